"""The template tree against a tree made in plain Python, and branches that part far from the host."""

import math
import random
from collections import Counter, defaultdict

import pytest

from factweave.llm.url_filter import merged_branches, templates, url_filter

URL = "page_id long, url string"


def tree_of(shapes, many, rare):
    """Templates of {(host, segs): n}, node by node."""
    out = {}

    def grow(host, node, group, d):
        here = [s for s in group if len(s) == d]
        deeper = [s for s in group if len(s) > d]
        out.update({(host, s): node for s in here})
        kids = defaultdict(list)
        for s in deeper:
            kids[s[d]].append(s)
        total = sum(shapes[host, s] for s in deeper)
        if len(deeper) == 1:
            out[host, deeper[0]] = (*node, "/".join(deeper[0][d:]))
            return
        into = defaultdict(list)
        for k, own in kids.items():
            into["*" if len(kids) > many and sum(shapes[host, s] for s in own) < rare * total else k].extend(own)
        for k, own in into.items():
            grow(host, (*node, k), own, d + 1)

    for host in {h for h, _ in shapes}:
        grow(host, (), [s for h, s in shapes if h == host], 0)
    return out


def differs(block, m, of_block, of_m, z=1.96):
    if not 0 < m < of_m:
        return False
    rate = of_block / of_m
    spread = math.sqrt(rate * (1 - rate) / m)
    return spread > 0 and abs(block / m - rate) > z * spread


def merged(leaves):
    """{node: (block, m)} of one host to the labels each leaf is judged by."""
    final, state = {}, {n: (n, True, b, m) for n, (b, m) in leaves.items()}
    for d in range(max(map(len, leaves)), 0, -1):
        items = {(i, leaf, b, m) for i, leaf, b, m in state.values() if len(i) == d}
        for up in {i[:-1] for i, *_ in items}:
            own = [x for x in items if x[0][:-1] == up]
            told = [x for x in own if x[1] or x[3] > 0]
            fb, fm = sum(x[2] for x in told), sum(x[3] for x in told)
            side = {x: "alone" if x not in told else "core" if not differs(x[2], x[3], fb, fm) else "above" if x[2] * fm > fb * x[3] else "below" for x in own}
            for x in own:
                pool = [y for y in own if side[y] == side[x]]
                pb, pm = sum(y[2] for y in pool), sum(y[3] for y in pool)
                alone = side[x] == "alone" or side[x] != "core" and differs(x[2], x[3], pb, pm)
                for n in [n for n, y in state.items() if y == x]:
                    if side[x] == "core":
                        state[n] = (up, False, pb, pm)
                    else:
                        final[n] = (x[2], x[3]) if alone else (pb, pm)
                        del state[n]
    return final | {n: (b, m) for n, (_, _, b, m) in state.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_and_branches_as_by_hand(spark, seed):
    rng = random.Random(seed)
    shapes = {(rng.choice(["h", "g"]), tuple(rng.choice("abcdefgh"[: rng.choice([2, 8])]) for _ in range(rng.randrange(6)))): rng.randrange(1, 30) for _ in range(160)}
    df = spark.createDataFrame([(h, list(s), n) for (h, s), n in shapes.items()], "host string, segs array<string>, n long")
    got = {(r.host, tuple(r.segs)): tuple(r.node) for r in templates(df, many=4, rare=0.2).collect()}
    assert got == tree_of(shapes, 4, 0.2) and any("*" in n for n in got.values())
    leaves = defaultdict(lambda: (0, 0))
    for (h, _), n in got.items():
        m = rng.choice([0, 0, 3, 40])
        leaves[h, n] = (rng.choice([0, m // 3, m]), m)
    rows = spark.createDataFrame([(h, list(n), b, m) for (h, n), (b, m) in leaves.items()], "host string, node array<string>, n_block long, m long")
    out = {(r.host, tuple(r.node)): (r.block, r.m) for r in merged_branches(rows).collect()}
    want = {(h, n): x for h in ("h", "g") for n, x in merged({n: x for (g, n), x in leaves.items() if g == h}).items()}
    assert out == want


def test_branches_that_part_at_the_fifth_segment(spark):
    """Under one long beginning one branch is blocked and one allowed; what is not labelled goes with its own branch."""
    rules = tuple((f"a.com/1x/2x/3x/4x/bad/{k}", "block") for k in range(10, 40)) + tuple((f"a.com/1x/2x/3x/4x/good/{k}", "allow") for k in range(10, 40))
    rows = [(k, f"http://a.com/1x/2x/3x/4x/bad/{k}") for k in range(10, 60)] + [(100 + k, f"http://a.com/1x/2x/3x/4x/good/{k}") for k in range(10, 60)]
    out = {r.page_id: r for r in url_filter(spark.createDataFrame(rows, URL), rules=rules).collect()}
    assert out[55].template == "a.com/1x/2x/3x/4x/bad/{n}" and out[55].verdict == "block" and out[155].verdict == "allow" and out[155].purity < 0.2


def test_similar_outliers_become_one(spark):
    """Two branches with few blocked labels each among many allowed ones are judged together."""
    rows = spark.createDataFrame([("h", ["x", k], b, m) for k, b, m in [("one", 8, 8), ("two", 7, 7), ("ok", 0, 90), ("none", 0, 0)]], "host string, node array<string>, n_block long, m long")
    got = {r.node[1]: (r.block, r.m) for r in merged_branches(rows).collect()}
    assert got["one"] == got["two"] == (15, 15) and got["ok"] == (0, 90) and got["none"] == (0, 0)


def test_long_urls_and_ties_of_rules(spark):
    deep = "http://a.com/" + "/".join(f"s{k}" for k in range(3000))
    rows = [(1, deep), (2, "http://a.com/q/w"), (3, "http://a.com/q/w"), (4, "http://a.com//"), (5, "http://a.com")]
    rules = (("a.com/q", "block"), ("a.com/q/", "allow"), ("com/q/w", "block"))
    out = spark.createDataFrame(rows, URL)
    got = {r.page_id: (r.rule, r.verdict, r.template) for r in url_filter(out, rules=rules).collect()}
    assert got[1][2] == deep[7:] and got[4][2] == got[5][2] == "a.com/"
    # of rules of one length the later by code point
    tie = url_filter(out, rules=(("a.com/q", "block"), ("com/q/w", "allow"))).where("page_id = 2").first()
    assert (tie.rule, tie.verdict) == ("com/q/w", "allow") and Counter(got[2][:2] for _ in "ab") == Counter(got[k][:2] for k in (2, 3))
