"""Each operator against brute force on the smallest table, and on odd rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import language_id as L, queries as Q, source_mix, toxicity as X
from factweave.llm.decontaminate import decontaminate
from factweave.llm.line_dedup import line_dedup
from factweave.llm.ngram_join import ngram_jaccard_join, one_of_each
from factweave.llm.quality_rules import quality_rules
from factweave.llm.suffix_dedup import suffix_dedup
from factweave.llm.suffix_repeats import maximal_repeats
from factweave.llm.token_counts import Automaton, read_vocabulary, token_counts
from factweave.llm.url_filter import url_filter

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# 1 -------------------------------------------------------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def rule_of(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    odd = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?y"), (4, "http://org"), (5, "ftp://x.com/fr/://a#b"), (6, ""), (6, ""), (7, "http://badorg/es/1"), (None, "s://é.com/de/1?u=http://z.org/"), (9, "a://b.org\n/x")]
    pages = spark.createDataFrame(odd, "page_id long, url string").withColumn("host", F.lit(1)).unionByName(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", F.lit(1).alias("host")))
    got = Counter((r.page_id, r.host, r.path, r.rule) + ((r.verdict,) if r.rule else ()) for r in url_filter(pages).collect())
    want = Counter((r.page_id, h, p, rule) + ((v,) if rule else ()) for r in pages.collect() for h, p, rule, v in [rule_of(r.url)])
    assert got == want
    assert url_filter(pages.limit(0)).count() == 0


def test_url_templates_reject_by_purity(spark):
    rows = [(k, f"http://a.com/de/{k}") for k in range(60)] + [(100 + k, f"http://a.com/xx/{k}") for k in range(5)] + [(200 + k, f"http://b.net/{k}/w{k * 31 % 97}") for k in range(60)]
    out = {r.page_id: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert out[3].template == "a.com/de/{n}" and out[3].purity > 0.8 and out[102].verdict == "allow"
    assert out[210].template == "b.net/{n}/*"


# 2 -------------------------------------------------------------------------------------------------------------


def test_language(spark, docs, odd, empty):
    held = lambda d: F.coalesce(Q.fold(d, 4) == 2, F.lit(False))
    model = L.fit(docs, held)
    got = docs.select("doc_id", "lang").join(L.language_id(docs.select("doc_id", "text"), model), "doc_id").where(held(F.col("doc_id"))).select((F.col("lang") == F.col("lang_pred")).cast("double").alias("x")).agg(F.avg("x")).first()[0]
    assert got >= 0.9
    named = L.language_id(odd, model)
    assert named.count() == odd.count() and {r.lang_pred for r in named.where("doc_id in (1, 2, 3)").collect()} == {"und"}
    assert named.where("score < 0 or score > 1").count() == 0 and L.language_id(empty, model).count() == 0
    assert L.language_id(odd, L.fit(empty, held)).where("lang_pred <> 'und'").count() == 0
    marks = docs.sparkSession.createDataFrame([(1, "\u00b2 \u00bd \u2460 \u2167"), (2, "12 + 4 = 16 _ !"), (3, "\u00b2 the")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in L.language_id(marks, model).collect()} == {1: True, 2: True, 3: False}
    assert Q.op2_language_id(spark, SF).where(F.col("held_out") != held(F.col("doc_id"))).count() == 0
    assert zlib.crc32(b"17") % 4 == spark.range(1).select(Q.fold(F.lit(17), 4)).first()[0]


# 3 -------------------------------------------------------------------------------------------------------------


def removed(rows, least=200):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + least] for _, t in raw for i in range(len(t) - least + 1))
    out = []
    for d, t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id % 2 = 0").unionByName(odd.select("doc_id", "text"))
    done = suffix_dedup(docs.select("*", *(F.lit(1).alias(k) for k in ("kept", "pairs", "r", "_text", "_r", "rest", "of", "none", "c0"))))
    assert done.columns[:2] == ["doc_id", "text"] and {"pairs", "_text", "_r", "rest", "c0"} <= set(done.columns)
    got = sorted((tuple(r) for r in done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)
    assert got == removed(rows_of(docs))
    assert suffix_dedup(empty).count() == 0


def test_windows_of_frequent_anchors(spark, monkeypatch):
    """Anchors that are dealt with window by window give the same bytes."""
    from factweave.llm import suffix_dedup as S

    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    common = " ".join(word() for _ in range(50))
    rows = [(k, " ".join(word() for _ in range(30)) + common + " ".join(word() for _ in range(30))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = S.frequent_anchors
    monkeypatch.setattr(S, "frequent_anchors", lambda d: real(d, local=3, least=3, share=10**9))
    assert len(real(docs.select(F.lit(0).alias("r"), "text"), local=3, least=3, share=10**9)[0]) > 0
    got = sorted((tuple(r) for r in S.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)
    assert got == removed(rows)


def test_maximal_repeats_have_all_occurrences():
    random.seed(5)
    for _ in range(60):
        base = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 20))) for _ in range(4)]
        texts = [b"".join(random.choice(base) for _ in range(random.randint(0, 3))) for _ in range(random.randint(1, 7))]
        g, t, s, n = (x.tolist() for x in maximal_repeats(texts, np.full(len(texts), -1), np.array([len(x) for x in texts]), 4))
        for q in set(g):
            found = [texts[a][b : b + c] for gg, a, b, c in zip(g, t, s, n, strict=True) if gg == q]
            assert len(set(found)) == 1
            assert len(found) == sum(x.startswith(found[0], i) for x in texts for i in range(len(x)))


# 4 -------------------------------------------------------------------------------------------------------------


def greedy(word, pieces, longest):
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces)
        n += 1
    return n


def test_token_counts(docs, odd, empty):
    pieces = read_vocabulary()
    have, longest = set(pieces), max(map(len, pieces))
    table = docs.select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text").where("doc_id <> 7 or doc_id is null"))
    want = sorted(((d, len(w), sum(greedy(b" " + x.encode(), have, longest) for x in w)) for d, t in rows_of(table) for w in [re.findall(WORD, t or "")]), key=str)
    assert sorted((tuple(r) for r in token_counts(table.withColumn("n_tokens", F.lit("x"))).select("doc_id", "n_words", "n_tokens").collect()), key=str) == want
    assert token_counts(empty).count() == 0


def test_automaton_on_a_small_vocabulary():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abcd", b" a", b"bc", b"bcd", b" abcx"]
    a = Automaton(pieces)
    random.seed(1)
    words = ["".join(random.choice("abcdx") for _ in range(random.randint(1, 9))).encode() for _ in range(300)]
    ends = np.cumsum([len(w) for w in words])
    got = a.lengths(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert got.tolist() == [greedy(b" " + w, set(pieces), 6) for w in words]
    with pytest.raises(ValueError, match="single byte"):
        Automaton([b"ab"])
    assert base64.b64encode(b" the") in open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read()


# 5 -------------------------------------------------------------------------------------------------------------


def base_counts(text):
    t = text or ""
    w = re.findall(WORD, t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_counts(docs, odd, empty):
    table = docs.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    got = sorted((tuple(r) for r in quality_rules(table.withColumn("n_words", F.lit("x"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = sorted(((d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]) for d, t in rows_of(table) for c in [base_counts(t)]), key=str)
    assert got == want
    assert quality_rules(table).where("base_failed and kept").count() == 0 and quality_rules(empty).count() == 0
    plan = quality_rules(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# 6 -------------------------------------------------------------------------------------------------------------


def components(rows):
    """By brute force: rows are linked one by one, whatever their ids."""
    sets = []
    for d, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    holders, up = defaultdict(list), list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    both = Counter()
    for i, (_, s) in enumerate(sets):
        for g in s:
            both.update((j, i) for j in holders[g])
            holders[g].append(i)
    for (i, j), k in both.items():
        if 100 * k >= 75 * (len(sets[i][1]) + len(sets[j][1]) - k):
            up[top(j)] = top(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min((x for x in (d, least.get(top(i))) if x is not None), default=None)
    return sorted(((d, len(s), least[top(i)]) for i, (d, s) in enumerate(sets)), key=str)


def test_ngram_join(spark, docs, odd, empty):
    random.seed(2)
    base = [f"w{k}" for k in range(150)]
    near = []
    for k in range(120):  # one group whose members are at all distances from the threshold
        w = base.copy()
        for _ in range(k // 12):
            w[random.randrange(150)] = f"e{random.randrange(40)}"
        near.append((1000 + k, " ".join(w[: 150 - k % 3])))
    table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    table = table.unionByName(spark.createDataFrame([(None, near[7][1]), (None, near[7][1] + " x"), (None, "alone " * 9), (1003, near[90][1])], "doc_id long, text string"))
    clashing = table.select("*", *(F.lit(1).alias(k) for k in ("n", "c", "th", "map", "o", "word", "bits", "held", "component_id")))
    assert sorted((tuple(r) for r in ngram_jaccard_join(clashing).collect()), key=str) == components(rows_of(table))
    assert ngram_jaccard_join(odd).count() == odd.count() and ngram_jaccard_join(empty).count() == 0


def test_one_of_each_group_stays(spark, odd, empty):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, "b"), (1, text + " x", "a"), (5, "a text of its own under the same id as a copy", "c"), (5, "a text of its own under the same id as a copy", "c"), (None, text, "d")]
    rows += [(None, "no id and of its own, alone in the table", "e"), (None, "another without an id, alone as well it is", "f"), (7, None, "g"), (7, "", "h"), (8, " ", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("i", F.lit(3)).withColumn("t", F.lit("x"))
    left = one_of_each(docs)
    assert left.columns == docs.columns and sorted(r["row"] for r in left.collect()) == ["a", "c", "e", "f", "g", "h", "i"]
    # every group of the brute-force version keeps one row, and every row that is alone stays
    table = odd.select("doc_id", "text")
    kept = Counter(r.doc_id for r in one_of_each(table).collect())
    assert kept == Counter({1: 1, 2: 1, 3: 1, 4: 1, None: 1, 5: 1, 7: 1, 8: 1, 9: 1, 10: 1})
    assert one_of_each(empty).count() == 0


# 7 -------------------------------------------------------------------------------------------------------------


def without_lines(rows):
    first, out = {}, []
    for d, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = t.split("\n")
        for i in range(len(lines) - 2):
            if "".join(lines[i : i + 3]).strip(" "):
                first.setdefault(tuple(lines[i : i + 3]), (d, t, i))
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = {j for i in range(len(lines) - 2) if "".join(lines[i : i + 3]).strip(" ") and first[tuple(lines[i : i + 3])] != (d, t, i) for j in range(i, i + 3)}
        out.append((d, 0 if t is None else len(lines), len(gone), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def test_line_dedup(docs, odd, empty):
    table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    clashing = table.select("*", *(F.lit(7).alias(k) for k in ("n_removed", "_gone", "_id", "_print", "_flags", "row", "id", "print", "of", "its", "places", "gone", "left", "lines")))
    done = line_dedup(clashing)
    assert done.where("_gone <> 7 or _id <> 7 or _flags <> 7 or row <> 7 or left <> 7 or places <> 7").count() == 0
    got = sorted((tuple(r) for r in done.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str)
    assert got == without_lines(rows_of(table))
    assert line_dedup(empty).count() == 0
    assert "Python" not in line_dedup(table)._jdf.queryExecution().executedPlan().toString()


# 8 -------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: re.findall(r"[0-9A-Za-z\u0080-\uffff]+", r.text.lower()) for r in bench.collect()}
    want = set()
    for d, t in rows_of(docs):
        w = " " + " ".join(re.findall(r"[0-9A-Za-z\u0080-\uffff]+", (t or "").lower())) + " "
        want |= {(d, i) for i, x in items.items() if " " + " ".join(x) + " " in w}
    found = decontaminate(docs, bench).select("doc_id", F.explode("leaks").alias("k")).select("doc_id", "k.item_id")
    assert {tuple(r) for r in found.collect()} == want and want
    # a paraphrase: two words of an item changed and one put in
    some = {i: x for i, x in items.items() if len(x) > 20}
    changed = [(10_000 + i, "Before it all. " + " ".join(["other" if k in (4, 9) else y for k, y in enumerate(x)][:12] + ["extra"] + x[12:]) + " and after") for i, x in some.items()]
    more = decontaminate(docs.select("doc_id", "text").unionByName(spark.createDataFrame(changed, "doc_id long, text string")), bench)
    assert {r.doc_id for r in more.where("size(leaks) > 0 and doc_id >= 10000").collect()} == {d for d, _ in changed}
    blank = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "...")], "item_id long, text string")
    assert decontaminate(odd, blank).where("size(leaks) > 0").count() == 0 and decontaminate(odd, bench).count() == odd.count()
    assert decontaminate(empty, bench).count() == 0


# 9 -------------------------------------------------------------------------------------------------------------


def test_mix(spark, docs, odd, empty):
    out = source_mix.mix_sources(docs)
    rows = out.collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((d, len(re.findall(WORD, t or ""))) for d, t in rows_of(docs))
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by = defaultdict(lambda: [0, 0.0])
    for r, s in zip(sorted(rows, key=lambda r: r.doc_id), [x[1] for x in sorted((y.doc_id, y.source) for y in docs.collect())], strict=True):
        by[s][0] += r.taken
        by[s][1] = r.target
    assert all(abs(t - target) <= 128 for t, target in by.values())
    assert abs(sum(t for _, t in by.values()) - sum(r.size for r in rows)) < 1e-6 * sum(r.size for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, source_mix.mix_sources(docs.repartition(5)).collect()))
    assert source_mix.mix_sources(odd).count() == odd.count() and source_mix.mix_sources(empty).count() == 0


def test_targets_stop_at_their_ceiling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 90)], "source string, size long")
    got = {r.source: r.target for r in source_mix.source_targets(sizes).collect()}
    # weights 5, 2, 1, 5: a and the null source are full at 30 and 270, the rest goes 2 to 1
    assert got["a"] == 30 and got[None] == 270 and got["b"] == pytest.approx(1200) and got["c"] == pytest.approx(600)


def test_apportionment_is_by_highest_quotients(spark):
    random.seed(3)
    shares = [(g, k, float(random.randint(0, 500)), seats) for g, seats in (("x", 37), ("y", 3), ("z", 0), ("w", 900)) for k in range(9)]
    df = spark.createDataFrame(shares, "g string, k long, share double, seats long")
    got = {(r.g, r.k): r.quota for r in source_mix.apportion(df, ["g"], F.col("k"), "share", "seats").collect()}
    for g, seats in (("x", 37), ("y", 3), ("z", 0), ("w", 900)):
        won = Counter()
        for _ in range(seats):
            won[max((k for gg, k, s, _ in shares if gg == g), key=lambda k: (next(s for gg, kk, s, _ in shares if (gg, kk) == (g, k)) / (2 * won[k] + 1), -k))] += 1
        assert {k: won[k] for k in range(9)} == {k: got[g, k] for k in range(9)}


# 10 ------------------------------------------------------------------------------------------------------------


def best_segments(scores):
    """Maximal segments by definition: divide at the best one, again and again."""
    best, span = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if (s := sum(scores[i:j])) > best + 1e-12:
                best, span = s, (i, j)
    if span is None:
        return []
    i, j = span
    left, right = best_segments(scores[:i]), best_segments(scores[j:])
    return [*left, (i, j), *((a + j, b + j) for a, b in right)]


def test_segments_are_all_maximal_ones():
    random.seed(6)
    for _ in range(200):
        s = [random.choice([-3, -2, -1, 1, 2, 4]) + random.random() / 100 for _ in range(random.randint(0, 12))]
        assert sorted((a, b) for a, b, _ in X.maximal_segments(np.array(s))) == sorted(best_segments(s))


def test_segments_take_time_in_proportion():
    falling = np.tile([1.0, -1.5], 200_000)  # every segment starts lower than all before it
    rising = np.concatenate([-np.arange(60_000, 0, -1.0).repeat(2) * np.tile([1, -0.5], 60_000)])
    assert len(X.maximal_segments(falling)) == 200_000 and X.maximal_segments(rising)
    took = []
    random.seed(8)
    for n in (20_000, 40_000):
        began = time.perf_counter()
        X.maximal_segments(np.array([random.choice([-1.02, 1.0]) for _ in range(n)]))
        took.append(time.perf_counter() - began)
    assert took[1] < 6 * took[0] + 0.05


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = Q.op10_toxicity(spark, sf).join(labels, "doc_id").where("held_out")
    tp, fp, p = (out.where(w).count() for w in ("predicted = 1 and toxic = 1", "predicted = 1 and toxic = 0", "toxic = 1"))
    assert tp >= 0.5 * p and fp <= 0.05 * out.count()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = lambda d: F.coalesce(Q.fold(d, 3) == 1, F.lit(False))
    model = X.fit(docs, labels, held)
    scored = X.toxicity(odd, model)
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert X.toxicity(empty, model).count() == 0
    none = X.fit(docs, labels.limit(0), held)
    assert X.toxicity(odd, none).where("predicted = 1").count() == 0
