"""URL filters: a template tree of paths per host, judged by labelled purity.

Rules label the urls they fit. Paths become templates, segment by segment to their ends: segments that look like
identifiers, or that are a rare one of many children, turn into wildcards. From the ends upwards, branches of one parent
whose labels do not differ are merged, and a template is judged by the widest branch that its labels cannot be told
from; one whose smoothed share of blocked labels is high is rejected. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factweave.functions.storage import cut

# fixed values: the rules with their verdicts
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``page_id, host, path``; both are empty for a null url or one without ``://``."""
    u = F.col(url).cast("string")
    part = lambda k: F.coalesce(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def ruled(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits; null where none does.

    A rule is a host and the start of a path; it holds for the host and its subdomains.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _typed(segment: Column) -> Column:
    """Identifiers by their look: numbers, and hex strings of eight or more; a file ending stays."""
    end = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    body = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return F.when(body.rlike(r"^[0-9]+$"), F.concat(F.lit("{n}"), end)).when(body.rlike(r"^[0-9a-fA-F-]{8,}$"), F.concat(F.lit("{h}"), end)).otherwise(segment)


def _shaped(df: DataFrame) -> DataFrame:
    """All segments of the path, typed, as ``segs``."""
    return df.withColumn("segs", F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), _typed))


def templates(shapes: DataFrame, many: int = 20, rare: float = 0.05) -> DataFrame:
    """``shapes`` (distinct ``host, segs`` with ``n``) with ``node``, the template's segments.

    Level by level: a child that holds under ``rare`` of its parent's rows becomes ``*`` when the parent has more than
    ``many`` children. What hangs at a node as a single shape is no tree and ends as one segment, so there are as many
    levels as the longest path that two shapes share. Counts go up by grouped sums, so a hot host is folded before each
    shuffle.
    """
    live, ended, d = cut(shapes.withColumn("node", F.array().cast("array<string>"))), [], 0
    while True:
        ended.append(live.where(F.size("segs") <= d))
        rows = live.where(F.size("segs") > d).withColumn("seg", F.get("segs", F.lit(d)))
        child = rows.groupBy("host", "node", "seg").agg(F.sum("n").alias("_c"), F.count("*").alias("_s"))
        parent = child.groupBy("host", "node").agg(F.count("*").alias("_kids"), F.sum("_c").alias("_all"), F.sum("_s").alias("_shapes"))
        named = child.join(parent, ["host", "node"]).select("host", "node", "seg", F.when((F.col("_kids") > many) & (F.col("_c") < rare * F.col("_all")), "*").otherwise(F.col("seg")).alias("_t"), (F.col("_shapes") == 1).alias("_one"))
        rest = F.array_join(F.slice("segs", d + 1, F.size("segs")), "/")
        grown = cut(rows.join(named, ["host", "node", "seg"]).withColumn("node", F.concat("node", F.array(F.when(F.col("_one"), rest).otherwise(F.col("_t"))))).drop("seg", "_t"))
        ended.append(grown.where("_one").drop("_one"))
        live, d = grown.where("not _one").drop("_one"), d + 1
        if not live.where(F.size("segs") > d).limit(1).count():
            return cut(reduce(DataFrame.unionByName, [*ended, live]))


def _differs(block: Column, m: Column, of_block: Column, of_m: Column, z: float) -> Column:
    """Whether a branch's share of blocked labels lies outside of what its group's share lets expect."""
    rate = F.try_divide(of_block, of_m)
    spread = F.sqrt(F.try_divide(rate * (1 - rate), m))
    return F.coalesce((m > 0) & (of_m > m) & (spread > 0) & (F.abs(F.try_divide(block, m) - rate) > z * spread), F.lit(False))


def merged_branches(leaves: DataFrame, similar_z: float = 1.96) -> DataFrame:
    """``host, node, block, m``: for each leaf (``host, node, n_block, m``) the labels of the widest branch it is like.

    From the deepest level up, branches of one parent are compared with all of them together. Those that do not differ are
    one branch of the parent from there on, leaves without labels among them. Of those that do, the ones above and the
    ones below are merged with each other where they are alike. A branch, no leaf, without labels stays by itself, since
    nothing tells what it is like.
    """
    at = cut(leaves.select("host", "node", "node", F.lit(True).alias("leaf"), F.col("n_block").alias("block"), "m").toDF("host", "node", "item", "leaf", "block", "m"))
    done, inner = [], None
    for d in range(at.agg(F.max(F.size("item"))).first()[0] or 0, 0, -1):
        own = at.where("leaf").where(F.size("item") == d).select("host", "item", "leaf", "block", "m").distinct()
        items = own if inner is None else own.unionByName(inner)
        items = items.withColumn("up", F.slice("item", 1, d - 1)).withColumn("told", F.col("leaf") | (F.col("m") > 0))
        family = items.where("told").groupBy("host", "up").agg(F.sum("block").alias("f_block"), F.sum("m").alias("f_m"))
        both = items.join(family, ["host", "up"], "left")
        apart = F.col("told") & _differs(F.col("block"), F.col("m"), F.col("f_block"), F.col("f_m"), similar_z)
        side = F.when(apart, F.when(F.col("block") * F.col("f_m") > F.col("f_block") * F.col("m"), "above").otherwise("below")).when(F.col("told"), "core").otherwise("alone")
        sided = cut(both.withColumn("side", side))
        pools = sided.groupBy("host", "up", "side").agg(F.sum("block").alias("p_block"), F.sum("m").alias("p_m"))
        judged = sided.join(pools, ["host", "up", "side"])
        by_itself = (F.col("side") == "alone") | (F.col("side") != "core") & _differs(F.col("block"), F.col("m"), F.col("p_block"), F.col("p_m"), similar_z)
        judged = judged.select("host", "item", "leaf", "up", "side", F.when(by_itself, F.col("block")).otherwise(F.col("p_block")).alias("to_block"), F.when(by_itself, F.col("m")).otherwise(F.col("p_m")).alias("to_m"))
        moved = cut(at.join(judged, ["host", "item", "leaf"], "left"))
        done.append(moved.where("side <> 'core'").select("host", "node", F.col("to_block").alias("block"), F.col("to_m").alias("m")))
        here = F.col("side") == "core"
        at = moved.where("side is null or side = 'core'").select("host", "node", F.when(here, F.col("up")).otherwise(F.col("item")).alias("item"), F.when(here, False).otherwise(F.col("leaf")).alias("leaf"), F.when(here, F.col("to_block")).otherwise(F.col("block")).alias("block"), F.when(here, F.col("to_m")).otherwise(F.col("m")).alias("m"))
        inner = at.where("not leaf").where(F.size("item") == d - 1).select("host", "item", "leaf", "block", "m").distinct()
    return reduce(DataFrame.unionByName, [*done, at.select("host", "node", "block", "m")])


def template_tree(shapes: DataFrame, many: int = 20, rare: float = 0.05, similar_z: float = 1.96, prior: float = 10.0, reject: float = 0.8) -> DataFrame:
    """``host, segs, template, purity, rejected`` for distinct shapes with ``n, n_allow, n_block``."""
    shaped = templates(shapes, many, rare)
    leaves = cut(shaped.groupBy("host", "node").agg(F.sum("n_block").alias("n_block"), F.sum(F.col("n_allow") + F.col("n_block")).alias("m")))
    # half of the prior's weight says block, so the share of an unlabelled template is one half
    purity = (F.col("block") + prior / 2) / (F.col("m") + prior)
    judged = merged_branches(leaves, similar_z).select("host", "node", F.concat(F.col("host"), F.lit("/"), F.array_join("node", "/")).alias("template"), purity.alias("purity"), (purity >= reject).alias("rejected"))
    return cut(shaped.select("host", "segs", "node").join(judged, ["host", "node"])).select("host", "segs", "template", "purity", "rejected")


def url_filter(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages``.

    A rule's verdict stands (of two rules of one length that fit, the later by code point); other urls are blocked when
    their template is rejected. Null urls and such without ``://`` have an empty host and path, one template, and are
    judged like any other. Very long urls are read whole. Repeated rows are judged alike and all returned, other columns
    are ignored, an empty table gives no rows.
    """
    shaped = _shaped(ruled(parsed(pages, url), rules))
    labels = [F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("n_allow"), F.count_if(F.col("rule_verdict") == "block").alias("n_block")]
    tree = template_tree(shaped.groupBy("host", "segs").agg(*labels))
    verdict = F.coalesce("rule_verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return shaped.join(tree, ["host", "segs"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 9).alias("purity"))
