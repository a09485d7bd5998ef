"""Aggregations and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def user_count(holders: DataFrame, memories: DataFrame, stances: tuple[str, ...] | None = None) -> DataFrame:
    """``memory_id, user_count``: distinct holders over all facts of the same key, one at least; a fact without a key counts its own.

    ``stances`` limits which holders count. Families are counted once, so a fact that very many hold is folded first.
    """
    held = holders if stances is None else holders.where(F.col("stance").isin(*stances))
    family = F.when(F.coalesce("content_key", F.lit("")) == "", F.col("memory_id")).otherwise(F.col("content_key"))
    keyed = memories.select("memory_id", family.alias("family"))
    per_family = held.join(keyed, "memory_id").groupBy("family").agg(F.count_distinct("user_id").alias("n"))
    return keyed.join(per_family, "family", "left").select("memory_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("user_count"))


def stances(holders: DataFrame) -> DataFrame:
    """holders of each fact by stance; an empty one means knows."""
    stance = F.coalesce(F.nullif(F.col("stance"), F.lit("")), F.lit("knows"))
    return holders.groupBy("memory_id", stance.alias("stance")).agg(F.count("*").alias("n"))


def controversy(rows: DataFrame, contradicts: DataFrame, owners: DataFrame) -> DataFrame:
    """the first contradicting fact of another owner: outgoing ones before incoming ones, then by id."""
    out = contradicts.select(F.col("src").alias("memory_id"), F.col("dst").alias("against"), F.lit(0).alias("way"))
    both = out.unionByName(contradicts.select(F.col("dst").alias("memory_id"), F.col("src").alias("against"), F.lit(1).alias("way")))
    whose = owners.select(F.col("memory_id").alias("against"), F.col("user_id").alias("against_user"))
    mine = rows.select("memory_id", "user_id").join(both, "memory_id").join(whose, "against").where("user_id <> against_user")
    first = mine.groupBy("memory_id").agg(F.min(F.struct("way", "against", "against_user")).alias("f"))
    return first.select("memory_id", "f.against", "f.against_user")


def overview(memories: DataFrame, entities: DataFrame, categories: DataFrame, groups: DataFrame) -> DataFrame:
    """one row of totals."""
    m = memories.agg(F.count("*").alias("memories"), F.count_distinct("user_id").alias("users"), F.count_distinct("content_key").alias("families"), F.count_if(F.col("certainty") >= 50).alias("firm"))
    one = lambda df, c, name: df.agg(F.count_distinct(c).alias(name))
    # four tables of one row each
    out = m.withColumn("_k", F.lit(1))
    for df in (one(entities, "entity_id", "entities"), one(categories, "category_id", "categories"), one(groups, "group_id", "groups")):
        out = out.join(df.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def top_contributors(memories: DataFrame, n: int = 8, sample: int | None = None) -> DataFrame:
    """owners with most facts; over all of them, or over the first ``sample`` by id."""
    own = memories if sample is None else memories.orderBy("memory_id").limit(sample)
    return own.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(n)


def access_projection(bindings: DataFrame, groups: DataFrame) -> DataFrame:
    """for each group its dedup group, members and leaders."""
    per = bindings.where("group_id is not null").groupBy("group_id").agg(F.count_distinct("subject").alias("members"), F.count_distinct(F.when(F.col("role").isin("groupadmin", "moderator"), F.col("subject"))).alias("leaders"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return groups.join(per, "group_id", "left").select("group_id", "dedup_group_id", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("leaders", F.lit(0)).alias("leaders"), F.coalesce("roles", F.lit("")).alias("roles"))


def relation_totals(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """edges by type with both ends allowed."""
    ok = allowed.select("memory_id").distinct()
    inside = edges.join(ok.withColumnRenamed("memory_id", "src"), "src", "left_semi").join(ok.withColumnRenamed("memory_id", "dst"), "dst", "left_semi")
    return inside.groupBy("edge_type").agg(F.count("*").alias("n"))


def category_counts(memories: DataFrame, tags: DataFrame, categories: DataFrame) -> DataFrame:
    """F8: members of each category and of its children that have any; empty ones are dropped, untagged facts are "uncategorized"."""
    inside = tags.join(memories.select("memory_id"), "memory_id", "left_semi")
    own = inside.groupBy("category_id").agg(F.count("*").alias("members"))
    children = categories.join(own, "category_id").groupBy(F.col("parent_id").alias("category_id")).agg(F.count("*").alias("children"))
    named = own.join(children, "category_id", "full").select("category_id", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("children", F.lit(0)).alias("children"))
    rest = memories.join(tags, "memory_id", "left_anti").agg(F.count("*").alias("members")).where("members > 0").select(F.lit("uncategorized").alias("category_id"), "members", F.lit(0).cast("long").alias("children"))
    return named.unionByName(rest)


def category_edges(edges: DataFrame, tags: DataFrame, shown: DataFrame) -> DataFrame:
    """edges between categories, by type, through the tags of both ends; only shown categories."""
    t = tags.join(shown, "category_id", "left_semi")
    a = t.select(F.col("memory_id").alias("src"), F.col("category_id").alias("src_category"))
    b = t.select(F.col("memory_id").alias("dst"), F.col("category_id").alias("dst_category"))
    return edges.select("src", "dst", "edge_type").join(a, "src").join(b, "dst").groupBy("src_category", "dst_category", "edge_type").agg(F.count("*").alias("n"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """one page of rows by an order that tells all of them apart; only as many as the pages so far are kept."""
    first = df.orderBy(*order).limit(number * size)
    w = Window.orderBy(*order)
    return first.withColumn("nth", F.row_number().over(w)).where(F.col("nth") > (number - 1) * size)


def memory_page(memories: DataFrame, edges: DataFrame, number: int, size: int = 24) -> tuple[DataFrame, DataFrame]:
    """facts by creation, newest first, and the edges inside the page."""
    rows = page(memories, [F.desc("created_at"), F.asc("memory_id")], number, size)
    ids = rows.select("memory_id")
    inside = edges.join(F.broadcast(ids.withColumnRenamed("memory_id", "src")), "src", "left_semi").join(F.broadcast(ids.withColumnRenamed("memory_id", "dst")), "dst", "left_semi")
    return rows, inside


def precedent_counts(shapes: DataFrame) -> DataFrame:
    """settled disputes by shape."""
    return shapes.groupBy("shape").agg(F.count("*").alias("n"))


def rule_proposals(counts: DataFrame, rules: DataFrame, after: int = 3) -> DataFrame:
    """shapes seen ``after`` times or more for which there is no rule yet."""
    return counts.where(F.col("n") >= after).join(rules, "shape", "left_anti")


def insight_health(insights: DataFrame, provenance: DataFrame, memory_groups: DataFrame, reserved: str) -> DataFrame:
    """witnesses of each insight, whether it has none, and the groups they are from but for the reserved one."""
    n = provenance.groupBy("insight_id").agg(F.count_distinct("memory_id").alias("witnesses"))
    g = provenance.join(memory_groups, "memory_id").where(F.col("group_id") != reserved).groupBy("insight_id").agg(F.array_join(F.array_sort(F.collect_set("group_id")), ",").alias("groups"))
    out = insights.select("insight_id").join(n, "insight_id", "left").join(g, "insight_id", "left")
    return out.select("insight_id", F.coalesce("witnesses", F.lit(0)).alias("witnesses"), F.col("witnesses").isNull().alias("orphan"), F.coalesce("groups", F.lit("")).alias("groups"))


def latency_summary(samples: DataFrame, key: str, value: str) -> DataFrame:
    """number, mean, median and 95th percentile with interpolation."""
    return samples.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"))


def open_debt(contradicts: DataFrame, owners: DataFrame) -> DataFrame:
    """open disputes by owner and kind, with totals over either."""
    from factweave.functions.text import dispute_kind

    whose = owners.select(F.col("memory_id").alias("src"), "user_id")
    return contradicts.where("resolved = 0").join(whose, "src").select("user_id", dispute_kind("strategy").alias("kind")).cube("user_id", "kind").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def key_family_size(memories: DataFrame) -> DataFrame:
    """F16: facts by key."""
    return memories.groupBy("content_key").agg(F.count("*").alias("n"))
