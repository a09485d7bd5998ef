"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get targets by weight, with a ceiling per source; the targets become whole blocks by highest
quotients, the blocks of a source become whole quotas of its shards the same way, and each shard gives
its quota as blocks of a seeded order of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.functions.storage import cut

# fixed value: the weights, by the order of the sources, repeating
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, source, size`` with the number of words as size; a null text has none."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = 3) -> DataFrame:
    """``source, source_size, target``: shares of the whole by weight, at most ``ceiling`` times the source.

    The excess of full sources goes to the others by weight. Ordered by ceiling over weight, the full ones come
    first; the level is the first one at which the next source is not full. One row per source is windowed here,
    not the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights)))).cast("double")).withColumn("cap", (ceiling * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("source_size").over(everyone), F.sum("w").over(everyone)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (weight - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    df = weighed.withColumn("level", level).withColumn("nth", F.row_number().over(order))
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct("nth", "level"))).over(everyone)
    return df.select("source", "source_size", F.least("cap", first["level"] * F.col("w")).alias("target"))


def apportion(shares: DataFrame, group: list[str], key: Column, share: str, seats: str) -> DataFrame:
    """Add ``quota``: the seats of each row when ``seats`` go by highest quotients ``share / (2k - 1)`` inside its group.

    A divisor a little too large gives seats that are surely among the highest; what is left, at most one and a half
    per row, is ranked by quotient. Ties go to the smaller key. Rows with no share get nothing.
    """
    whole = Window.partitionBy(*group)
    n, total = F.count("*").over(whole), F.sum(share).over(whole)
    df = shares.withColumn("_key", key).withColumn("_n", n).withColumn("_total", total.cast("double"))
    part = F.coalesce(F.try_divide(F.col(share).cast("double"), F.col("_total")), F.lit(0.0))
    df = df.withColumn("_base", F.floor(part * F.greatest(F.col(seats) - F.col("_n"), F.lit(0)) + 0.5).cast("long"))
    df = df.withColumn("_base", F.when(F.col(seats) > F.col("_n"), F.col("_base")).otherwise(0)).withColumn("_left", F.col(seats) - F.sum("_base").over(whole))
    tries = F.sequence(F.lit(1), F.ceil(part * (1.5 * F.col("_n") + F.greatest(F.lit(0), F.col("_left")))).cast("int") + 2)
    more = df.select(*group, "_key", "_base", "_left", share, F.explode(tries).alias("_k")).withColumn("_q", F.col(share) / (2 * (F.col("_base") + F.col("_k")) - 1))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_q").desc(), "_key", "_k"))
    won = more.where("_q > 0").withColumn("_rank", rank).where("_rank <= _left").groupBy(*[F.col(g).alias(f"_{g}") for g in group], F.col("_key").alias("_won")).agg(F.count("*").alias("_more"))
    same = won["_won"].eqNullSafe(df["_key"])
    for g in group:
        same = same & won[f"_{g}"].eqNullSafe(df[g])
    return df.join(won, same, "left").withColumn("quota", F.col("_base") + F.coalesce("_more", F.lit(0))).select(*shares.columns, "quota")


def mix_sources(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, ceiling: int = 3, block: int = 128, shard_scale: int = 1000, seed: int = 20) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``; taken counts words, repeats included.

    A source of S words has about sqrt(S / shard_scale) shards, so neither the shards of a source nor the documents of
    a shard grow into one large group. Within a shard the documents stand in seeded order and are cut into blocks of
    ``block`` words; the quota takes whole rounds of the shard, then the blocks from a seeded start on. No document is
    taken more than ``ceiling`` times. Null sources are one source; null texts have size 0; equal rows are told apart by
    nothing, so either may be the one taken; an empty table gives no rows. Reruns agree.
    """
    sizes = cut(sized(docs, text))
    targets = cut(source_targets(sizes, weights, ceiling))
    shards = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / shard_scale))).cast("long")
    renamed = targets.withColumn("n_shards", shards).withColumnRenamed("source", "_source")
    placed = sizes.join(renamed, sizes["source"].eqNullSafe(renamed["_source"])).drop("_source")
    placed = placed.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("n_shards")))
    flag = F.col("source").isNull()
    per_shard = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))

    whole = Window.partitionBy(F.lit(0))
    seats = targets.withColumn("_all", F.lit(0)).withColumn("_seats", F.round(F.sum("target").over(whole) / block).cast("long"))
    blocks = apportion(seats, ["_all"], F.struct(flag.alias("none"), F.col("source").alias("at")), "target", "_seats").select(F.col("source").alias("_source"), F.col("quota").alias("source_quota"))
    with_quota = per_shard.join(blocks, per_shard["source"].eqNullSafe(blocks["_source"])).drop("_source")
    quotas = apportion(with_quota, ["source"], F.col("shard"), "shard_size", "source_quota").select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "quota")
    # the blocks lie along the shard's documents, which repeat: whole rounds, then a run from a seeded block on
    size = F.greatest(F.col("shard_size"), F.lit(1))
    quotas = quotas.withColumn("words", F.least(F.col("quota") * block, ceiling * F.col("shard_size")))
    quotas = quotas.withColumn("rounds", F.floor(F.col("words") / size).cast("long")).withColumn("rest", F.col("words") % size)
    quotas = quotas.withColumn("start", F.pmod(F.xxhash64(F.lit(seed + 2), "_source", "_shard"), F.ceil(size / block).cast("long")) * block)

    order = Window.partitionBy("source", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("until", F.sum("size").over(order)).withColumn("since", F.col("until") - F.col("size"))
    df = laid.join(quotas, laid["source"].eqNullSafe(quotas["_source"]) & (laid["shard"] == quotas["_shard"]))
    end = F.col("start") + F.col("rest")
    over = lambda a, b: F.greatest(F.lit(0), F.least(F.col("until"), b) - F.greatest(F.col("since"), a))
    # a run that passes the end goes on at the shard's first block
    run = over(F.col("start"), end) + over(F.lit(0), end - F.col("shard_size"))
    taken = F.col("rounds") * F.col("size") + F.when(F.col("rest") > 0, run).otherwise(0)
    return df.select("doc_id", "size", "source_size", "target", F.least(taken, ceiling * F.col("size")).cast("long").alias("taken"))
