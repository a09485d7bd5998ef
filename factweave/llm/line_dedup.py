"""Line dedup: overlapping windows of three consecutive lines, found by hash over the whole corpus.

A window that occurs more than once keeps its first occurrence; every later one marks its three lines,
and the union of the marks is removed. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 3


def window_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, print, place, h1, h2``: one row per window of three lines of which one at least has a character.

    ``print`` is a hash of the text, so that different texts under one id stay apart; ``h1, h2`` are 128 bits in all.
    """
    lines = docs.select("doc_id", F.col(text).alias("t")).where("t is not null").select("doc_id", F.xxhash64("t").alias("print"), F.split("t", "\n").alias("lines")).where(F.size("lines") >= WINDOW)
    line = lambda i, k: F.get("lines", i + k)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("lines") - WINDOW),
        lambda i: F.when(
            F.trim(F.concat(*(line(i, k) for k in range(WINDOW)))) != "",
            F.struct(i.alias("place"), F.xxhash64(*(line(i, k) for k in range(WINDOW))).alias("h1"), F.xxhash64(F.lit(7), *(line(i, k) for k in range(WINDOW))).alias("h2")),
        ),
    )
    return lines.select("doc_id", "print", F.explode(F.array_compact(windows)).alias("w")).select("doc_id", "print", "w.*")


def later_windows(windows: DataFrame) -> DataFrame:
    """Windows that are not the first of their kind, in the order of doc_id (null first), print and place.

    The first is a grouped minimum, so a frequent window is folded before the shuffle; the join back to the
    occurrences has one row per kind on its other side, so adaptive execution may split a hot kind.
    """
    at = F.struct("doc_id", "print", "place")
    first = windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("not (first <=> last)")
    return windows.join(first, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first"))).select("doc_id", "print", "place")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def covered_ranges(places: Column) -> Column:
    """Ranges of lines (``at, to``) that the windows at these ascending places cover; windows that touch are one range."""
    step = lambda i: F.get(places, i) - F.get(places, i - 1)
    starts = F.filter(places, lambda p, i: (i == 0) | (step(i) > WINDOW))
    ends = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (step(i + 1) > WINDOW))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b + WINDOW).alias("to")))


def lines_outside(lines: Column, gone: Column) -> Column:
    """The lines that no range covers, joined again: what stands before the first, between two, and after the last."""
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1)["to"])
    end = lambda i: F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i)["at"])
    kept = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i)))
    return F.array_join(F.flatten(kept), "\n")


def line_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the lines of later windows taken out of ``text``, plus ``n_lines`` and ``n_removed``.

    Lines are what stands between line feeds, compared exactly. Texts of under three lines are left alone, as are
    nulls. Windows of blank lines only are never counted. Repeated rows (same id, same text) are one document and
    get the same result; rows that share an id but not a text are judged apart. Columns named n_lines or n_removed
    are replaced, all others kept, whatever their names. A text of very many lines takes work in proportion to them. An
    empty table gives no rows.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.drop("n_lines", "n_removed").columns)).alias("row"), F.col("doc_id").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("print"))
    covered = later_windows(window_table(docs, text)).groupBy(F.col("doc_id").alias("of"), F.col("print").alias("its")).agg(F.sort_array(F.collect_set("place")).alias("places"))
    joined = rows.join(covered, rows["id"].eqNullSafe(covered["of"]) & (rows["print"] == covered["its"]), "left")
    gone = F.when(F.col("places").isNotNull(), once(F.col("places"), covered_ranges))
    done = joined.withColumn("gone", gone).withColumn("left", F.when(F.col("places").isNotNull(), once(F.split("text", "\n"), lambda lines: once(F.col("gone"), lambda g: lines_outside(lines, g)))).otherwise(F.col("text")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_removed = F.coalesce(F.aggregate("gone", F.lit(0), lambda n, r: n + r["to"] - r["at"]), F.lit(0)).cast("long")
    own = [(F.col("left") if c == text else F.col("row").getField(c)).alias(c) for c in docs.drop("n_lines", "n_removed").columns]
    return done.select(*own, n_lines.alias("n_lines"), n_removed.alias("n_removed"))
