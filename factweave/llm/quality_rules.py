"""Quality rules as one projection.

A threshold table names ratios of length, symbols, stop words and lines. It is compiled into one
Spark projection of built-in functions: no user function, no shuffle, every row on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: white space between words, and the symbols that count
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# fixed values: frequent function words of the languages at hand
STOP_WORDS = (
    "a an and are as at be but by for from he in is it of on or that the this to was with "
    "au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con del el ella es las lo los más no para por se su una y "
    "aber auf das dem den der die ein eine für ich im ist mit nicht sich sie und von zu"
).split()


@dataclass(frozen=True)
class Threshold:
    """A document passes when ``low <= value <= high``; a missing bound is open. ``least_words`` limits it to texts at least so long."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


THRESHOLDS = (
    Threshold("word_length", "mean_word_chars", 2.0, 15.0),
    Threshold("symbols", "symbol_ratio", high=0.15),
    Threshold("lines", "dup_line_ratio", high=0.3),
    Threshold("stop_words", "stop_kinds", low=2, least_words=50),
    Threshold("line_length", "words_per_line", low=1.5, least_words=50),
    Threshold("alphabetic", "letter_ratio", low=0.5, least_words=20),
)

WINDOW = 5


def _windows(words: Column, n: Column) -> Column:
    """A hash for each five-word window; null where a text is too short to hold two."""
    each = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))))
    return F.when(n > WINDOW, F.slice(each, 1, n - (WINDOW - 1)))


def _covered(windows: Column) -> Column:
    """Words that lie in a window found twice or more, the first find included.

    Only texts with such a window come here. The hashes are sorted with their places, so that equal ones are
    neighbours; each repeated place, back in order, adds the words up to the next one, five at most.
    """
    keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    own = lambda k, f: F.get(F.transform(F.array(k), f), F.lit(0))  # noqa: E731  binds k, so that it is computed once
    marked = own(keyed, lambda k: F.sort_array(F.array_compact(F.transform(k, lambda x, i: F.when((F.get(k, i - 1)["h"] == x["h"]) | (F.get(k, i + 1)["h"] == x["h"]), x["i"])))))
    return own(marked, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios that thresholds may name. A null text counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("_t", t).withColumn("_w", F.array_remove(F.split("_t", SPACE + "+"), ""))
    n = F.size("_w")
    df = df.withColumn("n_words", n.cast("long")).withColumn("_k", _windows(F.col("_w"), n))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({
        "word_chars": (F.char_length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        # a filter on the results would copy these expressions into itself, level by level; the partition's number stops that
        "n_repeat_words": F.when((F.spark_partition_id() >= 0) & (F.size(F.array_distinct("_k")) < F.size("_k")), _covered(F.col("_k"))).otherwise(0).cast("long"),
        "_marks": F.regexp_count("_t", F.lit(r"[\x21-\x40\x5B-\x60\x7B-\x7E]")).cast("long"),
        "stop_kinds": F.size(F.array_intersect("_w", F.array(*map(F.lit, STOP_WORDS)))).cast("long"),
    })
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return df.withColumns({
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "letter_ratio": (F.col("word_chars") - F.col("_marks")) / chars,
        "repeat_percent": 100 * F.col("n_repeat_words") / words,
    }).drop("_t", "_w", "_k", "_l", "_marks")


def compiled(thresholds: tuple[Threshold, ...]) -> Column:
    """The names of the thresholds that a row breaks, as one array column."""
    broken = []
    for x in thresholds:
        value, wrong = F.col(x.value), F.lit(False)
        if x.low is not None:
            wrong = wrong | (value < x.low)
        if x.high is not None:
            wrong = wrong | (value > x.high)
        if x.least_words:
            wrong = wrong & (F.col("n_words") >= x.least_words)
        broken.append(F.when(wrong, F.lit(x.name)))
    return F.array_compact(F.array(*broken))


def quality_rules(docs: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """One row per input row: its id, the counts, ``base_failed``, ``broken`` (names of broken thresholds) and ``kept``.

    Null and empty texts have no words, so they fail the base. Repeated rows are judged alike, extra columns are
    ignored, an empty table gives no rows. A window is identified by a 64-bit hash within its own text.
    """
    df = features(docs.select("doc_id", F.col(text).alias("text")))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.withColumn("broken", compiled(thresholds)).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("text")
