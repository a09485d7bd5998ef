"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Token scores (of words, or of their beginnings where these tell more) are log-odds of toxic against clean labelled text under an informative Dirichlet prior. A text's
segments of highest sum are all found in one pass; the chance that clean text of that length holds such a segment
follows an extreme-value law whose two constants are fitted on clean labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factweave.functions.storage import cut
from factweave.llm.textkit import blocks, slices

#: bytes of the beginnings that stand in for words seen rarely
BEGINNINGS = (3, 4, 5, 6, 7, 8)
# letters and digits make words; other bytes of ASCII stand between them
_BREAK = np.ones(256, dtype=bool)
_BREAK[128:] = False
for _span in (range(48, 58), range(65, 91), range(97, 123)):
    _BREAK[list(_span)] = False


def training_rows(docs: DataFrame, labels: DataFrame, held_out, at_most: int, text: str = "text") -> DataFrame:
    """``doc_id, toxic, text`` of labelled documents outside the held-out fold, about ``at_most`` of them.

    The sample is by a hash of doc_id against a rate, so it is the same in every run. It is what the classifier is
    fitted on; everything else reads all documents. The labels kept are few enough to broadcast by that bound.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    rate = min(1.0, at_most / max(n, 1))
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < round(rate * 1_000_000))
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")


def features(block) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and of its beginnings (0 where the word is no longer), then starts, ends and rows of words."""
    low = block.lowered()
    starts, ends, first = low.words(_BREAK[low.data])
    sums, down = low.sums()
    out = [slices(sums, down, starts, ends)]
    for n in BEGINNINGS:
        cut_at = np.minimum(starts + n, ends)
        out.append(np.where(cut_at < ends, slices(sums, down, starts, cut_at) ^ np.uint64(n), np.uint64(0)))
    return out, starts, ends, first


def feature_counts(rows: DataFrame) -> DataFrame:
    """``key, y, n``: toxic and clean rows that hold a feature, summed inside each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text"), 1 << 20):
                keys, _, _, first = features(block)
                each = [np.unique(np.concatenate([k[first[r] : first[r + 1]] for k in keys])) for r in range(block.rows)]
                whole = np.concatenate(each)
                says = np.repeat(toxic[block.first : block.first + block.rows], [len(x) for x in each])
                found, at = np.unique(whole[whole != 0], return_inverse=True)
                y = np.bincount(at, weights=says[whole != 0], minlength=len(found)).astype(np.int64)
                all_of = np.bincount(at, minlength=len(found))
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(y), pa.array(all_of - y)], ["key", "y", "n"])

    counts = rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "key long, y long, n long")
    return counts.groupBy("key").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))


def token_scores(rows: DataFrame, vocabulary: int = 50_000, prior: float = 0.1, least_docs: int = 3, least_z: float = 3.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted feature hashes, their scores and absolute z: log-odds with a Dirichlet prior, damped by their error.

    The prior is worth ``prior`` times all counts and follows the feature's share in them, so what is seen rarely is
    drawn to zero; what lies under ``least_z`` scores zero. At most ``vocabulary``
    features of the highest absolute z are kept, which bounds the model that tasks receive.
    """
    seen = cut(feature_counts(rows).where(F.col("y") + F.col("n") >= least_docs))
    all_y, all_n = seen.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not all_y or not all_n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0)
    a, weight = prior * (F.col("y") + F.col("n")), prior * (all_y + all_n)
    odds = lambda k, whole: F.log((k + a) / (F.lit(whole + weight) - k - a))
    delta = odds(F.col("y"), float(all_y)) - odds(F.col("n"), float(all_n))
    z = delta / F.sqrt(1 / (F.col("y") + a) + 1 / (F.col("n") + a))
    table = seen.select("key", delta.alias("delta"), z.alias("z")).where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "key").limit(vocabulary).toPandas()
    hashes, z = table["key"].to_numpy(np.int64).view(np.uint64), np.abs(table["z"].to_numpy())
    score, order = table["delta"].to_numpy(), np.argsort(hashes)
    return hashes[order], score[order], z[order]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, disjoint, in one pass over the positive runs.

    Each open segment keeps the running sum before it and at its end, and the place of the nearest earlier one that
    starts lower. A new one is joined with its own nearest, when that one ends lower than the new one; else it stands by
    itself. The search for the nearest goes from place to place, so no segment is passed over twice.
    """
    out: list[tuple[float, float, int, int, int]] = []
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    for i in positive.tolist():
        left, right, start, j = float(sums[i]), float(sums[i + 1]), i, len(out) - 1
        while True:
            while j >= 0 and out[j][0] >= left:
                j = out[j][4]
            if j < 0 or out[j][1] >= right:
                out.append((left, right, start, i + 1, j))
                break
            left, _, start, _, lower = out[j]
            del out[j:]
            j = lower
    return [(s, e, r - l) for l, r, s, e, _ in out]


class Scorer:
    """Word scores of a batch of texts and what follows from them."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, weights: np.ndarray, gap: float):
        self.hashes, self.values, self.weights, self.gap = hashes, values, weights, gap

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
        """Row, its number of words, its segments, and the bytes where its words start and end.

        Of a word and its beginnings the one of the highest z gives the score.
        """
        for block in blocks(texts):
            keys, starts, ends, first = features(block)
            hit, best = np.zeros(len(starts)), np.zeros(len(starts))
            for key in keys if len(self.hashes) else ():
                at = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
                better = (self.hashes[at] == key) & (self.weights[at] > best)
                hit[better], best[better] = self.values[at[better]], self.weights[at[better]]
            hit -= self.gap
            for r in range(block.rows):
                a, b = first[r], first[r + 1]
                yield block.first + r, int(b - a), maximal_segments(hit[a:b]), starts[a:b] - block.offsets[r], ends[a:b] - block.offsets[r]


def segment_sums(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """``toxic, words, sums``: the segment sums of each labelled row, highest first."""
    shared = rows.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, sorted((s[2] for s in segments), reverse=True)) for _, n, segments, _, _ in shared.value.scan(batch.column("text"))]
            yield pa.record_batch([batch.column("toxic"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.float64()))], ["toxic", "words", "sums"])

    return rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, words long, sums array<double>")


def extreme_value_fit(words: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """``lambda, K`` of P(best >= x) = 1 - exp(-K n exp(-lambda x)), from the moments of clean rows.

    Taking ln n off leaves a Gumbel variable: its variance gives lambda, its mean K.
    """
    if len(best) < 20:
        return 1.0, 0.1
    lam = 1.0
    for _ in range(20):
        rest = best - np.log(np.maximum(words, 1)) / lam
        new = np.pi / (np.sqrt(6.0) * max(float(np.std(rest)), 1e-3))
        if abs(new - lam) < 1e-6:
            break
        lam = 0.5 * (lam + new)
    rest = best - np.log(np.maximum(words, 1)) / lam
    return lam, float(np.exp(lam * (np.mean(rest) - 0.5772156649 / lam)))


class Model:
    """A fitted classifier: word scores, the extreme-value constants, and the odds of a text by its surprise."""

    def __init__(self, scorer: Scorer, lam: float, k: float, slope: float, shift: float):
        self.scorer, self.lam, self.k, self.slope, self.shift = scorer, lam, k, slope, shift

    def normal(self, words: int, sums: np.ndarray) -> np.ndarray:
        """Segment sums on the scale where clean text exceeds x, anywhere, with probability about exp(-x)."""
        return self.lam * sums - np.log(self.k * max(words, 1))

    def surprise(self, words: int, sums: np.ndarray) -> float:
        """Minus log10 of the probability that clean text has its r best segments add up so high, for the r that tells most.

        The sum T of r normal scores exceeds t with probability near exp(-t) t^(r-1) / (r! (r-1)!).
        """
        if not len(sums):
            return float(self.normal(words, np.zeros(1))[0] / np.log(10.0))
        x = np.sort(self.normal(words, sums))[::-1]
        total, r = np.cumsum(x), np.arange(1, len(x) + 1)
        log_factorial = np.cumsum(np.log(r))
        chance = total - (r - 1) * np.log(np.maximum(total, 1.0)) + 2 * log_factorial - np.log(r) - r * np.log(2.0)
        return float(max(chance[0] + np.log(2.0), chance.max())) / np.log(10.0)

    def score(self, surprise: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * surprise + self.shift, -50, 50)))


def logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by a few damped Newton steps; one imagined row of either label at either end keeps it finite."""
    x = np.concatenate([x, [x.min(initial=0.0), x.max(initial=1.0)]])
    y = np.concatenate([y, [0.0, 1.0]])
    mean, spread = float(x.mean()), float(x.std()) or 1.0
    u = (x - mean) / spread
    w = np.zeros(2)
    design = np.stack([u, np.ones_like(u)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fit(docs: DataFrame, labels: DataFrame, held_out, text: str = "text", at_most: int = 12_000, gap: float = 0.25) -> Model:
    """Fit on about ``at_most`` labelled documents (the documented bound of the sample).

    ``gap`` is taken off every word, so that segments end where toxic words do.
    """
    rows = cut(training_rows(docs, labels, held_out, at_most, text))
    scorer = Scorer(*token_scores(rows), gap)
    table = segment_sums(rows, scorer).toPandas()
    sums = [np.asarray(x, float) for x in table.sums]
    best, clean = np.array([x[0] if len(x) else 0.0 for x in sums]), (table.toxic == 0).to_numpy()
    lam, k = extreme_value_fit(table.words.to_numpy(float)[clean], best[clean])
    model = Model(scorer, lam, k, 1.0, -5.0)
    if len(table):
        surprise = np.array([model.surprise(n, x) for n, x in zip(table.words, sums, strict=True)])
        model.slope, model.shift = logistic_fit(surprise, table.toxic.to_numpy(float))
    return model


def toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, significant: float = 1.0) -> DataFrame:
    """All columns of ``docs`` with ``score``, ``predicted`` and ``passages`` (array of start, end, sum; bytes of the text).

    Every whole text is scanned. Passages are the segments whose expected number in clean text is under
    10 ** -``significant``. Null and empty texts have no segment and the score of such. Repeated rows are scored alike;
    columns of the added names are replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop("score", "predicted", "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            surprise, passages = [], []
            for _, n, segments, starts, ends in m.scorer.scan(batch.column(text)):
                sums = np.array([s[2] for s in segments])
                surprise.append(m.surprise(n, sums))
                high = m.normal(n, sums) >= significant * np.log(10.0)
                passages.append([{"start": int(starts[s[0]]), "end": int(ends[s[1] - 1]), "sum": s[2]} for s, h in zip(segments, high, strict=True) if h])
            score = m.score(np.array(surprise))
            made = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "score", "predicted", "passages"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(run, f"{columns}, score double, predicted int, passages array<struct<start: bigint, end: bigint, sum: double>>")
