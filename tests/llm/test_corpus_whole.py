"""Cases in which a corpus operator once did less than its whole job."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from corpus_pipeline import drop_leaks
from factweave.llm import decontaminate as D
from factweave.llm.queries import op8_decontaminate
from factweave.llm.textkit import hash_words
from factweave.llm.toxicity import Model


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def short_items(n=400):
    """Items of 16 words and documents of 64 or 128 words with one of them, exact or a paraphrase, among words of other items."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    items = [[r.choice(words) for _ in range(16)] for _ in range(n)]
    docs = []
    for i, x in enumerate(items):
        said = [r.choice(words) if k in (2, 7, 12) else w for k, w in enumerate(x)]
        docs.append((i, " ".join([*r.choices(words, k=24), *said, *r.choices(words, k=24)])))
    # a passage mostly of another item, which pulls its vector away from the one said once
    docs += [(n + i, " ".join([*items[i - 1] * 2, *x, *items[i - 1] * 5])) for i, x in enumerate(items[:100])]
    return [(i, " ".join(x)) for i, x in enumerate(items)], docs


def owed(items, docs):
    """By brute force: every document against every item, with frequencies and rarest words counted here."""
    held = {d: t.split() for d, t in docs}
    df = Counter(w for t in held.values() for w in set(t))
    code = dict(zip(names := sorted({w for _, x in items for w in x.split()}), hash_words(names).tolist(), strict=True))
    out = set()
    for i, x in items:
        x = x.split()
        kinds = sorted(set(x), key=lambda w: (-math.log((len(docs) + 1) / (df[w] + 1)), code[w]))
        rare = set(kinds[: max(1, len(kinds) // 3)])
        out |= {(d, i) for d, t in held.items() if len(rare & set(t)) >= 0.5 * len(rare) and lcs(t, x) >= 0.7 * len(x)}
    return out


def found(spark, items, docs, **how):
    done = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **how)
    return {tuple(r) for r in done.select("doc_id", F.explode("leaks").alias("k")).select("doc_id", "k.item_id").collect()}


def test_paraphrased_items_are_found_as_by_brute_force(spark):
    """Short items, exact, paraphrased and drowned in others: nine of ten by the cosine, all of them by their words."""
    items, docs = short_items()
    want = owed(items, docs)
    got = found(spark, items, docs)
    print(f"recall {len(got & want)} of {len(want)}")
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 300
    assert found(spark, items, docs, exact=True) == want


def test_items_of_the_tables_are_found_by_the_cosine(spark):
    """All items of the larger table, half of their documents paraphrases, in texts of the table."""
    r = random.Random(9)
    sf = "/root/testdata/sf0.1"
    plain = lambda t: " ".join(re.findall(r"[0-9A-Za-z\u0080-\uffff]+", t.lower()))
    items = [(x.item_id, plain(x.text)) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    around = [plain(x.text).split() for x in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 20 = 3 and text is not null").limit(400).collect()]
    words = sorted({w for _, t in items for w in t.split()})
    docs = []
    for n, (i, t) in enumerate(items):
        said = [r.choice(words) if n % 2 and r.random() < 0.15 else w for w in t.split()]
        a, b = r.choice(around), r.choice(around)
        docs.append((i, " ".join([*a[: r.randrange(20, 60)], *said, *b[: r.randrange(20, 60)]])))
    docs += [(10_000 + k, " ".join(t[:300])) for k, t in enumerate(around)]
    want, got = owed(items, docs), found(spark, items, docs)
    print(f"recall {len(got & want)} of {len(want)}")
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 150


def test_the_directions_decide(spark, monkeypatch):
    """Without directions no passage is near an item, so nothing is found; a bar that no cosine reaches leaves nothing either."""
    items, docs = short_items(60)
    assert found(spark, items, docs)
    assert not found(spark, items, docs, least_cos=1.01)
    monkeypatch.setattr(D, "directions", lambda sample, it, rank: np.zeros((len(it.vocabulary), rank)))
    assert not found(spark, items, docs)


def test_rare_words_are_counted_over_all_the_segments_of_a_window():
    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(n))) for i, n in enumerate([5, 16, 60, 200] * 5)]
    it = D.Items(items)
    it.weigh(np.arange(len(it.vocabulary)), 1000)
    it.prepare(np.zeros((len(it.vocabulary), 1)), 0.7, 0.5)
    rows = [np.array([r.randrange(-1, len(it.vocabulary)) for _ in range(n)]) for n in (0, 1, 31, 32, 65, 700, 0, 300, 0)]
    first, at = np.cumsum([0, *map(len, rows)]), np.concatenate(rows).astype(int)
    row, start = D.passages(first)
    got = set(zip(*(x.tolist() for x in it.enough_rare(at, first)), strict=True))
    assert 0 < len(got) < len(row) * len(items)
    for p in range(len(row)):
        for i, rare in enumerate(it.rare):
            lo = max(0, start[p] - it.pads[i])
            window = set(rows[row[p]][lo : start[p] + 64 + it.pads[i]].tolist())
            assert (p, i) in got or len(rare & window) < 0.5 * len(rare)


def test_all_segments_of_a_text_count():
    got = Model(None, 1.0, 0.1, 1.0, 0.0).surprise(10_000, np.full(300, 12.0))
    x = 12.0 - math.log(1000.0)
    tells = [x * r - (r - 1) * math.log(x * r) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2.0) for r in range(1, 301)]
    assert max(tells) > max(tells[:40]) and abs(got - max(tells) / math.log(10.0)) < 1e-6


def test_items_far_from_their_passage_are_found_by_the_query_and_the_pipeline(spark, tmp_path):
    """Paraphrased items among words of one other item, said over and over: their passages lie near that one only."""
    items, docs = short_items(60)
    words = [t.split() for _, t in items]
    docs += [(1000 + i, " ".join(words[i - 1] * 2 + [f"x{k}" if k in (1, 5, 9, 13) else w for k, w in enumerate(x)] + words[i - 1] * 5)) for i, x in enumerate(words)]
    want = owed(items, docs)
    assert not want <= found(spark, items, docs)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r[:2] for r in op8_decontaminate(spark, str(tmp_path)).collect()} == want
    left = drop_leaks(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
