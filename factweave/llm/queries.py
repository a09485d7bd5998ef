"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.functions.storage import stored
from factweave.llm.centroid_clusters import cluster, inertia, integer_vectors
from factweave.llm.decontaminate import decontaminate
from factweave.llm.fingerprints import as_hex, fingerprint_documents, likeness, near_prints
from factweave.llm.language_id import fit as fit_languages, language_id
from factweave.llm.line_dedup import line_dedup
from factweave.llm.merkle_manifest import build, folded, leaf_digest, proofs, siblings
from factweave.llm.ngram_join import ngram_jaccard_join
from factweave.llm.quality_rules import quality_rules
from factweave.llm.source_mix import mix_sources
from factweave.llm.suffix_dedup import suffix_dedup
from factweave.llm.token_counts import token_counts
from factweave.llm.toxicity import fit as fit_toxicity, toxicity
from factweave.llm.url_filter import url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, of: int) -> Column:
    """The remainder of crc32 of an id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda doc_id: F.coalesce(fold(doc_id, 4) == 2, F.lit(False))
    named = language_id(docs.select("doc_id", "text"), fit_languages(docs, held_out))
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item found in a document."""
    done = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), exact=True)
    return done.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", F.round("leak.share", 6).alias("share"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda doc_id: F.coalesce(fold(doc_id, 3) == 1, F.lit(False))
    scored = toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels, held_out))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an id divisible by 20 are also searched for: ``n_near`` others have fingerprints within four bits."""
    done = stored(fingerprint_documents(table(spark, sf_dir, "documents")))
    prints = done.groupBy("f1", "f2").agg(F.count("*").alias("n"))
    asked = F.col("doc_id") % 20 == 0
    found = near_prints(prints, done.where(asked)).groupBy("f1", "f2").agg(F.sum(F.aggregate("near", F.lit(0).cast("long"), lambda n, x: n + x["n"])).alias("near"))
    f, e, n = ([F.col(f"{side}f1"), F.col(f"{side}f2")] for side in ("", "edited_", "next_"))
    return done.join(found, ["f1", "f2"], "left").select(
        "doc_id", "n_chars", "edited_sha256", as_hex(*f).alias("fingerprint"), as_hex(*e).alias("edited_fingerprint"), likeness(*f, *e).alias("near_edited"), likeness(*f, *n).alias("near_next"), F.when(asked, F.col("near") - 1).alias("n_near")
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    found = inertia(cluster(vectors, F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof; where 5 divides the crc32 of its id, its root is recomputed with A-Z of its text lower-cased."""
    columns = ["doc_id", "source", "lang", "n_chars"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(fold(F.col("doc_id"), 5) == 0, leaf_digest([*map(F.col, columns), lowered]))
    found = proofs(build(table(spark, sf_dir, "documents"), [*columns, "text"], kept={"tampered": tampered}))
    leaf = F.col("node.digest")
    rows = found.select(F.col("node.id").alias("doc_id"), leaf.alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("node.tampered", leaf), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_suffix_dedup, op4_token_counts, op5_quality_rules, op6_ngram_join, op7_line_dedup, op8_decontaminate, op9_source_mix, op10_toxicity, op11_fingerprints, op12_centroid_clusters, op13_merkle_manifest)}
