"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.llm import (cross_polytope, jaccard, language, licenses, mixing, page_text, pieces, pivot_clusters, quality_nbsvm,
                          quality_rules, ship, spelling, sql, suffix_dedup, unit_dedup)
from netsieve.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def piece_model_path() -> str:
    """The public vocabulary file; other installations pass their own path to ``pieces.encode``."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, oracle: str | None = None):
    def add(f):
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship.ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = shipped
        if oracle:
            ORACLE[name] = oracle
        return f
    return add


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode(table(spark, sf_dir, "documents"), piece_model_path())
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_jaccard_join", sql.JACCARD)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup", sql.SUFFIX_DEDUP)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op4_language_mixture")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    langs, logp = language.learn(docs.where(~held_out))
    return language.identify(docs, langs, logp, keep={"held_out": held_out})


@query("op8_quality_nbsvm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    model = quality_nbsvm.learn(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return quality_nbsvm.score(docs, model, keep={"held_out": held_out})


def _joined(numbers: str):
    return F.array_join(F.col(numbers).cast("array<string>"), ",")


@query("op5_unit_dedup", sql.UNIT_DEDUP)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = unit_dedup.dedup_units(table(spark, sf_dir, "documents"))
    kept = F.coalesce("kept_text", F.lit(""))
    return got.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), _joined("starts").alias("removed_starts"),
                      _joined("ends").alias("removed_ends"), F.length(kept).cast("long").alias("kept_chars"), "kept_text",
                      F.sha2(kept, 256).alias("kept_sha256"))


@query("op6_mixing", sql.mixing_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = {"source": "source", "lang": "lang", "topic": mixing.length_topic(F.col("n_tokens"))}
    return mixing.mix(table(spark, sf_dir, "documents"), dims).withColumns(
        {"weight": F.round("weight", 4), "prob": F.round("prob", 4)})


@query("op7_licenses", sql.licenses_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op9_quality_rules", sql.QUALITY_RULES)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return got.withColumns({"removed_starts": _joined("starts"), "removed_ends": _joined("ends")}).drop("starts", "ends")


@query("op10_cross_polytope", sql.NEAR_VECTORS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_pivot_clusters", sql.cluster_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.cluster(table(spark, sf_dir, "embeddings")).drop("n_exact")


@query("op12_spelling_variants", sql.spelling_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spelling.variants(table(spark, sf_dir, "documents"))
    return got.select("word", "n", "form", "root", "n_near", "form_n")


@query("op13_page_text")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    got = page_text.extract(pages, page_text.train(spark))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
