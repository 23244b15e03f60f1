"""Corpus pipeline: quality rules, near duplicates, repeated lines, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in the shared folder and reread as the next stage's docs. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netsieve.llm import jaccard, mixing, pieces, quality_rules, queries, ship, unit_dedup
from netsieve.session import scratch_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _cleaned(got: DataFrame, cut: Column, docs: DataFrame) -> DataFrame:
    """The columns of documents with kept_text as the text; n_chars is counted anew where ``cut``."""
    count = F.when(cut, F.length("kept_text")).otherwise(F.col("n_chars"))
    return got.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                      count.cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go, boilerplate lines leave the others; n_chars follows the text."""
    ship.ship(spark)
    got = quality_rules.quality_rules(docs, carry=["lang", "source", "n_chars"]).where("kept")
    return _cleaned(got, F.size("starts") > 0, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts stays: the one with the smallest id, a null id last.

    Rows are told apart by id and text, so rows without an id, or that share one, have verdicts
    of their own; of rows equal in both one stays.
    """
    ship.ship(spark)
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))
    groups = jaccard.jaccard_join(rows, "_key").select(F.col("_key").alias("_g_key"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))
    stays = (rows.select("doc_id", "_key").join(groups.hint("shuffle_hash"), F.col("_key") == F.col("_g_key"))
             .groupBy("component_id").agg(first.alias("first")).select(F.col("first._key").alias("_stays")))
    return (rows.join(stays.hint("shuffle_hash"), F.col("_key") == F.col("_stays"), "left_semi")
            .dropDuplicates(["_key"]).select(*COLUMNS))


def repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line, and every run of repeated clauses, stays in its earliest row only, by id (a null id last) and text; n_chars
    follows the text."""
    ship.ship(spark)
    got = unit_dedup.dedup_units(docs, carry=["lang", "source", "n_chars"])
    return _cleaned(got, F.col("n_removed") > 0, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the calibrated probability of their source, language and topic."""
    dims = {"source": "source", "lang": "lang", "topic": mixing.length_topic(F.col("n_tokens"))}
    return mixing.mix(docs, dims, carry=COLUMNS[1:]).where("sampled").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    ship.ship(spark)
    got = pieces.encode(docs, queries.piece_model_path())
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_units),
          ("mixing to target weights", mix), ("SentencePiece tokens", tokens)]

#: The tokens cannot be computed in SQL; the operators of the stages have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
