"""Seeded, partition-independent sampling and splits.

The order key is an arithmetic hash of a unique row id, so results do not
depend on partitioning (``randomSplit``/``sample`` do) and the DuckDB oracle
computes the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 16  # 65,536 hash buckets (per class for the stratified split)


def hash_order(id_col: str, seed: int = 42) -> Column:
    """((id mod 2^31) * 2654435761 + (id div 2^31 mod 2^32) * 1597334677 + seed) mod 2^32 — uniform over [0, 2^32).

    The high part keeps apart the rows of different partitions (Spark's generated ids hold the partition there).
    """
    low = F.col(id_col) % 2147483648 * F.lit(2654435761) % F.lit(4294967296)
    high = F.shiftright(F.col(id_col).cast("long"), 31) % F.lit(4294967296) * F.lit(1597334677) % F.lit(4294967296)
    return (low + high + F.lit(seed)) % F.lit(4294967296)


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Fixed-size seeded sample: the ``n`` rows first in hash order (exact, ties broken by id).

    A top-n over a large table would send ``n`` rows from every task to one
    merging task. Instead the hash's top bits split rows into 65,536 buckets;
    a table of bucket counts (at most 65,536 rows, so broadcasting it is safe)
    gives each bucket the rows in earlier buckets; only buckets that hold part
    of the sample are kept, and rows are ranked inside their bucket — about
    ``n`` plus one bucket's rows reach the ranking, spread over many tasks.
    """
    h = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_b", F.shiftright("_h", 32 - BUCKET_BITS))
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_nb"))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = (counts.select("_b", F.coalesce(F.sum("_nb").over(earlier), F.lit(0)).alias("_before"))
                  .where(F.col("_before") < n))
    rn = F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col))
    out = h.join(F.broadcast(edge), "_b", "inner").withColumn("_rn", rn)
    return out.where(F.col("_before") + F.col("_rn") <= n).drop("_h", "_b", "_before", "_rn")


def sample_per_class(df: DataFrame, label: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows per class without replacement.

    ``row_number() <= n`` is planned with a per-task group limit before the
    shuffle (WindowGroupLimit), so a huge class sends at most ``n`` rows per
    task to its reducer.
    """
    w = Window.partitionBy(label).orderBy("_h", id_col)
    return (df.withColumn("_h", hash_order(id_col, seed)).withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= n).drop("_h", "_rn"))


def split_random(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Every row with ``split`` = test / train by its hash (repeatable, partition independent)."""
    cut = int(test_fraction * 4294967296)
    return df.withColumn("split", F.when(hash_order(id_col, seed) < cut, F.lit("test")).otherwise(F.lit("train")))


def split_stratified(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Per class the ``round(f * n_c)`` rows first in hash order are test, the rest train.

    Exact, and no class is ever sorted in one task: rows fall into 65,536 hash
    buckets per class; a table of bucket counts (classes x 65,536 rows at most)
    gives each bucket the number of class rows in earlier buckets, so only rows
    within a bucket need ranking. The rows are already partitioned by (class,
    bucket) for that ranking, so the join moves only the counts table (AQE
    broadcasts it when its measured size is small).
    """
    shift = 32 - BUCKET_BITS
    h = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_b", F.shiftright(F.col("_h"), shift))
    counts = h.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    cls = Window.partitionBy(label)
    earlier = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(label, "_b", F.coalesce(F.sum("_nb").over(earlier), F.lit(0)).alias("_before"),
                           F.round(F.lit(test_fraction) * F.sum("_nb").over(cls)).cast("long").alias("_k"))
    rn = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", id_col))
    out = h.withColumn("_rn", rn).join(counts, [label, "_b"], "inner")
    return out.withColumn("split", F.when(F.col("_before") + F.col("_rn") <= F.col("_k"), F.lit("test"))
                          .otherwise(F.lit("train"))).drop("_h", "_b", "_rn", "_before", "_k")
