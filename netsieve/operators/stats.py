"""Label distributions, row audits, class weights and per-file z-scores.

Every aggregate is a ``groupBy`` with map-side partial aggregation, so a
label or file holding a third of all rows is pre-combined in each task and
never reaches one reducer as raw rows. Windows run only over the aggregated
(small) result, never over fact rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsieve.operators import labels as L
from netsieve.session import sized_join


def label_counts(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    keys = (by or []) + [F.col(label).alias("label")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Count and percent of each label (within ``by`` groups), most frequent first."""
    by = by or []
    counts = label_counts(df, label, by)
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    pct = F.round(F.col("n") * 100.0 / F.sum("n").over(w), 6)
    return counts.select(*by, "label", "n", pct.alias("pct")).orderBy(*by, F.desc("n"), "label")


def label_enum(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts per label plus a total row (one ``rollup`` pass); null labels count only in the total."""
    r = df.rollup(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    return r.where((F.col("_g") == 1) | F.col("label").isNotNull()).select(
        "label", "n", (F.col("_g") == 1).alias("is_total"))


def label_unique(raw: DataFrame, raw_label: str = "raw_label") -> DataFrame:
    """Distinct labels before and after standardization."""
    std = L.standardize_label(raw, raw_label, out="_std_label")
    before = raw.select(F.lit("raw").alias("stage"), F.col(raw_label).alias("label")).distinct()
    after = std.select(F.lit("standardized").alias("stage"), F.col("_std_label").alias("label")).distinct()
    return before.unionByName(after)


def row_audit(df: DataFrame, raw_label: str = "raw_label", by: str = "source_file") -> DataFrame:
    """Per file: initial rows, repeated headers, null labels, unknown labels removed, final rows."""
    std = L.standardize_label(df, raw_label, out="_std")
    known = L.known_dim(df.sparkSession)
    j = std.join(known, F.col("_std") == F.col("_known"), "left")
    header = F.col(raw_label).eqNullSafe("Label")
    null = F.col(raw_label).isNull()
    unknown = ~header & ~null & F.col("_known").isNull()
    agg = j.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_initial"),
        F.count_if(header).alias("n_header"),
        F.count_if(null).alias("n_null_label"),
        F.count_if(unknown).alias("n_unknown"),
    )
    return agg.withColumn("n_final", F.col("n_initial") - F.col("n_header") - F.col("n_null_label") - F.col("n_unknown"))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Every row plus its class weight ``N / (K * n_c)``, unrounded.

    Counts are a partial aggregate; the per-class table (one row per label) comes back by a join that checks its size.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy()
    w = counts.select(label, (F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n"))).alias(out))
    return sized_join(df, w, [label]).select(*df.columns, out)


def class_weights(df: DataFrame, label: str = "label", id_col: str = "row_id") -> DataFrame:
    """Each row's id and label with its class weight ``N / (K * n_c)`` (6 decimals)."""
    out = with_class_weights(df, label, "_w")
    return out.select(id_col, F.col(label).alias("label"), F.round("_w", 6).alias("weight"))


def zscore_by_file(df: DataFrame, cols: list[str], by: str = "source_file") -> DataFrame:
    """Per-file z-score with the population std; a constant column gives 0.

    Per-file means and stds are a grouped aggregate (one row per file) joined back after a check of its size,
    instead of a window that would put a whole file in one task.
    """
    stats = df.groupBy(by).agg(*[x for c in cols for x in (
        F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    j = sized_join(df, stats, [by])
    outs = [F.round((F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)), 6)
            .alias(f"z_{c}") for c in cols]
    return j.select(by, *[c for c in df.columns if c not in cols and c != by], *outs)
