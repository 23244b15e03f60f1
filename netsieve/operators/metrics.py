"""Evaluation metrics as aggregates over (true, predicted) or (label, score) columns.

Everything is a partial-aggregated ``groupBy``; only the aggregated per-class
or per-score tables (bounded by the class domain, or range-partitioned) see a
window. ROC AUC is exact with ties and never puts all rows in one task: the
per-score counts are range-partitioned, and each partition learns how many
negatives lie in earlier partitions from a table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsieve.session import checkpoint_root


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, y: str, p: str, positive=1) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class (0 when undefined)."""
    yt, pt = F.col(y) == F.lit(positive), F.col(p) == F.lit(positive)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(yt & pt).alias("tp"), F.count_if(~yt & pt).alias("fp"),
                 F.count_if(yt & ~pt).alias("fn"), F.count_if(~yt & ~pt).alias("tn"))
    return agg.select(
        "n", "tp", "fp", "fn", "tn",
        F.round(_div(F.col("tp") + F.col("tn"), F.col("n")), 6).alias("accuracy"),
        F.round(_div(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(_div(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"),
        F.round(_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"),
    )


def per_class_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per class of the union of true and predicted labels: tp, support, predicted count."""
    ev = F.explode(F.array(
        F.struct(F.col(y).alias("cls"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred"),
                 (F.col(y) == F.col(p)).cast("int").alias("is_tp")),
        F.struct(F.col(p).alias("cls"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred"), F.lit(0).alias("is_tp")),
    )).alias("e")
    return (df.select(ev).select("e.*")
              .groupBy("cls").agg(F.sum("is_tp").cast("long").alias("tp"), F.sum("is_true").cast("long").alias("support"),
                                  F.sum("is_pred").cast("long").alias("predicted")))


def per_class_scores(counts: DataFrame) -> DataFrame:
    return counts.select(
        "cls", "tp", "support", "predicted",
        _div(F.col("tp"), F.col("predicted")).alias("precision"),
        _div(F.col("tp"), F.col("support")).alias("recall"),
        _div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def multi_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy and macro / weighted precision, recall, F1 (one row)."""
    s = per_class_scores(per_class_counts(df, y, p))
    n = F.sum("support")
    agg = s.agg(
        _div(F.sum("tp"), n).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), _div(F.sum(F.col("precision") * F.col("support")), n)
        .alias("precision_weighted"),
        F.avg("recall").alias("recall_macro"), _div(F.sum(F.col("recall") * F.col("support")), n)
        .alias("recall_weighted"),
        F.avg("f1").alias("f1_macro"), _div(F.sum(F.col("f1") * F.col("support")), n).alias("f1_weighted"),
    )
    return agg.select(*[F.round(c, 6).alias(c) for c in agg.columns])


def class_report(df: DataFrame, y: str, p: str, names: DataFrame | None = None) -> DataFrame:
    """Per-class precision / recall / F1 / support, then accuracy, macro avg and weighted avg rows.

    ``names`` (cls, name) renames classes; classes without a name keep their value as text.
    """
    s = per_class_scores(per_class_counts(df, y, p))
    if names is not None:
        s = s.join(F.broadcast(names), "cls", "left").withColumn(
            "name", F.coalesce(F.col("name"), F.col("cls").cast("string")))
    else:
        s = s.withColumn("name", F.col("cls").cast("string"))
    rows = s.select("name", "precision", "recall", "f1", "support")
    n = F.sum("support")
    summary = s.agg(
        _div(F.sum("tp"), n).alias("acc"), n.alias("N"),
        F.avg("precision").alias("pm"), F.avg("recall").alias("rm"), F.avg("f1").alias("fm"),
        _div(F.sum(F.col("precision") * F.col("support")), n).alias("pw"),
        _div(F.sum(F.col("recall") * F.col("support")), n).alias("rw"),
        _div(F.sum(F.col("f1") * F.col("support")), n).alias("fw"))
    extra = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("name"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), F.col("N").alias("support")),
        F.struct(F.lit("macro avg").alias("name"), F.col("pm").alias("precision"), F.col("rm").alias("recall"),
                 F.col("fm").alias("f1"), F.col("N").alias("support")),
        F.struct(F.lit("weighted avg").alias("name"), F.col("pw").alias("precision"), F.col("rw").alias("recall"),
                 F.col("fw").alias("f1"), F.col("N").alias("support")),
    )).alias("r")).select("r.*")
    out = rows.unionByName(extra)
    return out.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def confusion_matrix(df: DataFrame, y: str, p: str, classes: list[int]) -> DataFrame:
    """Rows: sorted union of observed labels; columns ``p_<k>`` for the given classes and ``p_other`` for predictions that are
    none of them (null included); zero-filled."""
    other = df.groupBy(F.col(y).alias("true_id")).agg(
        F.count_if(~F.coalesce(F.col(p).isin(classes), F.lit(False))).alias("p_other"))
    m = df.groupBy(F.col(y).alias("true_id")).pivot(p, classes).agg(F.count(F.lit(1)))
    m = m.select("true_id", *[F.coalesce(F.col(str(k)), F.lit(0)).cast("long").alias(f"p_{k}") for k in classes])
    seen = (df.select(F.explode(F.array(F.col(y), F.col(p))).alias("true_id"))
              .groupBy("true_id").agg(F.count(F.lit(1)).alias("_n")).select("true_id"))
    out = seen.join(m, "true_id", "left").join(other, "true_id", "left")
    return out.select("true_id", *[F.coalesce(F.col(f"p_{k}"), F.lit(0)).cast("long").alias(f"p_{k}") for k in [*classes, "other"]])


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None,
            num_ranges: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties (Mann–Whitney), per ``by`` group.

    AUC = sum over distinct scores of (pos * neg_below + pos * neg_at / 2) / (P * N).
    """
    by = by or []
    spark = df.sparkSession
    parts = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    s = df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_n"))
    # The range bounds come from a sample; checkpointing pins each score to one partition id even if a
    # branch of the plan is recomputed after an executor loss.
    checkpoint_root(spark)
    s = s.repartitionByRange(parts, *by, "_s").withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    # negatives in earlier range partitions of the same group: one row per (group, partition)
    t = s.groupBy(*by, "_part").agg(F.sum("_n").alias("_np"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(*by, "_part", F.coalesce(F.sum("_np").over(before), F.lit(0)).alias("_nb0"))
    s = s.join(F.broadcast(t), by + ["_part"], "inner")
    below = Window.partitionBy("_part", *by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_nb", F.col("_nb0") + F.coalesce(F.sum("_n").over(below), F.lit(0)))
    agg = s.groupBy(*by).agg(
        F.sum(F.col("_p").cast("double") * (F.col("_nb") + 0.5 * F.col("_n"))).alias("_u"),
        F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))
    auc = F.try_divide(F.col("_u"), F.col("positives").cast("double") * F.col("negatives"))
    return agg.select(*by, "positives", "negatives", F.round(auc, 6).alias("auc"))


def log_loss(df: DataFrame, probs: str, y: str, weight: str | None = None, eps: float = 1e-15) -> DataFrame:
    """Multi-class log loss and error rate; with ``weight`` also the weighted forms sum(w*x) / sum(w)."""
    py = F.element_at(F.col(probs), F.col(y) + 1)
    ll = -F.log(F.greatest(py, F.lit(eps)))
    err = (F.array_position(F.col(probs), F.array_max(F.col(probs))) - 1 != F.col(y)).cast("double")
    cols = [F.round(F.avg(ll), 6).alias("logloss"), F.round(F.avg(err), 6).alias("merror")]
    if weight:
        w = F.col(weight)
        cols += [F.round(F.sum(w * ll) / F.sum(w), 6).alias("weighted_logloss"),
                 F.round(F.sum(w * err) / F.sum(w), 6).alias("weighted_merror")]
    return df.agg(*cols)
