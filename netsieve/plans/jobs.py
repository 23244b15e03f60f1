"""The reference's whole workflow as Spark jobs over a folder of labelled flow CSV files.

* ``preprocess`` — CSV folder → header groups → drop repeated headers and
  null labels → standardize → keep known labels → time parts (bad times
  dropped) → Parquet per source file; returns the ingest report and the row
  audit.
* ``train`` — cleaned rows → binary, multi-class (class weights, stratified
  split) and optional baseline models saved under one folder, the encoder
  label map beside them; returns hold-out metrics.
* ``evaluate`` — cleaned rows + saved models (+ an optional Arrow text
  scorer) → scores → hybrid trigger → alert log (3 decimals) and run summary
  CSVs.
* ``monitor`` — decoded packets arriving as files → packet features →
  binary and multi-class scores → alerts, appended per micro-batch
  (idempotent) with a checkpoint in the shared folder; a traffic log of every
  packet alongside.

Every step is an operator of this package; nothing is collected on the
driver except file headers and the ≤ 15-row label map.
"""

from __future__ import annotations

import datetime
import os

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.functions import alerts as A
from netsieve.functions import detect as X
from netsieve.functions import domains as D
from netsieve.functions import textops as TX
from netsieve.operators import boosting as B
from netsieve.operators import clean as C
from netsieve.operators import labels as L
from netsieve.operators import metrics as M
from netsieve.operators import models as MD
from netsieve.operators import sampling as SM
from netsieve.operators import stats as S
from netsieve.plans import evaluation as E
from netsieve.session import checkpoint_root
from netsieve.sources import csv_folder as CF
from netsieve.sources import sinks as SK
from netsieve.streaming import streams as ST

TEXT = set(CF.TEXT_COLUMNS) | {"label"}


def preprocess(spark: SparkSession, in_dir: str, out_dir: str, drop_bad_times: bool = True,
               fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Clean a flow CSV folder into ``out_dir`` (one folder per source file).

    Returns ``(ingest_report, row_audit)`` (both small: one row per file).
    """
    typed, report = CF.ingest(spark, in_dir, D.REQUIRED_COLUMNS)
    audit = S.row_audit(typed, "label", "source_file")
    df = L.known_labels(L.standardize_label(L.clean_labels(typed, "label"), "label"), "label")
    df = df.withColumn("_t", X.parse_day_first("timestamp"))
    if drop_bad_times:
        df = df.where(F.col("_t").isNotNull())
    df = df.select("*", *X.time_parts("_t")).drop("_t")
    SK.write_clean(df, out_dir, fmt)
    return report, audit


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: the numeric flow metrics and time parts (identity columns dropped)."""
    ident = set(C.drop_identity(df).columns)
    return [c for c in C.numeric_columns(df) if c in ident and c not in TEXT]


def complete_rows(df: DataFrame, features: list[str], by: str = "source_file") -> DataFrame:
    """Missing-value rule of the trainers, per file: ±inf → missing; a row missing a metric its own file
    has is dropped; metrics a file lacks entirely become 0.

    Which metrics each file has is a per-file count table (one row per file);
    AQE broadcasts it while it is small.
    """
    df = C.inf_to_null(df, features)
    has = df.groupBy(by).agg(*[(F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))) > 0).alias(f"_has_{c}")
                               for c in features])
    j = df.join(has, by, "inner")
    missing = [F.col(f"_has_{c}") & (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in features]
    bad = missing[0]
    for m in missing[1:]:
        bad = bad | m
    out = j.where(~bad).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features
                                 else F.col(c) for c in df.columns])
    return out


def _with_row_ids(df: DataFrame) -> DataFrame:
    """A row index as the reference's frame index (unique; fixed for a given set of input files)."""
    return df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id())


def train(spark: SparkSession, clean_dir: str, model_dir: str, max_iter: int = 100,
          baseline: bool = False) -> dict[str, DataFrame]:
    """Fit and save ``binary``, ``multi`` (and ``baseline``) models and the ``label_maps`` under ``model_dir``.

    Returns hold-out metrics: ``binary`` (accuracy, precision, recall, F1),
    ``binary_auc``, ``multi`` (accuracy, macro / weighted scores) and ``multi_curve`` (log loss and error per round and split).
    """
    df = spark.read.parquet(clean_dir)
    feats = feature_columns(df)
    # every model and metric below reads these rows: written once to the shared checkpoint folder (reliable,
    # survives executor loss), which also pins the row ids
    checkpoint_root(spark)
    df = _with_row_ids(complete_rows(df, feats)).checkpoint(eager=True)
    out: dict[str, DataFrame] = {}

    b = SM.split_random(df.withColumn("y", L.binary_label("label").cast("double")), "row_id")
    b = b.withColumn("is_val", F.col("split") == "test")
    binary = MD.train_binary(b, "y", feats, max_iter=max_iter, validation_col="is_val")
    binary.write().overwrite().save(f"{model_dir}/binary")
    held = MD.positive_probability(binary, b.where("is_val"))
    out["binary"] = M.binary_metrics(held.withColumn("p", F.coalesce("binary_pred", F.lit(False)).cast("int")),
                                     "y", "p")
    out["binary_auc"] = M.roc_auc(held, "y", "score")

    m = SM.split_stratified(S.with_class_weights(df, "label"), "label", "row_id")
    multi = MD.train_multi(m.withColumn("held", F.col("split") == "test"), "label", feats, max_iter=max_iter, weight_col="weight",
                           validation_col="held")
    multi.save(spark, f"{model_dir}/multi")
    out["multi_curve"] = multi.curve_table(spark)
    pred = MD.multi_predict(multi, m.where("split = 'test'"))
    out["multi"] = M.multi_metrics(pred, "label", "pred_label")

    seen = df.select(F.col("label").alias("name")).distinct()
    dim = L.label_dim(spark).where("mapping = 'encoder'").join(seen, "name", "left_semi")
    SK.write_label_maps(dim, f"{model_dir}/label_maps")

    if baseline:
        z = S.zscore_by_file(df.select("row_id", "source_file", "label", *feats), feats, "source_file")
        z = SM.split_random(z.withColumn("y", L.binary_label("label").cast("double")), "row_id")
        rf = MD.train_baseline(z.where("split = 'train'"), "y", [f"z_{c}" for c in feats])
        rf.write().overwrite().save(f"{model_dir}/baseline")
    return out


def _model_features(model: PipelineModel) -> list[str]:
    for stage in model.stages:
        if stage.hasParam("inputCols") and stage.isDefined("inputCols"):
            return stage.getInputCols()
    raise ValueError("no feature assembler in the model")


def classify_flagged(multi: B.SoftmaxModel, scored: DataFrame) -> DataFrame:
    """``class_label`` of the rows that the binary model flagged; the others get null and the multi-class model never sees them."""
    flag = F.coalesce(F.col("binary_pred"), F.lit(False))
    names = scored.columns
    flagged = MD.multi_predict(multi, scored.where(flag)).select(*names, F.col("pred_label").alias("class_label"))
    rest = scored.where(~flag).select(*names, F.lit(None).cast("string").alias("class_label"))
    return flagged.unionByName(rest)


def score_rows(df: DataFrame, model_dir: str, text_scorer=None, text_threshold: float = 0.7) -> DataFrame:
    """Binary score, gated multi-class name and text score of each row, then the hybrid trigger.

    Model inputs are aligned to each model's feature list (absent → 0); the
    multi-class model's name comes from its fitted label index; ``text_scorer``
    (an Arrow ``pandas_udf`` → struct<label, score>, see
    ``models.pandas_text_scorer``) reads the payload text.
    """
    spark = df.sparkSession
    binary = PipelineModel.load(f"{model_dir}/binary")
    multi = B.SoftmaxModel.load(spark, f"{model_dir}/multi")
    feats = _model_features(binary)
    aligned = df.select(*[c for c in df.columns if c not in feats],
                        *[(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0)).alias(n)
                          for n in feats])
    s = MD.positive_probability(binary, aligned).withColumnRenamed("score", "binary_score")
    s = classify_flagged(multi, s)
    if text_scorer is not None:
        res = text_scorer(TX.payload_text("flow_byts_s", "flow_pkts_s"))
        s = s.withColumn("_txt", res).select("*", F.col("_txt.label").alias("slm_label"),
                                             F.col("_txt.score").alias("slm_score")).drop("_txt")
    else:
        s = s.withColumn("slm_label", F.lit(None).cast("string")).withColumn("slm_score", F.lit(None).cast("double"))
    s = s.withColumn("attack_label", X.gated_label("binary_pred", "class_label"))
    return s.withColumn("is_malicious", X.hybrid_trigger("binary_pred", "slm_label", "slm_score", text_threshold))


def evaluate(spark: SparkSession, clean_dir: str, model_dir: str, out_dir: str, sample: int | None = None,
             seed: int = 42, text_scorer=None) -> tuple[DataFrame, DataFrame]:
    """The batch evaluation run: (optionally a seeded sample of) cleaned rows → scores → alert log CSV
    (``out_dir/alerts``) and run summary CSV (``out_dir/summary``: totals, rate, types, mean text score, run
    duration and start / end times). Returns both DataFrames as written."""
    df = spark.read.parquet(clean_dir)
    df = _with_row_ids(complete_rows(df, feature_columns(df)))  # rows with a missing metric are no records
    df = df.select(*[F.col(c).try_cast("int").alias(c) if c in ("protocol", "src_port", "dst_port") else F.col(c)
                     for c in df.columns])
    if "ts" not in df.columns and "timestamp" in df.columns:
        df = df.withColumn("ts", X.parse_day_first("timestamp"))
    if sample:
        df = SM.sample_n(df, sample, "row_id", seed)
    start = datetime.datetime.now()
    scored = score_rows(df, model_dir, text_scorer).persist(StorageLevel.MEMORY_AND_DISK)
    try:  # two writes read the scored rows; a lost executor recomputes its part from the lineage
        SK.write_csv_3dp(E.alert_log_of(scored.where("is_malicious")), f"{out_dir}/alerts")
        summary = E.with_timing(E.summary_of(scored), start, datetime.datetime.now())  # the 8-column run summary
        summary.write.mode("overwrite").option("header", True).csv(f"{out_dir}/summary")
    finally:
        scored.unpersist()
    summary = spark.read.option("header", True).option("inferSchema", True).csv(f"{out_dir}/summary")
    # alert texts span lines: the writer quotes them, the reader needs multiLine
    return spark.read.option("header", True).option("multiLine", True).csv(f"{out_dir}/alerts"), summary


def monitor(spark: SparkSession, packet_dir: str, model_dir: str, out_dir: str, checkpoint_dir: str,
            available_now: bool = True, processing_time: str = "5 seconds", text_scorer=None,
            text_threshold: float = 0.7):
    """Live scoring of decoded packets arriving in ``packet_dir``.

    Each micro-batch: packet features (57 fields) → binary and multi-class
    scores, and the optional Arrow ``text_scorer`` on the payload → hybrid
    trigger (binary or text) → alerts of malicious packets (fallback alert text) written to
    ``out_dir/alerts/batch_id=<n>`` and every packet with its decision to
    ``out_dir/traffic/batch_id=<n>`` (label ``Benign`` when none fired) — a
    replayed batch overwrites its own folders. Returns the started query.
    """
    binary = PipelineModel.load(f"{model_dir}/binary")
    multi = B.SoftmaxModel.load(spark, f"{model_dir}/multi")
    feats = _model_features(binary)
    pk = ST.packet_stream(spark, packet_dir)
    rows = C.packet_features(pk, "wide", keep=["ts", "src_ip", "dst_ip", "payload"])
    rows = rows.select("*", *[F.lit(0.0).alias(c) for c in feats if c not in rows.columns])

    def handle(batch: DataFrame, batch_id: int) -> None:
        # models score each micro-batch as a static DataFrame (MLlib transforms are batch operators)
        s = MD.positive_probability(binary, batch).withColumnRenamed("score", "binary_score")
        s = classify_flagged(multi, s)
        s = s.withColumn("attack_label", X.gated_label("binary_pred", "class_label"))
        if text_scorer is not None:
            s = s.withColumn("_txt", text_scorer(F.col("payload"))).select(
                "*", F.col("_txt.label").alias("slm_label"), F.col("_txt.score").alias("slm_score")).drop("_txt")
        else:  # no text model: the trigger is the binary decision and the alert text prints 0.00
            s = s.withColumn("slm_label", F.lit(None).cast("string")).withColumn("slm_score", F.lit(None).cast("double"))
        s = s.withColumn("is_malicious", X.hybrid_trigger("binary_pred", "slm_label", "slm_score", text_threshold))
        s = s.persist()  # written twice below; a lost executor recomputes it from the batch's files
        traffic = s.select("packet_id", "ts", "src_ip", "dst_ip", "protocol", "src_port", "dst_port",
                           F.coalesce("binary_pred", F.lit(False)).alias("binary_prediction"), "is_malicious",
                           F.coalesce("attack_label", F.lit("Benign")).alias("multiclass_label"))
        traffic.write.mode("overwrite").parquet(f"{out_dir}/traffic/batch_id={batch_id}")
        alerts = s.where("is_malicious").select(
            "packet_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "attack_label", "binary_score",
            "slm_label", "slm_score",
            A.alert_fallback().alias("notification"))
        alerts.write.mode("overwrite").parquet(f"{out_dir}/alerts/batch_id={batch_id}")
        s.unpersist()

    w = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def main(argv: list[str] | None = None) -> None:
    """Command line: ``python -m netsieve.plans.jobs <step> ...`` (or the same module via spark-submit).

    The master and cluster settings come from spark-submit / the environment;
    set ``spark.checkpoint.dir`` to a shared folder on a cluster.
    """
    import argparse

    from netsieve.session import get_spark

    ap = argparse.ArgumentParser(prog="netsieve.plans.jobs")
    sub = ap.add_subparsers(dest="step", required=True)
    p = sub.add_parser("preprocess", help="clean a flow CSV folder into Parquet")
    p.add_argument("csv_dir"), p.add_argument("clean_dir")
    p = sub.add_parser("train", help="fit and save the binary / multi-class (/ baseline) models")
    p.add_argument("clean_dir"), p.add_argument("model_dir")
    p.add_argument("--max-iter", type=int, default=100), p.add_argument("--baseline", action="store_true")
    p = sub.add_parser("evaluate", help="score cleaned rows: alert log and run summary CSVs")
    p.add_argument("clean_dir"), p.add_argument("model_dir"), p.add_argument("out_dir")
    p.add_argument("--sample", type=int, default=None), p.add_argument("--seed", type=int, default=42)
    p = sub.add_parser("monitor", help="score decoded packets arriving as files")
    p.add_argument("packet_dir"), p.add_argument("model_dir"), p.add_argument("out_dir"), p.add_argument("checkpoint_dir")
    p.add_argument("--continuous", action="store_true", help="keep running (default: process what is there, then stop)")
    a = ap.parse_args(argv)

    spark = get_spark(shuffle_partitions=int(os.environ.get("NETSIEVE_SHUFFLE_PARTITIONS", "200")))
    if a.step == "preprocess":
        report, audit = preprocess(spark, a.csv_dir, a.clean_dir)
        report.show(truncate=False)
        audit.show(truncate=False)
    elif a.step == "train":
        for name, df in train(spark, a.clean_dir, a.model_dir, max_iter=a.max_iter, baseline=a.baseline).items():
            print(name)
            df.show(truncate=False)
    elif a.step == "evaluate":
        _, summary = evaluate(spark, a.clean_dir, a.model_dir, a.out_dir, sample=a.sample, seed=a.seed)
        summary.show(truncate=False)
    else:
        monitor(spark, a.packet_dir, a.model_dir, a.out_dir, a.checkpoint_dir,
                available_now=not a.continuous).awaitTermination()


if __name__ == "__main__":
    main()
