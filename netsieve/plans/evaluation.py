"""Batch evaluation of the detection chain: labelled rows -> scores -> trigger -> alert log + summary.

All steps are narrow projections or bounded broadcast lookups; the only
shuffle is the final one-row aggregate of ``run_summary`` (partial aggregates
per task, then one tiny merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.functions import alerts as A
from netsieve.functions import detect as X
from netsieve.operators import labels as L
from netsieve.sources import adapters


def labelled_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert inputs with a clean, standardized, known ``label``."""
    df = adapters.alerts(spark, sf_dir)
    df = L.clean_labels(df, "raw_label")
    df = L.standardize_label(df, "raw_label", out="label")
    return L.known_labels(df, "label")


def score(df: DataFrame, text_threshold: float = 0.7) -> DataFrame:
    """Binary decision, gated class name (saved encoder), hybrid trigger."""
    df = df.withColumn("binary_pred", X.binary_decision("binary_score"))
    df = L.class_name(df, "class_id", out="class_label")
    return (df.withColumn("attack_label", X.gated_label("binary_pred", "class_label"))
              .withColumn("is_malicious", X.hybrid_trigger("binary_pred", "slm_label", "slm_score", text_threshold)))


def alert_rows(spark: SparkSession, sf_dir: str, text_threshold: float = 0.7) -> DataFrame:
    return score(labelled_alerts(spark, sf_dir), text_threshold)


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log entry per malicious row (21 columns); floats rounded to 3 decimals as the CSV writes them."""
    return alert_log_of(alert_rows(spark, sf_dir).where("is_malicious"))


def alert_log_of(df: DataFrame) -> DataFrame:
    """Alert log entries of scored rows (``is_malicious`` already applied by the caller); absent flow
    metrics are null."""
    absent = {c: "double" for c in ("flow_byts_s", "flow_pkts_s", "flow_iat_mean", "fwd_header_len", "bwd_header_len",
                                    "rst_flag_cnt", "syn_flag_cnt", "pkt_len_min", "pkt_len_max", "slm_score")}
    absent.update(slm_label="string", ts="timestamp", protocol="int", src_port="int", dst_port="int")
    for c, t in absent.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    r3 = lambda c: F.round(F.col(c).cast("double"), 3)
    return df.select(
        F.col("row_id").alias("row_index"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        L.binary_label("label").alias("actual_label"),
        F.col("binary_pred").alias("binary_prediction"),
        F.col("attack_label").alias("multiclass_prediction"),
        "slm_label",
        r3("slm_score").alias("slm_score"),
        r3("flow_byts_s").alias("flow_rate_bytes_s"),
        r3("flow_pkts_s").alias("packet_rate_pkts_s"),
        r3("flow_iat_mean").alias("iat_mean_ms"),
        "protocol",
        F.col("src_port").alias("source_port"),
        F.col("dst_port").alias("destination_port"),
        r3("fwd_header_len").alias("forward_header_length"),
        r3("bwd_header_len").alias("backward_header_length"),
        F.col("rst_flag_cnt").cast("int").alias("rst_flags"),
        F.col("syn_flag_cnt").cast("int").alias("syn_flags"),
        X.traffic_pattern("flow_pkts_s", "flow_iat_mean").alias("traffic_pattern"),
        r3("pkt_len_min").alias("packet_length_min"),
        r3("pkt_len_max").alias("packet_length_max"),
        A.alert_fallback().alias("notification"),
    )


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, detected, rate %, distinct attack types, mean text score over detected rows."""
    return summary_of(alert_rows(spark, sf_dir))


def summary_of(df: DataFrame) -> DataFrame:
    """The one-row run summary of scored rows (partial aggregates per task, one tiny merge)."""
    if "slm_score" not in df.columns:
        df = df.withColumn("slm_score", F.lit(None).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("is_malicious").alias("malicious_records"),
        F.round(F.try_divide(F.count_if("is_malicious") * 100.0, F.count(F.lit(1))).cast("double"), 6)
         .alias("detection_rate_pct"),
        F.count_distinct(F.when(F.col("is_malicious"), F.col("attack_label"))).alias("unique_attack_types"),
        F.round(F.avg(F.when(F.col("is_malicious"), F.col("slm_score"))), 6).alias("average_slm_score"),
    )


def with_timing(summary: DataFrame, start, end) -> DataFrame:
    """Add duration / start / end of a run (driver clock) to a summary row."""
    return summary.select(
        "*",
        F.lit(round((end - start).total_seconds() / 60, 6)).alias("test_duration_minutes"),
        F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).alias("test_start_time"),
        F.lit(end.strftime("%Y-%m-%d %H:%M:%S")).alias("test_end_time"),
    )
