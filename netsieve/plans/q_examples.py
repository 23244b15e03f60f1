"""Queries: training examples for the alert-text model (per-class sample -> description -> twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.functions import alerts as A
from netsieve.operators import sampling as SM
from netsieve.plans import evaluation as E
from netsieve.plans.registry import query
from netsieve.plans.sqlbase import LABELLED, with_alerts

PER_CLASS = 100
H = "((row_id % 2147483648) * 2654435761 + 42) % 4294967296"


def sampled(spark, sf) -> DataFrame:
    """At most 100 rows per standardized label (seeded)."""
    return SM.sample_per_class(E.labelled_alerts(spark, sf), "label", PER_CLASS, "row_id")


def examples(df: DataFrame) -> DataFrame:
    """Each sampled row gives its own example and an ``Unknown`` twin with the same metrics.

    Inputs come from the canonical columns (missing -> 0); the threat text is
    the attack type's description filled with the row's rates and ports.
    """
    inp = [F.coalesce(F.col("protocol"), F.lit(0)).cast("int").alias("protocol"),
           F.coalesce(F.col("src_port"), F.lit(0)).cast("int").alias("src_port"),
           F.coalesce(F.col("dst_port"), F.lit(0)).cast("int").alias("dst_port"),
           F.coalesce(F.col("flow_byts_s"), F.lit(0.0)).cast("double").alias("flow_byts_s"),
           F.coalesce(F.col("flow_pkts_s"), F.lit(0.0)).cast("double").alias("flow_pkts_s"),
           F.coalesce(F.col("flow_iat_mean"), F.lit(0.0)).cast("double").alias("flow_iat_mean")]
    twins = F.when(F.col("label") == "Unknown", F.array(F.col("label"))).otherwise(
        F.array(F.col("label"), F.lit("Unknown")))
    d = df.select("row_id", *inp, F.explode(twins).alias("attack_label"),
                  (F.col("label") != "Unknown").alias("_has_twin"))
    d = d.withColumn("is_twin", (F.col("attack_label") == "Unknown") & F.col("_has_twin"))
    parts = A._example_parts(F.col("attack_label"))
    return d.select("row_id", F.col("attack_label").alias("attack_type"), "is_twin", "protocol", "src_port", "dst_port",
                    F.col("flow_byts_s").alias("flow_rate"), F.col("flow_pkts_s").alias("packet_rate"),
                    F.col("flow_iat_mean").alias("iat_mean"), parts["threat"].alias("threat"),
                    F.split(F.regexp_replace(parts["mitigation"], "• ", ""), "\n").alias("mitigation"),
                    parts["impact"].alias("impact"))


def nested(df: DataFrame) -> DataFrame:
    """The nested training-example shape: ``input`` struct and ``output`` struct (JSON sink layout)."""
    return df.select(
        F.struct(F.col("protocol").alias("Protocol"), F.col("src_port").alias("Src Port"),
                 F.col("dst_port").alias("Dst Port"), F.col("flow_rate").alias("Flow Rate"),
                 F.col("packet_rate").alias("Packet Rate"), F.col("iat_mean").alias("IAT Mean"),
                 F.col("attack_type").alias("Attack Type")).alias("input"),
        F.struct("threat", "mitigation", "impact").alias("output"))


_SAMPLE_SQL = f""",
smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}, row_id) AS rn FROM labelled)
        WHERE rn <= {PER_CLASS}),
ex AS (SELECT row_id, label AS attack_label, false AS is_twin, * EXCLUDE (row_id) FROM smp
       UNION ALL BY NAME
       SELECT row_id, 'Unknown' AS attack_label, true AS is_twin, * EXCLUDE (row_id) FROM smp WHERE label <> 'Unknown'),
exn AS (SELECT row_id, attack_label, is_twin, CAST(coalesce(protocol, 0) AS INTEGER) AS protocol,
          CAST(coalesce(src_port, 0) AS INTEGER) AS src_port, CAST(coalesce(dst_port, 0) AS INTEGER) AS dst_port,
          CAST(coalesce(flow_byts_s, 0.0) AS DOUBLE) AS flow_byts_s, CAST(coalesce(flow_pkts_s, 0.0) AS DOUBLE) AS flow_pkts_s,
          CAST(coalesce(flow_iat_mean, 0.0) AS DOUBLE) AS flow_iat_mean FROM ex)"""


def _examples_sql(text_only: bool) -> str:
    p = A.sql_example_parts()
    if text_only:
        sel = f"row_id, attack_label AS attack_type, is_twin, {p['threat']} AS threat"
    else:
        sel = (f"row_id, attack_label AS attack_type, is_twin, protocol, src_port, dst_port, flow_byts_s AS flow_rate, "
               f"flow_pkts_s AS packet_rate, flow_iat_mean AS iat_mean, {p['threat']} AS threat, "
               f"string_split(replace({p['mitigation']}, '• ', ''), chr(10)) AS mitigation, {p['impact']} AS impact")
    return with_alerts(LABELLED) + _SAMPLE_SQL + f"\nSELECT {sel} FROM exn"


@query("training_examples", sql=lambda: _examples_sql(False))
def q_training_examples(spark, sf):
    return examples(sampled(spark, sf))


@query("example_text", sql=lambda: _examples_sql(True))
def q_example_text(spark, sf):
    """Description templates filled with each sampled row's rates, ports and IAT."""
    return examples(sampled(spark, sf)).select("row_id", "attack_type", "is_twin", "threat")
