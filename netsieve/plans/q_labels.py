"""Queries: label cleaning, lookups, distributions and the evaluation chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.functions import detect as X
from netsieve.functions import domains as D
from netsieve.functions.alerts import sql_alert_fallback
from netsieve.operators import labels as L
from netsieve.operators import stats as S
from netsieve.plans import evaluation as E
from netsieve.plans.registry import query
from netsieve.plans.sqlbase import (ENCODER, KNOWN, LABEL_DIM, LABELLED, MAPPING, SCORED, STANDARDIZED, gt, q,
                                    values, with_alerts)
from netsieve.sources import adapters

# ---------------------------------------------------------------- evaluation chain


@query("alert_log", sql=lambda: with_alerts(SCORED) + f"""
SELECT row_id AS row_index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
  CASE WHEN label IS NOT DISTINCT FROM 'Benign' THEN 0 ELSE 1 END AS actual_label,
  binary_pred AS binary_prediction, attack_label AS multiclass_prediction, slm_label,
  round(slm_score, 3) AS slm_score, round(flow_byts_s, 3) AS flow_rate_bytes_s,
  round(flow_pkts_s, 3) AS packet_rate_pkts_s, round(flow_iat_mean, 3) AS iat_mean_ms,
  protocol, src_port AS source_port, dst_port AS destination_port,
  round(fwd_header_len, 3) AS forward_header_length, round(bwd_header_len, 3) AS backward_header_length,
  CAST(rst_flag_cnt AS INTEGER) AS rst_flags, CAST(syn_flag_cnt AS INTEGER) AS syn_flags,
  CASE WHEN flow_pkts_s IS NULL OR flow_iat_mean IS NULL THEN 'Unknown pattern'
       WHEN {gt('flow_pkts_s', 1000)} THEN 'High-frequency'
       WHEN NOT isnan(flow_iat_mean) AND flow_iat_mean < 50 THEN 'Burst'
       WHEN {gt('flow_iat_mean', 1000)} THEN 'Slow and methodical' ELSE 'Moderate' END AS traffic_pattern,
  round(pkt_len_min, 3) AS packet_length_min, round(pkt_len_max, 3) AS packet_length_max,
  {sql_alert_fallback()} AS notification
FROM scored WHERE is_malicious""")
def q_alert_log(spark, sf):
    return E.alert_log(spark, sf)


@query("run_summary", sql=lambda: with_alerts(SCORED) + """
SELECT count(*) AS total_records, count(*) FILTER (WHERE is_malicious) AS malicious_records,
  round(count(*) FILTER (WHERE is_malicious) * 100.0 / count(*), 6) AS detection_rate_pct,
  count(DISTINCT CASE WHEN is_malicious THEN attack_label END) AS unique_attack_types,
  round(avg(CASE WHEN is_malicious THEN slm_score END), 6) AS average_slm_score
FROM scored""")
def q_run_summary(spark, sf):
    return E.run_summary(spark, sf)


@query("hybrid_trigger", sql=lambda: with_alerts(SCORED) + """
SELECT row_id, label, binary_pred, slm_label, slm_score, is_malicious FROM scored""")
def q_hybrid_trigger(spark, sf):
    return E.alert_rows(spark, sf).select("row_id", "label", "binary_pred", "slm_label", "slm_score", "is_malicious")


@query("hybrid_trigger_strict", sql=lambda: with_alerts(SCORED) + f"""
SELECT row_id, coalesce(binary_pred, false)
  OR coalesce(lower(slm_label) <> 'normal' AND {gt('slm_score', 0.9)}, false) AS is_malicious FROM scored""")
def q_hybrid_trigger_strict(spark, sf):
    """The real-time variant of the trigger: text threshold 0.9."""
    return E.alert_rows(spark, sf, text_threshold=0.9).select("row_id", "is_malicious")


@query("binary_decision", sql=lambda: adapters.cte("alerts") + f"""
SELECT row_id, binary_score, {gt('binary_score', 0.5)} AS binary_pred FROM alerts""")
def q_binary_decision(spark, sf):
    df = adapters.alerts(spark, sf)
    return df.select("row_id", "binary_score", X.binary_decision("binary_score").alias("binary_pred"))


@query("gated_label", sql=lambda: with_alerts(SCORED) + """
SELECT row_id, binary_pred, class_label, attack_label FROM scored""")
def q_gated_label(spark, sf):
    return E.alert_rows(spark, sf).select("row_id", "binary_pred", "class_label", "attack_label")


@query("traffic_log", sql=lambda: with_alerts(SCORED) + """
SELECT row_id, protocol, src_port, dst_port, flow_byts_s, flow_pkts_s, binary_pred AS binary_prediction,
  coalesce(CASE WHEN coalesce(binary_pred, false) THEN class_label END, 'Benign') AS multiclass_label
FROM scored""")
def q_traffic_log(spark, sf):
    """Binary-only route: every row is logged; the label defaults to ``Benign``."""
    df = E.alert_rows(spark, sf)
    return df.select("row_id", "protocol", "src_port", "dst_port", "flow_byts_s", "flow_pkts_s",
                     F.col("binary_pred").alias("binary_prediction"),
                     F.coalesce(X.gated_label("binary_pred", "class_label"), F.lit("Benign")).alias("multiclass_label"))


# ---------------------------------------------------------------- label cleaning


@query("clean_labels", sql=lambda: adapters.cte("alerts") + """
SELECT row_id, raw_label FROM alerts WHERE raw_label IS DISTINCT FROM 'Label' AND raw_label IS NOT NULL""")
def q_clean_labels(spark, sf):
    return L.clean_labels(adapters.alerts(spark, sf), "raw_label").select("row_id", "raw_label")


@query("standardize_label", sql=lambda: with_alerts(STANDARDIZED) + """
SELECT row_id, raw_label, label FROM standardized""")
def q_standardize_label(spark, sf):
    df = L.standardize_label(L.clean_labels(adapters.alerts(spark, sf), "raw_label"), "raw_label", out="label")
    return df.select("row_id", "raw_label", "label")


@query("known_labels", sql=lambda: with_alerts(LABELLED) + "SELECT row_id, label FROM labelled")
def q_known_labels(spark, sf):
    return E.labelled_alerts(spark, sf).select("row_id", "label")


@query("unknown_labels", sql=lambda: with_alerts(STANDARDIZED) + f"""
SELECT label, count(*) AS n_removed FROM standardized
WHERE label NOT IN (SELECT k_name FROM {KNOWN}) GROUP BY label""")
def q_unknown_labels(spark, sf):
    df = L.standardize_label(L.clean_labels(adapters.alerts(spark, sf), "raw_label"), "raw_label", out="label")
    return L.unknown_labels(df, "label")


@query("missing_types", sql=lambda: with_alerts(LABELLED) + f"""
SELECT k_name AS label FROM {KNOWN} WHERE k_name NOT IN (SELECT label FROM labelled)""")
def q_missing_types(spark, sf):
    return L.missing_types(E.labelled_alerts(spark, sf), "label")


@query("label_totals", sql=lambda: with_alerts(LABELLED) + """
SELECT label, count(*) AS n FROM labelled GROUP BY label""")
def q_label_totals(spark, sf):
    """Per-file label counts accumulated over all files (one partial-aggregated groupBy)."""
    per_file = S.label_counts(E.labelled_alerts(spark, sf), "label", ["source_file"])
    return per_file.groupBy("label").agg(F.sum("n").alias("n"))


@query("label_dist", sql=lambda: with_alerts(LABELLED) + """
SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM labelled GROUP BY label""")
def q_label_dist(spark, sf):
    return S.label_distribution(E.labelled_alerts(spark, sf), "label")


@query("label_dist_file", sql=lambda: with_alerts(STANDARDIZED) + """
SELECT source_file, label, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source_file), 6) AS pct
FROM standardized GROUP BY source_file, label""")
def q_label_dist_file(spark, sf):
    """Per-file distribution after standardization, before unknown labels are removed."""
    df = L.standardize_label(L.clean_labels(adapters.alerts(spark, sf), "raw_label"), "raw_label", out="label")
    return S.label_distribution(df, "label", ["source_file"])


@query("label_enum", sql=lambda: adapters.cte("alerts") + """
SELECT raw_label AS label, count(*) AS n, grouping(raw_label) = 1 AS is_total
FROM alerts GROUP BY ROLLUP (raw_label)
HAVING grouping(raw_label) = 1 OR raw_label IS NOT NULL""")
def q_label_enum(spark, sf):
    return S.label_enum(adapters.alerts(spark, sf), "raw_label")


@query("label_unique", sql=lambda: adapters.cte("alerts") + f""",
c AS (SELECT raw_label FROM alerts WHERE raw_label IS DISTINCT FROM 'Label' AND raw_label IS NOT NULL)
SELECT DISTINCT 'raw' AS stage, raw_label AS label FROM c
UNION ALL
SELECT DISTINCT 'standardized' AS stage, coalesce(m.m_std, c.raw_label) AS label
FROM c LEFT JOIN {MAPPING} m ON c.raw_label = m.m_raw""")
def q_label_unique(spark, sf):
    return S.label_unique(L.clean_labels(adapters.alerts(spark, sf), "raw_label"), "raw_label")


@query("row_audit", sql=lambda: adapters.cte("alerts") + f""",
j AS (
  SELECT a.source_file, a.raw_label, k.k_name
  FROM alerts a LEFT JOIN {MAPPING} m ON a.raw_label = m.m_raw
  LEFT JOIN {KNOWN} k ON coalesce(m.m_std, a.raw_label) = k.k_name
)
SELECT source_file, count(*) AS n_initial,
  count(*) FILTER (WHERE raw_label IS NOT DISTINCT FROM 'Label') AS n_header,
  count(*) FILTER (WHERE raw_label IS NULL) AS n_null_label,
  count(*) FILTER (WHERE raw_label IS DISTINCT FROM 'Label' AND raw_label IS NOT NULL AND k_name IS NULL) AS n_unknown,
  count(*) - count(*) FILTER (WHERE raw_label IS NOT DISTINCT FROM 'Label') - count(*) FILTER (WHERE raw_label IS NULL)
    - count(*) FILTER (WHERE raw_label IS DISTINCT FROM 'Label' AND raw_label IS NOT NULL AND k_name IS NULL) AS n_final
FROM j GROUP BY source_file""")
def q_row_audit(spark, sf):
    return S.row_audit(adapters.alerts(spark, sf), "raw_label", "source_file")


@query("binary_label", sql=lambda: with_alerts(STANDARDIZED) + """
SELECT row_id, label, CASE WHEN label IS NOT DISTINCT FROM 'Benign' THEN 0 ELSE 1 END AS binary_label
FROM standardized""")
def q_binary_label(spark, sf):
    df = L.standardize_label(L.clean_labels(adapters.alerts(spark, sf), "raw_label"), "raw_label", out="label")
    return df.select("row_id", "label", L.binary_label("label").alias("binary_label"))


@query("binary_label_raw", sql=lambda: adapters.cte("alerts") + f""",
s AS (SELECT a.row_id, coalesce(m.m_std, a.raw_label) AS label
      FROM alerts a LEFT JOIN {MAPPING} m ON a.raw_label = m.m_raw)
SELECT row_id, label, CASE WHEN label IS NOT DISTINCT FROM 'Benign' THEN 0 ELSE 1 END AS binary_label FROM s""")
def q_binary_label_raw(spark, sf):
    """The binary trainer's order: target mapped before the null drop, so a null label is malicious."""
    df = L.standardize_label(adapters.alerts(spark, sf), "raw_label", out="label")
    return df.select("row_id", "label", L.binary_label("label").alias("binary_label"))


@query("encode_labels", sql=lambda: with_alerts(LABELLED) + """
SELECT label, count(*) AS n, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
FROM labelled GROUP BY label""")
def q_encode_labels(spark, sf):
    return L.encode_labels(E.labelled_alerts(spark, sf), "label")


@query("class_weights", sql=lambda: with_alerts(LABELLED) + """,
c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label),
w AS (SELECT label, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c)
SELECT l.row_id, l.label, round(w.weight, 6) AS weight FROM labelled l JOIN w ON l.label = w.label""")
def q_class_weights(spark, sf):
    return S.class_weights(E.labelled_alerts(spark, sf), "label", "row_id")


# ---------------------------------------------------------------- lookups


@query("class_name", sql=lambda: adapters.cte("alerts") + f"""
SELECT a.row_id, a.class_id, coalesce(e.e_name, 'Unknown') AS class_name
FROM alerts a LEFT JOIN {ENCODER} e ON a.class_id = e.e_id""")
def q_class_name(spark, sf):
    return L.class_name(adapters.alerts(spark, sf).select("row_id", "class_id"), "class_id")


@query("class_name_runtime", sql=lambda: adapters.cte("alerts") + f"""
SELECT a.row_id, a.class_id, coalesce(d.name, 'Unknown') AS class_name
FROM alerts a LEFT JOIN (SELECT * FROM {LABEL_DIM} WHERE mapping = 'runtime') d ON a.class_id = d.id""")
def q_class_name_runtime(spark, sf):
    """The live scripts' id order, kept for comparison with the saved encoder."""
    return L.class_name(adapters.alerts(spark, sf).select("row_id", "class_id"), "class_id", mapping="runtime")


@query("label_dim", sql=lambda: with_alerts(LABELLED) + f"""
SELECT d.mapping, d.id, d.name, count(l.row_id) AS n_rows
FROM {LABEL_DIM} d LEFT JOIN labelled l ON l.label = d.name GROUP BY d.mapping, d.id, d.name""")
def q_label_dim(spark, sf):
    """Every label map with the number of observed rows carrying each name."""
    counts = S.label_counts(E.labelled_alerts(spark, sf), "label")
    dim = L.label_dim(spark)
    j = dim.join(counts, dim["name"] == counts["label"], "left")
    return j.select("mapping", "id", "name", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_rows"))


@query("alert_label_id", sql=lambda: with_alerts(SCORED) + f"""
SELECT s.row_id, coalesce(s.attack_label, 'Unknown') AS attack_type, coalesce(m.id, 13) AS alert_label_id
FROM scored s LEFT JOIN {values([(n, i) for n, i in D.ALERT_MODEL_CLASSES], 'name, id')} m
  ON coalesce(s.attack_label, 'Unknown') = m.name""")
def q_alert_label_id(spark, sf):
    df = E.alert_rows(spark, sf).select("row_id", F.coalesce("attack_label", F.lit("Unknown")).alias("attack_type"))
    return L.alert_label_id(df, "attack_type")


@query("text_label_id", sql=lambda: adapters.cte("alerts") + f"""
SELECT a.row_id, a.slm_label, coalesce(t.id, 15) AS text_label_id
FROM alerts a LEFT JOIN {values([(n.lower(), i) for i, n in D.TEXT_EVAL_CLASSES], 'lname, id')} t
  ON lower(a.slm_label) = t.lname""")
def q_text_label_id(spark, sf):
    return L.text_label_id(adapters.alerts(spark, sf).select("row_id", "slm_label"), "slm_label")


@query("label_to_id", sql=lambda: with_alerts(LABELLED) + f"""
SELECT l.row_id, l.label, t.id AS label_id
FROM labelled l JOIN {values([(n, i) for i, n in D.TEXT_EVAL_CLASSES], 'name, id')} t ON l.label = t.name""")
def q_label_to_id(spark, sf):
    return L.label_to_id(E.labelled_alerts(spark, sf).select("row_id", "label"), "label")
