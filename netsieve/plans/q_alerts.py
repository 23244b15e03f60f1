"""Queries: detection scalars, alert texts, prompts, text operators, packet features."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve import schemas
from netsieve.functions import alerts as A
from netsieve.functions import detect as X
from netsieve.functions import domains as D
from netsieve.functions import textops as TX
from netsieve.operators import clean as C
from netsieve.operators import labels as L
from netsieve.plans import evaluation as E
from netsieve.plans.registry import query
from netsieve.plans.sqlbase import SCORED, gt, with_alerts
from netsieve.session import table
from netsieve.sources import adapters

REC = ["row_id", "protocol", "src_port", "dst_port", "flow_byts_s", "flow_pkts_s", "flow_iat_mean", "fwd_header_len",
       "bwd_header_len", "rst_flag_cnt", "syn_flag_cnt", "tot_fwd_pkts", "tot_bwd_pkts", "fwd_pkt_len_mean",
       "bwd_pkt_len_mean", "slm_label", "slm_score", "binary_pred", "attack_label"]


def records(spark, sf):
    """Scored alert records (every labelled row; ``attack_label`` is null unless the binary model fired)."""
    return E.alert_rows(spark, sf).select(*REC)


def _scored_sql(select: str) -> str:
    return with_alerts(SCORED) + f"\nSELECT {select} FROM scored"


def _text_query(name: str, spark_col, sql_expr):
    @query(name, sql=lambda: _scored_sql(f"row_id, attack_label, {sql_expr()} AS {name}"))
    def _q(spark, sf):
        return records(spark, sf).select("row_id", "attack_label", spark_col().alias(name))
    return _q


_text_query("alert_fallback", A.alert_fallback, A.sql_alert_fallback)
_text_query("alert_generic", A.alert_generic, A.sql_alert_generic)


@query("alert_text", sql=lambda: _scored_sql(f"row_id, attack_label, {A.sql_alert_text()} AS alert_text"))
def q_alert_text(spark, sf):
    """The intended alert text per row; rows missing a needed metric get the fallback text."""
    return A.add_alert_text(records(spark, sf)).select("row_id", "attack_label", "alert_text")


@query("alert_detail", sql=lambda: _scored_sql(f"row_id, attack_label, {A.sql_alert_detail()} AS alert_detail"))
def q_alert_detail(spark, sf):
    return A.add_alert_detail(records(spark, sf)).select("row_id", "attack_label", "alert_detail")


@query("alert_detail2", sql=lambda: _scored_sql(f"row_id, attack_label, {A.sql_alert_detail2()} AS alert_detail2"))
def q_alert_detail2(spark, sf):
    return A.add_alert_detail(records(spark, sf), "alert_detail2", second=True).select(
        "row_id", "attack_label", "alert_detail2")
_text_query("threat_text", A.threat_text, A.sql_threat_text)
_text_query("port_analysis", A.port_analysis, A.sql_port_analysis)


@query("prompt_summary", sql=lambda: _scored_sql(
    f"row_id, attack_label, {A.sql_prompt_summary()} AS prompt_summary, {A.sql_prompt_words()} AS prompt_words"))
def q_prompt_summary(spark, sf):
    """The whole summary prompt of each record and its length in words."""
    return records(spark, sf).select("row_id", "attack_label", A.prompt_summary().alias("prompt_summary"),
                                     A.prompt_words().alias("prompt_words"))



@query("alert_confidence", sql=lambda: _scored_sql(
    f"row_id, attack_label, {A.sql_alert_confidence('slm_score')} AS alert_confidence"))
def q_alert_confidence(spark, sf):
    """Severity-headed alert; the confidence shown is the text-model score."""
    return A.add_alert_confidence(records(spark, sf), F.col("slm_score")).select(
        "row_id", "attack_label", "alert_confidence")


@query("prompt_classifier", sql=lambda: _scored_sql(
    f"row_id, {A.sql_prompt_classifier(A.AT)} AS prompt_classifier"))
def q_prompt_classifier(spark, sf):
    r = records(spark, sf)
    return r.select("row_id", A.prompt_classifier(F.coalesce("attack_label", F.lit("Unknown"))).alias("prompt_classifier"))


@query("alert_template", sql=lambda: _scored_sql(
    f"row_id, attack_label, {A.sql_example_parts()['threat']} AS threat, "
    f"{A.sql_example_parts()['mitigation']} AS mitigation, {A.sql_example_parts()['impact']} AS impact, "
    f"{A._sql_lookup(A.AT, A.TPL.MITIGATION, A.TPL.MITIGATION_DEFAULT)} AS alert_mitigation, "
    f"{A._sql_lookup(A.AT, A.TPL.IMPACT, A.TPL.IMPACT_DEFAULT)} AS alert_impact"))
def q_alert_template(spark, sf):
    """Attack type -> template texts (training-example set and intended-alert set); miss -> default row."""
    r = records(spark, sf)
    at = F.coalesce("attack_label", F.lit("Unknown"))
    parts = A._example_parts(at)
    return r.select("row_id", "attack_label", parts["threat"].alias("threat"), parts["mitigation"].alias("mitigation"),
                    parts["impact"].alias("impact"),
                    A._lookup(at, A.TPL.MITIGATION, A.TPL.MITIGATION_DEFAULT).alias("alert_mitigation"),
                    A._lookup(at, A.TPL.IMPACT, A.TPL.IMPACT_DEFAULT).alias("alert_impact"))


@query("alert_metrics", sql=lambda: _scored_sql(
    "row_id, " + ", ".join(f"{A.sql_value(n)} AS {n}" for n in A.METRIC_LABELS)))
def q_alert_metrics(spark, sf):
    return A.alert_metrics(records(spark, sf))


@query("traffic_pattern", sql=lambda: _scored_sql(f"row_id, {A.sql_traffic_pattern()} AS traffic_pattern"))
def q_traffic_pattern(spark, sf):
    return records(spark, sf).select("row_id", X.traffic_pattern("flow_pkts_s", "flow_iat_mean").alias("traffic_pattern"))


@query("impact_level", sql=lambda: _scored_sql(f"row_id, {A.sql_impact_level()} AS impact_level"))
def q_impact_level(spark, sf):
    return records(spark, sf).select("row_id", X.impact_level("flow_byts_s", "flow_pkts_s").alias("impact_level"))


@query("severity", sql=lambda: _scored_sql(f"row_id, {A.sql_severity()} AS severity"))
def q_severity(spark, sf):
    return records(spark, sf).select("row_id", X.severity("flow_byts_s", "flow_pkts_s", "rst_flag_cnt").alias("severity"))


@query("protocol_name", sql=lambda: adapters.cte("packets") +
       f"\nSELECT packet_id, protocol, {A._sql_protocol_name()} AS protocol_name FROM packets")
def q_protocol_name(spark, sf):
    p = adapters.packets(spark, sf)
    return p.select("packet_id", "protocol", L.protocol_name(F.col("protocol")).alias("protocol_name"))


@query("port_service", sql=lambda: adapters.cte("packets") +
       f"\nSELECT packet_id, {A._sql_service('src_port')} AS src_service, "
       f"{A._sql_service('dst_port')} AS dst_service FROM packets")
def q_port_service(spark, sf):
    p = adapters.packets(spark, sf)
    return p.select("packet_id", L.port_service(F.col("src_port")).alias("src_service"),
                    L.port_service(F.col("dst_port")).alias("dst_service"))


@query("alert_record", sql=lambda: _scored_sql(
    "row_id, coalesce(CAST(protocol AS VARCHAR), 'Unknown') AS protocol, "
    "coalesce(CAST(src_port AS VARCHAR), 'Unknown') AS src_port, "
    "coalesce(CAST(dst_port AS VARCHAR), 'Unknown') AS dst_port, flow_byts_s, flow_pkts_s, flow_iat_mean, "
    "fwd_header_len, bwd_header_len, rst_flag_cnt, syn_flag_cnt, pkt_len_min, pkt_len_max, slm_label, slm_score, "
    "binary_pred AS binary_prediction, attack_label AS multiclass_label"))
def q_alert_record(spark, sf):
    df = C.alert_record(E.alert_rows(spark, sf))
    return df.select("row_id", "alert.*")


@query("alert_defaults", sql=lambda: adapters.cte("packets") + """
SELECT packet_id, protocol, src_port, dst_port, CAST(pkt_len AS INTEGER) AS pkt_len,
  CAST(0 AS BIGINT) AS flow_byts_s, CAST(0 AS BIGINT) AS flow_pkts_s, CAST(0 AS BIGINT) AS flow_iat_mean,
  CAST(0 AS BIGINT) AS fwd_header_len, CAST(0 AS BIGINT) AS bwd_header_len,
  CAST(0 AS BIGINT) AS rst_flag_cnt, CAST(0 AS BIGINT) AS syn_flag_cnt FROM packets""")
def q_alert_defaults(spark, sf):
    """Packet rows carry none of the required alert metrics: each is added as 0."""
    p = adapters.packets(spark, sf).select("packet_id", "protocol", "src_port", "dst_port", "pkt_len")
    return C.alert_defaults(p)


# ---------------------------------------------------------------- rules on packets


@query("rule_port", sql=lambda: adapters.cte("packets") + """
SELECT packet_id, coalesce(protocol = 6 AND dst_port NOT IN (80, 443), false) AS suspicious_port FROM packets""")
def q_rule_port(spark, sf):
    return adapters.packets(spark, sf).select("packet_id", X.rule_port("protocol", "dst_port").alias("suspicious_port"))


@query("rule_external", sql=lambda: adapters.cte("packets") + """
SELECT packet_id, coalesce(protocol = 6 AND NOT contains(src_ip, '192.168.') AND NOT contains(dst_ip, '192.168.'),
  false) AS external FROM packets""")
def q_rule_external(spark, sf):
    return adapters.packets(spark, sf).select(
        "packet_id", X.rule_external("protocol", "src_ip", "dst_ip").alias("external"))


@query("tcp_flags", sql=lambda: adapters.cte("packets") + "\nSELECT packet_id, " + ", ".join(
    f"CAST(coalesce((tcp_flags & {m}) <> 0, false) AS INTEGER) AS {n}" for n, m in D.TCP_FLAG_MASKS)
    + " FROM packets")
def q_tcp_flags(spark, sf):
    return adapters.packets(spark, sf).select("packet_id", *X.tcp_flag_columns("tcp_flags"))


def _sql_packet_features(names, more=None):
    base = {
        "src_port": "coalesce(src_port, 0)", "dst_port": "coalesce(dst_port, 0)", "protocol": "coalesce(protocol, 0)",
        "pkt_len_min": "CAST(pkt_len AS DOUBLE)", "pkt_len_max": "CAST(pkt_len AS DOUBLE)",
        "pkt_len_mean": "CAST(pkt_len AS DOUBLE)", "pkt_len_std": "0.0::DOUBLE", "pkt_len_var": "0.0::DOUBLE",
        "hour": "CAST(hour(ts) AS INTEGER)", "minute": "CAST(minute(ts) AS INTEGER)",
        "second": "CAST(second(ts) AS INTEGER)", "day_of_week": "CAST(isodow(ts) - 1 AS INTEGER)",
    }
    for n, m in D.TCP_FLAG_MASKS:
        base[n] = f"CAST(coalesce((tcp_flags & {m}) <> 0, false) AS INTEGER)"
    base.update(more or {})
    return ", ".join(f"{base.get(n, '0.0::DOUBLE')} AS {n}" for n in names)


_SQL_EARLY = {
    "tot_fwd_pkts": "1.0::DOUBLE", "totlen_fwd_pkts": "CAST(pkt_len AS DOUBLE)", "pkt_size_avg": "CAST(pkt_len AS DOUBLE)",
    "fwd_header_len": "CASE WHEN coalesce(protocol, 0) <> 0 THEN 20.0 ELSE 0.0 END::DOUBLE",
    "init_fwd_win_byts": "CASE WHEN tcp_flags IS NOT NULL THEN coalesce(tcp_window, 0) ELSE 0 END",
}


@query("packet_features", sql=lambda: adapters.cte("packets") +
       f"\nSELECT packet_id, {_sql_packet_features(schemas.PACKET_FEATURES)} FROM packets")
def q_packet_features(spark, sf):
    return C.packet_features(adapters.packets(spark, sf), "wide")


@query("packet_features_narrow", sql=lambda: adapters.cte("packets") +
       f"\nSELECT packet_id, {_sql_packet_features(schemas.NARROW_FEATURES)} FROM packets")
def q_packet_features_narrow(spark, sf):
    return C.packet_features(adapters.packets(spark, sf), "narrow")


@query("packet_features_early", sql=lambda: adapters.cte("packets") +
       f"\nSELECT packet_id, {_sql_packet_features(schemas.EARLY_FEATURES, _SQL_EARLY)} FROM packets")
def q_packet_features_early(spark, sf):
    """The first live form: forward counts, header length and first window of each packet."""
    return C.packet_features(adapters.packets(spark, sf), "early")


@query("align_features", sql=lambda: adapters.cte("packets") + "\nSELECT packet_id, " + ", ".join(
    (f"CAST(f.{c} AS DOUBLE) AS {c}" if c in schemas.NARROW_FEATURES else f"0.0::DOUBLE AS {c}")
    for c in schemas.EARLY_FEATURES) + f" FROM (SELECT packet_id, {_sql_packet_features(schemas.NARROW_FEATURES)} "
    "FROM packets) f")
def q_align_features(spark, sf):
    """A narrow feature row aligned to the early model's feature list (missing -> 0, order fixed)."""
    narrow = C.packet_features(adapters.packets(spark, sf), "narrow")
    return C.align_features(narrow, schemas.EARLY_FEATURES, keep=["packet_id"])


_SQL_TIME_TEXT = adapters.cte("alerts") + """,
t AS (SELECT row_id, CASE WHEN row_id % 13 = 0 THEN '31/02/2024 10:00:00'
                          WHEN row_id % 17 = 0 THEN 'not a date'
                          ELSE CASE row_id % 7 WHEN 0 THEN strftime(ts, '%-d/%-m/%Y %H:%M')
                                               WHEN 1 THEN strftime(ts, '%d-%m-%Y %H:%M:%S')
                                               WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                                               WHEN 3 THEN strftime(ts, '%d/%m/%Y %I:%M:%S %p')
                                               ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END END AS timestamp_text FROM alerts),
p AS (SELECT *, try_strptime(timestamp_text, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %I:%M:%S %p', '%d/%m/%Y %H:%M',
                                              '%d-%m-%Y %H:%M:%S', '%Y-%m-%d %H:%M:%S']) AS parsed FROM t)"""


@query("time_features", sql=_SQL_TIME_TEXT + """
SELECT row_id, timestamp_text, CAST(hour(parsed) AS INTEGER) AS hour, CAST(minute(parsed) AS INTEGER) AS minute,
  CAST(second(parsed) AS INTEGER) AS second, CAST(isodow(parsed) - 1 AS INTEGER) AS day_of_week FROM p""")
def q_time_features(spark, sf):
    """Day-first text times in several spellings (some impossible or malformed) -> hour, minute, second, weekday (Monday = 0)."""
    return _time_text(spark, sf).select("row_id", "timestamp_text", *X.time_parts("parsed"))


def _time_text(spark, sf):
    a = adapters.alerts(spark, sf)
    text = (F.when(F.col("row_id") % 13 == 0, F.lit("31/02/2024 10:00:00"))
             .when(F.col("row_id") % 17 == 0, F.lit("not a date"))
             .when(F.col("row_id") % 7 == 0, F.date_format("ts", "d/M/yyyy HH:mm"))
             .when(F.col("row_id") % 7 == 1, F.date_format("ts", "dd-MM-yyyy HH:mm:ss"))
             .when(F.col("row_id") % 7 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
             .when(F.col("row_id") % 7 == 3, F.date_format("ts", "dd/MM/yyyy hh:mm:ss a"))
             .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")))
    t = a.select("row_id", text.alias("timestamp_text"))
    return t.withColumn("parsed", X.parse_day_first("timestamp_text").cast("timestamp_ntz"))


@query("valid_time", sql=_SQL_TIME_TEXT + """
SELECT row_id, timestamp_text FROM p WHERE parsed IS NOT NULL""")
def q_valid_time(spark, sf):
    return C.valid_time(_time_text(spark, sf), "parsed").select("row_id", "timestamp_text")


# ---------------------------------------------------------------- text operators


@query("payload_text", sql=lambda: adapters.cte("alerts") + """
SELECT row_id, 'Flow Bytes/s: ' || coalesce(CAST(flow_byts_s AS VARCHAR), 'Unknown') || ', Flow Packets/s: '
  || coalesce(CAST(flow_pkts_s AS VARCHAR), 'Unknown') AS payload_text FROM (
    SELECT row_id, CASE row_id % 4 WHEN 0 THEN flow_byts_s WHEN 1 THEN flow_byts_s / 1e9::DOUBLE WHEN 2 THEN flow_byts_s * 1e5::DOUBLE
                     ELSE flow_byts_s * 1e14::DOUBLE END AS flow_byts_s,
           CASE WHEN row_id % 11 > 0 THEN flow_pkts_s / 3 END AS flow_pkts_s FROM alerts)""")
def q_payload_text(spark, sf):
    """Flow rates as text, from 1e-8 to 1e18 and with missing ones: every spelling of a double."""
    rate, kind = F.col("flow_byts_s"), F.col("row_id") % 4
    a = adapters.alerts(spark, sf).select(
        "row_id", F.when(kind == 0, rate).when(kind == 1, rate / 1e9).when(kind == 2, rate * 1e5).otherwise(rate * 1e14).alias("flow_byts_s"),
        F.when(F.col("row_id") % 11 > 0, F.col("flow_pkts_s") / 3).alias("flow_pkts_s"))
    return a.select("row_id", TX.payload_text("flow_byts_s", "flow_pkts_s").alias("payload_text"))


@query("packet_payload_text", sql=lambda: adapters.cte("packets") + """
SELECT packet_id, 'Source: ' || coalesce(src_ip, 'Unknown') || ', Destination: ' || coalesce(dst_ip, 'Unknown') || ', Payload: '
  || coalesce(payload, 'Unknown') AS payload_text FROM packets""")
def q_packet_payload_text(spark, sf):
    """The text of each packet that a text scorer reads."""
    return adapters.packets(spark, sf).select(
        "packet_id", TX.packet_payload_text("src_ip", "dst_ip", "payload").alias("payload_text"))


@query("clean_text", sql=lambda: f"SELECT doc_id, {TX.sql_clean_text('text')} AS clean_text FROM documents")
def q_clean_text(spark, sf):
    """Keyword line filter over the whole text of every document."""
    docs = table(spark, sf, "documents")
    d = docs.select("doc_id", "text")
    return d.select("doc_id", TX.clean_text("text").alias("clean_text"))


@query("validate_text", sql=lambda: _scored_sql(
    f"row_id, {TX.sql_validate_text(A.sql_alert_text(), A.sql_alert_fallback())} AS validated"))
def q_validate_text(spark, sf):
    """Generated alert texts reduced to THREAT / MITIGATION (≤ 3 steps) / IMPACT, else the fallback."""
    r = A.add_alert_text(records(spark, sf))
    return r.select("row_id", TX.validate_text("alert_text", A.alert_fallback()).alias("validated"))


@query("validate_document", sql=lambda: f"""
SELECT doc_id, {TX.sql_validate_text('text', "'INVALID'")} AS validated FROM documents""")
def q_validate_document(spark, sf):
    """The same section validation over free document texts (most have no sections)."""
    docs = table(spark, sf, "documents")
    d = docs.select("doc_id", "text")
    return d.select("doc_id", TX.validate_text("text", F.lit("INVALID")).alias("validated"))


# ---------------------------------------------------------------- score arrays


@query("softmax_confidence", sql="""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - list_max(embedding))) AS e
           FROM embeddings)
SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS pred_idx,
  round(list_max(e) / list_sum(e), 6) AS confidence FROM s""")
def q_softmax_confidence(spark, sf):
    """Softmax over each score vector, its arg-max and the winning probability."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    p = e.select("vec_id", X.softmax("s").alias("p"))
    return p.select("vec_id", X.argmax("p").alias("pred_idx"), F.round(F.array_max("p"), 6).alias("confidence"))


@query("argmax_class", sql="""
SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred_idx
FROM embeddings""")
def q_argmax_class(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", X.argmax("embedding").alias("pred_idx"))


@query("mean_score_flag", sql="""
WITH m AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS m
           FROM embeddings)
SELECT vec_id, round(m, 6) AS mean_score, NOT isnan(m) AND m > 0.5 AS is_suspicious,
  CASE WHEN NOT isnan(m) AND m > 0.5 THEN 'Suspicious pattern detected' ELSE 'Normal traffic' END AS details FROM m""")
def q_mean_score_flag(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    m = e.select("vec_id", X.array_mean("s").alias("m"))
    flag = ~F.isnan("m") & (F.col("m") > 0.5)
    return m.select("vec_id", F.round("m", 6).alias("mean_score"), flag.alias("is_suspicious"),
                    F.when(flag, F.lit("Suspicious pattern detected")).otherwise(F.lit("Normal traffic")).alias("details"))


_ = gt  # re-exported helper used by other query modules
