"""Queries: file sources and sinks, each round-tripping data derived from the given tables
through a fresh folder under the shared checkpoint folder."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve.functions import detect as X
from netsieve.functions import domains as D
from netsieve.operators import labels as L
from netsieve.operators import stats as S
from netsieve.plans import evaluation as E
from netsieve.plans import q_examples, q_labels, q_metrics
from netsieve.plans.registry import ORACLE, query
from netsieve.plans.sqlbase import KNOWN, LABEL_DIM, LABELLED, MAPPING, SCORED, with_alerts
from netsieve.session import scratch_dir
from netsieve.sources import adapters
from netsieve.sources import csv_folder as CF
from netsieve.sources import sinks as SK

N_FILES = 5


def flow_csv_folder(spark, sf) -> str:
    """A folder of flow CSVs derived from the alert inputs: one file per ``user_id % 5`` with differing
    headers (one with identity columns, one without ``Protocol``), inf / NaN spellings, impossible
    dates, repeated-header labels, empty labels, plus a non-CSV file and an empty CSV."""
    folder = scratch_dir(spark, "flows-csv")
    a = adapters.alerts(spark, sf)
    byts = (F.when(F.col("row_id") % 50 == 0, F.lit("Infinity")).when(F.col("row_id") % 71 == 0, F.lit("-inf"))
             .when(F.col("row_id") % 89 == 0, F.lit("NaN")).otherwise(F.col("flow_byts_s").cast("string")))
    ts = F.when(F.col("row_id") % 13 == 0, F.lit("31/02/2024 10:00:00")).otherwise(
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    cols = {
        "Flow ID": F.concat_ws("-", F.col("row_id").cast("string"), F.col("flow_key").cast("string")),
        "Src IP": F.concat(F.lit("10.0.0."), (F.col("flow_key") % 250).cast("string")),
        "Dst IP": F.concat(F.lit("8.8.4."), (F.col("row_id") % 250).cast("string")),
        "Src Port": F.col("src_port"), "Dst Port": F.col("dst_port"), "Protocol": F.col("protocol"), "Timestamp": ts,
        "Flow Duration": (F.col("flow_iat_mean") * 3).cast("long"), "Tot Fwd Pkts": F.col("tot_fwd_pkts"),
        "Tot Bwd Pkts": F.col("tot_bwd_pkts"), "TotLen Fwd Pkts": F.col("fwd_pkt_len_mean"),
        "TotLen Bwd Pkts": F.col("bwd_pkt_len_mean"), "Flow Byts/s": byts, "Flow Pkts/s": F.col("flow_pkts_s"),
        "Flow IAT Mean": F.col("flow_iat_mean"), "Fwd Header Len": F.col("fwd_header_len"),
        "Bwd Header Len": F.col("bwd_header_len"), "RST Flag Cnt": F.col("rst_flag_cnt"),
        "SYN Flag Cnt": F.col("syn_flag_cnt"), "Label": F.col("raw_label"),
    }
    identity = ["Flow ID", "Src IP", "Dst IP"]
    for k in range(N_FILES):
        names = [n for n in cols if n not in identity or k == 1]
        if k == 3:
            names = [n for n in names if n != "Protocol"]
        part = a.where(F.col("flow_key") % N_FILES == k).select(*[cols[n].alias(n) for n in names])
        SK.write_named_csv(part, folder, f"day{k}.csv")
    SK.write_text_file(spark, f"{folder}/notes.txt", "flow captures, see day*.csv\n")
    SK.write_text_file(spark, f"{folder}/empty.csv", "")
    return folder


# Oracle side: the rows of the CSV folder written by ``flow_csv_folder``, as the scan types them
# (numbers read back as doubles; columns a file lacks are null for its rows).
def _sql_scan() -> str:
    k = f"flow_key % {N_FILES}"
    return adapters.cte("alerts") + f""",
scan AS (SELECT
  CASE WHEN {k} = 1 THEN CAST(row_id AS VARCHAR) || '-' || CAST(flow_key AS VARCHAR) END AS flow_id,
  CASE WHEN {k} = 1 THEN '10.0.0.' || CAST(flow_key % 250 AS VARCHAR) END AS src_ip,
  CASE WHEN {k} = 1 THEN '8.8.4.' || CAST(row_id % 250 AS VARCHAR) END AS dst_ip,
  CAST(src_port AS DOUBLE) AS src_port, CAST(dst_port AS DOUBLE) AS dst_port,
  CASE WHEN {k} <> 3 THEN CAST(protocol AS DOUBLE) END AS protocol,
  CASE WHEN row_id % 13 = 0 THEN '31/02/2024 10:00:00' ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS timestamp,
  CAST(trunc(flow_iat_mean * 3) AS DOUBLE) AS flow_duration,
  CAST(tot_fwd_pkts AS DOUBLE) AS tot_fwd_pkts, CAST(tot_bwd_pkts AS DOUBLE) AS tot_bwd_pkts,
  fwd_pkt_len_mean AS totlen_fwd_pkts, bwd_pkt_len_mean AS totlen_bwd_pkts,
  CASE WHEN row_id % 50 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN row_id % 71 = 0 THEN CAST('-inf' AS DOUBLE)
       WHEN row_id % 89 = 0 THEN CAST('NaN' AS DOUBLE) ELSE flow_byts_s END AS flow_byts_s,
  flow_pkts_s, flow_iat_mean, fwd_header_len, bwd_header_len,
  CAST(rst_flag_cnt AS DOUBLE) AS rst_flag_cnt, CAST(syn_flag_cnt AS DOUBLE) AS syn_flag_cnt,
  raw_label AS label, source_file
FROM alerts)"""


@query("flow_scan", sql=lambda: _sql_scan() + "\nSELECT * FROM scan")
def q_flow_scan(spark, sf):
    """Every row of every CSV file, columns aligned by name across differing headers, typed."""
    return CF.scan_flows(spark, flow_csv_folder(spark, sf))


@query("schema_check", sql=lambda: adapters.cte("alerts") + f"""
SELECT DISTINCT source_file AS file_name,
  CASE WHEN flow_key % {N_FILES} = 3 THEN ['Protocol'] ELSE CAST([] AS VARCHAR[]) END AS missing_columns,
  flow_key % {N_FILES} <> 3 AS ok
FROM alerts""")
def q_schema_check(spark, sf):
    """Per CSV file: required columns it lacks and whether it is used."""
    folder = flow_csv_folder(spark, sf)
    return CF.schema_report(CF.csv_headers(spark, folder)).select("file_name", "missing_columns", "ok")


@query("ingest_report", sql=lambda: adapters.cte("alerts") + f"""
SELECT source_file AS file_name, CASE WHEN flow_key % {N_FILES} = 3 THEN 'skipped: missing columns Protocol' ELSE 'processed' END AS status,
  CASE WHEN flow_key % {N_FILES} = 3 THEN 0 ELSE count(*) END AS n_rows
FROM alerts GROUP BY source_file, flow_key % {N_FILES}
UNION ALL SELECT 'broken.csv', 'skipped: ' || count(*) FILTER (WHERE row_id % 3 = 0) || ' rows with more fields than the header', count(*)
FROM alerts WHERE row_id % 50 = 0
UNION ALL VALUES ('notes.txt', 'skipped: not a CSV file', 0), ('empty.csv', 'skipped: empty file', 0)""")
def q_ingest_report(spark, sf):
    """Processed / skipped files (not CSV, empty, missing columns, rows of more fields than the header) with rows read per file."""
    folder = flow_csv_folder(spark, sf)
    rows = adapters.alerts(spark, sf).where("row_id % 50 = 0")
    head = spark.createDataFrame([(-1, ",".join(D.REQUIRED_COLUMNS))], "row_id long, value string")
    fields = F.concat_ws(",", *[F.col("row_id").cast("string")] * len(D.REQUIRED_COLUMNS))
    lines = rows.select("row_id", F.concat(fields, F.when(F.col("row_id") % 3 == 0, ",x").otherwise("")).alias("value"))
    SK.write_named_text(head.union(lines).coalesce(1).sortWithinPartitions("row_id").select("value"), folder, "broken.csv")
    return CF.ingest_report(spark, folder).drop("length")


@query("clean_sink", sql=lambda: _sql_scan() + f""",
std AS (SELECT s.* EXCLUDE (label), coalesce(m.m_std, s.label) AS label
        FROM scan s LEFT JOIN {MAPPING} m ON s.label = m.m_raw
        WHERE s.label IS DISTINCT FROM 'Label' AND s.label IS NOT NULL),
t AS (SELECT *, try_strptime(timestamp, '%d/%m/%Y %H:%M:%S') AS _t FROM std
      WHERE label IN (SELECT k_name FROM {KNOWN}))
SELECT * EXCLUDE (_t), CAST(hour(_t) AS INTEGER) AS hour, CAST(minute(_t) AS INTEGER) AS minute,
  CAST(second(_t) AS INTEGER) AS second, CAST(isodow(_t) - 1 AS INTEGER) AS day_of_week FROM t""")
def q_clean_sink(spark, sf):
    """Scan -> drop header rows and null labels -> standardize -> time parts -> known labels
    -> Parquet partitioned by source file; returns the written table."""
    df = CF.scan_flows(spark, flow_csv_folder(spark, sf), required=None)
    df = L.known_labels(L.standardize_label(L.clean_labels(df, "label"), "label"), "label")
    df = df.withColumn("_t", X.parse_day_first("timestamp")).select(
        "*", *X.time_parts("_t")).drop("_t")
    out = scratch_dir(spark, "clean")
    SK.write_clean(df, out)
    return spark.read.parquet(out)


_EX_FIELDS = [("Protocol", "protocol"), ("Src Port", "src_port"), ("Dst Port", "dst_port"),
              ("Flow Rate", "flow_rate"), ("Packet Rate", "packet_rate"), ("IAT Mean", "iat_mean"),
              ("Attack Type", "attack_type")]


def _sql_examples() -> str:
    return f"SELECT * EXCLUDE (row_id, is_twin) FROM ({q_examples._examples_sql(False)})"


@query("examples_write", sql=_sql_examples)
def q_examples_write(spark, sf):
    """Training examples written as nested JSON Lines and read back with the declared schema
    (returned with one column per field)."""
    out = scratch_dir(spark, "examples")
    SK.write_examples(q_examples.nested(q_examples.examples(q_examples.sampled(spark, sf))), out)
    ex = SK.read_examples(spark, out)
    return ex.select(*[F.col(f"input.`{k}`").alias(v) for k, v in _EX_FIELDS], "output.threat", "output.mitigation",
                     "output.impact")


@query("examples_read", sql=lambda: f"SELECT attack_type, count(*) AS n FROM ({_sql_examples()}) GROUP BY attack_type")
def q_examples_read(spark, sf):
    """Load a training-example file and count examples per attack type."""
    out = scratch_dir(spark, "examples-src")
    SK.write_examples(q_examples.nested(q_examples.examples(q_examples.sampled(spark, sf))), out)
    ex = SK.read_examples(spark, out)
    return ex.groupBy(F.col("input.`Attack Type`").alias("attack_type")).agg(F.count(F.lit(1)).alias("n"))


@query("label_dim_write", sql=lambda: with_alerts(LABELLED) + f""",
dim AS (SELECT * FROM {LABEL_DIM} WHERE name IN (SELECT label FROM labelled))
SELECT mapping,
  '{{"classes":[' || string_agg('"' || name || '"', ',' ORDER BY id, name) || ']}}' AS classes_json,
  '{{' || string_agg('"' || name || '":' || CAST(id AS VARCHAR), ',' ORDER BY name, id) || '}}' AS mapping_json
FROM dim GROUP BY mapping""")
def q_label_dim_write(spark, sf):
    """Label maps of the observed labels written as JSON text (class list and name -> id) and read back."""
    seen = S.label_counts(E.labelled_alerts(spark, sf), "label").select(F.col("label").alias("name"))
    dim = L.label_dim(spark).join(seen, "name", "left_semi")
    out = scratch_dir(spark, "label-maps")
    SK.write_label_maps(dim, out)
    parts = F.split("value", "\t")
    return spark.read.text(out).select(parts[0].alias("mapping"), parts[1].alias("classes_json"),
                                       parts[2].alias("mapping_json"))


# ---------------------------------------------------------------- logs and result files, written and read back


def _all_text(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in df.columns])


@query("traffic_log_file", sql=lambda: with_alerts(SCORED) + """
SELECT row_id, protocol, src_port, dst_port, flow_byts_s, flow_pkts_s, binary_pred AS binary_prediction,
  coalesce(CASE WHEN coalesce(binary_pred, false) THEN class_label END, 'Benign') AS multiclass_label,
  CASE WHEN row_id % 2 = 0 THEN 'first' ELSE 'second' END AS run_id
FROM scored""")
def q_traffic_log_file(spark, sf):
    """The traffic log appended in two runs, the second of them twice, beside an attempt that was never committed; read back."""
    rows = q_labels.q_traffic_log(spark, sf)
    path = scratch_dir(spark, "traffic-log")
    SK.append_log(rows.where("row_id % 2 = 0"), path, "first", "parquet")
    SK.append_log(rows.where("row_id % 2 = 1 AND row_id % 5 = 0"), path, "second", "parquet")
    SK.append_log(rows.where("row_id % 2 = 1"), path, "second", "parquet")
    rows.write.parquet(f"{path}/run_id=third/attempt=unfinished")
    return SK.read_log(spark, path, rows.schema, "parquet")


def _three(names: str) -> str:
    return ", ".join(f"printf('%.3f', CAST({n} AS DOUBLE)) AS {n}" for n in names.split())


@query("alert_log_csv", sql=lambda: f"""
SELECT CAST(row_index AS VARCHAR) AS row_index, timestamp, CAST(actual_label AS VARCHAR) AS actual_label,
  CAST(binary_prediction AS VARCHAR) AS binary_prediction, multiclass_prediction, slm_label,
  {_three("slm_score flow_rate_bytes_s packet_rate_pkts_s iat_mean_ms forward_header_length backward_header_length packet_length_min packet_length_max")},
  CAST(protocol AS VARCHAR) AS protocol, CAST(source_port AS VARCHAR) AS source_port, CAST(destination_port AS VARCHAR) AS destination_port,
  CAST(rst_flags AS VARCHAR) AS rst_flags, CAST(syn_flags AS VARCHAR) AS syn_flags, traffic_pattern, notification, 'run' AS run_id
FROM ({ORACLE["alert_log"]()})""")
def q_alert_log_csv(spark, sf):
    """The alert log as a CSV of 3 decimals (its texts span lines), read back as text."""
    log = E.alert_log(spark, sf)
    path = scratch_dir(spark, "alert-log")
    SK.append_log(SK.three_decimals(log), path, "run")
    return SK.read_log(spark, path, _all_text(log))


@query("run_summary_csv", sql=lambda: f"""
SELECT *, 2.5::DOUBLE AS test_duration_minutes, '2024-05-06 07:08:09' AS test_start_time, '2024-05-06 07:10:39' AS test_end_time
FROM ({ORACLE["run_summary"]()})""")
def q_run_summary_csv(spark, sf):
    """The run summary of 8 columns (for a run of two and a half minutes) written as CSV and read back."""
    start = datetime.datetime(2024, 5, 6, 7, 8, 9)
    summary = E.with_timing(E.run_summary(spark, sf), start, start + datetime.timedelta(seconds=150))
    path = scratch_dir(spark, "summary")
    summary.write.option("header", True).csv(path)
    return spark.read.schema(summary.schema).option("header", True).csv(path)


@query("text_eval_csv", sql=lambda: f"""
SELECT CAST(index AS VARCHAR) AS index, CAST(ground_truth AS VARCHAR) AS ground_truth, CAST(slm_prediction AS VARCHAR) AS slm_prediction,
  slm_label, printf('%.3f', slm_score) AS slm_score FROM ({ORACLE["text_eval_rows"]()})""")
def q_text_eval_csv(spark, sf):
    """The rows of the text evaluation as a CSV of 3 decimals, read back as text."""
    rows = q_metrics.q_text_eval_rows(spark, sf)
    path = scratch_dir(spark, "text-eval")
    SK.write_csv_3dp(rows, path)
    return spark.read.schema(_all_text(rows)).option("header", True).csv(path)
