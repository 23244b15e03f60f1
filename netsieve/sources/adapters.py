"""Adapters: network-shaped rows derived from the given tables.

The given tables hold no network data, so packets, alert inputs and flows are
derived from ``events`` and ``lineitem`` with plain SQL expressions. Each
expression is valid in both Spark SQL and DuckDB, so the oracle SQL uses the
very same text (see ``cte``). All work stays a narrow projection: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netsieve.session import table

_DST_PORT = (
    "CAST(CASE WHEN event_id % 4 = 1 THEN 0 ELSE CASE event_id % 7 WHEN 0 THEN 80 WHEN 1 THEN 443 "
    "WHEN 2 THEN 21 WHEN 3 THEN 22 WHEN 4 THEN 8080 WHEN 5 THEN 3389 ELSE 5353 END END AS INT)"
)
_PROTOCOL = "CAST(CASE event_id % 4 WHEN 0 THEN 17 WHEN 1 THEN 1 ELSE 6 END AS INT)"
_SRC_PORT = "CAST(CASE WHEN event_id % 4 = 1 THEN 0 ELSE 1024 + user_id END AS INT)"
_PKT_LEN = "CAST(floor(value * 10) AS INT) + 40"

PACKETS = [
    ("packet_id", "event_id"),
    ("ts", "ts"),
    ("flow_key", "user_id"),
    ("protocol", _PROTOCOL),
    ("src_port", _SRC_PORT),
    ("dst_port", _DST_PORT),
    ("tcp_flags", "CAST(CASE WHEN event_id % 4 >= 2 THEN event_id % 256 ELSE NULL END AS INT)"),
    ("pkt_len", _PKT_LEN),
    ("src_ip", "concat(CASE WHEN event_id % 3 = 0 THEN '192.168.1.' ELSE '10.0.0.' END, CAST(user_id % 250 AS STRING))"),
    ("dst_ip", "concat(CASE WHEN event_id % 5 = 0 THEN '192.168.2.' ELSE '8.8.4.' END, CAST(event_id % 250 AS STRING))"),
    ("tcp_window", "CAST(CASE WHEN event_id % 4 >= 2 THEN (event_id * 37) % 65536 ELSE NULL END AS INT)"),
    ("payload", "concat(event_type, ' ', props)"),
]

_RAW_LABEL = (
    "CASE event_id % 12 WHEN 0 THEN 'Label' WHEN 1 THEN NULL WHEN 2 THEN 'DDoS attacks-LOIC-HTTP' "
    "WHEN 3 THEN 'DDOS attack-HOIC' WHEN 4 THEN 'DoS attacks-Hulk' WHEN 5 THEN 'FTP-BruteForce' "
    "WHEN 6 THEN 'SSH-Bruteforce' WHEN 7 THEN 'Infilteration' WHEN 8 THEN 'MysteryScan' "
    "WHEN 9 THEN 'SQL Injection' ELSE 'Benign' END"
)

ALERTS = [
    ("row_id", "event_id"),
    ("ts", "ts"),
    ("flow_key", "user_id"),
    ("source_file", "concat('day', CAST(user_id % 5 AS STRING), '.csv')"),
    ("raw_label", _RAW_LABEL),
    ("slm_label", "CASE event_id % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'DoS Hulk' ELSE NULL END"),
    ("slm_score", "CAST(event_id % 101 AS DOUBLE) / 100"),
    ("binary_score", "CAST((event_id * 7) % 103 AS DOUBLE) / 103"),
    ("class_id", "CAST((event_id * 5) % 13 AS INT)"),
    ("pred_class_id", "CAST(CASE WHEN event_id % 4 = 0 THEN (event_id * 7) % 13 ELSE (event_id * 5) % 13 END AS INT)"),
    ("protocol", _PROTOCOL),
    ("src_port", _SRC_PORT),
    ("dst_port", _DST_PORT),
    ("flow_byts_s", "value * 10"),
    ("flow_pkts_s", "value * 12"),
    ("flow_iat_mean", "CAST((event_id * 11) % 2000 AS DOUBLE)"),
    ("rst_flag_cnt", "event_id % 160"),
    ("syn_flag_cnt", "event_id % 7"),
    ("fwd_header_len", "CAST((event_id * 13) % 1500 AS DOUBLE)"),
    ("bwd_header_len", "CAST((event_id * 17) % 800 AS DOUBLE)"),
    ("tot_fwd_pkts", "event_id % 50 + 1"),
    ("tot_bwd_pkts", "event_id % 30"),
    ("fwd_pkt_len_mean", "CAST((event_id * 19) % 1500 AS DOUBLE)"),
    ("bwd_pkt_len_mean", "CAST((event_id * 23) % 1200 AS DOUBLE)"),
    ("pkt_len_min", f"CAST({_PKT_LEN} AS DOUBLE)"),
    ("pkt_len_max", f"CAST({_PKT_LEN} + event_id % 100 AS DOUBLE)"),
]

FLOWS = [
    ("ts", "l_shipdate"),
    ("source_file", "CAST(l_suppkey % 7 AS INT)"),
    ("flow_byts_s", "CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / l_tax END"),
    ("flow_pkts_s", "l_quantity * 40"),
    ("flow_iat_mean", "l_discount * 20000"),
    ("label", "l_returnflag"),
]

_SOURCES = {"packets": ("events", PACKETS), "alerts": ("events", ALERTS), "flows": ("lineitem", FLOWS)}


def _project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    src, cols = _SOURCES[name]
    return table(spark, sf_dir, src).selectExpr(*[f"{expr} AS {alias}" for alias, expr in cols])


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "packets")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "alerts")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "flows")


def cte(*names: str) -> str:
    """``WITH`` clause defining the named adapters for DuckDB oracle SQL."""
    parts = []
    for name in names:
        src, cols = _SOURCES[name]
        select = ",\n    ".join(f"{expr} AS {alias}" for alias, expr in cols)
        parts.append(f"{name} AS (\n  SELECT\n    {select}\n  FROM {src}\n)")
    return "WITH " + ",\n".join(parts)
