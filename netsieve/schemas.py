"""Declared schemas and the CSV-header <-> column-name rule."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# FIXED VALUES: the feature names of one packet row, in the order the scoring
# scripts build them (CSV header spelling).
PACKET_FEATURE_NAMES = [
    "Src Port", "Dst Port", "Protocol", "Flow Duration",
    "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
    "Fwd Pkt Len Max", "Fwd Pkt Len Min", "Fwd Pkt Len Mean", "Fwd Pkt Len Std",
    "Bwd Pkt Len Max", "Bwd Pkt Len Min", "Bwd Pkt Len Mean", "Bwd Pkt Len Std",
    "Flow Byts/s", "Flow Pkts/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Tot", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Tot", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Len", "Bwd Header Len", "Fwd Pkts/s", "Bwd Pkts/s",
    "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var",
    "FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt",
    "ACK Flag Cnt", "URG Flag Cnt", "CWE Flag Count", "ECE Flag Cnt",
    "Hour", "Minute", "Second", "Day_of_Week",
]

# FIXED VALUES: extra columns of the early packet form.
EARLY_EXTRA_NAMES = ["Down/Up Ratio", "Pkt Size Avg", "Init Fwd Win Byts", "Init Bwd Win Byts"]

# FIXED VALUES: the narrow packet form.
NARROW_FEATURE_NAMES = [
    "Protocol", "Src Port", "Dst Port", "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean",
    "Pkt Len Std", "Flow Duration", "Flow Byts/s", "Flow Pkts/s",
    "Hour", "Minute", "Second", "Day_of_Week",
]


def column_name(header: str) -> str:
    """CSV header -> physical column name: lower snake case (``Flow Byts/s`` -> ``flow_byts_s``)."""
    return re.sub(r"[^0-9a-z]+", "_", header.strip().lower()).strip("_")


PACKET_FEATURES = [column_name(h) for h in PACKET_FEATURE_NAMES]
NARROW_FEATURES = [column_name(h) for h in NARROW_FEATURE_NAMES]
EARLY_FEATURES = (
    ["protocol", "src_port", "dst_port", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts",
     "pkt_len_min", "pkt_len_max", "pkt_len_mean", "pkt_len_std", "pkt_len_var",
     "flow_duration", "flow_byts_s", "flow_pkts_s"]
    + [c for c in PACKET_FEATURES if c.endswith("_flag_cnt") or c == "cwe_flag_count"]
    + ["fwd_header_len", "bwd_header_len", "fwd_pkts_s", "bwd_pkts_s"]
    + [column_name(h) for h in EARLY_EXTRA_NAMES]
    + ["hour", "minute", "second", "day_of_week"]
)

PACKET = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("flow_key", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("tcp_window", T.IntegerType()),
    T.StructField("pkt_len", T.IntegerType()),
    T.StructField("payload", T.StringType()),
])

EXAMPLE = T.StructType([
    T.StructField("input", T.StructType([
        T.StructField("Protocol", T.IntegerType()),
        T.StructField("Src Port", T.IntegerType()),
        T.StructField("Dst Port", T.IntegerType()),
        T.StructField("Flow Rate", T.DoubleType()),
        T.StructField("Packet Rate", T.DoubleType()),
        T.StructField("IAT Mean", T.DoubleType()),
        T.StructField("Attack Type", T.StringType()),
    ])),
    T.StructField("output", T.StructType([
        T.StructField("threat", T.StringType()),
        T.StructField("mitigation", T.ArrayType(T.StringType())),
        T.StructField("impact", T.StringType()),
    ])),
])
