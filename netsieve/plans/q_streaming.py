"""Queries: streaming operators, each run over the given data as files arriving in four time chunks.

Every query writes its input (derived from the given tables) to a fresh
folder under the shared checkpoint folder, runs the stream with an
``availableNow`` trigger into a file sink, and returns the sink's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve import schemas
from netsieve.functions import alerts as A
from netsieve.functions import detect as X
from netsieve.functions import domains as D
from netsieve.operators import labels as L
from netsieve.plans import evaluation as E
from netsieve.plans.q_windows import _rollup_sql, buffer_sql
from netsieve.plans.registry import query
from netsieve.plans.sqlbase import SCORED, with_alerts
from netsieve.plans.sqlbase import round_half_up as rh
from netsieve.session import scratch_dir
from netsieve.sources import adapters
from netsieve.streaming import streams as ST

CHUNKS = 4
DAY_S = 86400
DAY = f"{DAY_S} seconds"
CAP = 1000

# Oracle side: the packets a stream of IP packets sees (the adapter rows, protocol known).
_IP_PACKETS = adapters.cte("packets") + """,
ip AS (SELECT * FROM packets WHERE coalesce(protocol, 0) <> 0)"""


def _land(df: DataFrame, folder: str, fmt: str = "parquet") -> Iterator[int]:
    """Write rows as ``CHUNKS`` time-ordered drops and yield after each one, for the stream to take it as one
    micro-batch: however many files a drop has, no batch holds packets older than the batch before."""
    lo_hi = df.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()[0]
    lo, hi = lo_hi["lo"], lo_hi["hi"]
    if lo is None:
        df.write.mode("append").format(fmt).save(folder)
        yield 0
        return
    step = (hi - lo) / CHUNKS
    for i in range(CHUNKS):
        a = lo + step * i
        cond = (F.col("ts") >= F.lit(a)) & ((F.col("ts") < F.lit(a + step)) if i < CHUNKS - 1 else F.lit(True))
        df.where(cond).write.mode("append").format(fmt).save(folder)
        yield i


def _read_back(spark, path: str, round6: tuple[str, ...] = ()) -> DataFrame:
    """Sink rows as the batch queries return them: event times as ``timestamp_ntz`` (the given tables'
    type; the session zone is UTC), named doubles rounded to 6 digits."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
                       else F.round(f.name, 6).alias(f.name) if f.name in round6 else F.col(f.name)
                       for f in df.schema.fields])


def packet_drops(spark, sf, tag: str) -> str:
    """A folder with the packets of the given tables as files, in drops."""
    src = scratch_dir(spark, f"{tag}-in")
    for _ in _land(_packets(spark, sf), src):
        pass
    return src


def _packets(spark, sf) -> DataFrame:
    p = adapters.packets(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return p.select(*[F.col(c).cast(t.dataType) for c, t in zip(ST.PACKET_COLUMNS, schemas.PACKET.fields)])


def _stream_packets(spark, sf, tag: str, plan: Callable[[DataFrame], DataFrame], only: str = "ip",
                    left: Callable[[SparkSession, str], DataFrame] | None = None) -> str:
    """Run ``plan`` over the packets arriving in drops, into a file sink; returns the sink's folder.

    ``left(spark, checkpoint)`` gives the rows that the stream still holds at the end; a closing pass writes them beside
    the sink's rows (the folder returned then has both).
    """
    src, out, ck = (scratch_dir(spark, f"{tag}-{part}") for part in ("in", "out", "ck"))
    for _ in _land(_packets(spark, sf), src):
        ST.run_to_files(plan(ST.packet_stream(spark, src, max_files=None, only=only)), out, ck)
    if left is None:
        return out
    whole = scratch_dir(spark, f"{tag}-whole")
    closed = spark.read.parquet(out)
    closed.unionByName(left(spark, ck)).write.parquet(whole)
    return whole


@query("packet_stream", sql=lambda: _IP_PACKETS + "\nSELECT " + ", ".join(ST.PACKET_COLUMNS) + " FROM ip")
def q_packet_stream(spark, sf):
    """IP packets read as a stream of file drops, written to a file sink."""
    out = _stream_packets(spark, sf, "packet", lambda p: p)
    return _read_back(spark, out)


@query("rule_stream", sql=lambda: adapters.cte("packets") + """
SELECT packet_id, ts, src_ip, dst_ip, dst_port,
  coalesce(protocol = 6 AND dst_port NOT IN (80, 443), false) AS suspicious_port,
  coalesce(protocol = 6 AND NOT contains(src_ip, '192.168.') AND NOT contains(dst_ip, '192.168.'), false) AS external
FROM packets WHERE protocol = 6""")
def q_rule_stream(spark, sf):
    """Suspicious-port and external-traffic flags on the live TCP stream."""
    out = _stream_packets(spark, sf, "rules", ST.rules, only="tcp")
    return _read_back(spark, out)


@query("win_stream", sql=lambda: buffer_sql(_IP_PACKETS, "ip"))
def q_win_stream(spark, sf):
    """Per-flow bounded buffer (one day, 1000 packets) kept as streaming state: packet-length and
    inter-arrival (ms) stats, rounded as ``win_pkt_len`` / ``win_iat``."""
    out = _stream_packets(spark, sf, "win", lambda p: ST.buffer_state(p, window_seconds=DAY_S, cap=CAP, watermark=DAY))
    df = _read_back(spark, out, round6=("pkt_len_std", "pkt_len_var"))
    half_up = {"flow_iat_mean": 6, "flow_iat_std": 4}
    return df.select(*[X.round_half_up(c, half_up[c]).alias(c) if c in half_up
                       else F.round(c, 3).alias(c) if c in ("flow_iat_max", "flow_iat_min") else F.col(c)
                       for c in df.columns])


def _sessions_stream_sql() -> str:
    """All sessions split at gaps of a day: those that the watermark closed and those open at the end."""
    flags = ", ".join(f"CAST(sum(CAST(coalesce((tcp_flags & {m}) <> 0, false) AS INTEGER)) AS BIGINT) AS {n}"
                      for n, m in D.TCP_FLAG_MASKS)
    secs = "((max(us) - min(us)) / 1000000.0)"
    return _IP_PACKETS + f""",
p AS (SELECT *, epoch_us(ts) AS us,
        epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY flow_key ORDER BY ts, packet_id) AS gap FROM ip),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {DAY_S * 1_000_000} THEN 1 ELSE 0 END)
                  OVER (PARTITION BY flow_key ORDER BY ts, packet_id ROWS UNBOUNDED PRECEDING) AS sid FROM p),
g AS (SELECT flow_key, min(ts) AS flow_start, max(ts) + INTERVAL {DAY_S} SECONDS AS flow_end,
        max(us) - min(us) AS flow_duration, count(*) AS n_packets, CAST(sum(pkt_len) AS BIGINT) AS total_bytes,
        min(pkt_len) AS pkt_len_min, max(pkt_len) AS pkt_len_max,
        round(avg(CAST(pkt_len AS DOUBLE)), 6) AS pkt_len_mean, round(stddev_pop(CAST(pkt_len AS DOUBLE)), 6) AS pkt_len_std,
        round(var_pop(CAST(pkt_len AS DOUBLE)), 6) AS pkt_len_var,
        round(CAST(sum(pkt_len) AS DOUBLE) / nullif({secs}, 0), 6) AS flow_byts_s,
        round(CAST(count(*) AS DOUBLE) / nullif({secs}, 0), 6) AS flow_pkts_s,
        {rh("CASE WHEN count(*) > 1 THEN CAST(max(us) - min(us) AS DOUBLE) / CAST(count(*) - 1 AS DOUBLE) / 1000.0 END",
            6)} AS flow_iat_mean,
        {flags}
      FROM s GROUP BY flow_key, sid)
SELECT * FROM g"""


@query("flow_rollup_stream", sql=_sessions_stream_sql)
def q_flow_rollup_stream(spark, sf):
    """Session windows (gap one day) with a one-day watermark: closed flows are appended, those open at the end are
    read from the state."""
    out = _stream_packets(spark, sf, "flows", lambda p: ST.session_rollup(p, gap=DAY, watermark=DAY), left=ST.open_sessions)
    df = _read_back(spark, out, round6=("pkt_len_mean", "pkt_len_std", "pkt_len_var", "flow_byts_s", "flow_pkts_s"))
    return df.withColumn("flow_iat_mean", X.round_half_up("flow_iat_mean", 6))


@query("flow_rollup_state", sql=_rollup_sql)
def q_flow_rollup_state(spark, sf):
    """The full flow row (forward / backward, rates, inter-arrival, flags) kept as streaming state: appended once a later
    packet or the watermark closes a flow, read from the state for those open at the end. All flows of ``flow_rollup``."""
    out = _stream_packets(spark, sf, "flowstate", lambda p: ST.flow_state(p, gap_seconds=DAY_S, watermark=DAY),
                          left=ST.open_flows)
    return _read_back(spark, out)


@query("alert_stream", sql=lambda: with_alerts(SCORED) + f"""
SELECT row_id, ts, label, binary_pred, attack_label, slm_label, slm_score, {A.sql_alert_fallback()} AS notification
FROM scored WHERE is_malicious""")
def q_alert_stream(spark, sf):
    """The live chain on arriving alert inputs: clean, standardize, score, trigger, alert text; appended per batch."""
    a = adapters.alerts(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    src = scratch_dir(spark, "alerts-in")
    spark.createDataFrame([], a.schema).write.parquet(src)  # the folder must be there before the first drop
    stream = spark.readStream.schema(a.schema).parquet(src)
    s = L.known_labels(L.standardize_label(L.clean_labels(stream, "raw_label"), "raw_label", out="label"), "label")
    s = E.score(s).where("is_malicious")
    s = s.select("row_id", "ts", "label", "binary_pred", "attack_label", "slm_label", "slm_score",
                 A.alert_fallback().alias("notification"))
    out, ck = scratch_dir(spark, "alerts-out"), scratch_dir(spark, "alerts-ck")
    for _ in _land(a, src):
        ST.run_foreach_batch(s, ST.idempotent_batch_writer(out), ck)
    return _read_back(spark, out).drop("batch_id")


@query("reject_stream", sql=lambda: adapters.cte("packets") + """
SELECT packet_id, 'not-a-time' AS rejected_ts FROM packets WHERE packet_id % 97 = 0""")
def q_reject_stream(spark, sf):
    """JSON packet lines, some with an unparsable time: bad rows go to a reject table, the stream goes on."""
    p = adapters.packets(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    ts_text = F.when(F.col("packet_id") % 97 == 0, F.lit("not-a-time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    lines = p.select("ts", F.to_json(F.struct(*[ts_text.alias("ts") if c == "ts" else F.col(c)
                                                 for c in ST.PACKET_COLUMNS])).alias("value"))
    src = scratch_dir(spark, "json-in")
    lines.select("value").write.mode("overwrite").text(src)
    schema = T.StructType(schemas.PACKET.fields + [T.StructField("_corrupt_record", T.StringType())])
    stream = (spark.readStream.schema(schema).option("mode", "PERMISSIVE")
                   .option("columnNameOfCorruptRecord", "_corrupt_record")
                   .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(src))
    good, bad, ck = scratch_dir(spark, "good"), scratch_dir(spark, "reject"), scratch_dir(spark, "reject-ck")
    valid = lambda b: F.col("_corrupt_record").isNull() & F.col("ts").isNotNull()
    ST.run_foreach_batch(stream, ST.split_rejects(good, bad, valid), ck)
    # the reject table keeps the whole raw line; the query reports each rejected packet and its bad field
    return spark.read.parquet(bad).select("packet_id", F.get_json_object("_corrupt_record", "$.ts").alias("rejected_ts"))
