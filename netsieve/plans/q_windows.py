"""Queries: per-flow sliding buffers and the flow rollup.

With the test data's real gaps (150 keys over 30 days) a 60 s buffer holds
about one packet, so the registered queries use a one-day buffer and session
gap (86,400 s) to exercise multi-row frames; the 1000-packet cap and the 60 s
default are covered by pytest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.functions import detect as X
from netsieve.functions import domains as D
from netsieve.plans.sqlbase import round_half_up as rh
from netsieve.operators import windows as W
from netsieve.plans.registry import query
from netsieve.sources import adapters

WINDOW_S = 86400
CAP = 1000
GAP_S = 86400


def buffer_sql(ctes: str, source: str) -> str:
    """A packet's buffer holds the packets that arrived up to it (time, then id) within the window, at
    most ``CAP``: the RANGE frame without its later peers (equal time, larger id) or the ROWS frame,
    whichever is shorter. Its members are the ``n`` packets ranked just before it (inclusive), so the
    stats are a join on rank ranges. Moments are exact integers; gaps are to the key's previous packet
    (which may lie outside the buffer)."""
    var = "CAST(k * s2 - s1 * s1 AS DOUBLE) / CAST(k * k AS DOUBLE)"
    return ctes + f""",
p AS (SELECT packet_id, flow_key, ts, CAST(pkt_len AS HUGEINT) AS x,
        CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY flow_key ORDER BY ts, packet_id) AS HUGEINT) AS g,
        row_number() OVER (PARTITION BY flow_key ORDER BY ts, packet_id) AS rk FROM {source}),
c AS (SELECT packet_id, flow_key, rk,
        least(count(*) OVER (PARTITION BY flow_key ORDER BY ts RANGE BETWEEN INTERVAL {WINDOW_S} SECONDS PRECEDING
                             AND CURRENT ROW)
              - count(*) OVER (PARTITION BY flow_key, ts ORDER BY packet_id ROWS BETWEEN 1 FOLLOWING
                               AND UNBOUNDED FOLLOWING),
              count(*) OVER (PARTITION BY flow_key ORDER BY ts, packet_id ROWS BETWEEN {CAP - 1} PRECEDING
                             AND CURRENT ROW)) AS n FROM p),
b AS (SELECT a.packet_id, a.flow_key, a.n, count(m.x) AS k, sum(m.x) AS s1, sum(m.x * m.x) AS s2,
        count(m.g) AS gk, sum(m.g) AS g1, sum(m.g * m.g) AS g2, max(m.g) AS gmax, min(m.g) AS gmin
      FROM c a JOIN p m ON m.flow_key = a.flow_key AND m.rk BETWEEN a.rk - a.n + 1 AND a.rk
      GROUP BY a.packet_id, a.flow_key, a.n)
SELECT packet_id, flow_key, CAST(n AS BIGINT) AS n_buffer,
  round(CASE WHEN k > 0 THEN sqrt({var}) END, 6) AS pkt_len_std,
  round(CASE WHEN k > 0 THEN {var} END, 6) AS pkt_len_var,
  {rh("CASE WHEN gk > 0 THEN CAST(g1 AS DOUBLE) / CAST(gk AS DOUBLE) / 1000.0 ELSE 0.0 END", 6)} AS flow_iat_mean,
  {rh("CASE WHEN gk > 0 THEN sqrt(CAST(gk * g2 - g1 * g1 AS DOUBLE)) / CAST(gk AS DOUBLE) / 1000.0 ELSE 0.0 END", 4)}
    AS flow_iat_std,
  round(CASE WHEN gk > 0 THEN CAST(gmax AS DOUBLE) / 1000.0 ELSE 0.0 END, 3) AS flow_iat_max,
  round(CASE WHEN gk > 0 THEN CAST(gmin AS DOUBLE) / 1000.0 ELSE 0.0 END, 3) AS flow_iat_min FROM b"""


def _columns(names: str) -> str:
    return f"SELECT packet_id, flow_key, n_buffer, {names} FROM ({buffer_sql(adapters.cte('packets'), 'packets')})"


@query("win_pkt_len", sql=lambda: _columns("pkt_len_std, pkt_len_var"))
def q_win_pkt_len(spark, sf):
    """Packet-length std and variance over each packet's flow buffer (time window and packet cap)."""
    p = adapters.packets(spark, sf).select("packet_id", "flow_key", "ts", "pkt_len")
    s = W.buffer_stats(p, "pkt_len", window_seconds=WINDOW_S, cap=CAP, with_iat=False)
    return s.select("packet_id", "flow_key", "n_buffer", F.round("pkt_len_std", 6).alias("pkt_len_std"),
                    F.round("pkt_len_var", 6).alias("pkt_len_var"))


@query("win_iat", sql=lambda: _columns("flow_iat_mean, flow_iat_std, flow_iat_max, flow_iat_min"))
def q_win_iat(spark, sf):
    """Inter-arrival time (ms) mean / std / max / min over each packet's flow buffer; 0 when empty.

    Moments are exact integer sums of microseconds, so both engines hold the same doubles; the rounding
    avoids exact decimal ties (a mean of k gaps has k in its denominator): mean to 6 decimals of ms, std
    to 4, max / min to the microsecond.
    """
    p = adapters.packets(spark, sf).select("packet_id", "flow_key", "ts", "pkt_len")
    s = W.buffer_stats(p, "pkt_len", window_seconds=WINDOW_S, cap=CAP, with_iat=True)
    return s.select("packet_id", "flow_key", "n_buffer",
                    X.round_half_up("flow_iat_mean", 6).alias("flow_iat_mean"),
                    X.round_half_up("flow_iat_std", 4).alias("flow_iat_std"),
                    F.round("flow_iat_max", 3).alias("flow_iat_max"), F.round("flow_iat_min", 3).alias("flow_iat_min"))


def _rollup_sql() -> str:
    """Batch flow rows; inter-arrival mean / std are exact integer-microsecond moments (one division at the
    end), rounded half up by the same IEEE steps as the Spark side."""
    flags = ", ".join(f"CAST(sum(CAST(coalesce((tcp_flags & {m}) <> 0, false) AS INTEGER)) AS BIGINT) AS {n}"
                      for n, m in D.TCP_FLAG_MASKS)
    fl = "CASE WHEN src_ip = src0 THEN CAST(pkt_len AS DOUBLE) END"
    bl = "CASE WHEN src_ip IS DISTINCT FROM src0 THEN CAST(pkt_len AS DOUBLE) END"
    pl = "CAST(pkt_len AS DOUBLE)"
    secs = "((max(us) - min(us)) / 1000000.0)"
    r = lambda e: f"round({e}, 6)"
    g = "CAST(CASE WHEN st = 0 THEN us - prev END AS HUGEINT)"
    iat_mean = f"CAST(sum({g}) AS DOUBLE) / CAST(count({g}) AS DOUBLE) / 1000.0"
    iat_std = (f"CASE WHEN count({g}) > 0 THEN sqrt(CAST(count({g}) * sum({g} * {g}) - sum({g}) * sum({g}) AS DOUBLE))"
               f" / CAST(count({g}) AS DOUBLE) / 1000.0 END")
    return adapters.cte("packets") + f""",
p AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY flow_key ORDER BY ts, packet_id) AS prev
      FROM packets),
s AS (SELECT *, CASE WHEN prev IS NULL OR us - prev >= {GAP_S * 1_000_000} THEN 1 ELSE 0 END AS st FROM p),
s2 AS (SELECT *, sum(st) OVER (PARTITION BY flow_key ORDER BY ts, packet_id ROWS UNBOUNDED PRECEDING) AS sid FROM s),
s3 AS (SELECT *,
         first_value(src_ip) OVER (PARTITION BY flow_key, sid ORDER BY ts, packet_id) AS src0,
         first_value(protocol) OVER (PARTITION BY flow_key, sid ORDER BY ts, packet_id) AS protocol0,
         first_value(src_port) OVER (PARTITION BY flow_key, sid ORDER BY ts, packet_id) AS src_port0,
         first_value(dst_port) OVER (PARTITION BY flow_key, sid ORDER BY ts, packet_id) AS dst_port0,
         CASE WHEN st = 0 THEN (us - prev) / 1000.0 END AS iat FROM s2)
SELECT flow_key, min(ts) AS flow_start, max(ts) AS flow_end, max(us) - min(us) AS flow_duration,
  any_value(protocol0) AS protocol, any_value(src_port0) AS src_port, any_value(dst_port0) AS dst_port,
  count(*) AS n_packets, count(*) FILTER (WHERE src_ip = src0) AS tot_fwd_pkts,
  count(*) FILTER (WHERE src_ip IS DISTINCT FROM src0) AS tot_bwd_pkts,
  {r(f'sum({fl})')} AS totlen_fwd_pkts, {r(f'sum({bl})')} AS totlen_bwd_pkts,
  {r(f'max({fl})')} AS fwd_pkt_len_max, {r(f'min({fl})')} AS fwd_pkt_len_min, {r(f'avg({fl})')} AS fwd_pkt_len_mean,
  {r(f'stddev_pop({fl})')} AS fwd_pkt_len_std,
  {r(f'max({bl})')} AS bwd_pkt_len_max, {r(f'min({bl})')} AS bwd_pkt_len_min, {r(f'avg({bl})')} AS bwd_pkt_len_mean,
  {r(f'stddev_pop({bl})')} AS bwd_pkt_len_std,
  {r(f'sum({pl}) / nullif({secs}, 0)')} AS flow_byts_s, {r(f'count(*) / nullif({secs}, 0)')} AS flow_pkts_s,
  {r(f'(count(*) FILTER (WHERE src_ip = src0)) / nullif({secs}, 0)')} AS fwd_pkts_s,
  {r(f'(count(*) FILTER (WHERE src_ip IS DISTINCT FROM src0)) / nullif({secs}, 0)')} AS bwd_pkts_s,
  {r(f'min({pl})')} AS pkt_len_min, {r(f'max({pl})')} AS pkt_len_max, {r(f'avg({pl})')} AS pkt_len_mean,
  {r(f'stddev_pop({pl})')} AS pkt_len_std, {r(f'var_pop({pl})')} AS pkt_len_var,
  {rh(iat_mean, 6)} AS flow_iat_mean, {rh(iat_std, 6)} AS flow_iat_std, {r('max(iat)')} AS flow_iat_max,
  {r('min(iat)')} AS flow_iat_min, {flags}
FROM s3 GROUP BY flow_key, sid"""


@query("flow_rollup", sql=_rollup_sql)
def q_flow_rollup(spark, sf):
    """Packets -> flows (sessions of a key, split at gaps of a day): the flow-level metric row."""
    return W.flow_rollup(adapters.packets(spark, sf), gap_seconds=GAP_S)
