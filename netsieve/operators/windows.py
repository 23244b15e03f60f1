"""Per-flow sliding buffers and flow sessions, linear in the packets whatever one flow key holds.

A flow key may hold a third of all packets, in any density, so nothing here
partitions by the key or by time. Packets are shuffled once into range
partitions of the order (key, time, id) and passed over in that order
(``ordered``): a buffer is a window search and differences of prefix sums, its
extremes come from a sparse table, and a session starts where the gap to the
packet before reaches the limit. What crosses the edge of a partition is
bounded: the buffer cap in rows, or one row for a session left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsieve.functions import detect as X
from netsieve.functions import domains as D
from netsieve.operators import ordered as O


def buffer_stats(df: DataFrame, value: str, key: str = "flow_key", ts: str = "ts", order_id: str = "packet_id",
                 window_seconds: int = 60, cap: int = 1000, with_iat: bool = True,
                 partitions: int | None = None) -> DataFrame:
    """Per packet: size of its buffer, population std/var of ``value`` and inter-arrival (ms) stats.

    The buffer of a packet is the packets of its key at most ``window_seconds``
    older (inclusive), at most ``cap`` of them, itself included; of packets with its own time only those
    with a smaller ``order_id`` count. ``value`` is an integer column. Inter-arrival
    time is the gap to the previous packet of the key, in milliseconds; its
    stats are 0 when the buffer holds no gap. Moments are exact integers, so results
    do not depend on partitioning; values and gaps (in microseconds) of 2^52 or more count as missing. A packet
    without a time is alone in its buffer.
    """
    m = O.buffer_moments(df, F.col(value), key, ts, order_id, int(window_seconds * 1_000_000), cap, partitions)

    def spread_of(k: Column, s1: Column, s2: Column) -> Column:
        """``k * s2 - s1 * s1``: the variance times k squared, exact."""
        return (k.cast("decimal(38,0)") * s2 - s1.cast("decimal(38,0)") * s1.cast("decimal(38,0)")).cast("double")

    k, s1, s2 = O.moment_columns("_x")
    var = F.try_divide(spread_of(k, s1, s2), (k * k).cast("double"))
    out = [F.col("_n").alias("n_buffer"), F.sqrt(var).alias("pkt_len_std"), var.alias("pkt_len_var")]
    if with_iat:
        k, s1, s2 = O.moment_columns("_g")
        mean_us = F.try_divide(s1.cast("double"), k.cast("double"))
        std_us = F.try_divide(F.sqrt(spread_of(k, s1, s2)), k.cast("double"))
        ms = lambda c: F.coalesce(c.cast("double") / F.lit(1000.0), F.lit(0.0))
        out += [ms(mean_us).alias("flow_iat_mean"), ms(std_us).alias("flow_iat_std"),
                ms(F.when(k > 0, F.col("_g_max"))).alias("flow_iat_max"),
                ms(F.when(k > 0, F.col("_g_min"))).alias("flow_iat_min")]
    return m.select(*df.columns, *out)


def sessionize(df: DataFrame, key: str = "flow_key", ts: str = "ts", order_id: str = "packet_id", gap_seconds: int = 60,
               first_cols: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Add ``_us`` (epoch micros), ``_session_us`` (start of the packet's flow), ``_first_<c>`` (column ``c`` of the flow's
    first packet), ``_iat_us`` and ``_iat_ms`` (gap to the previous packet in the flow, null for the first).

    A new flow starts when the gap to the previous packet of the key is at least ``gap_seconds``.
    """
    s = O.sessions(df, key, ts, order_id, int(gap_seconds * 1_000_000), first_cols, partitions)
    return s.withColumn("_iat_ms", F.col("_iat_us") / F.lit(1000.0))


def flow_rollup(packets: DataFrame, gap_seconds: int = 60, key: str = "flow_key",
                partitions: int | None = None) -> DataFrame:
    """One row per flow (session of a key): duration, forward/backward counts and bytes, rates,
    length and inter-arrival stats, TCP flag counts.

    Forward = sent from the source address of the flow's first packet. One
    partial-aggregated ``groupBy`` per flow after ``sessionize``, so a long flow of
    a hot key is combined map-side before its shuffle. Two exchanges in all: the
    range shuffle of the packets and that of the partial flows.
    """
    s = sessionize(packets, key=key, gap_seconds=gap_seconds, first_cols=("src_ip", "protocol", "src_port", "dst_port"),
                   partitions=partitions)
    s = s.select("*", *X.tcp_flag_columns("tcp_flags"))
    fwd = F.col("src_ip").eqNullSafe(F.col("_first_src_ip"))
    pl = F.col("pkt_len").cast("double")
    fl, bl = F.when(fwd, pl), F.when(~fwd, pl)
    g = s.groupBy(key, "_session_us").agg(
        F.min("ts").alias("flow_start"), F.max("ts").alias("flow_end"), F.max("_us").alias("_end_us"),
        F.first("_first_protocol").alias("protocol"), F.first("_first_src_port").alias("src_port"),
        F.first("_first_dst_port").alias("dst_port"),
        F.count(F.lit(1)).alias("n_packets"),
        F.count_if(fwd).alias("tot_fwd_pkts"), F.count_if(~fwd).alias("tot_bwd_pkts"),
        F.sum(fl).alias("totlen_fwd_pkts"), F.sum(bl).alias("totlen_bwd_pkts"),
        F.max(fl).alias("fwd_pkt_len_max"), F.min(fl).alias("fwd_pkt_len_min"), F.avg(fl).alias("fwd_pkt_len_mean"),
        F.stddev_pop(fl).alias("fwd_pkt_len_std"),
        F.max(bl).alias("bwd_pkt_len_max"), F.min(bl).alias("bwd_pkt_len_min"), F.avg(bl).alias("bwd_pkt_len_mean"),
        F.stddev_pop(bl).alias("bwd_pkt_len_std"),
        F.min(pl).alias("pkt_len_min"), F.max(pl).alias("pkt_len_max"), F.avg(pl).alias("pkt_len_mean"),
        F.stddev_pop(pl).alias("pkt_len_std"), F.var_pop(pl).alias("pkt_len_var"), F.sum(pl).alias("_bytes"),
        F.count("_iat_us").alias("_gk"), F.sum("_iat_us").alias("_g1"),
        F.sum(F.col("_iat_us").cast("decimal(38,0)") * F.col("_iat_us").cast("decimal(38,0)")).alias("_g2"),
        F.max("_iat_ms").alias("flow_iat_max"), F.min("_iat_ms").alias("flow_iat_min"),
        *[F.sum(n).cast("long").alias(n) for n, _ in D.TCP_FLAG_MASKS],
    )
    dur_us = F.col("_end_us") - F.col("_session_us")
    secs = dur_us / F.lit(1_000_000.0)
    rate = lambda c: F.try_divide(F.col(c).cast("double"), secs)
    g = g.select(
        key, "flow_start", "flow_end", dur_us.alias("flow_duration"), "protocol", "src_port", "dst_port", "n_packets",
        "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts",
        "fwd_pkt_len_max", "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_std",
        "bwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_mean", "bwd_pkt_len_std",
        rate("_bytes").alias("flow_byts_s"), rate("n_packets").alias("flow_pkts_s"),
        rate("tot_fwd_pkts").alias("fwd_pkts_s"), rate("tot_bwd_pkts").alias("bwd_pkts_s"),
        "pkt_len_min", "pkt_len_max", "pkt_len_mean", "pkt_len_std", "pkt_len_var",
        (F.try_divide(F.col("_g1").cast("double"), F.col("_gk").cast("double")) / F.lit(1000.0)).alias("flow_iat_mean"),
        F.when(F.col("_gk") > 0, F.sqrt((F.col("_gk").cast("decimal(38,0)") * F.col("_g2")
                                         - F.col("_g1").cast("decimal(38,0)") * F.col("_g1")).cast("double"))
               / F.col("_gk").cast("double") / F.lit(1000.0)).alias("flow_iat_std"),
        "flow_iat_max", "flow_iat_min",
        *[n for n, _ in D.TCP_FLAG_MASKS])
    # inter-arrival moments are exact integers, rounded half up by fixed IEEE steps; the rest to 6 digits
    exact = {"flow_iat_mean", "flow_iat_std"}
    frac = {f.name for f in g.schema.fields if f.dataType.simpleString() == "double"} - exact
    return g.select(*[F.round(c, 6).alias(c) if c in frac else X.round_half_up(c, 6).alias(c) if c in exact
                      else F.col(c) for c in g.columns])
