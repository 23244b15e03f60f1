"""Structured Streaming: packet sources, the live detection chain, per-flow state, sessions, rejects.

Stateless steps are the very functions the batch queries use. The two
stateful operators are:

* ``buffer_state`` — the bounded per-flow buffer (last ``window`` seconds by
  event time, at most ``cap`` packets) kept in ``applyInPandasWithState``
  state; window functions are not allowed on streams. State per key is
  bounded by ``cap`` and expires by event-time timeout.
* ``session_rollup`` — ``session_window`` aggregation with a watermark: a flow
  is emitted (append mode) once the watermark passes its end; later rows are
  dropped.

Sinks are files with checkpoints in the shared checkpoint folder, so a
restarted query resumes exactly; ``foreachBatch`` writers overwrite their
batch's own folder, which makes a replayed batch idempotent.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netsieve import schemas
from netsieve.functions import detect as X
from netsieve.functions import domains as D

# The stateful per-flow function runs in Python workers: ship this module's code with the query
# (pickled by value), so executors need the package neither installed nor on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACKET_COLUMNS = [f.name for f in schemas.PACKET.fields]


def packet_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = 1000,
                  only: str = "ip") -> DataFrame:
    """Decoded packet rows arriving as files, at most ``max_files`` a micro-batch (None: all there are);
    ``only`` = ``ip`` (protocol known) or ``tcp``."""
    reader = spark.readStream.schema(schemas.PACKET)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.format(fmt).load(path)
    if only == "tcp":
        return df.where(F.col("protocol") == 6)
    return df.where(F.coalesce(F.col("protocol"), F.lit(0)) != 0)


def rules(df: DataFrame) -> DataFrame:
    """Port and external-traffic rules on TCP packets (same expressions as batch)."""
    return df.select("packet_id", "ts", "src_ip", "dst_ip", "dst_port",
                     X.rule_port("protocol", "dst_port").alias("suspicious_port"),
                     X.rule_external("protocol", "src_ip", "dst_ip").alias("external"))


def run_to_files(df: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Run a stream over everything available now into a file sink, then stop."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(out))
    q.awaitTermination()


def run_foreach_batch(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = (df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())
    q.awaitTermination()


def idempotent_batch_writer(out: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler: each batch overwrites its own ``batch_id=<n>`` folder (safe to replay)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{out}/batch_id={batch_id}")
    return handle


def split_rejects(good_out: str, reject_out: str, valid: Callable[[DataFrame], F.Column]):
    """``foreachBatch`` handler sending rows that fail ``valid`` to a reject table; the stream goes on."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        ok = valid(batch)
        batch.where(ok).write.mode("overwrite").parquet(f"{good_out}/batch_id={batch_id}")
        batch.where(~ok).write.mode("overwrite").parquet(f"{reject_out}/batch_id={batch_id}")
    return handle


BUFFER_OUT = T.StructType([
    T.StructField("packet_id", T.LongType()), T.StructField("flow_key", T.LongType()),
    T.StructField("n_buffer", T.LongType()), T.StructField("pkt_len_std", T.DoubleType()),
    T.StructField("pkt_len_var", T.DoubleType()),
    T.StructField("flow_iat_mean", T.DoubleType()), T.StructField("flow_iat_std", T.DoubleType()),
    T.StructField("flow_iat_max", T.DoubleType()), T.StructField("flow_iat_min", T.DoubleType()),
])
# Buffered packets as the bytes of four rows of 64-bit integers: time, length (-1 = null), gap to the key's previous packet in
# microseconds and whether it has one (the key's first packet has none; the previous packet may have left the buffer).
BUFFER_STATE = T.StructType([T.StructField("packets", T.BinaryType())])


def _window_extreme(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, fn, max_width: int) -> np.ndarray:
    """``fn`` (np.maximum / np.minimum) of ``v[lo[i]:hi[i]]`` for every i — a sparse table (levels up to
    ``max_width``, the buffer cap), no row loop."""
    levels = [v]
    while (1 << len(levels)) <= min(len(v), max_width):
        prev, h = levels[-1], 1 << (len(levels) - 1)
        levels.append(fn(prev[:-h], prev[h:]))
    width = hi - lo
    lvl = np.floor(np.log2(np.maximum(width, 1))).astype(np.int64)
    out = np.empty(len(lo), dtype=v.dtype)
    for k in np.unique(lvl):
        m = lvl == k
        t = levels[k]
        out[m] = fn(t[lo[m]], t[hi[m] - (1 << k)])
    return out


def _buffer_starts(ts: np.ndarray, first: int, window_us: int, cap: int) -> np.ndarray:
    """Index of the oldest buffered packet for each packet ``j >= first`` of ``ts`` (arrival order).

    A packet enters at the back; packets older than ``window_us`` leave from the
    front, then the oldest leave until at most ``cap`` remain. The front only
    moves forward, so when times arrive in order the bound is one
    ``searchsorted``; a late packet (older than one already buffered) falls
    back to the step-by-step rule.
    """
    idx = np.arange(first, len(ts))
    if len(ts) < 2 or bool(np.all(ts[1:] >= ts[:-1])):
        lo = np.searchsorted(ts, ts[first:] - window_us, side="left")
        return np.maximum(lo, idx - cap + 1)
    out, lo = np.empty(len(idx), dtype=np.int64), 0
    for k, j in enumerate(idx):
        while lo < j and ts[lo] < ts[j] - window_us:
            lo += 1
        lo = max(lo, j - cap + 1)
        out[k] = lo
    return out


def _expire_after(state: GroupState, last_us: int, wait_us: int) -> None:
    """Time out once the watermark is ``wait_us`` past the last time held; a late packet counts from the
    watermark, since a timeout must lie after it."""
    state.setTimeoutTimestamp(max(last_us // 1000, state.getCurrentWatermarkMs()) + wait_us // 1000 + 1)


def _buffered(state: GroupState) -> np.ndarray:
    return np.frombuffer(state.get[0], np.int64).reshape(4, -1)


def _buffer_fn(window_us: int, cap: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the buffer is over; its last packet stays for the gap of the key's next one
            state.update((_buffered(state)[:, -1:].tobytes(),))
            return
        frames = [p for p in pdfs]
        if not frames:
            return
        pdf = pd.concat(frames) if len(frames) > 1 else frames[0]
        packet, new_ts, new_len = pdf["packet_id"].to_numpy(np.int64), pdf["ts_us"].to_numpy(np.int64), pdf["pkt_len"].to_numpy(np.float64)
        order = np.lexsort((packet, new_ts))
        packet, new_ts, new_len = packet[order], new_ts[order], new_len[order]
        old_ts, old_len, old_iat, old_has = _buffered(state) if state.exists else np.empty((4, 0), np.int64)
        ts = np.concatenate([old_ts, new_ts])
        new_seen = ~np.isnan(new_len)
        lens = np.concatenate([np.maximum(old_len, 0), np.where(new_seen, new_len, 0).astype(np.int64)])
        seen = np.concatenate([old_len >= 0, new_seen])  # a null length is kept as -1
        first = len(old_ts)
        # gap to the previous packet of the key (the state always holds the last one)
        gaps = np.diff(ts)[max(first - 1, 0):] if len(ts) > 1 else np.empty(0, np.int64)
        new_has = np.ones(len(ts) - first, dtype=bool)
        if first == 0:
            new_has[0] = False
            gaps = np.concatenate([[0], gaps])
        iat = np.concatenate([old_iat, gaps.astype(np.int64)])
        has = np.concatenate([old_has.astype(bool), new_has])
        lo = _buffer_starts(ts, first, window_us, cap)
        hi = np.arange(first, len(ts)) + 1
        n = hi - lo
        # exact integer moments of the non-null lengths in each buffer: (k * sum(x^2) - sum(x)^2) / k^2
        k0 = np.concatenate([[0], np.cumsum(seen)])
        s1 = np.concatenate([[0], np.cumsum(lens)])
        s2 = np.concatenate([[0], np.cumsum(lens * lens)])
        k, a, b = k0[hi] - k0[lo], s1[hi] - s1[lo], s2[hi] - s2[lo]
        with np.errstate(invalid="ignore", divide="ignore"):
            var = np.where(k > 0, (k * b - a * a).astype(np.float64) / (k * k).astype(np.float64), np.nan)
        # inter-arrival moments in exact integers (squared microseconds exceed 64 bits: Python ints)
        g = np.where(has, iat, 0).astype(object)
        c0 = np.concatenate([[0], np.cumsum(has)])
        g1 = np.concatenate([[0], np.cumsum(g)]).astype(object)
        g2 = np.concatenate([[0], np.cumsum(g * g)]).astype(object)
        gk, ga, gb = c0[hi] - c0[lo], g1[hi] - g1[lo], g2[hi] - g2[lo]
        gkf, gko = gk.astype(np.float64), gk.astype(object)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(gk > 0, ga.astype(np.float64) / gkf / 1000.0, 0.0)
            std = np.where(gk > 0, np.sqrt((gko * gb - ga * ga).astype(np.float64)) / gkf / 1000.0, 0.0)
        big = np.iinfo(np.int64)
        gmax = _window_extreme(np.where(has, iat, big.min), lo, hi, np.maximum, cap)
        gmin = _window_extreme(np.where(has, iat, big.max), lo, hi, np.minimum, cap)
        gmax = np.where(gk > 0, gmax.astype(np.float64) / 1000.0, 0.0)
        gmin = np.where(gk > 0, gmin.astype(np.float64) / 1000.0, 0.0)
        lens = np.where(seen, lens, -1)
        keep = int(lo[-1])
        state.update((np.stack([ts, lens, iat, has])[:, keep:].tobytes(),))
        _expire_after(state, int(ts.max()), window_us)
        yield pd.DataFrame({"packet_id": packet,
                            "flow_key": np.full(len(n), int(key[0]), dtype=np.int64), "n_buffer": n.astype(np.int64),
                            "pkt_len_std": np.sqrt(var), "pkt_len_var": var, "flow_iat_mean": mean,
                            "flow_iat_std": std, "flow_iat_max": gmax, "flow_iat_min": gmin})
    return fn


def buffer_state(packets: DataFrame, window_seconds: int = 60, cap: int = 1000,
                 watermark: str = "60 seconds") -> DataFrame:
    """Streaming twin of ``windows.buffer_stats`` (packet length and inter-arrival stats, per flow key state).

    Rows of one micro-batch are applied in event-time order (one sort and
    vectorized bounds per key and batch, integer moments, no per-row Python
    objects); the state keeps at most ``cap`` entries and shrinks to the last packet once the
    watermark passes it by the window, so results do not depend on when batches end. A flow key is one state,
    so its packets are applied by one task per micro-batch: the work per batch
    is linear in its packets and the state never exceeds ``cap`` entries.
    """
    p = (packets.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
                .select("packet_id", "flow_key", "ts", F.unix_micros("ts").alias("ts_us"), "pkt_len"))
    return p.groupBy("flow_key").applyInPandasWithState(
        _buffer_fn(int(window_seconds * 1_000_000), cap), outputStructType=BUFFER_OUT,
        stateStructType=BUFFER_STATE, outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)


_FLAGS = [n for n, _ in D.TCP_FLAG_MASKS]
# What the state of a session holds, in the order of its aggregates (the decimal sum has a second field).
_SESSION_STATE = ("flow_key long, session struct<start: timestamp, end: timestamp>, n long, k long, s1 long, s2 decimal(38,0), "
                  "s2_empty boolean, len_min int, len_max int, first_us long, last_us long, "
                  + ", ".join(f"{f} long" for f in _FLAGS))


def session_rollup(packets: DataFrame, gap: str = "60 seconds", watermark: str = "60 seconds") -> DataFrame:
    """Per-flow sessions over a stream (append mode: emitted when the watermark passes the session end).

    The flow-level metrics that are plain aggregates: packets, bytes, length
    stats, duration, rates, TCP flag counts, and the mean inter-arrival time
    (the gaps of a session telescope to (last - first) / (n - 1)). Sessions still open when the stream stops are in its
    state: ``open_sessions``.
    """
    p = packets.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    x = F.col("pkt_len").cast("decimal(10,0)")
    p = p.select("flow_key", "ts", "pkt_len", (x * x).cast("decimal(28,0)").alias("_sq"), F.unix_micros("ts").alias("_us"),
                 *X.tcp_flag_columns("tcp_flags"))
    g = p.groupBy("flow_key", F.session_window("ts", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("n"), F.count("pkt_len").alias("k"), F.sum("pkt_len").alias("s1"), F.sum("_sq").alias("s2"),
        F.min("pkt_len").alias("len_min"), F.max("pkt_len").alias("len_max"), F.min("_us").alias("first_us"),
        F.max("_us").alias("last_us"), *[F.sum(f).cast("long").alias(f) for f in _FLAGS])
    return _session_rows(g)


def _session_rows(g: DataFrame) -> DataFrame:
    """The metric row of each session from its sums."""
    dur = F.col("last_us") - F.col("first_us")
    secs = dur / F.lit(1_000_000.0)
    k, s1 = F.col("k"), F.col("s1").cast("decimal(38,0)")
    spread = (k.cast("decimal(38,0)") * F.col("s2") - s1 * s1).cast("double")
    iat = F.when(F.col("n") > 1, dur.cast("double") / (F.col("n") - 1).cast("double") / F.lit(1000.0))
    return g.select("flow_key", F.col("session.start").alias("flow_start"), F.col("session.end").alias("flow_end"),
                    dur.alias("flow_duration"), F.col("n").alias("n_packets"), F.col("s1").alias("total_bytes"),
                    F.col("len_min").alias("pkt_len_min"), F.col("len_max").alias("pkt_len_max"),
                    F.try_divide(F.col("s1").cast("double"), k.cast("double")).alias("pkt_len_mean"),
                    F.try_divide(F.sqrt(spread), k.cast("double")).alias("pkt_len_std"),
                    F.try_divide(spread, (k * k).cast("double")).alias("pkt_len_var"),
                    F.try_divide(F.col("s1").cast("double"), secs).alias("flow_byts_s"),
                    F.try_divide(F.col("n").cast("double"), secs).alias("flow_pkts_s"),
                    iat.alias("flow_iat_mean"), *_FLAGS)


def _state(spark: SparkSession, checkpoint: str, schema: str) -> DataFrame:
    """The state that a stopped stream's last batch left behind, one row per key, named by ``schema``.

    A distributed read of the state store (one task per state partition); the stream can go on from the same
    checkpoint afterwards.
    """
    value = spark.read.format("statestore").load(checkpoint).select("value")
    return value.select(F.col("value").cast(f"struct<{schema}>").alias("v")).select("v.*")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that a stopped ``session_rollup`` stream has not emitted, as the rows it would emit now."""
    return _session_rows(_state(spark, checkpoint, _SESSION_STATE))


# ---------------------------------------------------------------- full flow rows as streaming state

# Running aggregates of a key's open flow: bounded state however long the flow runs. Length and gap
# square sums are exact integers (gaps reach 8.6e10 µs, so their squares need decimals).
_FLOW_STATE = ([("first_us", T.LongType()), ("last_us", T.LongType()), ("src0", T.StringType()),
                ("proto0", T.IntegerType()), ("sport0", T.IntegerType()), ("dport0", T.IntegerType()),
                ("n", T.LongType()), ("fc", T.LongType()), ("bc", T.LongType()), ("fk", T.LongType()),
                ("bk", T.LongType()), ("fs", T.LongType()), ("bs", T.LongType()), ("fq", T.DecimalType(38, 0)),
                ("bq", T.DecimalType(38, 0)), ("fmax", T.LongType()), ("fmin", T.LongType()), ("bmax", T.LongType()),
                ("bmin", T.LongType()), ("gn", T.LongType()), ("g1", T.LongType()), ("g2", T.DecimalType(38, 0)),
                ("gmax", T.LongType()), ("gmin", T.LongType())]
               + [(f, T.LongType()) for f in _FLAGS])
FLOW_STATE = T.StructType([T.StructField(n, t) for n, t in _FLOW_STATE])
# The state function's output: a flow's numbers as one CSV text. A frame's cost per key lies in its columns, not in its few rows.
_FLOW_NUMBERS = [n for n, t in _FLOW_STATE if not isinstance(t, T.StringType)]
FLOW_OUT = T.StructType([T.StructField("flow", T.StringType())])
_FLOW_CSV = ", ".join(["flow_key long"] + [f"{n} {t.simpleString()}" for n, t in _FLOW_STATE if n in _FLOW_NUMBERS])
# A packet's numbers as one array, for the same reason; nulls are 0 with their bit set in the first one.
_PACKET_NUMBERS = ["pkt_len", "protocol", "src_port", "dst_port"]


def _opt(fn, a, b):
    return a if b is None else b if a is None else fn(a, b)


def _iv(x):
    """An integer field from pandas (nullable ints arrive as floats with NaN) -> int or None."""
    return None if x is None or (isinstance(x, float) and np.isnan(x)) else int(x)


_DECIMALS = {n for n, t in _FLOW_STATE if isinstance(t, T.DecimalType)}


def _out(acc: dict, names: list[str]) -> list:
    from decimal import Decimal

    return [Decimal(int(acc[n])) if n in _DECIMALS else acc[n] for n in names]


def _segment(ts, lens, src, proto, sport, dport, flags, gaps, has_gap, head: dict) -> dict:
    """Aggregates of packets continuing the open flow ``head`` (numpy slices); merged with ``_merge``."""
    missing = pd.isna(src)
    if head["src0"] is None:  # null-safe equality of addresses, vectorized
        fwd = np.asarray(missing, dtype=bool)
    else:
        fwd = np.asarray((src == head["src0"]) & ~missing, dtype=bool)
    ok = ~np.isnan(lens)
    li = np.where(ok, lens, 0).astype(np.int64)
    acc = dict(head, last_us=int(ts[-1]), n=len(ts), fc=int(fwd.sum()), bc=int((~fwd).sum()))
    for side, m in (("f", fwd & ok), ("b", ~fwd & ok)):
        v = li[m]
        acc.update({f"{side}k": int(m.sum()), f"{side}s": int(v.sum()), f"{side}q": int((v * v).sum()),
                    f"{side}max": int(v.max()) if len(v) else None, f"{side}min": int(v.min()) if len(v) else None})
    g = gaps[has_gap]
    acc.update(gn=len(g), g1=int(g.sum()), g2=int(np.sum(g.astype(object) ** 2)) if len(g) else 0,
               gmax=int(g.max()) if len(g) else None, gmin=int(g.min()) if len(g) else None)
    for i, f in enumerate(_FLAGS):
        acc[f] = int(flags[:, i].sum())
    return acc


def _segments(ts, lens, src, proto, sport, dport, flags, gaps, has_gap, lo: np.ndarray) -> list[dict]:
    """Aggregates of the consecutive runs (flows) starting at rows ``lo`` (ascending, first 0) — one
    ``reduceat`` per metric, no loop over packets."""
    hi = np.append(lo[1:], len(ts))
    size = hi - lo
    src0 = src[lo]
    fwd = np.asarray(src == np.repeat(src0, size), dtype=bool)  # elementwise; None == None (null-safe)
    ok = ~np.isnan(lens)
    li = np.where(ok, lens, 0).astype(np.int64)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def red(a, fn=np.add):
        return fn.reduceat(a, lo)

    def opt(vals, counts):
        return [int(v) if c > 0 else None for v, c in zip(vals, counts)]

    cols = {"first_us": ts[lo], "last_us": ts[hi - 1], "n": size, "fc": red(fwd.astype(np.int64))}
    cols["bc"] = size - cols["fc"]
    for side, m in (("f", fwd & ok), ("b", ~fwd & ok)):
        v, k = np.where(m, li, 0), red(m.astype(np.int64))
        cols.update({f"{side}k": k, f"{side}s": red(v), f"{side}q": red(v * v),
                     f"{side}max": opt(red(np.where(m, li, low), np.maximum), k),
                     f"{side}min": opt(red(np.where(m, li, high), np.minimum), k)})
    gk = red(has_gap.astype(np.int64))
    g = np.where(has_gap, gaps, 0)
    cols.update(gn=gk, g1=red(g), g2=red(g.astype(object) ** 2),
                gmax=opt(red(np.where(has_gap, gaps, low), np.maximum), gk),
                gmin=opt(red(np.where(has_gap, gaps, high), np.minimum), gk))
    fl = np.add.reduceat(flags, lo, axis=0)
    out = []
    for i in range(len(lo)):
        acc = {k: (v[i] if isinstance(v, list) else int(v[i])) for k, v in cols.items()}
        acc.update(src0=src0[i], proto0=_iv(proto[lo[i]]), sport0=_iv(sport[lo[i]]), dport0=_iv(dport[lo[i]]),
                   **{f: int(fl[i, j]) for j, f in enumerate(_FLAGS)})
        out.append(acc)
    return out


def _merge(a: dict, b: dict) -> dict:
    out = dict(a, last_us=b["last_us"])
    for k in ("n", "fc", "bc", "fk", "bk", "fs", "bs", "fq", "bq", "gn", "g1", "g2", *_FLAGS):
        out[k] = int(a[k]) + int(b[k])
    for k in ("fmax", "bmax", "gmax"):
        out[k] = _opt(max, a[k], b[k])
    for k in ("fmin", "bmin", "gmin"):
        out[k] = _opt(min, a[k], b[k])
    return out


def _flow_fn(gap_us: int):
    names = [n for n, _ in _FLOW_STATE]

    def rows(key, accs):
        text = lambda x: "" if x is None else str(int(x))
        return pd.DataFrame({"flow": [",".join([str(int(key[0])), *(text(a[n]) for n in _FLOW_NUMBERS)]) for a in accs]})

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the watermark passed the open flow's last packet plus the gap: it is over
            acc = dict(zip(names, state.get))
            state.remove()
            yield rows(key, [acc])
            return
        frames = [p for p in pdfs]
        if not frames:
            return
        pdf = pd.concat(frames) if len(frames) > 1 else frames[0]
        v = np.stack(pdf["v"].to_numpy())
        order = np.lexsort((v[:, 1], v[:, 0]))
        v, ts = v[order], v[order, 0]
        open_acc = dict(zip(names, state.get)) if state.exists else None
        prev = np.concatenate([[open_acc["last_us"] if open_acc else ts[0]], ts[:-1]])
        gaps = ts - prev
        has_gap = np.ones(len(ts), dtype=bool)
        if open_acc is None:
            has_gap[0] = False
        starts = ~has_gap | (gaps >= gap_us)
        has_gap &= ~starts  # the gap that opens a flow belongs to no flow
        lens, proto, sport, dport = (np.where(v[:, 2] & (1 << i), None, v[:, 3 + i]) for i in range(len(_PACKET_NUMBERS)))
        cols = (ts, lens.astype("float64"), pdf["src_ip"].to_numpy(object)[order], proto, sport, dport,
                v[:, 3 + len(_PACKET_NUMBERS):], gaps, has_gap)
        bounds = list(np.flatnonzero(starts)) + [len(ts)]
        done = []
        if bounds[0] > 0:  # the first packets continue the open flow
            open_acc = _merge(open_acc, _segment(*[c[:bounds[0]] for c in cols], head=open_acc))
        if len(bounds) > 1:  # new flows start in this batch: the open one (if any) is over
            b0 = bounds[0]
            segs = _segments(*[c[b0:] for c in cols], np.asarray(bounds[:-1], dtype=np.int64) - b0)
            done += ([open_acc] if open_acc is not None else []) + segs[:-1]
            open_acc = segs[-1]
        state.update(tuple(_out(open_acc, names)))
        _expire_after(state, int(open_acc["last_us"]), gap_us)
        if done:
            yield rows(key, done)
    return fn


def flow_state(packets: DataFrame, gap_seconds: int = 60, watermark: str = "60 seconds") -> DataFrame:
    """Streaming twin of ``windows.flow_rollup``: the full flow row (forward / backward split by the first
    packet's source address, length, rate, inter-arrival and flag metrics) per flow of a key.

    A flow is emitted when a packet of its key arrives ``gap_seconds`` or more
    after its last one, or when the watermark passes its last packet plus the
    gap (event-time timeout). The state of a key is one row of running
    aggregates, so it stays bounded however long a flow lasts; packets of one
    micro-batch are applied in event-time order. Flows still open when the stream stops are in its state:
    ``open_flows``.
    """
    p = packets.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    missing = sum((F.col(c).isNull().cast("long") * (1 << i) for i, c in enumerate(_PACKET_NUMBERS)), F.lit(0))
    numbers = [F.unix_micros("ts"), F.coalesce("packet_id", F.lit((1 << 63) - 1)), missing,
               *[F.coalesce(F.col(c), F.lit(0)) for c in _PACKET_NUMBERS], *X.tcp_flag_columns("tcp_flags")]
    p = p.select("flow_key", "ts", "src_ip", F.array(*[c.cast("long") for c in numbers]).alias("v"))
    s = p.groupBy("flow_key").applyInPandasWithState(
        _flow_fn(int(gap_seconds * 1_000_000)), outputStructType=FLOW_OUT, stateStructType=FLOW_STATE,
        outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)
    return _flow_rows(s.select(F.from_csv("flow", F.lit(_FLOW_CSV)).alias("flow")).select("flow.*"))


def open_flows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The flows that a stopped ``flow_state`` stream has not emitted, as the rows it would emit now."""
    state = spark.read.format("statestore").load(checkpoint)
    return _flow_rows(state.select("key.flow_key", "value.groupState.*"))


def _flow_rows(s: DataFrame) -> DataFrame:
    """The metric row of each flow from its running aggregates."""
    secs = (F.col("last_us") - F.col("first_us")) / F.lit(1_000_000.0)
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    pop_std = lambda k, s1, q: F.sqrt((k.cast("decimal(38,0)") * q - s1.cast("decimal(38,0)") * s1).cast("double")) / k
    k_all, s_all = F.col("fk") + F.col("bk"), F.col("fs") + F.col("bs")
    q_all = F.col("fq") + F.col("bq")
    side = {}
    for sd, name in (("f", "fwd"), ("b", "bwd")):
        k = F.col(f"{sd}k")
        side[name] = [F.col(f"{sd}max").cast("double").alias(f"{name}_pkt_len_max"),
                      F.col(f"{sd}min").cast("double").alias(f"{name}_pkt_len_min"),
                      div(F.col(f"{sd}s"), k).alias(f"{name}_pkt_len_mean"),
                      F.when(k > 0, pop_std(k, F.col(f"{sd}s"), F.col(f"{sd}q"))).alias(f"{name}_pkt_len_std")]
    gk = F.col("gn")
    out = s.select(
        "flow_key", F.timestamp_micros("first_us").alias("flow_start"), F.timestamp_micros("last_us").alias("flow_end"),
        (F.col("last_us") - F.col("first_us")).alias("flow_duration"), F.col("proto0").alias("protocol"),
        F.col("sport0").alias("src_port"), F.col("dport0").alias("dst_port"), F.col("n").alias("n_packets"),
        F.col("fc").alias("tot_fwd_pkts"), F.col("bc").alias("tot_bwd_pkts"),
        F.when(F.col("fk") > 0, F.col("fs").cast("double")).alias("totlen_fwd_pkts"),
        F.when(F.col("bk") > 0, F.col("bs").cast("double")).alias("totlen_bwd_pkts"),
        *side["fwd"], *side["bwd"],
        F.when(k_all > 0, div(s_all, secs)).alias("flow_byts_s"), div(F.col("n"), secs).alias("flow_pkts_s"),
        div(F.col("fc"), secs).alias("fwd_pkts_s"), div(F.col("bc"), secs).alias("bwd_pkts_s"),
        F.least(F.col("fmin"), F.col("bmin")).cast("double").alias("pkt_len_min"),
        F.greatest(F.col("fmax"), F.col("bmax")).cast("double").alias("pkt_len_max"),
        div(s_all, k_all).alias("pkt_len_mean"), F.when(k_all > 0, pop_std(k_all, s_all, q_all)).alias("pkt_len_std"),
        F.when(k_all > 0, ((k_all.cast("decimal(38,0)") * q_all - s_all.cast("decimal(38,0)") * s_all).cast("double")
                           / (k_all * k_all).cast("double"))).alias("pkt_len_var"),
        (div(F.col("g1"), gk) / F.lit(1000.0)).alias("flow_iat_mean"),
        F.when(gk > 0, pop_std(gk, F.col("g1"), F.col("g2")) / F.lit(1000.0)).alias("flow_iat_std"),
        (F.col("gmax").cast("double") / F.lit(1000.0)).alias("flow_iat_max"),
        (F.col("gmin").cast("double") / F.lit(1000.0)).alias("flow_iat_min"),
        *[F.col(f).cast("long").alias(f) for f in _FLAGS])
    exact = {"flow_iat_mean", "flow_iat_std"}  # exact integer moments: rounded half up by fixed IEEE steps
    frac = {f.name for f in out.schema.fields if isinstance(f.dataType, T.DoubleType)} - exact
    return out.select(*[F.round(c, 6).alias(c) if c in frac else X.round_half_up(c, 6).alias(c) if c in exact
                        else F.col(c) for c in out.columns])
