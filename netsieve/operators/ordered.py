"""Rows of all keys in (key, time, id) order over range partitions, and Arrow passes along that order.

A key may hold a third of all rows, or all of them: a range partition is a stretch of
the global order, so a hot key is spread over as many partitions as its rows fill, at any
density in time. What a partition needs from the stretch before it is small and
travels on its own: a bounded number of rows, or one row per partition.

The order is fixed by a reliable checkpoint (``spark.checkpoint.dir``): range bounds are sampled, and two
branches, or a recomputed task, must not see different ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from netsieve.session import checkpoint_root

# The passes run in Python workers: ship this module's code with them (pickled by value), so that
# executors need the package neither installed nor on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
#: Values and gaps (microseconds) below this magnitude have exact moments.
EXACT = 1 << 52
_LIMB = 26
MAX_CAP = 2048


def epoch_us(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp without time zone (no session-zone dependence)."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, CAST({ts} AS TIMESTAMP_NTZ))")


def ordered(df: DataFrame, key: str, ts: str, order_id: str, partitions: int | None = None) -> DataFrame:
    """The rows with ``_us`` (epoch micros) and ``_p`` (partition), sorted by (key, time, id) within and across
    partitions: one range shuffle, checkpointed."""
    d = df.withColumn("_us", epoch_us(ts))
    by = [key, "_us", order_id]
    d = d.repartitionByRange(partitions, *by) if partitions else d.repartitionByRange(*by)
    checkpoint_root(df.sparkSession)
    return d.sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).checkpoint()


def run_starts(key: pa.Array, us: pa.Array, last) -> np.ndarray:
    """True where a row is not in one run with the row before it: another key, or a time is missing.

    ``last`` is the (key, time) before the first row, or None.
    """
    n = len(key)
    new = np.ones(n, bool)
    if n > 1:
        a, b = key.slice(1), key.slice(0, n - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] = other.to_numpy(zero_copy_only=False)
    if last is not None:
        new[0] = key[0].as_py() != last[0]
    gone = pc.is_null(us).to_numpy(zero_copy_only=False)
    new |= gone
    new[1:] |= gone[:-1]
    if last is not None and last[1] is None:
        new[0] = True
    return new


# ------------------------------------------------------------------ sliding buffers

class Buffers:
    """Buffer moments of consecutive rows; keeps the last ``cap`` rows of the current run between chunks."""

    def __init__(self, window_us: int, cap: int):
        self.window, self.cap = window_us, cap
        self.us = self.x = self.gap = np.zeros(0, np.int64)
        self.has_x = self.has_gap = np.zeros(0, bool)

    def add(self, us: np.ndarray, x: np.ndarray, has_x: np.ndarray, new: np.ndarray) -> dict[str, np.ndarray]:
        """Moments of each row's buffer: the rows of its run up to itself, at most ``window_us`` older, at most ``cap``."""
        if len(us) and new[0]:
            self.us = self.x = self.gap = np.zeros(0, np.int64)
            self.has_x = self.has_gap = np.zeros(0, bool)
        first, n = len(self.us), len(us)
        start = np.concatenate([np.zeros(first, bool), new])
        if first + n:
            start[0] = True
        t = np.concatenate([self.us, us])
        gap = np.diff(t, prepend=t[:1])
        has_gap = ~start & (gap < EXACT)
        gap, has_gap = np.concatenate([self.gap, gap[first:]]), np.concatenate([self.has_gap, has_gap[first:]])
        x, has_x = np.concatenate([self.x, x]), np.concatenate([self.has_x, has_x])
        # Steps longer than the window, and steps into another run, are one more than the window: a sum
        # of steps within the window has none of them and is the true distance.
        step = np.clip(np.diff(t, prepend=t[:1]), 0, self.window + 1)
        step[start] = self.window + 1
        along = np.cumsum(step)
        here = np.arange(first, first + n)
        lo = np.maximum(np.searchsorted(along, along[first:] - self.window, side="left"), here - self.cap + 1)
        hi = here + 1
        out = {"_n": hi - lo, **_moments("_x", np.where(has_x, x, 0), has_x, lo, hi),
               **_moments("_g", np.where(has_gap, gap, 0), has_gap, lo, hi)}
        edge = np.iinfo(np.int64)
        out["_g_max"] = window_extreme(np.where(has_gap, gap, edge.min), lo, hi, np.maximum, self.cap)
        out["_g_min"] = window_extreme(np.where(has_gap, gap, edge.max), lo, hi, np.minimum, self.cap)
        runs = np.flatnonzero(start)
        keep = max(len(t) - self.cap, int(runs[-1]) if len(runs) else 0)
        self.us, self.x, self.has_x, self.gap, self.has_gap = t[keep:], x[keep:], has_x[keep:], gap[keep:], has_gap[keep:]
        return out


def _moments(name: str, v: np.ndarray, there: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """Count, sum, and sum of squares in three parts (v = h * 2^26 + l): sums of h*h, h*l and l*l fit 64 bits."""
    high = v >> _LIMB
    low = v - (high << _LIMB)

    def total(a: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(a, dtype=np.int64)])
        return c[hi] - c[lo]

    return {f"{name}_k": total(there), f"{name}_1": total(v), f"{name}_hh": total(high * high),
            f"{name}_hl": total(high * low), f"{name}_ll": total(low * low)}


def window_extreme(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, fn, max_width: int) -> np.ndarray:
    """``fn`` (np.maximum / np.minimum) of ``v[lo[i]:hi[i]]`` for every i, by a sparse table of levels up to ``max_width``."""
    levels = [v]
    while (1 << len(levels)) <= min(len(v), max_width):
        prev, h = levels[-1], 1 << (len(levels) - 1)
        levels.append(fn(prev[:-h], prev[h:]))
    level = np.floor(np.log2(np.maximum(hi - lo, 1))).astype(np.int64)
    out = np.empty(len(lo), dtype=v.dtype)
    for k in np.unique(level):
        m = level == k
        out[m] = fn(levels[k][lo[m]], levels[k][hi[m] - (1 << k)])
    return out


def _ints(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _feed(buffers: Buffers, batch: pa.RecordBatch | pa.Table, new: np.ndarray) -> dict[str, np.ndarray]:
    x = batch["_x"]
    return buffers.add(_ints(batch["_us"]), _ints(x), pc.is_valid(x).to_numpy(zero_copy_only=False), new)


def _append(batch: pa.RecordBatch, names: list[str], made: dict[str, np.ndarray], rows: np.ndarray) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in names), *(pa.array(v[rows]) for v in made.values())],
                                      names=[*names, *made])


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


_MADE = ("_n", *(f"{v}_{m}" for v in ("_x", "_g") for m in ("k", "1", "hh", "hl", "ll")), "_g_max", "_g_min")


def buffer_moments(df: DataFrame, value: Column, key: str, ts: str, order_id: str, window_us: int, cap: int,
                   partitions: int | None = None) -> DataFrame:
    """The rows with the moments of their buffers (see ``Buffers``): of ``value`` (a long) and of the gap to the key's
    previous row.

    One range shuffle. A pass along each partition finishes all rows but the first ``cap`` of its first run;
    those meet the last rows of the stretch before (at most ``2 * cap`` rows per partition) in a second, small one.
    """
    spark = df.sparkSession
    if cap > MAX_CAP:
        raise ValueError(f"at most {MAX_CAP} packets a buffer: beyond that sums of squares leave 64 bits")
    x = value.cast("long")
    d = ordered(df.withColumn("_x", F.when(F.abs(x) < EXACT, x)), key, ts, order_id, partitions)
    names = list(df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"{c} long" for c in _MADE])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers, last, run, seen = Buffers(window_us, cap), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = run_starts(batch[key], batch["_us"], last)
            run_of = run + np.cumsum(new)  # 1: the partition's first run
            place = seen + np.arange(batch.num_rows)
            made = _feed(buffers, batch, new)
            yield _append(batch, names, made, np.flatnonzero((run_of > 1) | (place >= cap)))
            last, run, seen = (batch[key][-1].as_py(), batch["_us"][-1].as_py()), int(run_of[-1]), int(place[-1]) + 1

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, seen, tail = None, 0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = run_starts(batch[key], batch["_us"], last)
            run_of = run + np.cumsum(new)
            place = seen + np.arange(batch.num_rows)
            head = np.flatnonzero((run_of == 1) & (place < cap))
            if len(head):
                yield _flagged(batch.take(pa.array(head)), True, False)
            mine = batch.slice(int(np.flatnonzero(run_of == run_of[-1])[0]))
            tail = [mine] if new.any() else [*tail, mine]
            held = sum(b.num_rows for b in tail)
            while held - tail[0].num_rows >= cap:
                held -= tail.pop(0).num_rows
            last, run, seen = (batch[key][-1].as_py(), batch["_us"][-1].as_py()), int(run_of[-1]), int(place[-1]) + 1
        if tail:
            end = pa.Table.from_batches(tail)
            for b in end.slice(max(0, end.num_rows - cap)).to_batches():
                yield _flagged(b, False, run == 1)

    found = d.mapInArrow(along, schema)
    flagged = T.StructType([*d.schema.fields, T.StructField("_head", T.BooleanType()), T.StructField("_whole", T.BooleanType())])
    ends = d.mapInArrow(edges, flagged).checkpoint()
    # One row per partition: who has rows before a partition's first run, as far back as ``cap`` rows.
    info = ends.groupBy("_p").agg(
        F.min(F.when(F.col("_head"), F.struct("_us", F.col(key).alias("key")))).alias("first"),
        F.max(F.when(~F.col("_head"), F.struct("_us", F.col(key).alias("key")))).alias("last"),
        F.count_if(~F.col("_head")).alias("n"), F.max("_whole").alias("whole")).orderBy("_p").collect()
    sent = []
    for k, q in enumerate(info):
        need, j = cap, k - 1
        while (need > 0 and j >= 0 and info[j].last.key == q.first.key and info[j].last["_us"] is not None
               and q.first["_us"] is not None):
            sent.append((info[j]["_p"], q["_p"]))
            need -= info[j].n
            if not info[j].whole:
                break
            j -= 1
    to = spark.createDataFrame(sent, "_from int, _to int")
    heads = ends.where("_head").withColumn("_to", F.col("_p"))
    tails = ends.where("NOT _head").join(F.broadcast(to), F.col("_p") == F.col("_from")).select(*heads.columns)

    def meet(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("_us", "ascending"), (order_id, "ascending")], null_placement="at_start"))
        new = run_starts(_column(table, key), _column(table, "_us"), None)
        made = _feed(Buffers(window_us, cap), table, new)
        rows = np.flatnonzero(table["_head"].to_numpy())
        cut = table.take(pa.array(rows))
        return pa.table([*(cut[c] for c in names), *(pa.array(v[rows]) for v in made.values())], names=[*names, *made])

    return found.unionByName(heads.unionByName(tails).groupBy("_to").applyInArrow(meet, schema))


def _flagged(batch: pa.RecordBatch, head: bool, whole: bool) -> pa.RecordBatch:
    return batch.append_column("_head", pa.array(np.full(batch.num_rows, head))).append_column(
        "_whole", pa.array(np.full(batch.num_rows, whole)))


def moment_columns(name: str) -> tuple[Column, Column, Column]:
    """Count, sum and sum of squares (decimals) of the moments named ``name``."""
    dec = lambda c: F.col(f"{name}_{c}").cast("decimal(38,0)")
    squares = dec("hh") * F.lit(1 << 2 * _LIMB).cast("decimal(17,0)") + dec("hl") * F.lit(2 << _LIMB).cast("decimal(9,0)") + dec("ll")
    return F.col(f"{name}_k"), F.col(f"{name}_1"), squares


# ------------------------------------------------------------------ sessions

def _first_of(head: pa.Array, column: pa.Array, at: np.ndarray) -> pa.Array:
    """Element 0 of ``head`` where ``at`` is -1, else that of ``column``."""
    return pa.concat_arrays([head, column]).take(pa.array(at + 1))


def sessions(df: DataFrame, key: str, ts: str, order_id: str, gap_us: int, first_cols: tuple[str, ...],
             partitions: int | None = None) -> DataFrame:
    """The rows with ``_us``, ``_session_us`` (time of the first row of the session), ``_first_<c>`` (column ``c`` of that
    row) and ``_iat_us`` (gap to the previous row in the session, null for its first).

    A session ends where the next row of the key comes ``gap_us`` or more later; rows without a time are sessions of
    their own. One range shuffle; a first pass takes one row from each partition (its last session's first row
    and its last time), from which the driver tells each partition which session it goes on with; the second pass
    marks the rows.
    """
    spark = df.sparkSession
    d = ordered(df, key, ts, order_id, partitions)
    fields = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    firsts = [f"_first_{c}" for c in first_cols]
    head_schema = ", ".join(["_p int", f"_first_key {fields[key]}", "_first_at long", f"_last_key {fields[key]}", "_last_at long",
                             "_session_us long", *(f"{f} {fields[c]}" for f, c in zip(firsts, first_cols)), "_whole boolean"])

    def starts(batch: pa.RecordBatch, last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where sessions start, times, and gaps to the row before."""
        new = run_starts(batch[key], batch["_us"], last)
        us = _ints(batch["_us"])
        before = last[1] if last is not None and last[1] is not None else us[0]
        gap = np.diff(us, prepend=before)
        return new | (gap >= gap_us), us, gap

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, head = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            begin, _, _ = starts(batch, last)
            if out is None:
                out = {"_p": batch["_p"][0].as_py(), "_first_key": batch[key][0].as_py(), "_first_at": batch["_us"][0].as_py()}
                begin[0] = False  # open until the partition before is known
                head = (batch, 0)
            at = np.flatnonzero(begin)
            if len(at):
                head, out["_whole"] = (batch, int(at[-1])), False
            last = (batch[key][-1].as_py(), batch["_us"][-1].as_py())
        if out is not None:
            batch, at = head
            row = {**out, "_last_key": last[0], "_last_at": last[1], "_session_us": batch["_us"][at].as_py(),
                   **{f: batch[c][at].as_py() for f, c in zip(firsts, first_cols)}, "_whole": out.get("_whole", True)}
            yield pa.RecordBatch.from_pylist([row], schema=head_arrow)

    head_arrow = to_arrow_schema(T.StructType.fromDDL(head_schema))
    info = d.mapInArrow(ends, head_schema).orderBy("_p").collect()
    carry, open_head = [], None  # the session that the partitions so far leave open
    for k, q in enumerate(info):
        before = info[k - 1] if k else None
        goes_on = (before is not None and before["_last_key"] == q["_first_key"] and before["_last_at"] is not None
                   and q["_first_at"] is not None and q["_first_at"] - before["_last_at"] < gap_us)
        if goes_on:
            carry.append((q["_p"], before["_last_at"], *open_head))
        if not (goes_on and q["_whole"]):
            open_head = (q["_session_us"], *(q[f] for f in firsts))
    told = spark.createDataFrame(carry, ", ".join(
        ["_to int", "_before_us long", "_open_us long", *(f"_open_{c} {fields[c]}" for c in first_cols)]))
    # One row per partition at most.
    d = d.join(F.broadcast(told), F.col("_p") == F.col("_to"), "left")
    names = list(df.columns)
    schema = ", ".join([f"`{c}` {fields[c]}" for c in names] + ["_us long", "_session_us long"]
                       + [f"{f} {fields[c]}" for f, c in zip(firsts, first_cols)] + ["_iat_us long"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if head is None:
                if batch["_to"][0].is_valid:
                    last = (batch[key][0].as_py(), batch["_before_us"][0].as_py())
                head = [batch["_open_us"].slice(0, 1), *(batch[f"_open_{c}"].slice(0, 1) for c in first_cols)]
            begin, us, gap = starts(batch, last)
            at = np.maximum.accumulate(np.where(begin, np.arange(batch.num_rows), -1))
            marks = [_first_of(h, batch[c], at) for h, c in zip(head, ("_us", *first_cols))]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), batch["_us"], *marks, pa.array(gap, mask=begin)],
                names=[*names, "_us", "_session_us", *firsts, "_iat_us"])
            last = (batch[key][-1].as_py(), batch["_us"][-1].as_py())
            head = [m.slice(batch.num_rows - 1, 1) for m in marks]

    return d.mapInArrow(mark, schema)
