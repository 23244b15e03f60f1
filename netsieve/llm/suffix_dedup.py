"""Op 3: removal of repeated 50-byte strings by prefix-free parsing.

Parse: a phrase ends where the rolling hash of the last 49 bytes is 0 modulo
``TRIGGER``, and the next begins 49 bytes before. So every 50-byte string lies in exactly one
phrase, and the suffixes of a phrase that are 50 bytes or longer stand for all text
positions. Dictionary: the distinct phrases, each with the first document of its occurrences
in the parse. In every later document the whole phrase goes at once, which
settles highly repetitive text without looking at its bytes again.

What remains are the dictionary's phrases, whose suffixes may agree for 50 bytes with suffixes
of other phrases. Their suffix array is built in buckets: a suffix is keyed by the smallest hash of
its first 50 bytes' 20-byte substrings, so suffixes that agree for 50 bytes share a bucket, and
consecutive suffixes of one key are one run of bytes. The runs' places meet once, as lists by shares of the keys; those whose
key has a single text are out, and only the others travel with their bytes. Equal runs are one entry with its first document.
Each task sorts the suffixes of its buckets in byte order; neighbours with a common prefix of 50 bytes or more form the
classes, and a suffix goes where its class has a smaller document. A bucket of more than ``BUCKET`` suffixes is dealt on
in shorter runs, by their 36-byte substrings, and one that is still larger by the 50 bytes themselves, over all tasks.

The combination with the parse needs no suffix array of the parse itself: its part is to order
suffixes that are equal up to the end of their phrase. A string of 50 bytes never passes a phrase's end, so
among equal prefixes only the first document of the phrase counts, which the dictionary holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from netsieve.llm import arrays
from netsieve.llm.components import discard, written

WIDTH = 50
#: Mean bytes between phrase ends.
TRIGGER = 256
#: Bytes of the substrings that key a suffix.
KEY_BYTES = 20
#: The same for the buckets that are dealt on.
FINE_BYTES = 36
#: Suffixes of one run at most; a longer one (text of one repeated byte, say) is several runs.
RUN = 1024
#: Suffixes of one bucket that a task may sort together; larger buckets are dealt on by their bytes.
BUCKET = 1 << 16
#: Suffixes sorted at a time (a task goes on with whole buckets).
AT_ONCE = 1 << 18
#: Dictionary bytes whose keys make a share on average.
SHARE_BYTES = 1 << 22
#: Runs that a task packs, or holds of a share, at a time.
HELD = 1 << 20
#: Bytes hashed at a time: the arrays of one step stay in a core's cache.
SLICE = 1 << 17

_OTHER_CODE = arrays.mix(np.arange(256, dtype=np.uint64), 31)


def parse(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, arrays.RangeHash]:
    """Start, end and row of the phrases of each text of at least WIDTH bytes."""
    hashes = arrays.byte_hash(buf)
    cut = np.flatnonzero(hashes.windows(WIDTH - 1) % np.uint64(TRIGGER) == 0) + WIDTH - 1
    row = np.searchsorted(off, cut - WIDTH + 1, side="right") - 1
    # The window lies in one text, and a text's own end ends its last phrase.
    inside = (cut < off[row + 1]) & (cut > off[row] + WIDTH - 1)
    cut, row = cut[inside], row[inside]
    long = np.flatnonzero(np.diff(off) >= WIDTH)
    stop = np.concatenate([cut, off[long + 1]])
    owner = np.concatenate([row, long])
    start = np.concatenate([off[long], cut - WIDTH + 1])
    first = np.concatenate([long, row])
    return (start[np.lexsort((start, first))], *(x[np.lexsort((stop, owner))] for x in (stop, owner)), hashes)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, off in arrays.text_slices(batches, "text", SLICE):
        start, end, row, hashes = parse(buf, off)
        phrase = hashes.of(start, end)
        other = arrays.RangeHash(_OTHER_CODE[buf]).of(start, end)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(take), part.column(1).take(take), pa.array((start - off[row]).astype(np.int32)), pa.array((end - off[row]).astype(np.int32)),
             pa.array(phrase.view(np.int64)), pa.array(other.view(np.int64))],
            names=["id", "text_key", "start", "stop", "p1", "p2"])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _spans(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and rows of a column of span lists."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    return flat.field("start").to_numpy().astype(np.int64), flat.field("stop").to_numpy().astype(np.int64), row


def runs_of(key: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of the runs of equal keys of used positions, of RUN positions at most."""
    new = use.copy()
    new[1:] &= ~use[:-1] | (key[1:] != key[:-1])
    ends = use.copy()
    ends[:-1] &= ~use[1:] | new[1:]
    head, last = np.flatnonzero(new), np.flatnonzero(ends)
    parts = (last - head) // RUN + 1
    if len(parts) and parts.max() > 1:
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        head = np.repeat(head, parts) + place * RUN
        last = np.minimum(np.repeat(last, parts), head + RUN - 1)
    return head, last


def _suffix_keys(hashes: arrays.RangeHash, width: int) -> np.ndarray:
    """The smallest hash of the ``width``-byte substrings of each suffix's first WIDTH bytes."""
    return _smallest(hashes.windows(width), WIDTH - width + 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, row, start, stop): the runs of suffixes with one key in the spans of each text, by slice."""
    for part, buf, off in arrays.text_slices(batches, "text", SLICE):
        if len(buf) < WIDTH:
            continue
        key = _suffix_keys(arrays.byte_hash(buf), KEY_BYTES)
        start, stop, row = _spans(part.column(2))
        use = np.zeros(len(buf) + 1, np.int64)
        np.add.at(use, start + off[row], 1)
        np.add.at(use, stop + off[row] - WIDTH + 1, -1)
        # The last suffix of a text and the first of the next are never neighbours, so no run passes a text's end.
        head, last = runs_of(key, np.cumsum(use)[: len(key)] > 0)
        row = np.searchsorted(off, head, side="right") - 1
        yield (key[head].view(np.int64), part.column(0).to_numpy()[row],
               (head - off[row]).astype(np.int32), (last + WIDTH - off[row]).astype(np.int32))


_PLACES = {"key": pa.int64(), "row": pa.int64(), "start": pa.int32(), "stop": pa.int32()}


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*parts))


def _shares(shares: int):
    def pack(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = _joined(parts)
        share = (columns[0].view(np.uint64) % np.uint64(shares)).astype(np.int32)
        order = np.argsort(share, kind="stable")
        head = np.flatnonzero(np.diff(share[order], prepend=-1))
        bounds = np.append(head, len(order))
        return pa.RecordBatch.from_arrays(
            [pa.array(share[order][head]), *(arrays.list_array(c[order], bounds, kind) for c, kind in zip(columns, _PLACES.values()))],
            names=["share", *_PLACES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs' places as lists, a row for each share of the keys."""
        parts, n = [], 0
        for columns in _runs(batches):
            parts.append(columns)
            n += len(columns[0])
            if n >= HELD:
                yield pack(parts)
                parts, n = [], 0
        if n:
            yield pack(parts)
    return run


def _settle(parts: list[tuple[np.ndarray, ...]], told: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray]:
    """Places whose key has more than one text (it is told, or has two rows here), the other places, and all told keys."""
    columns = _joined(parts)
    order = np.argsort(columns[0])
    columns = tuple(c[order] for c in columns)
    key, row = columns[:2]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.minimum.reduceat(row, head) < np.maximum.reduceat(row, head)
    several |= np.isin(key[head], told)
    out = np.repeat(several, np.diff(np.append(head, len(key))))
    return tuple(c[out] for c in columns), tuple(c[~out] for c in columns), np.union1d(told, key[head[several]])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row, start, stop): the places whose key has more than one text, from lists that come sorted by share.

    A task holds the keys of a share that have one text as yet, however many places a frequent key has.
    """
    parts, n, limit, told, share = [], 0, HELD, np.zeros(0, np.int64), None

    def settled() -> Iterator[pa.RecordBatch]:
        nonlocal parts, n, limit, told
        if parts:
            found, rest, told = _settle(parts, told)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=list(_PLACES))
            parts, n = [rest], len(rest[0])
            limit = max(HELD, 2 * n)

    for batch in batches:
        shares = batch["share"].to_numpy()
        for i, now in enumerate(shares):
            if now != share:
                yield from settled()
                parts, n, limit, told, share = [], 0, HELD, np.zeros(0, np.int64), now
            part = batch.slice(i, 1)
            parts.append(tuple(part[c].flatten().to_numpy() for c in _PLACES))
            n += len(parts[-1][0])
            if n >= limit:
                yield from settled()
    yield from settled()


def _binaries(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The byte ranges of ``buf``, copied."""
    ends = np.cumsum(stop - start)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(stop - ends, stop - start)
    return pa.Array.from_buffers(pa.binary(), len(start), [
        None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf[at]))])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, run, id, text_key, start, stop, bytes): the listed runs of each text; run hashes the bytes."""
    for part, buf, off in arrays.text_slices(batches, "text", SLICE):
        head, stop, row = _spans(part.column(3))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [part.column(3).flatten().field("key"), pa.array(arrays.byte_hash(buf).of(head + off[row], stop + off[row]).view(np.int64)),
             part.column(0).take(take), part.column(1).take(take), pa.array(head.astype(np.int32)), pa.array(stop.astype(np.int32)),
             _binaries(buf, head + off[row], stop + off[row])],
            names=["key", "run", "id", "text_key", "start", "stop", "bytes"])


def _bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and n + 1 offsets of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets, data = column.buffers()[1:]
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0]: off[-1]], off - off[0]


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(deal, key, run, place, first_id, bytes): the entries in shorter runs, each with the place where it begins."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 11):
            part = batch.slice(at, 1 << 11)
            buf, off = _bytes_of(part["bytes"])
            key = _suffix_keys(arrays.byte_hash(buf), FINE_BYTES)
            edge = np.zeros(len(buf) + 1, np.int64)
            edge[off[:-1]] += 1
            edge[off[1:] - WIDTH + 1] -= 1
            head, last = runs_of(key, np.cumsum(edge)[: len(key)] > 0)
            row = np.searchsorted(off, head, side="right") - 1
            take = pa.array(row)
            deal = arrays.mix(key[head] ^ arrays.mix(part["key"].to_numpy().view(np.uint64)[row], 3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(deal.view(np.int64)), part["key"].take(take), part["run"].take(take), pa.array((head - off[row]).astype(np.int32)),
                 part["first_id"].take(take), _binaries(buf, head, last + WIDTH)],
                names=["deal", "key", "run", "place", "first_id", "bytes"])


def suffix_order(buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``buf`` at ``start`` in the order of their first WIDTH bytes, and whether each shares all of them with the one before."""
    word = np.ndarray((len(buf) - 7,), ">u8", np.ascontiguousarray(buf), strides=(1,))
    words = [word[start + k].astype(np.uint64) for k in (*range(0, WIDTH - 8, 8), WIDTH - 8)]
    order = np.lexsort(words[::-1])
    same = np.zeros(len(start), bool)
    same[1:] = True
    for w in words:
        w = w[order]
        same[1:] &= w[1:] == w[:-1]
    return order, same


def _judge(entries: pa.Table) -> pa.RecordBatch:
    """The entries' other columns, start and stop: the spans of each entry whose suffixes also start in a smaller document."""
    buf, off = _bytes_of(entries["bytes"])
    count = np.diff(off) - WIDTH + 1
    entry = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    first = entries["first_id"].to_numpy()[entry]
    order, same = suffix_order(buf, off[entry] + place)
    head = np.flatnonzero(~same)
    low = np.minimum.reduceat(first[order], head)
    gone = np.zeros(len(entry), bool)
    gone[order] = first[order] > low[np.cumsum(~same) - 1]
    at = np.flatnonzero(gone)
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (entry[at[1:]] != entry[at[:-1]])
    begin = at[opens]
    end = at[np.append(opens[1:], True)] if len(at) else at
    take = pa.array(entry[begin])
    names = [c for c in entries.column_names if c not in ("first_id", "bytes")]
    return pa.RecordBatch.from_arrays(
        [*(entries[c].combine_chunks().take(take) for c in names), pa.array(place[begin].astype(np.int32)), pa.array((place[end] + WIDTH).astype(np.int32))],
        names=[*names, "start", "stop"])


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_judge`` over whole buckets of entries that come sorted by their first column."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 12):
            held.append(batch.slice(at, 1 << 12))
            n += held[-1].num_rows * (1 - WIDTH) + pc.sum(pc.binary_length(held[-1]["bytes"])).as_py()
            if n < AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            full = int(np.searchsorted(key, key[-1], side="left"))
            if full:
                yield _judge(table.slice(0, full))
            held = table.slice(full).to_batches()
            n = sum(b.num_rows * (1 - WIDTH) + pc.sum(pc.binary_length(b["bytes"])).as_py() for b in held)
    if held:
        yield _judge(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, off in arrays.text_slices(batches, "text"):
        start, stop, row = _spans(part.column(3))
        edge = np.zeros(len(buf) + 1, np.int64)
        np.add.at(edge, start + off[row], 1)
        np.add.at(edge, stop + off[row], -1)
        gone = np.cumsum(edge)[: len(buf)] > 0
        kept, starts, stops = [], [], []
        for a, b in zip(off[:-1], off[1:]):
            g = gone[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            starts.append(turn[0::2]), stops.append(turn[1::2])
            kept.append(buf[a:b][~g].tobytes())
        ints = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(np.diff(off)), pa.array(kept, pa.binary()), pa.array(starts, ints), pa.array(stops, ints)],
            names=["id", "n_bytes", "kept", "starts", "stops"])


def _mixed(entries: DataFrame) -> DataFrame:
    """The entries whose bucket has more than one document, with its number of suffixes."""
    sizes = entries.groupBy(F.col("deal").alias("s_deal")).agg(
        F.min("first_id").alias("low"), F.max("first_id").alias("high"), F.sum(F.length("bytes") - (WIDTH - 1)).alias("suffixes"))
    return entries.join(sizes.where("low < high").hint("shuffle_hash"), F.col("deal") == F.col("s_deal")).drop("s_deal", "low", "high")


def _repeats(entries: DataFrame, bucket: int) -> DataFrame:
    """(key, run, start, stop): the spans of distinct runs whose 50-byte strings also start in a smaller document."""
    fields = ["deal", "key", "run", "place", "first_id", "bytes"]
    mixed = _mixed(entries.withColumns({"deal": F.col("key"), "place": F.lit(0)}))
    finer = written(mixed.where(F.col("suffixes") > bucket).select("key", "run", "first_id", "bytes").mapInArrow(
        _finer, "deal long, key long, run long, place int, first_id long, bytes binary"), "op3-finer")
    fine = _mixed(finer)
    buckets = mixed.where(F.col("suffixes") <= bucket).select(*fields).union(fine.where(F.col("suffixes") <= bucket).select(*fields))
    found = (buckets.repartition("deal").sortWithinPartitions("deal")
             .mapInArrow(_sort_suffixes, "deal long, key long, run long, place int, start int, stop int")
             .select("key", "run", (F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("stop")).alias("stop")))
    dealt = (fine.where(F.col("suffixes") > bucket)
             .select("key", "run", "place", "first_id", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - WIDTH)).alias("at"))
             .select("key", "run", "first_id", (F.col("place") + F.col("at")).alias("start"), F.expr(f"substring(bytes, at + 1, {WIDTH})").alias("prefix")))
    lows = dealt.groupBy(F.col("prefix").alias("l_prefix")).agg(F.min("first_id").alias("l_id"))
    large = (dealt.join(lows, (F.col("prefix") == F.col("l_prefix")) & (F.col("first_id") > F.col("l_id")))
             .select("key", "run", "start", (F.col("start") + F.lit(WIDTH)).alias("stop")))
    return found.union(large)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, n_bytes, kept (remaining bytes) and the removed byte spans (starts, stops).

    A byte goes if a 50-byte string that covers it also starts in a document
    with a smaller id. Null and empty texts, and texts below 50 bytes, lose
    nothing. Rows with a null id take no part. Rows that share an id are one
    document: none is smaller than the other. Extra columns are not
    read; an empty table gives no rows. Texts are taken whole; what is kept may cut a character.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"),
                        F.col(text_col).cast("string").alias("text"))
    phrases = written(texts.where("id is not null").mapInArrow(
        _parse, "id long, text_key long, start int, stop int, p1 long, p2 long"), "op3-parse")
    dictionary = phrases.groupBy("p1", "p2").agg(F.min("id").alias("first_id")).select(
        F.col("p1").alias("d1"), F.col("p2").alias("d2"), "first_id")
    placed = written(phrases.join(dictionary.hint("shuffle_hash"), (F.col("p1") == F.col("d1")) & (F.col("p2") == F.col("d2")))
                     .select("id", "text_key", F.struct("start", "stop").alias("span"), (F.col("id") > F.col("first_id")).alias("later")),
                     "op3-dictionary")
    discard(phrases)

    def beside(rows: DataFrame, values: DataFrame, how: str, name: str, on: tuple[str, ...] = ("id", "text_key")) -> DataFrame:
        """Rows with the list of their values; the list side is hashed, the texts are not sorted."""
        lists = values.groupBy(*(F.col(c).alias(f"s_{c}") for c in on)).agg(F.collect_list(name).alias(f"{name}s"))
        match = reduce(and_, (F.col(c) == F.col(f"s_{c}") for c in on))
        return rows.join(lists.hint("shuffle_hash"), match, how).drop(*(f"s_{c}" for c in on))

    # Texts with their dictionary phrases: a written table, so that the rows keep their numbers.
    own = written(beside(texts, placed.where("not later"), "inner", "span").withColumn("row", F.monotonically_increasing_id()), "op3-texts")
    n_bytes = placed.where("not later").agg(F.sum(F.col("span.stop") - F.col("span.start"))).first()[0] or 0
    packed = own.select("row", "text", "spans").mapInArrow(
        _shares(1 + n_bytes // SHARE_BYTES), "share int, key array<long>, row array<long>, start array<int>, stop array<int>")
    listed = written(packed.repartition("share").sortWithinPartitions("share")
                     .mapInArrow(_common, "key long, row long, start int, stop int")
                     .select("row", F.struct("start", "stop", "key").alias("run")), "op3-listed")
    shared = written(beside(own.select("row", "id", "text_key", "text"), listed, "inner", "run", ("row",)).select("id", "text_key", "text", "runs").mapInArrow(
        _shared, "key long, run long, id long, text_key long, start int, stop int, bytes binary"), "op3-shared")
    discard(own, listed)
    # Equal runs are one entry, as equal phrases are: every later document loses them whole.
    entries = written(shared.groupBy("key", "run").agg(F.min("id").alias("first_id"), F.first("bytes").alias("bytes")), "op3-entries")
    repeats = written(_repeats(entries, bucket), "op3-repeats").groupBy(F.col("key").alias("r_key"), F.col("run").alias("r_run")).agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))
    judged = entries.drop("bytes").join(repeats, (F.col("key") == F.col("r_key")) & (F.col("run") == F.col("r_run")), "left").select(
        F.col("key").alias("e_key"), F.col("run").alias("e_run"), "first_id", "spans")
    moved = F.transform("spans", lambda s: F.struct((F.col("start") + s["start"]).alias("start"), (F.col("start") + s["stop"]).alias("stop")))
    spans = F.when(F.col("id") > F.col("first_id"), F.array(F.struct("start", "stop"))).otherwise(moved)
    gone = written(shared.drop("bytes").join(judged.hint("shuffle_hash"), (F.col("key") == F.col("e_key")) & (F.col("run") == F.col("e_run")))
                   .select("id", "text_key", F.explode(spans).alias("span")), "op3-gone")
    discard(shared, entries)
    gone = placed.where("later").select("id", "text_key", "span").union(gone)
    cut = beside(texts, gone, "left", "span").select("id", "text_key", "text", "spans").mapInArrow(
        _cut, "id long, n_bytes long, kept binary, starts array<long>, stops array<long>")
    return cut.withColumnRenamed("id", id_col)
