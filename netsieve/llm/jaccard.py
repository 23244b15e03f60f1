"""Op 2: n-gram Jaccard join by MinHash banding.

Documents with the same set of word n-grams form a class, named by its smallest
id. Each class's MinHash signature is cut into bands; band and row counts
follow from the threshold and the target recall. Classes that share a band hash
are candidates: each is linked to the smallest class of its bucket, and the
connected candidates form families. Inside a family all pairs are verified on
their full n-gram sets, in blocks; large families are dealt over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netsieve.llm import arrays, blocks
from netsieve.llm.components import components, discard, written

WORDS = 5
THRESHOLD = 0.8
#: Chance that a pair exactly at the threshold shares a band.
RECALL = 0.9999
#: Signature length allowed.
MAX_HASHES = 128
#: Classes of a family that meet in one task at a time (a task holds two blocks).
BLOCK = 512
#: Columns of the membership matrix held at a time.
GRAMS_AT_ONCE = 1 << 13


def bands_and_rows(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """Most rows per band for which bands * rows stays within ``most`` and the recall at the threshold is met."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def gram_sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, and n + 1 offsets. A text below n words has one gram: all of it."""
    rows = len(off) - 1
    start, end, row = arrays.word_bounds(buf, off)
    words = arrays.byte_hash(buf).of(start, end)
    gram, at = arrays.word_grams(words, row, n)
    owner = row[at]
    run = arrays.per_row(row, rows)
    few = np.flatnonzero((np.diff(run) > 0) & (np.diff(run) < n))
    if len(few):
        gram = np.concatenate([gram, arrays.RangeHash(words).of(run[few], run[few + 1])])
        owner = np.concatenate([owner, few])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[new], owner[new]
    return gram, arrays.per_row(owner, rows)


def _signatures(n: int, bands: int, rows: int):
    factors = arrays.mix(np.arange(1, bands * rows + 1, dtype=np.uint64), 5) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in arrays.text_slices(batches, "text"):
            gram, run_off = gram_sets(buf, off, n)
            size = np.diff(run_off)
            some = np.flatnonzero(size)
            sums = [np.zeros(len(size), np.uint64) for _ in range(2)]
            out = np.zeros((len(some), bands), np.uint64)
            if len(some):
                for k in range(2):
                    sums[k][some] = np.add.reduceat(arrays.mix(gram, 21 + k), run_off[some])
                for band in range(bands):
                    total = np.full(len(some), band, np.uint64)
                    for k in range(rows):
                        low = np.minimum.reduceat(gram * factors[band * rows + k], run_off[some])
                        total = arrays.mix(total ^ low, k)
                    out[:, band] = total
            held = np.zeros(len(size) + 1, np.int64)
            held[some + 1] = bands
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(s.view(np.int64)) for s in sums), pa.array(size.astype(np.int64)),
                 arrays.list_array(out.ravel().view(np.int64), np.cumsum(held), pa.int64())],
                names=["id", "s1", "s2", "n_grams", "bands"])
    return run


def _verify(n: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        sets = []
        for part, buf, off in arrays.text_slices(table.to_batches(), "text"):
            gram, run_off = gram_sets(buf, off, n)
            sets += [gram[a:b] for a, b in zip(run_off[:-1], run_off[1:])]
        # Rows that share an id bring several texts; the one whose set the class has is taken, once.
        key = np.array([int(arrays.mix(s, 21).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
        same = np.flatnonzero(key == table["s1"].to_numpy())
        rows = same[np.unique(table["class_id"].to_numpy()[same], return_index=True)[1]]
        table, sets = table.drop(["text"]).take(pa.array(rows)), [sets[r] for r in rows]
        ids, size = table["class_id"].to_numpy(), table["size"].to_numpy()
        own, lo, hi = table["own"].to_numpy(), table["lo"][0].as_py(), table["hi"][0].as_py()
        left, right = blocks.meeting(own, lo, hi)
        length = np.array([len(s) for s in sets], np.int64)
        gram = np.concatenate(sets)
        _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), length)
        shared = count[inverse] > 1
        column, owner = (np.cumsum(count > 1) - 1)[inverse[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((len(left), len(right)), np.float32)
        total = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, total, GRAMS_AT_ONCE):
            a, b = np.searchsorted(column, [at, at + GRAMS_AT_ONCE])
            held = np.zeros((len(sets), min(GRAMS_AT_ONCE, total - at)), np.float32)
            held[owner[a:b], column[a:b] - at] = 1
            common += held[left] @ held[right].T
        either = length[left][:, None] + length[right][None, :] - common.astype(np.int64)
        linked = common.astype(np.int64) / either >= threshold
        if lo == hi:
            linked = np.triu(linked, 1)
        i, j = np.nonzero(linked)
        i, j = left[i], right[j]
        links = (np.bincount(i, size[j], len(ids)) + np.bincount(j, size[i], len(ids))).astype(np.int64)
        label = blocks.local_labels(len(ids), i, j, ids)
        keep = links > 0
        return pa.table({"class_id": ids[keep], "hub": label[keep], "links": links[keep]})
    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                 threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: id, class_id, n_links, component_id and kept.

    Two documents are linked if the Jaccard similarity of their sets of word
    n-grams is at least ``threshold``. ``n_links`` counts the other rows linked
    directly, ``class_id`` is the smallest id with the same set, ``component_id``
    the smallest id reachable by links, and ``kept`` says the row has that id.
    A text with fewer than n words has one gram, its whole word sequence. Null
    texts and texts without a word link with nothing and are kept. Rows
    with a null id take no part: their class and component are null and they are
    kept. Rows that share an id are one document: the text with the smallest
    signature counts, and every one of the rows gets its result. Extra
    columns are not read; an empty table gives no rows; texts are taken whole.
    """
    bands, rows = bands_and_rows(threshold, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = written(texts.mapInArrow(_signatures(n, bands, rows),
                                      "id long, s1 long, s2 long, n_grams long, bands array<long>"), "op2-marked")
    mark = F.struct("s1", "s2", "n_grams", "bands")
    able = (marked.where("id is not null and n_grams > 0").groupBy("id").agg(F.min(mark).alias("m"), F.count("*").alias("n"))
            .select("id", "n", "m.*"))
    banded = written(able.groupBy("s1", "s2", "n_grams").agg(
        F.min("id").alias("class_id"), F.sum("n").alias("size"), F.first("bands").alias("bands")), "op2-banded")
    # The band hashes are most of these tables, and are needed for the edges alone.
    ids, able = written(marked.select("id"), "op2-ids"), written(able.drop("bands", "n"), "op2-able")
    classes = written(banded.drop("bands"), "op2-classes")
    discard(marked)
    in_band = banded.select("class_id", F.posexplode("bands").alias("band", "hash"))
    hubs = (in_band.groupBy("band", "hash").agg(F.min("class_id").alias("hub"), F.count("*").alias("n"))
            .where("n > 1").select(F.col("band").alias("h_band"), F.col("hash").alias("h_hash"), "hub"))
    # A class has a hub in each band at most; its smallest hub joins it and its other hubs, so that a large group has about
    # one edge a class, not one a band.
    led = (in_band.join(hubs, (F.col("hash") == F.col("h_hash")) & (F.col("band") == F.col("h_band")))
           .groupBy("class_id").agg(F.collect_set("hub").alias("hubs")))
    edges = written(led.select(F.explode(F.array_append("hubs", F.col("class_id"))).alias("a"), F.array_min("hubs").alias("b"))
                    .where("a != b").distinct(), "op2-edges")
    discard(banded)
    families = components(edges).withColumnRenamed("component", "family")
    members = families.join(classes, F.col("node") == F.col("class_id")).select(
        "class_id", "size", "s1", "family")
    dealt = written(blocks.block_pairs(members, ["family"], "class_id", BLOCK), "op2-dealt")
    texts = texts.join(members.select("class_id").hint("shuffle_hash"), F.col("id") == F.col("class_id"), "left_semi")
    found = written(dealt.join(texts, F.col("class_id") == F.col("id")).drop("id")
                    .groupBy("family", "lo", "hi").applyInArrow(_verify(n, threshold), "class_id long, hub long, links long"), "op2-found")
    discard(edges, dealt)
    grouped = components(found.where("class_id != hub").select(F.col("class_id").alias("a"), F.col("hub").alias("b")))
    linked = (found.groupBy("class_id").agg(F.sum("links").alias("links"))
              .join(grouped, F.col("class_id") == F.col("node")).select("class_id", "links", "component"))
    full = (classes.withColumnRenamed("class_id", "c_id").join(linked, F.col("c_id") == F.col("class_id"), "left")
            .select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n_grams").alias("cn"), "c_id", "size",
                    F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "c_id").alias("component")))
    of_id = (able.join(full, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))
                                          & (F.col("n_grams") == F.col("cn")))
             .select(F.col("id").alias("o_id"), "c_id", (F.col("links") + F.col("size") - 1).alias("links"), "component"))
    component = F.coalesce("component", "id")
    return (ids.join(of_id, F.col("id") == F.col("o_id"), "left")
            .select(F.col("id").alias(id_col), F.coalesce("c_id", "id").alias("class_id"),
                    F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))
