"""Op 10: embedding near-duplicates by cross-polytope hashing.

Each table applies pseudo-random rotations (three rounds of random signs and a
fast Hadamard transform) and takes the largest coordinate with its sign; several
rotations together name the bucket. Multiprobe adds, for each rotation, the
bucket with its second-largest coordinate instead. A pair meets where one
vector's own bucket is the other's own bucket or probe. Buckets with one vector
drop out before any vector moves; in the others all pairs are verified by their cosine in double
precision, in blocks, and each pair counts only in the first place where it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netsieve.llm import arrays, blocks
from netsieve.llm.components import components, durable

THRESHOLD = 0.93
TABLES = 14
#: Rotations whose largest coordinates together name a bucket.
ROTATIONS = 3
#: Vectors of a bucket that meet in one task at a time (a task holds two blocks).
BLOCK = 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row (the width is a power of two)."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
        x = x.reshape(n, width)
    return x / np.sqrt(width)


def codes(unit: np.ndarray, tables: int, rotations: int) -> np.ndarray:
    """(rows, tables, 1 + rotations) codes: the own bucket, then one probe for each rotation."""
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    rng = np.random.default_rng([dim, tables, rotations])
    out = np.zeros((n, tables, 1 + rotations), np.int64)
    every = np.arange(n)
    for t in range(tables):
        top = np.zeros((rotations, 2, n), np.int64)
        for r in range(rotations):
            y = padded
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            for choice in range(2):
                at = size.argmax(1)
                top[r, choice] = 2 * at + (y[every, at] < 0)
                size[every, at] = -1
        for probe in range(1 + rotations):
            for r in range(rotations):
                out[:, t, probe] = out[:, t, probe] * (2 * width) + top[r, int(probe == r + 1)]
    return out


def _sign(tables: int, rotations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = part.column(3).to_pylist()
                widths = np.array([len(v) for v in raw])
                for dim in np.unique(widths):
                    rows = np.flatnonzero(widths == dim)
                    x = np.array([raw[r] for r in rows], np.float64)
                    # Scaled by the largest component first: no overflow or underflow in the squares.
                    x /= np.abs(x).max(1, keepdims=True)
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    c = codes(x, tables, rotations).reshape(len(rows), -1)
                    flat = lambda a: arrays.list_array(a.ravel(), np.arange(len(rows) + 1) * a.shape[1],
                                                       pa.from_numpy_dtype(a.dtype))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k).take(pa.array(rows)) for k in range(3)),
                         pa.array(np.full(len(rows), dim, np.int32)), flat(x), flat(c)],
                        names=["class_id", "label", "size", "dim", "unit", "codes"])
    return run


def _verify(threshold: float, probes: int):
    def run(table: pa.Table) -> pa.Table:
        ids, size = table["class_id"].to_numpy(), table["size"].to_numpy()
        lo, hi, t, code = (table[c][0].as_py() for c in ("lo", "hi", "tab", "code"))
        left, right = blocks.meeting(table["own"].to_numpy(), lo, hi)
        x = np.array(table["unit"].to_pylist(), np.float64)
        linked = x[left] @ x[right].T >= threshold
        if lo == hi:
            linked = np.triu(linked, 1)
        i, j = np.nonzero(linked)
        i, j = left[i], right[j]
        c = np.array(table["codes"].to_pylist(), np.int64).reshape(len(ids), -1, probes)
        # In this table the pair counts in the own bucket of i if j is there too, else in that of j.
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        mine = c[i, t, 0] == code
        theirs = (c[j, t, 0] == code) & ~(c[j, t] == c[i, t, :1]).any(1)
        new = mine | theirs
        i, j = i[new], j[new]
        for before in range(t):
            met = (c[j, before] == c[i, before, :1]).any(1) | (c[i, before] == c[j, before, :1]).any(1)
            i, j = i[~met], j[~met]
        links = (np.bincount(i, size[j], len(ids)) + np.bincount(j, size[i], len(ids))).astype(np.int64)
        label = blocks.local_labels(len(ids), i, j, ids)
        keep = links > 0
        return pa.table({"class_id": ids[keep], "hub": label[keep], "links": links[keep]})
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, tables: int = TABLES, rotations: int = ROTATIONS) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal and
    their cosine is at least ``threshold``. Vectors that are null, empty or zero or
    hold null or non-finite components, and rows with a null id or label, link with
    nothing; a null id has a null component and is kept. Equal vectors are compared
    once, as a class. Extra columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.col(label_col).cast("string").alias("label"))
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    fit = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    keyed = rows.select("id", "label", F.when(fit, F.col("v")).alias("v"),
                        *(F.when(fit, F.xxhash64(F.lit(k), "label", "v")).alias(f"k{k}") for k in (1, 2)))
    classes = (keyed.where("k1 is not null").groupBy("k1", "k2")
               .agg(F.min("id").alias("class_id"), F.count("*").alias("size"), F.first("label").alias("label"),
                    F.first("v").alias("v")))
    signed = durable(classes.select("class_id", "label", "size", "v").mapInArrow(
        _sign(tables, rotations),
        "class_id long, label string, size long, dim int, unit array<double>, codes array<long>"))
    probes = 1 + rotations
    spots = signed.select("class_id", "label", "dim", F.posexplode("codes").alias("place", "code")).select(
        "class_id", "label", "dim", F.floor(F.col("place") / probes).cast("int").alias("tab"), "code",
        (F.col("place") % probes == 0).alias("own_bucket"))
    bucket = ["label", "dim", "tab", "code"]
    live = (spots.groupBy(*bucket).agg(F.count("*").alias("n"), F.max("own_bucket").alias("any_own"))
            .where("n > 1 and any_own").select(*[F.col(c).alias(f"l_{c}") for c in bucket]))
    met = spots.join(live, (F.col("code") == F.col("l_code")) & (F.col("tab") == F.col("l_tab"))
                     & (F.col("dim") == F.col("l_dim")) & (F.col("label") == F.col("l_label")))
    dealt = blocks.block_pairs(met.select("class_id", *bucket), bucket, "class_id", BLOCK)
    payload = signed.select(F.col("class_id").alias("p_id"), "size", "unit", "codes")
    found = durable(dealt.join(payload, F.col("class_id") == F.col("p_id")).drop("p_id")
                    .groupBy(*bucket, "lo", "hi")
                    .applyInArrow(_verify(threshold, probes), "class_id long, hub long, links long"))
    grouped = components(found.where("class_id != hub").select(F.col("class_id").alias("a"), F.col("hub").alias("b")))
    linked = (found.groupBy("class_id").agg(F.sum("links").alias("links"))
              .join(grouped, F.col("class_id") == F.col("node")).select("class_id", "links", "component"))
    full = (classes.select("k1", "k2", F.col("class_id").alias("c_id"), "size")
            .join(linked, F.col("c_id") == F.col("class_id"), "left")
            .select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "c_id", "size", "links", "component"))
    out = keyed.drop("v").join(full, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.coalesce("component", "c_id", "id")
    return out.select(F.col("id").alias(id_col),
                      F.coalesce(F.coalesce("links", F.lit(0)) + F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
