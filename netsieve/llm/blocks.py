"""Pairs inside groups, in blocks: a group above the block size is dealt into pairs of blocks over many tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def block_pairs(rows: DataFrame, group: list[str], member: str, size: int) -> DataFrame:
    """Rows with ``lo``, ``hi`` (block pair) and ``own`` (the row's block).

    Groups of one row are dropped. A group of n rows has ceil(n / size) blocks; a row
    goes to each pair that its block is in, so every two rows meet in exactly one
    pair: the pair (lo, hi) of their blocks.
    """
    counts = rows.groupBy(*group).count().where("count > 1")
    counts = counts.select(*[F.col(g).alias(f"_{g}") for g in group],
                           F.ceil(F.col("count") / size).cast("int").alias("_blocks"))
    on: Column = F.lit(True)
    for g in group:
        on = on & (F.col(g) == F.col(f"_{g}"))
    dealt = (rows.join(counts, on)
             .withColumn("own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))))
    return dealt.select(*rows.columns, "own", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"))


def meeting(own: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides of a block pair (equal for a block with itself)."""
    left = np.flatnonzero(own == lo)
    return (left, left) if lo == hi else (left, np.flatnonzero(own == hi))


def local_labels(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each of n rows reaches by the links a-b."""
    label = ids.copy()
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (before == label).all():
            break
    return label
