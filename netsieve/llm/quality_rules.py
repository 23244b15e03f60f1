"""Op 9: quality rules with cross-document line frequency.

One Arrow pass hashes the normalised lines of each text. Spark then counts, for
each host and line, the near-copy classes (op 2) of the texts that hold the line,
so that a copied or slightly edited document does not turn its own lines into
boilerplate. A second Arrow pass measures each text and takes out its lines above
the limit; a document that keeps too few of its words is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from netsieve.llm import arrays, jaccard
from netsieve.llm.components import discard, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more than this many distinct texts of one host is boilerplate.
MAX_TEXTS_PER_HOST = 10
#: A document that keeps less than this share of its words is depleted.
MIN_KEPT_SHARE = 0.3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _worded_lines(buf: np.ndarray, off: np.ndarray, hashes: arrays.RangeHash, start: np.ndarray, end: np.ndarray):
    """Start, end, row, hash of the words and number of words of each line with a word, and the words' hashes."""
    words = hashes.of(start, end)
    l_start, l_end, l_row = arrays.line_bounds(buf, off)
    first, last = np.searchsorted(start, l_start), np.searchsorted(start, l_end)
    full = last > first
    l_start, l_end, l_row, first, last = (x[full] for x in (l_start, l_end, l_row, first, last))
    return l_start, l_end, l_row, arrays.RangeHash(words).of(first, last), last - first, words


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, off in arrays.text_slices(batches, "text"):
        start, end, _ = arrays.word_bounds(buf, off)
        _, _, row, line, _, _ = _worded_lines(buf, off, arrays.byte_hash(buf), start, end)
        # Each distinct line of a row once.
        _, once = np.unique(arrays.mix(line ^ arrays.mix(row.astype(np.uint64), 3)), return_index=True)
        order = once[np.argsort(row[once], kind="stable")]
        yield pa.RecordBatch.from_arrays([
            part.column(0), part.column(1),
            arrays.list_array(line[order].view(np.int64), arrays.per_row(row[order], part.num_rows), pa.int64()),
        ], names=["row_key", "host", "lines"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, off in arrays.text_slices(batches, "text"):
        rows = part.num_rows
        start, end, row = arrays.word_bounds(buf, off)
        hashes = arrays.byte_hash(buf)
        l_start, l_end, l_row, line, size, words = _worded_lines(buf, off, hashes, start, end)
        solid = ~arrays.SPACE[buf]
        heads = (buf & 0xC0) != 0x80
        n_words = np.bincount(row, minlength=rows)
        # Words in 3-word windows found twice or more in the row.
        gram, at = arrays.word_grams(words, row, 3)
        gram = arrays.mix(gram ^ arrays.mix(row[at].astype(np.uint64)))
        _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
        twice = at[count[inverse] > 1]
        hit = np.zeros(len(words) + 3, bool)
        for k in range(3):
            hit[twice + k] = True
        n_repeat = np.bincount(row[hit[: len(words)]], minlength=rows)
        raw = arrays.mix(hashes.of(l_start, l_end) ^ arrays.mix(l_row.astype(np.uint64)))
        _, once = np.unique(raw, return_index=True)
        n_dup = np.bincount(l_row, minlength=rows) - np.bincount(l_row[once], minlength=rows)
        # Lines to remove, and the text without them; a line goes with the newline after it.
        listed = part.column(3)
        n_listed = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
        listed_row = np.repeat(np.arange(rows), n_listed)
        gone = np.isin(arrays.mix(line ^ arrays.mix(l_row.astype(np.uint64), 3)),
                       arrays.mix(listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                                  ^ arrays.mix(listed_row.astype(np.uint64), 3)))
        l_start, l_end, l_row = l_start[gone], l_end[gone], l_row[gone]
        n_removed = np.bincount(l_row, weights=size[gone], minlength=rows).astype(np.int64)
        edge = np.zeros(len(buf) + 1, np.int64)
        edge[l_start] += 1
        np.subtract.at(edge, np.minimum(l_end + 1, off[l_row + 1]), 1)
        stays = np.cumsum(edge)[:-1] == 0
        kept_off = np.concatenate([[0], np.cumsum(stays)])[off].astype(np.int32)
        kept = pa.StringArray.from_buffers(rows, pa.py_buffer(kept_off), pa.py_buffer(np.ascontiguousarray(buf[stays])))
        kept = pc.if_else(pc.is_null(part.column(1)), pa.scalar(None, pa.string()), kept)
        chars = np.concatenate([[0], np.cumsum(heads)])
        bounds = arrays.per_row(l_row, rows)
        yield pa.RecordBatch.from_arrays([
            part.column(0), part.column(2), pa.array(n_words), pa.array(_sums(solid & heads, off)),
            pa.array(_sums(_SYMBOL[buf], off)), pa.array(n_dup), pa.array(n_repeat), pa.array(n_removed), kept,
            arrays.list_array((chars[l_start] - chars[off[l_row]]).astype(np.int32), bounds, pa.int32()),
            arrays.list_array((chars[l_end] - chars[off[l_row]]).astype(np.int32), bounds, pa.int32()),
        ], names=["id", "carry", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                  "n_removed_words", "kept_text", "starts", "ends"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  max_texts: int = MAX_TEXTS_PER_HOST, min_share: float = MIN_KEPT_SHARE,
                  carry: list[str] | None = None) -> DataFrame:
    """One row per input row: id, the ``carry`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_removed_words (words of removed lines), kept, kept_text (the text without the removed lines) and
    the removed character spans (starts, ends) in the input.

    A line of a host goes if more than ``max_texts`` texts of the host hold it; near
    copies of a text count once. A removed line goes with the newline after it.

    A null or empty text has no words and fails; a null id or host is a value of
    its own; repeated rows repeat with equal results; extra columns are not read; an empty
    table gives no rows. Texts of any length are measured whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    held = F.struct(*[F.col(c) for c in carry or []], F.lit(True).alias("_held"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(host_col).cast("string").alias("host"), held.alias("carry"))
    rows = rows.withColumn("row_key", F.xxhash64("id", "host", "text"))
    found = written(rows.select("row_key", "host", "text").mapInArrow(_lines, "row_key long, host string, lines array<long>"), "op9-lines")
    lines = found.select("host", "row_key", F.explode("lines").alias("line"))
    near = jaccard.jaccard_join(rows, "row_key", "text").select(
        F.col("row_key").alias("n_key"), "component_id").distinct()
    classes = found.select("host", "row_key", "lines").join(
        near.hint("shuffle_hash"), F.col("row_key") == F.col("n_key"))
    counted = classes.select("host", F.col("component_id").alias("text_key"), F.explode("lines").alias("line"))
    common = (counted.groupBy("host", "line", "text_key").agg(F.lit(1).alias("one"))
              .groupBy("host", "line").count().where(F.col("count") > max_texts)
              .select(F.col("host").alias("c_host"), F.col("line").alias("c_line")))
    # Written, so that the shuffles behind it are gone before the texts are dealt out.
    removed = written(lines.join(common, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("line") == F.col("c_line")))
                      .groupBy(F.col("row_key").alias("r_key")).agg(F.collect_set("line").alias("gone")), "op9-removed")
    discard(found)
    measured = (rows.join(removed.hint("shuffle_hash"), F.col("row_key") == F.col("r_key"), "left").select("id", "text", "carry", "gone")
                .mapInArrow(_measure, f"id {id_type}, carry {rows.schema['carry'].dataType.simpleString()}, n_words long, "
                                      "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                      "n_removed_words long, kept_text string, starts array<int>, ends array<int>"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.select(
        F.col("id").alias(id_col), *[F.col(f"carry.{c}").alias(c) for c in carry or []], "n_words", "word_chars",
        "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "n_removed_words",
        (~base & (F.col("n_words") - F.col("n_removed_words") >= min_share * F.col("n_words"))).alias("kept"),
        "kept_text", "starts", "ends")
