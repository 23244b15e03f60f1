"""Op 4: language identification by multilingual mixture inference.

Each language has a smoothed distribution over hashed byte trigrams around letters, counted by
Spark over all learning rows. A document is a mixture of languages: expectation
maximisation estimates its proportions from the trigram likelihoods, until the log-likelihood is
within ``TOLERANCE`` of its maximum (the likelihood is concave in the proportions, so the largest
gradient bounds what is left). The set of
languages is chosen by penalised likelihood: languages enter in the order of
their proportions for as long as the log-likelihood minus a penalty for each further
language rises. The prediction is the largest proportion of that set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netsieve.llm import arrays

#: Hashed trigrams; the model holds this many numbers per language.
BUCKETS = 1 << 13
SMOOTHING = 0.5
#: Log-likelihood that a converged estimate may lack.
TOLERANCE = 0.1
#: Penalty per further language, in units of log(number of trigrams) / 2.
PENALTY = 4.0
#: Texts handled at a time (a longer single text is taken whole).
BYTES_AT_ONCE = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of the trigram around each letter byte; other bytes and text ends count as a space."""
    low = _LOWER[buf]
    if len(low) > 1:  # capital Latin-1 letters, whose second byte follows C3
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 32
    letter = _LETTER[low]
    low[~letter] = 32
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    starts, ends = off[:-1], off[1:]
    before[starts[ends > starts]] = 32
    after[ends[ends > starts] - 1] = 32
    at = np.flatnonzero(letter)
    code = (before[at].astype(np.uint32) << 16) | (low[at].astype(np.uint32) << 8) | after[at]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return bucket.astype(np.int64), np.searchsorted(off, at, side="right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for part, buf, off in arrays.text_slices(batches, "text", BYTES_AT_ONCE):
        bucket, row = trigrams(buf, off)
        names = part.column(0).to_pylist()
        kinds = sorted(set(names))
        kind = np.searchsorted(kinds, names) if kinds else np.zeros(0, int)
        counts = np.bincount(kind[row] * BUCKETS + bucket, minlength=len(kinds) * BUCKETS).reshape(-1, BUCKETS)
        for k, name in enumerate(kinds):
            total[name] = total.get(name, 0) + counts[k]
    for name, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)),
                                          pa.array(counts[some])], names=["lang", "bucket", "n"])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and log-probabilities (bucket, language); rows without a language are skipped.

    The driver gets at most BUCKETS numbers for each language.
    """
    rows = (docs.where(F.col(lang_col).isNotNull())
            .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(_count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect())
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((BUCKETS, len(langs)))
    for r in rows:
        counts[r["bucket"], langs.index(r["lang"])] = r["n"]
    return langs, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS))


def mixture(likely: np.ndarray, n: np.ndarray, first: np.ndarray, rows: np.ndarray, total: np.ndarray):
    """Proportions (row, language), log-likelihood of each row, and a bound on what its maximum may lie above, by expectation
    maximisation to ``TOLERANCE``.

    ``likely``: (trigram, language) likelihoods, zero outside a row's set; ``first``: each row's first trigram.
    """
    share = (likely[first] > 0).astype(np.float64)
    share /= share.sum(1, keepdims=True)
    out, fit, lack = share.copy(), np.zeros(len(first)), np.zeros(len(first))
    left = np.arange(len(first))
    while len(left):
        mass = (likely * share[rows]).sum(1)
        slope = np.add.reduceat(likely * (n / mass)[:, None], first, axis=0) / total[:, None]
        gap = total * (slope.max(1) - 1.0)
        done = gap < TOLERANCE
        if done.any():
            at = left[done]
            out[at], lack[at] = share[done], np.maximum(gap[done], 0.0)
            fit[at] = np.add.reduceat(n * np.log(mass), first)[done]
            # Only the rows that go on are kept.
            stays = ~done[rows]
            likely, n, rows = likely[stays], n[stays], rows[stays]
            rows = (np.cumsum(~done) - 1)[rows]
            left, share, slope, total = left[~done], share[~done], slope[~done], total[~done]
            first = np.searchsorted(rows, np.arange(len(left)))
        share = share * slope
    return out, fit, lack


def infer(buf: np.ndarray, off: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, language) proportions of the chosen set; all zero for a row without a trigram, and the set sizes."""
    rows, langs = len(off) - 1, logp.shape[1]
    bucket, row = trigrams(buf, off)
    cell, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    n, bucket, row = n.astype(np.float64), cell % BUCKETS, cell // BUCKETS
    out, sizes = np.zeros((rows, langs)), np.zeros(rows, np.int64)
    present, first, local = np.unique(row, return_index=True, return_inverse=True)
    if not len(present):
        return out, sizes
    logs = logp[bucket]
    top = logs.max(1, keepdims=True)
    likely = np.exp(logs - top)  # scaled by a factor per trigram, which no comparison of sets sees
    total = np.add.reduceat(n, first)
    single = np.add.reduceat(n[:, None] * (logs - top), first, axis=0)
    share, full, lack = mixture(likely, n, first, local, total)
    best = np.eye(langs)[single.argmax(1)]
    score, size = single.max(1), np.ones(len(present), np.int64)
    penalty = PENALTY * 0.5 * np.log(total + 1)
    # No set fits better than all languages together: only rows where that beats one language's penalty go on.
    more = np.flatnonzero(full + lack - penalty > score)
    # The best single language comes first, then the others by proportion.
    place = np.argsort(np.argsort(-np.where(best > 0, 2.0, share), axis=1, kind="stable"), axis=1)
    for k in range(2, langs + 1):
        if not len(more):
            break
        into = np.full(len(present), -1)
        into[more] = np.arange(len(more))
        part = into[local] >= 0
        of = into[local[part]]
        inside = np.where((place[more] < k)[of], likely[part], 0.0)
        share, fit, _ = mixture(inside, n[part], np.searchsorted(of, np.arange(len(more))), of, total[more])
        fit = fit - penalty[more] * (k - 1)
        better = fit > score[more]
        more = more[better]  # the others have their set
        best[more], score[more], size[more] = share[better], fit[better], k
    out[present], sizes[present] = best, size
    return out, sizes


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
             keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, the ``keep`` columns, lang_pred, score (its proportion), n_langs (size of the set), and the set
    with its proportions (langs, shares), the largest first.

    A null text, one without a letter, or any text when nothing was learned has
    lang_pred ``und``, score 0 and no languages (two empty lists). Ties go to the first language in order.
    A null id stays null; repeated rows repeat; extra columns are not read; an
    empty table gives no rows; texts are taken whole.
    """
    keep = keep or {}
    rows = docs.select(F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("_able"),
                       F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias(id_col),
                       *[c.alias(name) for name, c in keep.items()])
    kept = rows.drop("_able", "_text").schema
    schema = kept.add("lang_pred", "string").add("score", "double").add("n_langs", "integer")
    schema = schema.add("langs", T.ArrayType(T.StringType())).add("shares", T.ArrayType(T.DoubleType()))
    n_kept = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in arrays.text_slices(batches, "_text", BYTES_AT_ONCE):
            able = np.array(part.column(0), bool)
            share, size = (infer(buf, off, logp) if langs else (np.zeros((part.num_rows, 1)), np.zeros(part.num_rows)))
            able &= size > 0
            at = share.argmax(1)
            name = np.where(able, np.array([*langs, "und"], object)[np.where(able, at, -1)], "und")
            score = np.where(able, np.minimum(share[np.arange(len(at)), at], 1.0), 0.0)
            order = np.argsort(-share, axis=1, kind="stable")
            chosen = [[j for j in order[r] if share[r, j] > 0] if able[r] else [] for r in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(2 + k) for k in range(n_kept)), pa.array(name.tolist(), pa.string()), pa.array(score),
                 pa.array(np.where(able, size, 0).astype(np.int32)),
                 pa.array([[langs[j] for j in c] for c in chosen], pa.list_(pa.string())),
                 pa.array([share[r, c].tolist() for r, c in enumerate(chosen)], pa.list_(pa.float64()))], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
