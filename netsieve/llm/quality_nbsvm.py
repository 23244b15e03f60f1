"""Op 8: quality classifier, a naive Bayes support vector machine.

Features are indicators of hashed byte bigrams and trigrams, of runs of one repeated word, of the
text's length class and of its class of distinct words. Each is scaled by the
log-count ratio of the two classes; a linear hinge-loss model is fitted to the
scaled, length-normalised rows by dual coordinate descent, and its margin is
turned into a probability by a logistic fit. The fit uses a bounded sample of
labelled rows (``SAMPLE_ROWS``, the smallest hashes of the id); scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netsieve.llm import arrays

GRAM_BUCKETS = 1 << 14
#: After the grams: 6 run classes, 24 length classes, 21 classes of distinct words in all words.
RUNS, LENGTHS, DISTINCT = GRAM_BUCKETS, GRAM_BUCKETS + 6, GRAM_BUCKETS + 30
BUCKETS = GRAM_BUCKETS + 64
#: Labelled rows used for the fit: the documented bound of what meets in one task.
SAMPLE_ROWS = 8_000
ALPHA = 1.0
COST = 1.0
EPOCHS = 20
#: Share of the fitted weights against their mean size.
BETA = 0.5
BYTES_AT_ONCE = 1 << 19


def indicators(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of each row, with offsets."""
    rows = len(off) - 1
    seen = np.zeros(rows * BUCKETS, bool)
    shift = np.uint32(32 - GRAM_BUCKETS.bit_length() + 1)
    for n in (2, 3):
        if len(buf) < n:
            continue
        code = np.zeros(len(buf) - n + 1, np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | buf[k: len(buf) - n + 1 + k]
        code = (code + np.uint32(n)) * np.uint32(0x9E3779B1) >> shift
        row = np.repeat(np.arange(rows), np.diff(off))
        inside = row[: len(code)] == row[n - 1:]
        seen[row[: len(code)][inside] * BUCKETS + code[inside]] = True
    start, end, row = arrays.word_bounds(buf, off)
    word = arrays.byte_hash(buf).of(start, end)
    every = np.arange(rows)
    n_words = np.bincount(row, minlength=rows)
    once = np.unique(arrays.mix(word ^ arrays.mix(row.astype(np.uint64))), return_index=True)[1]
    n_distinct = np.bincount(row[once], minlength=rows)
    seen[every * BUCKETS + LENGTHS + np.minimum(np.log2(n_words + 1).astype(np.int64), 23)] = True
    seen[every * BUCKETS + DISTINCT + 20 * n_distinct // np.maximum(n_words, 1)] = True
    again = np.zeros(len(word), np.int64)
    if len(word) > 1:
        again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    total = np.cumsum(again)
    for k in range(6):  # a word that follows itself 1, 2, 4, .. 32 times in a row
        width = 1 << k
        at = np.flatnonzero(total[width:] - total[:-width] == width) + width if len(word) > width else every[:0]
        seen[row[at] * BUCKETS + RUNS + k] = True
    cell = np.flatnonzero(seen)
    return cell % BUCKETS, arrays.per_row(cell // BUCKETS, rows)


def log_count_ratio(features: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    counts = np.full((2, BUCKETS), ALPHA)
    for f, p in zip(features, positive):
        counts[int(p), f] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0])


def fit(features: list[np.ndarray], positive: np.ndarray) -> tuple[np.ndarray, float, float, float, np.ndarray]:
    """(weight of each indicator before length normalisation, bias, logistic slope and offset, ratios)."""
    ratio = log_count_ratio(features, positive)
    rows = []
    for f in features:
        v = ratio[f]
        size = np.sqrt((v * v).sum())
        rows.append(v / size if size > 0 else v)
    y = np.where(positive, 1.0, -1.0)
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    # Rarer class weighted up so that both count alike.
    cost = COST * np.where(positive, len(y) / (2 * max(1, positive.sum())), len(y) / (2 * max(1, (~positive).sum())))
    square = np.array([(v * v).sum() + 1.0 for v in rows])
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            g = y[i] * (w[features[i]] @ rows[i] + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[features[i]] += step * rows[i]
                bias += step
    w = (1 - BETA) * np.abs(w).mean() * np.sign(w) + BETA * w
    margin = np.array([w[f] @ v for f, v in zip(features, rows)]) * (1 / BETA) + bias
    slope, offset = _logistic(margin, positive)
    return w / BETA * ratio, bias, slope, offset, ratio


def _logistic(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of p = 1 / (1 + exp(-(slope * margin + offset))), softened targets, by Newton steps."""
    pos, neg = positive.sum(), (~positive).sum()
    target = np.where(positive, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (target - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, off in arrays.text_slices(batches, "text", BYTES_AT_ONCE):
        f, run = indicators(buf, off)
        yield pa.RecordBatch.from_arrays([part.column(0), arrays.list_array(f.astype(np.int32), run, pa.int32())],
                                         names=["positive", "f"])


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.assign(key=[f.tobytes() for f in pdf["f"]]).sort_values(["key", "positive"])  # any input order fits alike
    w, bias, slope, offset, ratio = fit(list(pdf["f"]), pdf["positive"].to_numpy(bool))
    return pd.DataFrame({"w": [w.tolist()], "ratio": [ratio.tolist()], "bias": [bias], "slope": [slope], "offset": [offset]})


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """Fitted model from labelled documents, or None where either class is missing.

    The sample is at most ``sample_rows`` labels, so its ids may be broadcast and
    its features fit one task.
    """
    sample = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .select(F.col(id_col).alias("l_id"), (F.col(label_col) == 1).alias("positive"))
              .orderBy(F.xxhash64("l_id"), "l_id", "positive").limit(sample_rows))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(sample), F.col("id") == F.col("l_id")).select("positive", "text")
            .mapInArrow(_features, "positive boolean, f array<int>"))
    got = rows.groupBy(F.lit(1).alias("one")).applyInPandas(
        _fit_group, "w array<double>, ratio array<double>, bias double, slope double, offset double").collect()
    return got[0].asDict() if got else None


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
          keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, the ``keep`` columns, score (0 to 1) and predicted (1 if score >= 0.5).

    Null and empty texts get the score of no feature; without a model every score is 0.5.
    A null id stays null; repeated rows repeat; extra columns are not read; an
    empty table gives no rows; texts are taken whole.
    """
    keep = keep or {}
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias(id_col),
                       *[c.alias(name) for name, c in keep.items()])
    schema = rows.drop("_text").schema.add("score", "double").add("predicted", "integer")
    n_kept = len(keep) + 1
    m = {k: np.array(v) if isinstance(v, list) else v for k, v in (model or {}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in arrays.text_slices(batches, "_text", BYTES_AT_ONCE):
            p = np.full(part.num_rows, 0.5)
            if m:
                f, run_off = indicators(buf, off)
                sums = [np.concatenate([[0.0], np.cumsum(v[f])]) for v in (m["w"], m["ratio"] ** 2)]
                raw, size = (s[run_off[1:]] - s[run_off[:-1]] for s in sums)
                margin = raw / np.sqrt(np.where(size > 0, size, 1)) + m["bias"]
                p = 1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(1 + k) for k in range(n_kept)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
