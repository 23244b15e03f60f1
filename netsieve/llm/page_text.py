"""Op 13: main text of pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A block is a run of text between block-level tags. Its features are the tags and the
names (class, id, role) of the elements around it and measures of its text. The field
has two labels, main text or not, one weight per feature, and transition weights by how a block stands
to the one before (same element, equal tag). It is fitted by the gradient of the
penalised likelihood (forward-backward) on a bounded number of labelled pages, and decoded by
Viterbi inside Arrow tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.llm import page_blocks, page_examples

#: Labelled pages that a fit uses at most, and the made-up pages of the default training set.
MAX_PAGES = 4000
EXAMPLES = 800
STEPS = 120
L2 = 0.3
#: Share of the names (class, id) that a training page keeps, so that the other features learn too.
KEEP_NAMES = 0.85


@dataclass
class Field:
    """Weight of label 1 against 0 per feature, and transitions [relation to the block before][label][label]."""

    weights: dict[str, float]
    moves: np.ndarray

    def labels(self, found: list[page_blocks.Block]) -> list[int]:
        """Most likely label of each block of a page (Viterbi; ties: label 0)."""
        if not found:
            return []
        moves = self.moves.tolist()
        back, zero, one = [], 0.0, 0.0
        last = None
        for b in found:
            score = sum(self.weights.get(f, 0.0) for f in b.features)
            if last is None:
                zero, one = 0.0, score
            else:
                m = moves[b.relation(last)]
                from0, from1 = (zero + m[0][0], one + m[1][0]), (zero + m[0][1], one + m[1][1])
                back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
                zero, one = max(from0), max(from1) + score
            last = b
        out = [int(one > zero)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def main_text(self, html: str | None) -> str:
        found = page_blocks.blocks(html or "")
        return "\n".join(b.text for b, label in zip(found, self.labels(found)) if label)


def align(found: list[str], lines: list[str]) -> list[int]:
    """Label 1 for blocks that are lines of the labelled main text, in its order."""
    out = [0] * len(found)
    for a, _, n in SequenceMatcher(None, found, lines, autojunk=False).get_matching_blocks():
        out[a: a + n] = [1] * n
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [page_examples.page(k) for k in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.string()) for k in range(2)], names=["html", "text"])


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, relations, labels = [], [], []
        for html, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = page_blocks.blocks(html or "")
            features.append([b.features for b in found])
            relations.append([b.relation(found[k - 1]) if k else 0 for k, b in enumerate(found)])
            labels.append(align([b.text for b in found], [" ".join(x.split()) for x in (text or "").split("\n")]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(features, pa.list_(pa.list_(pa.string()))), pa.array(relations, pa.list_(pa.int32())),
             pa.array(labels, pa.list_(pa.int32()))], names=["features", "relations", "labels"])


def fit(pages: list[tuple[list[list[str]], list[int], list[int]]], steps: int = STEPS, l2: float = L2,
        keep_names: float = KEEP_NAMES) -> Field:
    """Field fitted to (features of each block, relations to the block before, labels) of each page."""
    rng = np.random.default_rng(13)
    index: dict[str, int] = {}
    pages = [p for p in pages if p[0]]
    width = max((len(p[0]) for p in pages), default=1)
    y, relation = np.zeros((len(pages), width), np.int64), np.zeros((len(pages), width), np.int64)
    there = np.zeros((len(pages), width), bool)
    spot, feature = [], []
    for r, (features, relations, labels) in enumerate(pages):
        n = len(features)
        y[r, :n], relation[r, :n], there[r, :n] = labels, relations, True
        gone: dict[str, bool] = {}
        for k, fs in enumerate(features):
            for f in fs:
                if "#" in f and gone.setdefault(f.removeprefix("own:"), rng.random() > keep_names):
                    continue
                spot.append(r * width + k), feature.append(index.setdefault(f, len(index)))
    spot, feature = np.array(spot, np.int64), np.array(feature, np.int64)
    n_w = len(index)
    x = np.zeros(n_w + 12)
    first, second = np.zeros_like(x), np.zeros_like(x)
    pair = there[:, 1:] & there[:, :-1]
    for step in range(1, steps + 1):
        w, moves = x[:n_w], x[n_w:].reshape(3, 2, 2)
        unary = np.bincount(spot, w[feature], y.size).reshape(y.shape)
        score = np.stack([np.zeros_like(unary), unary], -1)
        edge = moves[relation[:, 1:]]  # page, place, label before, label
        forward = np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for k in range(1, width):
            into = np.logaddexp(forward[:, k - 1, 0, None] + edge[:, k - 1, 0], forward[:, k - 1, 1, None] + edge[:, k - 1, 1])
            forward[:, k] = np.where(there[:, k, None], into + score[:, k], forward[:, k - 1])
        backward = np.zeros_like(score)
        for k in range(width - 2, -1, -1):
            to = score[:, k + 1] + backward[:, k + 1]
            out = np.logaddexp(edge[:, k, :, 0] + to[:, None, 0], edge[:, k, :, 1] + to[:, None, 1])
            backward[:, k] = np.where(there[:, k + 1, None], out, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p_one = np.where(there, np.exp(forward[..., 1] + backward[..., 1] - total[:, None]), 0.0)
        both = np.exp(forward[:, :-1, :, None] + edge + (score + backward)[:, 1:, None, :] - total[:, None, None, None])
        both *= pair[..., None, None]
        grad = np.zeros_like(x)
        grad[:n_w] = np.bincount(feature, (there * y - p_one).reshape(-1)[spot], n_w)
        for s in range(3):
            here = pair & (relation[:, 1:] == s)
            seen = np.bincount((2 * y[:, :-1] + y[:, 1:])[here], minlength=4).reshape(2, 2)
            grad[n_w + 4 * s: n_w + 4 * s + 4] = (seen - (both * here[..., None, None]).sum((0, 1))).ravel()
        grad = (grad - l2 * x) / max(len(pages), 1)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        x = x + 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return Field({f: float(x[k]) for f, k in index.items()}, x[n_w:].reshape(3, 2, 2))


def train(spark: SparkSession, labelled: DataFrame | None = None, html_col: str = "html", text_col: str = "text",
          max_pages: int = MAX_PAGES) -> Field:
    """Field fitted to at most ``max_pages`` labelled pages (html, main text with one line per block).

    The pages are those of smallest hash. Without ``labelled`` the made-up pages of ``page_examples`` are used.
    """
    if labelled is None:
        labelled = spark.range(EXAMPLES).mapInArrow(_examples, f"{html_col} string, {text_col} string")
    chosen = labelled.select(F.col(html_col).alias("html"), F.col(text_col).alias("text")).where("html is not null")
    chosen = chosen.orderBy(F.xxhash64("html"), "html").limit(max_pages)
    got = chosen.mapInArrow(_label, "features array<array<string>>, relations array<int>, labels array<int>").collect()
    return fit([(r.features, r.relations, r.labels) for r in got])


def _extract(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [field.main_text(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["carry", "text"])
    return run


def extract(pages: DataFrame, field: Field, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the ``carry`` columns and text, the blocks of label 1 in page order, one line each.

    Character references are decoded, white space inside a block becomes one space. A
    null or empty page has an empty text, and so has one without main text. Repeated rows repeat; other columns are not
    read; an empty table gives no rows; pages of any length are taken whole.
    """
    rows = pages.select(F.struct(*[F.col(c) for c in carry], F.lit(True).alias("_held")).alias("carry"),
                        F.col(html_col).cast("string").alias("html"))
    held = rows.schema["carry"].dataType.simpleString()
    return (rows.mapInArrow(_extract(field), f"carry {held}, text string")
            .select(*[F.col(f"carry.{c}").alias(c) for c in carry], "text"))
