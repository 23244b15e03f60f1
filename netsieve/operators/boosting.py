"""Multi-class boosted trees with one softmax loss: one tree per class and round, grown on binned features.

Rows are binned once (quantile edges) and carry the margins of the rounds so far, as an RDD of blocks: the arrays of one
Arrow batch, so that a pass moves bytes and not a list per row, and starts without a query plan. The blocks are dealt over the
cores, not over more tasks than their rows are worth: what a pass has to bring together grows with its tasks. Each level of a
round is one pass: every partition sums gradients and Hessians per (class, node, feature, bin), of the lighter child of a split
alone, as the other child's sums are those of their parent less these. The driver adds up the sums of a few partitions itself, Spark
brings together those of many first; either way at most 2^4 nodes per class reach the driver, whatever the rows, and it
finds the splits. The pass after the last level adds the leaf values to the margins, brings the weighted log loss and error of both splits
for the curve, and the sums of the next round's roots. Training
stops when the error on the held-out rows has not fallen for ``patience`` rounds; the rounds up to the best are kept.

Margins are persisted and every ``CUT`` rounds checkpointed (``spark.checkpoint.dir``), so a lost executor recomputes a
few rounds at most.
"""

from __future__ import annotations

import json
import operator
import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve.session import checkpoint_root

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RATE = 0.1
DEPTH = 6
BINS = 64
LAMBDA = 1.0
MIN_HESSIAN = 1.0
MAX_STEP = 1.0
SHARE = 0.8  # of rows per round and of features per tree
CUT = 10
#: Rows that are worth a task of their own in a pass, and rows of a task where there are more than the cores take at that.
TASK_ROWS, FULL_TASK = 10_000, 1_000_000
#: Bytes of sums that the driver adds up itself.
DIRECT = 4 << 20
#: Rows whose temporary arrays are small enough for memory that is not given back in between.
CHUNK = 1024


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i + 1, 2i + 2); a row goes left where its bin is at most ``cut``; feature -1: a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Node that each row has reached."""
        inner = np.flatnonzero(self.feature >= 0)
        at = np.zeros(len(bins), np.int64)
        if not len(inner):
            return at
        # A leaf leads to itself: no bin is above its cut.
        leaf = self.feature < 0
        feature, cut = np.where(leaf, 0, self.feature), np.where(leaf, BINS, self.cut)
        child = np.where(leaf, np.arange(len(leaf)), 2 * np.arange(len(leaf)) + 1)
        flat, base = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        for _ in range(int(inner[-1] + 1).bit_length()):
            at = child[at] + (flat[base + feature[at]] > cut[at])
        return at


@dataclass
class SoftmaxModel:
    """Trees of each round and class, bin edges per feature, class names in order, and the curve of the training."""

    features: list[str]
    edges: list[list[float]]
    labels: list[str]
    rounds: list[list[Tree]] = field(default_factory=list)
    curve: list[tuple] = field(default_factory=list)  # (round, split, mlogloss, merror)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), len(self.labels)))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.nodes(bins)]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        rounds = [[{n: getattr(t, n).tolist() for n in ("feature", "cut", "value")} for t in trees] for trees in self.rounds]
        text = json.dumps({"features": self.features, "edges": self.edges, "labels": self.labels, "rounds": rounds, "curve": self.curve})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SoftmaxModel:
        d = json.loads(spark.read.text(path).first().value)
        rounds = [[Tree(np.array(t["feature"], np.int32), np.array(t["cut"], np.int32), np.array(t["value"], float)) for t in trees]
                  for trees in d["rounds"]]
        return cls(d["features"], d["edges"], d["labels"], rounds, [tuple(c) for c in d["curve"]])

    def curve_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.curve, "round int, split string, mlogloss double, merror double")


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bin_rows(columns: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    """Bin of each value: the number of edges below it; a missing value is in bin 0."""
    return np.stack([np.searchsorted(np.array(e), np.nan_to_num(x, nan=-np.inf, posinf=np.inf, neginf=-np.inf), side="left")
                     for x, e in zip(columns, edges)], 1).astype(np.uint8) if columns else np.zeros((0, 0), np.uint8)


def histograms(bins: np.ndarray, slot: np.ndarray, grad: np.ndarray, hess: np.ndarray, features: np.ndarray, n_slots: int) -> np.ndarray:
    """Sums of gradients and Hessians of the rows in each slot, shape (slots, 2, features, bins)."""
    out = np.empty((n_slots, 2, len(features), BINS))
    at = slot * BINS
    for i, f in enumerate(features):
        here = at + bins[:, f]
        for j, x in enumerate((grad, hess)):
            out[:, j, i] = np.bincount(here, x, n_slots * BINS).reshape(n_slots, BINS)
    return out


def best_splits(h: np.ndarray, features: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
    """(feature, cut, and gradient and Hessian sums left and right) of the best split of each node by the sums of ``features``,
    shape (nodes, 2, features, bins); feature -1: none gains, and the sums of the node stand on the left."""
    g, s = h[:, 0], h[:, 1]
    total_g, total_h = g[:, :1].sum(2, keepdims=True), s[:, :1].sum(2, keepdims=True)
    left_g, left_h = np.cumsum(g, 2)[:, :, :-1], np.cumsum(s, 2)[:, :, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g ** 2 / (left_h + LAMBDA) + right_g ** 2 / (right_h + LAMBDA) - total_g ** 2 / (total_h + LAMBDA)
    gain[(left_h < MIN_HESSIAN) | (right_h < MIN_HESSIAN)] = -np.inf
    out = []
    for i, each in enumerate(gain):
        if each.size == 0 or not each.max() > 1e-9:
            out.append((-1, 0, float(total_g[i, 0, 0]), float(total_h[i, 0, 0]), 0.0, 0.0))
            continue
        # Of splits that gain alike the first: which sum comes out larger in its last bits depends on the order of addition.
        first = int(np.flatnonzero(each.ravel() >= each.max() * (1 - 1e-9))[0])
        f, c = np.unravel_index(first, each.shape)
        out.append((int(features[f]), int(c), *(float(x[i, f, c]) for x in (left_g, left_h, right_g, right_h))))
    return out


def leaf(g: float, h: float) -> float:
    return RATE * float(np.clip(-g / (h + LAMBDA), -MAX_STEP, MAX_STEP))


def _features_of(round_: int, k: int, n: int, seed: int) -> np.ndarray:
    """The features that the tree of a round and class may use."""
    allowed = np.zeros(n, bool)
    allowed[np.random.default_rng([seed, round_, k]).permutation(n)[: max(1, round(SHARE * n))]] = True
    return allowed


def _sampled(key: np.ndarray, round_: int, seed: int) -> np.ndarray:
    """Rows of a round, by a hash of their key."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53) < SHARE


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians, shape (classes, rows) as the margins; a ``CHUNK`` of rows at a time."""
    g, h = np.empty(margin.shape), np.empty(margin.shape)
    for i in range(0, len(y), CHUNK):
        to = slice(i, i + CHUNK)
        m = margin[:, to]
        p = np.exp(m - m.max(0))
        p /= p.sum(0)
        h[:, to] = np.maximum(2.0 * p * (1.0 - p), 1e-16) * w[to]
        p[y[to], np.arange(p.shape[1])] -= 1.0
        g[:, to] = p * w[to]
    return g, h


def level_sums(blocks: Iterator[tuple], round_: int, seed: int, trees: list[Tree], asked: list[list[int]],
               allowed: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Per class the histograms of the nodes ``asked`` for, by the training rows that the round draws."""
    total: dict = {}
    for key, val, y, w, bins, margin in blocks:
        take = np.flatnonzero(~val & _sampled(key, round_, seed))
        if not len(take):
            continue
        bins = bins[take]
        g, h = gradients(margin[:, take], y[take], w[take])
        for k, (tree, nodes) in enumerate(zip(trees, asked)):
            if not nodes:
                continue
            slots = np.full(len(tree.feature), -1)
            slots[nodes] = np.arange(len(nodes))
            slot = slots[tree.nodes(bins)]
            live = np.flatnonzero(slot >= 0)
            got = (histograms(bins, slot, g[k], h[k], allowed[k], len(nodes)) if len(live) == len(slot) else
                   histograms(bins[live], slot[live], g[k][live], h[k][live], allowed[k], len(nodes)))
            total[k] = total[k] + got if k in total else got
    return total


def losses(block: tuple) -> np.ndarray:
    """Weight, loss and error of the training rows, then of the held-out rows."""
    _, val, y, w, _, margin = block
    out = np.zeros((2, 3))
    for i in range(0, len(y), CHUNK):
        to = slice(i, i + CHUNK)
        m, v, here = margin[:, to], val[to], y[to]
        p = np.exp(m - m.max(0))
        p /= p.sum(0)
        weight = np.where(v, 1.0, w[to])  # held-out rows count alike
        loss = -np.log(np.maximum(p[here, np.arange(len(here))], 1e-16))
        each = np.stack([weight, weight * loss, weight * (p.argmax(0) != here)])
        out += np.stack([each[:, ~v].sum(1), each[:, v].sum(1)])
    return out


def train(df: DataFrame, label: str, features: list[str], key: str, validation_col: str | None = None, weight_col: str | None = None,
          max_iter: int = 100, patience: int = 10, seed: int = 42) -> SoftmaxModel:
    """Model fitted to the rows whose ``validation_col`` is not true; the others are held out for the curve and the early stop.

    ``key`` is an integer column that the row sample of a round is drawn by. Labels are the distinct training labels in
    order (a class list: the trees of a round are one per label); held-out rows of other labels and rows without a label are left
    out. Missing features are in the lowest bin.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    held = F.coalesce(F.col(validation_col), F.lit(False)) if validation_col else F.lit(False)
    narrow = df.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), held.alias("val"),
                       (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("w"),
                       *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]).where("label is not null")
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    fit_rows = narrow.where("NOT val")
    labels = [r.label for r in fit_rows.select("label").distinct().orderBy("label").collect()]
    cols = [f"f{i}" for i in range(len(features))]
    cuts = fit_rows.approxQuantile(cols, [i / BINS for i in range(1, BINS)], 1e-3) if labels else [[] for _ in cols]
    edges = [sorted({x for x in e if np.isfinite(x)}) for e in cuts]
    model = SoftmaxModel(list(features), edges, labels)
    width, classes = len(features), len(labels)
    number = {name: k for k, name in enumerate(labels)}

    if classes < 2:
        narrow.unpersist()
        return model
    cores, rows = spark.sparkContext.defaultParallelism, narrow.count()
    tasks = max(1, min(cores, rows // TASK_ROWS), -(-rows // FULL_TASK))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = bin_rows([pc.fill_null(b[c], np.nan).to_numpy(zero_copy_only=False) for c in cols], edges)
            y = np.array([number.get(v, -1) for v in b["label"].to_pylist()], np.int32)
            on = y >= 0
            key, val, w = (c.to_numpy(zero_copy_only=False)[on] for c in (pc.fill_null(b["key"], 0), b["val"], pc.fill_null(b["w"], 0.0)))
            block = key, val, y[on], w, x[on], np.zeros((classes, int(on.sum())))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    data = narrow.repartition(tasks).mapInArrow(start, "block binary").rdd.map(lambda row: pickle.loads(row.block)).persist(StorageLevel.MEMORY_AND_DISK)

    def together(parts: RDD, each: int) -> dict:
        """Arrays of all partitions added up by key; ``each``: bytes of a partition."""
        if tasks * each > DIRECT:
            parts = parts.reduceByKey(operator.add, max(1, min(cores, classes * 4)))
        out: dict = {}
        for k, x in parts.collect():
            out[k] = out[k] + x if k in out else x
        return out

    def allowed_of(r: int) -> list[np.ndarray]:
        return [np.flatnonzero(_features_of(r, k, width, seed)) for k in range(classes)]

    def bytes_of(nodes: list[list[int]], allowed: list[np.ndarray]) -> int:
        return sum(len(n) * len(a) for n, a in zip(nodes, allowed)) * 2 * BINS * 8

    def keyed(blocks: Iterator[tuple], *asked) -> Iterator[tuple]:
        nodes = asked[3]
        return (((k, v), x) for k, each in level_sums(blocks, *asked).items() for v, x in zip(nodes[k], each))

    allowed, roots = allowed_of(0), [[0] for _ in labels]
    first = 0, seed, [Tree.empty(DEPTH) for _ in labels], roots, allowed
    sums = together(data.mapPartitions(lambda blocks: keyed(blocks, *first)), bytes_of(roots, allowed)) if max_iter else {}
    best, since = np.inf, 0
    for r in range(max_iter):
        trees = [Tree.empty(DEPTH) for _ in labels]
        level = [{v: sums[k, v] for v in roots[k] if (k, v) in sums} for k in range(classes)]
        for depth in range(DEPTH):
            asked: list[list[int]] = [[] for _ in labels]
            for k, tree in enumerate(trees):
                if not level[k]:
                    continue
                for v, (feature, cut, lg, lh, rg, rh) in zip(level[k], best_splits(np.stack([*level[k].values()]), allowed[k])):
                    if feature < 0:
                        tree.value[v] = leaf(lg, lh)
                        continue
                    tree.feature[v], tree.cut[v] = feature, cut
                    tree.value[2 * v + 1], tree.value[2 * v + 2] = leaf(lg, lh), leaf(rg, rh)
                    asked[k].append(2 * v + 1 + int(rh < lh))
            if depth + 1 == DEPTH or not any(asked):
                break
            ask = r, seed, trees, asked, allowed
            sums = together(data.mapPartitions(lambda blocks: keyed(blocks, *ask)), bytes_of(asked, allowed))
            for k, above in enumerate(level):
                level[k] = {}
                for v in asked[k]:
                    parent = (v - 1) // 2
                    here = sums.get((k, v), np.zeros_like(above[parent]))
                    sides = (here, above[parent] - here) if v % 2 else (above[parent] - here, here)
                    level[k] |= {2 * parent + 1: sides[0], 2 * parent + 2: sides[1]}

        def add(block: tuple) -> tuple:
            *rest, bins, margin = block
            return (*rest, bins, margin + np.stack([t.value[t.nodes(bins)] for t in trees]))

        grown = data.map(add).persist(StorageLevel.MEMORY_AND_DISK)
        if (r + 1) % CUT == 0:
            grown.checkpoint()
        allowed = allowed_of(r + 1)
        following = r + 1, seed, first[2], roots, allowed

        def tell(blocks: Iterator[tuple]) -> Iterator[tuple]:
            """Losses after this round, and the sums of the next one's roots."""
            seen = np.zeros((2, 3))

            def passed() -> Iterator[tuple]:
                nonlocal seen
                for block in blocks:
                    seen = seen + losses(block)
                    yield block

            yield from keyed(passed(), *following)
            yield None, seen

        sums = together(grown.mapPartitions(tell), bytes_of(roots, allowed))
        data.unpersist()
        data = grown
        model.rounds.append(trees)
        at = {name: (loss / w, err / w) for name, (w, loss, err) in zip(("train", "test"), sums.pop(None)) if w}
        model.curve += [(r, name, float(at[name][0]), float(at[name][1])) for name in ("train", "test") if name in at]
        if "test" in at:
            best, since = (at["test"][1], 0) if at["test"][1] < best else (best, since + 1)
            if since >= patience:
                break
    if since:
        del model.rounds[len(model.rounds) - since:]
    data.unpersist()
    narrow.unpersist()
    return model


def predict(model: SoftmaxModel, df: DataFrame, label_out: str = "pred_label") -> DataFrame:
    """The rows with ``probs`` (by the order of the labels), ``pred_idx`` (first largest) and its name; narrow, in Arrow batches."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("probs", T.ArrayType(T.DoubleType())),
                           T.StructField("pred_idx", T.DoubleType()), T.StructField(label_out, T.StringType())])
    cols = [f"_x{i}" for i in range(len(model.features))]
    wide = df.select("*", *[(F.col(c).cast("double") if c in names else F.lit(0.0)).alias(x) for c, x in zip(model.features, cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = bin_rows([pc.fill_null(b[c], np.nan).to_numpy(zero_copy_only=False) for c in cols], model.edges)
            p = softmax(model.margins(bins)) if b.num_rows and model.labels else np.zeros((b.num_rows, len(model.labels)))
            top = p.argmax(1) if p.size else np.zeros(b.num_rows, np.int64)
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * p.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.ravel())), pa.array(top.astype(float)),
                 pa.array([model.labels[t] if model.labels else None for t in top], pa.string())], names=[*names, "probs", "pred_idx", label_out])

    return wide.mapInArrow(run, schema)
