"""Op 12: spelling variants by finite-state composition.

Words whose first letters are equal form one partition, and so do words whose last letters are
equal (read backwards): one edit leaves one of the two ends as it is, so two near words meet
in a partition. Its initial state is the state behind the shared letters. A partition's words
become a minimised acyclic acceptor; composing it with a one-edit transducer and
the acceptor again enumerates the near pairs: states are walked in step up to the edit,
and behind it the common words of two states are found, once for each pair of states.
Partitions above the block size are dealt into pairs of blocks, whose two acceptors share
their states and are composed with each other.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netsieve.llm import blocks
from netsieve.llm.components import durable

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form has at least this many times the occurrences of its variant.
FORM_RATIO = 10
#: One run in so many loses a code point (made-up misspellings).
NOISE = 31
#: Words of a partition that meet in one task at a time (a task holds two blocks).
BLOCK = 16384
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(65, 91)}
_PIECE = 1 << 20
_HELD = 200_000


def runs(text: str) -> Counter:
    """Number of each lower-cased run of a text, found in pieces that end between runs."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _PIECE) if at + _PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        found.update(_RUN.findall(text[at:end].translate(_LOWER)))
        at = end
    return found


def _count(min_length: int, noise: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                             names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for word, n in runs(text or "").items():
                        if len(word) < min_length:
                            continue
                        if noise:
                            h = zlib.crc32(f"{key}:{word}".encode())
                            if h % noise == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1:]
                                if len(word) < min_length:
                                    continue
                        total[word] += n
                if len(total) > _HELD:
                    yield flush()
        yield flush()
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points with ``min_count`` occurrences.

    Runs of letters A-Z, a-z, U+00C0-U+00FF, of which A-Z are lower-cased. Where ``noise`` is not 0 and divides the
    crc32 h of ``<id>:<run>``, the run loses its code point h % length. A null text has no words, a null id is
    an empty one in the crc32.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
                       F.col(text_col).cast("string").alias("text")).where("text is not null")
    return (rows.mapInArrow(_count(min_length, noise), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


class Acceptors:
    """Minimised acyclic acceptors that share their states; a state's words are numbered in sorted order."""

    def __init__(self):
        self.register: dict = {}
        self.arcs: list[list[tuple[str, int, int]]] = []  # (letter, state, number of the first word behind it)
        self.final: list[bool] = []
        self.size: list[int] = []
        self.least: list[int] = []  # length of the shortest word
        self.lengths: list[int] = []  # lengths modulo 64, as bits
        self.common: dict[tuple[int, int], list] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.arcs)
            at, numbered, bits = int(final), [], int(final)
            for letter, to in arcs:
                numbered.append((letter, to, at))
                at += self.size[to]
                turned = self.lengths[to]
                bits |= (turned << 1 | turned >> 63) & 0xFFFFFFFFFFFFFFFF
            self.arcs.append(numbered)
            self.final.append(final)
            self.size.append(at)
            self.least.append(0 if final else 1 + min((self.least[to] for _, to in arcs), default=0))
            self.lengths.append(bits)
        return state

    def add(self, words: list[str]) -> int:
        """Initial state of the acceptor of sorted distinct words."""
        stack: list[tuple[bool, list]] = [(False, [])]
        last = ""
        for word in [*words, None]:
            keep = 0
            if word is not None:
                top = min(len(last), len(word))
                while keep < top and last[keep] == word[keep]:
                    keep += 1
            while len(stack) - 1 > keep:
                state = self._state(*stack.pop())
                stack[-1][1].append((last[len(stack) - 1], state))
            if word is not None:
                stack.extend((False, []) for _ in range(len(word) - keep))
                stack[-1] = (True, stack[-1][1])
                last = word
        return self._state(*stack[0])

    def both(self, s: int, t: int) -> list[tuple[int, int]]:
        """Numbers of the words that two states have in common."""
        if not self.lengths[s] & self.lengths[t]:
            return []
        if s == t:
            return [(i, i) for i in range(self.size[s])]
        if s > t:
            return [(i, j) for j, i in self.both(t, s)]
        found = self.common.get((s, t))
        if found is None:
            found = [(0, 0)] if self.final[s] and self.final[t] else []
            there = {letter: (to, at) for letter, to, at in self.arcs[t]}
            for letter, to, at in self.arcs[s]:
                other = there.get(letter)
                if other is not None:
                    found += [(at + i, other[1] + j) for i, j in self.both(to, other[0])]
            self.common[s, t] = found
        return found

    def near(self, s: int, t: int, rest: int | None, known: dict) -> list[tuple[int, int]]:
        """Words of two states that are one edit apart; with ``rest``, edits with at most so many letters behind them.

        The same pair may be found twice, where an insertion has several places.
        """
        found = known.get((s, t))
        if found is not None:
            return found
        found = []
        least = self.least

        def edited(a: int, b: int, at: int, bt: int, mirror: bool) -> None:
            if rest is None or min(least[a], least[b]) <= rest:
                for i, j in self.both(a, b):
                    found.append((at + i, bt + j))
                    if mirror:
                        found.append((bt + j, at + i))

        arcs = self.arcs[s]
        if s == t:
            for k, (_, a, at) in enumerate(arcs):
                found += [(at + i, at + j) for i, j in self.near(a, a, rest, known)]
                edited(a, s, at, 0, True)
                for _, b, bt in arcs[k + 1:]:
                    edited(a, b, at, bt, True)
        else:
            others = self.arcs[t]
            for _, b, bt in others:
                edited(s, b, 0, bt, False)
            for letter, a, at in arcs:
                edited(a, t, at, 0, False)
                for other, b, bt in others:
                    if letter == other:
                        found += [(at + i, bt + j) for i, j in self.near(a, b, rest, known)]
                    else:
                        edited(a, b, at, bt, False)
        known[s, t] = found
        return found


def near_pairs(left: list[str], right: list[str] | None, rest: int | None = None) -> np.ndarray:
    """Rows (i, j) of words one edit apart, by their place in the sorted lists; without ``right``, inside one list, both ways."""
    longest = max((len(w) for w in [*left, *(right or [])]), default=0)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * longest + 2000))
    a = Acceptors()
    s = a.add(left)
    t = s if right is None else a.add(right)
    found = np.array(a.near(s, t, rest, {}), np.int64).reshape(-1, 2)
    return np.unique(found, axis=0)


def _best(n_words: int, i: np.ndarray, j: np.ndarray, n: np.ndarray, order: np.ndarray):
    """Words with near words, their number, and the near word of largest n (ties: first in ``order``)."""
    by = np.lexsort((order[j], -n[j], i))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    return i[first], np.bincount(i, minlength=n_words)[i[first]], j[first]


def _compose(head: int, tail: int):
    def run(table: pa.Table) -> pa.Table:
        side, lo, hi = (table[c][0].as_py() for c in ("side", "lo", "hi"))
        words, n = np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
        own = table["own"].to_numpy()

        def inner(w: str) -> str:
            return w[head:] if side == 0 else w[::-1][tail:]

        def block(rows: np.ndarray) -> tuple[list[str], np.ndarray]:
            inside = [inner(words[r]) for r in rows]
            by = sorted(range(len(rows)), key=inside.__getitem__)
            return [inside[k] for k in by], rows[by]

        left, l_rows = block(np.flatnonzero(own == lo))
        right, r_rows = (None, l_rows) if lo == hi else block(np.flatnonzero(own == hi))
        # Backwards only edits within the first letters count; the others are found forwards.
        pairs = near_pairs(left, right, None if side == 0 else head - 1)
        i, j = l_rows[pairs[:, 0]], r_rows[pairs[:, 1]]
        if side == 1:
            heads = np.array([w[:head] for w in words], object)
            new = (heads[i] != heads[j]).astype(bool)
            i, j = i[new], j[new]
        if lo != hi:
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.empty(len(words), np.int64)
        order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        w, count, b = _best(len(words), i, j, n, order)
        return pa.table({"word": pa.array(words[w], pa.string()), "n_near": pa.array(count, pa.int64()),
                         "best_n": pa.array(n[b], pa.int64()), "best": pa.array(words[b], pa.string())})
    return run


def near_words(vocab: DataFrame, min_length: int = MIN_LENGTH, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) for the words of ``vocab(word, n)`` that have near words.

    Near words differ by exactly one inserted, deleted or replaced code point; ``best`` is the one
    of largest n (ties: smallest in code-point order). Words have at least ``min_length`` (2 or more) code points.
    """
    head = min_length // 2
    tail = min_length - head
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, head).alias("letters")),
                              F.struct(F.lit(1).alias("side"), F.substring("word", -tail, tail).alias("letters"))))
    spread = vocab.select("word", "n", sides.alias("s")).select("word", "n", "s.side", "s.letters")
    dealt = blocks.block_pairs(spread, ["side", "letters"], "word", block)
    found = dealt.groupBy("side", "letters", "lo", "hi").applyInArrow(
        _compose(head, tail), "word string, n_near long, best_n long, best string")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.n")).alias("best_n")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = FORM_RATIO, noise: int = NOISE) -> DataFrame:
    """One row per word of the vocabulary: word, n, form, form_n, root, n_near.

    A word's form is its near word of largest n if that is at least ``ratio`` (2 or more) times the word's own; its
    root follows forms to the last and is the word itself where it has none. Repeated rows count again; null
    and empty texts have no words; extra columns are not read; an empty table gives no rows; texts and runs of any
    length are taken whole.
    """
    vocab = durable(vocabulary(docs, id_col, text_col, min_length, min_count, noise))
    near = near_words(vocab, min_length).withColumnRenamed("word", "w")
    is_form = F.col("best_n") >= ratio * F.col("n")
    told = durable(vocab.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")))
    # Each step of a chain has ``ratio`` times the occurrences of the one before, so a chain is short; every round
    # doubles the distance covered.
    links = told.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        hop = links.select(F.col("word").alias("h_word"), F.col("to").alias("h_to"))
        links = durable(links.join(hop, F.col("to") == F.col("h_word"), "left").select(
            "word", F.coalesce("h_to", "to").alias("to"), F.col("h_to").isNotNull().alias("moved")))
        done = links.where("moved").limit(1).count() == 0
        links = links.select("word", "to")
        if done:
            break
    roots = links.select(F.col("word").alias("r_word"), "to")
    return (told.join(roots, F.col("word") == F.col("r_word"), "left")
            .select("word", "n", "form", "form_n", F.coalesce("to", "word").alias("root"), "n_near"))
