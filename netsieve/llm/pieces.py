"""Op 1: SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The text is normalised as the model says (a leading word mark, spaces become
word marks). It then splits wherever two neighbouring characters stand side by
side in no piece: no merge can cross such a point, so both sides encode on
their own. Word marks and most punctuation cut a text in this way; each distinct
unit is encoded once per worker and kept in a bounded cache.

A word is encoded without simulating its merges. An Aho-Corasick automaton
over the pieces names the longest piece at each position; the encoder takes it
if it is compatible with the piece before, and otherwise the next shorter piece.
Two pieces are compatible if merging their joined characters from scratch gives
back just these two. When no piece fits, the last one is taken back and its
start is marked in a bitfield of failed positions, so that no position is
tried twice. The sequence in which all neighbours are compatible is unique
and is the sequence of the merge order; characters without a piece become their
byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netsieve.llm.arrays import list_array

MARK = "▁"
#: Distinct words a worker keeps (two generations of this size).
CACHE_WORDS = 400_000
#: Longest word that is kept.
CACHE_CHARS = 64
#: Remembered compatibility checks.
CACHE_PAIRS = 1_000_000


class PieceModel:
    """Vocabulary of a BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
        if sp.encode("  a") == sp.encode("a"):
            raise ValueError("the model folds white space; only the identity normaliser is supported")
        neighbours = {p[k: k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: Whether a word mark can only start a run: texts then split into words.
        self.by_word = not any(pair[1] == MARK and pair[0] != MARK for pair in neighbours)
        # Punctuation that follows no letter or digit in any piece: a word ends before it. ``bound`` holds the
        # other characters that some piece has before such punctuation; after them the unit goes on.
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        marks -= {b for a, b in neighbours if a.isalpha() or a.isdecimal()}
        bound = {a for a, b in neighbours if b in marks} - marks - {MARK}
        marks |= {c for c in "\n\t\r" if c not in self.ids}
        c, o = re.escape("".join(sorted(marks))), re.escape("".join(sorted(bound)))
        word = f"[^{MARK}{c}{o}]+"
        self.units = re.compile(f"{MARK}*[{c}{o}]*{word}(?:[{o}][{c}{o}]*(?:{word})?)*|{MARK}*[{c}{o}]+|{MARK}+"
                                if marks and bound else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.automaton = ahocorasick.Automaton()
        self.compatible: dict[int, bool] = {}
        #: Of each piece the longest piece that is a proper prefix of it, or -1.
        self.shorter: list[int] = [-1] * len(self.scores)
        self.size: list[int] = [0] * len(self.scores)
        self.pieces: dict[int, str] = {}
        for piece, i in self.ids.items():
            if self.merge(piece) == [i]:  # a piece that merging never makes is no candidate
                self.automaton.add_word(piece, i)
                self.size[i], self.pieces[i] = len(piece), piece
        self.automaton.make_automaton()
        for piece, i in self.ids.items():
            if self.size[i]:
                inner = [piece[:k] for k in range(1, len(piece)) if self.size[self.ids.get(piece[:k], 0)]]
                self.shorter[i] = self.ids[inner[-1]] if inner else -1
        self.starts_with_mark = sp.encode("a")[0] == self.ids.get(MARK + "a") or sp.encode("a")[0] == self.ids.get(MARK)
        self.unknown = re.compile("[^" + re.escape("".join(p for p in self.ids if len(p) == 1)) + "]")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, text: str) -> list[int]:
        """Ids of a short text of known characters by merging: best score first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Adjacent pieces are compatible if merging their characters gives just them."""
        key = left * len(self.scores) + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > CACHE_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def backtrack(self, run: str) -> list[int]:
        """Ids of a run of known characters."""
        n, size, known, vocab, shorter = len(run), self.size, self.compatible, len(self.scores), self.shorter
        best = [-1] * n
        pos = 0
        for end, i in self.automaton.iter_long(run):
            best[pos] = i
            pos = end + 1
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        pos, last, token = 0, -1, best[0]
        while True:
            end = pos + size[token]
            if last < 0:
                good = True
            else:
                good = known.get(last * vocab + token)
                if good is None:
                    good = self.fits(last, token)
            if good and not failed[end >> 3] & (1 << (end & 7)):
                out.append(token)
                if end == n:
                    return out
                last, pos = token, end
                token = best[pos]
                if token < 0:
                    self.matches(run, pos, best)
                    token = best[pos]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: this position fails, take the last piece back
                failed[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos -= size[token]
                last = out[-1] if out else -1
                token = shorter[token]

    def matches(self, run: str, pos: int, best: list[int]) -> None:
        """Longest piece at ``pos`` and at the positions its matches lead to, up to one already known."""
        for end, i in self.automaton.iter_long(run, pos):
            if best[pos] >= 0:
                return
            best[pos] = i
            pos = end + 1

    def word_ids(self, word: str) -> list[int]:
        """Ids of one unit; unknown characters split it and become byte pieces."""
        if self.unknown.search(word) is None:
            return self.backtrack(word)
        ids, out, run = self.ids, [], []
        for c in word:
            if c in ids:
                run.append(c)
                continue
            if run:
                out += self.backtrack("".join(run))
                run = []
            out += [self.byte_ids[b] for b in c.encode("utf-8")]
        if run:
            out += self.backtrack("".join(run))
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text as int32."""
        if not text:
            return np.zeros(0, np.int32)
        text = (MARK if self.starts_with_mark else "") + text.replace(" ", MARK)
        if not self.by_word:
            return np.array(self.word_ids(text), np.int32)
        units = self.units.findall(text)
        found = list(map(self.new.get, units))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    found[k] = self.unit(units[k])
        return np.frombuffer(b"".join(found), np.int32)

    def unit(self, word: str) -> bytes:
        got = self.new.get(word) or self.old.get(word)
        if got is None:
            got = array("i", self.word_ids(word)).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.new) >= CACHE_WORDS:
                self.old, self.new = self.new, {}
            self.new[word] = got
        return got

    def decode(self, ids: list[int]) -> str:
        """Text of ids, by the library's own ``decode(ids)``."""
        return self.library.decode(ids)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The worker's copy of a model."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text, one row per input row.

    No begin or end ids, no sampling. A null or empty text has no ids and decodes
    to the empty string; a null id stays null; repeated rows repeat; extra columns are
    not read; an empty table gives no rows. Texts of any length are encoded whole.
    ``model_path`` must name the model file on every machine.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [m.encode(t or "") for t in part.column(1).to_pylist()]
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                decoded = [m.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), list_array(flat, off, pa.int32()), pa.array(decoded, pa.string())],
                    names=[id_col, "ids", "decoded"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
