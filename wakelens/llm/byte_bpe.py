"""Byte-level BPE encoding and decoding (operator 9).

Bytes are mapped to Latin-1 characters, so one pyahocorasick automaton over the
vocabulary finds the longest token at every byte of a pre-token in one pass.
Encoding goes from longest match to longest match and steps back to shorter
tokens, or to the token before, where two neighbours could not stand side by
side after the merges.  That test is memoised, and a position that once failed
is never entered again, so the work is linear and the result is exactly that of
the merges.

Defined cases: a null or empty text has no ids and decodes to no bytes; null ids
decode to no bytes; every row gives one row, repeated rows included; only the
named columns are read, so other columns never clash.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import arrow_map, worker_slot

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Two generations of memoised words; the older one goes when the younger is full.
MAX_WORDS = 200_000
LONG_TEXT = 4_000_000


class ByteBpe:
    """Ranks of a ``.tiktoken`` file with the merge structure that follows from them."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in pairs}
        self.tokens = {rank: piece for piece, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.iterate = regex.compile(pattern).finditer
        self.automaton = ahocorasick.Automaton()
        for piece, rank in self.ranks.items():
            self.automaton.add_word(piece, (len(piece), rank))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.shorter_of: dict[int, int] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = max(self.tokens) + 1
        self.sizes = {rank: len(piece) for rank, piece in self.tokens.items()}
        raw = [self.tokens.get(i, "").encode("latin-1") for i in range(size)]
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``; itself twice for one byte."""
        if token not in self.halves:
            parts = [self.ranks[c] for c in self.tokens[token]]
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    joined = self.ranks.get(self.tokens[parts[i]] + self.tokens[parts[i + 1]])
                    if joined is not None and joined < token and (best is None or joined < best):
                        best, at = joined, i
                if best is None:
                    break
                parts[at : at + 2] = [best]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return self.halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` next to each other.

        Undo the merges of both, latest first.  If two facing pieces could have
        been joined before the merge undone last, the border would be gone.
        """
        key = left << 20 | right
        known = self.fits.get(key)
        if known is not None:
            return known
        if len(self.fits) > 300_000:
            self.fits.clear()
        bound, answer = None, True
        a, b = left, right
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and (bound is None or joined < bound):
                answer = False
                break
            whole_a, whole_b = len(self.tokens[a]) == 1 or self.split(a)[0] == a, len(self.tokens[b]) == 1 or self.split(b)[0] == b
            if whole_a and whole_b:
                break
            # Of two equal merges the left one happens first, so it is undone last.
            if not whole_a and (whole_b or a > b):
                bound, a = a, self.split(a)[1]
            else:
                bound, b = b + 1, self.split(b)[0]
        self.fits[key] = answer
        return answer

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 characters."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        sizes, shorter_of, fits, n = self.sizes, self.shorter_of, self.fits, len(piece)
        longest = [0] * n
        for end, (length, rank) in self.automaton.iter(piece):
            longest[end - length + 1] = rank
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while True:
            end = at + sizes[token]
            if open_at[end]:
                fit = before < 0 or fits.get(before << 20 | token)
                if fit is None:
                    fit = self.compatible(before, token)
                if fit:
                    out.append(token)
                    if end == n:
                        return out
                    at, before, token = end, token, longest[end]
                    continue
            shorter = shorter_of.get(token)
            if shorter is None:
                shorter = self.shorter(token)
            while shorter < 0:
                open_at[at] = 0
                token = out.pop()
                at -= sizes[token]
                before = out[-1] if out else -1
                shorter = self.shorter(token)
            token = shorter

    def shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of ``token``, or -1."""
        if token not in self.shorter_of:
            piece = self.tokens[token]
            self.shorter_of[token] = next((self.ranks[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ranks), -1)
        return self.shorter_of[token]

    def ids_of(self, word: str) -> bytes:
        held = self.words.get(word)
        if held is None:
            held = self.older.pop(word, None)
            if held is None:
                held = array("i", self.encode_piece(word.encode().decode("latin-1"))).tobytes()
            if len(word) < 100:
                if len(self.words) >= MAX_WORDS:
                    self.older, self.words = self.words, {}
                self.words[word] = held
        return held

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, each match of the pattern on its own."""
        if len(text) < LONG_TEXT:
            return np.frombuffer(b"".join(map(self.ids_of, self.find(text))), np.int32)
        matches, parts = self.iterate(text), []
        while block := [m[0] for m in islice(matches, 1 << 16)]:
            parts.append(b"".join(map(self.ids_of, block)))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.lengths):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for i in range(0, len(ids), 1 << 16):
            part = ids[i : i + (1 << 16)]
            sizes = self.lengths[part]
            before = np.cumsum(sizes) - sizes
            out.append(self.bytes[np.repeat(self.first[part] - before, sizes) + np.arange(int(sizes.sum()))].tobytes())
        return b"".join(out)


def codec(path: str, pattern: str) -> ByteBpe:
    return worker_slot(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def _id_list(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _slices(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text."""
    return _coded(df, path, pattern, id_col, text_col, False).select("id", "ids")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the ids of every whole text and the bytes they decode to."""
    return _coded(df, path, pattern, id_col, text_col, True)


def _coded(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, back: bool) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for whole in batches:
            for batch in _slices(whole):
                ids = [bpe.encode(t) if t else np.zeros(0, np.int32) for t in batch.column(1).to_pylist()]
                decoded = [bpe.decode(x) if back else None for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), _id_list(ids), pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(source, task, f"id {kind}, ids array<int>, decoded binary")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes of every row of ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for whole in batches:
            for batch in _slices(whole):
                decoded = [bpe.decode(np.array([x for x in ids if x is not None], np.int64)) if ids else b"" for ids in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["id", "decoded"])

    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return arrow_map(source, task, f"id {source.schema['id'].dataType.simpleString()}, decoded binary")
