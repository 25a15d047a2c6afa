"""Token counts at every prefix (operator 10).

A dynamic program over the prefixes of a word keeps, for each prefix, the last
token of its exact encoding and the number of tokens up to there: the last token
is the one vocabulary entry that ends there and may follow the last token of the
prefix before it.  Words are memoised; the counts of the words of a text are
summed up, so the token count at every word end of a text is stored once, and
truncation and budget questions are searches in that array.

Defined cases: a null or empty text, or one of white space only, has no prefixes
and zero tokens.  Strings of added tokens inside a text count as one token, as
the vocabulary's own library has it by default.  Every row gives one row,
repeated rows included; only the named columns are read.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import arrow_map, worker_slot

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Two generations of memoised words; the older one goes when the younger is full.
MAX_WORDS = 200_000


def byte_characters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary of merges with word ends, read from its JSON file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for place, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
            left, right, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left, right] = place
            self.halves[made] = (left, right)
        self.made_at = {made: self.rank[pair] for made, pair in self.halves.items()}
        self.plain = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.longest = max(map(len, self.final))
        self.automaton = ahocorasick.Automaton()
        for piece, token in self.plain.items():
            self.automaton.add_word(piece, (len(piece), token))
        self.automaton.make_automaton()
        splitter = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.find = regex.compile(splitter["pattern"]["Regex"]).finditer
        self.find_words = regex.compile(splitter["pattern"]["Regex"]).findall
        added = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.characters = dict(enumerate(byte_characters()))
        self.fits: dict[int, bool] = {}
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` next to each other."""
        key = left << 20 | right
        known = self.fits.get(key)
        if known is not None:
            return known
        if len(self.fits) > 300_000:
            self.fits.clear()
        a, b, bound, answer = left, right, len(self.rank), True
        while True:
            if self.rank.get((a, b), bound) < bound:
                answer = False
                break
            ra, rb = self.made_at.get(a, -1), self.made_at.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                bound, a = ra, self.halves[a][1]
            else:
                bound, b = rb + 1, self.halves[b][0]
        self.fits[key] = answer
        return answer

    def steps(self, word: str) -> tuple[list[int], list[int]]:
        """Last token and token count of every beginning of ``word``, left open at its end."""
        fits, known = self.compatible, self.fits
        last, count = [-1] + [-2] * len(word), [0] * (len(word) + 1)
        for end, (length, token) in self.automaton.iter(word):
            end += 1
            start = end - length
            if last[end] == -2 and last[start] != -2:
                fit = start == 0 or known.get(last[start] << 20 | token)
                if fit is None:
                    fit = fits(last[start], token)
                if fit:
                    last[end] = token
                    count[end] = count[start] + 1
        return last, count

    def closed(self, word: str, end: int, last: list[int], count: list[int]) -> int:
        """Tokens of the first ``end`` characters as a whole word, from the shorter beginnings."""
        for start in range(max(0, end - self.longest), end):
            token = self.final.get(word[start:end])
            if token is not None and (start == 0 or last[start] != -2 and self.compatible(last[start], token)):
                return count[start] + 1
        raise ValueError("the vocabulary does not cover every byte")

    def prefix_tokens(self, word: str) -> list[int]:
        """Tokens of every beginning of ``word`` (in byte characters), taken as a whole word."""
        last, count = self.steps(word)
        return [self.closed(word, end, last, count) for end in range(1, len(word) + 1)]

    def word_tokens(self, word: str) -> int:
        held = self.words.get(word)
        if held is None:
            held = self.older.pop(word, None)
            if held is None:
                piece = word.encode().decode("latin-1").translate(self.characters)
                held = 1 if piece in self.final else self.closed(piece, len(piece), *self.steps(piece[:-1]))
            if len(word) < 100:
                if len(self.words) >= MAX_WORDS:
                    self.older, self.words = self.words, {}
                self.words[word] = held
        return held

    def normal(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Runs of ordinary text, normalised, and added tokens (flagged)."""
        if self.added is None or "<" not in text and not self.added.search(text):
            yield self.normal(text), False
            return
        for i, part in enumerate(self.added.split(text)):
            if part:
                yield (part, True) if i % 2 else (self.normal(part), False)

    def counts(self, text: str) -> np.ndarray:
        """Tokens up to the end of each word or added token of the text."""
        steps: list[int] = []
        for part, is_added in self.parts(text):
            if is_added:
                steps.append(1)
            else:
                steps.extend(map(self.word_tokens, self.find_words(part)))
        return np.cumsum(np.array(steps, np.int64))

    def ends(self, text: str) -> np.ndarray:
        """Code point ends, in the normalised text, that ``counts`` belongs to."""
        at, out = 0, []
        for part, is_added in self.parts(text):
            out.extend([at + len(part)] if is_added else [at + m.end() for m in self.find(part)])
            at += len(part)
        return np.array(out, np.int64)

    def truncated(self, text: str, budget: int) -> str:
        """The longest beginning of the normalised text, ending with a word, within the budget."""
        fits = int(np.searchsorted(self.counts(text), budget, side="right"))
        whole = "".join(part for part, _ in self.parts(text))
        return whole[: int(self.ends(text)[fits - 1])] if fits else ""


def counter(path: str) -> WordBpe:
    return worker_slot(("word_bpe", path), lambda: WordBpe(path))


def prefix_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, counts): tokens up to every word end of every whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                arrays = [words.counts(t) if t else np.zeros(0, np.int64) for t in batch.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
                values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
                counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["id", "n_bytes", "counts"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(source, task, f"id {kind}, n_bytes long, counts array<bigint>")


def within_budget(counted: DataFrame, budget: int, name: str = "words_within") -> DataFrame:
    """Adds how many words fit into ``budget`` tokens, from the stored counts."""
    return counted.withColumn(name, F.size(F.filter("counts", lambda c: c <= budget)).cast("long"))


def truncate(df: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the longest beginning, ending with a word, within the budget."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(path)
        for batch in batches:
            texts = [words.truncated(t, budget) if t else "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(source, task, f"id {source.schema['id'].dataType.simpleString()}, text string")
