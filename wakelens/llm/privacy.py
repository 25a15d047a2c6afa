"""Personal data and the terms that disclose it (operator 3).

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
Beyond them, the corpus tells which terms reveal a protected entity.  For an
entity e and a term t that stands within ``NEAR`` words of it, the disclosure is
the pointwise mutual information of the two over the information of the entity,

    log(p(e|t) / p(e)) / -log(p(e)) = 1 + log p(e|t) / -log p(e),

which is 1 if the term occurs with that entity only.  For p(e|t) stands the lower
Wilson bound (``Z`` standard errors), so few observations count for less.  Terms
at or above ``GENERALISE`` are replaced by the kind of data they point to, those at
or above ``REMOVE`` are removed, wherever in the corpus they occur; a term that
more likely than not stands elsewhere (bound below ``LIKELY``) is left alone.  The
domain of an e-mail address is an entity too and pools what its addresses show.

Everything is counted in distinct surroundings (the three words on both sides),
so copies of a text are no evidence; one surrounding alone (``SUPPORT``) shows no
co-occurrence.  Counts cover all documents: tasks look up their words in a Bloom filter of fixed size
of the terms in question, and what passes is joined exactly.

Defined cases: a null or empty text has no spans; spans of one kind never
overlap; a term inside a base span is no term; repeated rows are sanitised
alike, each on its own row; without entities nothing is added.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .packed import Shared, arrow_map, bloom, free, hash_words, maybe_in, mix, text_buffers, text_groups, word_bounds

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
NEAR = 8
SIDE = 3
SUPPORT = 2
Z = 1.0
LIKELY = 0.5
GENERALISE = 0.9
REMOVE = 0.97
BLOOM_BITS = 1 << 23

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
# A match never starts inside a run of digits: it would have started with the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from the start of the run before an @ to the end of the domain."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at - _LOCAL.match(text[max(end, at - 4096) : at][::-1]).end()
        if start == max(end, at - 4096) and start > end:
            start = at - _LOCAL.match(text[end:at][::-1]).end()
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _text_hash(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(hash_words(raw, np.array([0]), np.array([len(raw)]))[0].view(np.int64)) if len(raw) else 0


def _places(words: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the surroundings: ``SIDE`` words on both sides within [lo, hi)."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for step in range(-SIDE, SIDE + 1):
            k = at + step
            inside = (k >= lo) & (k < hi)
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, words[np.clip(k, 0, len(words) - 1)], np.uint64(0)))
    return out


def _both(df: DataFrame, text_col: str) -> DataFrame:
    """The text and its lower-case form; words have the same numbers in both."""
    text = F.col(text_col).cast("string")
    return df.select(text.alias("text"), F.lower(text).alias("low"))


def entity_terms(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, kind, term, name, place): terms near base spans; the entity itself has term 0."""

    def rows_of(text: str, low: str) -> Iterator[tuple]:
        spans = base_spans(text)
        if not spans:
            return
        found = [m.span() for m in _WORD.finditer(text)]
        starts, ends = np.array([a for a, _ in found]), np.array([b for _, b in found])
        taken = np.zeros(len(found), bool)
        for _, a, b in spans:
            taken[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b)] = True
        raw, offsets = text_buffers(pa.array([low]))
        at, to = word_bounds(raw, offsets)
        words, (a0, b0) = hash_words(raw, at, to), _trim(raw, at, to)
        terms = hash_words(raw, a0, b0).view(np.int64)
        every = np.arange(len(words))
        places = _places(words, every, np.zeros_like(every), np.full_like(every, len(words))).view(np.int64)
        for kind, a, b in spans:
            entities = [_text_hash(f"{kind}:{text[a:b]}")]
            if kind == "email":
                entities.append(_text_hash("domain:" + text[a:b].rpartition("@")[2].lower()))
            lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))
            for entity in entities:
                yield entity, kind, 0, None, int(places[lo])
            for k in (*range(max(0, lo - NEAR), lo), *range(hi, min(len(found), hi + NEAR))):
                name = bytes(raw[a0[k] : b0[k]]).decode()
                if not taken[k] and len(name) > 1 and any(c.isalpha() for c in name):
                    for entity in entities:
                        yield entity, kind, int(terms[k]), name, int(places[k])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            rows = [r for text, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows_of(text, low)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], ["entity", "kind", "term", "name", "place"])

    return arrow_map(_both(df, text_col), task, "entity long, kind string, term long, name string, place long")


def _trim(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without the punctuation at the edges."""
    edge = np.zeros(256, bool)
    edge[list(_EDGE.encode())] = True
    starts, ends = starts.copy(), ends.copy()
    todo = np.arange(len(starts))
    while len(todo := todo[(starts[todo] < ends[todo]) & edge[raw[np.minimum(starts[todo], len(raw) - 1)]]]):
        starts[todo] += 1
    todo = np.arange(len(starts))
    while len(todo := todo[(starts[todo] < ends[todo]) & edge[raw[ends[todo] - 1]]]):
        ends[todo] -= 1
    return starts, ends


def _term_hits(column: pa.Array, held: np.ndarray) -> Iterator[tuple]:
    """(first row, word hashes, first words of the texts, numbers and term hashes of words that pass)."""
    if not held.any():
        return
    for first, _, raw, offsets in text_groups(column):
        starts, ends = word_bounds(raw, offsets)
        if len(starts):
            terms = hash_words(raw, *_trim(raw, starts, ends))
            near = np.flatnonzero(maybe_in(held, terms))
            if len(near):
                yield first, hash_words(raw, starts, ends), np.searchsorted(starts, offsets), near, terms[near].view(np.int64)


def occurrences(df: DataFrame, held: Shared, enough: int, text_col: str = "text") -> DataFrame:
    """(term, place) of the words of the corpus that pass the filter.

    A term that a task has met in more than ``enough`` surroundings discloses
    nothing, whatever else is found, so the task need not report it further.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met, done = held.get(), {}, set()
        for batch in batches:
            rows = []
            for _, words, bounds, near, terms in _term_hits(batch.column(1), known):
                text = np.searchsorted(bounds, near, "right") - 1
                places = _places(words, near, bounds[text], bounds[text + 1]).view(np.int64)
                for term in np.unique(terms).tolist():
                    if term in done:
                        continue
                    mine = met.setdefault(term, set())
                    new = set(places[terms == term].tolist()) - mine
                    rows.extend((term, place) for place in new)
                    mine |= new
                    if len(mine) > enough:
                        done.add(term)
                        del met[term]
            if sum(map(len, met.values())) > 1_000_000:
                met = {}
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["term", "place"])

    return arrow_map(_both(df, text_col), task, "term long, place long")


def lower_bound(hits: Column, tries: Column, z: float = Z) -> Column:
    """Lower Wilson bound of a share."""
    share, square = hits / tries, z * z
    centre = share + square / (2 * tries)
    return (centre - z * F.sqrt(share * (1 - share) / tries + square / (4 * tries * tries))) / (1 + square / tries)


def disclosing_terms(df: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, name, kind, disclosure, action): terms that reveal an entity beyond the thresholds."""
    near = cut(entity_terms(df, text_col).distinct())
    entities = near.where(F.col("term") == 0).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    counted = near.where(F.col("term") != 0).groupBy("entity", "kind", "term").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("n_both"))
    # The number of surroundings is that of the documents at least.
    total = float(max(2, df.count()))
    information = -F.log(F.least(F.lit(0.5), F.col("n_entity") / F.lit(total)))
    # A term is met at least as often as near any entity, which rules out common words before the corpus is searched.
    met = near.where(F.col("term") != 0).select("term", "place").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    often = counted.where(F.col("n_both") >= support).join(met, "term").where(lower_bound(F.col("n_both"), F.greatest("n_near", "n_both")) >= LIKELY)
    pairs = cut(often.join(entities, "entity").withColumn("information", information))
    # Beyond this the bound of every pair is below LIKELY.
    enough = pairs.agg(F.ceil(F.max(F.col("n_both") / LIKELY)).alias("n")).first()["n"] or 0
    held = Shared(df.sparkSession, bloom(pairs, "term", BLOOM_BITS))
    seen = occurrences(df, held, int(enough), text_col).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    given = lower_bound(F.col("n_both"), F.greatest("n_term", "n_both"))
    likely = pairs.join(seen, "term").withColumn("given", given).where(F.col("given") >= LIKELY)
    scored = likely.withColumn("disclosure", 1 + F.log("given") / F.col("information"))
    best = scored.groupBy("term").agg(F.max_by(F.struct("name", "kind", "disclosure"), F.struct("disclosure", "kind")).alias("top"))
    action = F.when(F.col("top.disclosure") >= remove, "remove").otherwise("generalise")
    return best.where(F.col("top.disclosure") >= generalise).select("term", "top.*", action.alias("action"))


def find(df: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, base, added) of every row: base spans and spans of disclosing terms.

    ``key`` hashes the text, so rows of one identifier with other texts stay apart.
    """
    held = Shared(df.sparkSession, bloom(terms, "term", BLOOM_BITS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.get()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            spans = [base_spans(t) for t in texts]
            hits: list[list] = [[] for _ in texts]
            for first, _, bounds, near, terms in _term_hits(batch.column(3), known):
                owners = np.searchsorted(bounds, near, "right") - 1
                for own in np.unique(owners):
                    row = first + int(own)
                    words = [m.span() for m in _WORD.finditer(texts[row])]
                    for k, term in zip((near - bounds[own])[owners == own], terms[owners == own]):
                        a, b = words[k]
                        word = texts[row][a:b]
                        a, b = a + len(word) - len(word.lstrip(_EDGE)), b - len(word) + len(word.rstrip(_EDGE))
                        if not any(x < b and a < y for _, x, y in spans[row]):
                            hits[row].append({"term": int(term), "start": a, "end": b})
            base = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], _SPAN_TYPE)
            maybe = pa.array(hits, pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), base, maybe], ["id", "key", "base", "maybe"])

    text = F.col(text_col).cast("string")
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), F.lower(text).alias("low"))
    kind = source.schema["id"].dataType.simpleString()
    scanned = cut(arrow_map(source, task, f"id {kind}, key long, base {SPANS}, maybe array<struct<term:long,start:int,end:int>>"))
    hits = scanned.where(F.size("maybe") > 0).select("id", "key", F.explode("maybe").alias("hit")).distinct().select("id", "key", "hit.term", "hit.start", "hit.end")
    # One document's spans at most are collected into a row.
    added = hits.join(terms, "term").groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "action"))).alias("added"))
    joined = scanned.join(added, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,action:string>>)")
    return joined.select("id", "key", "base", F.coalesce("added", none).alias("added"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with base spans replaced by their kind and disclosing terms generalised or removed.

    Texts without a disclosing term are rewritten where they are; only texts that
    may hold one are joined with the terms.
    """
    terms = cut(disclosing_terms(df, text_col))
    if terms.isEmpty():
        return _rewritten(df, text_col, None)
    held = Shared(df.sparkSession, bloom(terms, "term", BLOOM_BITS))
    plain = _rewritten(df, text_col, held, False)
    maybe = cut(_rewritten(df, text_col, held, True))
    return plain.unionByName(_joined_spans(maybe, find(maybe, terms, id_col, text_col), id_col, text_col))


def _rewritten(df: DataFrame, text_col: str, held: Shared | None, hit: bool = False) -> DataFrame:
    """Rows whose text has (``hit``) or has no word of the filter; the latter with base spans replaced."""
    columns, place = df.columns, df.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flagged = np.zeros(batch.num_rows, bool)
            if held is not None:
                for first, _, bounds, near, _ in _term_hits(batch.column(len(columns)), held.get()):
                    flagged[first + np.unique(np.searchsorted(bounds, near, "right") - 1)] = True
            batch = batch.select(columns).filter(pa.array(flagged == hit))
            if not hit:
                texts = pa.array([_without(t) for t in batch.column(place).to_pylist()], batch.column(place).type)
                batch = batch.set_column(place, columns[place], texts)
            yield batch

    text = F.col(text_col).cast("string")
    source = df.withColumn(text_col, text).withColumn(free(df, "_low")[0], F.lower(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return arrow_map(source, task, schema)


def _without(text: str | None) -> str | None:
    """The text with its base spans replaced by their kind; of overlapping spans the first wins."""
    spans = sorted((a, b, kind) for kind, a, b in base_spans(text))
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


def _joined_spans(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    columns = df.columns
    own, row, key, base, added = free(df, "_own", "_id", "_key", "base", "added")
    spans = found.select(F.col("id").alias(row), F.col("key").alias(key), F.col("base").alias(base), F.col("added").alias(added)).dropDuplicates([row, key])
    hashed = df.withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    joined = hashed.join(spans, F.col(id_col).eqNullSafe(F.col(row)) & (F.col(own) == F.col(key)), "left")
    put = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), s["kind"], F.lit(">")).alias("put")))
    more = F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise(F.concat(F.lit("<related to "), s["kind"], F.lit(">"))).alias("put")))
    spans_of = F.array_sort(F.concat(put, more))
    return joined.withColumn(text_col, F.when(F.col(base).isNull(), F.col(text_col)).otherwise(replaced(F.col(text_col), spans_of))).select(*columns)


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced; of overlapping spans the first wins."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["put"]).alias("out"))
    )
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
