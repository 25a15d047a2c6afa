"""Learned decision lists over text statistics (operator 2).

Sequential covering on labelled rows: a rule is grown one threshold condition at
a time by information gain, pruned on rows kept apart for that, and the rows it
covers are set aside before the next one.  The list becomes one ordered Spark
conditional expression: the first rule that holds decides.

Everything on the rows is DataFrame functions.  Growing reads histograms of at
most ``features x bins`` cells, so the driver sees counts only.  The list is
fitted on a sample of about ``sample_rows`` labelled rows, chosen by hash; all
statistics and verdicts cover all rows and whole texts.

Defined cases: a null or empty text has no words and fails the base rules; a
document whose labels disagree, or are null, is no training row; without
training rows the list is empty and the default verdict (keep) holds.
Statistics are per row, repeated rows included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = "[\\x20\\x09-\\x0D]"
WINDOW = 5
BINS = 24
SAMPLE_ROWS = 8_000


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text; empty edges of the split are removed."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE + "+"), lambda w: w != "")


def window_keys(words: Column) -> Column:
    """One hash per window of five words, built up from hashes of shorter windows."""
    rest = lambda x, k: F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    return bind(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda one: bind(joined(one, rest(one, 1)), lambda two: bind(joined(two, rest(two, 2)), lambda four: F.slice(joined(four, rest(one, 4)), 1, F.size(one) - WINDOW + 1))),
    )


def repeated_words(words: Column) -> Column:
    """Words covered by windows that are found twice or more in the text.

    A text whose window hashes are all distinct has none.  Otherwise hashes are
    sorted with their places; equal neighbours are repeats.  The places of
    repeats, in order, cover at most ``WINDOW`` words each and no more than up
    to the next one.
    """
    same = lambda a, b: F.coalesce(a.h == b.h, F.lit(False))

    def places(pairs: Column) -> Column:
        return F.transform(F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1))), lambda x: x["at"])

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of_keys(keys: Column) -> Column:
        placed = F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        found = bind(F.array_sort(placed), lambda pairs: bind(F.array_sort(places(pairs)), covered))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(found)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(bind(window_keys(words), of_keys)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, base_failed)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    without = lambda characters: F.length(F.translate(text, characters, ""))
    facts = bind(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    plain = df.select(
        F.col(id_col).alias("id"),
        facts.alias("facts"),
        without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length(text) - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.length(text) - without("!?")).cast("long").alias("n_marks"),
        duplicate_lines(text).alias("n_dup_lines"),
    )
    n_words, repeat = F.col("facts.n_words"), F.col("facts.n_repeat_words")
    return plain.select(
        "id",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeat.alias("n_repeat_words"),
        "n_marks",
        ((n_words < 10) | (100 * repeat > 20 * n_words)).alias("base_failed"),
    )


def features() -> dict[str, Column]:
    """What the conditions may test, from the columns of ``statistics``."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "word_length": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_words"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "mark_share": per("n_marks", "word_chars"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass
class Rule:
    conditions: list[Condition]
    keep: bool
    covered: int = 0
    right: int = 0

    def __str__(self) -> str:
        return f"if {' and '.join(map(str, self.conditions))} then {'keep' if self.keep else 'drop'}  ({self.right} of {self.covered})"


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default: bool = True

    def expression(self, of: dict[str, Column] | None = None) -> Column:
        """The ordered conditional: the first rule that holds decides."""
        of = of or features()
        out = F.lit(self.default)
        for rule in reversed(self.rules):
            out = F.when(_holds(rule.conditions, of), F.lit(rule.keep)).otherwise(out)
        return out


def _holds(conditions: Sequence[Condition], of: dict[str, Column]) -> Column:
    tests = [of[c.feature] >= c.threshold if c.above else of[c.feature] < c.threshold for c in conditions]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def training_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, good) of about ``sample_rows`` labelled documents, by hash of the identifier."""
    total = labels.count()
    share = min(1.0, sample_rows / max(1, total))
    picked = labels.where(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col), F.lit("labels")), F.lit(1 << 20)) < int(share * (1 << 20))))
    return (
        picked.groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"), F.count(F.lit(1)).alias("n"), F.count(label_col).alias("known"))
        .where((F.col("low") == F.col("high")) & (F.col("n") == F.col("known")))
        .select("id", (F.col("low") > 0).alias("good"))
    )


def fit(rows: DataFrame, max_rules: int = 8, max_conditions: int = 3, min_cover: int = 8, min_precision: float = 0.8) -> DecisionList:
    """Learn rules for the rare class (``good`` false) of rows with the feature columns.

    A third of the rows, by hash, is kept apart: a rule drops its last conditions
    while that does not lower (right - wrong) / (right + wrong) there, and is
    accepted if its precision on all rows reaches ``min_precision``.
    """
    names = list(features())
    grid = rows.agg(*[F.percentile_approx(n, [i / BINS for i in range(1, BINS)], 2000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(grid[n])) if grid[n] else [] for n in names}
    # A cut between the largest values of one class often lies above the quantiles.
    tops = rows.groupBy("good").agg(*[F.percentile_approx(n, [0.02, 0.1, 0.5, 0.9, 0.98], 2000).alias(n) for n in names]).collect()
    for n in names:
        cuts[n] = sorted({*cuts[n], *[x for row in tops for x in row[n] or []]})
    if not any(cuts.values()):
        return DecisionList()
    of = {n: F.col(n) for n in names}
    left, found = rows, DecisionList()
    for _ in range(max_rules):
        conditions, table = [], None
        while len(conditions) < max_conditions:
            table = _histogram(left.where(~F.col("pruning") & _holds(conditions, of)), cuts)
            best = _best(table, cuts)
            if best is None:
                break
            conditions.append(best)
        if not conditions:
            break
        rule = _pruned(left, conditions, of)
        if rule is None or rule.covered < min_cover or rule.right < min_precision * rule.covered:
            break
        found.rules.append(rule)
        left = left.where(~_holds(rule.conditions, of))
    return found


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(good, bad) rows at or above each cut of each feature, and in all (first entry)."""
    count = lambda test, name: F.count(F.when(test, 1)).alias(name)
    aggs = []
    for k, (n, values) in enumerate(cuts.items()):
        for i, v in enumerate([None, *values]):
            inside = F.lit(True) if v is None else F.col(n) >= v
            aggs += [count(inside & F.col("good"), f"g{k}_{i}"), count(inside & ~F.col("good"), f"b{k}_{i}")]
    row = rows.agg(*aggs).first()
    return {n: [(row[f"g{k}_{i}"], row[f"b{k}_{i}"]) for i in range(len(values) + 1)] for k, (n, values) in enumerate(cuts.items())}


def _best(table: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]]) -> Condition | None:
    """The condition with the largest gain in information about bad rows."""
    from math import log2

    best, choice = 1e-9, None
    for name, cells in table.items():
        good, bad = cells[0]
        if not bad or not good:
            return None
        base = log2(bad / (bad + good))
        for value, (g, b) in zip(cuts[name], cells[1:]):
            for above, gg, bb in ((True, g, b), (False, good - g, bad - b)):
                gain = bb * (log2(bb / (bb + gg)) - base) if bb else 0.0
                if gain > best:
                    best, choice = gain, Condition(name, above, value)
    return choice


def _pruned(left: DataFrame, conditions: list[Condition], of: dict[str, Column]) -> Rule | None:
    count = lambda test, name: F.count(F.when(test, 1)).alias(name)
    aggs = []
    for k in range(1, len(conditions) + 1):
        inside = _holds(conditions[:k], of)
        for part, among in (("p", F.col("pruning")), ("a", F.lit(True))):
            aggs += [count(inside & among, f"n{part}{k}"), count(inside & among & ~F.col("good"), f"b{part}{k}")]
    row = left.agg(*aggs).first()
    worth = {k: (2 * row[f"bp{k}"] - row[f"np{k}"]) / row[f"np{k}"] if row[f"np{k}"] else -1.0 for k in range(1, len(conditions) + 1)}
    k = max(worth, key=lambda k: (worth[k], -k))
    return Rule(conditions[:k], False, row[f"na{k}"], row[f"ba{k}"])


def apply(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds ``kept``: false where the base rules fail, else the verdict of the list."""
    return stats.withColumn("kept", ~F.col("base_failed") & rules.expression())
