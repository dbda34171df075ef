"""Learned decision lists on text statistics, emitted as ordered Spark conditions.

``with_statistics`` adds a struct of statistics to every row. ``learn`` fits
rules for the rejected class by sequential covering on labelled statistics:
grow a conjunction of thresholds by information gain on two thirds of the
rows, prune its last conditions on the other third, keep it while its pruned
precision holds, drop the rows it covers, repeat. ``verdict`` writes the list
as one CASE expression after the base rules.

Defined cases: null or empty text has no words and fails the base; a null
doc_id is kept as a row; repeated rows are judged alike; labels that are null
or of no document are ignored; several labels of a document must agree, else
it is not learned from; without labels of both classes the list is empty and
the base decides alone; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, U, begin, binary_column, bounded_batches, chunks, documents, mix, prefix_hash, span_hash, window_hashes, word_spans

#: Labelled documents that are learned from, at most: those with the smallest hashes of doc_id.
MAX_LABELLED = 12_000
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A rule is kept if at least so many of the pruning rows that it covers are of the rejected class.
MIN_PRECISION = 0.98
MIN_COVER = 8
MAX_RULES = 24
MAX_CONDITIONS = 4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct", "n_dup_words_run"]
#: Ratios of the counts that rules may test: name, numerator, denominator.
RATIOS = [
    ("symbols_per_word", "n_symbols", "n_words"), ("chars_per_word", "word_chars", "n_words"), ("repeat_share", "n_repeat_words", "n_words"), ("distinct_share", "n_distinct", "n_words"),
    ("upper_share", "n_upper", "word_chars"), ("digit_share", "n_digits", "word_chars"), ("mark_share", "n_marks", "word_chars"), ("dup_line_share", "n_dup_lines", "n_lines"),
    ("words_per_line", "n_words", "n_lines"), ("run_share", "n_dup_words_run", "n_words"), ("words", "n_words", None),
]

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_MARK = np.isin(np.arange(256), [b for b in range(33, 127) if not chr(b).isalnum()])
_START = (np.arange(256) & 0xC0) != 0x80  # not a continuation byte


def statistics(col: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each row of a binary column."""
    parts: dict[str, list] = {k: [] for k in COUNTS}
    for _, _, data, offs in chunks(col):
        n = len(offs) - 1
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
        starts, ends, first = word_spans(data, offs)
        of_word = np.repeat(np.arange(n), np.diff(first))
        words = np.diff(first)
        prefix = prefix_hash(data)
        h = span_hash(prefix, starts, ends)
        here = {
            "n_words": words, "word_chars": sums(_START[data] & ~_SPACE[data]), "n_symbols": sums(_SYMBOL[data]), "n_chars": sums(_START[data]),
            "n_upper": sums(_UPPER[data]), "n_digits": sums(_DIGIT[data]), "n_marks": sums(_MARK[data]), "n_distinct": _distinct(of_word, h, n),
        }
        same = np.zeros(len(h), np.int64)
        same[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
        here["n_dup_words_run"] = np.bincount(of_word, same, n).astype(np.int64)
        # lines: cut at \n and at row ends, only those with a word
        line_lo = np.unique(np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1]))
        line_lo = line_lo[line_lo < len(data)]
        line_hi = np.concatenate([line_lo[1:], [len(data)]]) if len(line_lo) else line_lo
        line_hi = line_hi - (data[line_hi - 1] == 10) if len(line_lo) else line_hi
        with_word = np.searchsorted(starts, line_hi) > np.searchsorted(starts, line_lo)
        lo, hi = line_lo[with_word], line_hi[with_word]
        of_line = np.searchsorted(offs, lo, "right") - 1
        here["n_lines"] = np.bincount(of_line, minlength=n)
        here["n_dup_lines"] = here["n_lines"] - _distinct(of_line, span_hash(prefix, lo, hi), n)
        here["n_repeat_words"] = _repeated(h, of_word, n)
        for k in COUNTS:
            parts[k].append(np.asarray(here[k], np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes in each row."""
    key = mix(h ^ mix(row.astype(U) + U(1)))
    _, at = np.unique(key, return_index=True)
    return np.bincount(row[at], minlength=n)


def _repeated(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that lie in a window that the row holds twice or more."""
    m = len(h) - WINDOW + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    inside = row[WINDOW - 1 :] == row[:m]
    key = mix(window_hashes(h, WINDOW) ^ mix(row[:m].astype(U) + U(1)))
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    k = key[order]
    equal = k[1:] == k[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    found = order[twice]
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, found + WINDOW, -1)
    return np.bincount(row, np.cumsum(step[:-1]) > 0, n).astype(np.int64)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """docs and a struct column name of COUNTS; nothing is shuffled."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality_rules")
        for batch in batches:
            got = statistics(binary_column(batch, "text"))
            struct = pa.StructArray.from_arrays([pa.array(got[k]) for k in COUNTS], COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*names, name])

    from pyspark.sql.types import LongType, StructField, StructType

    kind = StructType([StructField(k, LongType()) for k in COUNTS])
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, kind)]))


# --------------------------------------------------------------------------- learning


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.ratio] > self.threshold if self.above else x[self.ratio] <= self.threshold

    def column(self, stats: str) -> Column:
        c = ratio_column(stats, self.ratio)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = list[Condition]


def ratio_column(stats: str, ratio: str) -> Column:
    _, a, b = next(r for r in RATIOS if r[0] == ratio)
    c = F.col(f"`{stats}`.{a}").cast("double")
    return c if b is None else c / F.greatest(F.col(f"`{stats}`.{b}"), F.lit(1))


def ratios(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {name: counts[a].astype(float) / (1 if b is None else np.maximum(counts[b], 1)) for name, a, b in RATIOS}


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FOIL gain of narrowing a rule from (p0, n0) to (p, n) covered rows of either class."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    rule, left = [], np.ones(len(y), bool)
    while len(rule) < MAX_CONDITIONS and (left & ~y).any():
        best = (1e-9, None)
        p0, n0 = int((left & y).sum()), int((left & ~y).sum())
        for name, values in x.items():
            v = values[left]
            order = np.argsort(v, kind="stable")
            v, c = v[order], y[left][order]
            ends = np.flatnonzero(v[1:] != v[:-1])  # last row of each distinct value but the greatest
            if not len(ends):
                continue
            p, n = np.cumsum(c)[ends], np.cumsum(~c)[ends]
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                g = _gain(p0, n0, pp, nn)
                i = int(np.argmax(g))
                if g[i] > best[0]:
                    best = (g[i], Condition(name, above, float((v[ends[i]] + v[ends[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        left &= best[1].holds(x)
    return rule


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule with the best worth on pruning rows, its precision and cover there."""
    best = ([], -2.0, 0.0, 0)
    for k in range(1, len(rule) + 1):
        c = _covered(rule[:k], x, len(y))
        p, n = int((c & y).sum()), int((c & ~y).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[1]:
            best = (rule[:k], worth, p / (p + n) if p + n else 0.0, p)
    return best[0], best[2], best[3]


def learn(counts: dict[str, np.ndarray], rejected: np.ndarray, part: np.ndarray) -> list[Rule]:
    """An ordered list of rules for the rejected class. part: a hash of each row; a third of them prune."""
    x, y, prunes = ratios(counts), np.asarray(rejected, bool), part % 3 == 0
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    while len(rules) < MAX_RULES and (left & y & ~prunes).any() and (left & ~y).any():
        of = lambda rows: {k: v[rows] for k, v in x.items()}
        grow, prune = left & ~prunes, left & prunes
        rule = _grow(of(grow), y[grow])
        if not rule:
            break
        rule, precision, cover = _prune(rule, of(prune), y[prune])
        if not rule or precision < MIN_PRECISION or cover < MIN_COVER:
            break
        rules.append(rule)
        left &= ~_covered(rule, x, len(y))
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Statistics, rejected class and hash of at most limit labelled documents (whole texts)."""
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    chosen = lab.select(F.col("doc_id").alias("key"), "q", F.xxhash64("doc_id").alias("part")).orderBy("part", "key").limit(limit)
    # limit rows of 24 bytes: a proven bound for the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("key")).select("text", "q", "part")
    got = with_statistics(rows, "stats").select("stats.*", "q", "part").orderBy("part", "n_chars", "q").limit(limit).collect()
    counts = {k: np.array([r[k] for r in got], np.int64) for k in COUNTS}
    return counts, np.array([r["q"] == 0 for r in got], bool), np.array([r["part"] for r in got], np.int64).view(np.uint64)


def base_failed(stats: str) -> Column:
    s = lambda k: F.col(f"`{stats}`.{k}")
    return (s("n_words") < MIN_WORDS) | (100 * s("n_repeat_words") > REPEAT_PERCENT * s("n_words"))


def verdict(rules: list[Rule], stats: str) -> Column:
    """Whether a row is kept: the base, then the rules in order, then yes."""
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        out = out.when(_all(rule, stats), F.lit(False))
    return out.otherwise(F.lit(True))


def deciding_rule(rules: list[Rule], stats: str) -> Column:
    """Number of the rule that rejects a row: 0 for the base, from 1 for learned rules, null if none."""
    out = F.when(base_failed(stats), F.lit(0))
    for i, rule in enumerate(rules):
        out = out.when(_all(rule, stats), F.lit(i + 1))
    return out


def _all(rule: Rule, stats: str) -> Column:
    c = F.lit(True)
    for condition in rule:
        c = c & condition.column(stats)
    return c


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counted statistics, base_failed, kept, rule, a row per document."""
    rules = learn(*training_rows(docs, labels))
    got = with_statistics(docs.select("doc_id", "text"), "stats").drop("text")
    return got.select("doc_id", *[F.col(f"stats.{k}").alias(k) for k in COUNTS[:5]], base_failed("stats").alias("base_failed"), verdict(rules, "stats").alias("kept"), deciding_rule(rules, "stats").alias("rule"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the base and the learned rules keep."""
    rules = learn(*training_rows(docs, labels))
    name = free_name(docs, "quality_statistics")
    return with_statistics(docs, name).where(verdict(rules, name)).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
