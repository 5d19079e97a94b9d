"""Operator 9, quality rules as a learned decision list.

Statistics of every whole text come first. Sequential covering then grows conjunctions of thresholds that part bad from
good labelled documents (by information gain on two thirds of the sample), prunes each on the other third, removes what it
covers and goes on until no rule is precise enough. The list becomes one ordered conditional expression over the
statistics' columns.

Learning takes ``MOST_ROWS`` labelled rows at most, chosen by a hash of doc_id; the statistics and the
verdicts cover all rows.

Nulls and edge cases: null text has no words and fails the base rule; null labels or doc_ids aren't learned from, nor are
rows that fail the base rule; without labels the base rule alone decides; repeated rows are judged each; empty tables give
empty results. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import BLANKS, read, small_batches
from eventloom.shared import materialize

MOST_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits"]

#: Features of a document: name, numerator, denominator (none: the count itself).
FEATURES = [
    ("words", "n_words", None),
    ("word_length", "word_chars", "n_words"),
    ("symbol_rate", "n_symbols", "word_chars"),
    ("dup_line_rate", "n_dup_lines", "n_lines"),
    ("repeat_rate", "n_repeat_words", "n_words"),
    ("upper_rate", "n_upper", "word_chars"),
    ("digit_rate", "n_digits", "word_chars"),
]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    w = (h[:-2] * _A ^ h[1:-1]) * _B
    w = (w ^ (w >> np.uint64(29))) * _A + h[2:]
    order = np.argsort(w, kind="stable")
    equal = np.diff(w[order].view(np.int64)) == 0
    if not equal.any():
        return 0
    twice = np.zeros(len(w), dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(len(words), dtype=bool)
    for j in range(3):
        covered[j : j + len(w)] |= twice
    return int(covered.sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), sum(map(text.count, _UPPER)), sum(map(text.count, _DIGITS)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(t) for t in batch.column("text").to_pylist()]
            cols = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *COUNTS])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """feature >= limit, or feature < limit."""

    feature: int
    above: bool
    limit: float

    def on(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return v >= self.limit if self.above else v < self.limit

    def column(self) -> Column:
        _, over, under = FEATURES[self.feature]
        value = F.col(over).cast("double") if under is None else F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))
        return value >= self.limit if self.above else value < self.limit

    def __str__(self) -> str:
        return f"{FEATURES[self.feature][0]} {'>=' if self.above else '<'} {self.limit:.6g}"


def covers(rule: list[Test], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for test in rule:
        out &= test.on(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most_tests: int = 4, cuts: int = 48) -> list[Test]:
    """Adds the test with the largest gain until the rule covers no good document or nothing gains."""
    rule: list[Test] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < most_tests and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        before, best, chosen = np.log2(p0 / (p0 + n0)), 1e-9, None
        for k in range(x.shape[1]):
            v = x[inside, k]
            for limit in np.unique(np.quantile(v, np.linspace(0, 1, cuts))):
                for above in (True, False):
                    hit = v >= limit if above else v < limit
                    p = bad[inside][hit].sum()
                    if p:
                        gain = p * (np.log2(p / hit.sum()) - before)
                        if gain > best:
                            best, chosen = gain, Test(k, above, float(limit))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= chosen.on(x)
    return rule


def _prune(rule: list[Test], x: np.ndarray, bad: np.ndarray) -> list[Test]:
    """Drops last tests while the rule doesn't get worse on data it wasn't grown on."""

    def worth(r: list[Test]) -> float:
        hit = covers(r, x)
        return (2 * bad[hit].sum() - hit.sum()) / max(1, hit.sum())

    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, least: int = 8, most_rules: int = 12) -> list[list[Test]]:
    """The decision list: each rule covers at least ``least`` of the rows that are left, bad ones at this precision."""
    rules: list[list[Test]] = []
    rng = np.random.default_rng(0)
    while len(rules) < most_rules and bad.sum() >= least:
        grow = rng.random(len(x)) < 2 / 3
        rule = _prune(_grow(x[grow], bad[grow]), x[~grow], bad[~grow])
        hit = covers(rule, x) if rule else np.zeros(len(x), dtype=bool)
        if hit.sum() < least or bad[hit].mean() < precision:
            break
        rules.append(rule)
        x, bad = x[~hit], bad[~hit]
    return rules


def fit(stats: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> list[list[Test]]:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    joined = materialize(stats.filter(~base_failed()).join(known, "doc_id").select(*COUNTS, "quality", F.xxhash64("doc_id").alias("h")), "labelled")
    # the share of hashes first, so that each task has its part of the sample and not a whole one to sort
    share = min(1.0, 1.1 * most_rows / max(1, joined.count()))
    rows = joined.filter(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * share)).orderBy("h", *COUNTS, "quality").limit(most_rows).collect()
    if not rows:
        return []
    at = {c: np.array([r[c] for r in rows], dtype=float) for c in COUNTS}
    x = np.stack([at[a] if b is None else np.divide(at[a], at[b], out=np.zeros(len(rows)), where=at[b] > 0) for _, a, b in FEATURES], axis=1)
    return learn(x, np.array([r["quality"] == 0 for r in rows]))


def verdict(rules: list[list[Test]]) -> Column:
    """The number of the first rule that covers a row (from 1); 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for t in rule:
            test = test & t.column()
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule and kept of each document."""
    stats = materialize(statistics(docs), "statistics", wide=True)
    return stats.withColumns({"base_failed": base_failed(), "rule": verdict(fit(stats, labels))}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
