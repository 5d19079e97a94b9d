import math
import random
import re

import numpy as np

from eventloom.llm import quality as Q
from eventloom.llm.common import read

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    inside = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines, dup = (text or "").split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(WORD.search(line)) and line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_statistics_equal_the_plain_rules():
    rng = random.Random(1)
    parts = ["a", "b", "é", "##", " ", "\n", "\n", "\t", "\x0b", "\x1c", " ", "|", "x y z"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) + rng.choice((" ", "")) for _ in range(rng.randrange(40)))
        assert Q.statistics_of(text)[:5] == plain(text), repr(text)
    assert Q.statistics_of(None)[:5] == plain(None) and Q.statistics_of("a " * 100_000)[4] == 100_000


def test_learner_finds_planted_rules():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(Q.FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 5] > 0.7) & (x[:, 1] < 0.3))
    rules = Q.learn(x, bad)
    found = np.zeros(len(x), dtype=bool)
    for rule in rules:
        found |= Q.covers(rule, x)
    assert (found == bad).mean() > 0.97 and (found & ~bad).mean() < 0.01
    assert Q.learn(x, np.zeros(len(x), dtype=bool)) == [] and Q.learn(x[:, :], rng.random(3000) < 0.5) == []


def test_expression_equals_the_rules_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" + ("#" * rng.randrange(4) if i % 3 == 0 else "") for _ in range(60 + i % 9)), "s", 0) for i in range(300)]
    rows += [(900, None, "s", 1), (901, "", "s", 1), (None, "a b " * 60, "s", 1), (902, "x" * 9 + " q", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 300, 2)] + [(None, 0), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    assert len(got) == len(rows) and not got[900].kept and not got[None].kept and got[901].n_words == 0
    assert sum(got[i].kept == (i % 3 != 0) for i in range(300)) > 285
    alone = {r.doc_id: r for r in Q.judge(docs, labels.limit(0)).collect()}
    assert all(r.kept != r.base_failed for r in alone.values())
    assert Q.judge(docs.limit(0), labels).count() == 0


def test_verdicts_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    got = Q.query(spark, sf).filter("NOT base_failed").collect()
    good = [r.kept for r in got if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in got if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def _plain_gain(x, bad, k, limit, above):
    """FOIL's gain of one more test, counted row by row."""
    p0, n0 = sum(map(bool, bad)), sum(not b for b in bad)
    hit = [b for v, b in zip(x[:, k], bad) if (v >= limit if above else v < limit)]
    p = sum(map(bool, hit))
    return p * (math.log2(p / len(hit)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def test_each_test_grown_has_the_largest_gain():
    rng = np.random.default_rng(3)
    for _ in range(8):
        x = rng.integers(0, 6, (60, len(Q.FEATURES))).astype(float)
        bad = (x[:, 1] >= 3) & (x[:, 4] < 2) | (rng.random(60) < 0.1)
        inside = np.ones(60, dtype=bool)
        for t in Q._grow(x, bad):
            every = [_plain_gain(x[inside], bad[inside], k, v, above) for k in range(x.shape[1]) for v in set(x[inside, k]) for above in (True, False)]
            assert abs(_plain_gain(x[inside], bad[inside], t.feature, t.limit, t.above) - max(every)) < 1e-9
            inside &= t.on(x)


def test_pruning_keeps_the_best_prefix():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x, bad = rng.integers(0, 5, (40, len(Q.FEATURES))).astype(float), rng.random(40) < 0.5
        rule = [Q.Test(int(rng.integers(len(Q.FEATURES))), bool(rng.integers(2)), float(rng.integers(5))) for _ in range(4)]
        worth = []
        for n in range(1, 5):
            hit = [b for row, b in zip(x, bad) if all((row[t.feature] >= t.limit) == t.above for t in rule[:n])]
            worth.append((2 * sum(map(bool, hit)) - len(hit)) / max(1, len(hit)))
        assert Q._prune(rule, x, bad) == rule[: worth.index(max(worth)) + 1]


def test_rules_are_ordered_by_what_was_left(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (600, len(Q.FEATURES))).astype(float)
    bad = (x[:, 2] >= 7) | ((x[:, 5] < 2) & (x[:, 2] < 7))
    rules = Q.learn(x, bad)
    assert len(rules) >= 2
    left = np.ones(len(x), dtype=bool)
    for rule in rules:
        hit = Q.covers(rule, x) & left
        assert hit.sum() >= 8 and bad[hit].mean() >= 0.9
        left &= ~hit
