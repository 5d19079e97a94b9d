import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import language as L
from eventloom.llm.common import read


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    texts = [rng.normal(size=(n, 3)).astype(np.float32) * 3 for n in (0, 1, 2, 5, 6, 4)]
    for got, s in zip(L.viterbi(texts, 2.0), texts):
        def worth(p):
            return sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        if len(s):
            assert abs(worth(got) - max(worth(p) for p in itertools.product(range(3), repeat=len(s)))) < 1e-4


def _docs(spark):
    rng, words = random.Random(1), {"aa": ["tion", "house", "the", "water"], "bb": ["eau", "maison", "étè", "le"], "cc": ["вода", "дом", "мир", "язык"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "x") for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    mixed = " ".join(["house water the tion"] * 6 + ["maison eau le étè"] * 5)
    return spark.createDataFrame(rows + [(1000, mixed, None, "s"), (1001, None, "aa", "s"), (1002, "12 34 !!", "aa", "s"), (None, "вода", "bb", None), (1003, "", None, "s"), (1003, "the " * 30000, "aa", "s")], "doc_id long, text string, lang string, score string")


def test_labels_spans_and_edges(spark):
    docs = _docs(spark)
    got = {(r.doc_id, r.lang_pred): r for r in L.label(docs, L.train(docs)).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert by[1000].lang_pred == "aa" and [s.lang for s in by[1000].spans] == ["aa", "bb"] and by[1000].spans[0].start == 0
    text = docs.filter("doc_id = 1000").first().text
    assert text[by[1000].spans[1].start : by[1000].spans[1].end].split()[0] == "maison" and by[1000].spans[1].end == len(text)
    assert by[1001].lang_pred == by[1002].lang_pred == "und" and by[None].lang_pred == "cc"
    assert (1003, "und") in got and (1003, "aa") in got
    kept = {r.doc_id for r in L.keep_known(docs).collect()}
    assert 1001 not in kept and 1002 not in kept and set(range(180)) <= kept


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.label(docs, L.train(docs)).collect()] == [("und", 0.0)]
    assert L.label(docs.limit(0), L.train(docs.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = L.query(spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id").filter("lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_stage_drops_what_no_learned_language_has(spark):
    english, german = "the small ring was under the old house and they went home", "der kleine Ring war unter dem alten Haus und sie gingen heim"
    rows = [(i, (english, german)[i % 2], ("en", "de")[i % 2]) for i in range(40)]
    rows += [(100, "это текст на другом языке и его никто не учил", "ru?"), (101, english + " слово" * 4, None), (102, english + " словослово" * 20, None), (103, english, None)]
    docs = spark.createDataFrame([(i, t, None if i >= 100 else c) for i, t, c in rows], "doc_id long, text string, lang string")
    got = {r.doc_id for r in L.keep_known(docs).collect()}
    assert got == {*range(40), 101, 103}


def test_scores_equal_plain_counts(spark):
    """The model's score of a word is the sum of its n-grams' log shares, a third of each, for languages of its script."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aba abba", "x"), ("aba cab", "x"), ("bcb ccb", "y"), ("bcb bab", "y"), ("жук жук", "z"), ("жар жук", "z")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("doc_id", F.expr("element_at(filter(sequence(doc_id * 100, doc_id * 100 + 99), d -> crc32(cast(d AS string)) % 4 <> 2), 1)"))
    model = L.train(df)

    def grams(word):
        w = f"\n{word}\n"
        out = [w[i : i + 1] for i in range(1, len(w) - 1)] + [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]
        return out + [w[i : i + 4] for i in range(len(w) - 3) if len(w) >= 4]

    counts = {lang: Counter() for lang in "xyz"}
    for _, text, lang in rows:
        for word in text.split():
            counts[lang].update(grams(word))
    known = set().union(*({g for g, n in c.items() if n > 1} for c in counts.values()))
    words = ["aba", "bcb", "cab", "abba", "жук", "жар"]
    _, _, got = model.score(words)
    for word, scores in zip(words, got):
        want = []
        for lang in "xyz":
            total = sum(n for n in counts[lang].values() if n > 1)
            s = sum(math.log((counts[lang][g] * (counts[lang][g] > 1) + 0.1) / (total + 0.1 * len(known))) / 3 for g in grams(word) if g in known)
            want.append(s - 60 * ((lang == "z") != (word[0] > "z")))
        assert np.allclose(scores, np.array(want) - max(want), atol=1e-3), word
