import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventloom.llm import exact_dedup as E
from eventloom.llm.common import BLANKS, Bloom, keep_absent, keep_present, read


def plain(rows):
    by = {}
    for key, text in rows:
        norm = "".join(c for c in text or "" if c not in BLANKS)
        by.setdefault(norm, []).append((-len(text or ""), key is None, key or 0, key))
    out = []
    for norm, group in by.items():
        keep = min(group)[3]
        out += [(str(key), str(keep), len(group), hashlib.sha256(norm.encode()).hexdigest()) for *_, key in group]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a", "b", "é", " ", "\n", "\t", "\x0b", " "]) for _ in range(rng.randrange(7)))) for i in range(3000)]
    rows += [(5000 + i, "same text" + " " * (i % 3)) for i in range(900)] + [(None, "same  text   "), (None, "alone"), (7000, None), (7001, ""), (7002, " \n"), (7003, "long " * 60_000)]
    docs = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, hit string")
    got = E.decide(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == plain(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    stay = E.drop_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(r.doc_id) for r in kept)


def test_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame([(1, "x")] * 5, "doc_id long, text string")
    got = E.decide(docs).collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {5} and E.drop_copies(docs).count() == 1
    assert E.decide(docs.limit(0)).count() == 0 and E.drop_copies(docs.limit(0)).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(4000).select((F.col("id") % 3000).alias("k"))
    bloom = Bloom(4000).of_repeated(keys, "k")
    hits = bloom.probe(keys, F.col("k"), "cell_a").groupBy("k").agg(F.max("cell_a").alias("hit"), F.count("*").alias("n")).collect()
    assert all(r.hit for r in hits if r.n > 1) and sum(r.hit for r in hits if r.n == 1) < 0.1 * 3000
    some = spark.range(0, 4000, 7).select(F.col("id").alias("k"))
    assert keep_absent(keys, "k", some, 600).count() == keys.join(some, "k", "left_anti").count()
    assert keep_present(keys, "k", some, 600).count() == keys.join(some, "k").count()


@pytest.mark.parametrize("most", [1 << 28, 1 << 15])
def test_few_false_hits_whatever_may_be_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(Bloom, "MOST_BITS", most)
    keys = spark.range(10_000).select(F.when(F.col("id") < 9000, F.col("id")).otherwise(F.col("id") % 500).alias("k"))
    probed = Bloom.of_repeated(keys, "k").probe(keys, F.col("k"), "hit")
    assert ("broadcast" in probed._jdf.queryExecution().optimizedPlan().toString()) == (most > 1 << 20)
    once = probed.filter("k >= 500")
    assert once.filter("hit").count() < 0.05 * once.count() and probed.filter("k < 500 AND NOT hit").isEmpty()
    some = spark.range(0, 10_000, 2).select(F.col("id").alias("k"))
    absent = Bloom(some.count()).of_keys(some, "k").probe(spark.range(20_000).select(F.col("id").alias("k")), F.col("k"), "hit")
    assert absent.filter("hit AND (k % 2 = 1 OR k >= 10000)").count() < 0.05 * 15_000 and absent.filter("NOT hit AND k % 2 = 0 AND k < 10000").isEmpty()


def test_results_without_broadcast(spark, monkeypatch):
    want = sorted(map(str, E.decide(read(spark, "/root/testdata/sf0.01", "documents")).collect()))
    monkeypatch.setattr(Bloom, "MOST_BITS", 0)
    assert sorted(map(str, E.decide(read(spark, "/root/testdata/sf0.01", "documents")).collect())) == want


def test_smallest_number_and_ties(spark, tmp_path):
    low = -(1 << 63)
    rows = [(low, "a b", "x"), (5, "a b", "y"), (7, "t t", "first"), (7, "tt ", "second"), (7, "t t", "third"), (None, "a b", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert {r.keep_id for r in E.decide(docs).collect()} == {low, 7}
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted(r["odd.name"] for r in E.drop_copies(docs).collect()) == ["first", "x"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
