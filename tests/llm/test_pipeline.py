"""The pipeline against brute force: who stays is decided by the operators' own plain versions."""

import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline as P
from eventloom.llm import language, pii
from eventloom.llm.common import BLANKS, read
from eventloom.llm.wordmemo import load_tokenizer
from tests.llm.test_near_dedup import brute

ROOT = "/root/testdata/sf0.001"


def test_run_equals_the_stages_by_hand(spark):
    docs = read(spark, ROOT, "documents")
    known = {r.doc_id for r in language.label(docs, language.train(docs)).filter("lang_pred <> 'und' AND score >= 0.4").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in known}
    best = {}
    for key, text in rows.items():
        norm = "".join(c for c in text or "" if c not in BLANKS)
        best[norm] = min(best.get(norm, (1, 0)), (-len(text or ""), key))
    rows = {key: rows[key] for _, key in best.values()}
    stay = {key for key, _, low in brute(list(rows.items())) if key == low}
    tok, want = load_tokenizer(public_tokenizers.path("word_bpe_49k.json")), []
    for key in stay:
        ids = [*tok.encode(pii.redact(rows[key]), add_special_tokens=False).ids, 0]
        want += [(key, p, s, len(c := ids[s : s + 2048]), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    got = P.run(spark, ROOT).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)


def test_stages_keep_columns_and_stand_odd_tables(spark, tmp_path):
    odd = spark.createDataFrame([(1, "the house of the water " * 9, "en", "s", 5, True), (1, "the house of the water " * 9, "en", "s", 5, True), (None, None, None, None, None, None), (2, "", "en", "s", 0, None), (3, "x" * 50_000, "en", "s", 1, False), (4, "le éau de maison à la " * 20, "fr", None, 1, True)], "doc_id long, text string, lang string, source string, n_chars long, hit boolean")
    for name, table in (("odd", odd), ("empty", odd.limit(0))):
        at = str(tmp_path / name)
        table.write.parquet(at)
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, spark.read.parquet(at), ROOT)
            assert k == len(P.STAGES) - 1 or out.columns == odd.columns
            at = str(tmp_path / f"{name}{k}")
            out.write.parquet(at)
        assert (spark.read.parquet(at).count() > 0) == (name == "odd")
