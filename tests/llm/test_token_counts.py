import random

import numpy as np
import public_tokenizers
import pytest

from eventloom.llm import token_counts as C
from eventloom.llm.common import read

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(tok, text, sections, rule):
    offsets = tok.encode(text, add_special_tokens=False).offsets
    out, crossing = [0.0] * (len(sections) + 1), 0
    for a, b in offsets:
        homes = [next((i for i, (s, e) in enumerate(sections) if s <= c < e), len(sections)) for c in range(a, b)]
        crossing += len(set(homes)) > 1
        if rule == "start":
            out[homes[0]] += 1
        elif rule == "most":
            out[max(dict.fromkeys(homes), key=homes.count)] += 1
        else:
            for h in homes:
                out[h] += 1 / len(homes)
    return len(offsets), crossing, out


@pytest.mark.parametrize("rule", ["start", "most", "share"])
def test_equals_brute_force(rule):
    rng, spans = random.Random(3), C.Spans(PATH, most=30)
    parts = ["word", " ", "\n", "\n\n", "  ", "don't", "É", "😀", "日本", "12", "!?", "\t", "<|endoftext|>", "\x1c", "supercalifragilistic", " \n", "²", "_"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(20)]
        for t, words in zip(texts, spans.words(texts)):
            cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, rng.randrange(7))))
            for sections in (C.lines(t), np.array([(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if a < b], dtype=np.int64).reshape(-1, 2), np.array([(a, b) for a, b in zip(cuts, cuts[1:])], dtype=np.int64).reshape(-1, 2)):
                n, crossing, out = spans.count(t, words, sections, rule)
                want = plain(spans.tok, t, sections.tolist(), rule)
                assert (n, crossing) == want[:2] and np.allclose(out, want[2]), (t, sections)


def test_table_and_edges(spark):
    spans = C.Spans(PATH)
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in C.query(spark, "/root/testdata/sf0.01").collect():
        if r.doc_id % 10 == 0:
            n, crossing, out = plain(spans.tok, texts[r.doc_id], C.lines(texts[r.doc_id]).tolist(), "start")
            assert (r.n_tokens, r.n_crossing, list(r.section_tokens)) == (n, crossing, out[:-1])
    odd = spark.createDataFrame([(1, None, [(0, 1)], 1), (None, "", None, 1), (2, "ab cd", [(1, 4)], 1), (2, "ab cd", [(1, 4)], 1), (3, "é\n" * 20_000, None, 1)], "doc_id long, text string, sections array<struct<start: long, end: long>>, n_tokens int")
    got = C.attribute(odd, PATH, "sections", "share").collect()
    assert len(got) == 5 and [x.tokens for x in next(r for r in got if r.doc_id == 2).sections] == [pytest.approx(0.5 + 2 / 3)]
    assert C.by_section(C.attribute(odd, PATH)).filter("doc_id = 3").count() == 20_000 and C.attribute(odd.limit(0), PATH).count() == 0
