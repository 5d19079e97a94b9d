import hashlib
import math
import random
import re

from eventloom.llm import pii as P
from eventloom.llm.common import read

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(2)
    parts = ["a@b.co", "x_y@e.f", "@", "@@", ".", "..", "1.2.3.4", "256.1.1.1", "10.0.0.1.", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-9999", "+", "+4", " ", "-", "é", "word", "0012.1.1.9", "5", "12345678901234", "_d@e-f.g", "\n", "(", ")", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert P.base_spans(text) == plain(text), text
    assert [x[2] for x in P.base_spans("0" * 5000 + "1.2.3.4 " + "0" * 5000 + "256.2.3.4 " + "9" * 5000 + ".1.1.1")] == ["ip"]
    for text in ("9" * 200_000, "a" * 200_000, "1." * 100_000, "+1" * 50_000, "a@" * 50_000):
        P.base_spans(text)


def test_redaction_leaves_no_base_span():
    for text in ("mail a@b.co now", "4111 1111 1111 1111 and +1 (555) 010-9999", "1.2.3.4.5.6.7.8", "no data"):
        assert not plain(P.redact(text))
    assert P.redact("call +1 555 010 9999!") == "call [PHONE]!" and P.redact("no data") == "no data"
    assert P.redact("id K-12345 x", [(3, 10, "ctx")]) == "id [CTX] x"


def test_context_is_whole_words_only():
    assert P._pattern("x" * 90 + " call me: ", 100) == "call me" and P._pattern("x" * 90 + "call me ", 98) == "me" and P._pattern("a" * 500, 500) == ""
    assert P._pattern("Позвони_мне: по 電話、 ", 21) == "по 電話" and P._pattern("nr.12 ", 6) == "nr00" and P._pattern("", 0) == ""
    spans = P.base_spans("AB-123456,1.2.3.4 1.2.3.4-AB12345 ZZ-123456")
    assert [x[:2] for x in P.mentions("one two AB-12345", []) if not x[4]] == [(8, 16)]
    assert [("AB-123456,1.2.3.4 1.2.3.4-AB12345 ZZ-123456")[a:b] for a, b, *_, seed in P.mentions("AB-123456,1.2.3.4 1.2.3.4-AB12345 ZZ-123456", spans) if not seed] == ["ZZ-123456"]


def plain_scores(texts, rounds=3, seeds=5, least=0.6):
    """The accepted patterns by the rules of the docstring, in plain dictionaries."""
    n, seed = {}, {}
    for t in texts:
        for _, _, p, i, s in P.mentions(t, P.base_spans(t)):
            n[p, i] = n.get((p, i), 0) + 1
            seed[p, i] = seed.get((p, i), False) or s
    score = {i: float(any(seed[e] for e in n if e[1] == i)) for _, i in n}
    known = {i: score[i] == 1.0 for i in score}
    for k in range(rounds):
        total, good = {}, {}
        for p in {p for p, _ in n}:
            w = {i: math.log1p(n[p, i]) for q, i in n if q == p}
            total[p] = sum(score[i] * x for i, x in w.items()) / (sum(w.values()) + 0.5)
            good[p] = total[p] >= least and sum(known[i] for i in w) >= seeds
        if k < rounds - 1:
            for i in list(score):
                w = {p: math.log1p(n[p, j]) for p, j in n if j == i}
                certain = any(seed[p, i] for p in w)
                score[i] = 1.0 if certain else sum(total[p] * x for p, x in w.items()) / sum(w.values())
                known[i] = certain or any(good[p] for p in w)
    return {p: total[p] for p in good if good[p]}


def test_scoring_equals_brute_force_on_small_graphs(spark):
    rng = random.Random(9)
    accepted = 0
    for _ in range(6):
        contexts = [f"w{chr(97 + i)} v{chr(97 + i)}" for i in range(5)]
        handles = [f"H-{1000 + i}" for i in range(8)]
        texts = [f"{rng.choice(contexts[: rng.choice((2, 5))])} {rng.choice([f'u{rng.randrange(12)}@m.example', rng.choice(handles)])}" for _ in range(150)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.pattern: r.score for r in P.good_patterns(P.scan(df)).collect()}
        want = plain_scores(texts)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)
        accepted += len(got)
    assert accepted


def _corpus(spark):
    rng = random.Random(7)
    rows = [(i, f"please reach me at user{rng.randrange(10**6)}@mail.example and thanks", "r") for i in range(40)]
    rows += [(100 + i, f"please reach me at HANDLE-{rng.randrange(10**6)} and thanks", "r") for i in range(6)]
    rows += [(200 + i, f"the order number {rng.randrange(10**6)} was shipped", "r") for i in range(40)]
    rows += [(300, None, "r"), (301, "", None), (None, "at 1.2.3.4", "r"), (302, "x@y.zz " * 3000, "r"), (302, "x@y.zz " * 3000, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, pattern string")


def test_patterns_discover_unseen_identifiers(spark):
    got = {r.doc_id: r for r in P.find(_corpus(spark)).collect()}
    assert all([s.kind for s in got[100 + i].spans] == ["ctx"] and not got[100 + i].base for i in range(6))
    assert all(not got[200 + i].spans for i in range(40)) and not got[300].spans and not got[301].spans
    assert len(got[302].base) == 3000 and [s.kind for s in got[None].spans] == ["ip"]
    assert P.find(_corpus(spark).limit(0)).count() == 0


def _found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [s.kind for s in r.spans] for r in P.find(rows).collect()}


def test_found_identifiers_support_another_context(spark):
    seeded = [f"please reach me at u{i}@mail.example now" for i in range(100)]
    handles = [f"HANDLE-{1000 + i}" for i in range(12)]
    texts = [*seeded, *(f"please reach me at {h} now" for h in handles for _ in range(8)), *(f"my secret badge {h} here" for h in handles), "my secret badge OTHER-77777 here"]
    got = _found(spark, texts)
    assert got[len(texts) - 1] == ["ctx"] and got[len(texts) - 2] == ["ctx"]


def test_a_number_common_to_unseeded_contexts_is_no_evidence(spark):
    seeds = [f"write back to u{i}@mail.example now" for i in range(5)]
    common = [f"{n} pieces" for n in (10001, 10002, 10003, 10004)]
    texts = [*seeds, *(f"write back to {c}" for c in common), *(f"plain {a}{b} word {c}" for a in "abcde" for b in "wxyz" for c in common)]
    got = _found(spark, texts)
    assert all(got[i] == ["email"] for i in range(5)) and not any(got[i] for i in range(5, len(texts)))


def test_stage_redacts_and_keeps_columns(spark, tmp_path):
    _corpus(spark).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = P.redact_documents(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[100] == "please reach me at [CTX] and thanks" and got[0] == "please reach me at [EMAIL] and thanks"
    assert got[300] is None and got[301] == "" and got[None] == "at [IP]" and "order number" in got[200]
    assert out.count() == docs.count()


def test_query_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = P.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_card == sum(k == "card" for *_, k in want)
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_ordinary_words_after_a_context_count_against_it(spark):
    seeded = [f"and then the u{i}@m.example end" for i in range(40)]
    handles = [f"and then the H-{i}234 end" for i in range(6)]
    assert all(_found(spark, seeded + handles)[40 + i] == ["ctx"] for i in range(6))
    anything = [f"and then the {a}{b}q end" for a in "abcdefgh" for b in "klmnopqrs"]
    got = _found(spark, seeded + handles + anything)
    assert all(got[i] == ["email"] for i in range(40)) and not any(got[i] for i in range(40, len(got)))


def test_contexts_of_any_script(spark):
    seeded = [f"напишите мне на u{i}@m.example скорее" for i in range(20)]
    got = _found(spark, [*seeded, "напишите мне на H-1234 скорее", "и вот на H-9234 скорее"])
    assert got[20] == ["ctx"] and got[21] == []


def test_ordinary_uses_equal_a_plain_count(spark, monkeypatch):
    rng = random.Random(4)
    vocab = ["the", "The", "of,", "a", "b2", "x1y2", "--", "ñandú", "12", "me@x.yz", "w" * 78, "v" * 90, "…", "end.", "Q"]
    texts = ["", None, "one", *(" ".join(rng.choice(vocab) for _ in range(rng.randrange(60))) for _ in range(80))]
    want, patterns = {}, set()
    for t in texts:
        for m in re.finditer(r"\S+", t or ""):
            p, w = P._pattern(t, m.start()), m.group().lower()
            if p:
                patterns.add(p)
                if "@" not in w and re.search(r"[^\W\d_]", w) and not re.search(r"\d", w):
                    want[p] = want.get(p, 0) + 1
    docs, some = spark.createDataFrame([(t,) for t in texts], "text string"), sorted(patterns)[::2]
    for most in (P._GATHERED, 3):
        monkeypatch.setattr(P, "_GATHERED", most)
        for asked in (patterns, some):
            got = {r.pattern: r.ordinary for r in P.ordinary_uses(docs, spark.createDataFrame([(p,) for p in asked], "pattern string")).collect()}
            assert got == {p: n for p, n in want.items() if p in asked} and len(got) > 20
    assert P.ordinary_uses(docs, spark.createDataFrame([], "pattern string")).count() == 0
