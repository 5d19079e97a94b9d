import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from eventloom.llm.packing import Plan, best_plan, pack, query
from eventloom.llm.wordmemo import Memo, load_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def _bytes(tok):
    return lambda xs: [np.array(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch(xs, add_special_tokens=False)]


def test_memo_equals_whole_texts():
    tok, rng = load_tokenizer(PATH), random.Random(4)
    parts = ["don't", "Été", "é", "ΣΑΣ", "x" * 90, "<|endoftext|>", "a<|startoftext|>b", "日本", "12,5", "ŉ", "́a", "İ", "We'LL", "it's!", "''s", "<b>", "<|", "A.B", "ÀÉ×ß", "_x_", "a" * 70, "ÿ9", "\x00", "!'t"]
    gaps = [" ", "\n", "\t", " ", "\x1c", " ", "  ", "\x85", "​", "\r\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randrange(30))) for _ in range(300)] + [None, "", " "]
    texts += ["".join(rng.choice([p for p in parts if p.isascii()]) + rng.choice(" \n\t") for _ in range(rng.randrange(30))) for _ in range(300)]
    memo = Memo(tok, most=5)
    for at in range(0, len(texts), 40):
        assert memo.ids(texts[at : at + 40]) == _bytes(tok)([t or "" for t in texts[at : at + 40]])


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_rank_once_without_overlap(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.randrange(1, 200) for _ in range(rng.randrange(1, 40))}
    plan = best_plan(counts, 64)
    used = {}
    for n, k in counts.items():
        slots = plan.slots[n]
        assert [s[0] for s in slots] == sorted({s[0] for s in slots}) and slots[0][0] == 0
        for (first, seq, off), end in zip(slots, [*[s[0] for s in slots[1:]], k]):
            for r in range(first, end):
                used.setdefault(seq + r - first, []).append((off, n))
    for spans in used.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 64
    assert sum(map(len, used.values())) == sum(counts.values())
    assert len(used) == plan.sequences


def test_never_more_sequences_than_best_fit_decreasing():
    for seed in range(500):
        rng = random.Random(seed)
        cap = rng.choice((64, 64, 256, 2048))
        counts = {rng.randrange(1, cap + 1): rng.randrange(1, rng.choice((4, 60))) for _ in range(rng.randrange(1, 30))}
        least = -(-sum(n * k for n, k in counts.items()) // cap)
        assert least <= best_plan(counts, cap).sequences <= len(_best_fit_decreasing(counts, cap))


def test_query_needs_no_more_than_best_fit_decreasing(spark):
    rows = query(spark, "/root/testdata/sf0.01").select("length", "sequence_id").collect()
    assert len({r.sequence_id for r in rows}) <= len(_best_fit_decreasing(Counter(r.length for r in rows), 2048))


def test_a_very_long_text(spark):
    tok = load_tokenizer(PATH)
    text = " ".join(f"w{i % 5003}" for i in range(300_000))
    got = sorted(pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect(), key=lambda r: r.piece)
    ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
    assert [(r.start, r.length, r.ids_crc32) for r in got] == [(s, len(c := ids[s : s + 2048]), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for s in range(0, len(ids), 2048)]
    assert len({r.sequence_id for r in got}) == len(got)


def residual(counts, capacity):
    """Best fit alone, without exact complements."""
    return Plan(counts, capacity, parts=0)


def _gaps(plan, counts):
    """The open space of each sequence."""
    gap = {}
    for n, k in counts.items():
        for (first, seq, _), end in zip(plan.slots[n], [*[s[0] for s in plan.slots[n][1:]], k]):
            for r in range(first, end):
                gap[seq + r - first] = gap.get(seq + r - first, plan.capacity) - n
    return sorted(gap.values())


def _best_fit_decreasing(counts, capacity):
    gaps = []
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        at = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - n)
    return gaps


_RESIDUALS = [({1500: 1, 100: 5}, 2048), ({1500: 1000, 100: 5000}, 2048), ({1500: 7, 100: 23, 48: 3}, 2048)]
for _rng in map(random.Random, range(60)):
    _RESIDUALS.append(({_rng.randrange(1, 65): _rng.randrange(1, 60) for _ in range(_rng.randrange(1, 20))}, 64))


@pytest.mark.parametrize("counts, capacity", _RESIDUALS)
def test_residual_is_best_fit_decreasing(counts, capacity):
    assert _gaps(residual(counts, capacity), counts) == _best_fit_decreasing(counts, capacity)


def test_a_sequence_takes_all_pieces_that_it_holds():
    assert Plan({1500: 1, 100: 5}).sequences == 1 and Plan({1500: 1000, 100: 5000}).sequences == 1000


def test_pack_round_trip(spark):
    tok = load_tokenizer(PATH)
    rows = [(i, " ".join(f"w{j * i % 97}" for j in range(i * 13 % 900)), "x") for i in range(60)] + [(None, None, "y"), (7, "same", "z"), (7, "same", "z"), (99, "", None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), PATH).collect()
    want = []
    for key, text, _ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(key, p, s, len(c := ids[s : s + 2048]), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(by) <= len(_best_fit_decreasing(Counter(r.length for r in got), 2048))


def test_pack_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
