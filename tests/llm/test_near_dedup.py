import random

from eventloom.llm import near_dedup as N
from eventloom.llm.common import read


def _sets(rows):
    out = []
    for _, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    return out


def brute(rows):
    sets, parent = _sets(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, a in enumerate(sets):
        seen = set()
        for x in a:
            seen.update(j for j in by[x] if j < i)
        for j in seen:
            both = len(a & sets[j])
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return sorted((key if key is not None else -1, len(sets[i]), low.get(find(i), -1)) for i, (key, _) in enumerate(rows))


def ours(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, rep string, n int")
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n, r.component_id if r.component_id is not None else -1) for r in N.group(df).collect())


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_equals_brute_force_with_a_large_group(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    boiler = " ".join(rng.choice(vocab) for _ in range(14))
    base = [rng.choice(vocab) for _ in range(150)]
    rows = [(5000 + i, _edited(rng, base, rng.randrange(12))) for i in range(260)]
    for g in range(25):
        core = [rng.choice(vocab) for _ in range(rng.choice((3, 6, 9, 20, 70, 90, 120, 400)))]
        rows += [(g * 50 + i, _edited(rng, core, rng.randrange(5))) for i in range(rng.randrange(1, 9))]
    rows += [(20000 + i, boiler + " " + " ".join(rng.choice(vocab) for _ in range(rng.choice((2, 3, 30))))) for i in range(120)]
    rows += [(30000, None), (30001, ""), (30002, " \n"), (30003, "One TWO"), (30004, "one\ttwo "), (30004, "one\ttwo "), (None, "one two"), (None, "null id alone here"), (30005, " ".join(vocab * 5)), (30006, "É é"), (30007, "é é"), (30008, "a b c d e"), (30009, "A b\x0bc d e")]
    rng.shuffle(rows)
    assert ours(spark, rows) == brute(rows)


def test_chain_and_nothing(spark):
    words = [f"c{i}" for i in range(90)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 40])) for i in range(20)]
    assert ours(spark, rows) == brute(rows) and len({r[2] for r in brute(rows)}) == 1
    assert ours(spark, []) == []


def test_real_table_equals_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.query(spark, "/root/testdata/sf0.01").collect())
    assert got == brute(rows)


def test_stage_keeps_one_of_each(spark, tmp_path):
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, "A b c d e f g", "t"), (None, "q", "u"), (4, None, "v"), (5, "", "w")]
    spark.createDataFrame(rows, "doc_id long, text string, hit string").write.parquet(str(tmp_path / "d"))
    got = N.drop_near(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "4", "5", "None"]
