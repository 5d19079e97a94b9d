"""Operator 2, language identification of mixed text.

A word's script (by ranges of code points) narrows the candidate languages to those that were seen with that script; a
character n-gram model scores the word for each of them; Viterbi with a switching penalty labels the words of a whole text,
so that a few odd words don't cut a span. The prediction is the language with the most letters, its score that
language's share of the labelled letters.

Training uses about ``per_language`` labelled rows of each language at most (all rows of rarer ones), chosen by a hash;
counts are made by Spark in a fixed number of hash buckets, so that the model is bounded.

Nulls and edge cases: null text or no letters gives ``und`` with score 0; with nothing to learn from every text is ``und``;
rows with a null doc_id or lang are labelled but not learned from; ties go to the alphabetically first language; texts of
any length are labelled whole. Extra columns are left alone.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import by_place, place, read, small_batches, worker_cache

# First and last code point of script ranges.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]

UNKNOWN = "und"
_CHUNK = re.compile(r"\S+")
_NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]
#: N-grams are counted by hash, in this many buckets.
BUCKETS = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Letters, script and n-gram buckets of many chunks at once.

    A word is a run of letters in lower case between two marks; its n-grams have one to four characters.
    """

    def __init__(self, chunks: list[str]):
        self.n = len(chunks)
        codes = np.frombuffer(("\n" + "\n".join(c.lower() for c in chunks) + "\n").encode("utf-32-le"), dtype=np.uint32)
        each, back = np.unique(codes, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in each], dtype=bool)[back]
        script = np.array([next((_NAMES.index(name) for name, lo, hi in SCRIPTS if lo <= c <= hi), len(_NAMES) - 1) for c in each])[back]
        chunk = np.cumsum(codes == 10) - 1
        self.letters = np.bincount(chunk[letter], minlength=self.n)[: self.n]
        by = np.bincount(chunk[letter] * len(_NAMES) + script[letter], minlength=self.n * len(_NAMES))[: self.n * len(_NAMES)]
        self.by_script = by.reshape(self.n, len(_NAMES))
        self.script = self.by_script.argmax(axis=1)
        c = np.where(letter, codes, 0).astype(np.uint64)
        self.parts = []  # for each length: the chunk and the bucket of each n-gram
        for size in (1, 2, 3, 4):
            m = len(c) - size + 1
            inner = letter[:m].copy() if size == 1 else (letter[:m] | letter[1 : m + 1] if size == 2 else letter[1 : m + 1].copy())
            if size == 4:
                inner &= letter[2 : m + 2]
            at = np.nonzero(inner)[0]
            h = np.full(len(at), size, dtype=np.uint64)
            for j in range(size):
                h = (h ^ c[at + j]) * _MIX
                h ^= h >> np.uint64(31)
            owner = at if size == 1 else np.where(letter[at], at, at + 1)
            self.parts.append((chunk[owner], (h * _MIX >> np.uint64(47)).astype(np.int64)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Model:
    """Log-probabilities of n-gram buckets and the languages that each script allows."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        """rows: (language, bucket or minus one minus the script's number, count)."""
        self.name = uuid.uuid4().hex
        self.langs = sorted({lang for lang, _, _ in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        counts, scripts = np.zeros((BUCKETS, len(at))), np.zeros((len(_NAMES), len(at)))
        for lang, key, n in rows:
            if key < 0:
                scripts[-1 - key, at[lang]] += n
            else:
                counts[key, at[lang]] += n
        known = counts.sum(axis=1) > 0
        self.table = np.zeros((len(at), BUCKETS), dtype=np.float32)
        # the four lengths of n-grams overlap, so that each counts as a part only
        self.table[:, known] = (np.log((counts[known] + 0.1) / (counts.sum(axis=0) + 0.1 * known.sum())) / 3).T
        allowed = scripts > 0.001 * scripts.sum(axis=0)
        self.learned, self.known = allowed.any(axis=1), known
        # a script that no language was seen with narrows nothing
        self.barred = np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0, -60).astype(np.float32)

    def score(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters, those that may be of a learned language, and log-scores for each language, of chunks without white
        space. Letters in a script that no language was seen with, or in a chunk without a known n-gram, are of none."""
        f = Features(chunks)
        met = sum(np.bincount(owner, weights=self.known[bucket], minlength=f.n)[: f.n] for owner, bucket in f.parts) > 0
        known = np.where(met, f.by_script[:, self.learned].sum(axis=1), 0)
        out = np.zeros((f.n, len(self.langs)), dtype=np.float32)
        for owner, bucket in f.parts:
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(owner, weights=self.table[k, bucket], minlength=f.n)[: f.n]
        out += self.barred[f.script]
        return f.letters, known, out - out.max(axis=1, keepdims=True, initial=-np.inf) if self.langs else out


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label of each word of each text; all texts advance together, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int16)] * len(scores)
    at = 0
    while at < len(order) and len(scores[order[at]]):
        longest, k = scores[order[at]].shape
        group = order[at : at + max(1, 8_000_000 // (longest * (k + 4)))]
        at += len(group)
        group = [i for i in group if len(scores[i])]
        sizes = np.array([len(scores[i]) for i in group])
        padded = np.zeros((longest, len(group), k), dtype=np.float32)
        for j, i in enumerate(group):
            padded[: sizes[j], j] = scores[i]
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
        v = padded[0].copy()
        switched = np.zeros((longest, len(group), k), dtype=bool)
        source = np.zeros((longest, len(group)), dtype=np.int16)
        for t in range(1, longest):
            n = active[t]
            u = v[:n]
            best = u.argmax(axis=1)
            jump = np.take_along_axis(u, best[:, None], 1) - penalty
            s = jump > u
            v[:n] = np.where(s, jump, u) + padded[t, :n]
            switched[t, :n], source[t, :n] = s, best
        label = v.argmax(axis=1).astype(np.int16)
        path = np.zeros((longest, len(group)), dtype=np.int16)
        every = np.arange(len(group))
        for t in range(longest - 1, -1, -1):
            n = active[t]
            path[t, :n] = label[:n]
            if t:
                label[:n] = np.where(switched[t, every[:n], label[:n]], source[t, :n], label[:n])
        for j, i in enumerate(group):
            out[i] = path[: sizes[j], j]
    return out


class Labeller:
    """Labels whole texts; scores of chunks are kept, as many as a fixed size allows."""

    def __init__(self, model: Model, penalty: float, memo_scores: int):
        self.model, self.penalty = model, penalty
        self.most = memo_scores // max(16, len(model.langs))
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.letters, self.known, self.scores = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros((1, len(self.model.langs)), dtype=np.float32)

    def _learn(self, chunks: list[str]) -> None:
        """Row 0 stands for chunks without letters."""
        for at in range(0, len(chunks), 20_000):
            part = chunks[at : at + 20_000]
            letters, known, scores = self.model.score(part)
            some = letters > 0
            rows = np.where(some, len(self.letters) - 1 + np.cumsum(some), 0)
            self.memo.update(zip(part, rows.tolist(), strict=True))
            self.letters, self.known, self.scores = np.concatenate([self.letters, letters[some]]), np.concatenate([self.known, known[some]]), np.concatenate([self.scores, scores[some]])

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """For each text: language, score, spans (start, end, language) in code points."""
        return [x[:3] for x in self._label(texts)]

    def shares(self, texts: list[str | None]) -> list[float]:
        """For each text: the share of all its letters that the language with most of the known ones has."""
        return [x[3] for x in self._label(texts)]

    def _label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
        if not self.model.langs:
            return [(UNKNOWN, 0.0, [], 0.0) for _ in texts]
        if len(self.memo) > self.most:
            self._clear()
        memo, chunked = self.memo, [(t or "").split() for t in texts]
        self._learn(list(set().union(*chunked).difference(memo)))
        letters, table = self.letters, self.scores
        rows = [np.fromiter(map(memo.__getitem__, cs), dtype=np.int64, count=len(cs)) for cs in chunked]
        words = [r[r > 0] for r in rows]
        out = []
        for t, r, w, path in zip(texts, rows, words, viterbi([table[w] for w in words], self.penalty), strict=True):
            if not len(w):
                out.append((UNKNOWN, 0.0, [], 0.0))
                continue
            per = np.bincount(path, weights=letters[w], minlength=len(self.model.langs))
            top = int(per.argmax())
            known = np.bincount(path, weights=self.known[w], minlength=len(self.model.langs))
            out.append((self.model.langs[top], float(per[top] / per.sum()), self._spans(t, r, path), float(known.max() / per.sum())))
        return out

    def _spans(self, text: str, rows: np.ndarray, path: np.ndarray) -> list[tuple[int, int, str]]:
        cuts = [0, *(np.nonzero(np.diff(path))[0] + 1), len(path)]
        worded = np.nonzero(rows)[0]
        wanted, edges = sorted({int(worded[i]) for a, b in zip(cuts, cuts[1:]) for i in (a, b - 1)}), {}
        if len(cuts) == 2:
            first, last = text.split(None, int(wanted[0])), text.rsplit(None, len(rows) - 1 - int(wanted[-1]))
            start = len(text) - len(first[-1].lstrip()) if first else 0
            return [(start, len(last[0].rstrip()), self.model.langs[path[0]])]
        want = iter(wanted)
        nxt = next(want, None)
        for k, m in enumerate(_CHUNK.finditer(text)):
            if k == nxt:
                edges[k] = m.span()
                nxt = next(want, None)
                if nxt is None:
                    break
        return [(edges[int(worded[a])][0], edges[int(worded[b - 1])][1], self.model.langs[path[a]]) for a, b in zip(cuts, cuts[1:])]


MEMO_SCORES = 2_400_000


def labeller_of(model: Model, penalty: float, memo_scores: int = MEMO_SCORES) -> Labeller:
    """This worker's labeller for a model; memo_scores: how many scores of words it keeps."""
    return worker_cache(("language", model.name, penalty), lambda: Labeller(model, penalty, memo_scores))


def train(docs: DataFrame, per_language: int = 2000, least_count: int = 2) -> Model:
    """least_count: how often a language's n-gram bucket occurs in the sample at least to be in the model."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").filter(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return Model([])
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                chunks[lang].update(text.split())
        for lang, found in chunks.items():
            names, counts, scripts = list(found), np.zeros(BUCKETS), np.zeros(len(_NAMES))
            for at in range(0, len(names), 20_000):
                part = names[at : at + 20_000]
                times, f = np.array([found[c] for c in part], dtype=float), Features(part)
                for owner, bucket in f.parts:
                    counts += np.bincount(bucket, weights=times[owner], minlength=BUCKETS)
                scripts += np.bincount(f.script, weights=times * f.letters, minlength=len(_NAMES))
            keys, numbers = np.nonzero(counts)[0], np.nonzero(scripts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(keys) + len(numbers)), pa.string()), pa.array(np.concatenate([keys, -1 - numbers]), pa.int64()), pa.array(np.concatenate([counts[keys], scripts[numbers]]).astype(np.int64))], names=["lang", "key", "n"])

    # at most BUCKETS rows a language come to the driver
    tallied = sample.select("text", "lang").mapInArrow(tally, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).filter((F.col("n") >= least_count) | (F.col("key") < 0))
    return Model([tuple(r) for r in tallied.collect()])


def label(docs: DataFrame, model: Model, penalty: float = 8.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_of(model, penalty)
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 512):
                found += labeller.label(batch.column("text").slice(at, 512).to_pylist())
            spans = pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def keep_known(docs: DataFrame, least: float = 0.4, penalty: float = 8.0, memo_scores: int = MEMO_SCORES) -> DataFrame:
    """The documents in a known language that has at least this share of all their letters, those of no known language
    among them; columns are kept."""
    model, text = train(docs), place(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_of(model, penalty, memo_scores)
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 512):
                found += labeller.shares(batch.column(text).slice(at, 512).to_pylist())
            yield batch.filter(pa.array([x > 0 and x >= least for x in found], pa.bool_()))

    rows = by_place(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return label(docs, train(docs))
