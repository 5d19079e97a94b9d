"""Operator 6, personal data by bootstrapped contextual extraction.

Base entities (e-mail and IP addresses, card and phone numbers) are found in every whole text. They are the seeds: the two
words before a mention are its lexical pattern, mentions of seeds and of other identifier-like words form a graph of
patterns and instances, and Spark scores both sides in turn: a pattern by the mean score of its mentions' instances, an
instance by that of its patterns, seeds being certain. A pattern's score is lowered by the share of ordinary words among
what follows it, so that a context which stands before anything is no evidence. Patterns that end with a high score on enough different seeds, or
instances found in earlier rounds, then discover identifiers that no base rule knows (kind ``ctx``). Base spans always stay.

Nulls and edge cases: null text is empty; rows stay apart even if repeated; ties in scores don't matter, as all patterns
over the threshold count; empty tables give empty results; every scan is linear in the length of a text, as a mention's
context is the ``CONTEXT`` characters before it and unknown identifiers have the length ``WORD``. Extra columns are left
alone, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import Bloom, located, place, read, small_batches
from eventloom.shared import materialize

KINDS = ["email", "ip", "card", "phone"]
#: What an identifier and its context may be: characters before a mention, characters of an unknown identifier.
CONTEXT, WORD = 80, (5, 64)

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERED = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
_EDGE = ".,;:!?()[]{}\"'<>"
_ODD = re.compile(r"[\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that a long run without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Each run of dotted numbers gives its parts in fours."""
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base entities by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, b, 1) for a, b in _addresses(text)]
        for m in _DIGITS.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def _pattern(text: str, start: int) -> str:
    """The two words before a mention: lower case, digits as 0, letters of any script, other characters gone. A word that doesn't lie whole within
    the ``CONTEXT`` characters before the mention doesn't count."""
    at = max(0, start - CONTEXT)
    words = text[at:start].lower().split()
    if at and words and not text[at - 1].isspace() and not text[at].isspace():
        del words[0]
    return " ".join(map(_plain, words[-2:])).strip()


def _plain(word: str) -> str:
    return _ODD.sub("", _DIGIT.sub("0", word))


def mentions(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int, bool]]:
    """(start, end, pattern, instance, seed): the base spans, and other words of ``WORD`` characters with three digits or
    more."""
    out = [(a, b, _pattern(text, a), xxhash.xxh3_64_intdigest(text[a:b].encode()) >> 1, True) for a, b, _ in base]
    if _DIGIT.search(text):
        k = 0
        for m in _NUMBERED.finditer(text):
            word = m.group()
            a = m.start() + len(word) - len(word.lstrip(_EDGE))
            b = m.end() - len(word) + len(word.rstrip(_EDGE))
            while k < len(base) and base[k][1] <= a:
                k += 1
            # base[k] is the first that ends after a, and those behind it don't start before it
            if WORD[0] <= b - a <= WORD[1] and len(_DIGIT.findall(text[a:b])) >= 3 and not (k < len(base) and base[k][0] < b):
                out.append((a, b, _pattern(text, a), xxhash.xxh3_64_intdigest(text[a:b].encode()) >> 1, False))
    return [x for x in out if x[2]]


_MENTIONS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("instance", pa.int64()), ("seed", pa.bool_())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
_SPAN_DDL = "array<struct<start: long, end: long, kind: string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base = [base_spans(t) for t in texts]
        found = [[dict(zip(("start", "end", "pattern", "instance", "seed"), x, strict=True)) for x in mentions(t, b)] for t, b in zip(texts, base, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([[{"start": a, "end": b, "kind": c} for a, b, c in x] for x in base], _SPANS), pa.array(found, _MENTIONS)], names=["row", "doc_id", "base", "mentions"])


def scan(docs: DataFrame, at: str | None = None) -> DataFrame:
    """row, doc_id, base spans and mentions of each document, written to the shared folder. row is the column ``at`` if one
    is named, else a number that holds in this table only."""
    small_batches(docs.sparkSession)
    rows = docs.select((F.col(at) if at else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    return materialize(rows.mapInArrow(_scan, f"row {kind}, doc_id long, base {_SPAN_DDL}, mentions array<struct<start: long, end: long, pattern: string, instance: long, seed: boolean>>"), "scan", wide=True)


class _Words(dict):
    """Number of each lower-case word, with what is needed of it: CRC of its form in patterns (0: empty), whether it is an
    ordinary word (it has a letter, no digit and no @), length."""

    MOST = 200_000

    def __init__(self):
        self.facts = np.zeros((1 << 12, 3), np.int64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        ordinary = "@" not in word and any(map(str.isalpha, word)) and not any(map(str.isdigit, word))
        if n == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        self.facts[n] = zlib.crc32(_plain(word).encode()), ordinary, len(word)
        self[word] = n
        return n


def followed(text: str, words: _Words) -> np.ndarray:
    """The key of the pattern before each ordinary word that has one. As in ``_pattern`` its words lie within ``CONTEXT``
    characters, each gap being one."""
    tokens = text.lower().split()
    at = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    form, ordinary, size = words.facts[at].T
    last, far = form[:-1], size[:-1] + 1
    first = np.concatenate([[0], form[:-2]])[: len(last)]
    reach = far + np.concatenate([[0], size[:-2] + 1])[: len(last)]
    first, last = np.where(reach > CONTEXT, 0, first), np.where(far > CONTEXT, 0, last)
    first, last = np.where(last == 0, 0, first), np.where(last == 0, first, last)
    return (first << 32 | last)[(ordinary[1:] != 0) & (last != 0)]


#: Cells of the map that says which patterns are counted: 2 MiB however many there are. Where it is full, more is sent on.
_CELLS = 1 << 24
#: Counts that a task gathers before it sends them on.
_GATHERED = 200_000


def ordinary_uses(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, ordinary): how often an ordinary word follows each pattern in the whole texts of docs (text), where it ever
    does. Tasks send sums only. Patterns are told apart by the CRCs of their words."""
    parts = F.split("pattern", " ")
    last, first = F.crc32(F.element_at(parts, -1)), F.when(F.size(parts) > 1, F.crc32(F.element_at(parts, 1))).otherwise(0).cast("long")
    keyed = materialize(patterns.select("pattern", F.shiftleft(first, 32).bitwiseOR(last).alias("key"), (first * 31 + last).bitwiseAND(_CELLS - 1).alias("cell")), "counted")
    maps = keyed.groupBy(F.shiftright("cell", 15).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(32767)).alias("bits")).collect()
    if not maps:
        return patterns.select("pattern", F.lit(0).cast("long").alias("ordinary")).limit(0)
    cells = np.zeros((_CELLS >> 15, 4096), np.uint8)
    for r in maps:
        cells[r.bucket] = np.frombuffer(r.bits, np.uint8)
    wanted = docs.sparkSession.sparkContext.broadcast(cells.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, sums = np.frombuffer(wanted.value, np.uint8), _Words(), {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (sums.keys(), sums.values())], names=["key", "n"])

        for batch in batches:
            hits = [np.zeros(0, np.int64)]
            for text in batch.column("text").to_pylist():
                if len(words) > _Words.MOST:
                    words = _Words()
                key = followed(text or "", words)
                cell = ((key >> 32 & 0xFFFFFFFF) * 31 + (key & 0xFFFFFFFF)) & (_CELLS - 1)
                hits.append(key[(bits[cell >> 3] >> (cell & 7) & 1) != 0])
            for key, n in zip(*(x.tolist() for x in np.unique(np.concatenate(hits), return_counts=True)), strict=True):
                sums[key] = sums.get(key, 0) + n
            if len(sums) > _GATHERED:
                yield sent()
                sums = {}
        yield sent()

    small_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("ordinary"))
    return keyed.join(counts, "key").select("pattern", "ordinary")


def good_patterns(scanned: DataFrame, rounds: int = 3, seeds: int = 5, least: float = 0.6, docs: DataFrame | None = None) -> DataFrame:
    """The patterns (pattern, score) that end with at least this score and this many different supports: seeds, and
    instances that a pattern accepted in the round before has found. With docs (text), the score of a pattern that has
    instances enough to be accepted is multiplied by the share of mentions among its uses, ordinary words being the others."""
    m = scanned.select(F.explode("mentions").alias("m")).select("m.pattern", "m.instance", "m.seed")
    edges = m.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = materialize(edges, "edges")
    # the whole graph is scored: an instance's other patterns speak for or against it, accepted or not
    instances = materialize(edges.groupBy("instance").agg(F.max("seed").alias("known")).select("instance", F.col("known").cast("double").alias("score"), "known"), "instances")
    patterns = None
    shares = None
    if docs is not None:
        uses = materialize(edges.groupBy("pattern").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("instances")).filter(F.col("instances") >= seeds), "uses")
        shares = ordinary_uses(docs, uses.select("pattern")).join(uses, "pattern")
        shares = materialize(shares.select("pattern", (F.col("mentions") / (F.col("mentions") + F.col("ordinary"))).alias("share")), "shares")
    for k in range(rounds):
        score = F.sum(F.col("score") * F.log1p("n")) / (F.sum(F.log1p("n")) + 0.5)
        scored = edges.join(instances, "instance").groupBy("pattern").agg(score.alias("score"), F.count_if("known").alias("supports"))
        if shares is not None:
            scored = scored.join(shares, "pattern", "left").withColumn("score", F.col("score") * F.coalesce("share", F.lit(1.0)))
        patterns = materialize(scored.select("pattern", "score", ((F.col("score") >= least) & (F.col("supports") >= seeds)).alias("good")), "patterns")
        if k < rounds - 1:
            means = edges.join(patterns, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), F.max("good").alias("found"), (F.sum(F.col("score") * F.log1p("n")) / F.sum(F.log1p("n"))).alias("mean"))
            instances = materialize(means.select("instance", F.when(F.col("seed"), 1.0).otherwise(F.col("mean")).alias("score"), (F.col("seed") | F.col("found")).alias("known")), "instances")
    return patterns.filter("good").select("pattern", "score")


def discovered(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """row and its new spans, for rows that have any."""
    m = scanned.select("row", F.explode("mentions").alias("m")).filter("NOT m.seed").select("row", "m.pattern", "m.start", "m.end")
    return materialize(m.join(patterns.select("pattern"), "pattern").groupBy("row").agg(F.collect_list(F.struct("start", "end", F.lit("ctx").alias("kind"))).alias("more")), "found")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans of each document, each by start, then kind as listed, ``ctx`` last."""
    scanned = scan(docs)
    found = discovered(scanned, good_patterns(scanned, docs=docs))
    both = scanned.join(found, "row", "left")
    kinds = F.array(*[F.lit(k) for k in [*KINDS, "ctx"]])
    every = F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast(_SPAN_DDL))), lambda x: F.struct(x.start.alias("start"), F.array_position(kinds, x.kind).alias("rank"), x.end.alias("end"), x.kind.alias("kind"))))
    return both.select("doc_id", "base", F.transform(every, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"))).alias("spans"))


def redact(text: str, more: list[tuple[int, int, str]] = ()) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind; again until no base span is left."""
    while True:
        spans = sorted([*base_spans(text), *more])
        if not spans:
            return text
        merged: list[list] = []
        for a, b, kind in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b, kind])
        out, at = [], 0
        for a, b, kind in merged:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        text, more = "".join([*out, text[at:]]), ()


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; n_chars follows where the text changes. Only rows with discovered spans
    are shuffled. The second reading finds a row by its file and its place there."""
    rows, text, doc_id = located(docs), place(docs, "text"), place(docs, "doc_id")
    scanned = scan(rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "at"), "at")
    found = discovered(scanned, good_patterns(scanned, docs=rows.select(F.col(text).alias("text")))).withColumnRenamed("row", "at")
    probed = Bloom(found.count()).of_keys(found, "at").probe(rows, F.col("at"), "hit")
    hits = probed.filter("hit").drop("hit").join(found, "at", "left")
    names = rows.columns[:-1]
    chars = place(docs, "n_chars") if "n_chars" in docs.columns else None
    schema = rows.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            spans = batch.column("more").to_pylist() if "more" in batch.schema.names else [None] * len(texts)
            new = [t if t is None else redact(t, [(x["start"], x["end"], x["kind"]) for x in s or ()]) for t, s in zip(texts, spans, strict=True)]
            cols = {c: batch.column(c) for c in names}
            if chars:
                cols[chars] = pa.array([n if a == b else len(b) for n, a, b in zip(cols[chars].to_pylist(), texts, new, strict=True)], cols[chars].type)
            cols[text] = pa.array(new, cols[text].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    clear = probed.filter("NOT hit").select(*names)
    return clear.mapInArrow(run, schema).unionByName(hits.select(*names, "more").mapInArrow(run, schema)).toDF(*docs.columns)


def joined(spans: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
