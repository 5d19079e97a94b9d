"""Operator 8, token counts by offset-mapped attribution.

Each text is encoded once, as a whole; its tokens' character spans are joined by interval to the text's sections (its lines,
or any fields that a column names), and a token that crosses a boundary is allocated by rule:

- ``start``: to the section of its first character;
- ``most``: to the section that holds most of its characters, the first of equal ones;
- ``share``: to each section by its share of the token's characters.

Characters outside all sections count as section -1. A text's words, as the pre-tokenizer cuts them, are encoded once a
worker and then looked up, so that only words across a boundary need their tokens' offsets; texts with characters beyond
ASCII and Latin-1 letters are encoded by the library in one piece.

Nulls and edge cases: null and empty texts have no tokens and no sections; empty lines are sections without tokens of their
own; repeated rows are counted each; empty tables give empty results; texts of any length are counted whole. Sections must
not overlap. Extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import read, small_batches, worker_cache
from eventloom.llm.wordmemo import load_tokenizer

_NOT_PLAIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
#: Fixed value: the pre-tokenizer's pattern over these letters.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
_LONG = 64


class Spans:
    """Token spans of texts under a byte-level tokenizer, with a bounded memo of words' token numbers."""

    def __init__(self, path: str, most: int = 500_000):
        self.tok, self.most = load_tokenizer(path), most
        self.tok.encode_special_tokens = True
        self.numbers: dict[str, int] = {}
        self.offsets: dict[str, list[tuple[int, int]]] = {}

    def words(self, texts: list[str]) -> list[list[str] | None]:
        """The pre-tokenizer's words, their numbers of tokens known; None: encode the text in one piece."""
        cut = [None if _NOT_PLAIN.search(t) else _WORDS.findall(t) for t in texts]
        if len(self.numbers) > self.most:
            self.numbers.clear()
        new = list(set().union(*(c for c in cut if c)).difference(self.numbers))
        self.numbers.update(zip(new, (len(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return cut

    def spans(self, word: str) -> list[tuple[int, int]]:
        if word not in self.offsets:
            if len(self.offsets) > 50_000:
                self.offsets.clear()
            self.offsets[word] = self.tok.encode(word, add_special_tokens=False).offsets
        return self.offsets[word]

    def count(self, text: str, words: list[str] | None, sections: np.ndarray, rule: str) -> tuple[int, int, np.ndarray]:
        """Tokens, tokens across a boundary, tokens of each section (those outside last). sections: sorted (start, end)."""
        k = len(sections)
        out = np.zeros(k + 1)
        if words is None:
            offsets = self.tok.encode(text, add_special_tokens=False).offsets
            crossing = self._allocate(offsets, sections, rule, out)
            return len(offsets), crossing, out
        n = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        starts = ends - np.diff(ends, prepend=0)
        home = self._home(starts, sections)
        apart = (home != self._home(ends - 1, sections)) | ((home == k) & (k > 0) & (np.searchsorted(sections[:, 0], starts) != np.searchsorted(sections[:, 0], ends)))
        whole = ~apart
        out += np.bincount(home[whole], weights=n[whole], minlength=k + 1)
        crossing = 0
        for i in np.nonzero(apart)[0]:
            at = int(starts[i])
            crossing += self._allocate([(a + at, b + at) for a, b in self.spans(words[i])], sections, rule, out)
        return int(n.sum()), crossing, out

    @staticmethod
    def _home(chars: np.ndarray, sections: np.ndarray) -> np.ndarray:
        """The section of each character; the number of sections if it is outside."""
        k = len(sections)
        if not k:
            return np.zeros(len(chars), dtype=np.int64)
        at = np.searchsorted(sections[:, 0], chars, side="right") - 1
        return np.where((at >= 0) & (chars < sections[at, 1]), at, k)

    def _allocate(self, offsets: list[tuple[int, int]], sections: np.ndarray, rule: str, out: np.ndarray) -> int:
        crossing = 0
        for a, b in offsets:
            homes = self._home(np.arange(a, max(b, a + 1)), sections)
            kinds, sizes = np.unique(homes, return_counts=True)
            crossing += len(kinds) > 1
            if rule == "start" or len(kinds) == 1:
                out[homes[0]] += 1
            elif rule == "most":
                out[next(h for h in homes if sizes[np.searchsorted(kinds, h)] == sizes.max())] += 1
            else:
                out[kinds] += sizes / sizes.sum()
        return crossing


def lines(text: str) -> np.ndarray:
    """Each line with its line end is a section; an empty text has none."""
    if not text:
        return np.zeros((0, 2), dtype=np.int64)
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    out = np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)
    return out[out[:, 1] > out[:, 0]]


def attribute(docs: DataFrame, tokenizer: str, sections: str | None = None, rule: str = "start") -> DataFrame:
    """A row for each document: doc_id, n_tokens, n_crossing, sections (start, end, tokens), outside.

    sections: a column array<struct<start, end>> sorted by start; none: the text's lines.
    """
    if rule not in ("start", "most", "share"):
        raise ValueError(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = worker_cache(("spans", tokenizer), lambda: Spans(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                if sections is None:
                    parts = [lines(t) for t in texts]
                else:
                    parts = [np.array([(x["start"], x["end"]) for x in s or ()], dtype=np.int64).reshape(-1, 2) for s in part.column("sections").to_pylist()]
                found = [spans.count(t, w, s, rule) for t, w, s in zip(texts, spans.words(texts), parts, strict=True)]
                flat = np.concatenate([*parts, np.zeros((0, 2), dtype=np.int64)])
                tokens = np.concatenate([*(x[2][:-1] for x in found), np.zeros(0)])
                each = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(tokens)], names=["start", "end", "tokens"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), lists, pa.array([x[2][-1] for x in found], pa.float64())], names=["doc_id", "n_tokens", "n_crossing", "sections", "outside"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(sections).alias("sections")] if sections else []))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_crossing long, sections array<struct<start: long, end: long, tokens: double>>, outside double")


def by_section(attributed: DataFrame) -> DataFrame:
    """A row for each section of each document: doc_id, section (from 0), start, end, tokens."""
    return attributed.select("doc_id", F.posexplode("sections").alias("section", "x")).select("doc_id", "section", "x.start", "x.end", "x.tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attribute(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", "n_crossing", F.size("sections").cast("long").alias("n_sections"), F.transform("sections", lambda x: x.tokens.cast("long")).alias("section_tokens"))
