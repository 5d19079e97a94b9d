"""Operator 7, best-fit packing with exact-complement hashing.

Each document is encoded whole, ended by id 0 and cut only if it is longer than a sequence. The plan is made from the
histogram of piece lengths alone (at most ``capacity`` entries, whatever the number of rows): for each length, largest
first, the gap that it leaves is looked up among single lengths, pair sums and triple sums, and combinations that fill it
exactly are consumed under the counts that are left; what remains is packed best-fit by decreasing length. Plans that look
for triples, pairs, single pieces or nothing first are compared, as the plan costs little. A piece's rank
among those of its length then names its slot, so that no task ever holds all pieces of a length.

Nulls and edge cases: a null text is empty and still has its closing id; empty tables give empty results; repeated rows are
packed each; doc_id may be null. Extra columns are left alone.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import read, small_batches
from eventloom.shared import materialize
from eventloom.llm.wordmemo import memo_of

CAPACITY = 2048
END = b"\0\0\0\0"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, memo_words: int = 400_000) -> DataFrame:
    """A row for each piece; part is the task that made it and nth its number among that task's pieces of its length.
    memo_words: how many words a Python worker keeps encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_of(tokenizer, memo_words)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            cols = [[] for _ in range(7)]
            keys = batch.column("doc_id").to_pylist()
            for at in range(0, len(keys), 512):
                for key, ids in zip(keys[at : at + 512], memo.ids(batch.column("text").slice(at, 512).to_pylist()), strict=True):
                    ids += END
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        n = len(cut) // 4
                        for col, v in zip(cols, (key, piece, start // 4, n, zlib.crc32(cut), part, seen[n]), strict=True):
                            col.append(v)
                        seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


class Plan:
    """Which slots the pieces of each length get. ``slots[n]``: (first rank, first sequence, offset) in order of rank.

    parts: complements of so many pieces are looked for at most; even: pairs of pieces near in length come first.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, parts: int = 3, even: bool = False):
        self.capacity, self.sequences, self.parts, self.even = capacity, 0, parts, even
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for n, k in counts.items():
            self.left[n] = k
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self._exact()
        self._best_fit()

    def _emit(self, lengths: list[int], times: int) -> None:
        at = 0
        for n in lengths:
            self.slots[n].append((int(self.used[n]), self.sequences, at))
            self.used[n] += times
            at += n
        self.sequences += times

    def _take(self, lengths: list[int]) -> int:
        """Consume this combination as often as the counts allow."""
        need: dict[int, int] = defaultdict(int)
        for n in lengths:
            need[n] += 1
        times = min(int(self.left[n]) // k for n, k in need.items())
        if times:
            for n, k in need.items():
                self.left[n] -= times * k
            self._emit(lengths, times)
        return times

    def _pairs(self, total: int) -> np.ndarray:
        """The smaller parts of pairs of lengths that are left and sum to total."""
        small = np.arange(1, total // 2 + 1)
        found = small[(self.left[small] > 0) & (self.left[total - small] > 0)]
        return found[::-1] if self.even else found

    def _exact(self) -> None:
        cap, left = self.capacity, self.left
        if left[cap]:
            self._take([cap])
        for n in range(cap - 1, 0, -1):
            gap = cap - n
            if not left[n] or self.parts < 1:
                continue
            self._take([n, gap])
            for small in self._pairs(gap) if left[n] and self.parts > 1 else ():
                self._take([n, int(gap - small), int(small)])
                if not left[n]:
                    break
            if not left[n] or self.parts < 3:
                continue
            for large in np.nonzero(left[:gap])[0][::-1]:
                if not left[n] or 3 * large < gap:
                    break
                for small in self._pairs(int(gap - large)) if left[large] else ():
                    self._take([n, int(large), int(gap - large - small), int(small)])
                    if not left[n] or not left[large]:
                        break

    def _best_fit(self) -> None:
        """By decreasing length into the open sequences with the smallest gap that holds it, whole groups at a time. After a
        piece the same sequence has the smallest such gap while it holds another, so that it takes all that it holds."""
        gaps: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # gap: groups of (lengths, how many sequences)
        for n in range(self.capacity, 0, -1):
            rest = int(self.left[n])
            self.left[n] = 0
            for gap in sorted(g for g in gaps if g >= n) if rest else ():
                each = gap // n
                while rest and gaps[gap]:
                    lengths, k = gaps[gap].pop()
                    full = min(k, rest // each)
                    more = rest - full * each if full < k else 0  # fewer than one sequence holds
                    if full:
                        gaps[gap - each * n].append(([*lengths, *[n] * each], full))
                    if more:
                        gaps[gap - more * n].append(([*lengths, *[n] * more], 1))
                    if k > full + (more > 0):
                        gaps[gap].append((lengths, k - full - (more > 0)))
                    rest -= full * each + more
                if not gaps[gap]:
                    del gaps[gap]
                if not rest:
                    break
            each = self.capacity // n
            if rest >= each:
                gaps[self.capacity - each * n].append(([n] * each, rest // each))
            if rest % each:
                gaps[self.capacity - rest % each * n].append(([n] * (rest % each), 1))
        for groups in gaps.values():
            for lengths, k in groups:
                self._emit(lengths, k)


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences. Triples that fill a gap may use up short pieces that would have filled others, so
    that looking for pairs or single pieces only, or for none before best fit, may need fewer; the deepest one wins ties."""
    best = None
    for parts, even in ((3, False), (3, True), (2, False), (2, True), (1, False), (0, False)):
        plan = Plan(counts, capacity, parts, even)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences * capacity - sum(n * k for n, k in counts.items()) < capacity:
            break  # no plan needs fewer
    return best


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, memo_words: int = 400_000) -> DataFrame:
    """A row for each piece with its sequence_id and offset."""
    pieces = materialize(encode_pieces(docs, tokenizer, capacity, memo_words), "pieces", wide=True)
    tallies = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "tallies")
    # at most `capacity` rows come to the driver
    plan = best_plan({r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = tallies.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    # the plan's size depends on the capacity, not on the number of rows
    table = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*slots, strict=True)) for n, slots in plan.slots.items()}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for n in np.unique(length):
                first, sequence, offset = slots[int(n)]
                mine = length == n
                k = np.searchsorted(first, rank[mine], side="right") - 1
                seq[mine], off[mine] = sequence[k] + rank[mine] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
