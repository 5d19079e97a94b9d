"""Operator 4, near-duplicate detection by bottom-k sketches of one hash function.

1. Each text gives the set of its five-word shingles as 64-bit hashes; the ``K`` smallest are its sketch. Texts with equal
   sets form a class; one of each class goes on.
2. Inverted lists of the retained values generate overlaps. A pair with a Jaccard similarity of 0.75 shares at least
   ``need`` retained values, so that by the prefix principle it meets in the list of one of its rarest ones: only those
   lists are made, and values that many texts share drop out of them unless a text consists of such values.
3. Lists of up to ``SHORT`` texts give all their pairs. In longer ones each text is paired with one centre only; where
   such a list still holds several components afterwards, its texts are compared by the same principle over their full
   sets with positional bounds: with a better centre first, then across components only. So no link is lost and no large
   group gives all its pairs.
4. The union sketch estimates a pair's similarity and drops what can't reach 0.75; full sets verify the rest.
5. Components come from contraction of the verified links.

Completeness: for sets of up to 114 shingles the bounds are exact. For larger ones, a pair at 0.75 is lost only if fewer
than 26 of 64 draws fall in the intersection, with a probability of about 1e-9, less for closer pairs.

Nulls and edge cases: a text that is null or has no words has an empty set and is linked with nothing; with fewer than five
words the whole sequence is the one shingle; repeated rows are in one class; a null doc_id counts as larger than any
other; an empty table gives an empty result. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import Bloom, keep_absent, keep_present, located, place, read, small_batches
from eventloom.operators.graph import components
from eventloom.shared import materialize

WIDTH, K, LEAST, SHORT, FIRST = 5, 64, 26, 32, 16

_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    acc = np.full(n, min(len(h), width), dtype=np.uint64)
    for j in range(min(width, len(h))):
        acc = acc * _MIX_A + h[j : j + n]
        acc ^= acc >> np.uint64(29)
    acc *= _MIX_B
    acc ^= acc >> np.uint64(32)
    return np.unique(acc.view(np.int64))


def _signature(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64), pa.int64()))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "at", "row")), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.binary()), _lists([s[:K] for s in sets])], names=["doc_id", "at", "row", "n", "sig", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        if [_signature(s) for s in sets] != batch.column("sig").to_pylist():
            raise RuntimeError("the documents changed between two reads; write them to a table first")
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:K].tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "sketch", "full"])


def possible(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> bool:
    """Whether the union sketch leaves a similarity of 0.75 possible."""
    both = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)[:K]
    shared = len(both) if len(both) == 0 else int(np.searchsorted(both, union[-1], side="right"))
    if size_a <= K and size_b <= K:  # the sketches are the sets
        return 100 * len(both) >= 75 * (size_a + size_b - len(both))
    return shared >= max(LEAST, len(union) - max(size_a, size_b) // 3)


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b"))
        ok = [possible(np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64), i, j) for x, y, i, j in zip(a, b, na, nb, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("full_a").to_pylist(), batch.column("full_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _near_size(a: str, b: str) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def _need(n: Column) -> Column:
    """Retained values that a text of n shingles shares at least with any text at a similarity of 0.75."""
    return F.least(F.ceil(n * 3 / 4), F.greatest(F.lit(LEAST), K - F.floor(n / 3)))


def _with(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    for end in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}"), F.col(what).alias(f"{what}_{end}")), end)
    return pairs


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the estimate leaves and the full sets confirm."""
    left = materialize(_with(pairs, sets, "sketch").mapInArrow(_estimate, "a long, b long"), "estimated")
    return materialize(_with(left, sets, "full").mapInArrow(_verify, "a long, b long"), "links")


def _residual(lists: DataFrame, sets: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the search across the components that meet in one long list.

    The texts of such lists get inverted lists of their full sets. The text of a list whose shingles the others share most
    is a better centre than the sketches could name: pairs with it come first, and only what is apart afterwards is
    compared across components.
    """
    named = lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("v", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = named.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("v")
    texts = materialize(named.join(mixed, "v").select("rep").distinct(), "mixed")
    if texts.isEmpty():
        return labels

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, n, full in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "full")), strict=True):
                v = np.frombuffer(full, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), x, dtype=np.int64)) for x in (rep, n)] + [pa.array(v)], names=["rep", "n", "v"])

    entries = materialize(sets.join(texts, "rep").select("rep", "n", "full").mapInArrow(explode, "rep long, n long, v long"), "entries")
    common = materialize(entries.groupBy("v").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "common")
    # values of one text only come first in its order, so that they are counted and not carried
    shared = entries.join(common, "v")
    rows = shared.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "v"))).alias("vs"))
    alone = F.col("n") - F.size("vs")
    prefix = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - alone)
    shown = F.slice("vs", F.lit(1), prefix.cast("int"))
    weight = F.aggregate("vs", F.lit(0.0), lambda acc, x: acc + x.texts) / F.col("n")
    rows = rows.select("rep", "n", alone.alias("alone"), weight.alias("weight"), F.transform(F.slice(shown, 1, FIRST), lambda x: x.v).alias("first"), F.posexplode(shown).alias("k", "x"))
    placed = materialize(rows.select("rep", "n", "weight", "first", "x.v", (F.col("alone") + F.col("k") + 1).alias("pos")), "placed")
    least = placed.groupBy("v").agg(F.min("n").alias("least"))
    placed = placed.join(least, "v").filter(F.col("n") - F.col("pos") + 1 >= F.ceil((F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * 3 / 4))) * 3 / 7)).drop("least")
    placed = materialize(placed, "placed")

    centres = materialize(placed.groupBy("v").agg(F.max(F.struct("weight", "rep", "n", "pos")).alias("c")), "centres")
    now = labels.withColumnRenamed("node", "rep")
    stars = placed.join(centres, "v").filter(F.col("rep") != F.col("c.rep")).select(F.col("rep"), F.col("c.rep").alias("c"), F.col("n").alias("n_a"), F.col("c.n").alias("n_b"), F.col("pos").alias("pos_a"), F.col("c.pos").alias("pos_b"))
    stars = stars.filter(_near_size("n_a", "n_b") & _reach()).select("rep", "c").distinct()
    own, theirs = now.withColumnRenamed("label", "own"), now.select(F.col("rep").alias("c"), F.col("label").alias("theirs"))
    stars = stars.join(own, "rep", "left").join(theirs, "c", "left").filter(F.coalesce("own", "rep") != F.coalesce("theirs", "c"))
    links = links.unionByName(_links(materialize(stars.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct(), "stars"), sets))
    now = components(links).withColumnRenamed("node", "rep")

    # the largest component of each list needs no comparison within itself
    named = materialize(placed.join(now, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "placed")
    largest = materialize(named.groupBy("v", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("v").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").drop("labels"), "largest")
    named = materialize(named.join(largest, "v"), "placed")
    one = named.filter("label <> main").select("v", *(F.col(c).alias(f"{c}_a") for c in ("rep", "label", "n", "pos", "first")))
    two = named.select("v", "main", *(F.col(c).alias(f"{c}_b") for c in ("rep", "label", "n", "pos", "first")))
    apart = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("main")) | (F.col("rep_a") < F.col("rep_b")))
    # a pair is told at the first value that both have, where that is among their first ones
    once = F.coalesce(F.get(F.array_intersect("first_a", "first_b"), 0), F.col("v")) == F.col("v")
    meet = one.join(two, "v").filter(apart & _near_size("n_a", "n_b") & _reach() & once)
    more = materialize(meet.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct(), "more")
    links = links.unionByName(_links(more, sets))
    return components(links)


def _reach() -> Column:
    """The positions of a common value in both orders leave an overlap of 0.75 possible."""
    return 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= F.ceil((F.col("n_a") + F.col("n_b")) * 3 / 7)


def group(docs: DataFrame) -> DataFrame:
    """A row for each document: row (its number), doc_id, n, group (one number a component), component_id."""
    return _group(_texts(docs, located(docs)))[0]


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(F.col(place(docs, "doc_id")).cast("long").alias("doc_id"), F.col(place(docs, "text")).alias("text"), "at")


def _group(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """group() of texts (doc_id, text, at), and where each row is (row, at). Numbers are given once, in the table of sketches;
    later readings find a text by ``at``."""
    small_batches(texts.sparkSession)
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    kind = texts.schema["at"].dataType.simpleString()
    base = materialize(numbered.mapInArrow(_sketches, f"doc_id long, at {kind}, row long, n long, sig binary, sketch array<long>"), "sketches", wide=True)

    # 1. classes of equal sets
    probed = Bloom.of_repeated(base.filter("n > 0"), "sig").probe(base.filter("n > 0"), F.col("sig"), "hit")
    groups = materialize(probed.filter("hit").groupBy("sig").agg(F.min("row").alias("rep"), F.min("doc_id").alias("low")), "classes")
    members = materialize(
        base.filter("n = 0").select("row", "doc_id", "n", F.col("row").alias("rep"), F.col("doc_id").alias("low"))
        .unionByName(probed.filter("NOT hit").select("row", "doc_id", "n", F.col("row").alias("rep"), F.col("doc_id").alias("low")))
        .unionByName(probed.filter("hit").join(groups, "sig").select("row", "doc_id", "n", "rep", "low")), "members",
    )
    firsts = probed.filter("NOT hit").select(F.col("row").alias("rep"), "n", "sketch").unionByName(probed.filter("hit").select(F.col("row").alias("rep"), "n", "sketch").join(groups.select("rep"), "rep", "left_semi"))
    entries = firsts.select("rep", "n", F.explode("sketch").alias("v"))

    # 2. inverted lists of each text's rarest retained values
    shared = materialize(entries.groupBy("v").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "shared", wide=True)
    overlaps = keep_present(entries, "v", shared, shared.count())
    kept = overlaps.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "v"))).alias("vs")).filter(F.size("vs") >= _need(F.col("n")))
    size = F.least(F.col("n"), F.lit(K))
    prefix = F.greatest(F.lit(0), size - _need(F.col("n")) + 1 - (size - F.size("vs")))
    lists = kept.select("rep", "n", (size - F.size("vs")).alias("alone"), F.explode(F.slice(F.col("vs").getField("v"), F.lit(1), prefix.cast("int"))).alias("v"))
    lists = materialize(lists, "lists", wide=True)
    sizes = materialize(lists.groupBy("v").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("alone", "rep", "n")).alias("centre")).filter("texts > 1"), "sizes")
    long_lists = sizes.filter(F.col("texts") > SHORT)

    # 3. pairs: all of a short list, those with the centre of a long one
    short = materialize(lists.join(sizes.filter(F.col("texts") <= SHORT).select("v"), "v").select("v", "rep", "n"), "short")
    one, two = (short.select("v", F.col("rep").alias(e), F.col("n").alias(f"n_{e}")) for e in ("a", "b"))
    pairs = one.join(two, "v").filter((F.col("a") < F.col("b")) & _near_size("n_a", "n_b")).select("a", "b")
    crowded = materialize(lists.join(long_lists.select("v", "centre"), "v"), "crowded")
    stars = crowded.filter(F.col("rep") != F.col("centre.rep")).select(F.col("rep"), "n", F.col("centre.rep").alias("c"), F.col("centre.n").alias("n_c")).filter(_near_size("n", "n_c")).select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b"))
    pairs = materialize(pairs.unionByName(stars).distinct(), "pairs")

    # 4. estimate, then full sets of the texts in pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(crowded.select("rep")).distinct()
    wanted = materialize(base.select(F.col("row").alias("rep"), "at", "sig").join(wanted, "rep"), "wanted")
    met = keep_present(texts.select("at", "text"), "at", wanted, wanted.count()).select("rep", "sig", "text")
    sets = materialize(met.mapInArrow(_full_sets, "rep long, n long, sketch binary, full binary"), "sets", wide=True)
    links = _links(pairs, sets)
    labels = components(links)
    if not crowded.isEmpty():
        labels = _residual(crowded.select("v", "rep"), sets, labels, links)

    # 5. the smallest doc_id of each component
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("group", F.coalesce("label", "rep")).drop("label")
    named = materialize(named, "named")
    joined = labels.select(F.col("label").alias("group")).distinct()
    lowest = materialize(named.join(joined, "group").groupBy("group").agg(F.min("low").alias("component_id")), "lowest")
    out = named.join(lowest, "group", "left").select("row", "doc_id", "n", "group", F.coalesce("component_id", "low").alias("component_id"))
    return out, base.select("row", "at")


def drop_near(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id; columns are kept, and only rows that may have to go
    are shuffled."""
    rows = located(docs)
    grouped, places = _group(_texts(docs, rows))
    named = materialize(grouped.select("row", "group", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("place")), "placed")
    first = materialize(named.groupBy("group").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "firsts")
    gone = materialize(named.join(first, "group").filter("place.row <> first.row").select("row"), "gone")
    count = gone.count()
    gone = materialize(keep_present(places, "row", gone, count).select("at"), "gone")
    return keep_absent(rows, "at", gone, count).drop("at").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
