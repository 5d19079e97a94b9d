"""Operator 1, secret scans with corpus-wide ownership frequency. Built-in functions only.

Base rules find key assignments, access keys and long hex strings in every whole text. Their values, and other long mixed
words, are candidates: their hashes are counted over distinct repositories and owners. A value that ``WIDE`` or more owners
have is a widely copied example; one that fewer have looks live. Mixed words become spans (kind ``token``) only if they
look live; base spans always stay.

Repositories are the values of ``source``, owners their part before the first slash.

Nulls and edge cases: null text is empty, null source is one owner of its own; repeated rows stay apart; a value that
occurs twice in a text counts one owner; empty tables give empty results; texts are scanned whole. Extra columns are left
alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import read
from eventloom.shared import materialize

WIDE = 3

# The base patterns; those of the shorter kinds take only matches that are long enough.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{24,}"

KINDS = ["assign", "access", "hex", "token"]


_SPANS = "array<struct<start: int, kind: int, end: int, value: string>>"


def _running(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step`` (state, item) -> (state, result) gives for each of the items (one or more), in order; results are an
    array of the type ``out``.

    The built-in fold copies what it has collected at each step. Items are therefore folded in blocks of about the square
    root of their number, so that only references within a block, and then to blocks, are copied.
    """

    def whole(z: Column) -> Column:
        size, empty = F.ceil(F.sqrt(F.size(z))).cast("int"), F.array().cast(out)

        def add(acc: Column, x: Column) -> Column:
            after, result = step(acc.state, x)
            return F.struct(after.alias("state"), F.concat(acc.out, F.array(result)).alias("out"))

        def block(acc: Column, k: Column) -> Column:
            before = F.struct(F.element_at(acc, -1)["state"].alias("state"), empty.alias("out"))
            return F.concat(acc, F.array(F.aggregate(F.slice(z, k + 1, size), before, add)))

        first = F.array(F.struct(state.alias("state"), empty.alias("out")))
        return F.flatten(F.transform(F.aggregate(F.sequence(F.lit(0), F.size(z) - 1, size), first, block), lambda b: b.out))

    return F.get(F.transform(F.array(items), whole), 0)  # as a variable, the items are made once


def _found(pattern: str, kind: int, value_group: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of the matches in ``text``, in code points.

    No built-in function gives all positions; the pieces between the matches do, as they add up to them.
    """
    hits, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(value_group))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.char_length(x.gap)
        end = begin + F.char_length(x.hit)
        return end, F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.value.alias("value"))

    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")), lambda x: x.hit.isNotNull())
    return F.when(F.col("text").rlike(pattern), _running(zipped, F.lit(0), _SPANS, step)).otherwise(F.array().cast(_SPANS))


def _free(words: Column, base: Column) -> Column:
    """The words (which don't overlap each other) that overlap no base span. In order of start, a word overlaps one before it
    if the furthest end so far is behind its start, and one after it only if the next in order is one that starts inside."""

    def step(furthest: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x.kind < 4, F.greatest(furthest, x.end)).otherwise(furthest), furthest

    def whole(z: Column) -> Column:
        pairs = F.arrays_zip(z.alias("x"), _running(z, F.lit(0), "array<int>", step).alias("furthest"), F.slice(z, F.lit(2), F.size(z)).alias("next"))
        free = F.filter(pairs, lambda p: (p.x.kind == 4) & (p.furthest <= p.x.start) & ~F.coalesce((p.next.kind < 4) & (p.next.start < p.x.end), F.lit(False)))
        return F.transform(free, lambda p: p.x)

    return F.get(F.transform(F.array(F.array_sort(F.concat(base, words))), whole), 0)


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, base spans and mixed words of each document, written to the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    assign = F.filter(_found(ASSIGN, 1, 2), lambda x: F.char_length(x.value) >= 12)
    base = F.array_sort(F.concat(assign, _found(ACCESS, 2), _found(HEX, 3)))

    def mixed(x: Column) -> Column:
        return x.value.rlike("[0-9]") & x.value.rlike("[A-Z]") & x.value.rlike("[a-z]")

    found = rows.select("row", "doc_id", "source", base.alias("base"), F.filter(_found(TOKEN, 4), mixed).alias("words"))
    both = (F.size("words") > 0) & (F.size("base") > 0)
    return materialize(found.withColumn("words", F.when(both, _free(F.col("words"), F.col("base"))).otherwise(F.col("words"))), "secrets", wide=True)


def ownership(scanned: DataFrame) -> DataFrame:
    """A row for each candidate value's hash: digest, repositories, owners."""
    values = scanned.select("source", F.explode(F.concat("base", "words")).alias("x")).select(_digest(F.col("x.value")).alias("digest"), F.coalesce("source", F.lit("")).alias("repo"))
    repos = values.distinct().withColumn("owner", F.substring_index("repo", "/", 1))
    owners = repos.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return materialize(owners.groupBy("digest").agg(F.sum("repos").alias("repositories"), F.count(F.lit(1)).alias("owners")), "ownership")


def _digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, all spans, n_live and n_example of each document."""
    scanned = scan(docs)
    owned = ownership(scanned)
    some = F.size("base") + F.size("words") > 0
    empty = F.array().cast(_SPANS)
    none = scanned.filter(~some).select("doc_id", "base", F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    each = materialize(scanned.filter(some).select("row", F.explode(F.concat("base", "words")).alias("x")).select("row", "x", _digest(F.col("x.value")).alias("digest")), "candidates")
    judged = each.join(owned, "digest").withColumn("live", F.col("owners") < WIDE)
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("live") & (F.col("x.kind") == 4), F.col("x"))).alias("more"),
        F.count_if(F.col("live")).alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
    )
    rest = scanned.filter(some).select("row", "doc_id", "base").join(by_row, "row").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", empty))).alias("spans"), "n_live", "n_example")
    return none.unionByName(rest)


def _joined(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{KINDS[kind - 1]}")

    return found.select("doc_id", count(1), count(2), count(3), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), "n_live", "n_example")


def _sql() -> str:
    quoted = {k: p.replace("'", "''") for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)}
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, source, {i} AS kind, '{k}' AS name, i.i AS i, hits, vals[i.i] AS value, gaps FROM (SELECT doc_id, source, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {2 if i == 1 else 0}) AS vals, string_split_regex(t, '{p}') AS gaps FROM d) AS m, LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i) AS i"""
        for i, (k, p) in enumerate(quoted.items(), 1)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
p AS (SELECT doc_id, source, kind, name, value, length(hits[i]) AS size, length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS start FROM m),
base AS (SELECT *, start + size AS "end" FROM p WHERE kind <> 4 AND (kind <> 1 OR length(value) >= 12)),
words AS (SELECT *, start + size AS "end" FROM p WHERE kind = 4 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')),
free AS (SELECT w.* FROM words AS w WHERE NOT EXISTS (SELECT 1 FROM base AS b WHERE b.doc_id = w.doc_id AND b.start < w."end" AND b."end" > w.start)),
c AS (SELECT * FROM base UNION ALL SELECT * FROM free),
o AS (SELECT value, count(DISTINCT split_part(source, '/', 1)) AS owners FROM c GROUP BY value),
j AS (SELECT c.*, o.owners < {WIDE} AS live FROM c JOIN o ON c.value = o.value),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 1) AS n_assign, count(*) FILTER (WHERE kind = 2) AS n_access, count(*) FILTER (WHERE kind = 3) AS n_hex,
  string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (WHERE kind <> 4) AS base,
  string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (WHERE kind <> 4 OR live) AS spans,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


SQL = _sql()
