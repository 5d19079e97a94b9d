"""Steps that chain operators: confirmation, merging into the events table, and the digest of what is news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import loosen, normalize, strip_site_suffix
from eventloom.functions.urls import canonical_url, fingerprint
from eventloom.operators import cluster as C
from eventloom.operators import confirm as O
from eventloom.operators import merge as M
from eventloom.shared import materialize
from eventloom.sources import writers

SOURCES = "array<struct<name: string, url: string, published: string>>"


def _labels() -> Column:
    return F.array_distinct(F.filter(F.transform("matches", lambda m: m.label), lambda x: F.coalesce(x, F.lit("")) != ""))


def as_members(items: DataFrame) -> DataFrame:
    """Items of a run as fresh members for clustering and merging."""
    have = set(items.columns)

    def own(name: str, other: Column) -> Column:
        return (F.col(name) if name in have else other).alias(name)

    nothing = F.lit("")
    return items.select(
        "ord", "title", "url", "summary", "source", F.coalesce(F.col("published").cast("string"), nothing).alias("published"), "categories", "matches",
        F.col("event.start").alias("start"), F.col("event.end").alias("end"), F.coalesce("event.year_explicit", F.lit(False)).alias("year_explicit"), "date_note", "date_hint",
        own("date_confidence", nothing), F.coalesce("unverifiable", F.lit(False)).alias("unverifiable"), own("sources", F.array().cast(SOURCES)), own("status", F.lit("new")),
        own("doc_id", F.lit(None).cast("string")), own("calendar_id", nothing),
    )


def confirmed(items: DataFrame, bodies: DataFrame) -> DataFrame:
    """Items with their dates held against article bodies, one row for each event. Clusters come after corrections, so that
    conflicts are judged by corrected dates."""
    return C.collapse(as_members(materialize(O.confirm(items, bodies), "confirmed", wide=True)))


def merge_existing(rows: DataFrame, fresh: DataFrame, versions: DataFrame) -> DataFrame:
    """Write operations that fold fresh members into rows of the events table; existing rows come first by doc_id."""
    old = writers.items_from_rows(rows).withColumn("ord", F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("n"), F.col("doc_id").alias("key")))
    new = fresh.withColumn("ord", F.struct(F.lit(1).alias("batch"), F.col("ord").cast("long").alias("n"), F.lit("").alias("key")))
    both = materialize(old.unionByName(new, allowMissingColumns=True), "both", wide=True)
    # components work on numbers, which grow in the same order over the sorted partitions
    ranks = materialize(both.select("ord").orderBy("ord").withColumn("place", F.monotonically_increasing_id()), "ranks", wide=True)
    members = materialize(both.join(ranks, "ord").drop("ord").withColumnRenamed("place", "ord").withColumn("labels", _labels()), "members", wide=True)
    pairs = C.same_event_pairs(C.signals(members))
    return M.merge_clusters(materialize(C.clusters(members, pairs), "clustered", wide=True), versions)


def as_writes(items: DataFrame) -> DataFrame:
    """A set operation for each item, under its own fingerprint."""
    m = as_members(items)
    doc_id = fingerprint(canonical_url(F.col("url")), loosen(normalize(strip_site_suffix(F.col("title")))))
    first = items.select("ord", (F.col("first_seen") if "first_seen" in items.columns else F.lit(None).cast("date")).alias("first_seen"))
    return m.withColumns({"op": F.lit("set"), "doc_id": doc_id, "date_conflict": F.array().cast("array<struct<start: date, end: date, source: string, url: string>>")}).join(first, "ord").select("op", "doc_id", *M.PAYLOAD, "first_seen", "ord")


def news_items(writes: DataFrame, existing: DataFrame) -> DataFrame:
    """The written rows that are news, as items of a digest."""
    return M.news(writes, existing).withColumn("watched", F.coalesce(F.size("matches"), F.lit(0)) > 0)


def news_digest(writes: DataFrame, existing: DataFrame, today: Column) -> DataFrame:
    """The digest of what is news after merging: a row that an event only got another source for isn't told again."""
    return writers.digest(materialize(news_items(writes, existing), "news"), today)
