"""Change sets: merging clusters into an existing table, and the rows that are news."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import loosen, normalize, strip_site_suffix
from eventloom.functions.urls import canonical_url, fingerprint
from eventloom.operators.cluster import resolve

PAYLOAD = ["title", "url", "summary", "source", "published", "categories", "matches", "start", "end", "date_note", "date_hint", "date_conflict", "sources", "unverifiable"]


def merge_clusters(members: DataFrame, versions: DataFrame, folded=normalize) -> DataFrame:
    """Write operations (op, doc_id, if_version, payload columns, ord: the cluster's place) for clusters with a fresh row.

    members: rows with cluster as for resolve, and doc_id (null: fresh) and calendar_id of existing ones. The existing row
    with a calendar entry, else with the smallest doc_id, is written; others of its cluster are deleted; clusters without
    a fresh row aren't touched. versions (doc_id, version) guards each write.
    """
    known = F.col("doc_id").isNotNull()
    calendar = F.nullif(F.col("calendar_id"), F.lit(""))
    keys = members.groupBy("cluster").agg(
        F.bool_or(~known).alias("fresh"),
        F.min(F.when(known, F.struct(calendar.isNull().alias("loose"), F.col("doc_id").alias("doc_id")))).alias("keep"),
        F.min_by(calendar, F.when(calendar.isNotNull(), F.col("ord"))).alias("calendar_id"),
    ).filter("fresh").select("cluster", F.col("keep.doc_id").alias("keep_id"), "calendar_id")
    rows = resolve(members.join(keys.select("cluster"), "cluster", "left_semi")).join(keys, "cluster")
    new_id = fingerprint(canonical_url(F.col("url")), loosen(folded(strip_site_suffix(F.col("title")))))
    sets = rows.select(F.lit("set").alias("op"), F.coalesce("keep_id", new_id).alias("doc_id"), *PAYLOAD, "calendar_id", F.col("cluster").alias("ord"))
    drops = members.filter(known).join(keys.select("cluster", "keep_id"), "cluster").filter("doc_id <> keep_id").select(F.lit("delete").alias("op"), "doc_id")
    ops = sets.unionByName(drops, allowMissingColumns=True)
    return ops.join(versions.select("doc_id", F.col("version").alias("if_version")), "doc_id", "left")


def mark_searched(docs: DataFrame, pending_only: bool = True) -> DataFrame:
    """Updates that set searched; pending is only what is literally false."""
    rows = docs.filter("searched = false") if pending_only else docs
    return rows.select(F.lit("update").alias("op"), F.lit("watchlist").alias("collection"), "doc_id", F.lit(True).alias("searched"))


def news(writes: DataFrame, existing: DataFrame) -> DataFrame:
    """Written rows worth telling: new ones, and existing ones whose dates changed; empty and null dates are one."""
    old = existing.select("doc_id", *(F.nullif(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("start", "end")), F.lit(True).alias("_old"))
    x = writes.filter((F.col("op") == "set") & ~F.coalesce("unverifiable", F.lit(False))).join(old, "doc_id", "left")
    same = F.nullif(F.col("start").cast("string"), F.lit("")).eqNullSafe(F.col("_start")) & F.nullif(F.col("end").cast("string"), F.lit("")).eqNullSafe(F.col("_end"))
    return x.withColumn("status", F.when(F.col("_old").isNull(), "new").when(~same, "updated")).filter("status IS NOT NULL").drop("_start", "_end", "_old")
