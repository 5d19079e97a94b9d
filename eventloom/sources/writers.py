"""Sinks: write lists, digests, outbox rows and query lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import vocab as V
from eventloom.functions.text import fill
from eventloom.operators import digest as G


def operations(ops: DataFrame, path: str) -> None:
    """A write list; the order of its rows has no meaning and isn't kept."""
    ops.drop("ord").write.mode("overwrite").json(path)


def lines(queries: DataFrame, path: str) -> None:
    """One query a line, in order of round and place."""
    queries.orderBy("round", "place").select("query").coalesce(1).write.mode("overwrite").text(path)


def digest(items: DataFrame, today: Column) -> DataFrame:
    """One row: generated_at, count, push, bullets, subject, body of items (also of none)."""
    keyed = items.withColumn("_g", F.lit(1))
    one = items.agg(F.count(F.lit(1)).alias("count"), F.count_if("watched").alias("watched"))
    subject = fill(V.MAIL_SUBJECT, F.date_format(today, "MM/dd"), F.col("count"), F.col("watched"))
    row = one.select(F.lit(1).alias("_g"), today.alias("generated_at"), "count", subject.alias("subject"))
    row = row.join(G.push_bullets(keyed, ["_g"]).select("_g", "bullets"), "_g", "left")
    for part in (G.push_line(items), G.email_body(items, today)):
        row = row.join(part.withColumn("_g", F.lit(1)), "_g", "left")
    return row.select("generated_at", "count", F.coalesce("push", F.lit("")).alias("push"), F.coalesce("bullets", F.lit("")).alias("bullets"), "subject", "body")


def event_rows(items: DataFrame) -> DataFrame:
    """Items as rows of the events table, under the names that it keeps."""
    some = lambda c: F.coalesce(c, F.lit(""))
    return items.select(
        F.col("key").alias("doc_id"), *(some(c).alias(c) for c in ("title", "url", "summary", "source")), "categories", "matches", F.col("event.start").alias("start"), F.col("event.end").alias("end"),
        some(F.col("published").cast("string")).alias("published"), some("date_note").alias("dateNote"), some("date_hint").alias("dateHint"), F.coalesce("unverifiable", F.lit(False)).alias("unverifiable"), F.col("first_seen").alias("firstSeen"),
    )


def items_from_rows(rows: DataFrame) -> DataFrame:
    """The other way: rows of the events table as members for clustering and merging."""
    return rows.select(
        "doc_id", "title", "url", "summary", "source", "published", "categories", "matches", "start", "end", F.col("start").isNotNull().alias("year_explicit"), F.col("dateNote").alias("date_note"), F.col("dateHint").alias("date_hint"),
        F.lit("").alias("date_confidence"), F.coalesce("unverifiable", F.lit(False)).alias("unverifiable"), "sources", F.lit("known").alias("status"), F.coalesce("calendarEventId", F.lit("")).alias("calendar_id"),
    )
