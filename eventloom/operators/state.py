"""State across runs: first in a run, status against what was seen, upsert and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import vocab as V


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. min_by combines before the shuffle, so that a hot key sends one row a task."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")


def status(items: DataFrame, seen: DataFrame) -> DataFrame:
    """items (key, event_date, ...) with status: new, updated (a date that was unknown), known."""
    known = seen.select("key", F.col("event_date").alias("_seen_date"), F.lit(True).alias("_seen"))
    word = F.when(F.col("_seen").isNull(), "new").when(F.col("event_date").isNotNull() & F.col("_seen_date").isNull(), "updated").otherwise("known")
    return items.join(known, "key", "left").withColumn("status", word).drop("_seen", "_seen_date")


def remember(seen: DataFrame, items: DataFrame, today: Column) -> DataFrame:
    """seen (key, first_seen, last_seen, title, url, event_date) after a run: first_seen and title stay, last_seen and url
    are new, a date is only overwritten by a date."""
    new = items.select("key", *(F.col(c).alias(f"_{c}") for c in ("title", "url", "event_date")), F.lit(True).alias("_now"))
    both = seen.join(new, "key", "full_outer")
    now = F.col("_now").isNotNull()
    return both.select(
        "key",
        F.coalesce("first_seen", today).alias("first_seen"),
        F.when(now, today).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(F.col("first_seen").isNull(), F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(now, F.col("_url")).otherwise(F.col("url")).alias("url"),
        F.coalesce("_event_date", "event_date").alias("event_date"),
    )


def prune(seen: DataFrame, today: Column, days: int = V.RETENTION_DAYS) -> DataFrame:
    return seen.filter(F.col("last_seen") >= F.date_sub(today, days))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
