"""Confirmation of dates against article bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import vocab as V
from eventloom.functions.dates import MONTH_DAY, extract_ranges, month_days
from eventloom.functions.text import fill, nfkc


def confirm(items: DataFrame, bodies: DataFrame, folded=nfkc, ranges=extract_ranges) -> DataFrame:
    """items (url, event, date_hint, date_note, published date, ...) with date_confidence, body_note and corrected dates.

    bodies (url, body, error_kind, error_detail) is the fetched side; an item without url is inconclusive, one without a
    row in bodies counts as unreachable.
    """
    b = bodies.select(F.col("url").alias("_url"), folded(F.coalesce("body", F.lit(""))).alias("_body"), "error_kind", "error_detail", F.lit(True).alias("_got"))
    x = items.join(b, F.nullif(items["url"], F.lit("")) == F.col("_url"), "left").drop("_url")
    hint = folded(F.coalesce("date_hint", F.lit("")))
    hinted = F.when(F.regexp_extract(hint, MONTH_DAY, 1) != "", F.struct(F.regexp_extract(hint, MONTH_DAY, 1).cast("int").alias("m"), F.regexp_extract(hint, MONTH_DAY, 2).cast("int").alias("d")))
    target = F.when(F.col("event.start").isNotNull(), F.struct(F.month("event.start").alias("m"), F.day("event.start").alias("d"))).otherwise(hinted)
    x = x.withColumns({"_target": target, "_days": month_days(F.col("_body")), "_ranges": ranges(F.coalesce("_body", F.lit("")), F.col("published"))})
    right = F.get(F.filter("_ranges", lambda r: r.year_explicit & (F.month(r.start) == F.col("_target.m")) & (F.day(r.start) == F.col("_target.d"))), 0)
    x = x.withColumn("_right", right)
    empty = F.coalesce(F.col("url"), F.lit("")) == ""
    word = (
        F.when(empty, "inconclusive").when(F.col("_got").isNull() | F.col("error_kind").isNotNull(), "unreachable")
        .when(F.col("_target").isNull() | (F.size("_days") == 0), "inconclusive").when(~F.array_contains("_days", F.col("_target")), "contradicted")
        .when(F.col("_right").isNotNull(), "confirmed").otherwise("consistent")
    )
    x = x.withColumn("date_confidence", word)
    is_ = lambda w: F.col("date_confidence") == w
    moved = F.col("event.start").isNotNull() & (F.col("event.start") != F.col("_right.start"))
    note = (
        F.when(empty, F.lit(None).cast("string"))
        .when(is_("unreachable"), F.when(F.col("error_kind") == "blocked", F.lit(V.BODY_BLOCKED)).otherwise(fill(V.BODY_FAILED, F.coalesce("error_detail", F.lit("")))))
        .when(is_("confirmed"), F.when(moved, fill(V.BODY_CORRECTED, F.col("event.start"))).otherwise(F.lit(V.BODY_CONFIRMED)))
        .when(is_("contradicted"), F.lit(V.BODY_CONTRADICTED)).when(is_("consistent"), F.lit(V.BODY_NO_YEAR)).otherwise(F.lit(V.BODY_NO_DATE))
    )
    event = F.when(is_("confirmed"), F.col("_right")).when(is_("contradicted"), F.lit(None)).otherwise(F.col("event"))
    date_note = F.when(is_("confirmed"), F.lit("")).when(is_("contradicted"), F.lit(V.BODY_DATE_NOTE)).otherwise(F.col("date_note"))
    date_hint = F.when(is_("confirmed"), F.lit(None)).otherwise(F.col("date_hint"))
    x = x.withColumn("body_note", note).withColumns({"event": event, "date_note": date_note, "date_hint": date_hint})
    return x.drop("_target", "_days", "_ranges", "_right", "_got", "_body", "error_kind", "error_detail")
