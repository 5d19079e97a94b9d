"""Digest, push and calendar outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import vocab as V
from eventloom.functions.text import clip, fill


# Characters of the push line, a bullet, a mail's summary and a calendar title; bullets; hours without a run.
MOST_PUSH, MOST_BULLET, MOST_MAIL, MOST_TITLE, BULLETS, QUIET_HOURS = 200, 56, 120, 200, 6, 36


def period(start: Column, end: Column, note: Column) -> Column:
    """M/D, M/D〜M/D, or one of two texts for no date."""
    day = lambda d: F.date_format(d, "M/d")
    return F.when(start.isNull(), F.when(F.coalesce(note, F.lit("")) != "", F.lit(V.PERIOD_UNSURE)).otherwise(F.lit(V.PERIOD_OPEN))).when(end.isNotNull() & (end != start), F.concat(day(start), F.lit(V.PERIOD_JOINER), day(end))).otherwise(day(start))


def label(categories: Column, match_labels: Column) -> Column:
    names = F.create_map(*[x for k, v in V.CATEGORY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    cats = F.array_join(F.transform(categories, lambda c: F.coalesce(F.element_at(names, c), c)), "・")
    return F.concat(F.lit("["), cats, F.lit("]"), F.when(F.size(match_labels) > 0, F.concat(F.lit(" "), F.array_join(match_labels, "／"))).otherwise(""))


def by_date() -> list[Column]:
    return [F.col("start").asc_nulls_last(), F.col("ord").asc()]


def push_line(items: DataFrame) -> DataFrame:
    """One line: the next event and how many more; at most 200 characters."""
    head = items.agg(F.min(F.struct(F.col("start").isNull(), "start", "ord", "end", "title", "date_note")).alias("h"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    line = F.concat_ws(" ", period(F.col("h.start"), F.col("h.end"), F.col("h.date_note")), F.col("h.title"), F.when(F.col("n") > 1, fill(V.PUSH_MORE, F.col("n") - 1)))
    return head.select(F.when(F.char_length(line) > MOST_PUSH, F.concat(F.substring(line, 1, MOST_PUSH - 3), F.lit("…"))).otherwise(line).alias("push"))


def push_bullets(items: DataFrame, keys: list[str], limit: int = BULLETS) -> DataFrame:
    """For each key a head line, the first titles by date and the number of others. Only the first ``limit`` rows of a key
    are gathered."""
    # the limit is known to the plan, so that each task passes on its first rows of a key only; counts are combined apart
    top = items.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_date()))).filter(F.col("_r") <= limit)
    g = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", clip(F.col("title"), MOST_BULLET).alias("t")))).alias("x"))
    counts = items.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    g = g.join(counts, same)
    lines = F.concat(F.array(fill(V.BULLET_HEAD, F.col("n"))), F.transform("x", lambda e: F.concat(F.lit("- "), e.t)), F.when(F.col("n") > limit, F.array(fill(V.BULLET_MORE, F.col("n") - limit))).otherwise(F.array().cast("array<string>")))
    return g.select(*keys, F.col("n").alias("n_items"), F.array_join(lines, "\n").alias("bullets"))


def email_subject(items: DataFrame, keys: list[str], today: Column) -> DataFrame:
    g = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("watched").alias("w"))
    return g.select(*keys, fill(V.MAIL_SUBJECT, F.date_format(today, "MM/dd"), F.col("n"), F.col("w")).alias("subject"))


def email_entry(today: Column) -> Column:
    """The lines of one item in the mail."""
    names = F.create_map(*[x for k, v in V.STATUS_NAMES.items() for x in (F.lit(k), F.lit(v))])
    head = F.rtrim(F.concat(F.lit("■ "), period(F.col("start"), F.col("end"), F.col("date_note")), F.lit("  "), F.col("title"), F.lit("  "), F.coalesce(F.element_at(names, F.coalesce("status", F.lit("new"))), F.lit(""))))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    indent = lambda x: F.concat(F.lit("   "), x)
    shown = F.when(some("date_hint").isNotNull(), fill(V.MAIL_HINT, F.col("date_hint"))).otherwise(F.lit(V.MAIL_NO_HINT))
    note = F.when(some("date_note").isNotNull(), fill(V.MAIL_NOTE, F.col("date_note"), shown))
    return F.concat_ws("\n", head, indent(label(F.col("categories"), F.transform("matches", lambda m: m.label))), indent(F.substring(some("summary"), 1, MOST_MAIL)), note, indent(some("url")), F.lit(""))


def email_body(items: DataFrame, today: Column) -> DataFrame:
    """One row with the mail's text."""
    g = items.withColumn("_e", email_entry(today)).agg(F.array_sort(F.collect_list(F.struct(F.col("start").isNull().alias("u"), "start", "ord", "_e"))).alias("x"), F.count_if(F.col("start").isNull()).alias("undated"))
    intro = fill(V.MAIL_INTRO, F.date_format(today, "yyyy年M月d日"))
    outro = F.when(F.col("undated") > 0, fill(V.MAIL_OUTRO, F.col("undated")))
    body = F.concat_ws("\n", intro, F.lit(""), F.array_join(F.transform("x", lambda e: e._e), "\n"), outro)
    return g.select(F.when(F.size("x") == 0, F.lit(V.MAIL_NOTHING)).otherwise(body).alias("body"))


def calendar_events(items: DataFrame) -> DataFrame:
    """Dated items as all-day entries, with the inclusive and the exclusive last day."""
    last = F.coalesce("end", "start")
    some = [F.nullif(F.col(c), F.lit("")) for c in ("summary", "url")]
    return items.filter("start IS NOT NULL").select(
        "ord", F.substring(F.concat_ws(" ", label(F.col("categories"), F.transform("matches", lambda m: m.label)), F.col("title")), 1, MOST_TITLE).alias("summary"),
        F.col("start").alias("start_date"), last.alias("end_date"), F.date_add(last, 1).alias("end_date_exclusive"), F.concat_ws("\n", *some).alias("description"),
    )


def calendar_eligible(rows: DataFrame, today: Column) -> DataFrame:
    return rows.filter(F.col("start").isNotNull() & (F.coalesce("end", "start") >= today) & F.nullif(F.col("calendar_id"), F.lit("")).isNull() & (F.coalesce(F.size("date_conflict"), F.lit(0)) <= 0))


def outbox_row(digest: DataFrame, now: Column, kind: str = "full") -> DataFrame:
    """digest (count, subject, body, bullets) as the row to send; none if there is nothing to say."""
    at = F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    doc = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(now, F.current_timezone()), "Asia/Tokyo"), "yyyyMMddHHmm")
    row = digest.select(doc.alias("doc_id"), at.alias("at"), F.lit(kind).alias("kind"), F.coalesce(F.col("count").cast("long"), F.lit(0)).alias("count"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("subject", "body", "bullets")))
    return row.filter((F.col("count") > 0) & (F.trim("body") != ""))


def run_gate(requested: Column, pending: Column) -> Column:
    return F.when(F.coalesce(requested, F.lit(False)), "full").when(pending > 0, "diff").otherwise("none")


def unhealthy(last_run: Column, error: Column, now: Column, hours: int = QUIET_HOURS) -> Column:
    return last_run.isNull() | (last_run < now - F.make_interval(hours=F.lit(hours))) | (F.coalesce(error, F.lit("")) != "")
