"""The whole run: candidates to dated, deduplicated items, their status against the state, and the state afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import dates as D
from eventloom.functions import text as X
from eventloom.functions import urls as U
from eventloom.functions import vocab as V
from eventloom.operators import rules as R
from eventloom.operators import state as S
from eventloom.shared import materialize


@dataclass(frozen=True)
class Config:
    """What a run goes by. Nothing reads the clock: today is a parameter."""

    today: date
    works: Sequence[Mapping] = ()
    people: Sequence[Mapping] = ()
    categories: Sequence[str] = field(default_factory=lambda: tuple(V.CATEGORY_WORDS))
    include_unmatched: bool = False
    drop_past_events: bool = True


def _joined(*names: str) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(n), F.lit("")) for n in names])


def evaluate(candidates: DataFrame, config: Config) -> DataFrame:
    """Candidates (ord, title, url, summary, snippet, source, published) that a rule and the watch list keep, with
    categories, matches and watched. The cheap test of the URL comes before the Arrow UDF of the key."""
    empty = [c for c in ("title", "url", "summary", "snippet", "source", "published")]
    c = candidates.withColumns({n: F.coalesce(n, F.lit("")) for n in empty}).filter(~U.is_listing_url(F.col("url")))
    c = c.withColumn("title", X.strip_site_suffix(F.col("title")))
    c = c.withColumn("_key", X.key_once(_joined("title", "summary", "url")))
    c = c.withColumn("categories", R.event_fallback(F.col("_key"), R.classify(F.col("_key"), config.categories), config.categories)).filter(F.size("categories") > 0)
    c = c.withColumn("matches", R.match_watchlist(F.col("_key"), X.loosen(F.col("_key")), config.works, config.people)).withColumn("watched", F.size("matches") > 0)
    return (c if config.include_unmatched else c.filter("watched")).drop("_key")


def keyed(items: DataFrame) -> DataFrame:
    """Items with their fingerprint, the first of each."""
    title = X.loosen(X.normalize(X.strip_site_suffix(F.col("title"))))
    return S.first_per_key(items.withColumn("key", U.fingerprint(U.canonical_url(F.col("url")), title)), "key", "ord")


def published_on(today: Column) -> Column:
    """From a post's number, else the URL's path, else the given text in a known format; prose is read with the text."""
    return F.coalesce(U.published_from_post(F.col("url")), U.published_from_path(F.col("url"), today), D.parse_published(F.col("published")))


def dated(items: DataFrame, config: Config) -> DataFrame:
    """Items with event, date_note, date_hint, unverifiable; stale and past ones are gone. Texts go to Python once, without
    those that are known to be stale; dated prose in ``published`` only where nothing else gives a date."""
    today = F.lit(config.today)
    x = items.withColumn("_known", published_on(today)).filter(~R.is_stale(F.col("_known"), today))
    x = x.withColumn("_d", D.read_dates(_joined("title", "snippet", "summary"), F.col("_known"), F.when(F.col("_known").isNull(), F.trim("published"))))
    x = x.withColumn("published", F.col("_d.published")).filter(~R.is_stale(F.col("published"), today))
    x = x.withColumn("_range", F.when(F.col("_d.start").isNotNull(), F.struct(*[F.col(f"_d.{n}").alias(n) for n in D.RANGE.names])))
    r = F.col("_range")
    x = x.withColumn("_v", R.assess(r["start"], r["end"], F.col("published"), today, r["year_explicit"], F.col("categories")))
    ok, has = F.col("_v.accepted"), r.isNotNull()
    hint = F.nullif(F.when(has, r["raw"]).otherwise(F.col("_d.bare")), F.lit(""))
    by_month = ~ok & hint.isNull() & ~has & F.col("_d.month").isNotNull()
    x = x.withColumns({
        "event": F.when(ok, r),
        "date_hint": F.when(ok, F.lit(None)).when(hint.isNotNull(), hint).when(by_month, F.col("_d.month")),
        "date_note": F.when(ok, "").when(hint.isNotNull() & ~has, V.NOTE_NO_YEAR).when(by_month, V.NOTE_MONTH).otherwise(F.col("_v.reason")),
        "unverifiable": ~ok & F.col("published").isNull() & ~(by_month & F.col("_d.month_explicit")),
    })
    if config.drop_past_events:
        x = x.filter(~R.has_ended(F.col("event.start"), F.col("event.end"), today))
    return x.drop("_known", "_d", "_range", "_v")


def run(candidates: DataFrame, seen: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """New and updated items in order of ord, and the state after the run. Items are made once and written, as both results
    read them."""
    items = materialize(dated(keyed(evaluate(candidates, config)), config).withColumn("event_date", F.col("event.start")), "items", wide=True)
    told = S.status(items, seen)
    after = S.remember(seen, items, F.lit(config.today))
    first = told.join(after.select("key", "first_seen"), "key").filter("status <> 'known'")
    return first, after
