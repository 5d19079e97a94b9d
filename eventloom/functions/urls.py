"""URL functions: canonical form, fingerprints, listing pages, posts and the dates that URLs carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import strip

# Patterns.
LISTING = r"(?i)/(?:search|tag|category|genre|ranking|animetitle|brandtitle|ballot_boxes)(?:/|\?|$)|[?&](?:keyword|query|searchWord)="
TRACKING = r"[?&](?:utm_[^=]+|fbclid|gclid|ref|ref_src|cmpid)=[^&]*"
POST = r"https?://(?:www\.)?(?:x|twitter|mobile\.twitter|fxtwitter|vxtwitter)\.com/([A-Za-z0-9_]{1,15})/status(?:es)?/(\d{10,25})"
POST_LINK = r"https?://(?:www\.)?(?:x|twitter)\.com/[A-Za-z0-9_]{1,15}/status/\d{10,25}"
PATH_DATE = r"(?<!\d)(20\d{2})[/\-_]?(\d{2})[/\-_]?(\d{2})(?!\d)"
POST_EPOCH_MS, POST_FIRST_MS, POST_LAST_MS, POST_SHIFT = 1288834974657, 1293840000000, 4102444800000, 4194304


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing separators; a parameter in first place leaves its ``&``."""
    u = strip(F.coalesce(url, F.lit("")))
    for pattern, to in (("#.*$", ""), (TRACKING, ""), (r"\?&", "?"), ("[?&]+$", ""), ("/+$", "")):
        u = F.regexp_replace(u, pattern, to)
    return u


def fingerprint(url_key: Column, title_key: Column) -> Column:
    """Sixteen hex digits of the canonical URL, or of the title's loose key if there is no URL."""
    return F.substring(F.sha1(F.coalesce(F.nullif(url_key, F.lit("")), title_key).cast("binary")), 1, 16)


def is_listing_url(url: Column) -> Column:
    return F.coalesce(url.rlike(LISTING), F.lit(False))


def post_user(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, POST, 1), F.lit(""))


def post_id(url: Column) -> Column:
    """25 digits don't fit a long."""
    return F.nullif(F.regexp_extract(url, POST, 2), F.lit("")).cast("decimal(25,0)")


def posted_at(number: Column) -> Column:
    """The time (UTC) in a post's number; null outside 2011 to 2100."""
    ms = F.floor(number.cast("decimal(25,0)") / F.lit(POST_SHIFT).cast("decimal(25,0)")).cast("decimal(25,0)") + F.lit(POST_EPOCH_MS)
    return F.when(ms.between(POST_FIRST_MS, POST_LAST_MS), F.timestamp_millis(F.when(ms.between(POST_FIRST_MS, POST_LAST_MS), ms).cast("long")))


def published_from_post(url: Column) -> Column:
    """The date in Japan on which a post was made."""
    return F.to_date(posted_at(post_id(url)) + F.expr("INTERVAL 9 HOURS"))


def published_from_path(url: Column, today: Column) -> Column:
    """The first valid date from 2000 to today in a URL's path."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), "^https?://[^/]+", "")
    days = F.transform(F.regexp_extract_all(path, F.lit(PATH_DATE), F.lit(0)), lambda x: F.try_to_date(F.regexp_replace(x, "[^0-9]", ""), "yyyyMMdd"))
    return F.get(F.filter(days, lambda d: d.isNotNull() & (d >= F.to_date(F.lit("2000-01-01"))) & (d <= today)), 0)
