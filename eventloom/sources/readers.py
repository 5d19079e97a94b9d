"""Sources: JSON inboxes, document folders, feeds, post payloads, scraped links and fetched bodies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from eventloom.functions.text import html_to_text
from eventloom.functions.urls import POST, POST_LINK, posted_at
from eventloom.operators.state import first_per_key

CANDIDATE = "title string, url string, summary string, snippet string, source string, published string"
SEEN = "key string, first_seen date, last_seen date, title string, url string, event_date date"
# Charset names to look for in a page's head, and their codecs.
CHARSETS = [("shift_jis", "cp932"), ("shift-jis", "cp932"), ("windows-31j", "cp932"), ("euc-jp", "euc_jp"), ("iso-2022-jp", "iso2022_jp")]
MOST_BYTES, SNIFFED = 2_000_000, 4096
# Characters of a feed's summary and of a scraped post, and HTTP codes of a refusal.
MOST_SUMMARY, MOST_POST, REFUSALS = 400, 600, (403, 407)
# Fixed value: how a page names its channel.
CHANNEL = r'"(?:channelId|externalId)"\s*:\s*"(UC[\w-]{22})"'


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of candidates."""
    return spark.read.schema(CANDIDATE).option("multiLine", True).json(path)


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of all JSON files of a folder with ord, by file name and place. Files that don't parse or aren't arrays,
    and elements that aren't objects, are left out."""
    return inbox_rows(spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"))


def inbox_rows(files: DataFrame) -> DataFrame:
    """The same of files (file, value) that have been read."""
    raw = files.select("file", F.regexp_replace("value", r"^\x{FEFF}?\s+|^\x{FEFF}|\s+$", "").alias("raw"))
    rows = raw.filter(F.col("raw").startswith("[")).select("file", F.posexplode(F.from_json("raw", "array<string>")).alias("place", "x")).filter(F.ltrim("x").startswith("{"))
    out = rows.select("file", "place", F.from_json("x", CANDIDATE).alias("c")).select("file", "place", "c.*")
    return out.withColumn("ord", F.struct("file", "place"))


def append(existing: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of both; those of existing come first (batch 0)."""
    return existing.withColumn("batch", F.lit(0)).unionByName(more.withColumn("batch", F.lit(1)), allowMissingColumns=True)


def documents_by_name(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON documents, each named by its file."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json").withColumn("doc_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


#: Rows of the events table as documents.
EVENT = "title string, url string, summary string, source string, published string, categories array<string>, matches array<struct<kind: string, label: string, role: string>>, start date, end date, dateNote string, dateHint string, dateConflict array<struct<start: date, end: date, source: string, url: string>>, sources array<struct<name: string, url: string, published: string>>, unverifiable boolean, firstSeen date, calendarEventId string"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of doc_id and version as rows."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, long>")).alias("doc_id", "version"))


def post_candidates(posts: DataFrame) -> DataFrame:
    """Posts (url, user, posted, text, ord) as candidates, the first of each url; the text is handed on as it is."""
    text = F.coalesce("text", F.lit(""))
    title = F.when(text != "", text).otherwise(F.concat(F.lit("@"), "user", F.lit(" の投稿")))
    rows = posts.select("ord", title.alias("title"), "url", F.lit("").alias("summary"), text.alias("snippet"), F.concat(F.lit("X (@"), "user", F.lit(")")).alias("source"), F.coalesce(F.col("posted").cast("string"), F.lit("")).alias("published"))
    return first_per_key(rows, "url", "ord")


def seen_state(spark: SparkSession, documents: DataFrame | None) -> DataFrame:
    """State rows from documents (value: JSON with an object ``entries``); anything else is an empty state."""
    if documents is None:
        return spark.createDataFrame([], SEEN)
    entry = "map<string, struct<first_seen: date, last_seen: date, title: string, url: string, event_date: date>>"
    parsed = documents.select(F.from_json("value", f"entries {entry}").alias("s"))
    return parsed.select(F.explode("s.entries").alias("key", "e")).select("key", "e.*")


def parse_feed(data: bytes) -> list[dict]:
    """Entries of RSS, RDF or Atom whatever the namespaces; of several names for a field the first in the document counts."""
    names = {"title": {"title"}, "url": {"link", "id"}, "summary": {"description", "summary", "content"}, "published": {"pubDate", "date", "published", "updated"}}
    # a first element that has text or an address ends the search, even if it is blank
    out = []
    for element in ElementTree.fromstring(data).iter():
        if element.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        row: dict[str, str] = {}
        for child in element:
            value = child.text or child.get("href")
            for field, tags in names.items():
                if value and field not in row and child.tag.rpartition("}")[2] in tags:
                    row[field] = value.strip()
        row = dict.fromkeys(names, "") | row
        if row["title"]:
            out.append(row | {"summary": row["summary"][:MOST_SUMMARY]})
    return out


def feeds(files: DataFrame) -> DataFrame:
    """files (source, content binary) as candidates with ord; a broken feed gives one row with error and no title."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["source", "place", "title", "url", "summary", "published", "error"]
        for batch in batches:
            rows = []
            for source, content in zip(batch["source"], batch["content"], strict=True):
                try:
                    rows += [(source, i, x["title"], x["url"], x["summary"], x["published"], None) for i, x in enumerate(parse_feed(bytes(content)))]
                except ElementTree.ParseError as e:
                    rows.append((source, -1, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=cols)

    return files.select("source", "content").mapInPandas(run, "source string, place int, title string, url string, summary string, published string, error string")


def recent(rows: DataFrame, published: Column, today: Column, days: int = 14) -> DataFrame:
    """Rows not older than so many days; those without a date stay."""
    return rows.filter(published.isNull() | (published >= F.date_sub(today, days)))


PAYLOAD = "data array<struct<id: string, author_id: string, text: string, created_at: string>>, includes struct<users: array<struct<id: string, username: string>>>"


def posts(payloads: DataFrame) -> DataFrame:
    """Posts of API payloads (column value: JSON): url, user, id, posted (UTC date), text. A post without known author has
    the user ``i``; a broken time has no date."""
    p = payloads.select(F.from_json("value", PAYLOAD).alias("p")).select("p.data", F.coalesce("p.includes.users", F.array().cast("array<struct<id: string, username: string>>")).alias("users"))
    x = p.select("users", F.explode("data").alias("d"))
    user = F.coalesce(F.get(F.filter("users", lambda u: u.id == F.col("d.author_id")), 0)["username"], F.lit("i"))
    posted = F.to_date(F.try_to_timestamp(F.col("d.created_at")))
    return x.select(user.alias("user"), F.col("d.id").alias("id"), posted.alias("posted"), F.coalesce("d.text", F.lit("")).alias("text")).withColumn("url", F.concat(F.lit("https://x.com/"), F.col("user"), F.lit("/status/"), F.col("id")))


def status_links(pages: DataFrame, key: str, html: str, entities=None) -> DataFrame:
    """Posts that pages link to, the first of each number on a page. Text is only known where a page links to one post."""
    found = pages.select(key, html, F.posexplode(F.regexp_extract_all(html, F.lit(POST_LINK), F.lit(0))).alias("place", "link"))
    found = found.select(key, html, "place", F.regexp_extract("link", POST, 1).alias("user"), F.regexp_extract("link", POST, 2).alias("id"))
    each = found.groupBy(key, "id").agg(F.min_by("user", "place").alias("user"), F.min("place").alias("place"))
    one = each.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(key)
    plain = html_to_text(F.col(html), entities) if entities else html_to_text(F.col(html))
    text = pages.join(one, key, "left_semi").select(key, F.substring(plain, 1, MOST_POST).alias("text"))
    out = each.join(text, key, "left")
    return out.select(key, "place", "user", "id", F.concat(F.lit("https://x.com/"), F.col("user"), F.lit("/status/"), F.col("id")).alias("url"), F.to_date(posted_at(F.col("id").cast("decimal(25,0)"))).alias("posted"), F.coalesce("text", F.lit("")).alias("text"))


def collected(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row of each url (by ord), and how many rows each backend gave."""
    return first_per_key(rows, "url", "ord"), rows.groupBy("backend").agg(F.count(F.lit(1)).alias("n"))


@pandas_udf(StringType())
def decode_page(pages: pd.Series) -> pd.Series:
    """Bytes as text by the charset that the page's head names, else UTF-8; bad bytes are replaced."""

    def one(data) -> str | None:
        if data is None:
            return None
        head = bytes(data[:SNIFFED]).decode("ascii", "ignore").lower()
        return bytes(data).decode(next((codec for name, codec in CHARSETS if name in head), "utf-8"), "replace")

    return pages.map(one)


class FetchError(OSError):
    """A fetch that failed, with the HTTP code if there was an answer."""

    def __init__(self, detail: str, code: int | None = None):
        super().__init__(detail)
        self.code = code


def error_kind(e: Exception) -> str:
    """``blocked`` for a refusal, which a proxy also gives as the reason why no connection was made, else ``unreachable``. A
    code decides where there is one (an attribute, or a message that begins with it); other errors count by their reason,
    never by what else their message holds."""
    said = re.match(r"HTTP (?:Error )?(\d{3})\b", str(e))
    code = getattr(e, "code", None) or (int(said[1]) if said else None)
    if isinstance(code, int):
        return "blocked" if code in REFUSALS else "unreachable"
    reason = str(getattr(e, "reason", ""))
    return "blocked" if any(str(c) in reason for c in REFUSALS) else "unreachable"


def fetched(urls: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """urls (url, ...) with raw, error_kind and error_detail. fetch runs on the executors, should read no more than
    ``MOST_BYTES`` (more is cut) and raises OSError, best a FetchError, or ValueError."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((fetch(url)[:MOST_BYTES], None, None))
                except (OSError, ValueError) as e:
                    rows.append((None, error_kind(e), str(e)))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=["raw", "error_kind", "error_detail"])], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInPandas(run, f"{kept}, raw binary, error_kind string, error_detail string")


def bodies(urls: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """The different urls (url): url, body, error_kind, error_detail."""
    got = fetched(urls.select("url").distinct(), fetch)
    return got.select("url", html_to_text(decode_page("raw")).alias("body"), "error_kind", "error_detail")


def channel_feeds(pages: DataFrame) -> DataFrame:
    """pages (name, html) of channels with the feed's url; null if the page names no channel."""
    number = F.nullif(F.regexp_extract("html", CHANNEL, 1), F.lit(""))
    return pages.select("name", F.concat(F.lit("https://www.youtube.com/feeds/videos.xml?channel_id="), number).alias("url"))


def reachability(probes: DataFrame) -> DataFrame:
    """probes (kind, ok) by kind."""
    return probes.groupBy("kind").agg(F.count_if("ok").alias("reachable"), F.count(F.lit(1)).alias("total"))
