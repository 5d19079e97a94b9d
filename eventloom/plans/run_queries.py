"""The whole run and the feed source as queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import urls as U
from eventloom.functions import vocab as V
from eventloom.functions.urls import canonical_url, fingerprint
from eventloom.plans.ingest import Config, dated, run
from eventloom.plans.registry import Tables, query
from eventloom.sources import readers as I

TODAY = "1998-07-01"
CONFIG = Config(date(1998, 7, 1), works=[{"title": "星の海", "aliases": []}])


@query(f"""
WITH c AS (SELECT o_orderkey AS ord, o_orderdate::DATE AS pub, (o_orderdate::DATE + (o_orderkey % 60)::INT)::DATE AS start FROM orders WHERE o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND o_orderkey % 3 = 0))
SELECT ord, start, CASE WHEN ord % 16 = 0 THEN 'updated' ELSE 'new' END AS status FROM c WHERE DATE '{TODAY}' - pub <= 180 AND start >= DATE '{TODAY}' AND ord % 16 <> 8
""")
def ingest_run(t: Tables) -> DataFrame:
    """Orders as articles: half of them off topic, some twice under one URL, some seen before without or with a date."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    title = F.when(k % 4 == 0, "星の海 リバイバル上映 - コミックナタリー").when(k % 4 == 1, "『星・の・海』 グッズ").when(k % 4 == 2, "別作品 リバイバル上映").otherwise("星の海 の話")
    url = F.when((k % 4 == 1) & (k % 3 == 0), F.concat(F.lit("https://a.example/b"), k.cast("string"))).otherwise(F.concat(F.lit("https://a.example/"), F.floor(k / 2).cast("string"), F.lit("?utm_source=x")))
    c = t.orders.select(k.alias("ord"), title.alias("title"), url.alias("url"), F.lit("").alias("summary"), F.date_format(F.date_add(d, (k % 60).cast("int")), "yyyy年M月d日開催").alias("snippet"), F.lit("s").alias("source"), F.date_format(d, "yyyy-MM-dd").alias("published"))
    key = fingerprint(canonical_url(url), F.lit(""))
    seen = t.orders.filter(k % 8 == 0).select(key.alias("key"), d.alias("first_seen"), d.alias("last_seen"), F.lit("t").alias("title"), url.alias("url"), F.when(k % 16 == 8, d).alias("event_date"))
    items, _ = run(c, seen, CONFIG)
    return items.select("ord", F.col("event.start").alias("start"), "status")


@query("SELECT p_brand AS source, p_partkey::VARCHAR AS url, p_name || ' & co' AS title, p_type AS published FROM part WHERE p_partkey % 10 > 0")
def feed_entries(t: Tables) -> DataFrame:
    """A feed for each brand, in two dialects; entries without a title are left out."""
    k = F.col("p_partkey")
    name = F.when(k % 10 > 0, F.concat(F.lit("<title>"), "p_name", F.lit(" &amp; co</title>"))).otherwise("")
    rss = F.concat(F.lit("<item>"), name, F.lit("<link>"), k.cast("string"), F.lit("</link><pubDate>"), "p_type", F.lit("</pubDate></item>"))
    atom = F.concat(F.lit("<entry>"), name, F.lit("<link href='"), k.cast("string"), F.lit("'/><updated>"), "p_type", F.lit("</updated></entry>"))
    odd = F.substring("p_brand", 7, 3).cast("int") % 2 == 1
    files = t.part.groupBy(F.col("p_brand").alias("source")).agg(F.array_join(F.collect_list(F.when(odd, rss).otherwise(atom)), "").alias("x"), F.first(odd).alias("odd"))
    content = F.when(F.col("odd"), F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), "x", F.lit("</feed>")))
    return I.feeds(files.select("source", content.cast("binary").alias("content"))).select("source", "url", "title", "published")


EARLY = Config(date(1990, 1, 1))


def _noted(t: Tables) -> DataFrame:
    """Orders as items whose dates are written in five ways, published or not; nothing is past on the day of the run."""
    k, d = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    text = F.when(k == 0, F.date_format(F.date_add(d, 60), "yyyy年M月d日開催")).when(k == 1, F.date_format(d, "M月d日開催")).when(k == 2, F.date_format(d, "'20'yy年M月開催")).otherwise("開催")
    published = F.when(k.isin(1, 4), "").otherwise(F.date_format(d, "yyyy-MM-dd"))
    nothing = F.lit("")
    items = t.orders.select(F.col("o_orderkey").alias("ord"), F.lit("t").alias("title"), F.concat(F.lit("https://a.example/"), F.col("o_orderkey").cast("string")).alias("url"), nothing.alias("summary"), text.alias("snippet"), F.lit("s").alias("source"), published.alias("published"), F.array(F.lit("goods")).alias("categories"))
    return dated(items, EARLY)


@query(f"""
SELECT o_orderkey AS ord, CASE k WHEN 0 THEN '' WHEN 1 THEN '{V.NOTE_NO_YEAR}' WHEN 2 THEN '{V.NOTE_MONTH}' ELSE '{V.REASON_NO_DATE}' END AS note,
 CASE k WHEN 1 THEN month(o_orderdate) || '月' || day(o_orderdate) || '日' WHEN 2 THEN '20' || strftime(o_orderdate, '%y') || '年' || month(o_orderdate) || '月' ELSE '' END AS hint, k IN (1, 4) AS unverifiable
FROM (SELECT *, o_orderkey % 5 AS k FROM orders) AS o
""")
def run_notes(t: Tables) -> DataFrame:
    """Why a date isn't told, what the text says instead, and whether the time is wholly unknown."""
    return _noted(t).select("ord", F.col("date_note").alias("note"), F.coalesce("date_hint", F.lit("")).alias("hint"), "unverifiable")


@query("SELECT event_id AS ord, CASE event_id % 4 WHEN 0 THEN (date_trunc('second', ts) + INTERVAL 9 HOURS)::DATE WHEN 3 THEN NULL ELSE ts::DATE END AS published FROM events")
def publish_date(t: Tables) -> DataFrame:
    """From a post's number, else the URL's path, else dated prose, else nothing, whatever the later sources say."""
    k, d = F.col("event_id") % 4, F.to_date("ts")
    number = F.shiftleft(F.unix_seconds(F.date_trunc("second", "ts")) * 1000 - U.POST_EPOCH_MS, 22)
    url = F.when(k == 0, F.concat(F.lit("https://x.com/u/status/"), number.cast("string"), F.lit("/2024/01/01"))).when(k == 1, F.date_format(d, "'https://a.example/'yyyy'/'MM'/'dd'/x'")).otherwise("https://a.example/x")
    text = F.when(k == 3, "soon").when(k == 2, F.date_format(d, "yyyy年M月d日発表")).otherwise("2024-01-02")
    nothing = F.lit("")
    items = t.events.select(F.col("event_id").alias("ord"), nothing.alias("title"), url.alias("url"), nothing.alias("summary"), nothing.alias("snippet"), text.alias("published"), F.array(F.lit("goods")).alias("categories"))
    return dated(items, Config(date(2024, 2, 1))).select("ord", "published")


@query("SELECT page_id, sha256(html) AS text_sha256 FROM pages")
def page_decode(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(I.decode_page(F.encode("html", "UTF-8")), 256).alias("text_sha256"))


@query("SELECT page_id::VARCHAR AS name, CASE WHEN page_id % 3 > 0 THEN 'https://www.youtube.com/feeds/videos.xml?channel_id=UC' || lpad(page_id::VARCHAR, 22, '0') END AS url FROM pages")
def channel_feeds(t: Tables) -> DataFrame:
    """Two of three pages name their channel, in two ways."""
    k = F.col("page_id")
    number = F.concat(F.lit('"UC'), F.lpad(k.cast("string"), 22, "0"), F.lit('"'))
    html = F.concat("html", F.when(k % 3 == 1, F.concat(F.lit('{"channelId":'), number)).when(k % 3 == 2, F.concat(F.lit('{"externalId" : '), number)).otherwise(""))
    return I.channel_feeds(t.pages.select(k.cast("string").alias("name"), html.alias("html")))


@query("SELECT p_brand AS file, p_name AS title, p_partkey::VARCHAR AS url FROM part WHERE p_brand <> 'Brand#11' AND p_partkey % 7 > 0")
def inbox_files(t: Tables) -> DataFrame:
    """A file for each brand, after a mark and blanks; that of one brand is no array, and every seventh element no object."""
    k = F.col("p_partkey")
    row = F.to_json(F.struct(F.col("p_name").alias("title"), k.cast("string").alias("url"), F.lit(1).alias("more")))
    array = F.concat(F.lit("\ufeff \n["), F.array_join(F.collect_list(F.when(k % 7 > 0, row).otherwise("5")), ","), F.lit("]"))
    files = t.part.groupBy(F.col("p_brand").alias("file")).agg(array.alias("value"))
    files = files.withColumn("value", F.when(F.col("file") == "Brand#11", '{"title": "no array"}').otherwise(F.col("value")))
    return I.inbox_rows(files).select("file", "title", "url")


@query("SELECT o_orderkey::VARCHAR AS key, o_orderdate::DATE AS first_seen, (o_orderdate::DATE + 3)::DATE AS last_seen, o_orderpriority AS title FROM orders WHERE o_custkey % 5 > 0")
def state_documents(t: Tables) -> DataFrame:
    """A document for each customer; every fifth holds no entries that could be read."""
    d = F.to_date("o_orderdate")
    entry = F.struct(d.alias("first_seen"), F.date_add(d, 3).alias("last_seen"), F.col("o_orderpriority").alias("title"), F.lit("u").alias("url"))
    docs = t.orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), entry))).alias("entries"))).alias("value"))
    value = F.when(F.col("o_custkey") % 10 == 0, '{"entries": 5}').when(F.col("o_custkey") % 5 == 0, "nonsense").otherwise(F.col("value"))
    return I.seen_state(t.orders.sparkSession, docs.select(value.alias("value"))).select("key", "first_seen", "last_seen", "title")
