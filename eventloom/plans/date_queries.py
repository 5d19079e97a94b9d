"""Queries of the date operators. The tables hold no dated prose, so that it is made from their dates inside each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import dates as D
from eventloom.functions import urls as U
from eventloom.functions import vocab as V
from eventloom.operators import confirm as C
from eventloom.operators import rules as R
from eventloom.plans.registry import Tables, query

TODAY = "1998-07-01"
#: The weekday's sign of a DuckDB date.
_SIGN = "substr('日月火水木金土', dayofweek({d})::INT + 1, 1)"


def today() -> Column:
    return F.to_date(F.lit(TODAY))


def _order_date() -> Column:
    return F.to_date("o_orderdate")


def _sign(d: Column) -> Column:
    return F.substring(F.lit(D.WEEKDAYS), F.weekday(d) + 1, F.lit(1))


@query(f"""
WITH x AS (SELECT DISTINCT month(l_shipdate)::INT AS m, day(l_shipdate)::INT AS d, o_orderdate::DATE AS ref, CASE WHEN l_orderkey % 3 = 0 THEN {_SIGN.format(d='l_shipdate')} END AS mark FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT x.*, y.y, try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', (year(ref) + y.y)::INT, m, d) AS DATE) AS dt FROM x CROSS JOIN (SELECT unnest([-1, 0, 1]) AS y) AS y),
r AS (SELECT m, d, ref, mark, y, dt, abs(dt - ref) AS away, mark IS NULL OR {_SIGN.format(d='dt')} = mark AS fits FROM c WHERE dt IS NOT NULL AND abs(dt - ref) <= {V.INFER_DAYS}),
b AS (SELECT *, row_number() OVER (PARTITION BY m, d, ref, mark ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, away, CASE WHEN y = 0 THEN 0 ELSE 1 END, y) AS k FROM r)
SELECT x.m, x.d, x.ref, coalesce(x.mark, '') AS mark, CASE WHEN b.fits THEN year(b.dt) END AS inferred FROM x LEFT JOIN b ON b.k = 1 AND b.m = x.m AND b.d = x.d AND b.ref = x.ref AND b.mark IS NOT DISTINCT FROM x.mark
""")
def infer_year(t: Tables) -> DataFrame:
    ship = F.to_date("l_shipdate")
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.select(F.month(ship).alias("m"), F.day(ship).alias("d"), _order_date().alias("ref"), F.when(F.col("l_orderkey") % 3 == 0, _sign(ship)).alias("mark")).distinct()
    return x.select("m", "d", "ref", F.coalesce("mark", F.lit("")).alias("mark"), D.infer_year(F.col("m"), F.col("d"), F.col("ref"), F.col("mark")).cast("long").alias("inferred"))


@query(f"SELECT o_orderkey, o_orderkey % 7 = 0 OR {_SIGN.format(d='o_orderdate')} = substr('月火水木金土日', (o_orderkey % 7 + 1)::INT, 1) AS matches FROM orders")
def weekday_check(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 7
    mark = F.when(k != 0, F.substring(F.lit(D.WEEKDAYS), (k + 1).cast("int"), F.lit(1)))
    return t.orders.select("o_orderkey", D.weekday_matches(_order_date(), mark).alias("matches"))


@query("SELECT o_orderkey, (o_orderdate::DATE + CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 9 + 1) * 7 - 1 WHEN 1 THEN (o_orderkey % 9 + 1) - 1 WHEN 2 THEN (o_orderkey % 9 + 1) * 30 - 1 END::INT)::DATE AS last_day FROM orders")
def duration_end(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    unit = F.when(k % 4 == 0, "週間").when(k % 4 == 1, "日間").when(k % 4 == 2, "ヶ月").otherwise("年")
    return t.orders.select("o_orderkey", D.duration_end(_order_date(), F.concat(F.lit("より"), (k % 9 + 1).cast("string"), unit, F.lit("限定"))).alias("last_day"))


@query("SELECT o_orderkey, (o_orderdate::DATE + 1)::DATE AS exclusive FROM orders")
def exclusive_end(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.date_add(_order_date(), 1).alias("exclusive"))


@query("SELECT o_orderkey, o_orderdate::DATE AS read, o_orderkey % 3 <> 1 AS year_explicit FROM orders")
def date_roundtrip(t: Tables) -> DataFrame:
    """A date written in three ways and read again; the second has no year and is read near its own date."""
    d, k = _order_date(), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.date_format(d, "yyyy年M月d日"), F.lit("("), _sign(d), F.lit(")開催"))).when(k == 1, F.date_format(d, "M月d日公開")).otherwise(F.date_format(d, "'全角 'yyyy/MM/dd' から'"))
    x = t.orders.select("o_orderkey", F.get(D.extract_ranges(F.concat(F.lit("決定 "), text), d), 0).alias("r"))
    return x.select("o_orderkey", F.col("r.start").alias("read"), F.col("r.year_explicit").alias("year_explicit"))


@query("""
SELECT o_orderkey, o_orderdate::DATE AS start, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderdate::DATE + (o_orderkey % 50 + 1)::INT)::DATE WHEN o_orderkey % 3 = 1 THEN (o_orderdate::DATE + ((o_orderkey % 4 + 1) * 7 - 1)::INT)::DATE END AS "end", 1 AS ranges FROM orders
""")
def range_extract(t: Tables) -> DataFrame:
    d, k = _order_date(), F.col("o_orderkey")
    later = F.date_add(d, (k % 50 + 1).cast("int"))
    text = F.when(k % 3 == 0, F.concat(F.date_format(d, "yyyy年M月d日"), F.lit("〜"), F.date_format(later, "yyyy年M月d日"))).when(k % 3 == 1, F.concat(F.date_format(d, "yyyy/M/d"), F.lit("より"), (k % 4 + 1).cast("string"), F.lit("週間限定"))).otherwise(F.date_format(d, "yyyy.M.d"))
    x = t.orders.select("o_orderkey", D.extract_ranges(text, F.lit(None).cast("date")).alias("r"))
    return x.select("o_orderkey", F.get("r", 0)["start"].alias("start"), F.get("r", 0)["end"].alias("end"), F.size("r").alias("ranges"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 AND o_orderdate::DATE <= DATE '2001-01-15' AND o_orderkey % 4 <> 3 THEN o_orderdate::DATE END AS published FROM orders")
def url_path_date(t: Tables) -> DataFrame:
    d, k = _order_date(), F.col("o_orderkey") % 4
    path = F.when(k == 0, F.date_format(d, "'/a/'yyyy'/'MM'/'dd'/x'")).when(k == 1, F.date_format(d, "'/a-'yyyyMMdd'.html'")).when(k == 2, F.date_format(d, "'/209913/'yyyy'_'MM'-'dd")).otherwise(F.date_format(d, "'/n/7'yyyyMMdd"))
    return t.orders.select("o_orderkey", U.published_from_path(F.concat(F.lit("https://h20000101.example"), path), F.to_date(F.lit("2001-01-15"))).alias("published"))


_POST_MS = "(epoch_ms(ts) - 1288834974657)"


@query("SELECT event_id, CASE WHEN event_id % 10 = 9 THEN '' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS posted, CASE WHEN event_id % 10 <> 9 THEN (date_trunc('second', ts) + INTERVAL 9 HOURS)::DATE END AS day_in_japan FROM events")
def snowflake_decode(t: Tables) -> DataFrame:
    """Post numbers made from times; every tenth is too small to be one."""
    ms = F.unix_seconds(F.date_trunc("second", "ts")) * 1000 - U.POST_EPOCH_MS
    number = F.when(F.col("event_id") % 10 == 9, F.lit(1_000_000_000_000)).otherwise(F.shiftleft(ms, 22) + F.col("event_id") % 4096)
    url = F.concat(F.lit("see https://www.x.com/user_1/status/"), number.cast("string"), F.lit("?s=20"))
    at = U.posted_at(U.post_id(url))
    return t.events.select("event_id", F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("posted"), U.published_from_post(url).alias("day_in_japan"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN o_orderdate::DATE END AS published FROM orders")
def parse_published(t: Tables) -> DataFrame:
    d, k = _order_date(), F.col("o_orderkey") % 6
    text = F.when(k == 0, F.date_format(d, "EEE, dd MMM yyyy' 23:10:00 +0900'")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T23:00:00-05:00'")).when(k == 2, F.date_format(d, "yyyy-MM-dd'T01:00:00Z'")).when(k == 3, F.date_format(d, "yyyy/MM/dd")).when(k == 4, "soon").otherwise(F.date_format(d, "yyyy-13-dd"))
    return t.orders.select("o_orderkey", D.parse_published(text).alias("published"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y') || '年' || month(o_orderdate) || '月' WHEN o_orderkey % 3 < 2 THEN month(o_orderdate) || '月' ELSE '' END AS hint, o_orderkey % 3 = 0 AND year(o_orderdate) >= 2000 AS year_explicit FROM orders")
def month_mentions(t: Tables) -> DataFrame:
    d, k = _order_date(), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format(d, "yyyy年M月から発売")).when(k == 1, F.date_format(d, "M月開催決定")).otherwise(F.date_format(d, "M月d日"))
    x = t.orders.select("o_orderkey", D.mentions_month(text, F.lit(None).cast("date")).alias("m"))
    return x.select("o_orderkey", F.coalesce("m.text", F.lit("")).alias("hint"), F.coalesce("m.year_explicit", F.lit(False)).alias("year_explicit"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN month(o_orderdate) || '月' || day(o_orderdate) || '日' ELSE '' END AS bare FROM orders")
def bare_dates(t: Tables) -> DataFrame:
    d = _order_date()
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyy年M月d日")).otherwise(F.date_format(d, "'公開は 'M月d日"))
    return t.orders.select("o_orderkey", F.coalesce(D.mentions_bare_date(text), F.lit("")).alias("bare"))


@query("SELECT o_custkey, count(DISTINCT month(o_orderdate) * 100 + day(o_orderdate)) AS days FROM orders GROUP BY o_custkey")
def month_day_set(t: Tables) -> DataFrame:
    body = t.orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.date_format(_order_date(), "yyyy年M月d日")), " 13月40日 ").alias("body"))
    return body.select("o_custkey", F.size(D.month_days(F.col("body"))).cast("long").alias("days"))


@query(f"SELECT o_orderkey FROM orders WHERE DATE '{TODAY}' - o_orderdate::DATE <= {V.MOST_AGE_DAYS} OR o_orderkey % 11 = 0")
def stale_filter(t: Tables) -> DataFrame:
    published = F.when(F.col("o_orderkey") % 11 != 0, _order_date())
    return t.orders.filter(~R.is_stale(published, today())).select("o_orderkey")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 5 = 0 OR l_shipdate::DATE + CASE WHEN l_linenumber % 2 = 0 THEN 30 ELSE 0 END >= DATE '{TODAY}'")
def past_drop(t: Tables) -> DataFrame:
    start = F.when(F.col("l_linenumber") % 5 != 0, F.to_date("l_shipdate"))
    end = F.when(F.col("l_linenumber") % 2 == 0, F.date_add(start, 30))
    return t.lineitem.filter(~R.has_ended(start, end, today())).select("l_orderkey", "l_linenumber")


_CATS = "CASE l_linenumber % 4 WHEN 0 THEN ['concert', 'revival'] WHEN 1 THEN ['goods'] WHEN 2 THEN ['exhibition'] ELSE [] END"


def _categories() -> Column:
    k = F.col("l_linenumber") % 4
    return F.when(k == 0, F.array(F.lit("concert"), F.lit("revival"))).when(k == 1, F.array(F.lit("goods"))).when(k == 2, F.array(F.lit("exhibition"))).otherwise(F.array().cast("array<string>"))


_LIMIT = "CASE l_linenumber % 4 WHEN 0 THEN 60 WHEN 1 THEN 31 ELSE 210 END"


@query(f"SELECT l_linenumber, {_LIMIT} AS span, count(*) AS n FROM lineitem GROUP BY ALL")
def max_span(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linenumber", R.max_span(_categories()).alias("span")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 <> 0 THEN l_shipdate::DATE END AS s, CASE WHEN l_partkey % 3 = 0 THEN (l_shipdate::DATE + (l_partkey % 250)::INT)::DATE END AS e, CASE WHEN l_orderkey % 13 <> 0 THEN o_orderdate::DATE END AS p, l_suppkey % 2 = 0 AS y, {_LIMIT} AS lim FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT verdict, count(*) AS n, sum(l_orderkey) AS keys FROM (SELECT l_orderkey, CASE WHEN s IS NULL THEN 'none' WHEN e - s + 1 > lim THEN 'span' WHEN p IS NULL THEN CASE WHEN y THEN 'ok' ELSE 'year' END WHEN DATE '{TODAY}' - p > {V.MOST_AGE_DAYS} THEN 'old'
 WHEN s < p - {V.MOST_BACK_DAYS} AND NOT coalesce(e >= DATE '{TODAY}', FALSE) THEN 'before' WHEN s > p + {V.MOST_LEAD_DAYS} THEN 'after' ELSE 'ok' END AS verdict FROM x) AS v GROUP BY verdict
""")
def assess_verdict(t: Tables) -> DataFrame:
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.when(F.col("l_linenumber") % 7 != 0, F.to_date("l_shipdate"))
    end = F.when(F.col("l_partkey") % 3 == 0, F.date_add(F.to_date("l_shipdate"), (F.col("l_partkey") % 250).cast("int")))
    v = R.assess(start, F.when(start.isNotNull(), end), F.when(F.col("l_orderkey") % 13 != 0, _order_date()), today(), F.col("l_suppkey") % 2 == 0, _categories())
    x = x.select("l_orderkey", v.alias("v"))
    r = F.col("v.reason")
    word = F.when(F.col("v.accepted"), "ok").when(r == V.REASON_NO_DATE, "none").when(r.startswith("会期が"), "span").when(r == V.REASON_NO_YEAR, "year").when(r.startswith("記事が古い"), "old").when(r == V.REASON_BEFORE, "before").otherwise("after")
    return x.groupBy(word.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'inconclusive' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'inconclusive' WHEN 3 THEN 'contradicted' WHEN 4 THEN 'confirmed' WHEN 5 THEN 'consistent' ELSE CASE WHEN leap THEN 'contradicted' ELSE 'confirmed' END END AS date_confidence,
 CASE o_orderkey % 7 WHEN 3 THEN NULL WHEN 6 THEN CASE WHEN NOT leap THEN (o_orderdate::DATE + INTERVAL 1 YEAR)::DATE END ELSE o_orderdate::DATE END AS start FROM (SELECT *, month(o_orderdate) = 2 AND day(o_orderdate) = 29 AS leap FROM orders) AS o
""")
def body_confirm(t: Tables) -> DataFrame:
    """A year after 29 February is the 28th, which that body doesn't confirm."""
    d, k = _order_date(), F.col("o_orderkey") % 7
    o = t.orders
    event = F.struct(d.alias("start"), F.lit(None).cast("date").alias("end"), F.lit("").alias("raw"), F.lit(False).alias("year_explicit"))
    url = F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))
    items = o.select("o_orderkey", F.when(k == 0, "").otherwise(url).alias("url"), event.alias("event"), F.lit(None).cast("string").alias("date_hint"), F.lit("").alias("date_note"), d.alias("published"))
    body = F.when(k == 2, "no dates").when(k == 3, F.date_format(F.date_add(d, 40), "yyyy年M月d日")).when(k == 4, F.date_format(d, "'開催 'yyyy年M月d日")).when(k == 5, F.date_format(d, "M月d日")).otherwise(F.date_format(F.add_months(d, 12), "yyyy年M月d日"))
    bodies = o.filter(k > 0).select(url.alias("url"), F.when(k != 1, body).alias("body"), F.when(k == 1, "blocked").alias("error_kind"), F.lit("").alias("error_detail"))
    return C.confirm(items, bodies).select("o_orderkey", "date_confidence", F.col("event.start").alias("start"))
