"""Queries of state, clustering, merging, digests, planning and sources over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as X
from eventloom.functions import vocab as V
from eventloom.operators import cluster as C
from eventloom.operators import digest as G
from eventloom.operators import merge as M
from eventloom.operators import planner as P
from eventloom.operators import rules as R
from eventloom.operators import state as S
from eventloom.plans import flows as L
from eventloom.plans.date_queries import today
from eventloom.plans.registry import Tables, query
from eventloom.plans.text_queries import _TEXT, _canonical, _key, _sql, plain_key
from eventloom.shared import materialize
from eventloom.sources import readers as I

SPLIT, NOW = "1998-01-01", "1998-07-01"


# state: customers are the keys, older orders the state, newer ones the run


def _seen(t: Tables) -> DataFrame:
    old = t.orders.filter(F.col("o_orderdate") < SPLIT).groupBy(F.col("o_custkey").cast("string").alias("key"))
    d = F.to_date("o_orderdate")
    return old.agg(F.min(d).alias("first_seen"), F.max(d).alias("last_seen"), F.min("o_orderpriority").alias("title"), F.max("o_orderstatus").alias("url"), F.max(F.when(F.col("o_orderkey") % 3 == 0, d)).alias("event_date"))


def _run(t: Tables) -> DataFrame:
    new = t.orders.filter((F.col("o_orderdate") >= SPLIT) & (F.col("o_custkey") % 4 > 0)).groupBy(F.col("o_custkey").cast("string").alias("key"))
    return new.agg(F.min("o_orderpriority").alias("title"), F.min("o_orderstatus").alias("url"), F.max(F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate"))).alias("event_date"))


_STATE = f"""
WITH seen AS (SELECT o_custkey::VARCHAR AS key, min(o_orderdate)::DATE AS first_seen, max(o_orderdate)::DATE AS last_seen, min(o_orderpriority) AS title, max(o_orderstatus) AS url, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END)::DATE AS event_date FROM orders WHERE o_orderdate < DATE '{SPLIT}' GROUP BY o_custkey),
run AS (SELECT o_custkey::VARCHAR AS key, min(o_orderpriority) AS title, min(o_orderstatus) AS url, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END)::DATE AS event_date FROM orders WHERE o_orderdate >= DATE '{SPLIT}' AND o_custkey % 4 > 0 GROUP BY o_custkey)
"""


@query(_STATE + "SELECT run.key, run.event_date, CASE WHEN seen.key IS NULL THEN 'new' WHEN run.event_date IS NOT NULL AND seen.event_date IS NULL THEN 'updated' ELSE 'known' END AS status FROM run LEFT JOIN seen ON run.key = seen.key")
def seen_status(t: Tables) -> DataFrame:
    return S.status(_run(t), _seen(t)).select("key", "event_date", "status")


_UPSERT = f"SELECT coalesce(seen.key, run.key) AS key, coalesce(first_seen, DATE '{NOW}') AS first_seen, CASE WHEN run.key IS NULL THEN last_seen ELSE DATE '{NOW}' END AS last_seen, CASE WHEN seen.key IS NULL THEN run.title ELSE seen.title END AS title, CASE WHEN run.key IS NULL THEN seen.url ELSE run.url END AS url, coalesce(run.event_date, seen.event_date) AS event_date FROM seen FULL OUTER JOIN run ON seen.key = run.key"


@query(_STATE + _UPSERT)
def state_upsert(t: Tables) -> DataFrame:
    return S.remember(_seen(t), _run(t), today())


@query(_STATE + f"SELECT * FROM ({_UPSERT}) AS u WHERE last_seen >= DATE '{NOW}' - {V.RETENTION_DAYS}")
def state_prune(t: Tables) -> DataFrame:
    return S.prune(S.remember(_seen(t), _run(t), today()), today())


# clusters: orders of a customer are what one label holds


def _spans(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("label"), F.when(F.col("o_orderkey") % 5 != 0, d).alias("start"), F.when(F.col("o_orderkey") % 5 > 1, F.date_add(d, (F.col("o_orderkey") % 40).cast("int"))).alias("end"), F.date_format(d, "yyyy-MM").alias("month"))


_SPANS = "s AS (SELECT o_orderkey AS ord, o_custkey AS label, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS start, CASE WHEN o_orderkey % 5 > 1 THEN (o_orderdate::DATE + (o_orderkey % 40)::INT)::DATE END AS \"end\", strftime(o_orderdate, '%Y-%m') AS month FROM orders)"
_OVERLAP = 'a.start <= coalesce(b."end", b.start) AND b.start <= coalesce(a."end", a.start)'


@query(f"WITH {_SPANS} SELECT a.ord AS a, b.ord AS b FROM s AS a JOIN s AS b ON a.label = b.label AND a.ord < b.ord WHERE {_OVERLAP}")
def interval_overlap_join(t: Tables) -> DataFrame:
    a, b = (_spans(t).select("label", *(F.col(c).alias(f"{x}_{c}") for c in ("ord", "start", "end"))) for x in "ab")
    return a.join(b, "label").filter((F.col("a_ord") < F.col("b_ord")) & C.overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))


@query(f"WITH {_SPANS} SELECT a.ord AS dated, b.ord AS undated FROM s AS a JOIN s AS b ON a.label = b.label WHERE a.start IS NOT NULL AND b.start IS NULL AND b.month >= '2000' AND b.month BETWEEN strftime(a.start, '%Y-%m') AND strftime(coalesce(a.\"end\", a.start), '%Y-%m')")
def month_hint_join(t: Tables) -> DataFrame:
    a, b = (_spans(t).select("label", *(F.col(c).alias(f"{x}_{c}") for c in ("ord", "start", "end", "month"))) for x in "ab")
    hint = C.hint_month(F.concat(F.substring("b_month", 1, 4), F.lit("年"), F.substring("b_month", 6, 2).cast("int").cast("string"), F.lit("月")))
    return a.join(b, "label").filter(C.month_inside(F.col("a_start"), F.col("a_end"), hint, F.col("b_start"))).select(F.col("a_ord").alias("dated"), F.col("b_ord").alias("undated"))


def _items(t: Tables) -> DataFrame:
    """Orders as items: the customer is the label; the title has the first part's name, a quoted type and brand."""
    line = t.lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    k = F.col("o_orderkey")
    d = F.to_date("o_orderdate")
    x = t.orders.join(line, k == F.col("l_orderkey")).join(t.part, F.col("p") == F.col("p_partkey"))
    return x.select(
        k.alias("ord"),
        F.concat("p_name", F.lit(" "), F.when(k % 3 == 0, F.concat(F.lit("「"), "p_type", F.lit(" show」"))).otherwise(F.col("p_type")), F.lit(" "), F.regexp_replace("o_orderpriority", "[^A-Z]", "")).alias("title"),
        F.lit("").alias("summary"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("labels"),
        F.array(F.when(k % 2 == 0, "goods").otherwise("concert")).alias("categories"),
        F.when(k % 5 != 0, d).alias("start"), F.when(k % 5 > 1, F.date_add(d, (k % 40).cast("int"))).alias("end"),
        F.when(k % 5 == 0, F.date_format(d, "yyyy年M月")).alias("date_hint"),
    )


def _rel(a: str, b: str) -> str:
    return f"(contains({a}, {b}) OR contains({b}, {a}) OR (length({a}) >= 3 AND len(list_filter(range(1, greatest(length({a}) - 1, 2)), lambda i: contains({b}, substr({a}, i, 3)))) > 0))"


_PAIRS = f"""
x AS (SELECT o_orderkey AS ord, 'c' || o_custkey AS label, p_name || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN '「' || p_type || ' show」' ELSE p_type END || ' ' || regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS title,
 CASE WHEN o_orderkey % 3 = 0 THEN {_key("(p_type || ' show')")} END AS quoted, o_orderkey % 2 AS cat, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS start, CASE WHEN o_orderkey % 5 > 1 THEN (o_orderdate::DATE + (o_orderkey % 40)::INT)::DATE END AS "end", CASE WHEN o_orderkey % 5 = 0 AND year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m') END AS month
 FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) AS l ON o_orderkey = l_orderkey JOIN part ON p = p_partkey),
y AS (SELECT *, {_key('title')} AS key, list_distinct(regexp_extract_all(title, '[A-Za-z]{{3,}}')) AS terms FROM x),
z AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(key), 2)), lambda i: substr(key, i, 2))) AS grams FROM y),
pairs AS (SELECT a.ord AS a, b.ord AS b FROM z AS a JOIN z AS b ON a.label = b.label AND a.ord < b.ord WHERE
 len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams))) >= {V.SIMILAR_TITLES}
 OR (a.cat = b.cat AND (a.quoted = b.quoted OR coalesce(length(a.quoted) >= {V.QUOTED_LEAST} AND contains(b.key, a.quoted), FALSE) OR coalesce(length(b.quoted) >= {V.QUOTED_LEAST} AND contains(a.key, b.quoted), FALSE)))
 OR len(list_filter(a.terms, lambda s: len(list_filter(b.terms, lambda u: {_rel('s', 'u')})) > 0)) >= {V.SHARED_TERMS}
 OR (a.cat = b.cat AND len(list_filter(a.terms, lambda s: len(list_filter(b.terms, lambda u: {_rel('s', 'u')})) > 0)) >= 1 AND (coalesce({_OVERLAP}, FALSE)
  OR coalesce(b.start IS NULL AND b.month BETWEEN strftime(a.start, '%Y-%m') AND strftime(coalesce(a."end", a.start), '%Y-%m'), FALSE) OR coalesce(a.start IS NULL AND a.month BETWEEN strftime(b.start, '%Y-%m') AND strftime(coalesce(b."end", b.start), '%Y-%m'), FALSE))))
"""


def _pairs(t: Tables) -> DataFrame:
    signalled = C.signals(_items(t), lambda c: F.col(c) if isinstance(c, str) else c, plain_key)
    return C.same_event_pairs(signalled)


@query(f"WITH {_PAIRS} SELECT a, b FROM pairs")
def same_event_pairs(t: Tables) -> DataFrame:
    return _pairs(t)


# the closure is taken over sparser links: orders of a customer at most 20 days apart


_LINKS = "e AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders AS a JOIN orders AS b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE abs(a.o_orderdate::DATE - b.o_orderdate::DATE) <= 20)"
_CLOSED = f"WITH RECURSIVE {_LINKS}, w AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT o_orderkey AS ord, o_orderkey AS label FROM orders UNION SELECT r.ord, w.y FROM r JOIN w ON r.label = w.x), c AS (SELECT ord, min(label) AS cluster FROM r GROUP BY ord)"


def _links(t: Tables) -> DataFrame:
    a, b = (t.orders.select("o_custkey", F.col("o_orderkey").alias(x), F.to_date("o_orderdate").alias(f"d_{x}")) for x in "ab")
    return a.join(b, "o_custkey").filter((F.col("a") < F.col("b")) & (F.abs(F.datediff("d_a", "d_b")) <= 20)).select("a", "b")


@query(_CLOSED + " SELECT ord, cluster FROM c")
def event_components(t: Tables) -> DataFrame:
    return C.clusters(t.orders.select(F.col("o_orderkey").alias("ord")), _links(t)).select("ord", "cluster")


def _members(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    m = t.orders.select(
        k.alias("ord"), F.concat(F.lit("t"), (k % 50).cast("string")).alias("title"), F.concat(F.lit("u"), (k % 900).cast("string")).alias("url"), F.lit("").alias("summary"), F.col("o_orderpriority").alias("source"),
        F.when(k % 4 > 0, F.date_format(d, "yyyy-MM-dd")).otherwise("").alias("published"), F.array(F.when(k % 2 == 0, "goods").otherwise("concert"), F.lit("revival")).alias("categories"),
        F.array(F.struct(F.lit("work").alias("kind"), F.concat(F.lit("w"), (k % 3).cast("string")).alias("label"), F.lit(None).cast("string").alias("role"))).alias("matches"),
        F.when(k % 5 != 0, d).alias("start"), F.lit(None).cast("date").alias("end"), (k % 7 == 0).alias("year_explicit"), F.lit("").alias("date_note"), F.lit("").alias("date_hint"),
        F.when(k % 11 == 0, "confirmed").otherwise("").alias("date_confidence"), (k % 3 == 0).alias("unverifiable"), F.array().cast("array<struct<name: string, url: string, published: string>>").alias("sources"),
        F.when(k % 6 == 0, "new").when(k % 6 == 1, "updated").otherwise("known").alias("status"), F.when(k % 2 == 0, F.concat(F.lit("doc"), F.lpad(k.cast("string"), 9, "0"))).alias("doc_id"), F.when(k % 8 == 0, k.cast("string")).alias("calendar_id"),
    )
    return materialize(C.clusters(m, _links(t)), "members")


_MEMBERS = _CLOSED + """, m AS (SELECT c.cluster, o_orderkey AS ord, 't' || (o_orderkey % 50) AS title, 'u' || (o_orderkey % 900) AS url, o_orderpriority AS source, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS published, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS start,
 CASE WHEN o_orderkey % 2 = 0 THEN 'goods' ELSE 'concert' END AS cat, 'w' || (o_orderkey % 3) AS label, o_orderkey % 7 = 0 AS explicit, o_orderkey % 11 = 0 AS sure, o_orderkey % 3 = 0 AS unverifiable, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank, CASE WHEN o_orderkey % 2 = 0 THEN 'doc' || lpad(o_orderkey::VARCHAR, 9, '0') END AS doc_id, CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey END AS cal FROM orders JOIN c ON c.ord = o_orderkey),
t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sure DESC, published <> '' DESC, published DESC, explicit DESC, ord) AS by_trust, row_number() OVER (PARTITION BY cluster ORDER BY start IS NOT NULL DESC, sure DESC, published <> '' DESC, published DESC, explicit DESC, ord) AS best FROM m),
b AS (SELECT cluster, title, url, source, published, start FROM t WHERE best = 1),
f AS (SELECT cluster, cat, min(ord) AS o FROM t GROUP BY cluster, cat), l AS (SELECT cluster, label, min(ord) AS o FROM t GROUP BY cluster, label), s AS (SELECT cluster, url, min(by_trust) AS o FROM t GROUP BY cluster, url),
cats AS (SELECT cluster, string_agg(cat, ',' ORDER BY o) AS cats FROM f GROUP BY cluster), labs AS (SELECT cluster, string_agg(label, ',' ORDER BY o) AS labels FROM l GROUP BY cluster), srcs AS (SELECT cluster, string_agg(url, ',' ORDER BY o) AS sources FROM s GROUP BY cluster),
conf AS (SELECT t.cluster, string_agg(t.start::VARCHAR, ',' ORDER BY t.ord) AS conflict FROM t JOIN b ON t.cluster = b.cluster WHERE t.start <> b.start GROUP BY t.cluster),
g AS (SELECT cluster, bool_and(unverifiable) AS unverifiable, min(rank) AS rank, bool_or(doc_id IS NULL) AS fresh, min(CASE WHEN doc_id IS NOT NULL THEN (CASE WHEN cal IS NULL THEN '1' ELSE '0' END) || doc_id END) AS keep FROM t GROUP BY cluster)"""
_CATS = "CASE WHEN contains(cats, 'goods') AND starts_with(cats, 'goods') THEN CASE WHEN contains(cats, 'concert') THEN 'goods,revival,concert' ELSE 'goods,revival' END ELSE CASE WHEN contains(cats, 'goods') THEN 'concert,revival,goods' ELSE 'concert,revival' END END"


@query(f"{_MEMBERS} SELECT b.cluster, b.title, b.url, b.source, b.start, {_CATS} AS categories, labels, sources, coalesce(conflict, '') AS conflict, unverifiable, CASE rank WHEN 0 THEN 'new' WHEN 1 THEN 'updated' ELSE 'known' END AS status FROM b JOIN cats ON b.cluster = cats.cluster JOIN labs ON b.cluster = labs.cluster JOIN srcs ON b.cluster = srcs.cluster JOIN g ON b.cluster = g.cluster LEFT JOIN conf ON b.cluster = conf.cluster")
def survivorship(t: Tables) -> DataFrame:
    r = C.resolve(_members(t))
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    return r.select("cluster", "title", "url", "source", "start", F.array_join("categories", ",").alias("categories"), names("matches", "label").alias("labels"), names("sources", "url").alias("sources"), names("date_conflict", "start").alias("conflict"), "unverifiable", "status")


_NEW_ID = f"substr(sha1(CASE WHEN {_canonical('b.url')} <> '' THEN {_canonical('b.url')} ELSE b.title END), 1, 16)"
_OPS = f"""{_MEMBERS}, v AS (SELECT doc_id, length(doc_id) + right(doc_id, 2)::INT AS version FROM m WHERE doc_id IS NOT NULL AND right(doc_id, 1) <> '4'),
ops AS (SELECT 'set' AS op, coalesce(substr(g.keep, 2), {_NEW_ID}) AS doc_id, b.start, g.unverifiable FROM b JOIN g ON b.cluster = g.cluster WHERE g.fresh UNION ALL SELECT 'delete', t.doc_id, NULL, NULL FROM t JOIN g ON t.cluster = g.cluster WHERE g.fresh AND t.doc_id IS NOT NULL AND t.doc_id <> substr(g.keep, 2)),
wr AS (SELECT ops.*, v.version AS if_version FROM ops LEFT JOIN v ON ops.doc_id = v.doc_id)"""


def _writes(t: Tables) -> DataFrame:
    m = _members(t)
    versions = m.filter(F.col("doc_id").isNotNull() & ~F.col("doc_id").endswith("4")).select("doc_id", (F.length("doc_id") + F.substring("doc_id", -2, 2).cast("int")).alias("version"))
    return M.merge_clusters(m, versions, plain_key)


@query(f"{_OPS} SELECT op, doc_id, start, if_version FROM wr")
def merge_changeset(t: Tables) -> DataFrame:
    return _writes(t).select("op", "doc_id", "start", "if_version")


@query(f"{_OPS}, old AS (SELECT doc_id, CASE WHEN ord % 10 < 6 THEN start END AS start FROM m WHERE doc_id IS NOT NULL) SELECT w.doc_id, CASE WHEN old.doc_id IS NULL THEN 'new' ELSE 'updated' END AS status FROM wr AS w LEFT JOIN old ON w.doc_id = old.doc_id WHERE op = 'set' AND NOT coalesce(unverifiable, FALSE) AND (old.doc_id IS NULL OR w.start IS DISTINCT FROM old.start)")
def news_items(t: Tables) -> DataFrame:
    existing = _members(t).filter("doc_id IS NOT NULL").select("doc_id", F.when(F.col("ord") % 10 < 6, F.col("start")).alias("start"), F.lit("").alias("end"))
    return M.news(_writes(t), existing).select("doc_id", "status")


_NEWS = """old AS (SELECT doc_id, CASE WHEN ord % 10 < 6 THEN start END AS start FROM m WHERE doc_id IS NOT NULL),
news AS (SELECT w.*, row_number() OVER (ORDER BY w.start NULLS LAST, w.cluster) AS r FROM (SELECT 'set' AS op, coalesce(substr(g.keep, 2), '') AS doc_id, b.cluster, b.title, b.start, g.unverifiable FROM b JOIN g ON b.cluster = g.cluster WHERE g.fresh) AS w LEFT JOIN old ON w.doc_id = old.doc_id WHERE NOT coalesce(unverifiable, FALSE) AND (old.doc_id IS NULL OR w.start IS DISTINCT FROM old.start))"""


@query(f"{_MEMBERS}, {_NEWS} SELECT max(c) AS count, '07/01 新着' || max(c) || '件（ウォッチ対象' || max(c) || '件）' AS subject, '新着' || max(c) || '件' || chr(10) || string_agg('- ' || title, chr(10) ORDER BY r) || CASE WHEN max(c) > 6 THEN chr(10) || '- ほか' || (max(c) - 6) || '件' ELSE '' END AS bullets FROM (SELECT *, count(*) OVER () AS c FROM news) AS n WHERE r <= 6")
def news_digest(t: Tables) -> DataFrame:
    """Merging, what is news of it, and its digest."""
    existing = _members(t).filter("doc_id IS NOT NULL").select("doc_id", F.when(F.col("ord") % 10 < 6, F.col("start")).alias("start"), F.lit("").alias("end"))
    return L.news_digest(_writes(t), existing, today()).select("count", "subject", "bullets")


@query(f"""WITH RECURSIVE {_PAIRS}, w AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), r AS (SELECT ord, ord AS label FROM x UNION SELECT r.ord, w.y FROM r JOIN w ON r.label = w.x), c AS (SELECT ord, min(label) AS cluster FROM r GROUP BY ord),
best AS (SELECT cluster, min(CASE WHEN start IS NOT NULL THEN c.ord END) AS dated, min(c.ord) AS first, count(*) AS n FROM c JOIN x ON c.ord = x.ord GROUP BY cluster),
b AS (SELECT cluster, coalesce(dated, first) AS ord FROM best)
SELECT b.cluster, b.ord, max(y.start) AS start, count(*) FILTER (WHERE m.start IS NOT NULL AND m.start <> y.start) AS conflicts FROM b JOIN x AS y ON b.ord = y.ord JOIN c ON c.cluster = b.cluster JOIN x AS m ON m.ord = c.ord GROUP BY b.cluster, b.ord""")
def collapse(t: Tables) -> DataFrame:
    """Pairs, their closure and the values that survive, in one."""
    nothing = F.lit("")
    label = F.transform("labels", lambda x: F.struct(F.lit("work").alias("kind"), x.alias("label"), F.lit(None).cast("string").alias("role")))
    items = _items(t).withColumns({"url": F.col("ord").cast("string"), "source": nothing, "published": nothing, "matches": label, "year_explicit": F.lit(False), "date_note": nothing, "date_confidence": nothing, "unverifiable": F.lit(False), "sources": F.array().cast(L.SOURCES), "status": F.lit("new")}).drop("labels")
    r = C.collapse(items, lambda c: F.col(c) if isinstance(c, str) else c, plain_key)
    return r.select("cluster", "ord", "start", F.size("date_conflict").cast("long").alias("conflicts"))


# digests: a customer's orders are the items of one digest


def _digest_items(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    return t.orders.select(
        "o_custkey", k.alias("ord"), F.concat(F.lit("order  "), k.cast("string"), F.lit(" "), F.repeat(F.col("o_orderpriority"), (k % 9).cast("int"))).alias("title"), F.when(k % 4 > 0, d).alias("start"), F.when(k % 3 == 0, F.date_add(d, 5)).alias("end"),
        F.when(k % 2 == 0, "why").otherwise("").alias("date_note"), (k % 3 == 0).alias("watched"), F.array(F.lit("goods"), F.lit("odd")).alias("categories"), F.array(F.struct(F.lit("work").alias("kind"), F.lit("W").alias("label"), F.lit("").alias("role"))).alias("matches"), F.col("o_orderstatus").alias("summary"), F.lit("").alias("url"),
        F.when(k % 5 == 0, "updated").otherwise("new").alias("status"), F.when(k % 8 == 0, "9月1日").alias("date_hint"), F.when(k % 6 == 0, F.lit("cal")).alias("calendar_id"), F.when(k % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("date_conflict"),
    )


_ITEMS = """i AS (SELECT o_custkey, o_orderkey AS ord, 'order  ' || o_orderkey || ' ' || repeat(o_orderpriority, (o_orderkey % 9)::INT) AS title, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate::DATE END AS start, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderdate::DATE + 5)::DATE END AS "end", o_orderkey % 2 = 0 AS noted, o_orderkey % 3 = 0 AS watched, o_orderstatus AS summary FROM orders),
k AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY start NULLS LAST, ord) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM i)"""


@query(f"WITH {_ITEMS} SELECT o_custkey, max(n) AS n_items, '新着' || max(n) || '件' || chr(10) || string_agg('- ' || CASE WHEN length(c) <= 56 THEN c ELSE substr(c, 1, 55) || '…' END, chr(10) ORDER BY r) || CASE WHEN max(n) > 6 THEN chr(10) || '- ほか' || (max(n) - 6) || '件' ELSE '' END AS bullets FROM k WHERE r <= 6 GROUP BY o_custkey")
def digest_bullets(t: Tables) -> DataFrame:
    return G.push_bullets(_digest_items(t), ["o_custkey"])


_PERIOD = "CASE WHEN start IS NULL THEN CASE WHEN noted THEN '日程未確認' ELSE '日程未定' END ELSE month(start) || '/' || day(start) || CASE WHEN \"end\" <> start THEN '〜' || month(\"end\") || '/' || day(\"end\") ELSE '' END END"


@query(f"WITH {_ITEMS}, h AS (SELECT {_PERIOD} || ' ' || title || ' ほか' || (SELECT count(*) - 1 FROM i) || '件' AS line FROM i ORDER BY start IS NULL, start, ord LIMIT 1) SELECT CASE WHEN length(line) > 200 THEN substr(line, 1, 197) || '…' ELSE line END AS push FROM h")
def push_line(t: Tables) -> DataFrame:
    return G.push_line(_digest_items(t))


@query(f"WITH {_ITEMS} SELECT o_custkey, '07/01 新着' || count(*) || '件（ウォッチ対象' || count(*) FILTER (WHERE watched) || '件）' AS subject FROM i GROUP BY o_custkey")
def email_subject(t: Tables) -> DataFrame:
    return G.email_subject(_digest_items(t), ["o_custkey"], today())


@query(f"WITH {_ITEMS} SELECT ord, sha256(rtrim('■ ' || {_PERIOD} || '  ' || title || '  ' || CASE WHEN ord % 5 = 0 THEN '日程判明' ELSE 'NEW' END) || chr(10) || '   [グッズ・商品・odd] W' || chr(10) || '   ' || summary || chr(10) || CASE WHEN noted THEN '   ※ 日程は載せていません（why）: ' || CASE WHEN ord % 8 = 0 THEN '「9月1日」とあるが未確認' ELSE '日付なし' END || chr(10) ELSE '' END) AS entry FROM i")
def email_entries(t: Tables) -> DataFrame:
    return _digest_items(t).select("ord", F.sha2(G.email_entry(today()), 256).alias("entry"))


@query(f"WITH {_ITEMS} SELECT ord, substr('[グッズ・商品・odd] W ' || title, 1, 200) AS summary, start AS start_date, coalesce(\"end\", start) AS end_date, (coalesce(\"end\", start) + 1)::DATE AS end_date_exclusive, summary AS description FROM i WHERE start IS NOT NULL")
def calendar_events(t: Tables) -> DataFrame:
    return G.calendar_events(_digest_items(t))


@query(f"WITH {_ITEMS} SELECT ord, start FROM i WHERE start IS NOT NULL AND coalesce(\"end\", start) >= DATE '{NOW}' AND ord % 6 <> 0 AND ord % 7 <> 0")
def calendar_eligible(t: Tables) -> DataFrame:
    return G.calendar_eligible(_digest_items(t), today()).select("ord", "start")


@query("SELECT event_id, strftime(date_trunc('minute', ts) + INTERVAL 9 HOURS, '%Y%m%d%H%M') AS doc_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, event_id % 5 AS count FROM events WHERE event_id % 5 > 0 AND event_type <> 'error'")
def outbox_rows(t: Tables) -> DataFrame:
    d = t.events.select("event_id", "ts", (F.col("event_id") % 5).cast("string").alias("count"), F.lit("s").alias("subject"), F.when(F.col("event_type") != "error", "b").otherwise("  ").alias("body"), F.lit(None).cast("string").alias("bullets"))
    rows = d.select("event_id", "ts", "count", "subject", "body", "bullets")
    out = G.outbox_row(rows.withColumn("count", F.col("count")), F.col("ts"))
    return out.join(rows.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "event_id", F.col("count").cast("long").alias("count")), ["at", "count"]).select("event_id", "doc_id", "at", "count")


@query("SELECT date_confidence, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'consistent' ELSE event_type END AS date_confidence FROM events) AS e GROUP BY date_confidence")
def confidence_tally(t: Tables) -> DataFrame:
    word = F.when(F.col("event_id") % 4 == 0, "confirmed").when(F.col("event_id") % 4 == 1, "consistent").otherwise(F.col("event_type"))
    return t.events.groupBy(word.alias("date_confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) FILTER (WHERE value > 10) AS watched, count(*) AS n FROM events GROUP BY event_type")
def conditional_count(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 10).alias("watched"), F.count(F.lit(1)).alias("n"))


# planning


def _rounds() -> str:
    parts = [f"SELECT 0 AS r, p_partkey AS p, replace({_sql(V.PERSON_FIRST)}, '{{term}}', p_brand) AS q FROM part"]
    parts += [f"SELECT {i + 1}, p_partkey, replace({_sql(w)}, '{{term}}', p_name) FROM part" for i, w in enumerate(V.WORK_TEMPLATES)]
    n = len(V.WORK_TEMPLATES)
    parts += [f"SELECT {n + 1}, p_partkey, replace({_sql(V.PERSON_LAST)}, '{{term}}', p_brand) FROM part"]
    parts += [f"SELECT {r}, {i}, {_sql(q)}" for r, qs in ((n + 2, V.VENUE_QUERIES), (n + 3, V.BROAD_QUERIES)) for i, q in enumerate(qs)]
    return " UNION ALL ".join(parts)


@query(f"SELECT q AS query, min(r) AS round FROM ({_rounds()}) AS x GROUP BY q ORDER BY min(r::BIGINT * 1000000000 + p), q LIMIT 330")
def query_plan(t: Tables) -> DataFrame:
    names = lambda c: t.part.select(F.col(c).alias("name"), F.col("p_partkey").alias("ord"))
    return P.search_queries(names("p_name"), names("p_brand"), 330, broad=True).select("query", "round")


_POSTS = " UNION ALL ".join([f"SELECT 0 AS r, p_partkey AS p, replace({_sql(V.POST_WORK)}, '{{term}}', p_name) AS q FROM part", f"SELECT 1, p_partkey, replace({_sql(V.POST_PERSON)}, '{{term}}', p_brand) FROM part", *(f"SELECT 2, {i}, {_sql(V.POST_ACCOUNT.replace('{term}', a))}" for i, a in enumerate(V.ACCOUNTS))])


@query(f"SELECT q AS query, min(r) AS round FROM ({_POSTS}) AS x GROUP BY q ORDER BY min(r::BIGINT * 1000000000 + p), q LIMIT 91")
def post_query_plan(t: Tables) -> DataFrame:
    names = lambda c: t.part.select(F.col(c).alias("name"), F.col("p_partkey").alias("ord"))
    return P.post_queries(names("p_name"), names("p_brand"), 91).select("query", "round")


@query("SELECT event_id, greatest(10, least(event_id % 150, 100)) AS size FROM events")
def search_size(t: Tables) -> DataFrame:
    return t.events.select("event_id", P.search_size(F.col("event_id") % 150).alias("size"))


# sources and gates


@query("SELECT event_id::VARCHAR AS id, CASE WHEN user_id % 3 = 0 THEN 'i' ELSE 'user' || user_id END AS user, CASE WHEN event_id % 7 <> 0 THEN ts::DATE END AS posted, 'https://x.com/' || CASE WHEN user_id % 3 = 0 THEN 'i' ELSE 'user' || user_id END || '/status/' || event_id AS url FROM events")
def payload_posts(t: Tables) -> DataFrame:
    """Posts of one user and day are one payload; every third user is missing from it."""
    post = F.struct(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("author_id"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("soon").alias("created_at"))
    user = F.array(F.struct(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username")))
    users = F.when(F.col("user_id") % 3 != 0, user).otherwise(F.array().cast("array<struct<id: string, username: string>>"))
    payloads = t.events.withColumn("post", post).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list("post").alias("data")).select(F.to_json(F.struct("data", F.struct(users.alias("users")).alias("includes"))).alias("value"))
    return I.posts(payloads).select("id", "user", "posted", "url")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(t: Tables) -> DataFrame:
    return t.events.select(F.from_json("props", "k long")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


_LINKED = "SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'dup' ELSE 'u' || (event_id % 5) END AS user, (100000000000 + event_id // 2)::VARCHAR AS id, event_id FROM events"


@query(f"SELECT user_id, id, arg_min(user, event_id) AS user, 'https://x.com/' || arg_min(user, event_id) || '/status/' || id AS url FROM ({_LINKED}) AS x GROUP BY user_id, id")
def status_links(t: Tables) -> DataFrame:
    k = F.col("event_id")
    link = F.concat(F.lit("<a href='https://twitter.com/"), F.when(k % 3 == 0, "dup").otherwise(F.concat(F.lit("u"), (k % 5).cast("string"))), F.lit("/status/"), (F.floor(k / 2) + 100000000000).cast("string"), F.lit("?s=1'>x</a>"))
    pages = t.events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", link.alias("l")))), lambda x: x.l), "\n").alias("html"))
    return I.status_links(pages, "user_id", "html", X.unescape_common).select("user_id", "id", "user", "url")


@query("SELECT event_type AS backend, count(*) AS n FROM events GROUP BY event_type")
def backend_tally(t: Tables) -> DataFrame:
    return I.collected(t.events.select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("ord"), F.col("event_type").alias("backend")))[1]


@query("SELECT user_id::VARCHAR AS url, min(event_id) AS ord FROM events GROUP BY user_id")
def collected_first(t: Tables) -> DataFrame:
    return I.collected(t.events.select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("ord"), F.col("event_type").alias("backend")))[0].select("url", "ord")


@query("SELECT event_type AS kind, count(*) FILTER (WHERE value > 5) AS reachable, count(*) AS total FROM events GROUP BY event_type")
def reachability(t: Tables) -> DataFrame:
    return I.reachability(t.events.select(F.col("event_type").alias("kind"), (F.col("value") > 5).alias("ok")))


@query("SELECT event_id FROM events WHERE event_id % 6 = 0 OR ts::DATE >= DATE '2024-01-20' - 14")
def recent_rows(t: Tables) -> DataFrame:
    return I.recent(t.events, F.when(F.col("event_id") % 6 != 0, F.to_date("ts")), F.to_date(F.lit("2024-01-20"))).select("event_id")


@query("SELECT 0 AS batch, event_id AS id FROM events UNION ALL SELECT 1, page_id FROM pages")
def append_inbox(t: Tables) -> DataFrame:
    return I.append(t.events.select(F.col("event_id").alias("id"), "event_type"), t.pages.select(F.col("page_id").alias("id"), "url")).select("batch", "id")


@query("SELECT event_id::VARCHAR AS doc_id, 'update' AS op, TRUE AS searched FROM events WHERE event_id % 3 = 1")
def pending_gate(t: Tables) -> DataFrame:
    searched = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    return M.mark_searched(t.events.select(F.col("event_id").cast("string").alias("doc_id"), searched.alias("searched"))).select("doc_id", "op", "searched")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 60) THEN 'full' WHEN count(*) FILTER (WHERE event_type = 'signup') > 20 THEN 'diff' ELSE 'none' END AS run FROM events GROUP BY user_id")
def run_gate(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > 60)).alias("r"), F.count_if(F.col("event_type") == "signup").alias("p"))
    return g.select("user_id", G.run_gate(F.col("r"), F.greatest(F.col("p") - 20, F.lit(0))).alias("run"))


@query("SELECT user_id, max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 36 HOURS OR user_id % 9 = 0 AS unhealthy FROM events GROUP BY user_id")
def health_watchdog(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return g.select("user_id", G.unhealthy(F.col("last"), F.when(F.col("user_id") % 9 == 0, "failed"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("unhealthy"))
