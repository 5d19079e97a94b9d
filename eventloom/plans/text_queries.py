"""Queries of the text, URL and rule operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as X
from eventloom.functions import urls as U
from eventloom.functions import vocab as V
from eventloom.operators import rules as R
from eventloom.operators.state import first_per_key
from eventloom.plans.registry import Tables, query

DELETED = V.BRACKETS + V.SEPARATORS
#: Title prefixes, rules and a watch list over the tables' own words.
PREFIXES = ["the", "andthe", "la"]
RULES = {"ring": ["small ring", "ring"], "widget": ["widget", "gear"], "bolt": ["bolt", "screw"]}
BANNED, STEM, HINTS = ["red"], "blue", ["gasket", "ring", "gear"]
WORKS = [{"title": "Thing", "aliases": ["reanth", "hester"]}, {"title": "Eaux", "aliases": ["tréan"]}, {"title": "Ung", "aliases": ["keit"]}, {"title": "Quexyz", "aliases": []}]
PEOPLE = [{"name": "ciónra", "role": "author", "aliases": []}, {"name": "ab", "role": "x", "aliases": ["ñosar"]}]


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _key(column: str) -> str:
    return f"translate(replace(lower({column}), 'ß', 'ss'), {_sql(DELETED)}, '')"


def _canonical(column: str) -> str:
    out = f"trim({column}, E' \\t\\n\\r')"
    for pattern, to in (("#.*$", ""), (U.TRACKING, ""), (r"\?&", "?"), ("[?&]+$", ""), ("/+$", "")):
        out = f"regexp_replace({out}, {_sql(pattern)}, {_sql(to)}, 'g')"
    return out


def _loose(key: str, prefixes: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({key}, {_sql(p)}) AND length({key}) > {len(p) + 1} THEN substr({key}, {len(p) + 1})" for p in prefixes) + f" ELSE {key} END"


def plain_key(c) -> F.Column:
    return X.normalize(c, X.fold_plain)


@query(f"SELECT page_id, {_canonical('url')} AS canonical FROM pages")
def canonical_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, substr(sha1(CASE WHEN page_id % 3 = 0 THEN coalesce(nullif({_loose(_key('regexp_extract(html, $$<title>([^<]*)$$, 1)'), V.LOOSE_PREFIXES)}, ''), '') ELSE {_canonical('url')} END), 1, 16) AS fingerprint FROM pages".replace("$$", "'"))
def url_fingerprint(t: Tables) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, "").otherwise(U.canonical_url(F.col("url")))
    title = X.loosen(plain_key(F.regexp_extract("html", "<title>([^<]*)", 1)))
    return t.pages.select("page_id", U.fingerprint(url, title).alias("fingerprint"))


_TEXT = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>|</li>|</h[1-6]>', E'\n', 'g'), '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t　]+', ' ', 'g'), E'\n{3,}', E'\n\n', 'g'), E' \n\t\r')"""


@query(f"SELECT page_id, length(x) AS n_chars, sha256(x) AS text_sha256 FROM (SELECT page_id, {_TEXT} AS x FROM pages) AS p")
def html_to_text_all_entities(t: Tables) -> DataFrame:
    """The default path, which knows every entity; the pages have eight."""
    x = t.pages.select("page_id", X.html_to_text(F.col("html")).alias("x"))
    return x.select("page_id", F.char_length("x").cast("long").alias("n_chars"), F.sha2("x", 256).alias("text_sha256"))


@query(f"SELECT page_id, length(x) AS n_chars, sha256(x) AS text_sha256 FROM (SELECT page_id, {_TEXT} AS x FROM pages) AS p")
def html_to_text(t: Tables) -> DataFrame:
    x = t.pages.select("page_id", X.html_to_text(F.col("html"), X.unescape_common).alias("x"))
    return x.select("page_id", F.char_length("x").cast("long").alias("n_chars"), F.sha2("x", 256).alias("text_sha256"))


@query(f"SELECT doc_id, length(k) AS n_chars, sha256(k) AS key_sha256 FROM (SELECT doc_id, {_key('text')} AS k FROM documents) AS d")
def normalize_key(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", plain_key(F.col("text")).alias("k"))
    return k.select("doc_id", F.char_length("k").cast("long").alias("n_chars"), F.sha2("k", 256).alias("key_sha256"))


@query(f"SELECT doc_id, length(k) AS n_chars, sha256(k) AS key_sha256 FROM (SELECT doc_id, {_key('text')} AS k FROM documents) AS d", name="normalize_unicode")
def normalize_unicode(t: Tables) -> DataFrame:
    """The general path, with compatibility forms and full case folding."""
    k = t.documents.select("doc_id", X.normalize(F.col("text")).alias("k"))
    return k.select("doc_id", F.char_length("k").cast("long").alias("n_chars"), F.sha2("k", 256).alias("key_sha256"))


@query(f"SELECT doc_id, sha256({_loose('k', PREFIXES)}) AS loose_sha256 FROM (SELECT doc_id, {_key('text')} AS k FROM documents) AS d")
def normalize_loose(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", plain_key(F.col("text")).alias("k"))
    return k.select("doc_id", F.sha2(X.loosen(F.col("k"), PREFIXES), 256).alias("loose_sha256"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_name || ' by Oricon News' ELSE p_name END AS title FROM part")
def strip_site_suffix(t: Tables) -> DataFrame:
    noisy = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " - コミックナタリー").when(F.col("p_partkey") % 4 == 1, "  | movie walker press ｜リスアニ！ ").when(F.col("p_partkey") % 4 == 2, "").otherwise(" by Oricon News"))
    return t.part.select("p_partkey", X.strip_site_suffix(noisy).alias("title"))


@query(f"SELECT page_id, canonical FROM (SELECT page_id, {_canonical('url')} AS canonical, row_number() OVER (PARTITION BY regexp_replace({_canonical('url')}, '[0-9]+$', '') ORDER BY page_id) AS r FROM pages) AS p WHERE r = 1")
def first_wins_dedupe(t: Tables) -> DataFrame:
    """URLs that differ in their last number count as one, so that something goes."""
    p = t.pages.select("page_id", U.canonical_url(F.col("url")).alias("canonical")).withColumn("key", F.regexp_replace("canonical", "[0-9]+$", ""))
    return first_per_key(p, "key", "page_id").select("page_id", "canonical")


_LISTED = _sql(U.LISTING)


@query(f"SELECT page_id FROM pages WHERE NOT regexp_matches(CASE WHEN page_id % 5 = 0 THEN url || '/search/x' WHEN page_id % 5 = 1 THEN url || '&searchword=' ELSE url END, {_LISTED})")
def listing_url_filter(t: Tables) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 5 == 0, "/search/x").when(F.col("page_id") % 5 == 1, "&searchword=").otherwise(""))
    return t.pages.filter(~U.is_listing_url(url)).select("page_id")


def _hit(words: list[str], key: str = "k") -> str:
    return "(" + " OR ".join(f"contains({key}, {_sql(w)})" for w in words) + ")"


_CLASSES = ", ".join(f"CASE WHEN {_hit([w.replace(' ', '') for w in words])} THEN {_sql(c)} END" for c, words in RULES.items())


@query(f"SELECT p_partkey, CASE WHEN {_hit(BANNED)} THEN '' ELSE concat_ws(',', {_CLASSES}) END AS categories FROM (SELECT p_partkey, {_key('p_name')} AS k FROM part) AS p")
def classify_rules(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(R.classify(plain_key(F.col("p_name")), None, RULES, BANNED, False), ",").alias("categories"))


@query(f"SELECT p_partkey, CASE WHEN NOT {_hit(BANNED)} AND {_hit(['ring', 'bolt', 'screw'])} THEN 'named' WHEN contains(k, '{STEM}') AND {_hit(HINTS)} THEN 'screening_event' ELSE '' END AS categories FROM (SELECT p_partkey, {_key('p_name')} AS k FROM part) AS p")
def event_fallback(t: Tables) -> DataFrame:
    key = plain_key(F.col("p_name"))
    cats = R.classify(key, None, {"named": ["ring", "bolt", "screw"]}, BANNED, False)
    return t.part.select("p_partkey", F.array_join(R.event_fallback(key, cats, None, STEM, HINTS), ",").alias("categories"))


_SUFFIX = ["展", "展開", "発展", "展示", "原画展の", "回顧展", "進展", "展"]


@query("SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 4, 5, 7) THEN 'exhibition' ELSE '' END AS categories FROM part")
def exhibition_suffix(t: Tables) -> DataFrame:
    text = F.concat("p_name", F.element_at(F.array(*[F.lit(s) for s in _SUFFIX]), (F.col("p_partkey") % 8 + 1).cast("int")))
    return t.part.select("p_partkey", F.array_join(R.classify(plain_key(text)), ",").alias("categories"))


_MATCHES = ", ".join(
    [f"CASE WHEN {_hit([w['title'].lower(), *w['aliases']])} THEN {_sql('work:' + w['title'])} END" for w in WORKS]
    + [f"CASE WHEN {_hit([x for x in [p['name'], *p['aliases']] if len(x) >= 3])} THEN {_sql('person:' + p['name'])} END" for p in PEOPLE]
)
_MATCHED = f"SELECT conv_id, turn, concat_ws(',', {_MATCHES}) AS matches FROM (SELECT conv_id, turn, {_key('text')} AS k FROM conversations) AS c"


def _matched(t: Tables) -> DataFrame:
    key = plain_key(F.col("text"))
    m = R.match_watchlist(key, X.loosen(key), WORKS, PEOPLE)
    return t.conversations.select("conv_id", "turn", F.array_join(F.transform(m, lambda x: F.concat_ws(":", x.kind, x.label)), ",").alias("matches"))


@query(_MATCHED)
def watchlist_match(t: Tables) -> DataFrame:
    return _matched(t)


@query(f"SELECT conv_id, turn FROM ({_MATCHED}) AS m WHERE matches <> ''")
def watched_only(t: Tables) -> DataFrame:
    return _matched(t).filter("matches <> ''").select("conv_id", "turn")


def _grams(key: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({key}), 2)), lambda i: substr({key}, i, 2)))"


@query(f"""
WITH n AS (SELECT DISTINCT p_name, p_type, {_key('p_name')} AS k FROM part),
g AS (SELECT p_name, p_type, {_grams('k')} AS grams FROM n)
SELECT a.p_type, a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams))), 6) AS similarity
FROM g AS a JOIN g AS b ON a.p_type = b.p_type AND a.p_name < b.p_name WHERE len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams))) >= {V.SIMILAR_TITLES}
""")
def bigram_jaccard(t: Tables) -> DataFrame:
    """Distinct names of one type, so that the block is bounded by the vocabulary."""
    g = t.part.select("p_name", "p_type").distinct().withColumn("grams", X.bigrams(plain_key(F.col("p_name"))))
    a, b = (g.select("p_type", F.col("p_name").alias(s), F.col("grams").alias(f"g_{s}")) for s in "ab")
    s = X.jaccard(F.col("g_a"), F.col("g_b"))
    return a.join(b, "p_type").filter((F.col("a") < F.col("b")) & (s >= V.SIMILAR_TITLES)).select("p_type", "a", "b", F.round(s, 6).alias("similarity"))


_STOP = ["the", "and", "that"]


@query(f"""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {_sql(V.TERM_PATTERN)}))) AS w, lower(substr(text, 1, 3)) AS label FROM documents)
SELECT doc_id, count(*) FILTER (WHERE w NOT IN ('the', 'and', 'that') AND NOT contains(label, w) AND NOT contains(w, label)) AS n_terms, min(w) FILTER (WHERE w NOT IN ('the', 'and', 'that') AND NOT contains(label, w) AND NOT contains(w, label)) AS first_term FROM w GROUP BY doc_id
""")
def distinctive_terms(t: Tables) -> DataFrame:
    terms = X.distinctive_terms(F.col("text"), F.array(F.lower(F.substring("text", 1, 3))), _STOP)
    d = t.documents.filter(F.size(F.regexp_extract_all("text", F.lit(V.TERM_PATTERN), F.lit(0))) > 0).select("doc_id", terms.alias("x"))
    return d.select("doc_id", F.size("x").cast("long").alias("n_terms"), F.array_min("x").alias("first_term"))


# words of three letters or more are related just if they have three in a row in common
@query("""
WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM conversations),
g AS (SELECT conv_id, turn, w, list_distinct(flatten(list_transform(w, lambda a: list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))))) AS g FROM t)
SELECT a.conv_id, a.turn, len(list_filter(a.w, lambda x: list_has_any(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)), b.g))) AS n_shared FROM g AS a JOIN g AS b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def shared_terms(t: Tables) -> DataFrame:
    """Neighbouring turns, all different terms of each."""
    w = t.conversations.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w"))
    nxt = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y"))
    return w.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", X.shared_term_count(F.col("w"), F.col("y")).cast("long").alias("n_shared"))


@query(f"SELECT p_partkey, concat_ws(',', CASE WHEN length(p_name) BETWEEN 4 AND 40 AND {_key('p_name')} <> {_key('p_brand')} THEN {_key('p_name')} END, CASE WHEN length(p_type) BETWEEN 4 AND 40 AND p_partkey % 2 = 0 AND {_key('p_type')} <> {_key('p_name')} THEN {_key('p_type')} END) AS names FROM part")
def quoted_names(t: Tables) -> DataFrame:
    text = F.concat(F.lit("a「"), "p_name", F.lit("」b『"), "p_type", F.when(F.col("p_partkey") % 2 == 0, "』c").otherwise("c"), F.lit(" 「"), "p_brand", F.lit("」"))
    names = X.quoted_names(text, F.array(plain_key(F.col("p_brand"))), plain_key)
    return t.part.select("p_partkey", F.array_join(names, ",").alias("names"))


@query(f"SELECT p_partkey, length(p_name) >= 6 AS found FROM (SELECT p_partkey, {_key('p_name')} AS p_name FROM part) AS p")
def quoted_in_text(t: Tables) -> DataFrame:
    name = plain_key(F.col("p_name"))
    return t.part.select("p_partkey", X.quoted_in_text(F.array(name), plain_key(F.concat(F.lit("Anime: "), F.col("p_name"), F.lit(" (tba)")))).alias("found"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' (@acct_' || (p_partkey % 7) || ') ' || p_type WHEN p_partkey % 3 = 1 THEN p_name || ' (@acct)' ELSE p_name END AS signal FROM part")
def signal_text(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, F.concat("p_name", F.lit(" (@acct_"), (k % 7).cast("string"), F.lit(") "))).when(k % 3 == 1, F.concat(F.lit(" "), "p_name", F.lit(" (@acct)"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.signal_text(title, F.when(k % 3 == 1, F.lit("  ")).otherwise(F.col("p_type"))).alias("signal"))


@query(r"SELECT doc_id, CASE WHEN length(x) <= 56 THEN x ELSE substr(x, 1, 55) || '…' END AS title FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents) AS d")
def clip_titles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clip(F.col("text"), 56).alias("title"))


@query(f"""
WITH p AS (SELECT page_id, url, {_canonical('url')} AS canonical, {_TEXT} AS x FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS r FROM p WHERE NOT regexp_matches(url, {_LISTED})),
k AS (SELECT page_id, {_key('x')} AS k FROM f WHERE r = 1)
SELECT category, count(*) AS pages FROM (SELECT unnest(list_filter([CASE WHEN {_hit(['tion'])} THEN 'tion' END, CASE WHEN {_hit(['eaux'])} THEN 'eaux' END, CASE WHEN {_hit(['keit', 'ung'])} THEN 'keit' END], lambda c: c IS NOT NULL)) AS category FROM k) AS c GROUP BY category
""")
def page_event_counts(t: Tables) -> DataFrame:
    """Flagship: pages in canonical form, first of each, without listings, as text, by rule category."""
    p = t.pages.filter(~U.is_listing_url(F.col("url"))).withColumn("canonical", U.canonical_url(F.col("url")))
    p = first_per_key(p, "canonical", "page_id")
    cats = R.classify(plain_key(X.html_to_text(F.col("html"), X.unescape_common)), None, {"tion": ["tion"], "eaux": ["eaux"], "keit": ["keit", "ung"]}, [], False)
    return p.select(F.explode(cats).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("pages"))
