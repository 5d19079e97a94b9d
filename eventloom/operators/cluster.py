"""Same-event pairs, clusters and their surviving values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import text as X
from eventloom.functions import vocab as V
from eventloom.operators.graph import components
from eventloom.shared import materialize

# Fixed value: a month with its year.
HINT_MONTH = r"(20\d{2})\s*年\s*(\d{1,2})\s*月"


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals; a null end is the start; a null start overlaps nothing."""
    return F.coalesce((a_start <= F.coalesce(b_end, b_start)) & (b_start <= F.coalesce(a_end, a_start)), F.lit(False))


def hint_month(hint: Column) -> Column:
    m = F.regexp_extract(F.coalesce(hint, F.lit("")), HINT_MONTH, 2)
    return F.when(m != "", F.concat_ws("-", F.regexp_extract(hint, HINT_MONTH, 1), F.lpad(m, 2, "0")))


def month_inside(start: Column, end: Column, month: Column, other_start: Column) -> Column:
    """A dated side's span holds the month of an undated side's hint."""
    first, last = F.date_format(start, "yyyy-MM"), F.date_format(F.coalesce(end, start), "yyyy-MM")
    return F.coalesce(start.isNotNull() & other_start.isNull() & month.between(first, last), F.lit(False))


def signals(items: DataFrame, nfkc=X.nfkc, normalize=X.normalize) -> DataFrame:
    """items (ord, title, summary, labels, categories, start, end, date_hint) with all that pairs are judged by, made once a
    row so that the join only compares."""
    t = X.signal_text(F.col("title"), F.col("summary"))
    out = items.withColumn("_signal", t).withColumns({"_text": nfkc("_signal"), "_key": X.loosen(normalize(F.col("_signal"))), "_month": hint_month(F.col("date_hint"))})
    raw = F.array_except(F.array_distinct(F.regexp_extract_all("_text", F.lit(V.TERM_PATTERN), F.lit(0))), F.array(*[F.lit(g) for g in V.GENERIC_TERMS]))
    out = out.withColumn("_terms", raw)
    parts = {"_tri": 3, "_bi": 2}
    out = out.withColumns({k: F.array_distinct(F.flatten(F.transform(F.filter("_terms", lambda t: F.char_length(t) >= n), lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))))) for k, n in parts.items()})
    return out.withColumns({"_short": F.filter("_terms", lambda t: F.char_length(t) == 2), "_grams": X.bigrams(F.col("_key")), "_quoted": X.quoted_names(F.col("_text"), F.array().cast("array<string>"), lambda n: X.loosen(F.translate(X.fold_plain(n), V.BRACKETS + V.SEPARATORS, "")))})


def same_event(pairs: DataFrame, a: str, b: str) -> Column:
    """Whether the rows with prefixes a and b are one event, given the labels that they share in ``shared``.

    The ladder goes from cheap to dear: similar titles; a common or quoted name, or two common terms, or one with the same
    time, each with its own demand on categories.
    """

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}")

    keys = F.transform("shared", lambda s: X.loosen(F.translate(X.fold_plain(s), V.BRACKETS + V.SEPARATORS, "")))
    names = {s: F.filter(c(s, "_quoted"), lambda n: ~F.array_contains(keys, n)) for s in (a, b)}
    terms = {s: F.filter(c(s, "_terms"), lambda t: ~F.exists("shared", lambda x: x.contains(t) | t.contains(x))) for s in (a, b)}
    alike = F.arrays_overlap(c(a, "categories"), c(b, "categories"))
    quoted = F.arrays_overlap(names[a], names[b]) | X.quoted_in_text(names[a], c(b, "_key")) | X.quoted_in_text(names[b], c(a, "_key"))
    # related terms have three characters in common, or one of two characters is within the other
    touch = F.arrays_overlap(c(a, "_tri"), c(b, "_tri")) | F.arrays_overlap(c(a, "_bi"), c(b, "_short")) | F.arrays_overlap(c(a, "_short"), c(b, "_bi"))
    common = X.shared_term_count(terms[a], terms[b])
    timed = overlaps(c(a, "start"), c(a, "end"), c(b, "start"), c(b, "end")) | month_inside(c(a, "start"), c(a, "end"), c(b, "_month"), c(b, "start")) | month_inside(c(b, "start"), c(b, "end"), c(a, "_month"), c(a, "start"))
    # grams are distinct, so that their union's size follows from that of the intersection
    both = F.size(F.array_intersect(c(a, "_grams"), c(b, "_grams")))
    similar = both >= V.SIMILAR_TITLES * (F.size(c(a, "_grams")) + F.size(c(b, "_grams")) - both)
    enough = F.when(timed & alike, 1).otherwise(V.SHARED_TERMS)
    return F.coalesce(similar | (quoted & alike) | (touch & (common >= enough)), F.lit(False))


#: Rows of a label up to which all its pairs are judged.
SMALL = 64

_SIGNALS = ("ord", "labels", "categories", "start", "end", "_month", "_key", "_grams", "_terms", "_tri", "_bi", "_short", "_quoted")


def same_event_pairs(signalled: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b), a < b, of rows that share a label and are one event.

    Rows meet only where they share a label; the pair is judged once, at its smallest shared label. In a label of more than
    ``small`` rows only those pairs meet that have something in common which every rung of the ladder asks for in its way.
    """
    rows = materialize(signalled.select(*_SIGNALS), "signals", wide=True)
    sizes = rows.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.filter(F.col("n") > small).select("label"), "large")
    some = not large.isEmpty()
    sides = {}
    for s in ("a", "b"):
        side = rows.select(*(F.col(c).alias(f"{s}_{c}") for c in _SIGNALS)).withColumn(f"{s}_label", F.explode(f"{s}_labels"))
        sides[s] = side.join(large.withColumnRenamed("label", f"{s}_label"), f"{s}_label", "left_anti") if some else side
    # judging a pair costs more than moving its rows, so that labels are dealt to all tasks
    meet = sides["a"].join(sides["b"].hint("merge"), (F.col("a_label") == F.col("b_label")) & (F.col("a_ord") < F.col("b_ord")))
    found = _judged(meet, F.col("a_label"))
    if not some:
        return found
    pairs = _candidates(rows, large)
    for s in ("a", "b"):
        pairs = pairs.join(rows.select(*(F.col(c).alias(f"{s}_{c}") for c in _SIGNALS)), F.col(s) == F.col(f"{s}_ord")).drop(s)
    return found.unionByName(_judged(pairs, F.col("label")))


def _judged(meet: DataFrame, label: Column) -> DataFrame:
    meet = meet.withColumn("shared", F.array_intersect("a_labels", "b_labels")).filter(label == F.array_min("shared"))
    return meet.filter(same_event(meet, "a", "b")).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))


def _meeting(one: DataFrame, two: DataFrame, test: Column | None = None) -> DataFrame:
    """(label, a, b) of rows of both that have a label and token in common."""
    pairs = one.select("label", "token", *(F.col(c).alias(f"{c}_1") for c in one.columns[2:])).join(two.select("label", "token", *(F.col(c).alias(f"{c}_2") for c in two.columns[2:])), ["label", "token"])
    if test is not None:
        pairs = pairs.filter(test)
    return pairs.filter("ord_1 <> ord_2").select("label", F.least("ord_1", "ord_2").alias("a"), F.greatest("ord_1", "ord_2").alias("b"))


def _candidates(rows: DataFrame, large: DataFrame) -> DataFrame:
    """(label, a, b) of the pairs of large labels that may be one event, each once.

    - Similar titles have a common bigram among each one's rarest of the label (a prefix, with bounds by size and position).
    - A quoted name is in both, or all its bigrams, its rarest among them, are in the other title.
    - Related terms have three characters in common, or one has two characters that the other holds. Terms that overlap the
      label don't count there.
    """
    m = materialize(rows.select("ord", F.explode("labels").alias("label"), "_grams", "_terms", "_quoted").join(large, "label"), "in-large", wide=True)
    t = V.SIMILAR_TITLES
    grams = m.select("label", F.explode("_grams").alias("token"), "ord", F.size("_grams").alias("n"))
    counts = materialize(grams.groupBy("label", "token").agg(F.count(F.lit(1)).alias("k")), "grams", wide=True)
    ordered = grams.join(counts.filter("k > 1"), ["label", "token"]).groupBy("label", "ord", "n").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("x"))
    # bigrams of one title only come first in its order
    alone = F.col("n") - F.size("x")
    prefix = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1 - alone).cast("int")
    front = ordered.select("label", "ord", "n", alone.alias("alone"), F.posexplode(F.slice("x", F.lit(1), prefix)).alias("p", "x"))
    front = materialize(front.select("label", F.col("x.token").alias("token"), "ord", "n", (F.col("alone") + F.col("p") + 1).alias("pos")), "front", wide=True)
    fits = (F.least("n_1", "n_2") >= t * F.greatest("n_1", "n_2") - 1e-9) & (1 + F.least(F.col("n_1") - F.col("pos_1"), F.col("n_2") - F.col("pos_2")) >= (F.col("n_1") + F.col("n_2")) * t / (1 + t) - 1e-9) & (F.col("ord_1") < F.col("ord_2"))
    found = _meeting(front, front, fits)

    names = m.select("label", F.explode("_quoted").alias("token"), "ord")
    found = found.unionByName(_meeting(names, names, F.col("ord_1") < F.col("ord_2")))
    long = names.filter(F.char_length("token") >= V.QUOTED_LEAST).withColumn("name", F.col("token"))
    rarest = long.select("label", "ord", "name", F.explode(X.bigrams(F.col("name"))).alias("token")).join(counts, ["label", "token"], "left")
    # a bigram that no title has can't be within one
    rarest = rarest.groupBy("label", "ord", "name").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), F.col("token").alias("token"))).alias("x")).filter("x.k > 0")
    found = found.unionByName(_meeting(rarest.select("label", F.col("x.token").alias("token"), "ord"), grams.select("label", "token", "ord")))

    terms = m.select("label", "ord", F.filter("_terms", lambda x: ~(F.col("label").contains(x) | x.contains(F.col("label")))).alias("terms"))

    def parts(n: int) -> DataFrame:
        cut = F.flatten(F.transform(F.filter("terms", lambda x: F.char_length(x) >= n), lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n)))))
        return terms.select("label", F.explode(F.array_distinct(cut)).alias("token"), "ord")

    found = found.unionByName(_meeting(parts(3), parts(3), F.col("ord_1") < F.col("ord_2")))
    short = terms.select("label", F.explode(F.filter("terms", lambda x: F.char_length(x) == 2)).alias("token"), "ord")
    return materialize(found.unionByName(_meeting(short, parts(2))).distinct(), "candidates", wide=True)


def clusters(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """items with cluster: the smallest ord that same-event pairs lead to."""
    labels = components(pairs).withColumnRenamed("node", "ord")
    return items.join(labels, "ord", "left").withColumn("cluster", F.coalesce("label", "ord")).drop("label")


def trust() -> Column:
    """How far a row's date is believed; the earlier row wins ties."""
    return F.struct((F.coalesce(F.col("date_confidence"), F.lit("")) == "confirmed").alias("sure"), (F.coalesce(F.col("published"), F.lit("")) != "").alias("known"), F.coalesce(F.col("published"), F.lit("")).alias("published"), F.coalesce(F.col("year_explicit"), F.lit(False)).alias("explicit"), (-F.col("ord")).alias("first"))


def _distinct_by(rows: Column, key) -> Column:
    """The first element of each key, in order: sorted by key, an element counts if its key isn't that of the one before."""
    placed = F.array_sort(F.transform(rows, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))

    def firsts(z: Column) -> Column:
        marked = F.transform(z, lambda e, j: F.struct(e.i.alias("i"), e.x.alias("x"), ((j == 0) | ~e.k.eqNullSafe(F.get(z, j - 1)["k"])).alias("first")))
        return F.transform(F.array_sort(F.filter(marked, lambda e: e.first)), lambda e: e.x)

    return F.get(F.transform(F.array(placed), firsts), 0)  # as a variable, the sorted array is made once


def resolve(members: DataFrame) -> DataFrame:
    """One row for each cluster of members (cluster, ord, title, url, summary, source, published, categories, matches, start,
    end, year_explicit, date_note, date_hint, date_confidence, unverifiable, sources, status).

    The most trusted dated row gives the values; other dates are kept as conflicts; categories, matches and sources are
    united in order.
    """
    values = ["ord", "title", "url", "summary", "source", "published", "start", "end", "year_explicit", "date_note", "date_hint", "date_confidence"]
    own = F.array(F.struct(F.coalesce("source", F.lit("")).alias("name"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("published", F.lit("")).alias("published")))
    rank = F.when(F.col("status") == "new", 0).when(F.col("status") == "updated", 1).when(F.col("status") == "known", 2).otherwise(3)
    m = members.withColumns({"_trust": trust(), "_sources": F.when(F.size("sources") > 0, F.col("sources")).otherwise(own)})
    g = m.groupBy("cluster").agg(
        F.max_by(F.struct(*values), F.struct(F.col("start").isNotNull(), "_trust")).alias("best"),
        F.array_sort(F.collect_list(F.struct("ord", "start", "end", "source", "url", "categories", "matches"))).alias("all"),
        F.reverse(F.array_sort(F.collect_list(F.struct("_trust", "_sources")))).alias("by_trust"),
        F.bool_and(F.coalesce("unverifiable", F.lit(False))).alias("unverifiable"),
        F.min_by("status", F.struct(rank, "ord")).alias("status"),
    )
    conflict = F.transform(F.filter("all", lambda x: x.start.isNotNull() & (x.start != F.col("best.start"))), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.source.alias("source"), x.url.alias("url")))
    hits = F.filter(F.flatten(F.transform("all", lambda x: x.matches)), lambda h: F.coalesce(h.label, F.lit("")) != "")
    return g.select(
        "cluster", "best.*",
        F.array_distinct(F.flatten(F.transform("all", lambda x: x.categories))).alias("categories"),
        _distinct_by(hits, lambda h: h.label).alias("matches"),
        conflict.alias("date_conflict"),
        _distinct_by(F.flatten(F.transform("by_trust", lambda x: x._sources)), lambda s: s.url).alias("sources"),
        "unverifiable", "status",
    )


def collapse(items: DataFrame, nfkc=X.nfkc, normalize=X.normalize) -> DataFrame:
    """Clusters and their values. items as for signals and resolve; labels come from matches."""
    labelled = materialize(items.withColumn("labels", F.array_distinct(F.filter(F.transform("matches", lambda m: m.label), lambda x: F.coalesce(x, F.lit("")) != ""))), "items", wide=True)
    return resolve(clusters(labelled, same_event_pairs(signals(labelled, nfkc, normalize))))


def earliest(df: DataFrame, key: str, start: str) -> DataFrame:
    """Rank of a row among those of its key by date, undated last."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(start).asc_nulls_last(), "ord")))
