"""Search queries from a watch list: rounds of templates, first wins, cut at a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import vocab as V


def _filled(names: DataFrame, templates: list[tuple[int, str]]) -> DataFrame:
    """names (name, ord) in every template: round, place, query. The templates are literals, so that nothing is joined."""
    pairs = F.array(*[F.struct(F.lit(r).alias("round"), F.lit(t).alias("template")) for r, t in templates])
    x = names.filter(F.coalesce("name", F.lit("")) != "").select("name", F.col("ord").alias("place"), F.explode(pairs).alias("t"))
    return x.select("t.round", "place", F.replace(F.col("t.template"), F.lit("{term}"), F.col("name")).alias("query"))


def _fixed(spark: SparkSession, round_: int, queries: list[str]) -> DataFrame:
    return spark.createDataFrame([(round_, i, q) for i, q in enumerate(queries)], "round int, place long, query string")


def _first(rows: DataFrame, limit: int) -> DataFrame:
    first = rows.groupBy("query").agg(F.min(F.struct("round", "place")).alias("at"))
    return first.orderBy("at", "query").limit(limit).select("query", "at.round", "at.place")


def search_queries(works: DataFrame, people: DataFrame, limit: int = 40, venues: bool = True, broad: bool = False) -> DataFrame:
    """Each work gets its first query before any gets its second, so that a limit hits all alike."""
    n = len(V.WORK_TEMPLATES)
    rows = _filled(people, [(0, V.PERSON_FIRST), (n + 1, V.PERSON_LAST)]).unionByName(_filled(works, [(i + 1, t) for i, t in enumerate(V.WORK_TEMPLATES)]))
    spark = works.sparkSession
    if venues:
        rows = rows.unionByName(_fixed(spark, n + 2, V.VENUE_QUERIES))
    if broad:
        rows = rows.unionByName(_fixed(spark, n + 3, V.BROAD_QUERIES))
    return _first(rows, limit)


def post_queries(works: DataFrame, people: DataFrame, limit: int = 20, accounts: bool = True) -> DataFrame:
    rows = _filled(works, [(0, V.POST_WORK)]).unionByName(_filled(people, [(1, V.POST_PERSON)]))
    if accounts:
        rows = rows.unionByName(_fixed(works.sparkSession, 2, [V.POST_ACCOUNT.replace("{term}", a) for a in V.ACCOUNTS]))
    return _first(rows, limit)


def search_size(n: Column) -> Column:
    """What one request may ask for."""
    return F.greatest(F.lit(10), F.least(n, F.lit(100)))
