"""Operator 5, exact deduplication by two Bloom passes. Built-in functions only.

Texts are equal when identical after deleting white space. Pass one hashes every text once and marks the Bloom cells that
two or more rows share; pass two tests each row against them. Rows that are surely unique pass straight through; only
possibly repeated ones are shuffled, and there the full SHA-256 decides, so that false hits cost time but never change
the result.

Nulls and ties: a null text counts as empty; a null doc_id comes after every other one; of rows with the same text, length
and doc_id that which comes first in its file stays (of several files, that whose path has the smaller hash). An empty
table gives an empty result. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import Bloom, located, place, read, strip_blanks
from eventloom.shared import materialize


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"), F.sha2(strip_blanks(F.col("text")), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))


def decide(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(_digests(docs), "digests", wide=True)
    bloom = Bloom.of_repeated(digests, "text_sha256")
    probed = bloom.probe(digests, F.col("text_sha256"), "hit")
    single = probed.filter(~F.col("hit")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    hits = materialize(probed.filter("hit").drop("hit"), "hits")
    best = F.min(F.struct((-F.col("n")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = materialize(hits.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    # both sides come from files, so that a group with a third of all rows can be split by the engine
    joined = hits.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return single.unionByName(joined)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns. Possibly repeated rows are combined before the shuffle, so that a
    group sends one row a task, and rows that are surely unique aren't shuffled at all."""
    rows, text, doc_id = located(docs), place(docs, "text"), place(docs, "doc_id")
    cols = rows.columns[:-1]
    rows = rows.withColumn("sha", F.sha2(strip_blanks(F.col(text)), 256))
    probed = Bloom.of_repeated(materialize(rows.select("sha"), "digests", wide=True), "sha").probe(rows, F.col("sha"), "hit")
    order = F.struct(-F.coalesce(F.char_length(text), F.lit(0)), F.col(doc_id).isNull(), doc_id, "at")
    best = probed.filter("hit").groupBy("sha").agg(F.min_by(F.struct(*cols), order).alias("best"))
    return probed.filter("NOT hit").select(*cols).unionByName(best.select("best.*")).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
