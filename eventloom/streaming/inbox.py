"""Candidates as a stream: status against the state, batch by batch, with snapshots that a repeated batch can't spoil."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.state import prune
from eventloom.plans.ingest import Config, run
from eventloom.sources import snapshots
from eventloom.sources.readers import CANDIDATE, SEEN


def files(spark: SparkSession, folder: str, consume: bool = False) -> DataFrame:
    """New JSON files of a folder; consume: they are deleted once a later batch is done."""
    reader = spark.readStream.schema(CANDIDATE).option("multiLine", True).option("pathGlobFilter", "*.json")
    return (reader.option("cleanSource", "delete") if consume else reader).json(folder)


def start(candidates: DataFrame, state: str, out: str, checkpoint: str, config: Callable[[int], Config]) -> StreamingQuery:
    """Runs all files that are there and ends. Each batch reads the snapshot before it and overwrites its own results, so
    that a batch which is run again gives the same."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        numbered = rows.withColumn("ord", F.monotonically_increasing_id())
        settings = config(number)
        # what a batch reads is the snapshot of the one before, so that it may be run again; older ones go
        seen = snapshots.read(spark, state, "after=", number - 1) if number else spark.createDataFrame([], SEEN)
        items, after = run(numbered, seen, settings)
        items.write.mode("overwrite").parquet(f"{out}/batch={number}")
        snapshots.write(prune(after, F.lit(settings.today)), state, "after=", number)

    return candidates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
