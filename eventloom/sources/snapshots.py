"""State as numbered snapshots: a new one is written beside the last, which goes only when the new one is whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from eventloom.shared import filesystem
from eventloom.sources.readers import SEEN

KEEP = 2


def numbers(spark: SparkSession, folder: str, prefix: str) -> tuple[list[int], list[int]]:
    """The numbers of whole snapshots (those that Spark has marked as done) and of broken ones, ascending."""
    fs, path = filesystem(spark, folder)
    whole, broken = [], []
    if fs.exists(path):
        for status in fs.listStatus(path):
            m = re.fullmatch(re.escape(prefix) + r"(\d+)", status.getPath().getName())
            if m:
                done = fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
                (whole if done else broken).append(int(m[1]))
    return sorted(whole), sorted(broken)


def read(spark: SparkSession, folder: str, prefix: str = "state-", number: int | None = None) -> DataFrame:
    """The last whole snapshot, or that of a number. A state is empty only before its first snapshot: one that is missing or
    broken later fails."""
    whole, broken = numbers(spark, folder, prefix)
    want = number if number is not None else (whole[-1] if whole else None)
    if want in whole:
        return spark.read.schema(SEEN).parquet(f"{folder}/{prefix}{want}")
    if whole or (number is None and len(broken) > 1):
        raise FileNotFoundError(f"{folder}: no whole snapshot {'' if number is None else number}")
    return spark.createDataFrame([], SEEN)


def write(state: DataFrame, folder: str, prefix: str = "state-", number: int | None = None, keep: int = KEEP) -> int:
    """Writes the next snapshot (or that of a number, again if need be) and deletes all but the last ``keep``."""
    spark = state.sparkSession
    whole, _ = numbers(spark, folder, prefix)
    number = number if number is not None else (whole[-1] + 1 if whole else 0)
    state.write.mode("overwrite").parquet(f"{folder}/{prefix}{number}")
    whole, broken = numbers(spark, folder, prefix)
    for old in [k for k in whole if k <= number - keep] + [k for k in broken if k < number]:
        fs, path = filesystem(spark, f"{folder}/{prefix}{old}")
        fs.delete(path, True)
    return number
