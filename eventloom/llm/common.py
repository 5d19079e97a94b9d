"""What the corpus operators share: bounded batches, free column names and a bounded Bloom filter."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.shared import materialize, ship

T = TypeVar("T")

#: The six characters that the contracts call white space.
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512, size: str = "4m") -> None:
    """Before an operator that runs Python: workers have this package, and get this many rows and bytes at a time at most,
    as rows hold whole texts. Plans run later than they are made, so that the session keeps both settings; smaller
    settings stay."""
    ship(spark)
    records, octets = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(records)) <= rows:
        spark.conf.set(records, str(rows))
    jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    if not 0 < jvm.byteStringAsBytes(spark.conf.get(octets)) <= jvm.byteStringAsBytes(size):
        spark.conf.set(octets, size)


_CACHE: dict = {}


def worker_cache(key: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks: one object, the last one asked for, so that the operators of a pipeline
    don't add up in a worker that runs them in turn."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = make()
    return _CACHE[key]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        k = f"_el_{name}"
        while k in taken:
            k += "_"
        taken.add(k)
        out.append(k)
    return out


def strip_blanks(text: Column) -> Column:
    """Text without white space; null counts as empty. A chain of plain replaces beats a regex here."""
    out = F.coalesce(text, F.lit(""))
    for ch in BLANKS:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


#: Plan nodes that keep each row of a scan as one row or none.
_PLAIN = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def place(df: DataFrame, name: str) -> str:
    """The name that a column has after ``by_place``."""
    return f"c{df.columns.index(name)}"


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns renamed c0, c1, ...: operators that hand whole rows on then needn't care what a legal name may
    contain, and may add columns; ``toDF(*names)`` gives the old names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def located(docs: DataFrame) -> DataFrame:
    """docs by place, with the column ``at``: a name of each row that stays the same in every reading, however files are
    dealt to tasks (its file and its place there). What isn't a plain scan of Parquet files is written to such first."""

    def plain(node) -> bool:
        below = node.children()
        return node.nodeName() in _PLAIN and (below.size() == 0 or (below.size() == 1 and plain(below.apply(0))))

    def named(df: DataFrame) -> DataFrame:
        there = df.metadataColumn("_metadata")
        return df.select("*", F.struct(F.xxhash64(there["file_path"]).alias("file"), there["row_index"].alias("index")).alias("at"))

    df = by_place(docs)
    if plain(df._jdf.queryExecution().analyzed()):
        try:
            return named(df)
        except AnalysisException:
            pass  # files of another format don't number their rows
    return named(materialize(df, "located", wide=True))


class Bloom:
    """A Bloom filter with two cells a key, built and probed with built-in functions only.

    It is a table (bucket, 4 KiB bitmap) with 16 bits or more for each of ``rows`` keys, so that its rate of false hits
    (1.4 % at most, as computed) doesn't grow with the corpus. Both cells of a key lie in one bucket: a probe is one join. Up
    to ``MOST_BITS`` (32 MiB) the table is broadcast; a larger one is joined by its bucket, so that what is probed is
    shuffled then.
    """

    MOST_BITS = 1 << 28

    def __init__(self, rows: int):
        self.buckets = max(4, -(-16 * rows // 32768))
        self.table: DataFrame | None = None

    def _place(self, key: Column) -> list[Column]:
        """Bucket and the two cells in it."""
        h = F.xxhash64(key, F.lit(1))
        return [F.pmod(F.shiftrightunsigned(h, 30), F.lit(self.buckets)), h.bitwiseAND(32767).cast("int"), F.shiftrightunsigned(h, 15).bitwiseAND(32767).cast("int")]

    def of_keys(self, keys: DataFrame, key: str) -> Bloom:
        """Holds every key."""
        bucket, a, b = self._place(F.col(key))
        cells = keys.select(bucket.alias("bucket"), F.explode(F.array(a, b)).alias("cell"))
        self.table = materialize(cells.groupBy("bucket").agg(F.bitmap_construct_agg("cell").alias("bits")), "bloom")
        return self

    @staticmethod
    def of_repeated(keys: DataFrame, key: str) -> Bloom:
        """Holds every key that occurs twice or more. Each row sends one 64-bit hash, combined before the shuffle, so that a
        key with a third of all rows sends one a task; keys with equal hashes are false hits."""
        hashes = keys.select(F.xxhash64(key).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
        hashes = materialize(hashes, "repeated")
        bloom = Bloom(hashes.count()).of_keys(hashes, "h")
        bloom.hashed = True
        return bloom

    hashed = False

    def probe(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        """df with the boolean column ``out``: false means that the key is surely absent."""
        bucket, a, b, bits = fresh(df, "bucket", "cell_a", "cell_b", "bits")
        place = self._place(F.xxhash64(key) if self.hashed else key)
        side = self.table.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
        side = F.broadcast(side) if self.buckets << 15 <= self.MOST_BITS else side
        df = df.withColumns(dict(zip((bucket, a, b), place, strict=True))).join(side, bucket, "left")

        def bit(cell: str) -> Column:
            byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(F.col(cell), 3) + 1, F.lit(1))), 16, 10).cast("int")
            return F.coalesce(F.bit_get(byte, F.col(cell).bitwiseAND(7)) == 1, F.lit(False))

        return df.withColumn(out, bit(a) & bit(b)).drop(bucket, a, b, bits)


def keep_absent(df: DataFrame, key: str, gone: DataFrame, rows: int) -> DataFrame:
    """Rows of df whose key isn't among the keys of ``gone`` (same column name, no nulls).

    Rows that a Bloom filter of the keys clears pass straight through; only its hits, true or false, are shuffled.
    """
    (hit,) = fresh(df, "hit")
    probed = Bloom(rows).of_keys(gone, key).probe(df, F.col(key), hit)
    clear = probed.filter(~F.col(hit)).drop(hit)
    rest = probed.filter(F.col(hit)).drop(hit).join(gone.select(key), key, "left_anti").select(*clear.columns)
    return clear.unionByName(rest)


def keep_present(df: DataFrame, key: str, wanted: DataFrame, rows: int) -> DataFrame:
    """df joined with ``wanted`` on the key that both have; rows that a Bloom filter excludes aren't shuffled."""
    (hit,) = fresh(df, "hit")
    probed = Bloom(rows).of_keys(wanted, key).probe(df, F.col(key), hit)
    return probed.filter(F.col(hit)).drop(hit).join(wanted, key)
