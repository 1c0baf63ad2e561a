"""What the operators of this subpackage share: tables, cut lineage, word columns."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java/RE2 character class body.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"
#: The same six characters themselves, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a
    session without that setting (tests) a temporary folder set once."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(told)
        return told.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="recordloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it by checkpoint(), for narrow rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it as Parquet in the shared folder; Spark then
    knows its size, so that joins with it are planned by that size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that Spark sends to Python at a time, and Spark's own default for it.
ARROW_ROWS, DEFAULT_ROWS = 2000, "10000"


def short_batches(spark: SparkSession) -> None:
    """Sends rows to Python in short batches, unless the session has a setting of its own: a
    batch of long texts stands in memory on both sides at once, in every task of an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short parts, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def dealt(rows: DataFrame, by: str, block: int, seed: int) -> DataFrame:
    """rows (with count: how many rows have the same keys) with own, low and high, which are
    the same: a block of such rows by a hash of the column by, about block rows or fewer."""
    n = F.greatest(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(seed), by), n).cast("int")
    return rows.withColumns({"own": own, "low": own, "high": own})


def crossed(rows: DataFrame, by: str, block: int) -> DataFrame:
    """rows (with odd: whether a row is one of the many or a stray, and n_odd and n_even: how
    many of both have the same keys) with low and high: groups of one block of strays, or of
    two blocks one of which holds strays, so that a stray meets every row and the many do not
    meet each other. Column own is a row's block. With few strays each row comes a few times."""
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    of = lambda n: F.pmod(F.xxhash64(F.lit("crossed"), by), F.greatest(blocks(n), F.lit(1))).cast("int")
    out = rows.withColumn("own", F.when(F.col("odd"), of("n_odd")).otherwise(blocks("n_odd") + of("n_even")))
    last = F.when(F.col("odd"), blocks("n_odd") + blocks("n_even")).otherwise(blocks("n_odd")) - 1
    out = out.withColumn("other", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    return out.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "odd", "n_odd", "n_even")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups from batches in order of keys (numbers without nulls), with
    where each group of two rows or more begins and ends."""
    import numpy as np

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch])
        held = held if rest is None else pa.concat_tables([rest, held]).combine_chunks()
        new = np.ones(held.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([np.diff(held.column(k).to_numpy()) != 0 for k in keys])
        starts = np.flatnonzero(new)
        rest = held.slice(starts[-1])
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), [(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()) if b - a > 1]
    if rest is not None and rest.num_rows > 1:
        yield rest, [(0, rest.num_rows)]


def discard(df: DataFrame) -> None:
    """Deletes what written() has kept, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of plans that nothing refers to any more.

    The second round finds what the first one's finalizers have let go.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def n_words(text: Column) -> Column:
    """Number of runs of non-white characters; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
