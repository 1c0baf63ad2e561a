"""Sources: raw resources, text tables and override folders as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.binary import name_key

BINARY = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def named(files: DataFrame) -> DataFrame:
    """Files with resref and res_type from their names."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"resref": name_key(F.regexp_replace(name, r"\.[^.]*$", "")), "res_type": F.upper(F.regexp_extract(name, r"\.([^.]*)$", 1))})


def resources(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file under a path, as one row of binary content."""
    return named(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream of files as they appear."""
    return named(spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path))


def decoded_text(files: DataFrame, encoding: str = "ISO-8859-1") -> DataFrame:
    return files.withColumn("text", F.decode("content", encoding))


def located(wanted: DataFrame, there: DataFrame, roots: list[str]) -> DataFrame:
    """For each wanted (game, bif_index, file) the path found first: by root, then with the
    relative path before the bare name; letter case doesn't matter.

    there: (game, path), relative paths of the files that exist.
    """
    base = F.element_at(F.split("file", "/"), -1)
    tries = [F.struct(F.lit(2 * i + k).alias("rank"), F.lower(F.concat(F.lit(f"{r}/" if r else ""), name)).alias("key")) for i, r in enumerate(roots) for k, name in enumerate((F.col("file"), base))]
    rows = wanted.select("*", F.explode(F.array(*tries)).alias("t")).select(*wanted.columns, "t.rank", "t.key")
    hits = rows.join(there.select("game", F.lower("path").alias("key"), "path"), ["game", "key"])
    best = hits.groupBy(*wanted.columns).agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return wanted.join(best, wanted.columns, "left")


def fingerprint(key_files: DataFrame) -> Column:
    """What an index depends on, as one text: the key files' times and lengths."""
    return F.md5(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "path", "modificationTime", "length")))).cast("binary"))
