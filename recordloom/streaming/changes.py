"""Change logs (resource, field, old, new, source, batch_id, ts), as tables and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["resource", "field"]


def effective(log: DataFrame) -> DataFrame:
    """Changes whose new value differs from the old one."""
    return log.where(~F.col("old").eqNullSafe(F.col("new")))


def latest(log: DataFrame) -> DataFrame:
    """(resource, field, value, ts, changes): the state after all changes."""
    order = F.struct("ts", "batch_id")
    return log.groupBy(*KEY).agg(F.max_by(F.struct(F.col("new").alias("value")), order).alias("v"), F.max("ts").alias("ts"), F.count("*").alias("changes")).select(*KEY, "v.value", "ts", "changes")


def undone(log: DataFrame, batches: DataFrame) -> DataFrame:
    """The state of each field without the changes of some batches (batch_id)."""
    kept = latest(log.join(batches.select("batch_id"), "batch_id", "left_anti"))
    first = log.groupBy(*KEY).agg(F.min_by(F.struct("old"), F.struct("ts", "batch_id")).alias("o")).select(*KEY, "o.old")
    return first.join(kept, KEY, "left").select(*KEY, F.when(F.col("ts").isNull(), F.col("old")).otherwise(F.col("value")).alias("value"))


def history(log: DataFrame) -> DataFrame:
    """Each change with the version it makes and when the next one replaces it."""
    w = Window.partitionBy(*KEY).orderBy("ts", "batch_id")
    return log.withColumns({"version": F.row_number().over(w), "until": F.lead("ts").over(w)})


def once(stream: DataFrame, late: str) -> DataFrame:
    """A stream's changes without repeats that come within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([*KEY, "batch_id"])


def activity(stream: DataFrame, window: str, late: str) -> DataFrame:
    """Changes per resource and time window; late rows within the watermark still count."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "resource").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "resource", "n")


def upserted(stream: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keeps the latest state of a stream as versions of a Parquet table under path.

    Batch n writes path/n from the state of path/(n - 1); a batch that runs again writes
    the same version again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = latest(effective(batch))
        if number > 0:
            old = spark.read.parquet(f"{path}/{number - 1}")
            both = old.unionByName(state)
            state = both.groupBy(*KEY).agg(F.max_by(F.struct("value"), "ts").alias("v"), F.max("ts").alias("ts"), F.sum("changes").alias("changes")).select(*KEY, "v.value", "ts", "changes")
        state.write.mode("overwrite").parquet(f"{path}/{number}")
        if after:
            after(spark.read.parquet(f"{path}/{number}"))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
