"""Reference graphs between resources."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.plans.layout import Layout


def edges(rows: DataFrame, source: str, targets: list[str]) -> DataFrame:
    """(src, field, dst): one row per reference held in a column or array of references."""
    parts = []
    for t in targets:
        many = rows.schema[t].dataType.typeName() == "array"
        dst = F.explode(F.col(t)) if many else F.col(t)
        parts.append(rows.select(F.col(source).alias("src"), F.lit(t).alias("field"), dst.alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("dst is not null and dst <> ''").distinct()


def layout_edges(layout: Layout, resources: DataFrame, decoded: Mapping[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, section, field, dst): every reference that a layout says its fields hold, once;
    resources has the column values, decoded the entries of sections that are to be read."""
    parts = []
    for s in layout.sections:
        rows = resources.select(*keys, "values.*") if s is layout.header else decoded.get(s.name)
        for f in s.fields if rows is not None else ():
            if f.kind in ("resref", "resref_array"):
                names = F.array(F.col(f.name)) if f.kind == "resref" else F.col(f.name)
                dst = F.explode(F.transform(names, lambda n: F.upper(F.trim(F.split_part(n, F.lit("\0"), F.lit(1))))))
                parts.append(rows.select(*keys, F.lit(s.name).alias("section"), F.lit(f.name).alias("field"), dst.alias("dst")))
    if not parts:
        raise ValueError(f"{layout.name} has no references in these sections")
    return reduce(DataFrame.union, parts).where("dst <> ''").distinct()


def used_by(links: DataFrame) -> DataFrame:
    """(dst, n, users): who refers to each resource."""
    return links.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("src")).alias("users"))


def kept(df: DataFrame) -> DataFrame:
    """df computed once, as Parquet in the folder that driver and executors share: rounds
    of an iteration then have no lineage and known sizes."""
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        place = tempfile.mkdtemp(prefix="recordloom-")
        spark.sparkContext.setCheckpointDir(place)
    path = f"{place.rstrip('/')}/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(links: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): everything reachable, with the least number of steps.

    By path doubling: pairs of exactly `half` steps are followed by all pairs of up to
    `half` steps, until that gives nothing new. A chain of any length ends in as many
    rounds as its length has binary digits, and so do cycles. Nothing is followed beyond
    nodes of stop (node).
    """
    found = kept(links.select("src", "dst").distinct().withColumn("depth", F.lit(1)))
    half = 1
    while True:
        first = found.where(F.col("depth") == half).select("src", F.col("dst").alias("mid"))
        if stop is not None:
            first = first.join(stop.select(F.col("node").alias("mid")), "mid", "left_anti")
        second = found.select(F.col("src").alias("mid"), "dst", "depth")
        ahead = first.join(second, "mid").groupBy("src", "dst").agg((F.min("depth") + half).alias("depth"))
        old = found.select(F.col("src").alias("old_src"), F.col("dst").alias("old_dst"))
        # null-safe: a pair with a null end must not be new in every round
        new = kept(ahead.join(old, F.col("src").eqNullSafe(F.col("old_src")) & F.col("dst").eqNullSafe(F.col("old_dst")), "left_anti"))
        if new.isEmpty():
            return found
        found, half = found.union(new), 2 * half


def shared(links: DataFrame, least: int = 2) -> DataFrame:
    """(dst, n, sources): targets that several distinct sources lead to."""
    return used_by(links).where(F.col("n") >= least).withColumnRenamed("users", "sources")


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst) over a middle: links (src, dst) followed by links (src, dst)."""
    return first.select("src", F.col("dst").alias("mid")).join(second.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()


def dangling(links: DataFrame, known: DataFrame) -> DataFrame:
    """References to what is not there; known: (node)."""
    return links.join(known.select(F.col("node").alias("dst")), "dst", "left_anti")
