"""Byte-coverage audits: claimed ranges, their union, the gaps, and what is in them.

Claims are rows (keys, start, end). A resource's claims are merged twice, first within
stretches of its bytes and then over what is left of them, so that a resource with very
many claims is merged by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import binary as B

STRETCH = 1 << 16
STRIDES = (2, 4, 8)
#: What a gap can be, with its risk.
ZERO, POINTED, OTHER = ("all_zero_padding", "low"), ("pointer_referenced_nonzero", "high"), ("nonzero_unreferenced", "medium")


def union_of(claims: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = claims.select(*keys, "start", "end").withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merged(claims: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """The union of claims that overlap or touch; empty claims are dropped."""
    some = claims.where("end > start").withColumn("stretch", F.floor(F.col("start") / stretch))
    return union_of(union_of(some, [*keys, "stretch"]).drop("stretch"), keys)


def gaps(union: DataFrame, sizes: DataFrame, keys: list[str], claims: DataFrame | None = None) -> DataFrame:
    """(keys, gap_id, start, end, kind, prev_end, next_start) of unclaimed bytes.

    sizes: (keys, size). next_start is where the next claim starts. prev_end is where the
    union before the gap ends; with claims given, it is the end of the last one of those, by
    start and end, that ends by the gap's start.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    inner = union.withColumn("before", F.lag("end").over(w)).select(*keys, F.coalesce("before", F.lit(0)).alias("g_start"), F.col("start").alias("g_end"), F.col("before").alias("prev_end"), F.col("start").alias("next_start"))
    last = union.groupBy(*keys).agg(F.max("end").alias("last"))
    tail = sizes.join(last, keys, "left").select(*keys, F.coalesce("last", F.lit(0)).alias("g_start"), F.col("size").alias("g_end"), F.col("last").alias("prev_end"), F.lit(None).cast("bigint").alias("next_start"))
    rows = inner.unionByName(tail).where("g_end > g_start")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("g_start")) - 1
    kind = F.when(F.col("next_start").isNull(), "tail_gap").otherwise("internal_gap")
    found = rows.select(*keys, number.alias("gap_id"), F.col("g_start").alias("start"), F.col("g_end").alias("end"), kind.alias("kind"), "prev_end", "next_start")
    return found if claims is None else as_of(found, claims, keys)


def as_of(found: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """found with prev_end by the claims themselves: one running maximum over claims and gaps
    in the order of their places, instead of a join of all pairs."""
    none = lambda t: F.lit(None).cast(t)
    kept = [c for c in found.columns if c not in (*keys, "prev_end")]
    gap = found.select(*keys, F.col("start").alias("place"), F.lit(1).alias("is_gap"), none("struct<s:bigint,e:bigint>").alias("claim"), F.struct(*kept).alias("gap"))
    one = claims.where("end > start").select(*keys, F.col("end").cast("bigint").alias("place"), F.lit(0).alias("is_gap"), F.struct(F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e")).alias("claim"), none(gap.schema["gap"].dataType).alias("gap"))
    order = Window.partitionBy(*keys).orderBy("place", "is_gap").rowsBetween(Window.unboundedPreceding, 0)
    both = one.union(gap).withColumn("last", F.max("claim").over(order)).where("is_gap = 1")
    return both.select(*keys, "gap.*", F.col("last.e").alias("prev_end"))


def pointed_at(found: DataFrame, pointers: DataFrame, keys: list[str], stretch: int = 4096) -> DataFrame:
    """found with the number of pointers (keys, target) into each gap: an equi-join on
    stretches of bytes, then the exact bounds."""
    spread = found.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / stretch), F.floor((F.col("end") - 1) / stretch))))
    hits = spread.join(pointers.select(*keys, "target").withColumn("stretch", F.floor(F.col("target") / stretch)), [*keys, "stretch"])
    hits = hits.where("target >= start and target < end").groupBy(*keys, "gap_id").agg(F.count("*").alias("pointer_hits"))
    return found.join(hits, [*keys, "gap_id"], "left").withColumn("pointer_hits", F.coalesce("pointer_hits", F.lit(0)))


def classified(found: DataFrame, nonzero: Column) -> DataFrame:
    """found with classification and risk; nonzero: how many of a gap's bytes aren't zero."""
    pick = lambda k: F.when(nonzero == 0, ZERO[k]).when(F.col("pointer_hits") > 0, POINTED[k]).otherwise(OTHER[k])
    return found.withColumns({"classification": pick(0), "risk": pick(1)})


def strides(size: Column, pointed: Column, nonzero: Column, more: tuple[int, ...] = ()) -> Column:
    """Entry widths that divide a gap, with how likely each is."""
    sure = F.when(nonzero == 0, "low").when(pointed > 0, "high").otherwise("medium")
    pairs = F.array(*(F.when(size % s == 0, F.struct(F.lit(s).alias("stride"), sure.alias("confidence"))) for s in (*STRIDES, *more)))
    return F.filter(pairs, lambda x: x.isNotNull())


#: Names and widths of entries that a gap may consist of, in general and in some layouts.
CANDIDATES = (("word_scalar_array", 2), ("dword_array", 4), ("qword_array", 8))
CANDIDATES_OF = {"WED": (("wed_tilemap_entry", 10), ("wed_polygon_entry", 18), ("wed_vertex_entry", 4))}
LEVELS = ("summary", "nonzero", "full")


def detailed(found: DataFrame, nonzero: Column, level: str = "nonzero", most: int = 10, layout: str | None = None) -> DataFrame:
    """found (with start, end, pointer_hits) with candidates: what a gap's entries may be, as
    (type, entry_size, entry_count, confidence), the first most of them.

    They are empty at the level summary, and at nonzero for gaps of zeros without pointers.
    """
    if level not in LEVELS:
        raise ValueError(f"no detail level {level!r}: {', '.join(LEVELS)}")
    size = F.col("end") - F.col("start")
    sure = F.when(nonzero == 0, "low").when(F.col("pointer_hits") > 0, "high").otherwise("medium")
    kinds = (*CANDIDATES, *CANDIDATES_OF.get(layout, ()))
    one = lambda name, n: F.struct(F.lit(name).alias("type"), F.lit(n).alias("entry_size"), F.floor(size / n).alias("entry_count"), sure.alias("confidence"))
    fits = F.slice(F.array_compact(F.array(*(F.when((size > 0) & (size % n == 0), one(name, n)) for name, n in kinds))), 1, max(1, most))
    wanted = {"summary": F.lit(False), "full": F.lit(True), "nonzero": (nonzero > 0) | (F.col("pointer_hits") > 0)}[level]
    return found.withColumn("candidates", F.when(wanted, fits).otherwise(F.slice(fits, 1, 0)))


def suppressed(found: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """found with the id of the first allow rule that fits, null if none does.

    A rule names a schema, resource, start and end; its other fields hold if null or equal.
    """
    on = ["game", "schema", "resref", "start", "end"]
    optional = ["size", "kind", "classification", "risk"]
    rules = rules.select(*(F.col(c).alias(f"r_{c}") for c in [*on, *optional, "id", "rank"]))
    fits = found["schema"].eqNullSafe(F.col("r_schema"))
    for c in ("resref", "start", "end"):
        fits &= found[c] == F.col(f"r_{c}")
    for c in ["game", *optional]:
        own, wanted = found["end"] - found["start"] if c == "size" else found[c], F.col(f"r_{c}")
        if c != "size":  # in any letter case
            own, wanted = F.lower(F.trim(own)), F.lower(F.trim(wanted))
        fits &= F.col(f"r_{c}").isNull() | (own == wanted)
    hit = found.join(rules, fits).groupBy(*keys, "gap_id").agg(F.min_by("r_id", "r_rank").alias("rule_id"))
    return found.join(hit, [*keys, "gap_id"], "left")


def summarised(found: DataFrame, levels: list[str]) -> DataFrame:
    """Counts and bytes of gaps by risk, for each level and in total."""
    size = F.col("end") - F.col("start")
    out = found.rollup(*levels).agg(
        F.count("*").alias("gaps"),
        F.sum(size).cast("bigint").alias("gap_bytes"),
        F.max(size).cast("bigint").alias("largest"),
        *(F.count_if(F.col("risk") == r).alias(f"{r}_gaps") for r in ("low", "medium", "high")),
    )
    return out


def measured(found: DataFrame, sizes: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """The audit's measures for each level and in total, gaps that a rule names apart.

    found: keys, start, end, kind, risk, pointer_hits, nonzero_bytes, rule_id; sizes: keys,
    size and the levels.
    """
    size, live = F.col("end") - F.col("start"), F.col("rule_id").isNull()
    rows = found.withColumns({"size_": size, "live_": live, "nonzero_": F.col("nonzero_bytes") > 0, "high_": F.lower("risk") == "high"})
    whole = found.groupBy(*keys).agg(F.sum(size).alias("unclaimed"))
    claimed = sizes.join(whole, keys, "left").select(*levels, "size", (F.col("size") - F.coalesce("unclaimed", F.lit(0))).alias("claimed"))
    top = claimed.rollup(*levels).agg(F.count("*").alias("resources"), F.sum("size").cast("bigint").alias("filesize"), F.sum("claimed").cast("bigint").alias("claimed_bytes"))
    number = lambda c: F.count_if(c)
    of = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("bigint")
    flag, gone = F.col("live_"), ~F.col("live_")
    gaps_ = rows.join(sizes.select(*keys, *levels), keys).rollup(*levels).agg(
        number(flag).alias("total_gaps"), number(flag & (F.lower("kind") == "internal_gap")).alias("internal_gaps"), number(flag & (F.lower("kind") == "tail_gap")).alias("tail_gaps"),
        of(flag, F.col("size_")).alias("unknown_bytes"), number(flag & F.col("nonzero_")).alias("nonzero_gaps"), number(flag & (F.col("pointer_hits") > 0)).alias("pointer_referenced_gaps"),
        number(flag & F.col("high_")).alias("high_risk_gaps"), F.coalesce(F.max(F.when(flag, F.col("size_"))), F.lit(0)).cast("bigint").alias("largest_gap_size"),
        number(gone).alias("suppressed_gaps"), of(gone, F.col("size_")).alias("suppressed_unknown_bytes"), number(gone & F.col("nonzero_")).alias("suppressed_nonzero_gaps"), number(gone & F.col("high_")).alias("suppressed_high_risk_gaps"),
    )
    renamed = gaps_.withColumnsRenamed({c: f"g_{c}" for c in levels})
    on = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in levels]
    out = top.join(renamed, on, "left").drop(*(f"g_{c}" for c in levels))
    return out.fillna(0, [c for c in renamed.columns if not c.startswith("g_")])


def reported(found: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The gaps of each resource that matter most: by risk, then size."""
    rank = F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).otherwise(2)
    order = Window.partitionBy(*keys).orderBy(rank, F.col("start") - F.col("end"), "gap_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


#: Texts that are Arrow columns of results at a time, and bytes that are counted at a time.
PROFILE_ROWS, PROFILE_BYTES = 256, 1 << 20


def counted(raw: pa.Buffer) -> tuple[int, int, int, int, float]:
    """Size, zeros, FFs, distinct values, and the sum of n log2 n over the counts of byte values."""
    n = np.zeros(256, dtype=np.int64)
    for at in range(0, raw.size, PROFILE_BYTES):
        n += np.bincount(np.frombuffer(raw.slice(at, min(PROFILE_BYTES, raw.size - at)), dtype=np.uint8), minlength=256)
    some = n[n > 0]
    return int(n.sum()), int(n[0]), int(n[255]), len(some), float((some * np.log2(some)).sum())


def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and counted() of raw, read where Arrow has it: no copy of a batch as Python objects."""
    names, types = ["size", "zeros", "ffs", "distinct_bytes", "weighted"], [pa.int64()] * 4 + [pa.float64()]
    for batch in batches:
        for at in range(0, batch.num_rows, PROFILE_ROWS):
            part = batch.slice(at, PROFILE_ROWS)
            rows = [counted(x.as_buffer()) if x.is_valid else (None,) * 5 for x in part.column("raw")]
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["key", *names])


def byte_profile(blobs: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Size, zeros, FFs, distinct values, share of nonzero bytes and Shannon entropy of each
    blob, counted in one pass over Arrow batches: no row per byte, and no shuffle."""
    rows = blobs.select(F.struct(*keys).alias("key"), F.col(content).alias("raw"))
    kind = rows.schema["key"].dataType.simpleString()
    got = rows.mapInArrow(profiled, f"key {kind}, size long, zeros long, ffs long, distinct_bytes long, weighted double").where("size > 0")
    entropy = F.log2("size") - F.col("weighted") / F.col("size")
    return got.select("key.*", "size", "zeros", "ffs", "distinct_bytes", F.round((F.col("size") - F.col("zeros")) / F.col("size"), 6).alias("nonzero_share"), F.round(entropy, 6).alias("entropy"))


def byte_counts(blobs: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, byte, n): a row per byte value that occurs; sums are partial before the shuffle."""
    c = F.col(content)
    rows = blobs.select(*keys, c.alias("c"), F.explode(F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c)))).alias("i"))
    return rows.select(*keys, F.conv(F.hex(F.substring("c", F.col("i"), F.lit(1))), 16, 10).cast("int").alias("byte")).groupBy(*keys, "byte").agg(F.count("*").alias("n"))


def byte_statistics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, shares and Shannon entropy from byte_counts()."""
    total = F.sum("n")
    by = counts.groupBy(*keys).agg(
        total.cast("bigint").alias("size"),
        F.sum(F.when(F.col("byte") == 0, F.col("n")).otherwise(0)).cast("bigint").alias("zeros"),
        F.sum(F.when(F.col("byte") == 255, F.col("n")).otherwise(0)).cast("bigint").alias("ffs"),
        F.count("*").alias("distinct_bytes"),
        F.sum(F.col("n") * F.log2("n")).alias("weighted"),
    )
    entropy = F.log2("size") - F.col("weighted") / F.col("size")
    return by.withColumn("nonzero_share", F.round((F.col("size") - F.col("zeros")) / F.col("size"), 6)).withColumn("entropy", F.round(entropy, 6)).drop("weighted")


def sample(content: Column, n: int = 32) -> dict[str, Column]:
    """Head and tail in hex, and a preview in printable ASCII."""
    text = F.regexp_replace(F.decode(B.slice_at(content, 0, 2 * n), "ISO-8859-1"), "[^ -~]", ".")
    tail = F.substring(content, F.greatest(F.length(content) - n, F.lit(0)) + 1, F.lit(n))
    return {"head": F.lower(F.hex(B.slice_at(content, 0, n))), "tail": F.lower(F.hex(tail)), "preview": text}
