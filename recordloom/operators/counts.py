"""Section counts that other sections determine, as aggregates by resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summed(rows: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Sum of a field over a section's entries, nulls as zero."""
    return rows.groupBy(*keys).agg(F.sum(F.coalesce(field, F.lit(0))).cast("bigint").alias("n"))


def extent(rows: DataFrame, keys: list[str], first: str, many: str) -> DataFrame:
    """The largest first index plus count; entries without a count don't take part."""
    reach = F.when(F.col(many) > 0, F.col(first) + F.col(many))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(reach), F.lit(0)).cast("bigint").alias("n"))


def largest(*counts: Column) -> Column:
    return F.greatest(*(F.coalesce(c, F.lit(0)) for c in counts))


def that_fit(base: Column, next_start: Column, stride: int) -> Column:
    """Entries between a section's start and the next known one."""
    return F.floor((next_start - base) / stride).cast("bigint")


def feature_blocks(declared: Column, reach: Column, is_last: Column, remaining: Column, stride: int) -> Column:
    """Blocks that several entries point into: what the header declares or the furthest entry
    reaches; where no section follows, all that physically fit if those are more."""
    needed, there = largest(declared, reach), F.floor(remaining / stride)
    return F.when(is_last & (there > needed), there).otherwise(needed).cast("bigint")


def ceil_product(terms: list[tuple[Column, float]]) -> Column:
    """The product of each value over its divisor, rounded up; null counts as zero."""
    out = F.lit(1).cast("bigint")
    for value, divisor in terms:
        out = out * F.ceil(F.coalesce(value, F.lit(0)) / F.lit(float(divisor)))
    return out


#: Fixed value: a tile without a second picture.
NO_TILE = 0xFFFF


def tilemap_extent(overlays: Column, tilemaps: Column, base: Column, unit: int) -> Column:
    """How many entries of the tile lookup the maps of all overlays need.

    overlays: array of (tile_count, lookup_offset); tilemaps: array of (first, many, second),
    the overlays' maps one after the other. A map's numbers count from where its overlay's
    lookup starts; an overlay without tiles takes no maps, one that starts before base or
    between two entries takes its maps and needs nothing.
    """

    def step(done: Column, o: Column) -> Column:
        many, ahead = F.coalesce(o["tile_count"], F.lit(0)), F.coalesce(o["lookup_offset"], F.lit(0)) - base
        start = F.floor(ahead / unit)
        own = F.slice(tilemaps, (done["cursor"] + 1).cast("int"), F.greatest(many, F.lit(0)).cast("int"))
        first = lambda t: start + F.coalesce(t["first"], F.lit(0)) + F.coalesce(t["many"], F.lit(0))
        second = lambda t: F.when(t["second"] != NO_TILE, start + t["second"] + 1)
        needed = F.array_max(F.transform(own, lambda t: F.greatest(first(t), second(t))))
        fits = (many > 0) & (ahead >= 0) & (ahead % unit == 0)
        most = F.greatest(done["most"], F.when(fits, needed))
        return F.struct((done["cursor"] + F.greatest(many, F.lit(0))).cast("bigint").alias("cursor"), most.cast("bigint").alias("most"))

    start = F.struct(F.lit(0).cast("bigint").alias("cursor"), F.lit(0).cast("bigint").alias("most"))
    return F.aggregate(overlays, start, step)["most"]


def tile_lookup(total: Column, cap: Column, *extents: Column) -> Column:
    """Entries of the tile lookup: the sum of tiles, or the furthest extent where that is more,
    as far as the next section lets it."""
    furthest = largest(*extents) if len(extents) > 1 else F.coalesce(extents[0], F.lit(0))
    return F.greatest(F.coalesce(total, F.lit(0)), F.least(furthest, cap)).cast("bigint")
