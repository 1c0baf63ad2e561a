"""Resources by view: fields under names of their own, inner entries beside their owners, checks
of values, and the way back to sections.

Everything is a projection or an equality join; entries never gather in one row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.plans.projection import Group, Shown


def column(field: Shown, source: Column) -> Column:
    return (source if field.part is None else source[field.part]).alias(field.name)


def projected(resources: DataFrame, group: Group, keys: list[str]) -> DataFrame:
    """(keys, the group's fields) of resources with the column values."""
    return resources.select(*keys, *(column(f, F.col("values")[f.source]) for f in group.fields))


def repeated(decoded: Mapping[str, DataFrame], group: Group, keys: list[str]) -> DataFrame:
    """(keys, entry, the group's fields) for each entry of its section."""
    return decoded[group.section].select(*keys, "entry", *(column(f, F.col(f.source)) for f in group.fields))


def nested(decoded: Mapping[str, DataFrame], outer: Group, inner: Group, keys: list[str]) -> DataFrame:
    """(keys, owner, place, the inner group's fields): the inner entries of each outer one, in
    their places. Ranges end where the section does; an entry in two ranges comes twice."""
    there = decoded[inner.section].groupBy(*keys).agg(F.count("*").alias("there"))
    first, count = F.greatest(F.col(inner.first), F.lit(0)), F.col(inner.count)
    last = F.least(F.col(inner.first) + count, F.col("there")) - 1
    owners = decoded[outer.section].join(there, keys)
    places = owners.select(*keys, F.col("entry").alias("owner"), first.alias("first_"), F.explode(F.when(last >= first, F.sequence(first, last))).alias("at"))
    places = places.select(*keys, "owner", (F.col("at") - F.col("first_")).cast("int").alias("place"), F.col("at").cast("int").alias("entry"))
    return places.join(repeated(decoded, inner, keys), [*keys, "entry"]).select(*keys, "owner", "place", *(f.name for f in inner.fields))


def problems(group: Group) -> Column:
    """Names of the fields whose value is missing or out of its bounds, in the group's order."""

    def bad(f: Shown) -> Column:
        v = F.col(f.name)
        out = F.lit(False) if f.nullable else v.isNull()
        if f.least is not None:
            out |= v < f.least
        if f.most is not None:
            out |= v > f.most
        return F.coalesce(out, F.lit(False))

    return F.array_compact(F.array(*(F.when(bad(f), F.lit(f.name)) for f in group.fields)).cast("array<string>"))


def controls(owners: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, owner, first, count): where the inner rows (keys, owner) of each owner (keys, entry)
    stand when they are laid out owner by owner; owners without rows have a count of zero."""
    many = rows.groupBy(*keys, "owner").agg(F.count("*").alias("count"))
    every = owners.select(*keys, F.col("entry").alias("owner")).join(many, [*keys, "owner"], "left").fillna(0, ["count"])
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("owner").rowsBetween(Window.unboundedPreceding, -1))
    return every.withColumn("first", F.coalesce(before, F.lit(0)).cast("bigint")).select(*keys, "owner", "first", "count")


def assembled(section: DataFrame, rows: DataFrame, group: Group, keys: list[str]) -> DataFrame:
    """The section's entries with the values that rows (as of repeated()) have for them. What the
    group doesn't show stays as it is, bits beside a shown part included; entries that rows
    don't have are gone."""
    new = rows.select(*keys, "entry", *(F.col(f.name).alias(f"new_{f.name}") for f in group.fields))
    out = section.join(new, [*keys, "entry"])
    for f in group.fields:
        value = F.col(f"new_{f.name}")
        out = out.withColumn(f.source, value if f.part is None else F.col(f.source).withField(f.part, value))
    return out.select(*section.columns)
