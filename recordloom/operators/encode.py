"""Encoding: entries to bytes, sections to resources, and checks of fidelity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import binary as B
from recordloom.plans.layout import ENTRY_WIDTHS, Field, Layout, Section


def field_bytes(field: Field, value: Column, digits: bool = False) -> Column:
    """The bytes of a field's value as the layout has them, or their hex digits."""
    kind, size, own = field.kind, field.size, field.attributes
    whole, shown = (B.digits_le, F.hex) if digits else (B.bytes_le, lambda raw: raw)
    if kind in ("char_array", "resref"):
        return shown(B.fixed_text(value, size))
    if kind == "bytes":
        return shown(F.substring(F.concat(F.coalesce(value, F.lit(b"")), F.lit(bytes(size))), 1, size))
    if kind in ENTRY_WIDTHS:
        step = int(own.get("entry_size", ENTRY_WIDTHS[kind]))
        one = (lambda v: shown(B.fixed_text(v, step))) if kind == "resref_array" else (lambda v: whole(v, step))
        return F.concat(*(one(F.get(value, F.lit(k))) for k in range(size // step)))
    if kind == "bitfield" and own.get("bitfields"):
        total = F.coalesce(value["_unknown"], F.lit(0)).cast("bigint")
        for name, p in own["bitfields"].items():
            total = total.bitwiseOR(F.shiftleft(F.coalesce(value[name], F.lit(0)).cast("bigint"), p.get("shift", 0)))
        return whole(total, size)
    if kind == "bitmask" and own.get("flags"):
        total = F.coalesce(value["_unknown"], F.lit(0)).cast("bigint")
        for mask, name in own["flags"].items():
            total = total.bitwiseOR(F.when(value[name], F.lit(int(mask))).otherwise(0).cast("bigint"))
        return whole(total, size)
    if kind == "enum" and own.get("values"):
        pairs = (x for k, v in own["values"].items() for x in (F.lit(v), F.lit(int(k)).cast("bigint")))
        return whole(F.coalesce(F.create_map(*pairs)[value], value.try_cast("bigint"), F.lit(0)), size)
    return whole(value, size)


def entry_bytes(section: Section, values: dict[str, Column], digits: bool = False) -> Column:
    return F.concat(*(field_bytes(f, values[f.name], digits) for f in section.fields if f.size))


def joined(rows: DataFrame, keys: list[str], order: list[str], entry: Column, digits: bool = False, scattered: bool = False) -> DataFrame:
    """(keys, n, body): the entries of each resource in order, one after the other; digits: entry has hex digits;
    scattered: those of one resource hardly lie together, and are brought there before they are gathered."""
    held = rows.select(*keys, F.struct(*order, (entry if digits else F.hex(entry)).alias("bytes")).alias("e"))
    body = F.unhex(F.concat_ws("", F.sort_array(F.collect_list("e")).getField("bytes")))
    return (held.repartition(*keys) if scattered else held).groupBy(*keys).agg(F.count("*").alias("n"), body.alias("body"))


def resource(layout: Layout, values: dict[str, Column], body: Column) -> Column:
    """A header and the one section that follows it."""
    return F.concat(entry_bytes(layout.header, values), F.coalesce(body, F.lit(b"")))


def repacked(sections: DataFrame, keys: list[str], order: str, size: str, first: int | Column = 0) -> DataFrame:
    """Sections of each resource with new offsets, one right after the other."""
    before = F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.lit(first) if isinstance(first, int) else first
    return sections.withColumn("offset", (start + F.coalesce(before, F.lit(0))).cast("bigint"))


def fidelity(original: Column, saved: Column) -> dict[str, Column]:
    """Checksums, lengths, and the first byte in which the two differ."""
    return {
        "md5_original": F.md5(original),
        "md5_saved": F.md5(saved),
        "same": F.md5(original) == F.md5(saved),
        "first_mismatch": F.when(F.md5(original) != F.md5(saved), B.first_difference(original, saved)),
    }
