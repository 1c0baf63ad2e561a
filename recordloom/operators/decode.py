"""Declarative decoding: layouts compiled to projections over binary content.

A header is one flat projection. A section is exploded: one row per entry, its bytes
cut from the content first, its fields read from that cut. Field columns that a query
doesn't use are pruned by the optimizer.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import binary as B
from recordloom.functions.expression import compiled
from recordloom.plans.layout import ENTRY_WIDTHS, SIGNED, Field, Layout, Section


def value(field: Field, raw: Column, context: Mapping[str, Column], content: Column | None = None) -> Column:
    """The column that reads a field from the bytes of its entry; content: those of the resource,
    for strings that stand elsewhere in it and for data whose size another field has."""
    kind, at, size, own = field.kind, field.offset, field.size, field.attributes
    if kind == "computed":
        return compiled(own["expr"], context)
    if kind == "pointer_string":
        length = context[own["length_ref"]]
        return F.when(length > 1, B.text_at(content, context[own["offset_ref"]], length))
    if "size_ref" in own and kind in ("char_array", "bytes"):
        sized = B.slice_at(raw, at, context[own["size_ref"]])
        return sized if kind == "bytes" else B.text_at(raw, at, context[own["size_ref"]])
    if kind == "effect_extra_data":
        return F.when(F.coalesce(context["eff_structure_version"], F.lit(0)) != 0, B.slice_at(raw, at, size)).otherwise(F.lit(b""))
    if kind == "char_array":
        return B.text_at(raw, at, size)
    if kind == "resref":
        return B.text_at(raw, at, size) if size == 8 else B.slice_at(raw, at, size)
    if kind == "bytes":
        return B.slice_at(raw, at, size)
    if kind in ENTRY_WIDTHS:
        step = int(own.get("entry_size", ENTRY_WIDTHS[kind]))
        one = (lambda o: B.text_at(raw, o, step)) if kind == "resref_array" else (lambda o: B.uint_le(raw, o, step))
        return F.array(*(one(at + step * k) for k in range(size // step)))
    if kind in SIGNED:
        return B.sint_le(raw, at, size)
    number = B.uint_le(raw, at, size)
    if kind == "strref":
        return F.when(number != 0, number)
    if kind == "bitfield" and own.get("bitfields"):
        return B.bit_parts(number, {n: (p.get("shift", 0), p.get("mask", 0xFFFFFFFF)) for n, p in own["bitfields"].items()})
    if kind == "bitmask" and own.get("flags"):
        return B.flags(number, {n: int(m) for m, n in own["flags"].items()})
    if kind == "enum" and own.get("values"):
        return B.label(number, {int(k): v for k, v in own["values"].items()})
    return number


def fields(section: Section, raw: Column, context: Mapping[str, Column] | None = None, content: Column | None = None) -> dict[str, Column]:
    """Columns of a section's fields; later ones may compute with earlier ones."""
    known = dict(context or {})
    out = {}
    for f in section.fields:
        out[f.name] = known[f.name] = value(f, raw, known, content)
    return out


def header(resources: DataFrame, layout: Layout, content: str = "content") -> DataFrame:
    """resources with a struct column values: the header and what later sections promote."""
    raw = F.substring(F.col(content), 1, layout.header.stride)
    cols = fields(layout.header, raw, None, F.col(content))
    out = resources.withColumn("values", F.struct(*(c.alias(n) for n, c in cols.items())))
    for s in layout.sections[1:]:
        if s.promote:
            start = F.col("values")[s.offset_field]
            more = fields(s, B.slice_at(F.col(content), start, s.stride), None, F.col(content))
            names = [n for n in out.schema["values"].dataType.names if n not in more]
            out = out.withColumn("values", F.struct(*(F.col("values")[n].alias(n) for n in names), *(c.alias(n) for n, c in more.items())))
    return out


def count_of(section: Section, values: Column, content: Column, start: Column) -> Column:
    """How many entries a section has: a number, a field, or all that fits (rest)."""
    if section.count is None:
        return F.lit(1)
    if section.count == "rest":
        return F.floor((F.length(content) - start) / section.stride)
    if isinstance(section.count, str):
        return F.coalesce(values[section.count], F.lit(0))
    return F.lit(int(section.count))


def entries(resources: DataFrame, layout: Layout, name: str, keys: list[str], content: str = "content", count: Column | None = None, start: Column | None = None) -> DataFrame:
    """One row per entry of a section: keys, entry (its index) and the section's fields.

    resources has the column values of header(). A section at offset zero without any count,
    and a count of zero, give no rows. count and start may come from rules that other
    sections determine (counts.py).
    """
    section = next(s for s in layout.sections if s.name == name)
    start, n = extent_of(layout, section, F.col("values"), F.col(content), count, start)
    rows = resources.select(*keys, "values", F.col(content).alias("content_"), start.cast("bigint").alias("start_"), n.alias("n_"))
    if section.offset_from:
        # places come out of the generator: a filter on fields would compute this start anew in every byte that it reads
        step = F.lit(max(section.stride, 1)).cast("bigint")
        places = F.sequence(F.col("start_"), F.col("start_") + (F.col("n_") - 1) * step, step)
        rows = rows.select(*keys, "values", "content_", F.posexplode(F.when(F.col("n_") > 0, places)).alias("entry", "place_"))
    else:
        rows = rows.select(*keys, "values", "content_", "start_", F.explode(F.when(F.col("n_") > 0, F.sequence(F.lit(0), F.col("n_") - 1))).alias("entry"))
        rows = rows.withColumn("place_", F.col("start_") + F.col("entry") * section.stride)
    raw = B.slice_at(F.col("content_"), F.col("place_"), section.stride)
    rows = rows.select(*keys, "entry", "values", "content_", raw.alias("raw_"))
    known = {n: F.col("values")[n] for n in resources.schema["values"].dataType.names}
    return rows.select(*keys, "entry", *(c.alias(n) for n, c in fields(section, F.col("raw_"), known, F.col("content_")).items()))


def extent_of(layout: Layout, section: Section, values: Column, content: Column, count: Column | None = None, start: Column | None = None) -> tuple[Column, Column]:
    """Where a section starts and how many entries of it are there, null if none can be."""
    if start is None:
        start = start_of(layout, section, values, content)
    n = count if count is not None else count_of(section, values, content, start)
    uncounted = section.count is None and count is None and section is not layout.header
    return start, F.when(start != 0 if uncounted else start.isNotNull(), n).cast("int")


def start_of(layout: Layout, section: Section, values: Column, content: Column) -> Column:
    """Where a section starts: by a field of values, or by one in an entry of another section,
    null if that entry is not there. All in the row, without a join."""
    if section is layout.header:
        return F.lit(0)
    if section.offset_from is None:
        return values[section.offset_field]
    name, index, field = section.offset_from
    other = next(s for s in layout.sections if s.name == name)
    first = start_of(layout, other, values, content)
    found = next(f for f in other.fields if f.name == field)
    # the condition stands inside, see uint_le
    raw = F.when(F.lit(index) < count_of(other, values, content, first), B.slice_at(content, first + index * other.stride, other.stride))
    return value(found, raw, {})


def ends(layout: Layout, values: Column, content: Column) -> list[tuple[Section, Column, Column]]:
    """Each section with where it starts and ends by what the header says."""
    out = []
    for s in layout.sections:
        start = start_of(layout, s, values, content)
        n = F.lit(1) if s is layout.header else count_of(s, values, content, start)
        out.append((s, start, F.coalesce(start + n * s.stride, F.lit(0))))
    return out


def end_of(layout: Layout, values: Column, content: Column) -> Column:
    """The byte after the last one that the layout reads."""
    last = [end for _, _, end in ends(layout, values, content)]
    return F.greatest(*last) if len(last) > 1 else last[0]


#: Kinds that read what is there, and shorten silently.
LENIENT = {"char_array", "bytes", "resref", "computed", "pointer_string"}


def errors(layout: Layout, values: Column, content: Column) -> Column:
    """Failed reads as data: an array of (section, field, offset, message), the first failing
    field of each section that the content is too short for."""

    def failed(s: Section, x: Column) -> Column:
        entry = F.greatest(F.floor((x["size"] - x["start"]) / s.stride), F.lit(0))
        rest = F.greatest(x["size"] - x["start"] - entry * s.stride, F.lit(0))
        out = F.lit(None).cast("struct<section:string,field:string,offset:bigint,message:string>")
        for f in reversed([f for f in s.fields if f.kind not in LENIENT]):
            at = (x["start"] + entry * s.stride + f.offset).cast("bigint")
            told = F.concat(F.lit(f"{f.size} bytes of {f.name} end after "), x["size"].cast("string"))
            out = F.when(rest < f.offset + f.size, F.struct(F.lit(s.name).alias("section"), F.lit(f.name).alias("field"), at.alias("offset"), told.alias("message"))).otherwise(out)
        return F.when(x["end"] > x["size"], out)

    # places are bound once: each field's test would read the header anew
    places = [(s, F.array(F.struct(F.length(content).alias("size"), start.alias("start"), end.alias("end")))) for s, start, end in ends(layout, values, content)]
    found = F.concat(*(F.transform(at, partial(failed, s)) for s, at in places))
    return F.filter(found, lambda e: e.isNotNull())


def trailing(content: Column, end: Column) -> Column:
    """Bytes after the last one that a layout has read, null if none."""
    return F.when(F.length(content) > end, F.substring(content, end.cast("int") + 1, F.length(content)))


def routed(resources: DataFrame, rules: list[tuple[Column, str]], default: str) -> DataFrame:
    """resources with the layout each belongs to, by the first rule that holds."""
    out = F.lit(default)
    for condition, layout in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), layout).otherwise(out)
    return resources.withColumn("layout", out)
