"""Resources as JSON for people to read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import binary as B
from recordloom.operators import decode, rewrite
from recordloom.plans.layout import Field, Layout, Section


def shown(field: Field, value: Column) -> Column:
    """Names as names, text up to its first NUL, bytes in hex, everything else as it is."""
    if field.kind == "resref":
        return B.name_shown(F.encode(value, "ISO-8859-1") if field.size == 8 else value)
    if field.kind == "bytes":
        return B.bytes_shown(value)
    return F.substring_index(value, "\0", 1) if field.kind in ("char_array", "pointer_string") else value


def entry_json(section: Section, of: Mapping[str, Column]) -> Column:
    return F.to_json(F.struct(*(shown(f, of[f.name]).alias(f.name) for f in section.fields)), {"ignoreNullFields": "false"})


def dumped(resources: DataFrame, layout: Layout, keys: list[str], decoded: Mapping[str, DataFrame], content: str = "content") -> DataFrame:
    """(keys, json): each section as a list of its entries, in the layout's order, and what
    follows the last byte read as _unmapped_trailing_data. One shuffle for all sections."""
    rows = None
    for k, s in enumerate(layout.sections[1:]):
        text = entry_json(s, {f.name: F.col(f.name) for f in s.fields})
        own = decoded[s.name].select(*keys, F.struct(F.lit(k).alias("part"), "entry", text.alias("json")).alias("e"))
        rows = own if rows is None else rows.union(own)
    rest = decode.trailing(F.col(content), decode.end_of(layout, F.col("values"), F.col(content)))
    both = resources.withColumn("rest_", rest)
    if rows is not None:
        both = both.join(rows.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("held_")), keys, "left")
    parts = [F.concat(F.lit('"header":['), entry_json(layout.header, {f.name: F.col("values")[f.name] for f in layout.header.fields}), F.lit("]"))]
    for k, s in enumerate(layout.sections[1:]):
        mine = F.transform(rewrite.of_part(k), lambda e: e["json"])
        parts.append(F.concat(F.lit(f'"{s.name}":['), F.coalesce(F.concat_ws(",", mine), F.lit("")), F.lit("]")))
    spaced = F.rtrim(F.regexp_replace(F.hex("rest_"), "(..)", "$1 "))
    parts.append(F.concat(F.lit('"_unmapped_trailing_data":{"size_bytes":'), F.length("rest_").cast("string"), F.lit(',"data_hex":"'), spaced, F.lit('"}')))
    return both.select(*keys, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))
