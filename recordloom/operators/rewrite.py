"""Writing whole resources: as they were, byte for byte, or packed anew after a change.

Entries of all sections meet their resource in one shuffle, or none where they are told by a
condition; everything after that is an expression over the row, so a resource has to fit in
one (as its content already does).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import binary as B
from recordloom.operators import decode, encode
from recordloom.plans.layout import Layout, Section

POLICIES = ("allow", "warn", "fail_nonzero")

#: What becomes of a section: the rows of its entries, or which of the entries that the resource has
#: are kept, by their fields.
Entries = DataFrame | Callable[[Mapping[str, Column]], Column]


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def put(content: Column, at: Column, raw: Column) -> Column:
    """content with raw written over it from a place on; longer if raw reaches past its end."""
    after = F.substring(content, (at + F.length(raw) + 1).cast("int"), F.length(content))
    return F.concat(F.substring(content, F.lit(1), at.cast("int")), raw, after)


def of_part(k: int, alone: bool = False) -> Column:
    """The gathered entries of one section."""
    return F.col("held_") if alone else F.filter("held_", lambda e: e["part"] == k)


def with_bodies(resources: DataFrame, decoded: Mapping[str, Entries], layout: Layout, keys: list[str], content: str = "content") -> DataFrame:
    """resources with n_<section> and body_<section> for every section after the header.

    decoded: by section name rows (keys, entry, fields), or for all of them conditions on
    the fields of an entry; a section without rows is empty. Null keys meet nothing, as in
    any join. Bodies are put together before they meet their resource, so that what is
    sorted and joined is bytes, not arrays of entries.
    """
    given = [s for s in layout.sections[1:] if s.name in decoded]
    none = {f"{c}_{s.name}": v for s in layout.sections[1:] for c, v in (("n", F.lit(0)), ("body", F.lit(b"")))}
    if not given:
        return resources.withColumns(none)
    told = [callable(decoded[s.name]) for s in given]
    if any(told) and not all(told):
        raise ValueError("sections are given by rows or by conditions, not by both")
    alone = len(given) == 1
    cols = {}
    for k, s in enumerate(layout.sections[1:]):
        if s.name in decoded:
            mine = of_part(k, alone)
            cols |= {f"n_{s.name}": F.size(mine), f"body_{s.name}": F.unhex(F.concat_ws("", mine.getField("digits")))}
    bodies = [c.alias(n) for n, c in cols.items()]
    if all(told):
        met = read_once(resources.drop(*none), decoded, layout, keys, bodies, content)
    else:
        parts = []
        for k, s in enumerate(layout.sections[1:]):
            if s.name in decoded:
                digits = encode.entry_bytes(s, {f.name: F.col(f.name) for f in s.fields}, digits=True).alias("digits")
                parts.append(decoded[s.name].select(*keys, F.struct(*(() if alone else (F.lit(k).alias("part"),)), "entry", digits).alias("e")))
        held = reduce(DataFrame.union, parts).groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("held_"))
        met = resources.drop(*none).join(held.select(*keys, *bodies), keys, "left")
    return met.withColumns({n: F.coalesce(n, v) if n in cols else v for n, v in none.items()})


def read_once(resources: DataFrame, kept: Mapping[str, Callable[[Mapping[str, Column]], Column]], layout: Layout, keys: list[str], bodies: list[Column], content: str) -> DataFrame:
    """resources with bodies, made of held_, in one pass: a resource is a row beside those of
    its entries and meets them again by grouping, so that what it is computed from is computed
    once, and grouped where it already lies by keys. The rows are those that a join gives: one
    for each resource, also where several have the same keys."""
    own = [c for c in resources.columns if c not in keys]
    alone, values, whole = len(kept) == 1, F.col("values"), F.col(content)
    places, codes = [], [F.array(F.lit(-1).cast("bigint"))]
    for k, s in enumerate(layout.sections[1:]):
        if s.name in kept:
            start, n = decode.extent_of(layout, s, values, whole)
            places += [start.cast("bigint").alias(f"start_{k}"), n.alias(f"n_{k}")]
            first = F.lit(k << 32).cast("bigint")
            codes.append(F.when(F.col(f"n_{k}") > 0, F.sequence(first, first + F.col(f"n_{k}") - 1)).otherwise(F.expr("array()").cast("array<bigint>")))
    mine = resources.select(*keys, F.struct(*own).alias("own_"), values.alias("values"), whole.alias("content_"), *places)
    rows = mine.select("*", F.explode(F.concat(*codes)).alias("code_"))
    part, entry = F.shiftright("code_", 32).cast("int"), F.col("code_").bitwiseAND(F.lit((1 << 32) - 1).cast("bigint")).cast("int")
    known = {n: values[n] for n in resources.schema["values"].dataType.names}
    raws, read, stays, digits = [], [], F.col("code_") < 0, F.lit(None).cast("string")
    for k, s in enumerate(layout.sections[1:]):
        if s.name in kept:
            here = F.col("code_") >= 0 if alone else part == k
            raws.append(F.when(here, B.slice_at(F.col("content_"), F.col(f"start_{k}") + entry * s.stride, s.stride)).alias(f"raw_{k}"))
            # fields are columns of their own: bytes are made of each several times
            fields = decode.fields(s, F.col(f"raw_{k}"), known, F.col("content_"))
            read += [c.alias(f"f{k}_{n}") for n, c in fields.items()]
            named = {n: F.col(f"f{k}_{n}") for n in fields}
            stays = stays | (here & kept[s.name](named))
            digits = F.when(here, encode.entry_bytes(s, named, digits=True)).otherwise(digits)
    rows = rows.select(*keys, "own_", "values", "content_", "code_", *raws).select(*keys, "own_", "content_", "code_", *read).where(stays)
    # resources without a key are told apart by their bytes: they are no group
    unnamed = reduce(Column.__or__, (F.col(c).isNull() for c in keys))
    one = F.struct(*(() if alone else (part.alias("part"),)), entry.alias("entry"), digits.alias("digits"))
    rows = rows.select(*keys, F.when(unnamed, F.xxhash64("content_")).alias("apart_"), F.when(F.col("code_") < 0, F.col("own_")).alias("own_"), F.when((F.col("code_") >= 0) & ~unnamed, one).alias("e"))
    held = rows.groupBy(*keys, "apart_").agg(F.collect_list("own_").alias("owns_"), F.sort_array(F.collect_list("e")).alias("held_"))
    names = [c for s in layout.sections[1:] if s.name in kept for c in (f"n_{s.name}", f"body_{s.name}")]
    return held.select(*keys, *bodies, "owns_").select(*keys, *names, F.inline("owns_")).select(*resources.columns, *names)


def head(layout: Layout, changed: Mapping[str, Column]) -> Column:
    return encode.entry_bytes(layout.header, {f.name: changed.get(f.name, F.col("values")[f.name] if f.kind != "computed" else F.lit(None)) for f in layout.header.fields})


def preserved(resources: DataFrame, decoded: Mapping[str, Entries], layout: Layout, keys: list[str], content: str = "content") -> DataFrame:
    """resources with saved: sections where they were, in physical order, what lies between
    them and behind them from the original.

    A section that starts before the last one ended is written over it. What starts behind
    the original's end is preceded by zeros. Bytes before an empty section are lost: what is
    not read by an entry comes back only before one, or behind all that is read. Null for null content.
    """
    # the header is written below the join, where it is generated code and written once
    rows = with_bodies(resources.withColumn("head_", head(layout, {})), decoded, layout, keys, content)
    starts = {s.name: decode.start_of(layout, s, F.col("values"), F.col(content)) for s in layout.sections[1:]}
    parts = [F.struct(starts[s.name].cast("bigint").alias("start"), F.lit(k).alias("part"), F.col(f"body_{s.name}").alias("body")) for k, s in enumerate(layout.sections[1:])]
    found = F.array_sort(F.filter(F.array(*parts), lambda p: (p["start"] > 0) & (F.length(p["body"]) > 0)))
    state = lambda raw, at: F.struct(raw.alias("raw"), at.cast("bigint").alias("at"))

    def step(done: Column, p: Column) -> Column:
        room = p["start"] - done["at"]
        kept = F.when(p["start"] <= F.length(content), F.substring(F.col(content), (done["at"] + 1).cast("int"), room.cast("int"))).otherwise(zeros(room))
        ready = F.when(room > 0, put(done["raw"], done["at"], kept)).otherwise(done["raw"])
        return state(put(ready, p["start"], p["body"]), p["start"] + F.length(p["body"]))

    first = state(F.col("head_"), F.lit(layout.header.stride))
    rows = rows.withColumn("done_", first if not parts else behind_header(parts[0], layout.header.stride, content) if len(parts) == 1 else F.aggregate(found, first, step))
    rest = decode.trailing(F.col(content), decode.end_of(layout, F.col("values"), F.col(content)))
    saved = F.when(rest.isNull(), F.col("done_")["raw"]).otherwise(put(F.col("done_")["raw"], F.col("done_")["at"], rest))
    return rows.withColumn("saved", F.when(F.col(content).isNotNull(), saved)).drop("head_", "done_", *(f"{c}_{s.name}" for s in layout.sections[1:] for c in ("n", "body")))


def behind_header(part: Column, stride: int, content: str) -> Column:
    """The one section of a layout as preserved() writes it, without a lambda: (raw, at)."""
    at, body, top = part["start"], part["body"], F.col("head_")
    between = F.when(at <= F.length(content), F.substring(F.col(content), stride + 1, (at - stride).cast("int"))).otherwise(zeros(at - stride))
    after = F.substring(top, (at + F.length(body) + 1).cast("int"), F.lit(stride))
    raw = F.concat(F.substring(top, F.lit(1), at.cast("int")), F.when(at > stride, between).otherwise(F.lit(b"")), body, after)
    written = (at > 0) & (F.length(body) > 0)
    return F.struct(F.when(written, raw).otherwise(top).alias("raw"), F.when(written, at + F.length(body)).otherwise(F.lit(stride)).cast("bigint").alias("at"))


def place_of(section: Section, field: str) -> tuple[int, int]:
    """Offset and size of a field in its entry."""
    f = next(f for f in section.fields if f.name == field)
    return f.offset, f.size


def repointed(body: Column, n: Column, source: Section, target: Section, field: str, stride: str | None, start: Column) -> Column:
    """Entries of source with pointers into target: the first to its start, each next one as
    many of target's entries further as the entry before it says."""
    (to, width) = place_of(source, field)
    many, size = place_of(source, stride) if stride else (0, 0)

    def step(done: Column, i: Column) -> Column:
        at = i * source.stride
        ahead = B.uint_le(done["body"], at + many, size) * target.stride if stride else F.lit(0)
        raw = put(done["body"], at + to, B.bytes_le(done["place"], width))
        return F.struct(raw.alias("body"), (done["place"] + ahead).cast("bigint").alias("place"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(body.alias("body"), start.cast("bigint").alias("place")), step)["body"]).otherwise(body)


def repacked(resources: DataFrame, decoded: Mapping[str, Entries], layout: Layout, keys: list[str]) -> DataFrame:
    """resources with saved: sections one right after the other in the layout's order, counts,
    offsets and pointers as they then are; gaps and trailing bytes go. Empty sections have
    offset zero, except where the offset stands in another section's entry: that stays."""
    rows = with_bodies(resources, decoded, layout, keys)
    changed, place = {}, F.lit(layout.header.stride).cast("bigint")
    by_name = {s.name: s for s in layout.sections}
    for s in layout.sections[1:]:
        n = F.col(f"n_{s.name}")
        rows = rows.withColumn(f"at_{s.name}", F.when(n > 0, place).otherwise(0))
        place = place + F.length(f"body_{s.name}")
        if s.offset_field:
            changed[s.offset_field] = F.col(f"at_{s.name}")
        if isinstance(s.count, str) and s.count != "rest":
            changed[s.count] = n.cast("bigint")
    for s in layout.sections[1:]:
        start, some = F.col(f"at_{s.name}"), F.col(f"n_{s.name}") > 0
        if s.offset_from:
            name, index, field = s.offset_from
            to, width = place_of(by_name[name], field)
            whole = put(F.col(f"body_{name}"), F.lit(index * by_name[name].stride + to), B.bytes_le(start, width))
            rows = rows.withColumn(f"body_{name}", F.when(some & (F.col(f"n_{name}") > index), whole).otherwise(F.col(f"body_{name}")))
        if s.offset_update:
            name, field, stride = s.offset_update
            whole = repointed(F.col(f"body_{name}"), F.col(f"n_{name}"), by_name[name], s, field, stride, start)
            rows = rows.withColumn(f"body_{name}", F.when(some, whole).otherwise(F.col(f"body_{name}")))
    saved = F.concat(head(layout, changed), *(F.col(f"body_{s.name}") for s in layout.sections[1:]))
    return rows.withColumn("saved", saved).drop(*(f"{c}_{s.name}" for s in layout.sections[1:] for c in ("n", "body", "at")))


def gate(policy: str, modified: Column, nonzero_gaps: Column) -> Column:
    """Whether a resource may be written, as (allowed, message): a changed one with gaps that
    aren't zero is reported under warn and refused under fail_nonzero."""
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}")
    hit = F.coalesce(modified & (nonzero_gaps > 0), F.lit(False)) & F.lit(policy != "allow")
    told = F.when(hit, F.concat(nonzero_gaps.cast("string"), F.lit(" gaps with other bytes than zero would be lost")))
    return F.struct((~hit | F.lit(policy != "fail_nonzero")).alias("allowed"), told.alias("message"))
