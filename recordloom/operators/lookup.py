"""Lookup tables: symbol lists, two-dimensional tables, string tables, and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import binary as B

STRING_HEADER, STRING_ENTRY = 18, 26
#: Entries that the offset mode of a string table is judged by.
SAMPLE = 2048


def deciphered(content: Column, key: bytes) -> Column:
    """Text resources: with the mark FF FF the rest is XORed with a cyclic key; Latin-1."""
    n = F.length(content) - 2
    one = lambda i: F.lpad(F.hex(F.conv(F.hex(B.slice_at(content, i + 2, 1)), 16, 10).cast("int").bitwiseXOR(F.get(F.array(*map(F.lit, key)), i % len(key)))), 2, "0")
    plain = F.unhex(F.concat_ws("", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<string>"))))
    raw = F.when(F.hex(B.slice_at(content, 0, 2)) == "FFFF", plain).otherwise(content)
    return F.regexp_replace(F.decode(raw, "ISO-8859-1"), "^(ï»¿)", "")


def number(text: Column) -> Column:
    """Decimal, 0x, 0o or 0b notation; null for anything else."""
    bare, sign = F.regexp_replace(text, "^[+-]", ""), F.when(text.startswith("-"), -1).otherwise(1)
    low = F.lower(bare)
    digits = F.substring(low, 3, 64)
    value = (
        F.when(low.rlike("^0x[0-9a-f]+$"), F.conv(digits, 16, 10))
        .when(low.rlike("^0o[0-7]+$"), F.conv(digits, 8, 10))
        .when(low.rlike("^0b[01]+$"), F.conv(digits, 2, 10))
        .when(low.rlike("^([1-9][0-9]*|0+)$"), low)
    )
    return value.try_cast("bigint") * sign


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def symbols(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, value, symbol) of symbol lists; comments, headings and odd lines are skipped."""
    rows = files.select(*keys, F.posexplode(lines(F.col(text))).alias("line", "raw"))
    clean = F.trim(F.regexp_replace("raw", "//.*$", ""))
    rows = rows.select(*keys, "line", F.split(clean, r"\s+", 3).alias("t")).where((F.size("t") >= 2) & ~F.upper(F.get("t", F.lit(0))).isin("IDS"))
    return rows.select(*keys, "line", number(F.get("t", F.lit(0))).alias("value"), F.get("t", F.lit(1)).alias("symbol")).where("value is not null")


def forward(listed: DataFrame, keys: list[str]) -> DataFrame:
    """The last symbol of each value."""
    return listed.groupBy(*keys, "value").agg(F.max_by("symbol", "line").alias("symbol"))


def backward(listed: DataFrame, keys: list[str]) -> DataFrame:
    """The last value of each symbol."""
    return listed.groupBy(*keys, "symbol").agg(F.max_by("value", "line").alias("value"))


def cells(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, row_idx, row_label, column, cell) of two-dimensional tables.

    The second line has the default, the third the columns; short rows get the default,
    cells beyond the columns are dropped, the last of equal labels holds by label.
    """
    split = F.split(F.trim("raw"), r"\s+")
    all_lines = F.filter(lines(F.col(text)), lambda x: F.trim(x) != "")
    good = files.select(*keys, all_lines.alias("all")).where(F.upper(F.get("all", F.lit(0))).rlike(r"^\s*2DA\s+V1\.0"))
    rows = good.select(*keys, F.get(F.split(F.trim(F.get("all", F.lit(1))), r"\s+"), F.lit(0)).alias("default"), F.split(F.trim(F.get("all", F.lit(2))), r"\s+").alias("columns"), F.posexplode(F.slice("all", F.lit(4), F.greatest(F.size("all") - 3, F.lit(0)))).alias("row_idx", "raw"))
    rows = rows.select(*keys, "default", "columns", "row_idx", split.alias("v"))
    rows = rows.select(*keys, "default", "row_idx", F.get("v", F.lit(0)).alias("row_label"), "v", F.posexplode("columns").alias("i", "column"))
    return rows.select(*keys, "row_idx", "row_label", "column", F.coalesce(F.get("v", F.col("i") + 1), "default").alias("cell"))


def table_name(reference: Column) -> Column:
    """The table that a reference names: without folders and extension, upper case."""
    return F.upper(F.regexp_replace(F.regexp_extract(F.trim(reference), r"[^/\\\\]*$", 0), r"\.[^.]*$", ""))


def cell_of(rows: DataFrame, key: str, table: DataFrame, column: str, out: str, by: str = "row_label") -> DataFrame:
    """rows with out: the cell of a two-dimensional table (cells()) in the row that key names,
    by label or, with by="row_idx", by number; the default in a row without the column, null
    without the row. Of rows with one label the last holds."""
    default = F.first("default", ignorenulls=True) if "default" in table.columns else F.lit(None).cast("string")
    own = F.max_by(F.struct(F.col("cell").alias("cell")), F.when(F.col("column") == column, F.col("row_idx"))).alias("best")
    match = table.groupBy(F.col(by).cast("string").alias("lookup_key")).agg(own, default.alias("lookup_default"))
    match = match.select("lookup_key", F.coalesce("best.cell", "lookup_default").alias(out))
    return rows.join(match, F.col(key).cast("string") == F.col("lookup_key"), "left").drop("lookup_key")


def entries_shown(values: Column, labels: dict[int, str] | None = None, shown: dict[int, str] | None = None, empty: tuple[int, ...] = (), sparse: bool = False, prefix: str = "entry_") -> Column:
    """An array of numbers for display, as text: names from shown, null for empty values; with
    labels a map from the label of each place, empty ones left out if sparse."""

    def one(v: Column) -> Column:
        named = F.create_map(*(x for k, t in shown.items() for x in (F.lit(k).cast("bigint"), F.lit(t))))[v.cast("bigint")] if shown else F.lit(None).cast("string")
        return F.when(v.isNotNull() & ~v.isin(*empty) if empty else v.isNotNull(), F.coalesce(named, v.cast("string")))

    if labels is None:
        return F.transform(values, one)
    names = F.create_map(*(x for k, t in labels.items() for x in (F.lit(k), F.lit(t))))
    pairs = F.transform(values, lambda v, i: F.struct(F.coalesce(names[i], F.concat(F.lit(prefix), i.cast("string"))).alias("label"), one(v).alias("shown")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["shown"].isNotNull()) if sparse else pairs)


def by_place(indices: Column, items: Column) -> Column:
    """Each index as the item at that place, the index itself outside the items; both as text."""
    return F.transform(indices, lambda i: F.coalesce(F.when(i >= 0, F.get(items, i.cast("int"))).cast("string"), i.cast("string")))


def sequence_of(lookup: Column, start: Column, count: Column) -> Column:
    """The entries of a lookup list from start on, those outside it left out."""
    places = F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.filter(places, lambda i: (i >= 0) & (i < F.size(lookup))), lambda i: F.get(lookup, i.cast("int")))


def resolved(rows: DataFrame, value: str, table: DataFrame, key: str, shown: str, out: str, offset: int = 0, skip: tuple[int, ...] = (), both: bool = False) -> DataFrame:
    """rows with out: what the table shows for value plus offset, or the value itself.

    table: (key, shown), one row a key. Values to skip are not looked up.
    """
    raw = F.col(value)
    on = F.when(~raw.isin(*skip) if skip else F.lit(True), raw + offset)
    match = table.select(F.col(key).alias("lookup_key"), F.col(shown).alias("lookup_shown"))
    found = F.col("lookup_shown")
    text = F.concat(F.lit("("), raw.cast("string"), F.lit(") "), found) if both else found
    return rows.withColumn("lookup_on", on).join(match, F.col("lookup_on") == F.col("lookup_key"), "left").withColumn(out, F.coalesce(text, raw.cast("string"))).drop("lookup_on", "lookup_key", "lookup_shown")


def strings(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, strref, text, ...) of string tables.

    Offsets count from the block of texts or from the file's start; the first entries
    that have text decide, the block only if strictly more of them fit so.
    """
    c = F.col(content)
    good = files.where((F.decode(F.substring(c, 1, 4), "ISO-8859-1") == "TLK ") & (F.length(c) >= STRING_HEADER))
    rows = good.select(*keys, c.alias("c"), B.uint_le(c, 14, 4).alias("base"), F.explode(F.sequence(F.lit(0), F.greatest(B.uint_le(c, 10, 4).cast("int") - 1, F.lit(0)))).alias("strref"))
    rows = rows.where(F.col("strref") < B.uint_le(F.col("c"), 10, 4))
    raw = B.slice_at(F.col("c"), STRING_HEADER + F.col("strref") * STRING_ENTRY, STRING_ENTRY)
    rows = rows.withColumn("raw", raw).where(F.length("raw") == STRING_ENTRY)
    rows = rows.select(*keys, "strref", "base", "c", F.length("c").alias("size"), B.uint_le(F.col("raw"), 0, 2).alias("flags"), B.text_at(F.col("raw"), 2, 8).alias("sound"), B.uint_le(F.col("raw"), 18, 4).alias("at"), B.uint_le(F.col("raw"), 22, 4).alias("n"))
    some = (F.col("n") > 0) & (F.col("strref") < SAMPLE)
    direct = (F.col("at") >= F.col("base")) & (F.col("at") + F.col("n") <= F.col("size"))
    within = F.col("base") + F.col("at") + F.col("n") <= F.col("size")
    mode = rows.groupBy(*keys).agg((F.count_if(some & within) > F.count_if(some & direct)).alias("relative"))
    rows = rows.join(mode, keys)
    start = F.when(F.col("relative"), F.col("base")).otherwise(0) + F.col("at")
    text = B.to_nul(F.decode(B.slice_at(F.col("c"), start, F.col("n")), "ISO-8859-1"))
    return rows.select(*keys, "strref", "flags", "sound", "relative", F.when(start <= F.col("size"), text).alias("text"))


def labelled_slots(slots: DataFrame, keys: list[str], slot: str, shown: Column, labels: dict[int, str] | None = None, empty: Column | None = None) -> DataFrame:
    """(keys, slots): a map from slot labels to what they show, empty slots left out.

    A label that occurs again in a resource carries its slot's number.
    """
    named = F.coalesce(F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), F.lit(v))))[F.col(slot)], F.concat(F.lit("slot_"), F.col(slot).cast("string"))) if labels else F.concat(F.lit("slot_"), F.col(slot).cast("string"))
    rows = slots.where(~empty) if empty is not None else slots
    rows = rows.withColumns({"label_": named, "shown_": shown})
    again = F.row_number().over(Window.partitionBy(*keys, "label_").orderBy(slot)) > 1
    rows = rows.withColumn("label_", F.when(again, F.concat("label_", F.lit("["), F.col(slot).cast("string"), F.lit("]"))).otherwise(F.col("label_")))
    pair = F.struct(F.col(slot).alias("slot"), F.col("label_").alias("label"), F.col("shown_").alias("shown"))
    held = F.transform(F.array_sort(F.collect_list(pair)), lambda e: F.struct(e["label"], e["shown"]))
    return rows.groupBy(*keys).agg(F.map_from_entries(held).alias("slots"))


#: Names, and ends of names, of fields that hold numbers of texts.
TEXT_NAMES = ("name", "description", "strref", "area_name", "long_name")
TEXT_ENDS = (
    "_name", "_description", "identified_desc", "unidentified_desc", "_text", "_tooltip", "_strref", "_msg", "_message",
    "identified_name", "unidentified_name", "identified_description", "unidentified_description", "journal_text", "dialog_text", "encounter_text",
)


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with <field>_text beside every whole-number column that by its name holds the number
    of a text; null for numbers up to zero, numbers without a text, and empty texts.

    texts: (strref, text), one row a number. Fields are found in the schema, before anything runs.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    out = rows
    for name, kind in rows.dtypes:
        if kind in whole and (name.lower() in TEXT_NAMES or name.lower().endswith(TEXT_ENDS)):
            own = texts.where("strref > 0 and text <> ''").select(F.col("strref").alias("strref_"), F.col("text").alias(f"{name}_text"))
            out = out.join(own, F.col(name) == F.col("strref_"), "left").drop("strref_")
    return out
