"""Queries that pack driver tables into stored formats and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import binary as B
from recordloom.operators import catalog, counts, decode, encode, lookup, raster
from recordloom.plans.layout import layout
from recordloom.plans.samples import ORDER
from recordloom.queries.decoding import packed_orders
from recordloom.queries.tables import register, table

QUERIES: dict = {}


def u(value: Column | int, size: int = 4) -> Column:
    return B.bytes_le(F.lit(value) if isinstance(value, int) else value, size)


def latin(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def put_together(rows: DataFrame, keys: list[str], order: str, **parts: Column) -> DataFrame:
    """Each part of the rows of a key, one after the other in order, and n: how many rows."""
    held = rows.select(*keys, F.struct(order, *(F.hex(c).alias(k) for k, c in parts.items())).alias("e"))
    body = lambda k: F.unhex(F.concat_ws("", F.sort_array(F.collect_list("e")).getField(k)))
    return held.groupBy(*keys).agg(F.count("*").alias("n"), *(body(k).alias(k) for k in parts))


LOCATOR = "(p_partkey * 2654435761) % 4294967296"


@register(QUERIES, f"""
    WITH r AS (SELECT p_size % 4 AS game, p_partkey, {LOCATOR} AS x, row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) - 1 AS entry FROM part)
    SELECT CAST(game AS INT) AS game, CAST(entry AS INT) AS entry, 'P' || CAST(p_partkey AS VARCHAR) AS resref, CASE p_partkey % 3 WHEN 0 THEN 'ITM' WHEN 1 THEN 'TIS' ELSE 'UNKN' END AS res_type,
        CAST(x & 16383 AS BIGINT) AS resource_index, CAST((x >> 14) & 63 AS BIGINT) AS tileset_index, CAST((x >> 20) & 4095 AS BIGINT) AS bif_index FROM r WHERE p_partkey % 10 <> 0""")
def key_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key files of parts by size, read as a catalog; entries without a name are dropped."""
    part = table(spark, sf_dir, "part").withColumn("game", (F.col("p_size") % 4).cast("int"))
    name = F.when(F.col("p_partkey") % 10 != 0, F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    code = F.get(F.array(*map(F.lit, (0x03ED, 0x03EB, 0x7777))), (F.col("p_partkey") % 3).cast("int"))
    files = put_together(part, ["game"], "p_partkey", body=F.concat(B.fixed_text(name, 8), u(code, 2), u(F.expr(LOCATOR))))
    head = F.concat(F.lit(b"KEY V1  "), u(0), u(F.col("n")), u(catalog.KEY_HEADER), u(catalog.KEY_HEADER))
    return catalog.key_entries(files.select("game", F.concat(head, "body").alias("content")))


@register(QUERIES, "SELECT n_nationkey AS key, n_name AS text, 'N' || CAST(n_nationkey AS VARCHAR) AS resref FROM nation")
def archive_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files of one archive a region, cut out again by their locators."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", latin(F.col("n_name")).alias("raw"))
    # sizes in the first round, offsets after the table of files in the second
    sized = nation.withColumn("size", F.length("raw").cast("bigint")).withColumn("game", F.lit("G"))
    placed = encode.repacked(sized, ["n_regionkey"], "n_nationkey", "size", 0)
    per = placed.groupBy("n_regionkey").agg(F.count("*").alias("files"))
    placed = placed.join(per, "n_regionkey").withColumn("at", F.col("offset") + 20 + F.col("files") * catalog.ARCHIVE_FILE)
    entry = F.concat(u(0), u(F.col("at")), u(F.col("size")), u(0x03ED, 2), u(0, 2))
    archives = put_together(placed, ["n_regionkey"], "n_nationkey", entries=entry, bodies=F.col("raw"))
    head = F.concat(F.lit(b"BIFFV1  "), u(F.col("n")), u(0), u(20))
    archives = archives.select(F.lit("G").alias("game"), F.col("n_regionkey").cast("bigint").alias("bif_index"), F.concat(head, "entries", "bodies").alias("content"))
    number = nation.select("n_nationkey", "n_regionkey").alias("a").join(nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")).alias("b"), F.col("r") == F.col("n_regionkey"))
    number = number.groupBy("n_nationkey", "n_regionkey").agg(F.count_if(F.col("k") < F.col("n_nationkey")).alias("resource_index"))
    wanted = number.select(F.lit("G").alias("game"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("resref"), F.lit("ITM").alias("res_type"), F.col("n_regionkey").cast("bigint").alias("bif_index"), "resource_index", F.lit(0).cast("bigint").alias("tileset_index"), "n_nationkey")
    return catalog.contents(wanted, archives).select(F.col("n_nationkey").alias("key"), F.decode("content", "ISO-8859-1").alias("text"), "resref")


@register(QUERIES, """
    WITH s AS (SELECT n_regionkey AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS strref, n_name FROM nation)
    SELECT file, CAST(strref AS INT) AS strref, file % 2 = 0 AS relative, n_name AS text FROM s""")
def string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String tables of nations, offsets from the block of texts in one half of the files and from the file's start in the other."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("file"), "n_nationkey", latin(F.col("n_name")).alias("raw"))
    placed = encode.repacked(nation.withColumn("size", F.length("raw").cast("bigint")), ["file"], "n_nationkey", "size", 0)
    placed = placed.join(placed.groupBy("file").agg(F.count("*").alias("files")), "file").withColumn("base", lookup.STRING_HEADER + F.col("files") * lookup.STRING_ENTRY)
    at = F.col("offset") + F.when(F.col("file") % 2 == 0, 0).otherwise(F.col("base"))
    entry = F.concat(u(1, 2), B.fixed_text(F.lit("SND"), 8), u(0), u(0), u(at), u(F.col("size")))
    files = put_together(placed, ["file"], "n_nationkey", entries=entry, texts=F.col("raw"))
    base = lookup.STRING_HEADER + F.col("n") * lookup.STRING_ENTRY
    content = F.concat(F.lit(b"TLK V1  "), u(0, 2), u(F.col("n")), u(base), "entries", "texts")
    return lookup.strings(files.select("file", content.alias("content")), ["file"]).select("file", "strref", "relative", "text")


@register(QUERIES, "SELECT n_nationkey AS value, replace(n_name, ' ', '_') AS symbol FROM nation")
def symbol_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol list as text, numbers in three notations, with a heading, comments and a line that is none."""
    nation = table(spark, sf_dir, "nation")
    number = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("0x"), F.hex("n_nationkey"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("0b"), F.bin("n_nationkey"))).otherwise(F.col("n_nationkey").cast("string"))
    line = F.concat(number, F.lit("  "), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" // a comment"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"])
    files = nation.agg(F.concat(F.lit("IDS V1.0\n// nothing\nodd line\n"), F.concat_ws("\r\n", body)).alias("text")).withColumn("file", F.lit("NATION"))
    return lookup.forward(lookup.symbols(files, ["file"]), ["file"]).select("value", "symbol")


@register(QUERIES, "SELECT c_custkey, c_name AS text FROM customer")
def text_cipher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under a cyclic key of 64 bytes, and read back."""
    key = bytes((37 * k + 11) % 256 for k in range(64))
    mark = F.lit(b"\xff\xff")
    rows = table(spark, sf_dir, "customer").select("c_custkey", latin(lookup.deciphered(F.concat(mark, latin(F.col("c_name"))), key)).alias("hidden"))
    return rows.select("c_custkey", lookup.deciphered(F.concat(mark, "hidden"), key).alias("text"))


@register(QUERIES, """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN '<zeroed (12 bytes)>' WHEN o_orderkey % 5 = 2 THEN '0x00000000' ELSE '0x' || lower(hex(encode(o_orderstatus))) END AS shown,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '<non-text resref:0102>' ELSE o_orderstatus END AS name FROM orders""")
def bytes_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and names for display: empty, all zero, or hex; no text, other bytes, or text."""
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.lit(b"")).when(k == 1, F.lit(bytes(12))).when(k == 2, F.lit(bytes(4))).otherwise(latin(F.col("o_orderstatus")))
    name = F.when(k == 0, F.lit(bytes(8))).when(k == 1, F.lit(b"\x01\x02\0\x09")).otherwise(B.fixed_text(F.col("o_orderstatus"), 8))
    return table(spark, sf_dir, "orders").select("o_orderkey", B.bytes_shown(raw).alias("shown"), B.name_shown(name).alias("name"))


def le(x: str, size: int) -> str:
    """DuckDB: the hex digits of a whole number, low byte first."""
    return "printf('" + "%02X" * size + "', " + ", ".join(f"(({x}) >> {8 * k}) & 255" for k in range(size)) + ")"


NESTED = layout(
    {
        "name": "NESTED",
        "sections": {
            "header": {"fields": [{"name": "count", "type": "dword"}, {"name": "table_offset", "type": "dword"}]},
            "tables": {"offset_field": "table_offset", "count": 2, "fields": [{"name": "at", "type": "dword"}, {"name": "kind", "type": "dword"}]},
            "items": {"offset_from": {"section": "tables", "index": 1, "field": "at"}, "count": "count", "fields": [{"name": "number", "type": "word"}, {"name": "size", "type": "word"}]},
        },
    }
)


@register(QUERIES, f"""
    SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, {le("CAST(l_quantity AS BIGINT)", 2)}) - 1 AS INT) AS entry,
        CAST(l_linenumber AS BIGINT) AS number, CAST(l_quantity AS BIGINT) AS size FROM lineitem""")
def decode_offset_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section whose place stands in an entry of another section."""
    item = F.concat(u(F.col("l_linenumber"), 2), u(F.col("l_quantity").cast("bigint"), 2))
    bodies = encode.joined(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], item)
    content = F.concat(u(F.col("n")), u(8), u(0), u(1), u(28), u(2), F.lit(b"gap!"), "body")
    rows = decode.header(bodies.select("l_orderkey", content.alias("content")), NESTED)
    return decode.entries(rows, NESTED, "items", ["l_orderkey"])


LENGTH = "24 + 12 * coalesce(n, 0)"
LINES = "orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


@register(QUERIES, f"""
    WITH c AS (SELECT o_orderkey, coalesce(n, 0) AS n, {LENGTH} AS full_, greatest({LENGTH} - o_orderkey % 40, 0) AS size FROM {LINES}),
    r AS (SELECT *, (size - 24) % 12 AS r FROM c WHERE size < full_)
    SELECT o_orderkey, CASE WHEN size < 24 THEN 'header' ELSE 'lines' END AS section,
        CASE WHEN size < 24 THEN CASE WHEN size < 16 THEN 'key' WHEN size < 20 THEN 'line_count' ELSE 'line_offset' END WHEN r < 4 THEN 'quantity' WHEN r < 8 THEN 'price' WHEN r < 9 THEN 'discount' ELSE 'number' END AS field,
        CAST(CASE WHEN size < 24 THEN CASE WHEN size < 16 THEN 8 WHEN size < 20 THEN 16 ELSE 20 END ELSE size - r + CASE WHEN r < 4 THEN 0 WHEN r < 8 THEN 4 WHEN r < 9 THEN 8 ELSE 10 END END AS BIGINT) AS "offset" FROM r""")
def decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failed read of packed orders that are cut short."""
    rows = packed_orders(spark, sf_dir).withColumn("content", F.expr("substring(content, 1, cast(greatest(length(content) - o_orderkey % 40, 0) as int))"))
    found = decode.header(rows, ORDER)
    # rows without an error go by explode: a filter would be pushed down and pack each order anew in every place that reads its content
    one = F.explode(F.slice(decode.errors(ORDER, F.col("values"), F.col("content")), 1, 1)).alias("e")
    return found.select("o_orderkey", one).select("o_orderkey", "e.section", "e.field", "e.offset")


@register(QUERIES, f"SELECT o_orderkey, {LENGTH} AS \"end\", CASE WHEN o_orderkey % 3 > 0 THEN repeat('t', CAST(o_orderkey % 3 AS INT)) END AS trailing FROM {LINES}")
def trailing_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes after the last one that the layout reads."""
    rows = packed_orders(spark, sf_dir).withColumn("content", F.concat("content", F.encode(F.repeat(F.lit("t"), (F.col("o_orderkey") % 3).cast("int")), "ISO-8859-1")))
    end = decode.end_of(ORDER, F.col("values"), F.col("content"))
    found = decode.header(rows, ORDER).withColumn("end", end.cast("bigint"))
    return found.select("o_orderkey", "end", F.decode(decode.trailing(F.col("content"), F.col("end")), "ISO-8859-1").alias("trailing"))


@register(QUERIES, """
    WITH a AS (SELECT l_orderkey, max(CASE WHEN CAST(l_quantity AS BIGINT) % 5 > 0 THEN l_linenumber + CAST(l_quantity AS BIGINT) % 5 END) AS reach FROM lineitem GROUP BY 1),
    n AS (SELECT o_orderkey, greatest(o_custkey % 8, coalesce(reach, 0)) AS needed, (o_orderkey % 4000) // 48 AS there, o_orderkey % 2 = 0 AS last FROM orders LEFT JOIN a ON l_orderkey = o_orderkey)
    SELECT o_orderkey, CAST(CASE WHEN last AND there > needed THEN there ELSE needed END AS BIGINT) AS n FROM n""")
def count_feature_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by header, by what entries reach, and by what fits at the end of a resource."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("first"), (F.col("l_quantity").cast("bigint") % 5).alias("many"))
    reach = counts.extent(lines, ["l_orderkey"], "first", "many")
    both = table(spark, sf_dir, "orders").join(reach, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = counts.feature_blocks(F.col("o_custkey") % 8, F.col("n"), F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 4000, 48)
    return both.select("o_orderkey", n.alias("n"))


CENTS = "CAST(round({} * 100) AS BIGINT)"
LINE_HEX = " || ".join([le(CENTS.format("l_quantity"), 4), le(CENTS.format("l_extendedprice"), 4), le(CENTS.format("l_discount"), 1), "hex(encode(l_returnflag))", le("CAST(l_linenumber AS BIGINT)", 2)])


@register(QUERIES, f"""
    WITH b AS (SELECT l_orderkey, count(*) AS n, string_agg({LINE_HEX}, '' ORDER BY l_linenumber, l_partkey, l_suppkey, {LINE_HEX}) AS body FROM lineitem GROUP BY 1),
    h AS (SELECT o_orderkey, coalesce(n, 0) AS n, hex(encode('ORD V1.0')) || {le("CAST(o_orderkey AS BIGINT)", 8)} || {le("CAST(coalesce(n, 0) AS BIGINT)", 4)} || '18000000' || coalesce(body, '') AS x FROM orders LEFT JOIN b ON l_orderkey = o_orderkey)
    SELECT o_orderkey, md5(unhex(x)) AS md5_original, md5(unhex(CASE WHEN n > 0 AND o_orderkey % 7 = 0 THEN left(x, length(x) - 2) || 'EE' ELSE x END)) AS md5_saved,
        CASE WHEN n > 0 AND o_orderkey % 7 = 0 THEN CAST(length(x) // 2 - 1 AS INT) END AS first_mismatch FROM h""")
def roundtrip_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders decoded and encoded again, the last byte of some changed on the way: checksums and first mismatch."""
    rows = decode.header(packed_orders(spark, sf_dir), ORDER)
    lines, section = decode.entries(rows, ORDER, "lines", ["o_orderkey"]), ORDER.sections[1]
    bodies = encode.joined(lines, ["o_orderkey"], ["entry"], encode.entry_bytes(section, {f.name: F.col(f.name) for f in section.fields}))
    saved = encode.resource(ORDER, {f.name: F.col("values")[f.name] for f in ORDER.header.fields}, F.col("body"))
    both = rows.join(bodies, "o_orderkey", "left").withColumn("whole", saved)
    spoiled = F.concat(F.expr("substring(whole, 1, length(whole) - 1)"), F.lit(b"\xee"))
    both = both.withColumn("saved", F.when((F.col("n") > 0) & (F.col("o_orderkey") % 7 == 0), spoiled).otherwise(F.col("whole")))
    checks = encode.fidelity(F.col("content"), F.col("saved"))
    return both.select("o_orderkey", *(checks[c].alias(c) for c in ("md5_original", "md5_saved", "first_mismatch")))


@register(QUERIES, """
    WITH t AS (SELECT s_suppkey, 'AR' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN s_suppkey % 2 = 0 THEN 'N' ELSE '' END AS name, s_nationkey AS page FROM supplier),
    p AS (SELECT *, name[1] || name[3:6] || CASE WHEN name[7] = 'N' THEN 'N' ELSE '' END AS brief, lpad(CAST(page AS VARCHAR), 2, '0') AS two, printf('%02X', page) AS hexed FROM t)
    SELECT s_suppkey, brief || two || ',' || name[1:6] || two || CASE WHEN page >= 10 THEN ',' || brief || hexed || ',' || name[1:6] || hexed ELSE '' END || ',MOS' || lpad(CAST(page AS VARCHAR), 4, '0') AS names FROM p""")
def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the texture pages of tilesets may be called, in order."""
    name = F.concat(F.lit("ar"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.when(F.col("s_suppkey") % 2 == 0, "n").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(raster.page_names(name, F.col("s_nationkey")), ",").alias("names"))


@register(QUERIES, """
    WITH t AS (SELECT p_partkey, CAST(p_size * p_partkey % 30000 AS BIGINT) AS tiles, CASE WHEN p_partkey % 2 = 0 THEN 64 ELSE 1024 END AS edge FROM part), m AS (SELECT *, greatest(8192 // edge, 1) AS most FROM t)
    SELECT p_partkey, CAST(CASE WHEN tiles <= 0 OR (10 <= most AND ceil(tiles / 10.0) <= most) THEN 10 ELSE least(greatest(ceil(tiles / CAST(most AS DOUBLE)), 1), most) END AS INT) AS columns FROM m""")
def grid_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in a row of a sheet that no side of which is too long."""
    tiles = (F.col("p_size") * F.col("p_partkey") % 30000).cast("bigint")
    return table(spark, sf_dir, "part").select("p_partkey", raster.grid_width(tiles, F.when(F.col("p_partkey") % 2 == 0, 64).otherwise(1024)).alias("columns"))


SLOTS_SQL = "SELECT l_orderkey, list(CAST(l_suppkey AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey) AS held FROM lineitem GROUP BY 1"


def held_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_custkey, held): the suppliers of each order's lines, in order."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_suppkey"].cast("bigint")).alias("held"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))


@register(QUERIES, f"SELECT o_orderkey, CASE WHEN o_custkey % 7 - 1 >= 0 THEN coalesce(held[o_custkey % 7 - 1 + 1], -1) ELSE -1 END AS tile FROM orders JOIN ({SLOTS_SQL}) ON l_orderkey = o_orderkey")
def tile_map_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile of a map cell by its lookup list, -1 outside it."""
    return held_lists(spark, sf_dir).select("o_orderkey", raster.mapped_tile(F.col("held"), F.col("o_custkey") % 7, F.lit(-1)).alias("tile"))


@register(QUERIES, f"""
    SELECT o_orderkey, array_to_string(list_transform(list_filter(range(CAST(o_custkey % 5 AS BIGINT), CAST(o_custkey % 5 + o_orderkey % 4 AS BIGINT)), lambda i: i < length(held)), lambda i: held[i + 1]), ',') AS frames
    FROM orders JOIN ({SLOTS_SQL}) ON l_orderkey = o_orderkey""")
def cycle_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of a cycle by its lookup list, entries outside the list left out."""
    frames = lookup.sequence_of(F.col("held"), (F.col("o_custkey") % 5).cast("bigint"), (F.col("o_orderkey") % 4).cast("bigint"))
    return held_lists(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(frames, lambda x: x.cast("string")), ",").alias("frames"))


@register(QUERIES, f"""
    SELECT o_orderkey, array_to_string(list_transform([o_custkey % 6, o_orderkey % 3], lambda i: coalesce(CAST(held[i + 1] AS VARCHAR), CAST(i AS VARCHAR))), ',') AS items FROM orders JOIN ({SLOTS_SQL}) ON l_orderkey = o_orderkey""")
def positional_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by the items at their places, numbers outside the items as they are."""
    slots = F.array((F.col("o_custkey") % 6).cast("bigint"), (F.col("o_orderkey") % 3).cast("bigint"))
    return held_lists(spark, sf_dir).select("o_orderkey", F.array_join(lookup.by_place(slots, F.col("held")), ",").alias("items"))


@register(QUERIES, """
    WITH v AS (SELECT p_partkey, [p_size % 4, p_partkey % 3, 7] AS v FROM part)
    SELECT p_partkey, array_to_string(list_transform(v, lambda x: CASE WHEN x = 0 THEN '-' WHEN x = 2 THEN 'two' ELSE CAST(x AS VARCHAR) END), ',') AS shown,
        array_to_string(list_filter([CASE WHEN v[1] <> 0 THEN 'head=' || CASE WHEN v[1] = 2 THEN 'two' ELSE CAST(v[1] AS VARCHAR) END END, CASE WHEN v[2] <> 0 THEN 'entry_1=' || CASE WHEN v[2] = 2 THEN 'two' ELSE CAST(v[2] AS VARCHAR) END END, 'tail=7'], lambda x: x IS NOT NULL), ',') AS slots FROM v""")
def array_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of numbers for display, as a list and as a sparse map by label."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array((F.col("p_size") % 4).cast("bigint"), (F.col("p_partkey") % 3).cast("bigint"), F.lit(7).cast("bigint")).alias("v"))
    shown = lookup.entries_shown(F.col("v"), shown={2: "two"}, empty=(0,))
    named = lookup.entries_shown(F.col("v"), labels={0: "head", 2: "tail"}, shown={2: "two"}, empty=(0,), sparse=True)
    pairs = F.transform(F.map_entries(named), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("p_partkey", F.array_join(shown, ",", "-").alias("shown"), F.array_join(pairs, ",").alias("slots"))


@register(QUERIES, """
    WITH r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region)
    SELECT n_nationkey, a.r_name AS by_label, CASE WHEN b.r_regionkey IS NOT NULL THEN CASE WHEN b.r_regionkey % 2 = 0 THEN CAST(b.r_regionkey * 10 AS VARCHAR) ELSE 'NONE' END END AS by_index
    FROM nation LEFT JOIN r a ON a.r_regionkey = n_regionkey LEFT JOIN r b ON b.i = n_nationkey""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a two-dimensional table by a row's label and by its number; short rows have the default."""
    region = table(spark, sf_dir, "region")
    row = F.concat_ws(" ", F.col("r_regionkey").cast("string"), F.replace("r_name", F.lit(" "), F.lit("_")), F.when(F.col("r_regionkey") % 2 == 0, (F.col("r_regionkey") * 10).cast("string")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", row.alias("row")))), lambda x: x["row"])
    files = region.agg(F.concat(F.lit("2DA V1.0\nNONE\nNAME RANK\n"), F.concat_ws("\n", body)).alias("text")).withColumn("file", lookup.table_name(F.lit("tables/region.2da")))
    cells = lookup.cells(files, ["file"])
    out = lookup.cell_of(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", cells, "NAME", "label")
    out = lookup.cell_of(out, "n_nationkey", cells, "RANK", "by_index", by="row_idx")
    return out.select("n_nationkey", F.replace("label", F.lit("_"), F.lit(" ")).alias("by_label"), "by_index")
