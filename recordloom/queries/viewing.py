"""Queries over views of layouts, references by layout, candidates of gaps, pictures and archives."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import raster as pixels
from recordloom.operators import audit, catalog, decode, encode, graph, lookup, projection, raster, search
from recordloom.plans.layout import layout
from recordloom.plans.projection import view
from recordloom.queries.auditing import HITS_SQL, with_pointers
from recordloom.queries.formats import latin, put_together, u
from recordloom.queries.tables import register, table

QUERIES: dict = {}

ACCOUNT = layout(
    {
        "name": "ACCOUNT",
        "sections": {
            "header": {
                "fields": [
                    {"name": "signature", "type": "char_array", "size": 4},
                    {"name": "order_count", "type": "dword"},
                    {"name": "order_offset", "type": "dword"},
                    {"name": "line_count", "type": "dword"},
                    {"name": "line_offset", "type": "dword"},
                ]
            },
            "orders": {
                "offset_field": "order_offset",
                "count": "order_count",
                "fields": [
                    {"name": "key", "type": "dword", "size": 8},
                    {"name": "state", "type": "bitfield", "bitfields": {"kind": {"shift": 0, "mask": 7}, "rank": {"shift": 3, "mask": 31}}},
                    {"name": "first_line", "type": "dword"},
                    {"name": "lines", "type": "dword"},
                ],
            },
            "lines": {
                "offset_field": "line_offset",
                "count": "line_count",
                "fields": [{"name": "key", "type": "dword"}, {"name": "number", "type": "word"}, {"name": "supplier", "type": "resref"}],
            },
        },
    }
)
VIEW = view(
    {
        "name": "Account",
        "groups": [
            {"name": "Sizes", "fields": [{"name": "orders", "from": "order_count"}, {"name": "all_lines", "from": {"A": "line_count", "B": "line_offset"}}, {"name": "mark", "from": "signature", "games": ["B"]}]},
            {
                "name": "Orders", "repeating": True, "from_section": "orders",
                "fields": [
                    {"name": "number", "from": "key"},
                    {"name": "kind", "from_bitfield": {"field": "state", "subfield": "kind"}, "max": 5},
                    {"name": "rank", "from_bitfield": {"field": "state", "subfield": "rank"}, "min": 2, "max": 28},
                    {"name": "Lines", "repeating": True, "from_section": "lines", "first": "first_line", "count": "lines", "fields": [{"name": "quantity", "from": "key"}, {"name": "number"}, {"name": "supplier", "nullable": False}]},
                ],
            },
        ],
    },
    ACCOUNT,
    "A",
)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resource per customer with orders: its orders and their lines, in order, with header values."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    line = encode.entry_bytes(ACCOUNT.sections[2], {"key": F.col("l_quantity").cast("bigint"), "number": F.col("l_linenumber"), "supplier": F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))})
    bodies = encode.joined(lines, ["c_custkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], line).select("c_custkey", F.col("n").alias("n_lines"), F.col("body").alias("line_body"))
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    own = orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("c_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("first", F.coalesce(before, F.lit(0)))
    entry = F.concat(u(F.col("o_orderkey"), 8), u(F.col("o_orderkey") * 13 % 256), u(F.col("first")), u(F.col("n")))
    whole = encode.joined(own, ["c_custkey"], ["o_orderkey"], entry).join(bodies, "c_custkey", "left")
    count, start, wide = F.coalesce("n_lines", F.lit(0)), ACCOUNT.header.stride, ACCOUNT.sections[1].stride
    head = F.concat(F.lit(b"ACC "), u(F.col("n")), u(start), u(count), u(start + F.col("n") * wide))
    content = F.concat(head, "body", F.coalesce("line_body", F.lit(b"")))
    return decode.header(whole.select("c_custkey", content.alias("content")), ACCOUNT)


def decoded(resources: DataFrame) -> dict[str, DataFrame]:
    return {s.name: decode.entries(resources, ACCOUNT, s.name, ["c_custkey"]) for s in ACCOUNT.sections[1:]}


ORDERS_SQL = """
    WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
    o AS (SELECT o_custkey AS c_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS entry, CAST(o_orderkey * 13 % 256 % 8 AS BIGINT) AS kind, CAST(o_orderkey * 13 % 256 // 8 AS BIGINT) AS rank, coalesce(n, 0) AS n
        FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)"""


@register(QUERIES, ORDERS_SQL + " SELECT c_custkey, count(*) AS orders, CAST(sum(n) AS BIGINT) AS all_lines FROM o GROUP BY 1")
def view_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields under a view's names; those of another game are not there."""
    return projection.projected(accounts(spark, sf_dir), VIEW["Sizes"], ["c_custkey"])


@register(QUERIES, ORDERS_SQL + """ SELECT c_custkey, entry, CAST(o_orderkey AS BIGINT) AS number, kind, rank,
    concat_ws(',', CASE WHEN kind > 5 THEN 'kind' END, CASE WHEN rank < 2 OR rank > 28 THEN 'rank' END) AS problems FROM o""")
def view_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by view, parts of bit fields as fields, with those out of their bounds."""
    rows = projection.repeated(decoded(accounts(spark, sf_dir)), VIEW["Orders"], ["c_custkey"])
    return rows.select("c_custkey", "entry", F.col("number").cast("bigint").alias("number"), "kind", "rank", F.concat_ws(",", projection.problems(VIEW["Orders"])).alias("problems"))


@register(QUERIES, ORDERS_SQL + """ SELECT c_custkey, entry AS owner, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS place,
    CAST(l_quantity AS BIGINT) AS quantity, CAST(l_linenumber AS BIGINT) AS number, 's' || CAST(l_suppkey AS VARCHAR) AS supplier FROM o JOIN lineitem ON l_orderkey = o_orderkey""")
def view_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner entries of each outer one, by the range that it names."""
    rows = projection.nested(decoded(accounts(spark, sf_dir)), VIEW["Orders"], VIEW["Orders"].inner[0], ["c_custkey"])
    return rows.withColumn("supplier", F.split_part("supplier", F.lit("\0"), F.lit(1)))


@register(QUERIES, ORDERS_SQL + """, k AS (SELECT l_orderkey, count(*) AS k FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1), a AS (SELECT o.*, coalesce(k, 0) AS k FROM o LEFT JOIN k ON l_orderkey = o_orderkey)
    SELECT c_custkey, entry, CAST(o_orderkey AS BIGINT) AS key, kind, CAST((rank + 1) % 32 AS BIGINT) AS rank, CAST(sum(k) OVER (PARTITION BY c_custkey ORDER BY entry) - k AS BIGINT) AS first_line, CAST(k AS BIGINT) AS lines FROM a""")
def view_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed views back in their section: a part of a bit field anew, the ranges of inner entries counted again."""
    parts, keys, outer = decoded(accounts(spark, sf_dir)), ["c_custkey"], VIEW["Orders"]
    changed = projection.repeated(parts, outer, keys).withColumn("rank", (F.col("rank") + 1) % 32)
    rows = projection.nested(parts, outer, outer.inner[0], keys).where("number <> 2")
    ranges = projection.controls(parts["orders"], rows, keys).withColumnRenamed("owner", "entry")
    out = projection.assembled(parts["orders"], changed, outer, keys).join(ranges, [*keys, "entry"])
    return out.select("c_custkey", "entry", F.col("key").cast("bigint").alias("key"), F.col("state.kind").alias("kind"), F.col("state.rank").cast("bigint").alias("rank"), F.col("first").alias("first_line"), F.col("count").alias("lines"))


@register(QUERIES, "SELECT DISTINCT o_custkey AS c_custkey, 'lines' AS section, 'supplier' AS field, 'S' || CAST(l_suppkey AS VARCHAR) AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def layout_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resources refer to, by the types of their layout's fields."""
    resources = accounts(spark, sf_dir)
    return graph.layout_edges(ACCOUNT, resources, decoded(resources), ["c_custkey"])


@register(QUERIES, """
    WITH i AS (SELECT 'N' || CAST(p_partkey % 50 AS VARCHAR) AS resref, CASE p_size % 3 WHEN 0 THEN 'ITM' WHEN 1 THEN 'SPL' ELSE 'CRE' END AS restype FROM part WHERE p_size < 9),
    w AS (SELECT 'n' || CAST(s_suppkey AS VARCHAR) || CASE s_suppkey % 3 WHEN 0 THEN '.itm' WHEN 1 THEN '.Spl' ELSE '' END AS request, 'N' || CAST(s_suppkey AS VARCHAR) AS name, CASE s_suppkey % 3 WHEN 0 THEN 'ITM' WHEN 1 THEN 'SPL' END AS kind FROM supplier),
    t AS (SELECT request, count(DISTINCT restype) AS n, coalesce(string_agg(DISTINCT restype, ',' ORDER BY restype), '') AS types FROM w LEFT JOIN i ON resref = name AND (kind IS NULL OR kind = restype) GROUP BY 1)
    SELECT request, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, types FROM t""")
def open_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by name, with or without type: found, ambiguous or missing."""
    kinds = lambda c, *of: F.get(F.array(*map(F.lit, of)), (F.col(c) % 3).cast("int"))
    index = table(spark, sf_dir, "part").where("p_size < 9").select(F.concat(F.lit("N"), (F.col("p_partkey") % 50).cast("string")).alias("resref"), kinds("p_size", "ITM", "SPL", "CRE").alias("restype"))
    wanted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string"), kinds("s_suppkey", ".itm", ".Spl", "")).alias("request"))
    return search.opened(wanted, index).withColumn("types", F.array_join("types", ","))


@register(QUERIES, HITS_SQL + """, d AS (SELECT *, ge - gs AS size, (gs % 3) * (ge - gs) AS nz FROM hits),
    f AS (SELECT d.*, CASE WHEN nz = 0 THEN 'low' WHEN pointer_hits > 0 THEN 'high' ELSE 'medium' END AS sure FROM d)
    SELECT user_id, CAST(gap_id AS INT) AS gap_id, CASE WHEN nz > 0 OR pointer_hits > 0 THEN concat_ws(',',
        CASE WHEN size % 2 = 0 THEN 'word_scalar_array:2:' || CAST(size // 2 AS VARCHAR) || ':' || sure END, CASE WHEN size % 4 = 0 THEN 'dword_array:4:' || CAST(size // 4 AS VARCHAR) || ':' || sure END,
        CASE WHEN size % 8 = 0 THEN 'qword_array:8:' || CAST(size // 8 AS VARCHAR) || ':' || sure END, CASE WHEN size % 10 = 0 THEN 'wed_tilemap_entry:10:' || CAST(size // 10 AS VARCHAR) || ':' || sure END,
        CASE WHEN size % 18 = 0 THEN 'wed_polygon_entry:18:' || CAST(size // 18 AS VARCHAR) || ':' || sure END, CASE WHEN size % 4 = 0 THEN 'wed_vertex_entry:4:' || CAST(size // 4 AS VARCHAR) || ':' || sure END) ELSE '' END AS candidates FROM f""")
def gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the entries of gaps may be, for gaps that aren't zero or are pointed at."""
    nonzero = (F.col("start") % 3) * (F.col("end") - F.col("start"))
    found = audit.detailed(with_pointers(spark, sf_dir), nonzero, "nonzero", layout="WED")
    shown = F.transform("candidates", lambda c: F.concat_ws(":", c["type"], c["entry_size"].cast("string"), c["entry_count"].cast("string"), c["confidence"]))
    return found.select("user_id", "gap_id", F.array_join(shown, ",").alias("candidates"))


@register(QUERIES, """
    SELECT l_orderkey, CAST(count_if(l_partkey % 40 - 1 BETWEEN 0 AND 29) AS BIGINT) AS valid, CAST(count_if(l_partkey % 40 - 1 >= 30) AS BIGINT) AS outside, CAST(count_if(l_partkey % 40 = 0) AS BIGINT) AS missing FROM lineitem GROUP BY 1""")
def tile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map cells whose tile exists, lies beyond the tileset, or is none."""
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40 - 1).alias("tile"), F.lit(30).alias("tiles"))
    return raster.tile_validity(cells, ["l_orderkey"], "tile", "tiles")


@register(QUERIES, """
    SELECT l_orderkey, count(*) AS frames, CAST(count_if(l_quantity % 3 > 1 OR l_linenumber % 3 > 1) AS BIGINT) AS visible, CAST(sum(CASE WHEN l_quantity % 3 > 1 OR l_linenumber % 3 > 1 THEN l_linenumber ELSE 0 END) AS BIGINT) AS numbers FROM lineitem GROUP BY 1""")
def visible_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are larger than one pixel."""
    frame = F.struct((F.col("l_quantity") % 3).alias("width"), (F.col("l_linenumber") % 3).alias("height"), F.col("l_linenumber").cast("bigint").alias("number"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(frame).alias("frames"))
    seen = raster.visible(F.col("frames"))
    return rows.select("l_orderkey", F.size("frames").cast("bigint").alias("frames"), F.size(seen).cast("bigint").alias("visible"), F.aggregate(seen, F.lit(0).cast("bigint"), lambda a, f: a + f["number"]).alias("numbers"))


#: Blue, green and red of palette entry k for nation n: green alone at entry 5 where n is even.
BLUE, GREEN, RED = "((k + 251) * n % 256)", "((260 - n % 2 - k) % 256)", "((k + 251) % 256)"
#: DuckDB: the pixel of entry k in hex; the clear entry is 5, or 0 where n leaves 1 over 4.
PIXEL_SQL = f"CASE WHEN n % 2 = 0 AND k = 5 OR n % 4 = 1 AND k = 0 THEN '00000000' ELSE printf('%02X%02X%02XFF', {RED}, {GREEN}, {BLUE}) END"


def palettes(spark: SparkSession, sf_dir: str, clear: bool) -> DataFrame:
    """(n_nationkey, palette): 256 entries a nation; entry 0 has alpha 0 where n leaves 1 over 4."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("bigint").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("k"))
    alpha = F.when((F.col("k") == 0) & (F.col("n") % 4 == 1), 0).otherwise(7) if clear else F.lit(0)
    return put_together(rows, ["n_nationkey"], "k", palette=F.concat(u(F.expr(BLUE), 1), u(F.expr(GREEN), 1), u(F.expr(RED), 1), u(alpha, 1))).drop("n")


@register(QUERIES, f"""
    WITH c AS (SELECT n_nationkey AS n, unnest([0, 7, 9]) AS k FROM nation), p AS (SELECT n, k, {PIXEL_SQL} AS px FROM c)
    SELECT n AS n_nationkey, max(px) FILTER (k = 7) || repeat(max(px) FILTER (k = 0), CAST(n + 1 AS INT)) || max(px) FILTER (k = 9) || max(px) FILTER (k = 0) AS pixels FROM p GROUP BY n""")
def frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of run-length indices by palette, one marker at the end without a count; the clear colour is zeroed."""
    rows = palettes(spark, sf_dir, True)
    data = F.concat(u(7, 1), u(0, 1), u(F.col("n_nationkey").cast("bigint"), 1), u(9, 1), u(0, 1))
    rgba = pixels.frame_rgba(data, "palette", F.col("n_nationkey") + 4, F.lit(1), F.lit(True), F.lit(0))
    return rows.select("n_nationkey", F.hex(rgba).alias("pixels"))


@register(QUERIES, f"""
    WITH c AS (SELECT n_nationkey AS n, unnest(range(256)) AS k FROM nation), p AS (SELECT n, k, printf('%02X%02X%02X', {RED}, {GREEN}, {BLUE}) || CASE k WHEN 0 THEN '00' ELSE 'FF' END AS px FROM c)
    SELECT n AS n_nationkey, md5(repeat(string_agg(px, '' ORDER BY k), 16)) AS pixels FROM p GROUP BY n""")
def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles by palette: entry 0 is clear and keeps its colour."""
    rows = palettes(spark, sf_dir, False)
    tile = F.concat("palette", F.lit(bytes(range(256)) * 16))
    return rows.select("n_nationkey", F.md5(F.hex(pixels.tile_rgba(tile))).alias("pixels"))


@register(QUERIES, """
    WITH e AS (SELECT n_nationkey, (n_nationkey * 7919) % 65536 AS a, (n_nationkey * 104729 + 31) % 65536 AS b FROM nation),
    c AS (SELECT *, (a >> 11) * 255 // 31 AS ar, ((a >> 5) & 63) * 255 // 63 AS ag, (a & 31) * 255 // 31 AS ab, (b >> 11) * 255 // 31 AS br, ((b >> 5) & 63) * 255 // 63 AS bg, (b & 31) * 255 // 31 AS bb FROM e),
    r AS (SELECT n_nationkey, printf('%02X%02X%02XFF', ar, ag, ab) || printf('%02X%02X%02XFF', br, bg, bb) ||
        CASE WHEN a > b THEN printf('%02X%02X%02XFF', (2 * ar + br) // 3, (2 * ag + bg) // 3, (2 * ab + bb) // 3) || printf('%02X%02X%02XFF', (ar + 2 * br) // 3, (ag + 2 * bg) // 3, (ab + 2 * bb) // 3)
        ELSE printf('%02X%02X%02XFF', (ar + br) // 2, (ag + bg) // 2, (ab + bb) // 2) || '00000000' END AS row FROM c)
    SELECT n_nationkey, repeat(row, 4) AS pixels FROM r""")
def block_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of four colours, or of three and a clear one."""
    n = F.col("n_nationkey").cast("bigint")
    block = F.concat(u(n * 7919 % 65536, 2), u((n * 104729 + 31) % 65536, 2), F.lit(b"\xe4\xe4\xe4\xe4"))
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", F.hex(pixels.texture_rgba(block, F.lit(4), F.lit(4), F.lit(False))).alias("pixels"))


@F.pandas_udf(T.BinaryType())
def deflated(content: pd.Series) -> pd.Series:
    return content.map(zlib.compress)


@register(QUERIES, r"""
    SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN 'BIFFV1  ' || s_name END AS text,
        CASE WHEN s_suppkey % 4 = 3 THEN 'unknown archive signature b''GIF8''' END AS error FROM supplier""")
def archives_inflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives as they are, packed whole and packed in two blocks, and others, which are errors."""
    raw = F.concat(F.lit(b"BIFFV1  "), latin(F.col("s_name")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw")).withColumns({"a": F.substring("raw", 1, 9), "b": F.expr("substring(raw, 10)")})
    rows = rows.select("s_suppkey", "raw", "a", "b", *(deflated(c).alias(f"packed_{c}") for c in ("raw", "a", "b")))
    size = lambda c: u(F.length(c).cast("bigint"))
    whole = F.concat(F.lit(b"BIF V1.0"), u(5), F.lit(b"name\0"), size("raw"), size("packed_raw"), "packed_raw")
    blocks = F.concat(F.lit(b"BIFCV1.0"), size("raw"), *(x for c in ("a", "b") for x in (size(c), size(f"packed_{c}"), F.col(f"packed_{c}"))))
    k = F.col("s_suppkey") % 4
    content = F.when(k == 0, F.col("raw")).when(k == 1, whole).when(k == 2, blocks).otherwise(F.lit(b"GIF89a"))
    return rows.select("s_suppkey", catalog.unpacked(content).alias("u")).select("s_suppkey", F.decode("u.content", "ISO-8859-1").alias("text"), F.col("u.error").alias("error"))


@register(QUERIES, "SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS symbol, CAST(max(n_nationkey) AS BIGINT) AS value FROM nation GROUP BY n_regionkey")
def symbol_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by symbol; of several the last holds."""
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(" R"), F.col("n_regionkey").cast("string"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"])
    files = table(spark, sf_dir, "nation").agg(F.concat(F.lit("IDS\n"), F.concat_ws("\n", body)).alias("text")).withColumn("file", F.lit("REGION"))
    return lookup.backward(lookup.symbols(files, ["file"]), ["file"]).select("symbol", "value")
