"""Queries that pack rows into binary resources and read them by layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import binary as B
from recordloom.functions.expression import compiled
from recordloom.operators import counts, decode, encode
from recordloom.operators.audit import byte_profile
from recordloom.operators.catalog import located, type_name
from recordloom.plans.samples import ORDER
from recordloom.queries.tables import register, sql_byte, table

QUERIES: dict = {}


def packed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One binary resource per order, its lines as entries: (o_orderkey, content)."""
    lines = table(spark, sf_dir, "lineitem")
    cents = lambda c: B.nearest(F.col(c) * 100).cast("bigint")
    values = {"quantity": cents("l_quantity"), "price": cents("l_extendedprice"), "discount": cents("l_discount"), "return_flag": F.col("l_returnflag"), "number": F.col("l_linenumber")}
    section = ORDER.sections[1]
    bodies = encode.joined(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], encode.entry_bytes(section, values, digits=True), digits=True, scattered=True)
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(bodies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = {"signature": F.lit("ORD "), "version": F.lit("V1.0"), "key": F.col("o_orderkey"), "line_count": F.coalesce("n", F.lit(0)), "line_offset": F.lit(ORDER.header.stride)}
    return orders.select("o_orderkey", encode.resource(ORDER, head, F.col("body")).alias("content"))


@register(QUERIES, """
    SELECT l_returnflag AS return_flag, count(*) AS n_lines, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS quantity,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price, CAST(sum(l_linenumber) AS BIGINT) AS numbers
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def packed_scan_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack orders, decode their lines, and add them up by return flag."""
    resources = decode.header(packed_orders(spark, sf_dir), ORDER)
    lines = decode.entries(resources, ORDER, "lines", ["o_orderkey"])
    return lines.groupBy("return_flag").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("quantity"), F.sum("price").alias("price"), F.sum("number").alias("numbers"))


@register(QUERIES, """
    SELECT o_orderkey, 'ORD ' AS signature, 'V1.0' AS version, CAST(o_orderkey AS BIGINT) AS key, CAST(coalesce(n, 0) AS BIGINT) AS line_count, CAST(24 + 12 * coalesce(n, 0) AS BIGINT) AS size
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def packed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields of every packed order."""
    rows = decode.header(packed_orders(spark, sf_dir), ORDER)
    v = F.col("values")
    return rows.select("o_orderkey", v["signature"].alias("signature"), v["version"].alias("version"), v["key"].cast("bigint").alias("key"), v["line_count"].alias("line_count"), F.length("content").cast("bigint").alias("size"))


@register(QUERIES, f"""
    WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents)
    SELECT doc_id, CASE WHEN length(h) >= 2 THEN {sql_byte('h', 0)} END AS b, CASE WHEN length(h) >= 4 THEN {sql_byte('h', 0)} + 256 * {sql_byte('h', 1)} END AS w,
        CASE WHEN length(h) >= 8 THEN {sql_byte('h', 0)} + 256 * {sql_byte('h', 1)} + 65536 * {sql_byte('h', 2)} + CAST(16777216 AS BIGINT) * {sql_byte('h', 3)} END AS d
    FROM d""")
def decode_uint_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned integers of 1, 2 and 4 bytes at the start of each text."""
    raw = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", *(B.uint_le(raw, 0, n).alias(name) for n, name in ((1, "b"), (2, "w"), (4, "d"))))


@register(QUERIES, """
    WITH v AS (SELECT event_id, (event_id * 7919) % 65536 AS w FROM events)
    SELECT event_id, CAST(CASE WHEN w >= 32768 THEN w - 65536 ELSE w END AS BIGINT) AS signed, CAST(CASE WHEN w = 65535 THEN -1 ELSE w END AS BIGINT) AS shown FROM v""")
def decode_sint_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-byte values signed, and unsigned with all bits set read as -1."""
    raw = B.bytes_le((F.col("event_id") * 7919) % 65536, 2)
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", B.sint_le(F.col("raw"), 0, 2).alias("signed"), B.sentinel(B.uint_le(F.col("raw"), 0, 2), 2).alias("shown"))


LOCATOR = "(l_orderkey * 2654435761) % 4294967296"


@register(QUERIES, f"""
    SELECT (({LOCATOR}) >> 20) & 4095 AS bif_index, count(*) AS n, CAST(sum(({LOCATOR}) & 16383) AS BIGINT) AS files, CAST(sum((({LOCATOR}) >> 14) & 63) AS BIGINT) AS tilesets
    FROM lineitem GROUP BY 1""")
def locator_bitfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three parts of 32-bit locators, added up by archive."""
    parts = located(F.expr(LOCATOR))
    rows = table(spark, sf_dir, "lineitem").select(*(c.alias(n) for n, c in parts.items()))
    return rows.groupBy("bif_index").agg(F.count("*").alias("n"), F.sum("resource_index").alias("files"), F.sum("tileset_index").alias("tilesets"))


FLAGS = {"magical": 0x01, "cursed": 0x02, "two_handed": 0x08, "stackable": 0x40}


@register(QUERIES, """
    WITH v AS (SELECT l_partkey % 256 AS x FROM lineitem)
    SELECT (x & 1) <> 0 AS magical, (x & 2) <> 0 AS cursed, (x & 8) <> 0 AS two_handed, (x & 64) <> 0 AS stackable, CAST(CASE WHEN x & 180 <> 0 THEN x & 180 END AS BIGINT) AS unknown, count(*) AS n
    FROM v GROUP BY ALL""")
def bitmask_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by mask, with what no name covers."""
    rows = table(spark, sf_dir, "lineitem").select(B.flags(F.col("l_partkey") % 256, FLAGS).alias("f")).select("f.*")
    return rows.withColumnRenamed("_unknown", "unknown").groupBy(*FLAGS, "unknown").agg(F.count("*").alias("n"))


@register(QUERIES, """
    SELECT CASE CAST(o_orderpriority[1] AS INT) WHEN 1 THEN 'urgent' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE o_orderpriority[1] END AS label, count(*) AS n FROM orders GROUP BY 1""")
def enum_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as labels; a code without one stays a number."""
    code = F.substring("o_orderpriority", 1, 1).cast("bigint")
    return table(spark, sf_dir, "orders").select(B.label(code, {1: "urgent", 2: "high", 3: "medium"}).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@register(QUERIES, """
    WITH v AS (SELECT doc_id, substr(coalesce(text, ''), 1, 24) AS t FROM documents)
    SELECT doc_id, CASE WHEN regexp_full_match(t, '[ -~]*') THEN t ELSE '<binary data: ' || rtrim(regexp_replace(hex(encode(t)), '(..)', '\\1 ', 'g')) || '>' END AS shown
    FROM v WHERE regexp_full_match(t, '[\\x00-\\x7F]*')""")
def cstring_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first characters of ASCII texts as C strings."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 24).alias("t")).where(F.col("t").rlike("^[\\x00-\\x7F]*\\z"))
    return rows.select("doc_id", B.cstring(F.encode("t", "ISO-8859-1")).alias("shown"))


@register(QUERIES, """
    WITH v AS (SELECT doc_id, split_part(coalesce(text, ''), chr(0), 1) AS t FROM documents)
    SELECT doc_id, CASE WHEN regexp_full_match(t, '[ -~]*') THEN t ELSE '<binary data: ' || rtrim(regexp_replace(hex(encode(t)), '(..)', '\\1 ', 'g')) || '>' END AS shown
    FROM v""")
def cstring_display_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, whole, as C strings."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", B.cstring(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("shown"))


@register(QUERIES, "SELECT c_custkey, upper(trim(substr(c_name, 1, 8))) AS resref FROM customer")
def resref_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as fixed eight bytes and back, normalised."""
    raw = B.fixed_text(F.col("c_name"), 8)
    return table(spark, sf_dir, "customer").select("c_custkey", B.name_key(B.text_at(raw, 0, 8)).alias("resref"))


@register(QUERIES, """
    SELECT p_partkey, CAST(floor((p_size - 25) / 4.0) AS BIGINT) AS quotient, CAST((((p_size - 25) % 4) + 4) % 4 AS BIGINT) AS remainder, CAST((p_size - 25) * 3 + 7 AS BIGINT) AS linear FROM part""")
def computed_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed fields, with division that rounds down for negative numbers too."""
    size = {"size": F.col("p_size").cast("bigint")}
    exprs = {"quotient": "(size - 25) // 4", "remainder": "(size - 25) % 4", "linear": "(size - 25) * 3 + 7"}
    return table(spark, sf_dir, "part").select("p_partkey", *(compiled(e, size).cast("bigint").alias(n) for n, e in exprs.items()))


@register(QUERIES, "SELECT p_partkey, CAST(ceil(p_size / 10.0) * ceil(p_retailprice / 75.0) AS BIGINT) AS n FROM part")
def ceil_product_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count as a product of sizes over cell sizes, each rounded up."""
    return table(spark, sf_dir, "part").select("p_partkey", counts.ceil_product([(F.col("p_size"), 10), (F.col("p_retailprice"), 75)]).alias("n"))


@register(QUERIES, "SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def sum_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's count as the sum of another one's field."""
    return counts.summed(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@register(QUERIES, """
    SELECT l_orderkey, CAST(coalesce(max(CASE WHEN l_quantity - 10 > 0 THEN l_linenumber * 16 + CAST(l_quantity AS BIGINT) - 10 END), 0) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def max_extent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's count as the furthest entry that others point to."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 16).alias("first"), (F.col("l_quantity").cast("bigint") - 10).alias("many"))
    return counts.extent(rows, ["l_orderkey"], "first", "many")


@register(QUERIES, """
    WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents), c AS (SELECT doc_id, x, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS size, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY 1""")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy of each text's bytes."""
    blobs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return byte_profile(blobs, ["doc_id"], "raw").select("doc_id", "size", "entropy")


@register(QUERIES, """
    WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents)
    SELECT doc_id, count(*) AS size, count(*) FILTER (x = '00') AS zeros, count(*) FILTER (x = 'FF') AS ffs, count(DISTINCT x) AS distinct_bytes FROM b GROUP BY 1""")
def byte_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bytes, zeros, FFs and distinct values each text has."""
    blobs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return byte_profile(blobs, ["doc_id"], "raw").select("doc_id", "size", "zeros", "ffs", "distinct_bytes")


@register(QUERIES, """
    SELECT o_orderkey, md5('ORD V1.0' || CAST(o_orderkey AS VARCHAR)) IS NOT NULL AS same, CAST(NULL AS INT) AS first_mismatch FROM orders""")
def roundtrip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed orders decoded, encoded again, and compared byte by byte."""
    resources = decode.header(packed_orders(spark, sf_dir), ORDER)
    lines = decode.entries(resources, ORDER, "lines", ["o_orderkey"])
    section = ORDER.sections[1]
    bodies = encode.joined(lines, ["o_orderkey"], ["entry"], encode.entry_bytes(section, {f.name: F.col(f.name) for f in section.fields}))
    both = resources.join(bodies, "o_orderkey", "left")
    saved = encode.resource(ORDER, {f.name: F.col("values")[f.name] for f in ORDER.header.fields}, F.col("body"))
    checks = encode.fidelity(F.col("content"), F.col("saved"))
    return both.withColumn("saved", saved).select("o_orderkey", checks["same"].alias("same"), checks["first_mismatch"].alias("first_mismatch"))


@register(QUERIES, "SELECT doc_id, md5(text) AS md5_original, md5(text) AS md5_saved FROM documents")
def roundtrip_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of texts before and after going through bytes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    checks = encode.fidelity(F.col("raw"), F.encode(F.decode("raw", "UTF-8"), "UTF-8"))
    return rows.select("doc_id", checks["md5_original"].alias("md5_original"), checks["md5_saved"].alias("md5_saved"))


@register(QUERIES, """
    SELECT a.doc_id, CAST(list_position(list_transform(range(1, greatest(length(a.text), length(b.text)) + 1), lambda i: coalesce(substr(a.text, i, 1), '') <> coalesce(substr(b.text, i, 1), '')), true) - 1 AS INT) AS first_mismatch
    FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE regexp_full_match(a.text, '[\\x00-\\x7F]*') AND regexp_full_match(b.text, '[\\x00-\\x7F]*') AND length(a.text) < 1500 AND length(b.text) < 1500""")
def first_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each short ASCII text differs from the next one."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("^[\\x00-\\x7F]*\\z") & (F.length("text") < 1500)).select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("raw").alias("other"))
    return docs.join(after, "doc_id").select("doc_id", B.first_difference(F.col("raw"), F.col("other")).alias("first_mismatch"))


@register(QUERIES, """
    WITH RECURSIVE p AS MATERIALIZED (
        SELECT a.doc_id, hex(encode(a.text)) AS x, hex(encode(b.text)) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
    ), s AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS lo, CAST(greatest(length(x), length(y)) // 2 + 1 AS BIGINT) AS hi FROM p WHERE x <> y
        UNION ALL
        SELECT doc_id, CASE WHEN same THEN m ELSE lo END, CASE WHEN same THEN hi ELSE m END
        FROM (SELECT s.doc_id, lo, hi, (lo + hi) // 2 AS m, left(x, 2 * ((lo + hi) // 2)) = left(y, 2 * ((lo + hi) // 2)) AS same FROM s JOIN p USING (doc_id) WHERE hi - lo > 1)
    )
    SELECT p.doc_id, CAST(max(s.lo) AS INT) AS first_mismatch FROM p LEFT JOIN s USING (doc_id) GROUP BY 1""")
def first_mismatch_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte in which each text differs from the next one: all texts, whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("raw").alias("other"))
    return docs.join(after, "doc_id").select("doc_id", B.first_difference(F.col("raw"), F.col("other")).alias("first_mismatch"))


@register(QUERIES, """
    WITH one AS (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, size, CAST(24 + coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM one""")
def repack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New offsets of sections laid out one after the other."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("bigint").alias("size"))
    return encode.repacked(one, ["l_orderkey"], "l_linenumber", "size", ORDER.header.stride)


@register(QUERIES, """
    SELECT CASE l_partkey % 4 WHEN 0 THEN 'ITM' WHEN 1 THEN 'TIS' WHEN 2 THEN 'PVRZ' ELSE 'UNKN' END AS res_type, count(*) AS n FROM lineitem GROUP BY 1""")
def type_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource type codes by name; codes without one are UNKN."""
    code = F.get(F.array(*map(F.lit, (0x03ED, 0x03EB, 0x0404, 0x7777))), (F.col("l_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "lineitem").select(type_name(code).alias("res_type")).groupBy("res_type").agg(F.count("*").alias("n"))
