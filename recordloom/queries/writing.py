"""Queries that write whole resources, choose layouts, and show resources as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import counts, decode, dump, encode, lookup, rewrite, routing
from recordloom.plans.layout import Registry, layout
from recordloom.plans.samples import ORDER
from recordloom.queries.decoding import packed_orders
from recordloom.queries.formats import LINE_HEX, NESTED, le, u
from recordloom.queries.tables import register, table

QUERIES: dict = {}

BODIES = f"SELECT l_orderkey, count(*) AS n, string_agg({LINE_HEX}, '' ORDER BY l_linenumber, l_partkey, l_suppkey, {LINE_HEX}) AS body FROM lineitem GROUP BY 1"
HEAD = f"hex(encode('ORD V1.0')) || {le('CAST(o_orderkey AS BIGINT)', 8)} || {le('CAST(coalesce(n, 0) AS BIGINT)', 4)}"


def gapped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed orders with four bytes before their lines and up to two behind them."""
    at = ORDER.header.fields[-1].offset
    behind = F.encode(F.repeat(F.lit("t"), (F.col("o_orderkey") % 3).cast("int")), "ISO-8859-1")
    head, body = F.expr(f"substring(content, 1, {at})"), F.expr(f"substring(content, {at + 5}, length(content))")
    return packed_orders(spark, sf_dir).select("o_orderkey", F.concat(head, u(28), F.lit(b"gap!"), body, behind).alias("content"))


@register(QUERIES, f"""
    WITH b AS ({BODIES}), h AS (SELECT o_orderkey, coalesce(n, 0) AS n, {HEAD} || '1C000000' AS head, coalesce(body, '') AS body, repeat('74', CAST(o_orderkey % 3 AS INT)) AS behind FROM orders LEFT JOIN b ON l_orderkey = o_orderkey)
    SELECT o_orderkey, md5(unhex(head || '67617021' || body || behind)) AS md5_original, md5(unhex(head || CASE WHEN n > 0 THEN '67617021' ELSE '' END || body || behind)) AS md5_saved FROM h""")
def write_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read and written again where they were, with what lies between and behind."""
    rows = decode.header(gapped_orders(spark, sf_dir), ORDER)
    saved = rewrite.preserved(rows, {"lines": lambda line: F.lit(True)}, ORDER, ["o_orderkey"])
    checks = encode.fidelity(F.col("content"), F.col("saved"))
    return saved.select("o_orderkey", *(checks[c].alias(c) for c in ("md5_original", "md5_saved")))


KEPT = f"SELECT l_orderkey, count(*) FILTER (l_linenumber % 3 <> 1) AS n, coalesce(string_agg({LINE_HEX}, '' ORDER BY l_linenumber, l_partkey, l_suppkey, {LINE_HEX}) FILTER (l_linenumber % 3 <> 1), '') AS body FROM lineitem GROUP BY 1"


@register(QUERIES, f"""
    WITH b AS ({KEPT}), h AS (SELECT o_orderkey, {HEAD} || CASE WHEN n > 0 THEN '18000000' ELSE '00000000' END || coalesce(body, '') AS x FROM orders LEFT JOIN b ON l_orderkey = o_orderkey)
    SELECT o_orderkey, md5(unhex(x)) AS md5_saved, CAST(length(x) // 2 AS INT) AS size FROM h""")
def write_repacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders packed anew after some of their lines have gone: counts and offsets follow."""
    rows = decode.header(gapped_orders(spark, sf_dir), ORDER)
    saved = rewrite.repacked(rows, {"lines": lambda line: line["number"] % 3 != 1}, ORDER, ["o_orderkey"])
    return saved.select("o_orderkey", F.md5("saved").alias("md5_saved"), F.length("saved").alias("size"))


ITEM_HEX = f"{le('CAST(l_linenumber AS BIGINT)', 2)} || {le('CAST(l_quantity AS BIGINT)', 2)}"


@register(QUERIES, f"""
    WITH b AS (SELECT l_orderkey, count(*) FILTER (l_linenumber % 2 = 0) AS n, coalesce(string_agg({ITEM_HEX}, '' ORDER BY l_linenumber, l_partkey, l_suppkey, {ITEM_HEX}) FILTER (l_linenumber % 2 = 0), '') AS body FROM lineitem GROUP BY 1)
    SELECT l_orderkey, md5(unhex({le('CAST(n AS BIGINT)', 4)} || '08000000' || '0000000001000000' || CASE WHEN n > 0 THEN '18000000' ELSE '1C000000' END || '02000000' || body)) AS md5_saved FROM b""")
def write_repointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section whose place stands in another section's entry, packed anew: the entry follows."""
    item = F.concat(u(F.col("l_linenumber"), 2), u(F.col("l_quantity").cast("bigint"), 2))
    bodies = encode.joined(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], item)
    content = F.concat(u(F.col("n")), u(8), u(0), u(1), u(28), u(2), F.lit(b"gap!"), "body")
    rows = decode.header(bodies.select("l_orderkey", content.alias("content")), NESTED)
    decoded = {s: decode.entries(rows, NESTED, s, ["l_orderkey"]) for s in ("tables", "items")}
    decoded["items"] = decoded["items"].where("number % 2 = 0")
    return rewrite.repacked(rows, decoded, NESTED, ["l_orderkey"]).select("l_orderkey", F.md5("saved").alias("md5_saved"))


@register(QUERIES, """
    SELECT p_partkey, policy, NOT hit OR policy = 'warn' AS allowed, CASE WHEN hit THEN CAST(p_partkey % 3 AS VARCHAR) || ' gaps with other bytes than zero would be lost' END AS message
    FROM (SELECT *, policy <> 'allow' AND p_size % 2 = 0 AND p_partkey % 3 > 0 AS hit FROM part, (VALUES ('allow'), ('warn'), ('fail_nonzero')) v(policy))""")
def write_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which changed resources may be written under each policy for gaps that aren't zero."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("modified"), (F.col("p_partkey") % 3).alias("gaps"))
    verdicts = F.array(*(F.struct(F.lit(p).alias("policy"), rewrite.gate(p, F.col("modified"), F.col("gaps")).alias("verdict")) for p in rewrite.POLICIES))
    return part.select("p_partkey", F.explode(verdicts).alias("v")).select("p_partkey", "v.policy", "v.verdict.allowed", "v.verdict.message")


def older(name: str, game: str) -> dict:
    """A short layout of our own in the place of an older one."""
    fields = [{"name": "signature", "type": "char_array", "size": 4}, {"name": "version", "type": "char_array", "size": 4}, {"name": "offset_to_item_slots", "type": "dword"}]
    return {"name": name, "games": [game], "sections": {"header": {"fields": fields}, "item_slots": {"offset_field": "offset_to_item_slots", "fields": [{"name": "slots", "type": "word_array", "count": 10}]}}}


OLDER = Registry(layout(older(n, g)) for n, g in (("CRE", "PST"), ("CRE", "IWD"), ("ARE", "PST")))


@register(QUERIES, """
    WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_size AS s FROM part)
    SELECT p_partkey, CASE k WHEN 3 THEN CASE WHEN s % 7 = 0 THEN NULL WHEN s % 2 = 0 THEN 'BAM_V2' ELSE 'BAM' END WHEN 2 THEN 'ARE' ELSE 'CRE' END AS name,
        CASE k WHEN 0 THEN CASE WHEN s % 2 = 1 AND s % 10 > 0 AND s % 10 * 5 + 20 <= 12 + s THEN 'PST' ELSE 'PSTEE' END WHEN 1 THEN CASE WHEN s % 2 = 1 THEN 'IWD' ELSE 'IWD2' END
            WHEN 2 THEN CASE WHEN (s % 3 = 0 AND s * 10 <= 208 AND s % 5 > 0) OR (s % 2 = 0 AND s % 4 > 0) THEN 'PST' ELSE 'PSTEE' END ELSE CASE WHEN s % 7 > 0 THEN 'EE' END END AS game FROM p""")
def route_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layouts of creatures, areas and sprites by version, pointers and marks."""
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("bigint")
    game = F.when(k == 1, "IWD2").when(k == 3, "EE").otherwise("PSTEE")
    restype = F.when(k == 2, "ARE").when(k < 2, "CRE").when(s % 7 == 0, "PVRZ").otherwise("BAM")
    odd = s % 2 == 1
    stated = F.when(k == 0, F.when(odd, F.lit(b"V1.1")).otherwise(F.lit(b"V1.0"))).when(k == 1, F.when(odd, F.lit(b"V9.1")).otherwise(F.lit(b"V2.2"))).when(k == 2, F.lit(b"V1.0")).otherwise(F.when(odd, F.lit(b"V1  ")).otherwise(F.lit(b"V2  ")))
    area = F.concat(F.lit(bytes(routing.ACTORS - 8)), u(s % 2), F.lit(bytes(routing.OLD_ACTORS - routing.ACTORS - 4)), u(s % 4), F.lit(bytes(routing.MARK - routing.OLD_ACTORS - 4)), u(F.when(s % 3 == 0, routing.MARKED).otherwise(0)), u(s * 10), u(F.when(s % 5 == 0, 2 * routing.TOO_MANY).otherwise(1)))
    content = F.concat(F.lit(b"SIG "), stated, F.when(k == 2, area).otherwise(F.concat(u(s % 10 * 5), rewrite.zeros(s))))
    rows = table(spark, sf_dir, "part").select("p_partkey", restype.alias("restype"), game.alias("game"), content.alias("content"))
    found = rows.select("p_partkey", routing.routed(F.col("restype"), F.col("game"), F.col("content"), OLDER).alias("r"))
    return found.select("p_partkey", "r.name", "r.game")


CENT = "CAST(CAST(round({} * 100) AS BIGINT) AS VARCHAR)"


@register(QUERIES, f"""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {LINE_HEX} AS x, '{{"quantity":' || {CENT.format("l_quantity")} || ',"price":' || {CENT.format("l_extendedprice")} || ',"discount":' || {CENT.format("l_discount")} || ',"return_flag":"' || l_returnflag || '","number":' || CAST(l_linenumber AS VARCHAR) || '}}' AS j FROM lineitem),
    b AS (SELECT l_orderkey, count(*) AS n, string_agg(j, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, x) AS lines FROM l GROUP BY 1)
    SELECT o_orderkey, '{{"header":[{{"signature":"ORD ","version":"V1.0","key":' || CAST(o_orderkey AS VARCHAR) || ',"line_count":' || CAST(coalesce(n, 0) AS VARCHAR) || ',"line_offset":28}}],"lines":[' || coalesce(lines, '') || ']'
        || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ',"_unmapped_trailing_data":{{"size_bytes":1,"data_hex":"74"}}' ELSE ',"_unmapped_trailing_data":{{"size_bytes":2,"data_hex":"74 74"}}' END || '}}' AS json FROM orders LEFT JOIN b ON l_orderkey = o_orderkey""")
def json_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON, bytes behind what the layout reads included."""
    rows = decode.header(gapped_orders(spark, sf_dir), ORDER)
    return dump.dumped(rows, ORDER, ["o_orderkey"], {"lines": decode.entries(rows, ORDER, "lines", ["o_orderkey"])})


@register(QUERIES, """
    WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS many, 100 + 2 * (l_suppkey % 9) - 4 * CAST(l_partkey % 5 = 0 AS INT) * 10 + CAST(l_partkey % 7 = 0 AS INT) AS at, l_partkey % 11 AS p, l_suppkey % 3 AS c, CASE WHEN l_partkey % 2 = 0 THEN 65535 ELSE l_suppkey % 20 END AS s,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem),
    o AS (SELECT *, coalesce(sum(many) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM l),
    n AS (SELECT o.l_orderkey, max(greatest((o.at - 100) // 2 + t.p + t.c, CASE WHEN t.s <> 65535 THEN (o.at - 100) // 2 + t.s + 1 END)) FILTER (o.at >= 100 AND (o.at - 100) % 2 = 0) AS most
        FROM o JOIN l t ON t.l_orderkey = o.l_orderkey AND t.i >= o.cursor AND t.i < o.cursor + o.many GROUP BY 1)
    SELECT l_orderkey, CAST(greatest(sum(many), least(coalesce(any_value(most), 0), l_orderkey % 40)) AS BIGINT) AS n FROM l LEFT JOIN n USING (l_orderkey) GROUP BY l_orderkey""")
def count_tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a tile lookup by what overlays' maps need, lines standing in for both."""
    at = 100 + 2 * (F.col("l_suppkey") % 9) - F.when(F.col("l_partkey") % 5 == 0, 40).otherwise(0) + F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0)
    second = F.when(F.col("l_partkey") % 2 == 0, counts.NO_TILE).otherwise(F.col("l_suppkey") % 20)
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber") % 3).alias("tile_count"), at.alias("lookup_offset"), (F.col("l_partkey") % 11).alias("first"), (F.col("l_suppkey") % 3).alias("many"), second.alias("second"))
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum(F.col("l_linenumber") % 3).alias("total"))
    needed = counts.tilemap_extent(F.col("rows"), F.col("rows"), F.lit(100), 2)
    return held.select("l_orderkey", counts.tile_lookup(F.col("total"), F.col("l_orderkey") % 40, needed).alias("n"))


@register(QUERIES, """
    SELECT s_suppkey, s_nationkey AS identified_name, s_suppkey % 30 AS strref, a.n_name AS identified_name_text, b.n_name AS strref_text
    FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_nationkey AND s_nationkey > 0 LEFT JOIN nation b ON b.n_nationkey = s_suppkey % 30 AND s_suppkey % 30 > 0""")
def expand_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts beside the fields whose names say that they hold the number of one."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("identified_name"), (F.col("s_suppkey") % 30).alias("strref"))
    return lookup.with_texts(rows, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("strref"), F.col("n_name").alias("text")))
