"""Queries that relate resources: lookups, catalogs, references, change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import binary as B
from recordloom.operators import catalog, graph, lookup
from recordloom.queries.tables import register, table
from recordloom.streaming import changes

QUERIES: dict = {}


@register(QUERIES, """
    SELECT n_nationkey, coalesce(r_name, CAST(n_regionkey AS VARCHAR)) AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey + 1 AND n_regionkey <> 2""")
def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by symbol list, with an offset and a value to skip; without a symbol, the code."""
    nation = table(spark, sf_dir, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("bigint"))
    out = lookup.resolved(nation, "n_regionkey", table(spark, sf_dir, "region"), "r_regionkey", "r_name", "region", offset=1, skip=(2,))
    return out.select("n_nationkey", "region")


@register(QUERIES, """
    SELECT n_nationkey, coalesce('(' || CAST(n_regionkey AS VARCHAR) || ') ' || r_name, CAST(n_regionkey AS VARCHAR)) AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey""")
def lookup_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes shown with their symbols."""
    nation = table(spark, sf_dir, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("bigint"))
    return lookup.resolved(nation, "n_regionkey", table(spark, sf_dir, "region"), "r_regionkey", "r_name", "region", both=True).select("n_nationkey", "region")


@register(QUERIES, """
    WITH r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region)
    SELECT CAST(i AS INT) AS row_idx, CAST(r_regionkey AS VARCHAR) AS row_label, 'NAME' AS "column", replace(r_name, ' ', '_') AS cell FROM r
    UNION ALL SELECT CAST(i AS INT), CAST(r_regionkey AS VARCHAR), 'RANK', CASE WHEN r_regionkey % 2 = 0 THEN CAST(r_regionkey * 10 AS VARCHAR) ELSE 'NONE' END FROM r""")
def lookup_2da(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-dimensional table written as text and parsed; short rows get the default."""
    region = table(spark, sf_dir, "region")
    row = F.concat_ws(" ", F.col("r_regionkey").cast("string"), F.replace("r_name", F.lit(" "), F.lit("_")), F.when(F.col("r_regionkey") % 2 == 0, (F.col("r_regionkey") * 10).cast("string")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", row.alias("row")))), lambda x: x["row"])
    files = region.agg(F.concat(F.lit("2DA V1.0\nNONE\nNAME RANK\n"), F.concat_ws("\n", body)).alias("text")).withColumn("file", F.lit("REGION"))
    return lookup.cells(files, ["file"]).drop("file")


@register(QUERIES, """
    SELECT c_custkey, CASE WHEN n_name IS NULL THEN CAST(c_nationkey AS VARCHAR) ELSE '(' || CAST(c_nationkey AS VARCHAR) || ') ' || n_name END AS shown
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_nationkey <> 3""")
def strref_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String references with their text, the number alone without one."""
    texts = table(spark, sf_dir, "nation").where("n_nationkey <> 3").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "customer").join(texts, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", B.reference_shown(F.col("c_nationkey"), F.col("n_name")).alias("shown"))


@register(QUERIES, """
    WITH s AS (SELECT l_orderkey, l_linenumber AS slot, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, string_agg(CASE slot WHEN 1 THEN 'helmet' WHEN 2 THEN 'armor' ELSE 'slot_' || CAST(slot AS VARCHAR) END || '=' || CAST(q AS VARCHAR), ',' ORDER BY slot) AS slots
    FROM s WHERE q >= 10 GROUP BY 1""")
def sparse_slot_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by label, empty ones left out."""
    slots = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("slot")).agg(F.max("l_quantity").cast("bigint").alias("q"))
    found = lookup.labelled_slots(slots, ["l_orderkey"], "slot", F.col("q").cast("string"), {1: "helmet", 2: "armor"}, F.col("q") < 10)
    pairs = F.transform(F.map_entries("slots"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("l_orderkey", F.concat_ws(",", pairs).alias("slots"))


@register(QUERIES, "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2")
def catalog_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalog has by type and place."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@register(QUERIES, """
    SELECT resref, lang, doc_id, source FROM (SELECT substr(text, 1, 8) AS resref, lang, doc_id, source,
        row_number() OVER (PARTITION BY substr(text, 1, 8), lang ORDER BY CASE source WHEN 'src0' THEN 0 ELSE 1 END, doc_id) AS r FROM documents) WHERE r = 1""")
def override_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of copies with one name and type, the override's, else the first."""
    copies = table(spark, sf_dir, "documents").select(F.substring("text", 1, 8).alias("resref"), "lang", "doc_id", "source")
    return catalog.preferred(copies, ["resref", "lang"], [F.when(F.col("source") == "src0", 0).otherwise(1), F.col("doc_id")]).select("resref", "lang", "doc_id", "source")


@register(QUERIES, """
    SELECT l_suppkey AS supplier, count(DISTINCT o_custkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1""")
def shared_asset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops, customer to order to supplier: suppliers that several customers share."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    links = graph.two_hops(orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), lines.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")))
    return links.groupBy(F.col("dst").alias("supplier")).agg(F.count("*").alias("n")).where("n > 1")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to nation, nation to region, region to a hub, and the hub back to a nation."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    a = supplier.select(text("S", "s_suppkey").alias("src"), text("N", "s_nationkey").alias("dst"))
    b = nation.select(text("N", "n_nationkey").alias("src"), text("R", "n_regionkey").alias("dst"))
    c = nation.select(text("R", "n_regionkey").alias("src"), F.lit("HUB").alias("dst")).distinct()
    return a.union(b).union(c).union(spark.sql("SELECT 'HUB' AS src, 'N0' AS dst"))


REFERENCES_SQL = """SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS src, 'N' || CAST(s_nationkey AS VARCHAR) AS dst FROM supplier
    UNION SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR) FROM nation
    UNION SELECT 'R' || CAST(n_regionkey AS VARCHAR), 'HUB' FROM nation UNION SELECT 'HUB', 'N0'"""


@register(QUERIES, f"SELECT dst, count(DISTINCT src) AS n, string_agg(DISTINCT src, ',' ORDER BY src) AS users FROM ({REFERENCES_SQL}) GROUP BY 1")
def used_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who refers to each resource."""
    return graph.used_by(references(spark, sf_dir)).select("dst", "n", F.concat_ws(",", "users").alias("users"))


@register(QUERIES, f"""
    WITH RECURSIVE e AS ({REFERENCES_SQL}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst) SELECT src, dst FROM c""")
def dep_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything reachable by references, cycles included."""
    return graph.closure(references(spark, sf_dir)).select("src", "dst")


@register(QUERIES, """
    SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to what is not there."""
    links = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    return graph.dangling(links, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node"))).select("c_custkey")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes: a user's resource, the event type as field, values as text."""
    events = table(spark, sf_dir, "events")
    cents = lambda c: F.floor(c).cast("string")
    return events.select(F.col("user_id").alias("resource"), F.col("event_type").alias("field"), cents(F.col("value") / 2).alias("old"), cents(F.col("value")).alias("new"), F.col("event_id").alias("batch_id"), "ts")


LOG_SQL = "SELECT user_id AS resource, event_type AS field, CAST(CAST(floor(value / 2) AS BIGINT) AS VARCHAR) AS old, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS new, event_id AS batch_id, ts FROM events"


@register(QUERIES, f"""
    WITH l AS (SELECT * FROM ({LOG_SQL}) WHERE old IS DISTINCT FROM new)
    SELECT resource, field, new AS value, n AS changes FROM (SELECT *, count(*) OVER (PARTITION BY resource, field) AS n, row_number() OVER (PARTITION BY resource, field ORDER BY ts DESC, batch_id DESC) AS r FROM l) WHERE r = 1""")
def change_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all real changes."""
    return changes.latest(changes.effective(change_log(spark, sf_dir))).select("resource", "field", "value", "changes")


@register(QUERIES, f"""
    WITH l AS ({LOG_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY resource, field ORDER BY ts DESC, batch_id DESC) AS r FROM l WHERE batch_id % 3 <> 0),
    o AS (SELECT resource, field, old, row_number() OVER (PARTITION BY resource, field ORDER BY ts, batch_id) AS r FROM l)
    SELECT o.resource, o.field, CASE WHEN k.resource IS NULL THEN o.old ELSE k.new END AS value FROM o LEFT JOIN (SELECT * FROM k WHERE r = 1) k ON k.resource = o.resource AND k.field = o.field WHERE o.r = 1""")
def change_log_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state without the changes of every third batch."""
    log = change_log(spark, sf_dir)
    return changes.undone(log, log.where("batch_id % 3 = 0"))
