"""Queries over indexes: text search and the two dialects of the filter language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import search
from recordloom.queries.tables import orders_with_lines, register, table

QUERIES: dict = {}

LINES = "FROM lineitem WHERE l_orderkey = o_orderkey"


def resource_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as one index: (resref, restype, source, display_name)."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    entry = lambda key, kind, source, name: (F.concat(F.lit(kind[0]), F.col(key).cast("string")).alias("resref"), F.lit(kind).alias("restype"), F.col(source).alias("source"), F.col(name).alias("display_name"))
    return part.select(*entry("p_partkey", "PART", "p_brand", "p_name")).union(supplier.select(*entry("s_suppkey", "SUPP", "s_name", "s_name")))


INDEX_SQL = """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS resref, 'PART' AS restype, p_brand AS source, p_name AS display_name FROM part
    UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'SUPP', s_name, s_name FROM supplier"""


@register(QUERIES, INDEX_SQL)
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of parts and suppliers."""
    return resource_index(spark, sf_dir)


@register(QUERIES, f"SELECT * FROM ({INDEX_SQL}) WHERE contains(lower(resref), 'p1') OR contains(lower(display_name), 'p1')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name or display name that has the query in it."""
    return search.text_search(resource_index(spark, sf_dir), "P1")


@register(QUERIES, f"SELECT * FROM ({INDEX_SQL}) WHERE restype = 'SUPP' AND (contains(lower(resref), '0') OR contains(lower(display_name), '0'))")
def text_search_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within a type."""
    return search.text_search(resource_index(spark, sf_dir), "0", "SUPP")


@register(QUERIES, f"SELECT DISTINCT resref FROM ({INDEX_SQL}) WHERE resref LIKE 'P10%' ORDER BY 1 LIMIT 50")
def prefix_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first names with a prefix, as completion offers them."""
    return search.completed(resource_index(spark, sf_dir), "p10")


@register(QUERIES, f"""
    WITH f AS (SELECT resref, restype FROM ({INDEX_SQL}) WHERE restype = 'PART')
    SELECT resref, restype, (SELECT count(*) FROM f) - 50 AS more FROM f ORDER BY resref LIMIT 50""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty results, and how many more there are."""
    found = resource_index(spark, sf_dir).where("restype = 'PART'").select("resref", "restype")
    return search.page(found, ["resref"])


def matched(spark: SparkSession, sf_dir: str, text: str, strict: bool = False) -> DataFrame:
    return search.where(orders_with_lines(spark, sf_dir), text, "ORDER", strict).select("o_orderkey")


@register(QUERIES, "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f'")
def where_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on a header field, in any letter case."""
    return matched(spark, sf_dir, "header.status = F")


@register(QUERIES, f"SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 {LINES} AND lower(l_returnflag) <> 'n')")
def where_ne_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inequality holds if any value differs."""
    return matched(spark, sf_dir, "lines.flag != N")


@register(QUERIES, "SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000 AND o_totalprice < 250000.5")
def where_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric bounds joined by and."""
    return matched(spark, sf_dir, "header.price >= 150000 and header.price < 250000.5")


@register(QUERIES, "SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urg')")
def where_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of the display name."""
    return matched(spark, sf_dir, "name ~ 'URG'")


@register(QUERIES, f"SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 {LINES} AND l_quantity > 49)")
def where_list_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path through a list holds if any entry meets it."""
    return matched(spark, sf_dir, "lines.l_quantity > 49")


@register(QUERIES, f"""
    SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 {LINES}) AND NOT EXISTS (SELECT 1 {LINES} AND lower(l_returnflag) = 'n') AND o_totalprice > 100000""")
def where_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict dialect: all values must differ."""
    return matched(spark, sf_dir, "lines.flag != N and value > 100000", strict=True)


@register(QUERIES, "SELECT o_orderkey FROM orders WHERE false")
def where_missing_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that leads nowhere meets no clause, != included."""
    return matched(spark, sf_dir, "header.nothing != 1")
