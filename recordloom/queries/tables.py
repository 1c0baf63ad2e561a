"""The driver tables, and registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(queries: dict[str, tuple[Query, str | None]], sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        queries[f.__name__] = (f, sql)
        return f

    return keep


#: DuckDB: byte k of the hex text h, as a number.
def sql_byte(h: str, k: int) -> str:
    digit = lambda i: f"(instr('0123456789ABCDEF', substr({h}, {i}, 1)) - 1)"
    return f"({digit(2 * k + 1)} * 16 + {digit(2 * k + 2)})"


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested index rows: resref, restype, display_name, header, lines."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    line = F.struct(F.col("l_linenumber").cast("bigint").alias("number"), "l_quantity", "l_extendedprice", F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))
    nested = lines.select("l_orderkey", line.alias("line")).groupBy("l_orderkey").agg(F.collect_list("line").alias("lines"))
    rows = orders.join(nested, orders.o_orderkey == nested.l_orderkey, "left")
    header = F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    return rows.select(
        "o_orderkey", F.concat(F.lit("ORD"), F.col("o_orderkey").cast("string")).alias("resref"), F.lit("ORDER").alias("restype"),
        F.col("o_orderpriority").alias("display_name"), F.array(header).alias("header"), F.coalesce("lines", F.expr("array()").cast(nested.schema["lines"].dataType)).alias("lines"),
    )
