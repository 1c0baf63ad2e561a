"""The resource index: built as a table, searched by text and by a small filter language."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 50
CLAUSE = re.compile(r"^([A-Za-z0-9_.]+)\s*(!=|<=|>=|=|<|>|~)\s*(.+)$", re.S)
#: Names of the strict dialect that stand for fields.
ALIASES = {"name": "display_name", "value": "header.price", "weight": "header.weight"}
PSEUDO = {"resref": "resref", "type": "restype", "name": "display_name"}


@dataclass(frozen=True)
class Clause:
    path: tuple[str, ...]
    op: str
    value: str


def parsed(text: str, strict: bool = False) -> tuple[list[Clause], list[str]]:
    """Clauses joined by "and", and those that can't be read (an error if strict)."""
    good, bad = [], []
    for part in re.split(r"\s+and\s+", text.strip(), flags=re.I):
        m = CLAUSE.match(part.strip())
        if not m:
            if strict:
                raise ValueError(f"not a clause: {part!r}")
            bad.append(part)
            continue
        value = m[3].strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        good.append(Clause(tuple(m[1].split(".")), m[2], value))
    return good, bad


def values_at(column: Column, kind: T.DataType, path: tuple[str, ...]) -> tuple[Column, T.DataType] | None:
    """An array of what a path reaches, lists spread out, with the element's type."""
    if isinstance(kind, T.ArrayType):
        if not path and not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return column, kind.elementType
        if path and path[0].isdigit():
            return values_at(F.get(column, F.lit(int(path[0]))), kind.elementType, path[1:])
        inner = values_at(F.lit(None), kind.elementType, path)
        if inner is None:
            return None
        return F.flatten(F.transform(column, lambda x: values_at(x, kind.elementType, path)[0])), inner[1]
    if isinstance(kind, T.StructType):
        if not path or path[0] not in kind.names:
            return None
        return values_at(column[path[0]], kind[path[0]].dataType, path[1:])
    return (F.array(column), kind) if not path else None


def compared(clause: Clause, values: Column, kind: T.DataType, strict: bool) -> Column:
    """Whether any value (all, for != of the strict dialect) meets a clause; no values: false."""
    wanted = clause.value.lower()
    text = lambda v: F.coalesce(F.lower(v.cast("string")), F.lit("none"))
    numeric = isinstance(kind, (T.NumericType, T.BooleanType)) or strict
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # a fraction is text as Python writes it; only that text of a number equals it
        number = float(wanted) if re.fullmatch(r"-?[0-9.]+(e[+-][0-9]+)?", wanted) and wanted.count(".") < 2 and wanted.strip("-.") else None
        exact = number is not None and repr(number) == wanted
        plain = text
        text = lambda v: F.when(v == number, F.lit(wanted)).otherwise(F.lit("")) if exact else F.when(v.isNull() | F.isnan(v), plain(v)).otherwise(F.lit(""))
        if clause.op == "~":
            text = plain
    if clause.op == "=":
        return F.exists(values, lambda v: text(v) == wanted)
    if clause.op == "!=":
        return F.size(values).__gt__(0) & F.forall(values, lambda v: text(v) != wanted) if strict else F.exists(values, lambda v: text(v) != wanted)
    if clause.op == "~":
        return F.exists(values, lambda v: text(v).contains(wanted))
    try:
        limit = float(clause.value)
    except ValueError:
        if strict:
            raise ValueError(f"{clause.op} needs a number: {clause.value!r}") from None
        return F.lit(False)
    if not numeric:
        return F.lit(False)
    ops = {"<": lambda v: v < limit, ">": lambda v: v > limit, "<=": lambda v: v <= limit, ">=": lambda v: v >= limit}
    return F.exists(values, lambda v: F.coalesce(ops[clause.op](v.try_cast("double")), F.lit(False)))


def where(index: DataFrame, text: str, restype: str | None = None, strict: bool = False) -> DataFrame:
    """Rows of an index that meet every clause.

    The loose dialect leaves out clauses it can't read; != holds if any value differs. In
    the strict one, != needs all values to differ, and text that looks like a number
    compares as one.
    """
    conditions = [F.col("restype") == restype] if restype else []
    for clause in parsed(text, strict)[0]:
        path = clause.path
        if strict and ".".join(path) in ALIASES and path[0] not in index.columns:
            path = tuple(ALIASES[".".join(path)].split("."))
        name = PSEUDO.get(path[0], path[0]) if len(path) == 1 else path[0]
        found = values_at(F.col(name), index.schema[name].dataType, path[1:]) if name in index.columns else None
        conditions.append(F.coalesce(compared(clause, *found, strict), F.lit(False)) if found else F.lit(False))
    return index.where(reduce(lambda a, b: a & b, conditions)) if conditions else index


def text_search(index: DataFrame, query: str, restype: str | None = None) -> DataFrame:
    """Rows whose name or display name has the query in it, in any letter case."""
    q = query.lower()
    hit = F.coalesce(F.lower("resref").contains(q), F.lit(False)) | F.coalesce(F.lower("display_name").contains(q), F.lit(False))
    return index.where(hit if restype is None else hit & (F.col("restype") == restype))


def completed(index: DataFrame, prefix: str, limit: int = LIMIT) -> DataFrame:
    """The first names with a prefix."""
    return index.where(F.col("resref").startswith(prefix.upper())).select("resref").distinct().orderBy("resref").limit(limit)


def page(found: DataFrame, order: list[str], limit: int = LIMIT) -> DataFrame:
    """The first results in order and, in each row, how many more there are."""
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(*order).limit(limit).join(total).withColumn("more", F.greatest(F.col("total") - limit, F.lit(0))).drop("total")


def picked(found: DataFrame, seed: int) -> DataFrame:
    """One row at random, the same for a seed."""
    return found.orderBy(F.rand(seed)).limit(1)


def ambiguous(index: DataFrame) -> DataFrame:
    """Names that stand for resources of several types."""
    return index.groupBy("resref").agg(F.array_sort(F.collect_set("restype")).alias("types")).where(F.size("types") > 1)


def opened(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (request: NAME or NAME.TYPE, any letter case) with status and types: found when
    one type fits, ambiguous when several do, missing when none does."""
    name, kind = F.upper(F.split_part("request", F.lit("."), F.lit(1))), F.upper(F.split_part("request", F.lit("."), F.lit(2)))
    asked = wanted.select("request", name.alias("name_"), kind.alias("kind_")).distinct()
    known = index.select(F.upper("resref").alias("name_"), F.upper("restype").alias("restype")).distinct()
    both = asked.join(known, "name_", "left").where((F.col("kind_") == "") | F.col("restype").isNull() | (F.col("restype") == F.col("kind_")))
    types = both.groupBy("request").agg(F.array_sort(F.collect_set("restype")).alias("types"))
    n = F.coalesce(F.size("types"), F.lit(0))
    status = F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous")
    return asked.select("request").join(types, "request", "left").select("request", status.alias("status"), F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def written(index: DataFrame, path: str, fingerprint: str) -> None:
    """Saves an index by game and type, under the fingerprint of what it was made from."""
    index.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").partitionBy("fingerprint", "game", "restype").parquet(path)


def cached(spark, path: str, fingerprint: str) -> DataFrame | None:
    """A saved index, or none if it was made from something else."""
    try:
        found = spark.read.parquet(path).where(F.col("fingerprint") == fingerprint)
    except Exception as e:  # no such path
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return None if found.isEmpty() else found.drop("fingerprint")
