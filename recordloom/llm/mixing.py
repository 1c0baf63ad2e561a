"""Operator 2: mixing sources to target weights (DataFrame functions only).

Leaves of the tree are domain, language, source. A token budget goes down from the
root: a node's budget is divided among its children by weight; a child gets no more
than its subtree has (its tokens times the epochs allowed). What a child cannot take
goes to its siblings, by weight again, until they are full; only a node whose whole
subtree is full passes a shortage up to its own siblings. This is water filling, in
whole numbers, at each node.

A leaf's quota is met by whole seeded epochs over its documents and a prefix, in
tokens, of one more epoch's order. The order is by a hash of seed, epoch and doc_id.
Running sums go over hash ranges first and then within a range, so that a leaf with a
third of all documents is not sorted in one task.

Tokens are words here. Defined results: null text has no tokens; null language or
source is the same leaf as the empty one; repeated rows are chosen one by one; rows
without doc_id have one place in a leaf's order, as if their id were empty; an empty table gives no rows; extra columns are ignored by chosen() and kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import n_words, written

#: Weights that differ from 1, by level of the tree (whole numbers); a
#: caller may give others.
DOMAINS = {"d0": 4, "d1": 3, "d2": 2}
LANGUAGES = {"en": 4, "de": 2, "fr": 2}
SOURCES: dict[str, int] = {}
Weights = tuple[dict[str, int], dict[str, int], dict[str, int]]
WEIGHTS: Weights = (DOMAINS, LANGUAGES, SOURCES)
#: The budget, in percent of the tokens there are, and the epochs that a leaf may give.
PERCENT = 60
EPOCHS = 2
SEED = 11
#: Hexadecimal digits of the hash that name a range.
RANGE_DIGITS = 3
LEAF = ["domain", "m_lang", "m_source"]


def domain(source: Column) -> Column:
    """The domain of a source: its number modulo 4, 0 without a number."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.concat(F.lit("d"), (number % 4).cast("string"))


def weight(key: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, w in weights.items():
        out = F.when(key == k, w).otherwise(out)
    return out.cast("long")


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def filled(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """children with what each gets of its parent's budget; columns weight, cap, budget."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), key)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = children.withColumn("full", big(F.col("budget") - before) * big("weight") >= big("cap") * big(weights))
    whole = Window.partitionBy(*parent)
    rows = rows.withColumns({"taken": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole), "free": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)})
    share = F.expr("cast((cast(budget - taken as decimal(19,0)) * cast(weight as decimal(19,0))) div cast(greatest(free, 1) as decimal(19,0)) as bigint)")
    return rows.withColumn("gets", F.when(F.col("full"), F.col("cap")).otherwise(share)).drop("full", "taken", "free", "weight", "cap", "budget")


def quotas(leaves: DataFrame, percent: int, epochs: int, weights: Weights = WEIGHTS) -> DataFrame:
    """Leaves (domain, m_lang, m_source, tokens) with quota, whole epochs and rest."""
    cap = (F.col("tokens") * epochs).alias("cap")
    leaves = leaves.select(*LEAF, "tokens", cap)
    root = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * percent / 100).cast("long").alias("budget")).withColumn("root", F.lit(0))
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("root", F.lit(0)).join(root, "root")
    top = filled(top.withColumn("weight", weight(F.col("domain"), weights[0])), ["root"], "domain").select("domain", F.col("gets").alias("budget"))
    middle = leaves.groupBy("domain", "m_lang").agg(F.sum("cap").alias("cap")).join(top, "domain")
    middle = filled(middle.withColumn("weight", weight(F.col("m_lang"), weights[1])), ["domain"], "m_lang").select("domain", "m_lang", F.col("gets").alias("budget"))
    below = filled(leaves.join(middle, ["domain", "m_lang"]).withColumn("weight", weight(F.col("m_source"), weights[2])), ["domain", "m_lang"], "m_source")
    some = F.greatest("tokens", F.lit(1))
    return below.select(*LEAF, F.col("gets").alias("quota"), F.expr("gets div greatest(tokens, 1)").alias("whole"), (F.col("gets") % some).alias("rest"))


def leafed(docs: DataFrame) -> DataFrame:
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    return docs.withColumns({"domain": domain(source), "m_lang": lang, "m_source": source})


def place(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def chosen(docs: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: Weights = WEIGHTS) -> DataFrame:
    """(doc_id, domain, m_lang, m_source, n_tokens, whole, place, copies, taken_tokens) of the documents taken."""
    rows = written(leafed(docs.select("doc_id", "lang", "source", n_words(F.col("text")).alias("n_tokens"))).drop("lang", "source"))
    leaves = written(quotas(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), percent, epochs, weights))
    rows = rows.join(leaves, LEAF).withColumn("place", place(F.col("whole"), seed)).withColumn("range", F.substring("place", 1, RANGE_DIGITS))
    ranges = rows.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("in_range"))
    before = F.sum("in_range").over(Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = written(ranges.select(*LEAF, "range", F.coalesce(before, F.lit(0)).alias("before")))
    inner = Window.partitionBy(*LEAF, "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ranges, [*LEAF, "range"]).withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    part = F.col("start") < F.col("rest")
    rows = rows.withColumns(
        {
            "copies": F.col("whole") + F.when(part, 1).otherwise(0),
            "taken_tokens": F.col("whole") * F.col("n_tokens") + F.when(part, F.least("n_tokens", F.col("rest") - F.col("start"))).otherwise(0),
        }
    )
    return rows.where("copies > 0").select("doc_id", *LEAF, "n_tokens", "whole", "place", "copies", "taken_tokens")


def mixed(docs: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: Weights = WEIGHTS) -> DataFrame:
    """The documents taken, whole, as often as they are taken; the columns of docs.

    The document at a leaf's cut is kept whole. Texts are not shuffled unless the table
    of leaves is too large for Spark to broadcast it.
    """
    picked = chosen(docs, percent, epochs, seed, weights)
    last = F.max(F.when(F.col("copies") > F.col("whole"), F.struct("place", "doc_id"))).alias("last")
    ends = written(picked.groupBy(*LEAF).agg(F.first("whole").alias("whole"), last))
    kept = docs.select(F.struct("*").alias("doc"), "doc_id", "lang", "source")
    kept = leafed(kept).drop("lang", "source").join(ends, LEAF)
    here = F.struct(place(F.col("whole"), seed).alias("place"), "doc_id")
    copies = F.col("whole") + F.when(F.col("last").isNotNull() & (here <= F.col("last")), 1).otherwise(0)
    kept = kept.withColumn("copies", copies.cast("int")).where("copies > 0")
    return kept.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def oracle(percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: Weights = WEIGHTS) -> str:
    """chosen() over the table documents, as DuckDB SQL."""
    case = lambda c, w: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END" if w else "1"

    def fill(source: str, parent: str, key: str) -> str:
        order = f"PARTITION BY {parent} ORDER BY cap / weight, {key}"
        return f"""SELECT *, CASE WHEN full_ THEN cap ELSE CAST(CAST(budget - taken AS HUGEINT) * weight // greatest(free, 1) AS BIGINT) END AS gets FROM (
            SELECT *, SUM(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS taken, SUM(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS free FROM (
            SELECT *, CAST(budget - coalesce(SUM(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) * weight
                >= CAST(cap AS HUGEINT) * SUM(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_ FROM ({source})))"""

    return f"""
    WITH rows_ AS (
        SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
            'd' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % 4 AS VARCHAR) AS domain,
            coalesce(lang, '') AS m_lang, coalesce(source, '') AS m_source FROM documents),
    leaves AS (SELECT domain, m_lang, m_source, SUM(n_tokens) AS tokens, SUM(n_tokens) * {epochs} AS cap FROM rows_ GROUP BY ALL),
    top AS (SELECT domain, gets FROM ({fill(f"SELECT 0 AS root, domain, SUM(cap) AS cap, (SELECT CAST(floor(SUM(tokens) * {percent} / 100) AS BIGINT) FROM leaves) AS budget, {case('domain', weights[0])} AS weight FROM leaves GROUP BY domain", 'root', 'domain')})),
    middle AS (SELECT domain, m_lang, gets FROM ({fill(f"SELECT l.domain, m_lang, SUM(cap) AS cap, any_value(top.gets) AS budget, {case('m_lang', weights[1])} AS weight FROM leaves l JOIN top ON l.domain = top.domain GROUP BY l.domain, m_lang", 'domain', 'm_lang')})),
    leaf AS (SELECT domain, m_lang, m_source, gets // greatest(tokens, 1) AS whole, gets % greatest(tokens, 1) AS rest FROM ({fill(f"SELECT l.domain, l.m_lang, m_source, tokens, cap, middle.gets AS budget, {case('m_source', weights[2])} AS weight FROM leaves l JOIN middle ON l.domain = middle.domain AND l.m_lang = middle.m_lang", 'domain, m_lang', 'm_source')})),
    placed AS (SELECT r.*, whole, rest, md5('{seed}:' || CAST(CAST(whole AS BIGINT) AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM rows_ r JOIN leaf USING (domain, m_lang, m_source)),
    started AS (SELECT *, coalesce(SUM(n_tokens) OVER (PARTITION BY domain, m_lang, m_source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed)
    SELECT doc_id, domain, m_lang AS lang, m_source AS source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(whole + CASE WHEN start < rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
        CAST(whole * n_tokens + CASE WHEN start < rest THEN least(n_tokens, rest - start) ELSE 0 END AS BIGINT) AS taken_tokens
    FROM started WHERE whole > 0 OR start < rest"""
