"""Operator 9: URL filter by rules and a path-template tree.

Rules name a host with its subdomains and the start of a path; the longest one that
fits decides. All other URLs are judged by templates: a path's segments become
branches of a tree per host, to any depth. Digits inside a segment and long segments are
wildcards. So are a node's branches that have one page each, where such pages are so
large a share of the node's that the segment is an identifier rather than a place.

From the top down, siblings are merged where their labels speak for it: the Bayes factor
of one rate of bad pages against two. Branches with labels meet in the order of their
rates, the best-supported neighbours first, until the labels of no two speak for one rate
any more. Equal counts speak for it, few against many of another rate do not, and a branch
without labels says nothing: it is not merged and takes its parent's rate. A node's rate is
smoothed towards its parent's, down from the corpus and the host; URLs whose template has
a purity, the share of good pages, under PURITY are blocked.

The tree is a table of distinct templates with counts, and one round of joins a level; a
round has only templates that still share their node with others. Siblings meet as
distinct pairs of counts (labelled, bad), of which N labels make less than N ** (2 / 3) or
so; no node's pages or branches are gathered.

Defined results: null URLs and those without :// have empty host and path and form a
template of their own; null or missing labels count for nothing, and of several labels of
a page the bad one holds; rows without page_id are judged like any other but have no label;
repeated pages are repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import discard, written

RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
LONG_SEGMENT = 24
#: Share of a node's pages that are alone in their branch, above which those are wildcards.
VARIABLE = 0.5
#: Pages that a parent's rate counts for.
SMOOTHING = 10.0
PURITY = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = ["host", "node"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    fits = []
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        name, start = rule.split("/", 1)
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + start), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def generalised(path: Column) -> Column:
    """A path without its first slash, variable parts of its segments wild."""
    one = lambda s: F.when(F.length(s) > LONG_SEGMENT, F.lit("*")).otherwise(F.regexp_replace(s, "[0-9]+|[0-9a-f]{8,}", "*"))
    return F.array_join(F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), one), "/")


def support(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The logarithm of the Bayes factor of one rate against two, for each pair of neighbours,
    rates being uniform before."""
    gamma = np.vectorize(math.lgamma, otypes=[float])
    beta = lambda b, g: gamma(b + 1) + gamma(g + 1) - gamma(b + g + 2)
    own = beta(bad, good)
    return beta(bad[1:] + bad[:-1], good[1:] + good[:-1]) - own[1:] - own[:-1]


def clusters(lab: np.ndarray, bad: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A cluster number for each pair of counts (lab > 0) that so many siblings have."""
    order = np.lexsort((lab, (bad + 1) / (lab + 2)))
    b, g = (bad * many)[order].astype(float), ((lab - bad) * many)[order].astype(float)
    ends = np.arange(1, len(order) + 1)
    while len(b) > 1:
        best = support(b, g)
        k = int(best.argmax())
        if best[k] <= 1e-9:
            break
        b[k], g[k] = b[k] + b[k + 1], g[k] + g[k + 1]
        b, g, ends = np.delete(b, k + 1), np.delete(g, k + 1), np.delete(ends, k)
    out = np.empty(len(order), dtype=np.int32)
    out[order] = np.searchsorted(ends, np.arange(len(order)), side="right")
    return out


def merged(children: DataFrame) -> DataFrame:
    """(host, node, lab, bad, cluster) of the siblings (host, node, branch, lab, bad) that have
    labels; cluster is null where it would hold one of them alone."""
    counts = children.where("lab > 0 and branch is not null").groupBy(*NODE, "lab", "bad").agg(F.count("*").alias("many"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        own = clusters(*(group[c].to_numpy() for c in ("lab", "bad", "many")))
        size = np.bincount(own, weights=group["many"])
        return group[[*NODE, "lab", "bad"]].assign(cluster=np.where(size[own] > 1, own, -1))

    return counts.groupBy(*NODE).applyInPandas(solve, "host string, node long, lab long, bad long, cluster int").where("cluster >= 0")


def smooth(bad: str, lab: str, above: Column) -> Column:
    return (F.col(bad) + SMOOTHING * above) / (F.col(lab) + SMOOTHING)


def matched(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """rows with the columns of more for the same node and key; null keys are the same."""
    names = {c: f"m_{c}" for c in (*NODE, key)}
    more = more.withColumnsRenamed(names)
    on = (F.col("host") == F.col("m_host")) & (F.col("node") == F.col("m_node")) & F.col(key).eqNullSafe(F.col(names[key]))
    return rows.join(more, on).drop(*names.values())


def tree(pages: DataFrame) -> DataFrame:
    """(host, raw, template, purity) of the distinct templates of pages (host, raw, bad); bad
    is null where a page has no label."""
    sums = [F.sum(c).alias(c) for c in ("held", "n", "lab", "bad")]
    rows = written(pages.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")))
    spent = [rows]
    hosts = rows.withColumn("held", F.lit(1).cast("long")).groupBy("host").agg(*sums)
    corpus = hosts.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("lab"), F.lit(0)), F.lit(1))).alias("rate")).first()[0]
    hosts = hosts.select("host", "held", smooth("bad", "lab", F.lit(float(corpus or 0))).alias("rate"))
    rows = rows.join(hosts, "host").select("*", F.split("raw", "/", -1).alias("steps"), F.xxhash64("host").alias("node"), F.array().cast("array<string>").alias("branch"))
    level, done = 0, []
    while True:
        rest = F.slice("steps", level + 1, F.greatest(F.size("steps") - level, F.lit(0)))
        done.append(rows.where("held < 2").select("host", "raw", F.concat("branch", rest).alias("branch"), "rate"))
        rows = rows.where("held > 1").withColumn("own", F.get("steps", F.lit(level)))
        child = written(rows.withColumn("held", F.lit(1).cast("long")).groupBy(*NODE, "own").agg(*sums))
        spent.append(child)
        if child.isEmpty():
            break
        novel = child.groupBy(*NODE).agg((F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / (F.sum("n") + SMOOTHING) > VARIABLE).alias("novel"))
        # the end of a path is a branch without a name, never wild and never merged
        named = child.join(novel, NODE).withColumn("branch", F.when(F.col("novel") & (F.col("n") == 1) & F.col("own").isNotNull(), F.lit("*")).otherwise(F.col("own")))
        siblings = named.groupBy(*NODE, "branch").agg(*sums)
        siblings = siblings.join(merged(siblings), [*NODE, "lab", "bad"], "left")
        final = F.when(F.col("cluster").isNotNull() & F.col("branch").isNotNull(), F.concat(F.lit("*#"), F.col("cluster").cast("string"))).otherwise(F.col("branch"))
        siblings = written(siblings.select(*NODE, "branch", "held", "lab", "bad", final.alias("final")))
        spent.append(siblings)
        whole = siblings.groupBy(*NODE, "final").agg(*(F.sum(c).alias(f"f_{c}") for c in ("held", "lab", "bad")))
        several = whole.groupBy(*NODE).agg((F.count("*") > 1).alias("several"))
        told = named.select(*NODE, "own", "branch")
        for more, key in ((siblings.select(*NODE, "branch", "final"), "branch"), (whole.join(several, NODE), "final")):
            told = matched(told, more, key)
        rate = F.when(F.col("several"), smooth("f_bad", "f_lab", F.col("rate"))).otherwise(F.col("rate"))
        grown = F.when(F.col("final").isNull(), F.col("branch")).otherwise(F.concat("branch", F.array("final")))
        below = F.xxhash64("node", F.coalesce("final", F.lit("\0")))
        held = F.when(F.col("own").isNull(), 1).otherwise(F.col("f_held"))
        rows = matched(rows.drop("held"), told.drop("branch"), "own")
        rows = written(rows.select("host", "raw", rate.alias("rate"), "n", "lab", "bad", "steps", below.alias("node"), grown.alias("branch"), held.alias("held")))
        spent.append(rows)
        level += 1
    out = reduce(DataFrame.union, done)
    out = written(out.select("host", "raw", F.array_join(F.concat(F.array("host"), "branch"), "/").alias("template"), (1 - F.col("rate")).alias("purity")))
    for part in spent:
        discard(part)
    return out


def judged(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity). labels: (page_id, bad)."""
    host, path = parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("raw", generalised(F.col("path")))
    if labels is None:
        known = seen.withColumn("bad", F.lit(None).cast("int"))
    else:
        bad = labels.where("page_id is not null and bad is not null").groupBy(F.col("page_id").alias("l_page")).agg(F.max("bad").cast("int").alias("bad"))
        known = seen.join(bad, F.col("page_id") == F.col("l_page"), "left")
    both = seen.join(tree(known.select("host", "raw", "bad")), ["host", "raw"], "left")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    verdicts = F.create_map(*(F.lit(x) for r in rules for x in r)) if rules else F.create_map()
    own = F.when(F.col("purity") < PURITY, "block").otherwise("allow")
    out = both.withColumn("rule", rule).withColumn("verdict", F.when(F.col("rule").isNotNull(), F.get(F.array(verdicts[F.col("rule")]), F.lit(0))).otherwise(own) if rules else own)
    return out.select("page_id", "host", "path", "rule", "verdict", "template", "purity")
