"""Queries that audit byte coverage: merged claims, gaps, their classes, and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import audit
from recordloom.queries.tables import register, table

QUERIES: dict = {}
SIZE = 60_000


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claimed ranges of each user's resource: (user_id, start, end)."""
    start = (F.col("event_id") * 7919) % 50_000
    return table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + F.col("event_id") % 400).alias("end"))


MERGED_SQL = """
    WITH c AS (SELECT user_id, (event_id * 7919) % 50000 AS s, (event_id * 7919) % 50000 + event_id % 400 AS e FROM events), p AS (SELECT * FROM c WHERE e > s),
    m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
    u AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, island)"""

GAPS_SQL = MERGED_SQL + f""",
    i AS (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s), 0) AS gs, s AS ge, lag(e) OVER (PARTITION BY user_id ORDER BY s) AS prev_end, s AS next_start FROM u
        UNION ALL SELECT user_id, max(e), {SIZE}, max(e), NULL FROM u GROUP BY user_id),
    gaps AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY gs) - 1 AS gap_id, gs, ge, CASE WHEN next_start IS NULL THEN 'tail_gap' ELSE 'internal_gap' END AS kind, prev_end, next_start FROM i WHERE ge > gs)"""


@register(QUERIES, MERGED_SQL + ' SELECT user_id, s AS "start", e AS "end" FROM u')
def claims_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of claims that overlap or touch."""
    return audit.merged(claims(spark, sf_dir), ["user_id"], stretch=4096)


def found_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    union = audit.merged(claims(spark, sf_dir), ["user_id"], stretch=4096)
    return audit.gaps(union, union.select("user_id").distinct().withColumn("size", F.lit(SIZE).cast("bigint")), ["user_id"])


@register(QUERIES, GAPS_SQL + ' SELECT user_id, CAST(gap_id AS INT) AS gap_id, gs AS "start", ge AS "end", kind FROM gaps')
def claims_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclaimed ranges, the tail included."""
    return found_gaps(spark, sf_dir).select("user_id", "gap_id", "start", "end", "kind")


@register(QUERIES, GAPS_SQL + """ SELECT g.user_id, CAST(gap_id AS INT) AS gap_id, (SELECT arg_max(e, s * 1000000 + e) FROM p WHERE p.user_id = g.user_id AND p.e <= g.gs) AS prev_end, next_start FROM gaps g""")
def gap_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims on either side of each gap: the last, by start, that ends before it, and the next."""
    every = claims(spark, sf_dir)
    union = audit.merged(every, ["user_id"], stretch=4096)
    found = audit.gaps(union, union.select("user_id").distinct().withColumn("size", F.lit(SIZE).cast("bigint")), ["user_id"], every)
    return found.select("user_id", "gap_id", "prev_end", "next_start")


def with_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps with pointer hits and a stand-in for their nonzero bytes."""
    pointers = table(spark, sf_dir, "events").select("user_id", ((F.col("event_id") * 104_729) % SIZE).alias("target"))
    return audit.pointed_at(found_gaps(spark, sf_dir), pointers, ["user_id"])


HITS_SQL = GAPS_SQL + f""",
    t AS (SELECT user_id, (event_id * 104729) % {SIZE} AS target FROM events),
    hits AS (SELECT g.user_id, g.gap_id, g.gs, g.ge, g.kind, count(target) AS pointer_hits FROM gaps g LEFT JOIN t ON t.user_id = g.user_id AND target >= gs AND target < ge GROUP BY ALL),
    risky AS (SELECT *, CASE WHEN (gs % 3) * (ge - gs) = 0 THEN 'all_zero_padding' WHEN pointer_hits > 0 THEN 'pointer_referenced_nonzero' ELSE 'nonzero_unreferenced' END AS classification,
        CASE WHEN (gs % 3) * (ge - gs) = 0 THEN 'low' WHEN pointer_hits > 0 THEN 'high' ELSE 'medium' END AS risk FROM hits)"""


@register(QUERIES, HITS_SQL + " SELECT user_id, CAST(gap_id AS INT) AS gap_id, pointer_hits FROM hits")
def gap_pointer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pointers lead into each gap."""
    return with_pointers(spark, sf_dir).select("user_id", "gap_id", "pointer_hits")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.classified(with_pointers(spark, sf_dir), (F.col("start") % 3) * (F.col("end") - F.col("start")))


@register(QUERIES, HITS_SQL + """ SELECT kind, risk, count(*) AS gaps, CAST(sum(ge - gs) AS BIGINT) AS gap_bytes, CAST(max(ge - gs) AS BIGINT) AS largest,
    count(*) FILTER (risk = 'low') AS low_gaps, count(*) FILTER (risk = 'medium') AS medium_gaps, count(*) FILTER (risk = 'high') AS high_gaps FROM risky GROUP BY ROLLUP (kind, risk)""")
def gap_classify_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps by kind and risk, with totals."""
    return audit.summarised(classes(spark, sf_dir), ["kind", "risk"])


@register(QUERIES, HITS_SQL + """ SELECT user_id, CAST(gap_id AS INT) AS gap_id, risk FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, gs - ge, gap_id) AS r FROM risky) WHERE r <= 3""")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three gaps of each resource that matter most."""
    return audit.reported(classes(spark, sf_dir), ["user_id"], 3).select("user_id", "gap_id", "risk")


def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow rules made from every fifth gap; half of them hold for tails alone."""
    return classes(spark, sf_dir).where("gap_id % 5 = 0").select(
        F.lit(None).cast("string").alias("game"), F.lit("EVT").alias("schema"), F.col("user_id").cast("string").alias("resref"), "start", "end", F.lit(None).cast("bigint").alias("size"),
        F.when(F.col("gap_id") % 2 == 0, "Tail_GAP").alias("kind"), F.lit(None).cast("string").alias("classification"), F.lit(None).cast("string").alias("risk"), F.concat_ws("-", "user_id", "gap_id").alias("id"), F.col("gap_id").alias("rank"),
    )


@register(QUERIES, HITS_SQL + """ SELECT user_id, CAST(gap_id AS INT) AS gap_id, CASE WHEN gap_id % 5 = 0 AND (gap_id % 2 <> 0 OR kind = 'tail_gap') THEN CAST(user_id AS VARCHAR) || '-' || CAST(gap_id AS VARCHAR) END AS rule_id FROM risky""")
def allowlist_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps that an allow rule names, with the rule."""
    found = classes(spark, sf_dir).withColumns({"game": F.lit("G"), "schema": F.lit("EVT"), "resref": F.col("user_id").cast("string")})
    return audit.suppressed(found, allowed(spark, sf_dir), ["user_id"]).select("user_id", "gap_id", "rule_id")


@register(QUERIES, "SELECT quality, toxic, count(*) AS tested, CAST(sum(1 - quality) AS BIGINT) AS failed FROM labels GROUP BY ROLLUP (quality, toxic)")
def fidelity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested and failed by two levels, with totals."""
    return table(spark, sf_dir, "labels").rollup("quality", "toxic").agg(F.count("*").alias("tested"), F.sum(1 - F.col("quality")).alias("failed"))


@register(QUERIES, HITS_SQL + f""", named AS (SELECT *, (gs % 3) * (ge - gs) AS nz, gap_id % 5 = 0 AND (gap_id % 2 <> 0 OR kind = 'tail_gap') AS gone, user_id % 3 AS team FROM risky),
    whole AS (SELECT user_id % 3 AS team, user_id, {SIZE} AS size, coalesce((SELECT sum(ge - gs) FROM risky r WHERE r.user_id = u.user_id), 0) AS free FROM (SELECT DISTINCT user_id FROM u) u),
    top AS (SELECT team, count(*) AS resources, CAST(sum(size) AS BIGINT) AS filesize, CAST(sum(size - free) AS BIGINT) AS claimed_bytes FROM whole GROUP BY ROLLUP (team)),
    low AS (SELECT team, count(*) FILTER (NOT gone) AS total_gaps, count(*) FILTER (NOT gone AND kind = 'internal_gap') AS internal_gaps, count(*) FILTER (NOT gone AND kind = 'tail_gap') AS tail_gaps,
        CAST(coalesce(sum(ge - gs) FILTER (NOT gone), 0) AS BIGINT) AS unknown_bytes, count(*) FILTER (NOT gone AND nz > 0) AS nonzero_gaps, count(*) FILTER (NOT gone AND pointer_hits > 0) AS pointer_referenced_gaps,
        count(*) FILTER (NOT gone AND risk = 'high') AS high_risk_gaps, CAST(coalesce(max(ge - gs) FILTER (NOT gone), 0) AS BIGINT) AS largest_gap_size, count(*) FILTER (gone) AS suppressed_gaps,
        CAST(coalesce(sum(ge - gs) FILTER (gone), 0) AS BIGINT) AS suppressed_unknown_bytes, count(*) FILTER (gone AND nz > 0) AS suppressed_nonzero_gaps, count(*) FILTER (gone AND risk = 'high') AS suppressed_high_risk_gaps FROM named GROUP BY ROLLUP (team))
    SELECT top.*, low.* EXCLUDE (team) FROM top JOIN low ON top.team IS NOT DISTINCT FROM low.team""")
def gap_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of the audit by team and in total, allowed gaps counted apart."""
    found = classes(spark, sf_dir).withColumns({"game": F.lit("G"), "schema": F.lit("EVT"), "resref": F.col("user_id").cast("string"), "nonzero_bytes": (F.col("start") % 3) * (F.col("end") - F.col("start"))})
    named = audit.suppressed(found, allowed(spark, sf_dir), ["user_id"])
    sizes = claims(spark, sf_dir).where("end > start").select("user_id").distinct().select("user_id", F.lit(SIZE).cast("bigint").alias("size"), (F.col("user_id") % 3).alias("team"))
    return audit.measured(named, sizes, ["user_id"], ["team"])
