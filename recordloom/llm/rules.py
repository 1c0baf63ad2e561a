"""Operator 10: quality rules as robust multivariate outliers (DataFrame functions only).

Base statistics are exact counts over the whole text. The method looks at four
transformed ratios of them. For each language and source, for each language, and for all
rows, their centre and covariance are estimated by minimum covariance determinant. Each
of several starts (medians and median deviations, spatial signs, and two halves of the
rows) takes concentration steps: the SHARE of rows with the smallest Mahalanobis distances
gives mean and covariance anew, until the determinant falls no more; the start that ends
with the least determinant wins. A floor on each variance keeps the estimate regular where
most documents have one value. Rows beyond LIMIT are rejected.

Steps run over cells: rows whose features agree to GRID are one row with their number,
sums and sums of products, so that moments of cells are exact and a step's work depends on
how many cells there are. All rows of a cell are taken or left together. Distances of
documents are their own.

Every group has an estimate of its own, however small. A group of n rows is judged by
the moments of a mixture: its own estimate with odds of (n / EVEN) squared against its
language's, which is mixed with that of all rows in the same way. There is no size at
which the verdict switches: large groups are judged by themselves, and a small one that
differs from its language widens the covariance towards itself.

Estimates are aggregates with partial sums; a group that holds a third of all rows is
never gathered in one task.

Defined results: null text has no words (n_words 0, base_failed); null lang or source
is a group of its own; rows without doc_id are judged like any other; repeated rows count
as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import SPACE_CHARS, WORD, discard, written

SYMBOLS = "#*$%&|<>"
SPAN = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
FEATURES = ("x0", "x1", "x2", "x3")
PAIRS = tuple((i, j) for i in range(len(FEATURES)) for j in range(i + 1))
#: Least standard deviation of each feature.
FLOOR = (0.15, 0.35, 0.35, 0.35)
SHARE = 0.75
#: Width of a cell in each feature.
GRID = 1 / 32
#: Fall of the determinant's logarithm below which a start has ended.
FALL = 1e-6
#: Rows at which a group's own estimate and that of its language weigh the same.
EVEN = 50
#: Squared Mahalanobis distance: the 1 - 1e-9 quantile of chi-squared with 4 degrees of freedom.
LIMIT = 47.0
#: Makes the covariance of the nearest three quarters of a normal sample (4 features) consistent.
SCALE = 1.0 / 0.537


def repeated_words(grams: Column, span: int = SPAN) -> Column:
    """Words covered by windows whose hash occurs twice or more in grams."""
    ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def twin(x: Column, i: Column, all_: Column) -> Column:
        return F.coalesce(x["h"] == F.get(all_, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(all_, i + 1)["h"], F.lit(False))

    # let: one evaluation of the ordered array for all lookups
    places = F.flatten(F.transform(F.array(ordered), lambda all_: F.filter(F.transform(all_, lambda x, i: F.when(twin(x, i, all_), x["at"])), lambda p: p.isNotNull())))
    places = F.array_sort(places)
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        return F.struct((p + span).alias("to"), (s["n"] + span - F.greatest(s["to"] - p, F.lit(0))).alias("n"))

    return F.aggregate(places, zero, step, lambda s: s["n"])


def paired(step: int) -> Callable[[Column], Column]:
    """For an array of hashes, those of each one and the one so many places on."""

    def pairs(codes: Column) -> Column:
        on = F.slice(codes, F.lit(step + 1), F.greatest(F.size(codes) - step, F.lit(0)))
        return F.zip_with(codes, on, lambda x, y: F.xxhash64(x, y))

    return pairs


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.translate("t", SPACE_CHARS, " " * len(SPACE_CHARS)), " ", -1), lambda w: w != "")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    got = docs.select(*keep, t.alias("t")).withColumns({"words": words, "lines": lines})
    bare = F.length(F.translate("t", SPACE_CHARS, ""))
    n = F.size("words")
    # hashes of one word, then of two, four and eight in a row
    codes = F.transform("words", lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        codes = F.get(F.transform(F.array(codes), paired(step)), F.lit(0))
    grams = F.when(n >= SPAN, F.slice(codes, F.lit(1), n - SPAN + 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    got = got.select(
        *keep,
        n.cast("long").alias("n_words"),
        bare.cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        grams.alias("grams"),
    )
    repeat = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), repeated_words(F.col("grams"))).otherwise(0)
    return got.withColumn("n_repeat_words", repeat.cast("long")).drop("grams")


def features(stats: DataFrame) -> DataFrame:
    """Each feature can pass LIMIT alone, from a centre of 0 and at the floor: x2 above half
    of the lines, x3 above a quarter of the words (MOST_REPEATED comes soon after)."""
    some = F.greatest("n_words", F.lit(1))
    x = {
        "x0": F.log(F.greatest("word_chars", F.lit(1)) / some),
        "x1": F.log1p(100.0 * F.col("n_symbols") / F.greatest("word_chars", F.lit(20))),
        "x2": F.log1p(20.0 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(4))),
        "x3": F.log1p(40.0 * F.col("n_repeat_words") / F.greatest("n_words", F.lit(50))),
    }
    return stats.withColumns(x)


def factored(moments: DataFrame, scale: float = 1.0) -> DataFrame:
    """moments with the lower Cholesky factor (l00, l10, ...) of the scaled, floored covariance,
    and the logarithm of its determinant."""
    out = moments
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            v = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * scale + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0))
            v = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), v)
            out = out.withColumn(f"l{i}{j}", F.sqrt(v) if i == j else v / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", reduce(lambda a, b: a + b, (2 * F.log(f"l{i}{i}") for i in range(len(FEATURES)))))


SUMS = ["n", *(f"s{i}" for i in range(len(FEATURES))), *(f"p{i}{j}" for i, j in PAIRS)]
PLACE = [f"q{i}" for i in range(len(FEATURES))]
MOMENTS = [f"m{i}" for i in range(len(FEATURES))] + [f"c{i}{j}" for i, j in PAIRS]
FACTOR = [f"l{i}{j}" for i, j in PAIRS]
LEVEL = ["level", "g_lang", "g_source"]


def cells(rows: DataFrame) -> DataFrame:
    """(LEVEL, PLACE, SUMS): cells of language and source (level 0), language (1), all rows (2)."""
    sums = {"n": F.count("*")} | {f"s{i}": F.sum(x) for i, x in enumerate(FEATURES)} | {f"p{i}{j}": F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in PAIRS}
    place = [F.floor(F.col(x) / GRID).cast("int").alias(q) for x, q in zip(FEATURES, PLACE)]
    own = written(rows.groupBy("g_lang", "g_source", *place).agg(*(c.alias(k) for k, c in sums.items())))
    out = own.select(F.lit(0).alias("level"), "g_lang", "g_source", *PLACE, *SUMS)
    none = F.lit("")
    for level, keys in ((1, [F.col("g_lang"), none.alias("g_source")]), (2, [none.alias("g_lang"), none.alias("g_source")])):
        wide = own.groupBy(*keys, *PLACE).agg(*(F.sum(c).alias(c) for c in SUMS))
        out = out.union(wide.select(F.lit(level).alias("level"), "g_lang", "g_source", *PLACE, *SUMS))
    out = written(out.withColumns({x: F.col(f"s{i}") / F.col("n") for i, x in enumerate(FEATURES)}))
    discard(own)
    return out


def moments(held: DataFrame, keys: list[str]) -> DataFrame:
    """Means and covariances of the rows in cells, by keys."""
    total = held.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS))
    means = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(len(FEATURES))}
    covariances = {f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in PAIRS}
    covariances |= {f"c{i}{i}": F.greatest(covariances[f"c{i}{i}"], F.lit(0.0)) for i in range(len(FEATURES))}
    return total.withColumns(means).withColumns(covariances).select(*keys, *MOMENTS)


def starts(held: DataFrame) -> DataFrame:
    """(LEVEL, start, MOMENTS): where the concentration steps of each group set out from."""
    middle = written(held.groupBy(*LEVEL).agg(*(F.percentile(x, 0.5, F.col("n")).alias(f"m{i}") for i, x in enumerate(FEATURES))))
    both = held.join(middle, LEVEL)
    spread = both.groupBy(*LEVEL).agg(*(F.percentile(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, F.col("n")).alias(f"d{i}") for i, x in enumerate(FEATURES)))
    spread = written(middle.join(spread, LEVEL).withColumns({f"d{i}": 1.4826 * F.col(f"d{i}") + FLOOR[i] for i in range(len(FEATURES))}))
    diagonal = spread.select(*LEVEL, *MOMENTS[:4], *((F.pow(f"d{i}", 2) / SCALE if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS))
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"d{i}") for i, x in enumerate(FEATURES)]
    signs = held.join(spread, LEVEL).withColumn("weight", F.col("n") / F.greatest(reduce(lambda a, b: a + b, (v * v for v in z)), F.lit(1e-9)))
    several = [F.first(c).alias(c) for c in (*MOMENTS[:4], "d0", "d1", "d2", "d3")]
    signs = signs.groupBy(*LEVEL).agg(*several, F.sum("n").alias("n"), *(F.sum(F.col("weight") * z[i] * z[j]).alias(f"z{i}{j}") for i, j in PAIRS))
    signs = signs.select(*LEVEL, *MOMENTS[:4], *((4 * F.col(f"z{i}{j}") / F.col("n") * F.col(f"d{i}") * F.col(f"d{j}") / SCALE).alias(f"c{i}{j}") for i, j in PAIRS))
    odd = F.pmod(reduce(lambda a, b: a + b, map(F.col, PLACE)), F.lit(2))
    halves = [moments(held.where(odd == k), LEVEL) for k in (0, 1)]
    out = [part.select(*LEVEL, F.lit(k).alias("start"), *MOMENTS) for k, part in enumerate((diagonal, signs, *halves))]
    found = written(reduce(DataFrame.union, out))
    discard(middle)
    discard(spread)
    return found


def distance() -> Column:
    """The squared Mahalanobis distance, by forward substitution."""
    y: list[Column] = []
    for i, x in enumerate(FEATURES):
        r = reduce(lambda a, k: a - F.col(f"l{i}{k}") * y[k], range(i), F.col(x) - F.col(f"m{i}"))
        y.append(r / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (v * v for v in y))


def estimated(held: DataFrame) -> DataFrame:
    """(LEVEL, many, MOMENTS): minimum covariance determinant estimates from cells()."""
    keys = [*LEVEL, "start"]
    first = starts(held)
    now = written(factored(first, SCALE).withColumn("logdet", F.lit(None).cast("double")))
    discard(first)
    ended = []
    while True:
        far = held.join(now, LEVEL).withColumn("far", distance())
        edge = written(far.groupBy(*keys).agg(F.percentile("far", SHARE, F.col("n")).alias("edge")))
        near = moments(far.join(edge, keys).where("far <= edge"), keys)
        new = factored(near, SCALE).join(now.select(*keys, F.col("logdet").alias("before")), keys)
        new = written(new.withColumn("falls", F.coalesce(F.col("logdet") < F.col("before") - FALL, F.lit(True))))
        discard(edge)
        ended.append(written(new.where("not falls").select(*keys, "logdet", *MOMENTS).union(now.join(new.where("not falls").select(*keys), keys, "left_semi").select(*keys, "logdet", *MOMENTS))))
        discard(now)
        now = written(new.where("falls").drop("before", "falls"))
        discard(new)
        if now.isEmpty():
            break
    discard(now)
    best = reduce(DataFrame.union, ended).groupBy(*LEVEL).agg(F.min_by(F.struct(*MOMENTS), F.struct("logdet", "start")).alias("best"))
    best = best.select(*LEVEL, *(F.col(f"best.{c}").alias(c) for c in MOMENTS)).withColumns({f"c{i}{j}": SCALE * F.col(f"c{i}{j}") for i, j in PAIRS})
    out = written(best.join(held.groupBy(*LEVEL).agg(F.sum("n").alias("many")), LEVEL))
    for part in ended:
        discard(part)
    return out


def mixed(own: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the moments of own (keys, many) mixed with those of above (some of keys, or
    one row), which are the moments where own has none."""
    names = [f"m{i}" for i in range(4)] + [f"c{i}{j}" for i, j in PAIRS]
    on = [k for k in keys if k in above.columns]
    above = above.select(*on, *(F.col(c).alias(f"above_{c}") for c in names))
    both = own.join(above, on, "left") if on else own.join(above, F.lit(True), "left")
    odds = F.pow(F.coalesce("many", F.lit(0)) / F.lit(float(EVEN)), 2)
    # without a level above (no sound row at all) all is null, as before
    both = both.withColumn("part", odds / (1 + odds))
    w, rest = F.col("part"), 1 - F.col("part")
    gap = [F.coalesce(F.col(f"m{i}") - F.col(f"above_m{i}"), F.lit(0.0)) for i in range(4)]

    def mean(c: str) -> Column:
        return w * F.coalesce(c, f"above_{c}") + rest * F.col(f"above_{c}")

    means = [mean(f"m{i}").alias(f"m{i}") for i in range(4)]
    return both.select(*keys, *means, *((mean(f"c{i}{j}") + w * rest * gap[i] * gap[j]).alias(f"c{i}{j}") for i, j in PAIRS))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, the five counts, base_failed, distance, kept)."""
    rows = written(features(statistics(docs).withColumns({"g_lang": F.coalesce("lang", F.lit("\0")), "g_source": F.coalesce("source", F.lit("\0")), "g_all": F.lit(0)})))
    held = cells(rows.where(f"n_words >= {LEAST_WORDS}"))
    found = estimated(held)
    discard(held)
    keys = ["g_lang", "g_source"]
    of = lambda level, names: found.where(F.col("level") == level).select(*names, "many", *MOMENTS)
    # each group of rows, though none of them is sound
    own, of_lang = (rows.select(*k).distinct().join(of(level, k), k, "left") for level, k in ((0, keys), (1, keys[:1])))
    of_all = rows.select("g_all").distinct().join(found.where("level = 2").select(F.lit(0).alias("g_all"), "many", *MOMENTS), "g_all", "left")
    langs = mixed(of_lang, of_all, keys[:1])
    groups = mixed(own, langs, keys)
    both = rows.join(written(factored(groups).drop("logdet")), keys, "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), distance().alias("distance"),
    ).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= LIMIT))
