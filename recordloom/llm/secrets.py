"""Operator 8: secret scans by patterns and by sliding-window entropy (DataFrame functions only).

Base kinds are patterns, leftmost and non-overlapping per kind. Positions come from
the texts between the matches: split() gives them, their lengths and those of the
matches add up to places in the text, in code points.

The method adds spans of kind entropy. Candidates are runs of key-like characters. A
window of WIDTH characters slides over each; its Shannon entropy is kept up to date
by the counts of the one character that leaves and the one that enters. A window
counts if its entropy reaches the threshold of the candidate's character class (hex,
letters and digits, or all of base64). The span reaches from the first to the last
such window. Allow-listed candidates (words without digits, numbers, UUIDs, paths,
placeholders) and those that touch a base span add nothing.

Defined results: null text counts as empty and has no spans; repeated rows are
repeated; an empty table gives no rows; other columns are ignored by scan() and kept
by redacted().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
LEAST_VALUE = 12

KEY_CHARS = "A-Za-z0-9+/=_-"
WIDTH = 20
CANDIDATE = f"(?<![{KEY_CHARS}])[{KEY_CHARS}]{{{WIDTH},}}+"
#: Entropy in bits that a window must reach, by class: (pattern of the whole candidate, bits).
CLASSES = (("[0-9A-Fa-f]+", 3.0), ("[A-Za-z0-9]+", 3.8), (f"[{KEY_CHARS}]+", 3.9))
ALLOWED = (
    "^[^0-9]*$|^[0-9_+/=-]*$"  # no digit, or digits and separators alone
    "|^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"
    "|^/?([A-Za-z_-]+[0-9]{0,4}/)+[A-Za-z_-]*[0-9]{0,4}$"
    "|(?i:example|sample|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh)"
)
#: Characters of a candidate that one pass of the window goes over; passes overlap by a window.
STRETCH = 512
MARK = "[SECRET]"

SPAN = "array<struct<start:int,kind:int,end:int>>"


def placed(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """The spans of a pattern's matches; keep: booleans that go with the matches."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    keep = F.transform(found, lambda _: F.lit(True)) if keep is None else keep
    parts = F.arrays_zip(F.transform(found, F.length).alias("n"), F.slice(F.transform(between, F.length), F.lit(1), F.size(found)).alias("gap"), keep.alias("keep"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        end = begin + part["n"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(part["keep"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda state: state["spans"])


def none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def count_of(char: Column, within: Column) -> Column:
    return F.length(within) - F.length(F.replace(within, char, F.lit("")))


def hot_stretch(piece: Column, bits: Column, width: int = WIDTH) -> Column:
    """(first, last): where the first window with so much entropy starts and the last ends."""
    weight = F.array(*(F.lit(k * math.log2(k) if k else 0.0) for k in range(width + 2)))

    def step(state: Column, i: Column) -> Column:
        # The characters that stay while one leaves on the left and one enters on the right.
        stay = F.substring(piece, F.greatest(i - width + 1, F.lit(1)), F.least(i - 1, F.lit(width - 1)))
        comes, goes = F.substring(piece, i, F.lit(1)), F.substring(piece, i - width, F.lit(1))
        a = count_of(comes, stay)
        total = state["total"] + F.get(weight, a + 1) - F.get(weight, a)
        b = count_of(goes, stay)
        total = total - F.when(i > width, F.get(weight, b + 1) - F.get(weight, b)).otherwise(0.0)
        hot = (i >= width) & (math.log2(width) - total / width >= bits)
        return F.struct(
            total.alias("total"),
            F.when(hot & state["first"].isNull(), i - width).otherwise(state["first"]).alias("first"),
            F.when(hot, i).otherwise(state["last"]).alias("last"),
        )

    zero = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(piece)), zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def hot_span(candidate: Column, width: int = WIDTH, stretch: int = STRETCH) -> Column:
    """hot_stretch() of a candidate of any length, nulls if no window is hot."""
    bits = F.lit(CLASSES[-1][1])
    for pattern, b in reversed(CLASSES[:-1]):
        bits = F.when(candidate.rlike(f"^(?:{pattern})$"), b).otherwise(bits)
    starts = F.sequence(F.lit(0), F.length(candidate) - width, F.lit(stretch - width + 1))

    def one(at: Column) -> Column:
        hot = hot_stretch(F.substring(candidate, at + 1, F.lit(stretch)), bits, width)
        return F.struct((hot["first"] + at).alias("first"), (hot["last"] + at).alias("last"))

    hot = F.transform(starts, one)
    return F.struct(F.array_min(F.transform(hot, lambda x: x["first"])).alias("first"), F.array_max(F.transform(hot, lambda x: x["last"])).alias("last"))


def entropy_spans(text: Column, candidates: Column, base: Column) -> Column:
    def inside(c: Column) -> Column:
        hot = hot_span(F.substring(text, c["start"] + 1, c["end"] - c["start"]))
        return F.struct((hot["first"] + c["start"]).alias("start"), F.lit(3).alias("kind"), (hot["last"] + c["start"]).alias("end"))

    def wanted(c: Column) -> Column:
        string = F.substring(text, c["start"] + 1, c["end"] - c["start"])
        return ~string.rlike(ALLOWED) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    return F.filter(F.transform(F.filter(candidates, wanted), inside), lambda s: s["start"].isNotNull())


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns found_base and found_all, spans in order."""
    t = F.coalesce(F.col(text), F.lit(""))
    value = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= LEAST_VALUE)
    out = docs.withColumns(
        {
            "found_assign": F.when((t.contains("=") | t.contains(":")) & t.rlike(ASSIGN), placed(t, ASSIGN, 0, value)).otherwise(none()),
            "found_access": F.when(t.contains("AKIA") & t.rlike(ACCESS), placed(t, ACCESS, 1)).otherwise(none()),
            "found_hex": F.when(t.rlike(HEX), placed(t, HEX, 2)).otherwise(none()),
            "found_candidate": F.when(t.rlike(CANDIDATE), placed(t, CANDIDATE, 3)).otherwise(none()),
        }
    )
    out = out.withColumn("found_base", F.array_sort(F.concat("found_assign", "found_access", "found_hex")))
    more = F.when(F.size("found_candidate") > 0, entropy_spans(t, F.col("found_candidate"), F.col("found_base"))).otherwise(none())
    return out.withColumn("found_all", F.array_sort(F.concat("found_base", more)))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    got = found(docs.select("doc_id", "text"))
    counts = [F.size(f"found_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return got.select("doc_id", *counts, F.sha2(listed(F.col("found_base")), 256).alias("base_sha256"), listed(F.col("found_all")).alias("spans"))


def redacted(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """docs with every span replaced by a mark in text; null text stays null. n_chars, if
    there, is the length of a changed text."""
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"))

    clean = F.aggregate(F.col("found_all"), start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    got = found(docs.select(F.struct("*").alias("found_doc"), "text")).withColumn("changed", F.size("found_all") > 0)
    got = got.withColumn("clean", F.when(F.col("changed"), clean))
    columns = {c: F.col("found_doc")[c] for c in docs.columns}
    columns["text"] = F.when(F.col("changed"), F.col("clean")).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("changed"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return got.select(*(c.alias(name) for name, c in columns.items()))
