"""Layouts with pointers and sizes, errors, exact arithmetic, and comparisons of fractions."""

import pytest
from pyspark.sql import functions as F

from recordloom.functions.expression import compiled
from recordloom.functions.raster import blocks_rgba
from recordloom.operators import audit, decode, search
from recordloom.plans.layout import layout

POINTED = layout(
    {
        "name": "POINTED",
        "sections": {
            "header": {
                "fields": [
                    {"name": "at", "type": "dword"},
                    {"name": "length", "type": "word"},
                    {"name": "eff_structure_version", "type": "byte"},
                    {"name": "extra", "type": "effect_extra_data", "size": 2},
                    {"name": "name", "type": "pointer_string", "offset_ref": "at", "length_ref": "length"},
                ]
            },
            "once": {"offset_field": "at", "fields": [{"name": "first", "type": "byte"}]},
            "counted": {"offset_field": "at", "count": 1, "fields": [{"name": "first", "type": "byte"}]},
        },
    }
)


def test_pointers_sizes_and_offset_zero(spark):
    rows = [(1, b"\x09\0\0\0\x03\0\x01xyabc"), (2, b"\0\0\0\0\x01\0\0zz"), (3, None)]
    df = decode.header(spark.createDataFrame(rows, "k int, content binary"), POINTED)
    fields = df.select("k", *(c.alias(n) for n, c in decode.fields(POINTED.header, F.col("content"), None, F.col("content")).items()))
    got = {r.k: r for r in fields.collect()}
    assert got[1].name == "abc" and bytes(got[1].extra) == b"xy" and got[2].name is None and bytes(got[2].extra) == b""
    # a section at offset zero has no entries without a count, and those of its count with one
    assert sorted((r.k, r.first) for r in decode.entries(df, POINTED, "once", ["k"]).collect()) == [(1, 97)]
    assert sorted((r.k, r.first) for r in decode.entries(df, POINTED, "counted", ["k"]).collect()) == [(1, 97), (2, 0)]


@pytest.mark.parametrize(("text", "a", "want"), [("a // 3", -(2**60) - 1, (-(2**60) - 1) // 3), ("a // -7", 2**61 + 5, (2**61 + 5) // -7), ("a % -7", 9, 9 % -7), ("a // 0", 1, None), ("a // 7.5", 16, 2.0), ("a / 4", 10, 2.5)])
def test_arithmetic_is_exact(spark, text, a, want):
    if "-7" in text:
        text = text.replace("-7", "(0 - 7)")
    assert spark.createDataFrame([(a,)], "a long").select(compiled(text, {"a": F.col("a")}).alias("x")).first().x == want


def test_fractions_compare_by_their_text(spark):
    index = spark.createDataFrame([("A", "T", "a", 1.0e7), ("B", "T", "b", 0.5), ("C", "T", "c", None), ("D", "T", "d", 1.0e-7)], "resref string, restype string, display_name string, price double")
    found = lambda text: sorted(r.resref for r in search.where(index, text).collect())
    assert found("price = 10000000.0") == ["A"] and found("price = 10000000") == [] and found("price = 1e-07") == ["D"]
    assert found("price = none") == ["C"] and found("price != 0.5") == ["A", "C", "D"] and found("price = x") == []


def test_short_blocks_are_transparent():
    assert blocks_rgba(bytes(7), 4, 4, False) == bytes(64)


def test_byte_profile(spark):
    df = spark.createDataFrame([(1, b"\0\0\xffa"), (2, b""), (3, None)], "k int, raw binary")
    rows = audit.byte_profile(df, ["k"], "raw").collect()
    assert [(r.k, r["size"], r.zeros, r.ffs, r.distinct_bytes, r.nonzero_share, r.entropy) for r in rows] == [(1, 4, 2, 1, 3, 0.5, 1.5)]


def test_previous_claim_is_the_last_by_start(spark):
    claims = spark.createDataFrame([("r", 0, 10), ("r", 5, 6), ("r", 20, 30), ("r", 7, 7)], "k string, start long, end long")
    sizes = spark.createDataFrame([("r", 40)], "k string, size long")
    got = audit.gaps(audit.merged(claims, ["k"]), sizes, ["k"], claims).orderBy("start").collect()
    assert [(r.start, r.end, r.kind, r.prev_end, r.next_start) for r in got] == [(10, 20, "internal_gap", 6, 20), (30, 40, "tail_gap", 30, None)]


def test_errors_pack_each_order_once(spark, sf):
    """No filter on the errors is pushed down to where it would pack an order in every place that reads its content."""
    from recordloom import queries

    plan = queries.queries()["decode_errors"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and plan.count("body#") < 6
