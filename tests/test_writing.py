"""Writing of whole resources, their gate, and JSON, on built bytes."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from recordloom.operators import decode, dump, rewrite
from recordloom.plans.layout import layout

TWO = layout(
    {
        "name": "TWO",
        "sections": {
            "header": {"fields": [{"name": "a_at", "type": "word"}, {"name": "a_n", "type": "word"}, {"name": "b_at", "type": "word"}, {"name": "b_n", "type": "word"}]},
            "a": {"offset_field": "a_at", "count": "a_n", "fields": [{"name": "into", "type": "dword"}, {"name": "many", "type": "word"}, {"name": "raw", "type": "bytes", "size": 2}]},
            "b": {"offset_field": "b_at", "count": "b_n", "fields": [{"name": "x", "type": "word"}], "offset_update": {"section": "a", "field": "into", "stride_expr": {"field": "many"}}},
        },
    }
)


def a(into, many, raw=b"\0\0"):
    return struct.pack("<IH2s", into, many, raw)


def words(*x):
    return struct.pack(f"<{len(x)}H", *x)


def read(spark, contents, change=None):
    df = decode.header(spark.createDataFrame(list(enumerate(contents)), "k int, content binary"), TWO)
    return df, {s: decode.entries(df, TWO, s, ["k"]) for s in ("a", "b")}


def saved(df):
    return {r.k: r.saved and bytes(r.saved) for r in df.select("k", "saved").collect()}


def test_preserved(spark):
    plain = words(10, 1, 22, 2) + b"gg" + a(1, 2, b"hi") + b"zzzz" + words(5, 6) + b"tail"
    backwards = words(16, 1, 10, 2) + b"gg" + words(5, 6) + b".." + a(1, 2)
    overlapping = words(10, 1, 12, 2) + b"gg" + a(1, 2)
    empty = words(10, 0, 22, 0) + b"gg" + bytes(20)
    df, sections = read(spark, [plain, backwards, overlapping, empty, None])
    got = saved(rewrite.preserved(df, sections, TWO, ["k"]))
    assert got == {0: plain, 1: backwards, 2: overlapping, 3: words(10, 0, 22, 0) + empty[22:], 4: None}


def test_repacked_with_pointers(spark):
    raw = words(10, 3, 40, 5) + b"gg" + a(9, 2) + a(9, 0) + a(9, 3) + bytes(6) + words(1, 2, 3, 4, 5) + b"tail"
    df, sections = read(spark, [raw, words(0, 0, 0, 0)])
    got = saved(rewrite.repacked(df, sections, TWO, ["k"]))
    assert got[0] == words(8, 3, 32, 5) + a(32, 2) + a(36, 0) + a(36, 3) + words(1, 2, 3, 4, 5)
    assert got[1] == words(0, 0, 0, 0)
    # all entries of one section gone
    got = saved(rewrite.repacked(df, sections | {"a": sections["a"].where("false")}, TWO, ["k"]))
    assert got[0] == words(0, 0, 8, 5) + words(1, 2, 3, 4, 5)
    assert saved(rewrite.repacked(df, {}, TWO, ["k"]))[0] == words(0, 0, 0, 0)


def test_no_rows(spark):
    df, sections = read(spark, [])
    assert rewrite.preserved(df, sections, TWO, ["k"]).count() == 0 and rewrite.repacked(df, sections, TWO, ["k"]).count() == 0


def test_gate(spark):
    df = spark.createDataFrame([(1, True, 2), (2, False, 2), (3, True, 0), (4, None, 1)], "k int, modified boolean, gaps int")
    allowed = lambda p: [r[0] for r in df.orderBy("k").select(rewrite.gate(p, F.col("modified"), F.col("gaps"))["allowed"]).collect()]
    assert allowed("allow") == allowed("warn") == [True] * 4 and allowed("fail_nonzero") == [False, True, True, True]
    with pytest.raises(ValueError):
        rewrite.gate("never", F.col("modified"), F.col("gaps"))


def test_dumped(spark):
    df, sections = read(spark, [words(8, 1, 16, 0) + a(1, 2, b"\x01\xff"), words(0, 0, 0, 0) + b"ab", None])
    got = {r.k: r.json for r in dump.dumped(df, TWO, ["k"], sections).collect()}
    assert json.loads(got[0]) == {"header": [{"a_at": 8, "a_n": 1, "b_at": 16, "b_n": 0}], "a": [{"into": 1, "many": 2, "raw": "0x01ff"}], "b": []}
    assert json.loads(got[1])["_unmapped_trailing_data"] == {"size_bytes": 2, "data_hex": "61 62"}
    assert 2 in got


def test_a_filter_on_entries_does_not_seek_their_place(spark):
    """The place of a section that stands in another one's entry is read once a resource, not in every byte that a filter reads."""
    from recordloom.queries.formats import NESTED

    raw = struct.pack("<2I4I", 3, 8, 0, 1, 28, 2) + b"gap!" + words(1, 10, 2, 20, 3, 30)
    none = struct.pack("<2I", 3, 90)
    rows = decode.header(spark.createDataFrame([(1, raw), (2, none), (3, None)], "k int, content binary"), NESTED)
    found = decode.entries(rows, NESTED, "items", ["k"]).where("number % 2 = 1")
    assert [tuple(r) for r in found.orderBy("entry").collect()] == [(1, 0, 1, 10), (1, 2, 3, 30)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if "Filter" in line and "conv(" in line]
    assert len(conditions) == 1 and conditions[0].count("conv(") == 1 and "values" not in conditions[0]


ONE = layout(
    {
        "name": "ONE",
        "sections": {
            "header": {"fields": [{"name": "at", "type": "word"}, {"name": "n", "type": "word"}, {"name": "name", "type": "char_array", "size": 2}]},
            "a": {"offset_field": "at", "count": "n", "fields": [{"name": "x", "type": "dword"}, {"name": "flag", "type": "char_array", "size": 2}]},
        },
    }
)


def one_section(spark, contents):
    df = decode.header(spark.createDataFrame(list(enumerate(contents)), "k int, content binary"), ONE)
    return df, decode.entries(df, ONE, "a", ["k"])


def test_preserved_with_one_section(spark):
    """Behind a gap, over the header, behind the end of the original, empty, and null."""
    entry = struct.pack("<I2s", 0x81FF7F80, b"q\n")
    plain = struct.pack("<2H2s", 8, 2, b"hi") + b"gg" + entry + entry[::-1] + b"tail"
    over = struct.pack("<2H2s", 4, 1, b"hi") + entry
    empty = struct.pack("<2H2s", 9, 0, b"hi") + b"ggg" + b"tail"
    none = struct.pack("<2H2s", 0, 1, b"hi")
    df, a = one_section(spark, [plain, over, empty, none, None])
    got = saved(rewrite.preserved(df, {"a": a}, ONE, ["k"]))
    first = over[:4] + over[4:10] + over[10:]
    assert got == {0: plain, 1: first, 2: empty[:6] + b"tail", 3: none + none[6:], 4: None}
    # an entry given for a place behind the end: zeros before it
    far = struct.pack("<2H2s", 12, 1, b"hi")
    df, _ = one_section(spark, [far])
    given = spark.createDataFrame([(0, 0, 5, "ab")], "k int, entry int, x long, flag string")
    assert saved(rewrite.preserved(df, {"a": given}, ONE, ["k"]))[0] == far + bytes(6) + struct.pack("<I2s", 5, b"ab")


def test_bodies_are_joined_as_bytes(spark):
    """One section's header and body are made below the join, in generated code: no lambda and no array of entries above it."""
    df, a = one_section(spark, [struct.pack("<2H2s", 8, 1, b"hi") + b"gg" + struct.pack("<I2s", 1, b"ab")])
    for out in (rewrite.preserved(df, {"a": a}, ONE, ["k"]), rewrite.repacked(df, {"a": a}, ONE, ["k"])):
        above = out._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[0]
        assert "lambda" not in above and "held_" not in above


def test_text_keeps_a_newline_behind_a_nul(spark):
    """Trailing NULs alone go: the pattern before took one in front of a last newline too, and the byte was lost on writing."""
    raw = struct.pack("<2H2s", 6, 1, b"hi") + struct.pack("<I2s", 1, b"\0\n")
    df, a = one_section(spark, [raw])
    assert saved(rewrite.repacked(df, {"a": a}, ONE, ["k"]))[0] == raw


def test_numbers_turned(spark):
    from recordloom.functions import binary as B

    for size in (1, 2, 3, 4):
        values = [0, 1, 0x7F, 0x80, 0xFF, 2 ** (8 * size) - 1, 2 ** (8 * size - 1), 0x81FF7F03 % 2 ** (8 * size)]
        df = spark.createDataFrame([(i, v.to_bytes(size, "little") if v < 2 ** (8 * size) else b"") for i, v in enumerate(values)] + [(98, b""), (99, None)], "i int, c binary")
        got = {r.i: r.v for r in df.select("i", B.uint_le(F.col("c"), 0, size).alias("v")).collect()}
        assert got == {**dict(enumerate(values)), 98: None, 99: None}
    plan = df.where(B.uint_le(F.col("c"), 0, 2) > 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") <= 2 and plan.count("hex(") <= 2


def test_conditions_give_what_rows_give(spark):
    """Sections told by a condition: also with null and repeated keys, null and cut contents, several sections."""
    raw = words(10, 3, 40, 5) + b"gg" + a(9, 2) + a(9, 0) + a(9, 3) + bytes(6) + words(1, 2, 3, 4, 5) + b"tail"
    more = words(10, 1, 22, 2) + b"gg" + a(1, 2, b"hi") + b"zzzz" + words(5, 6) + b"tail"
    contents = list(zip([0, 1, 2, 3, 3, 4, None, None], [raw, words(0, 0, 0, 0), None, more, raw, raw[:35], raw, words(0, 0, 0, 0)]))
    df = decode.header(spark.createDataFrame(contents, "k int, content binary"), TWO)
    every, odd = lambda e: F.lit(True), lambda e: e["x"] % 2 == 1
    rows = {s: decode.entries(df, TWO, s, ["k"]) for s in ("a", "b")}
    for by_rows, told in (({**rows, "b": rows["b"].where("x % 2 = 1")}, {"a": every, "b": odd}), ({"b": rows["b"].where("x % 2 = 1")}, {"b": odd})):
        for write in (rewrite.repacked, rewrite.preserved):
            wanted, got = (write(df, x, TWO, ["k"]) for x in (by_rows, told))
            assert got.schema == wanted.schema
            assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    with pytest.raises(ValueError):
        rewrite.repacked(df, {**rows, "b": odd}, TWO, ["k"])


def test_resources_are_packed_once(spark):
    """Packing an order was the most of the work, and was done for the resource and for its entries again."""
    from recordloom.queries import writing

    for query in ("write_repacked", "write_preserved"):
        plan = writing.QUERIES[query][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_extendedprice#") > 0 and plan.count("Relation [l_orderkey") == 1 and plan.count("Join") == 1


def test_nearest(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.49999999999999994, -0.49999999999999994, 12.5, 1735.0000000000002, 4503599627370497.5, 9007199254740993.0, 1e17, 0.0, -0.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    from recordloom.functions import binary as B

    assert all(r.a == r.b for r in df.select(B.nearest(F.col("v")).cast("bigint").alias("a"), F.round("v").cast("bigint").alias("b")).collect())
