"""Field types, displays and expressions against bytes built with struct."""

import struct

import pytest
from pyspark.sql import functions as F

from recordloom.functions import binary as B
from recordloom.functions.expression import compiled
from recordloom.operators import decode, encode
from recordloom.plans.layout import Registry, layout


def one(spark, raw, *cols):
    return spark.createDataFrame([(bytearray(raw),)], "c binary").select(*cols).first()


def test_integers(spark):
    raw = struct.pack("<BHIbhiQ", 250, 65000, 4_000_000_000, -5, -2, -70000, 2**63 + 5)
    c = F.col("c")
    got = one(spark, raw, B.uint_le(c, 0, 1), B.uint_le(c, 1, 2), B.uint_le(c, 3, 4), B.sint_le(c, 7, 1), B.sint_le(c, 8, 2), B.sint_le(c, 10, 4), B.uint_le(c, 14, 8), B.uint_le(c, 20, 4))
    assert list(got)[:6] == [250, 65000, 4_000_000_000, -5, -2, -70000]
    assert int(got[6]) == 2**63 + 5
    assert got[7] is None  # past the end


@pytest.mark.parametrize("value,size", [(0, 1), (255, 1), (-1, 2), (65535, 2), (-2, 4), (4294967295, 4), (1 << 40, 6)])
def test_encoding_inverts_decoding(spark, value, size):
    raw = bytes(spark.range(1).select(B.bytes_le(F.lit(value), size)).first()[0])
    assert raw == (value % (1 << 8 * size)).to_bytes(size, "little")


def test_text_and_names(spark):
    c = F.col("c")
    assert one(spark, b"II083\0\0\0", B.text_at(c, 0, 8))[0] == "II083"
    assert one(spark, b"ab\0cd\0\0", B.cstring(c))[0] == "ab"
    assert one(spark, b"a\x01\0zz", B.cstring(c))[0] == "<binary data: 61 01>"
    assert one(spark, b"", B.bytes_shown(c))[0] == ""
    assert one(spark, bytes(9), B.bytes_shown(c))[0] == "<zeroed (9 bytes)>"
    assert one(spark, b"\x01\xff", B.bytes_shown(c))[0] == "0x01ff"
    assert one(spark, b"\0abc", B.name_shown(c))[0] is None
    assert one(spark, b"\xe9\x01\0", B.name_shown(c))[0] == "<non-text resref:e901>"
    assert one(spark, b" sw1h01 \0x", B.name_key(F.decode(c, "ISO-8859-1")))[0] == "SW1H01"


def test_sentinels_flags_labels(spark):
    v = F.lit(65535).cast("bigint")
    row = spark.range(1).select(
        B.sentinel(v, 2), B.sentinel(F.lit(5).cast("bigint"), 2), B.label(F.lit(4).cast("bigint"), {4: "ALLY"}), B.label(F.lit(9).cast("bigint"), {4: "ALLY"}),
        B.flags(F.lit(0b1011).cast("bigint"), {"a": 1, "b": 4}), B.bit_parts(F.lit(0x1F34).cast("bigint"), {"low": (0, 0xFF), "high": (8, 0xF)}),
    ).first()
    assert row[:4] == (-1, 5, "ALLY", "9")
    assert row[4].asDict() == {"a": True, "b": False, "_unknown": 0b1010}
    assert row[5].asDict() == {"low": 0x34, "high": 0xF, "_unknown": 0x1000}


def test_reference_display(spark):
    rows = spark.createDataFrame([(123, "text:123"), (5, ""), (7, None)], "n long, t string").select(B.reference_shown(F.col("n"), F.col("t"))).collect()
    assert [r[0] for r in rows] == ["(123) text:123", "(5)", "7"]


@pytest.mark.parametrize("text,want", [("a // b", -4), ("a % b", 1), ("a / 2", -3.5), ("a * b + 1", -13), ("(a - b) // 2", -5)])
def test_expressions_round_as_python(spark, text, want):
    assert spark.range(1).select(compiled(text, {"a": F.lit(-7), "b": F.lit(2)})).first()[0] == want


@pytest.mark.parametrize("text", ["a == 1", "-a", "a and b", "f(a)", "c + 1"])
def test_expressions_refuse(spark, text):
    with pytest.raises(ValueError):
        compiled(text, {"a": F.lit(1), "b": F.lit(2)})


def test_first_difference(spark):
    for a, b, want in [(b"abc", b"abc", None), (b"abc", b"abd", 2), (b"ab", b"abc", 2), (b"", b"", None), (b"x" * 9000, b"x" * 8999 + b"y", 8999)]:
        got = spark.createDataFrame([(bytearray(a), bytearray(b))], "a binary, b binary").select(B.first_difference(F.col("a"), F.col("b"))).first()[0]
        assert got == want


SWORD = {
    "name": "SWORD",
    "games": ["G1"],
    "sections": {
        "header": {
            "fields": [
                {"name": "signature", "type": "char_array", "size": 4},
                {"name": "flags", "type": "bitmask", "flags": {1: "critical", 4: "cursed"}},
                {"name": "kind", "type": "enum", "values": {1: "axe", 2: "bow"}},
                {"name": "price", "type": "sdword"},
                {"name": "icon", "type": "resref"},
                {"name": "title", "type": "strref"},
                {"name": "effect_offset", "type": "dword"},
                {"name": "effect_count", "type": "word"},
                {"name": "double_price", "type": "computed", "expr": "price * 2"},
            ]
        },
        "effects": {"offset_field": "effect_offset", "count": "effect_count", "fields": [{"name": "opcode", "type": "word"}, {"name": "slots", "type": "word_array", "count": 2}]},
    },
}


def sword(effects, offset=None):
    head = struct.pack("<4sIHi8sIIH", b"ITM ", 5 | 32, 2, -9, b"icon\0\0\0\0", 0, 32 if offset is None else offset, len(effects))
    return head + b"".join(struct.pack("<H2H", *e) for e in effects)


def test_layout_decode_and_encode(spark):
    x = layout(SWORD)
    raws = [sword([(7, 1, 2), (8, 3, 65535)]), sword([]), sword([(1, 1, 1)], offset=0)]
    df = decode.header(spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "id int, content binary"), x)
    v = df.orderBy("id").first()["values"].asDict(recursive=True)
    assert v["flags"] == {"critical": True, "cursed": True, "_unknown": 32} and v["kind"] == "bow" and v["price"] == -9 and v["icon"] == "icon" and v["title"] is None and v["double_price"] == -18
    rows = decode.entries(df, x, "effects", ["id"]).orderBy("id", "entry")
    # a counted section at offset zero is read there
    assert [(r.id, r.entry, r.opcode, list(r.slots)) for r in rows.collect()] == [(0, 0, 7, [1, 2]), (0, 1, 8, [3, 65535]), (2, 0, 21577, [8269, 37])]
    saved = encode.entry_bytes(x.header, {f.name: F.col("values")[f.name] for f in x.header.fields})
    assert bytes(df.where("id = 1").select(saved).first()[0]) == raws[1]
    body = encode.joined(rows, ["id"], ["entry"], encode.entry_bytes(x.sections[1], {"opcode": F.col("opcode"), "slots": F.col("slots")}))
    assert bytes(body.where("id = 0").first()["body"]) == raws[0][32:]
    rest = decode.trailing(F.col("content"), F.lit(32))
    assert [r[0] is None for r in df.orderBy("id").select(rest).collect()] == [False, True, False]


def test_layout_rules():
    bad = lambda change: layout({**SWORD, "sections": {**SWORD["sections"], **change}})
    with pytest.raises(ValueError, match="two fields"):
        bad({"effects": {"offset_field": "effect_offset", "fields": [{"name": "a", "type": "byte"}, {"name": "a", "type": "byte"}]}})
    with pytest.raises(ValueError, match="offset field"):
        bad({"effects": {"offset_field": "nowhere", "fields": [{"name": "a", "type": "byte"}]}})
    with pytest.raises(ValueError, match="declared at"):
        bad({"effects": {"offset_field": "effect_offset", "fields": [{"name": "a", "type": "byte", "offset": 3}]}})
    with pytest.raises(ValueError, match="no type"):
        bad({"effects": {"offset_field": "effect_offset", "fields": [{"name": "a", "type": "quux"}]}})
    r = Registry([layout(SWORD)])
    assert r.get("SWORD", "G1") is not None and r.get("SWORD", "G2") is None and r.get("SWORD") is None


def test_first_difference_of_short_blobs(spark):
    """The bytes of a short block are looked at, not 4096 places of each."""
    import time

    rows = spark.range(0, 20_000, 1, 1).select(F.encode(F.lpad(F.col("id").cast("string"), 8, "a"), "UTF-8").alias("a"))
    rows = rows.select("a", F.concat(F.substring("a", 1, 7), F.lit(b"x")).alias("b"))
    start = time.monotonic()
    got = rows.select(B.first_difference(F.col("a"), F.col("b")).alias("d")).groupBy("d").count().collect()
    assert [tuple(r) for r in got] == [(7, 20_000)] and time.monotonic() - start < 15
