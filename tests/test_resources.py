"""Archives, key files, lookup tables, string tables, search and rasters, from built bytes."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.functions import raster
from recordloom.operators import audit, catalog, lookup, search
from recordloom.sources import files as sources


def archive(files=(), tiles=()):
    at = 20 + 16 * len(files) + 20 * len(tiles)
    table, body = b"", b""
    for i, f in enumerate(files):
        table += struct.pack("<IIIHH", i, at + len(body), len(f), 0x3ED, 0)
        body += f
    for i, (n, size, t) in enumerate(tiles):
        table += struct.pack("<IIIIHH", (i + 1) << 14, at + len(body), n, size, 0x3EB, 0)
        body += t
    return struct.pack("<4s4sIII", b"BIFF", b"V1  ", len(files), len(tiles), 20) + table + body


def key_file(names, archives):
    at = 24 + 12 * len(archives)
    text = b"".join(a.encode() + b"\0" for a in archives)
    head = struct.pack("<4s4sIIII", b"KEY ", b"V1  ", len(archives), len(names), 24, at + len(text))
    offset, rows = at, b""
    for a in archives:
        rows += struct.pack("<IIHH", 0, offset, len(a) + 1, 1)
        offset += len(a) + 1
    return head + rows + text + b"".join(struct.pack("<8sHI", n.encode(), t, loc) for n, t, loc in names)


def test_catalog_end_to_end(spark):
    plain = archive([b"first", b"second"], [(2, 3, b"abcdef")])
    wrapped = b"BIF V1.0" + struct.pack("<I", 4) + b"abc\0" + struct.pack("<II", len(plain), 0) + zlib.compress(plain)
    blocks = b"BIFCV1.0" + struct.pack("<I", len(plain)) + b"".join(struct.pack("<II", len(p), len(z := zlib.compress(p))) + z for p in (plain[:30], plain[30:])) + bytes(8)
    key = key_file([("sw1", 0x3ED, 1 | 0 << 20), ("SW1", 0x3ED, 0 | 1 << 20), ("ti", 0x3EB, 0 | 2 << 20), ("zz", 0x7777, 9 | 0 << 20), ("", 1, 0), ("bad", 0x3ED, 3 << 20)], ["C:\\data\\a.bif", "./b.bif", "c.bif", "d.bif"])
    keys = spark.createDataFrame([("G", bytearray(key))], "game string, content binary")
    entries = catalog.key_entries(keys)
    assert [(r.resref, r.res_type) for r in entries.orderBy("entry").collect()] == [("SW1", "ITM"), ("SW1", "ITM"), ("TI", "TIS"), ("ZZ", "UNKN"), ("BAD", "ITM")]
    assert [r.file for r in catalog.key_archives(keys).orderBy("bif_index").collect()] == ["data/a.bif", "b.bif", "c.bif", "d.bif"]
    packed = [("G", 0, bytearray(plain)), ("G", 1, bytearray(wrapped)), ("G", 2, bytearray(blocks)), ("G", 3, bytearray(b"NOPE"))]
    got = catalog.contents(entries, spark.createDataFrame(packed, "game string, bif_index long, content binary")).orderBy("entry").collect()
    assert bytes(got[0].content) == b"second" and bytes(got[1].content) == b"first"
    assert bytes(got[2].content) == struct.pack("<4s4sIIII", b"TIS ", b"V1  ", 2, 3, 24, 64) + b"abcdef"
    assert got[3].content is None and got[4].content is None and "unknown archive" in got[4].error
    assert catalog.first_entry(entries, "sw1").first().entry == 0 and catalog.first_entry(entries, "sw1", "TIS").count() == 0


def test_large_key_file(spark):
    """Entries of one large file cost no copy of the file each (60,000 of them: minutes)."""
    import time

    n = 60_000
    key = key_file([(f"r{k}", 0x3ED, k % 16384) for k in range(n)], ["a.bif"])
    keys = spark.createDataFrame([("G", bytearray(key))], "game string, content binary")
    start = time.monotonic()
    got = catalog.key_entries(keys).agg(F.count("*"), F.sum("entry"), F.max_by("resref", "entry"), F.sum("resource_index")).first()
    assert tuple(got) == (n, n * (n - 1) // 2, f"R{n - 1}", sum(k % 16384 for k in range(n)))
    assert time.monotonic() - start < 30


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("AB", "ITM", bytearray(b"xyz")), ("CD", "SPL", bytearray(b"q"))], "resref string, res_type string, content binary")
    assert all(r.error is None for r in catalog.saved(rows, str(tmp_path / "override")).collect())
    back = sources.resources(spark, str(tmp_path / "override"))
    assert {(r.resref, r.res_type, bytes(r.content)) for r in back.collect()} == {("AB", "ITM", b"xyz"), ("CD", "SPL", b"q")}


def test_symbol_lists(spark):
    text = "IDS V1.0\n10\n4 ALLY // friend\n0x0100 CHUNKS\n4 FRIEND\nbad\n-1 ANY\n010 NO\n"
    listed = lookup.symbols(spark.createDataFrame([("EA", text)], "file string, text string"), ["file"])
    assert {(r.value, r.symbol) for r in lookup.forward(listed, ["file"]).collect()} == {(4, "FRIEND"), (256, "CHUNKS"), (-1, "ANY")}
    assert {(r.symbol, r.value) for r in lookup.backward(listed, ["file"]).collect()} == {("ALLY", 4), ("FRIEND", 4), ("CHUNKS", 256), ("ANY", -1)}


def test_two_dimensional_tables(spark):
    text = "2DA V1.0\nDEFAULT\nNAME VALUE\n0 ALPHA 1\n1\n2 GAMMA 3 EXTRA\n"
    rows = lookup.cells(spark.createDataFrame([("T", text), ("U", "no table")], "file string, text string"), ["file"]).collect()
    got = {(r.row_label, r.column): r.cell for r in rows}
    assert got == {("0", "NAME"): "ALPHA", ("0", "VALUE"): "1", ("1", "NAME"): "DEFAULT", ("1", "VALUE"): "DEFAULT", ("2", "NAME"): "GAMMA", ("2", "VALUE"): "3"}


def test_ciphered_text(spark):
    key, plain = bytes(range(1, 65)), b"IDS V1.0\r\n0 TEST\r\n" * 5
    raw = b"\xff\xff" + bytes(c ^ key[i % 64] for i, c in enumerate(plain))
    df = spark.createDataFrame([(bytearray(raw),), (bytearray(b"plain"),)], "c binary")
    assert [r[0] for r in df.select(lookup.deciphered(F.col("c"), key)).collect()] == [plain.decode(), "plain"]


@pytest.mark.parametrize("relative", [True, False])
def test_string_tables(spark, relative):
    base = 18 + 26 * 2
    block = b"Hello".ljust(80, b"\0") + b"World" + bytes(115)
    at = [0, 80] if relative else [base, base + 80]
    raw = struct.pack("<4s4sHII", b"TLK ", b"V1  ", 0, 2, base) + b"".join(struct.pack("<H8sIIII", 1, b"snd", 0, 0, a, 5) for a in at) + block
    df = spark.createDataFrame([("G", bytearray(raw)), ("H", bytearray(b"short"))], "game string, content binary")
    got = lookup.strings(df, ["game"]).orderBy("strref").collect()
    assert [(r.strref, r.text, r.relative, r.sound) for r in got] == [(0, "Hello", relative, "snd"), (1, "World", relative, "snd")]


def test_filter_language_drops_or_refuses_bad_clauses(spark):
    assert [c.op for c in search.parsed("a = 1 AND b.c >= 'x y' and nonsense")[0]] == ["=", ">="]
    assert search.parsed("nonsense")[1] == ["nonsense"]
    with pytest.raises(ValueError):
        search.parsed("nonsense", strict=True)


def test_filter_language_on_nested_rows(spark):
    rows = [("A", "ITM", "Axe", [(True, None, [1, 2])]), ("B", "ITM", "Bow", [(False, "x", [])])]
    index = spark.createDataFrame(rows, "resref string, restype string, display_name string, header array<struct<cursed:boolean,note:string,levels:array<int>>>")
    found = lambda text, **kw: [r.resref for r in search.where(index, text, **kw).orderBy("resref").collect()]
    assert found("header.cursed = true") == ["A"]
    assert found("header.cursed >= 1") == ["A"]
    assert found("header.note = none") == ["A"]  # a present null reads as none
    assert found("header.levels > 1") == ["A"]
    assert found("header.levels != 1") == ["A"]
    assert found("header.levels != 1", strict=True) == []
    assert found("header.absent != 1") == []
    assert found("name ~ ow and type = itm") == ["B"]
    assert found("header.note > 1") == []


def test_saved_index_depends_on_fingerprint(spark, tmp_path):
    index = spark.createDataFrame([("G", "ITM", "A")], "game string, restype string, resref string")
    path = str(tmp_path / "index")
    assert search.cached(spark, path, "f1") is None
    search.written(index, path, "f1")
    assert search.cached(spark, path, "f1").count() == 1 and search.cached(spark, path, "f2") is None


def test_merging_over_stretches(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 3, 400), rng.integers(0, 3000, 400), rng.integers(0, 12, 400))]
    df = spark.createDataFrame(rows, "k int, start long, end long")
    for stretch in (64, 10_000):
        got = {(r.k, r.start, r.end) for r in audit.merged(df, ["k"], stretch).collect()}
        want = set()
        for k in range(3):
            now = None
            for s, e in sorted((s, e) for q, s, e in rows if q == k and e > s):
                if now and s <= now[1]:
                    now[1] = max(now[1], e)
                else:
                    now and want.add((k, *now))
                    now = [s, e]
            want.add((k, *now))
        assert got == want


def test_block_texture():
    block = struct.pack("<HHI", 0xF800, 0x001F, 0)
    image = np.frombuffer(raster.blocks_rgba(block, 4, 4, False), dtype=np.uint8).reshape(4, 4, 4)
    assert (image == [255, 0, 0, 255]).all()
    clear = struct.pack("<HHI", 0x001F, 0xF800, 0xFFFFFFFF)
    assert (np.frombuffer(raster.blocks_rgba(clear, 4, 4, False), dtype=np.uint8).reshape(-1, 4)[:, 3] == 0).all()
    assert len(raster.blocks_rgba(b"", 6, 5, True)) == 6 * 5 * 4


def test_tiles_and_frames(spark):
    palette = bytearray(1024)
    palette[4:8] = bytes((0, 0, 255, 0))
    tile = bytes(palette) + bytes([1]) * 4096
    rgba = bytes(spark.createDataFrame([(bytearray(tile),)], "t binary").select(raster.tile_rgba("t")).first()[0])
    assert len(rgba) == 64 * 64 * 4 and tuple(rgba[:4]) == (255, 0, 0, 255)
    assert bytes(raster.run_lengths(bytes([5, 0, 2, 7, 0]), 0, 6)) == bytes([5, 0, 0, 0, 7, 0])
    row = spark.createDataFrame([(bytearray([1, 0, 1]), palette, 3, 1, True, 0)], "d binary, p binary, w int, h int, r boolean, m int")
    frame = bytes(row.select(raster.frame_rgba("d", "p", "w", "h", "r", "m")).first()[0])
    assert frame[:4] == bytes((255, 0, 0, 255)) and frame[4:8] == frame[8:12] == bytes(4)


def test_byte_profile_holds_few_texts():
    """A batch is not held a second time as Python objects."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(2002)), pa.array([bytes(10_000) + b"\xff\x01" * 5000] * 2000 + [None, b""])], ["key", "raw"])
    tracemalloc.start()
    got = pa.Table.from_batches(list(audit.profiled(iter([batch])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6
    assert {k: got[0][k] for k in ("size", "zeros", "ffs", "distinct_bytes")} == {"size": 20_000, "zeros": 10_000, "ffs": 5000, "distinct_bytes": 3}
    assert got[2000]["size"] is None and got[2001]["size"] == 0 and [r["key"] for r in got] == list(range(2002))


def test_claims_given_twice(spark):
    """Equal claims, which the order by start and end leaves in any order, change no union."""
    rows = [(k, s, e) for k in range(20) for s, e in [(0, 5), (0, 5), (5, 5), (10, 20), (10, 20), (10, 20), (12, 13), (30, 31), (30, 31)]]
    got = audit.merged(spark.createDataFrame(rows, "k int, start long, end long"), ["k"], stretch=16).collect()
    assert sorted((r.k, r.start, r.end) for r in got) == [(k, s, e) for k in range(20) for s, e in [(0, 5), (10, 20), (30, 31)]]
