"""Raster joins, from built bytes and against plain loops."""

import struct
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from recordloom.functions import raster as pixels
from recordloom.operators import raster


def picture(width, height, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 4), dtype=np.uint8)


def version_2(pixels):
    height, width = pixels.shape[:2]
    head = struct.pack("<11I4sI", 52, height, width, 1, 0, width * height * 4, 32, 0xFF, 0xFF00, 0xFF0000, 0xFF000000, b"PVR!", 1)
    return head + pixels.tobytes()


def test_textures(spark):
    raw = version_2(picture(2, 2))
    packed = zlib.compress(raw)
    block = struct.pack("<HHI", 0xF800, 0x001F, 0)
    v3 = b"PVR\x03" + struct.pack("<IQIIIIIIIII", 0, 7, 0, 0, 4, 4, 1, 1, 1, 1, 0) + block
    files = [raw, packed, struct.pack("<I", len(raw)) + packed, v3, b"nothing", None]
    rows = spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in enumerate(files)], "k int, c binary").select("k", raster.textures("c").alias("t")).orderBy("k").collect()
    for r in rows[:3]:
        assert (r.t.width, r.t.height, bytes(r.t.pixels)) == (2, 2, picture(2, 2).tobytes())
    red = np.frombuffer(bytes(rows[3].t.pixels), dtype=np.uint8).reshape(4, 4, 4)
    assert (red == (255, 0, 0, 255)).all()
    assert rows[4].t.error and rows[4].t.pixels is None and rows[5].t.pixels is None


def test_masks_of_three_bytes():
    assert raster.masked(bytes([1, 2, 3]), 1, 1, 3, (0xFF0000, 0xFF00, 0xFF, 0)) == bytes([3, 2, 1, 255])
    assert raster.masked(b"", 1, 1, 4, (0xFF, 0xFF00, 0xFF0000, 0xFF000000)) == bytes(4)


def test_page_names_and_the_first_that_exists(spark):
    wanted = spark.createDataFrame([("AR0100N", 3), ("AR0100N", 12), ("AR0100N", 99)], "resref string, page int")
    names = {r.page: r.n for r in wanted.select("page", raster.page_names(F.col("resref"), F.col("page")).alias("n")).collect()}
    assert names[3] == ["A0100N03", "AR010003", "MOS0003"]
    assert names[12] == ["A0100N12", "AR010012", "A0100N0C", "AR01000C", "MOS0012"]
    pages = spark.createDataFrame([("AR010003",), ("MOS0003",), ("ar01000c",), ("MOS0012",)], "resref string")
    got = {r.page: r.page_resref for r in raster.paged(wanted, pages).collect()}
    assert got == {3: "AR010003", 12: "ar01000c", 99: None}


def page_rows(spark):
    p = picture(8, 6, 1)
    return p, spark.createDataFrame([("P", 8, 6, bytearray(p.tobytes()))], "page_key string, width int, height int, pixels binary")


def test_page_tiles(spark):
    page, pages = page_rows(spark)
    tiles = spark.createDataFrame([(0, "P", 1, 2, 1), (1, "P", 1, 6, 4), (2, None, -1, 0, 0), (3, "Q", 7, 0, 0)], "place int, page_key string, page int, x int, y int")
    got = {r.place: np.frombuffer(bytes(r.rgba), dtype=np.uint8).reshape(4, 4, 4) for r in raster.page_tiles(tiles, pages, edge=4).collect()}
    assert (got[0] == page[1:5, 2:6]).all()
    assert (got[1][:2, :2] == page[4:6, 6:8]).all() and not got[1][2:].any()
    assert (got[2] == (0, 0, 0, 255)).all() and not got[3].any()


def test_frames_of_blocks(spark):
    page, pages = page_rows(spark)
    frames = spark.createDataFrame([("A", 0, 5, 4), ("A", 1, 2, 2)], "resref string, frame int, width int, height int")
    blocks = [("A", 0, 0, "P", 0, 0, 3, 3, 0, 0), ("A", 0, 1, "P", 4, 2, 3, 3, 1, 2), ("A", 0, 2, "P", 0, 0, 3, 3, -1, -2), ("A", 0, 3, "Q", 0, 0, 5, 4, 0, 0), ("A", 0, 4, "P", 0, 0, 1, 1, 9, 9)]
    schema = "resref string, frame int, block int, page_key string, source_x int, source_y int, block_width int, block_height int, target_x int, target_y int"
    got = {r.frame: r for r in raster.composed(frames, spark.createDataFrame(blocks, schema), pages, ["resref", "frame"]).collect()}
    want = np.zeros((4, 5, 4), dtype=np.uint8)
    for _, _, _, key, sx, sy, w, h, tx, ty in blocks:
        for y in range(h):
            for x in range(w):
                if key == "P" and 0 <= ty + y < 4 and 0 <= tx + x < 5:
                    want[ty + y, tx + x] = page[sy + y, sx + x]
    assert (np.frombuffer(bytes(got[0].rgba), dtype=np.uint8).reshape(4, 5, 4) == want).all()
    assert bytes(got[1].rgba) == bytes(16) and got[1].width == 2


def test_sheets(spark):
    a, b = picture(2, 2, 3), picture(2, 2, 4)
    tiles = spark.createDataFrame([("T", 0, 2, bytearray(a.tobytes())), ("T", 3, 2, bytearray(b.tobytes())), ("T", 1, 2, None)], "resref string, place int, columns int, rgba binary")
    r = raster.stitched(tiles, ["resref"], edge=2).first()
    sheet = np.frombuffer(bytes(r.rgba), dtype=np.uint8).reshape(r.height, r.width, 4)
    assert sheet.shape == (4, 4, 4) and (sheet[:2, :2] == a).all() and (sheet[2:, 2:] == b).all()
    assert not sheet[:2, 2:].any() and not sheet[2:, :2].any()


def test_tile_maps(spark):
    cells = spark.createDataFrame([(1, [4, 9], 0, 1), (1, [4, 9], 1, 1), (1, [4, 9], 0, 0), (2, None, 0, 0)], "wed int, lookup array<int>, start int, cell int")
    rows = cells.withColumn("tile", raster.mapped_tile(F.col("lookup"), F.col("start"), F.col("cell"))).withColumn("n", F.lit(5))
    assert [r.tile for r in rows.collect()] == [9, -1, 4, -1]
    got = {r.wed: (r.valid, r.outside, r.missing) for r in raster.tile_validity(rows, ["wed"], "tile", "n").collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 1)}


@pytest.mark.parametrize(("tiles", "edge", "width"), [(0, 64, 10), (1280, 64, 10), (1281, 64, 11), (20000, 64, 128), (60, 1024, 8), (5, 4096, 2), (5, 2048, 2)])
def test_grid_width(spark, tiles, edge, width):
    row = spark.createDataFrame([(tiles, edge)], "n int, w int")
    assert row.select(raster.grid_width(F.col("n"), F.col("w")).alias("g")).first().g == width


def test_packed_twice():
    import zlib

    raw = b"plain bytes of a texture"
    once, sized = zlib.compress(raw), lambda x: len(x).to_bytes(4, "little") + x
    assert raster.inflated(once) == raster.inflated(sized(once)) == raster.inflated(zlib.compress(once)) == raster.inflated(sized(zlib.compress(sized(once)))) == raw


def test_scaled_down():
    p = picture(8, 4)
    assert raster.scaled_down(p.tobytes(), 8, 4, 8) == (8, 4, p.tobytes())
    w, h, out = raster.scaled_down(p.tobytes(), 8, 4, 4)
    assert (w, h) == (4, 2) and (np.frombuffer(out, dtype=np.uint8).reshape(2, 4, 4) == p[::2, ::2]).all()


def test_pixels():
    assert pixels.pixels_rgba(bytes([1, 2, 3, 4]), 1, 1, 32) == bytes([1, 2, 3, 4])
    assert pixels.pixels_rgba(bytes([1, 2, 3, 4]), 1, 1, 32, pixels.BGRA_MASKS) == bytes([3, 2, 1, 4])
    assert pixels.pixels_rgba(bytes([1, 2, 3, 4]), 1, 1, 32, (0xFF000000, 0xFF00, 0xFF, 0)) == bytes([4, 2, 1, 255])
    assert pixels.pixels_rgba(bytes([1, 2, 3]), 1, 1, 24) == bytes([1, 2, 3, 255])
    assert pixels.pixels_rgba(b"abc", 1, 1, 32) is None and pixels.pixels_rgba(b"ab", 1, 1, 16) is None


def test_surfaces(spark):
    head = lambda kind: b"DDS " + bytes(8) + struct.pack("<II", 4, 4) + bytes(64) + kind + bytes(40)
    red = struct.pack("<HHI", 0xF800, 0, 0)
    rows = [(0, head(b"DXT1") + red), (1, head(b"DXT5") + bytes([255, 0, 0, 0, 0, 0, 0, 0]) + red), (2, head(b"DX10") + red), (3, b"DDS "), (4, None)]
    df = spark.createDataFrame(rows, "k int, raw binary").select("k", pixels.surface_rgba("raw").alias("s")).select("k", "s.*")
    got = {r.k: (r.width, r.height, r.rgba and bytes(r.rgba), r.error) for r in df.collect()}
    assert got[0] == got[1] == (4, 4, bytes([255, 0, 0, 255]) * 16, None)
    assert got[2] == (4, 4, None, "unknown format DX10") and got[3] == (None, None, None, "shorter than its header") and got[4] == (None,) * 4
