"""Raster joins: texture pages by name, tiles and blocks laid on pages, tile maps, grids.

Pixels are RGBA bytes, row by row. Each page is one row and meets what is drawn from it
by a join on its key; a frame is put together from its own blocks only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.raster import blocks_rgba

TILE = 64
#: Page number of a tile that is opaque black.
BLACK = -1
#: Version 2 texture header: 13 numbers, the mark at 44.
HEADER = 52
MARK_AT, MARK = 44, b"PVR!"
#: Version 3 texture header (fixed values of the format): its mark, size without metadata,
#: and the formats that are block-compressed.
HEADER_3, MARK_3 = 52, b"PVR\x03"
TEXTURE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())])


def inflated(raw: bytes) -> bytes:
    """What a texture file holds: zlib data after its size, zlib data alone, or plain; packed
    data that is zlib data again, with or without a size, is unpacked once more."""

    def once(data: bytes) -> bytes | None:
        for at in (4, 0):
            try:
                return zlib.decompress(data[at:])
            except zlib.error:
                continue
        return None

    first = once(raw)
    if first is not None:
        second = once(first)
        return first if second is None else second
    return raw[4:] if raw[4:8] == MARK_3 or raw[4 + MARK_AT : 8 + MARK_AT] == MARK else raw


def masked(body: bytes, width: int, height: int, size: int, masks: tuple[int, ...]) -> bytes:
    """Plain pixels of size bytes whose channels stand under masks; no alpha mask: opaque."""
    n = width * height
    raw = np.zeros(n * size, dtype=np.uint8)
    given = np.frombuffer(body[: n * size], dtype=np.uint8)
    raw[: len(given)] = given
    number = np.zeros(n, dtype=np.uint32)
    for k in range(size):
        number |= raw[k::size].astype(np.uint32) << np.uint32(8 * k)
    out = np.full((n, 4), 255, dtype=np.uint8)
    for k, mask in enumerate(masks):
        if mask:
            shift = (mask & -mask).bit_length() - 1
            most = mask >> shift
            out[:, k] = ((number & np.uint32(mask)) >> np.uint32(shift)).astype(np.uint64) * 255 // most
        elif k < 3:
            out[:, k] = 0
    return out.tobytes()


def texture(raw: bytes | None) -> tuple[int | None, int | None, bytes | None, str | None]:
    """(width, height, pixels, error) of a texture file, packed or not."""
    if raw is None:
        return None, None, None, None
    data = inflated(raw)
    u32 = lambda k: int.from_bytes(data[k : k + 4], "little")
    if data[:4] == MARK_3 and len(data) >= HEADER_3:
        height, width, body = u32(24), u32(28), data[HEADER_3 + u32(48) :]
        size, masks = 0, ()
    elif data[MARK_AT : MARK_AT + 4] == MARK:
        height, width, body = u32(4), u32(8), data[u32(0) :]
        masks = tuple(u32(28 + 4 * k) for k in range(4))
        size = u32(24) // 8 if u32(24) in (24, 32) and any(masks[:3]) else 0
    else:
        return None, None, None, "no texture header"
    if not width or not height:
        return width, height, b"", None
    if size:
        return width, height, masked(body, width, height, size, masks), None
    blocks = -(-width // 4) * -(-height // 4)
    # the amount of data tells the kind of blocks
    return width, height, blocks_rgba(body, width, height, len(body) >= 16 * blocks), None


@F.pandas_udf(TEXTURE)
def textures(content: pd.Series) -> pd.DataFrame:
    """Textures as width, height, pixels, or an error."""
    rows = pd.DataFrame([texture(raw) for raw in content], columns=TEXTURE.names)
    return rows.astype({"width": "Int32", "height": "Int32"})


def page_names(name: Column, page: Column) -> Column:
    """What the page of a tileset may be called, in order: its short name (the first letter, the
    third to sixth, and an N in seventh place) and two digits, its first six letters and two
    digits, the same in hexadecimal from ten on, MOS and four digits. No name comes twice."""
    name = F.upper(name)
    brief = F.concat(F.substring(name, 1, 1), F.substring(name, 3, 4), F.when(F.substring(name, 7, 1) == "N", "N").otherwise(""))
    two, hexed = F.lpad(page.cast("string"), 2, "0"), F.lpad(F.hex(page), 2, "0")
    two = F.when(page < 100, two).otherwise(page.cast("string"))
    six = F.when(F.length(name) >= 6, F.substring(name, 1, 6))
    plain = F.array(F.concat(brief, two), F.concat(six, two))
    more = F.when(page >= 10, F.array(F.concat(brief, hexed), F.concat(six, hexed))).otherwise(F.array().cast("array<string>"))
    number = F.when(page < 10000, F.lpad(page.cast("string"), 4, "0")).otherwise(page.cast("string"))
    return F.array_distinct(F.array_compact(F.concat(plain, more, F.array(F.concat(F.lit("MOS"), number)))))


def paged(wanted: DataFrame, pages: DataFrame, name: str = "resref", page: str = "page") -> DataFrame:
    """wanted with the page resource (page_resref) found first, null if there is none.

    pages: resref of the pages that exist, one row each.
    """
    need = wanted.select(name, page).distinct()
    tries = need.select(name, page, F.posexplode(page_names(F.col(name), F.col(page))).alias("rank", "try"))
    hits = tries.join(pages.select(F.upper("resref").alias("try"), F.col("resref").alias("page_resref")), "try")
    best = hits.groupBy(name, page).agg(F.min_by("page_resref", "rank").alias("page_resref"))
    return wanted.join(best, [name, page], "left")


def cut_out(pixels: bytes | None, width: int, height: int, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A rectangle of a page; what lies outside, or on a missing page, is transparent."""
    out = np.zeros((h, w, 4), dtype=np.uint8)
    if pixels is None or x < 0 or y < 0 or x >= width or y >= height:
        return out
    part = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 4)[y : y + h, x : x + w]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def page_tiles(tiles: DataFrame, pages: DataFrame, edge: int = TILE) -> DataFrame:
    """tiles with the column rgba: each tile cut from its page.

    tiles: page_key, page, x, y and more; pages: page_key, width, height, pixels. A page
    number of -1 is opaque black; a missing page is transparent.
    """
    both = tiles.join(pages.select("page_key", "width", "height", "pixels"), "page_key", "left")

    @F.pandas_udf(T.BinaryType())
    def tile(page: pd.Series, x: pd.Series, y: pd.Series, width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.Series:
        black = np.tile(np.array([0, 0, 0, 255], dtype=np.uint8), edge * edge).tobytes()
        rows = zip(page, x, y, width, height, pixels)
        return pd.Series([black if p == BLACK else cut_out(px, 0 if px is None else int(w), 0 if px is None else int(h), int(a), int(b), edge, edge).tobytes() for p, a, b, w, h, px in rows], dtype=object)

    return both.withColumn("rgba", tile("page", "x", "y", "width", "height", "pixels")).drop("width", "height", "pixels")


def composed(frames: DataFrame, blocks: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, width, height, rgba): frames put together from blocks of pages.

    frames: keys, width, height; blocks: keys, block (their order), page_key, source_x,
    source_y, block_width, block_height, target_x, target_y; pages as in page_tiles().
    Blocks are clipped at the frame's edges, later ones lie above earlier ones; blocks of a
    missing page leave it transparent. A block's part of its page is cut before the blocks
    of a frame meet, so that no page is sent there whole.
    """
    met = blocks.join(pages.select("page_key", "width", "height", "pixels"), "page_key", "inner")

    @F.pandas_udf(T.BinaryType())
    def part(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.Series:
        return pd.Series([cut_out(px, int(pw), int(ph), int(a), int(b), int(c), int(d)).tobytes() for a, b, c, d, pw, ph, px in zip(x, y, w, h, width, height, pixels)], dtype=object)

    piece = F.struct("block", "target_x", "target_y", "block_width", "block_height", F.col("part"))
    cut = met.withColumn("part", part("source_x", "source_y", "block_width", "block_height", "width", "height", "pixels"))
    held = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    both = frames.select(*keys, "width", "height").join(held, keys, "left")
    row = both.select(F.struct(*keys).alias("key"), "width", "height", "pieces")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = []
            for width, height, pieces in zip(batch["width"], batch["height"], batch["pieces"]):
                out = np.zeros((int(height), int(width), 4), dtype=np.uint8)
                for p in pieces if pieces is not None else ():
                    x, y, w, h = (int(p[k]) for k in ("target_x", "target_y", "block_width", "block_height"))
                    image = np.frombuffer(p["part"], dtype=np.uint8).reshape(h, w, 4)
                    left, top = max(x, 0), max(y, 0)
                    image = image[top - y : int(height) - y, left - x : int(width) - x] if x < width and y < height else image[:0]
                    out[top : top + image.shape[0], left : left + image.shape[1]] = image
                drawn.append(out.tobytes())
            yield batch[["key", "width", "height"]].assign(rgba=drawn)

    schema = T.StructType([row.schema["key"], row.schema["width"], row.schema["height"], T.StructField("rgba", T.BinaryType())])
    return row.mapInPandas(draw, schema).select("key.*", "width", "height", "rgba")


def mapped_tile(lookup: Column, start: Column, primary: Column) -> Column:
    """The tile of a map cell: an entry of the lookup list, -1 outside it."""
    at = (start + primary).cast("int")
    return F.when(at >= 0, F.coalesce(F.get(lookup, at), F.lit(-1))).otherwise(F.lit(-1))


def tile_validity(cells: DataFrame, keys: list[str], tile: str, count: str) -> DataFrame:
    """(keys, valid, outside, missing): how many cells have a tile that exists, one beyond
    the tileset, or none (-1)."""
    t, n = F.col(tile), F.col(count)
    return cells.groupBy(*keys).agg(F.count_if((t >= 0) & (t < n)).alias("valid"), F.count_if(t >= n).alias("outside"), F.count_if(t == -1).alias("missing"))


def visible(frames: Column) -> Column:
    """The frames (width, height, ...) of an array that are larger than one pixel."""
    return F.filter(frames, lambda f: (f["width"] > 1) | (f["height"] > 1))


#: Tiles in a row of a sheet by preference, and the longest side of a sheet in pixels.
COLUMNS, LONGEST = 10, 8192


def grid_width(tiles: Column, edge: Column | int = TILE, longest: int = LONGEST) -> Column:
    """Tiles in a row of a sheet: COLUMNS, unless a side would be longer than is safe; then as
    few as keep the height safe, up to what the width allows. Without tiles COLUMNS."""
    edge = F.lit(edge) if isinstance(edge, int) else edge
    most = F.greatest(F.floor(F.lit(longest) / edge), F.lit(1))
    fits = (F.lit(COLUMNS) <= most) & (F.ceil(tiles / F.lit(float(COLUMNS))) <= most)
    narrow = F.least(F.greatest(F.ceil(tiles / most), F.lit(1)), most)
    return F.when(fits | (tiles <= 0) | (edge <= 0), COLUMNS).otherwise(narrow).cast("int")


def stitched(tiles: DataFrame, keys: list[str], edge: int = TILE) -> DataFrame:
    """(keys, width, height, rgba): a sheet of tiles (keys, place, columns, rgba) row by row.

    Places without a tile are transparent.
    """
    row = tiles.groupBy(*keys).agg(F.max("columns").alias("columns"), F.array_sort(F.collect_list(F.struct("place", "rgba"))).alias("tiles"))
    row = row.select(F.struct(*keys).alias("key"), "columns", "tiles")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for columns, held in zip(batch["columns"], batch["tiles"]):
                lines = int(held[-1]["place"]) // int(columns) + 1
                sheet = np.zeros((lines * edge, int(columns) * edge, 4), dtype=np.uint8)
                for t in held:
                    y, x = divmod(int(t["place"]), int(columns))
                    if t["rgba"] is not None:
                        sheet[y * edge : (y + 1) * edge, x * edge : (x + 1) * edge] = np.frombuffer(t["rgba"], dtype=np.uint8).reshape(edge, edge, 4)
                out.append((sheet.shape[1], sheet.shape[0], sheet.tobytes()))
            yield pd.DataFrame({"key": batch["key"], "width": [o[0] for o in out], "height": [o[1] for o in out], "rgba": [o[2] for o in out]})

    schema = T.StructType([row.schema["key"], T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgba", T.BinaryType())])
    return row.mapInPandas(draw, schema).select("key.*", "width", "height", "rgba")


def scaled_down(pixels: bytes, width: int, height: int, most: int) -> tuple[int, int, bytes]:
    """The nearest pixels of a picture no side of which is longer than most."""
    if max(width, height) <= most:
        return width, height, pixels
    part = most / max(width, height)
    w, h = max(1, int(width * part)), max(1, int(height * part))
    y, x = np.arange(h) * height // h, np.arange(w) * width // w
    return w, h, np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 4)[y][:, x].tobytes()
