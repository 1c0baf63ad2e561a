"""Raster decoding: run lengths, palettes, tiles and block textures to RGBA bytes.

One row is one frame, tile or texture; each function is a vectorised UDF over rows with
NumPy inside, as Spark has no functions for pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 64


def palette_rgba(raw: bytes, green_is_clear: bool = True) -> np.ndarray:
    """256 BGRA entries as RGBA, alpha full; the clear colour (pure green, first one) zeroed."""
    bgra = np.frombuffer(raw[:1024].ljust(1024, b"\0"), dtype=np.uint8).reshape(256, 4)
    rgba = bgra[:, [2, 1, 0, 3]].copy()
    rgba[:, 3] = 255
    if green_is_clear:
        green = np.flatnonzero((bgra[:, 0] == 0) & (bgra[:, 1] == 255) & (bgra[:, 2] == 0))
        clear = green[0] if len(green) else 0 if bgra[0, 3] == 0 else None
        if clear is not None:
            rgba[clear] = 0
    return rgba


def run_lengths(raw: bytes, marker: int, n: int) -> np.ndarray:
    """Indices from run-length data: the marker and a count c stand for c + 1 markers."""
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < n:
        if raw[at] != marker:
            to = raw.find(bytes([marker]), at)
            to = len(raw) if to < 0 else to
            out += raw[at:to]
            at = to
        else:
            out += bytes([marker]) * ((raw[at + 1] if at + 1 < len(raw) else 0) + 1)
            at += 2
    return np.frombuffer(bytes(out[:n]).ljust(n, b"\0"), dtype=np.uint8)


@F.pandas_udf(T.BinaryType())
def frame_rgba(data: pd.Series, palette: pd.Series, width: pd.Series, height: pd.Series, packed: pd.Series, marker: pd.Series) -> pd.Series:
    """Sprite frames: palette indices, run-length packed or not, as RGBA."""
    out = []
    for raw, colours, w, h, rle, m in zip(data, palette, width, height, packed, marker):
        n = int(w) * int(h)
        index = run_lengths(raw, int(m), n) if rle else np.frombuffer(raw[:n].ljust(n, b"\0"), dtype=np.uint8)
        out.append(palette_rgba(colours)[index].tobytes())
    return pd.Series(out)


@F.pandas_udf(T.BinaryType())
def tile_rgba(tile: pd.Series) -> pd.Series:
    """Palette tiles of 5120 bytes as 64 x 64 RGBA; index 0 is clear but keeps its colour."""

    def one(raw: bytes) -> bytes | None:
        if raw is None or len(raw) < 1024 + TILE * TILE:
            return None
        colours = palette_rgba(raw, green_is_clear=False)
        colours[0, 3] = 0
        return colours[np.frombuffer(raw, dtype=np.uint8, count=TILE * TILE, offset=1024)].tobytes()

    return tile.map(one)


def colours_565(c: np.ndarray) -> np.ndarray:
    """16-bit colours as RGB of 8 bits a channel."""
    r, g, b = c >> 11, (c >> 5) & 63, c & 31
    return np.stack([r * 255 // 31, g * 255 // 63, b * 255 // 31], axis=-1)


def blocks_rgba(raw: bytes, width: int, height: int, alpha: bool) -> bytes:
    """Block textures: 8 bytes a block of 4 x 4, or 16 with interpolated alpha; all of it is
    transparent where the data is short."""
    size, across, down = (16 if alpha else 8), -(-width // 4), -(-height // 4)
    if len(raw) < size * across * down:
        return bytes(4 * width * height)
    data = np.frombuffer(raw[: size * across * down], dtype=np.uint8).reshape(-1, size)
    colour = data[:, size - 8 :]
    ends = colour[:, :4].copy().view("<u2").astype(np.int64)
    rgb = colours_565(ends)
    a, b = rgb[:, 0], rgb[:, 1]
    four = np.stack([a, b, (2 * a + b) // 3, (a + 2 * b) // 3], axis=1)
    three = np.stack([a, b, (a + b) // 2, np.zeros_like(a)], axis=1)
    solid = alpha | (ends[:, 0] > ends[:, 1])
    table = np.where(solid[:, None, None], four, three)
    codes = colour[:, 4:].copy().view("<u4")[:, 0]
    index = (codes[:, None] >> (2 * np.arange(16, dtype=np.uint32))) & 3
    rows = np.arange(len(data))[:, None]
    out = np.full((len(data), 16, 4), 255, dtype=np.uint8)
    out[:, :, :3] = table[rows, index]
    if alpha:
        low, high = data[:, 0].astype(np.int64), data[:, 1].astype(np.int64)
        k = np.arange(1, 7)
        eight = np.concatenate([low[:, None], high[:, None], ((7 - k) * low[:, None] + k * high[:, None]) // 7], axis=1)
        k = np.arange(1, 5)
        six = np.concatenate([low[:, None], high[:, None], ((5 - k) * low[:, None] + k * high[:, None]) // 5, np.zeros((len(data), 1), dtype=np.int64), np.full((len(data), 1), 255)], axis=1)
        levels = np.where((low > high)[:, None], eight, six)
        bits = sum(data[:, 2 + i].astype(np.uint64) << np.uint64(8 * i) for i in range(6))
        which = (bits[:, None] >> (np.uint64(3) * np.arange(16, dtype=np.uint64))) & np.uint64(7)
        out[:, :, 3] = levels[rows, which.astype(np.int64)]
    else:
        out[:, :, 3] = np.where(~solid[:, None] & (index == 3), 0, 255)
    image = out.reshape(down, across, 4, 4, 4).swapaxes(1, 2).reshape(4 * down, 4 * across, 4)
    return image[:height, :width].tobytes()


@F.pandas_udf(T.BinaryType())
def texture_rgba(blocks: pd.Series, width: pd.Series, height: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([blocks_rgba(raw or b"", int(w), int(h), bool(a)) for raw, w, h, a in zip(blocks, width, height, alpha)])


#: Channel masks of pixels that are stored as RGBA and as BGRA.
RGBA_MASKS = (0x000000FF, 0x0000FF00, 0x00FF0000, 0xFF000000)
BGRA_MASKS = (0x00FF0000, 0x0000FF00, 0x000000FF, 0xFF000000)
#: Fixed places of a surface file: height, width, name of the block format, and the blocks.
DDS_HEIGHT, DDS_WIDTH, DDS_FORMAT, DDS_BLOCKS = 12, 16, 84, 128


def pixels_rgba(raw: bytes, width: int, height: int, bits: int, masks: tuple[int, ...] = RGBA_MASKS) -> bytes | None:
    """Pixels of 24 bits as they are, or of 32 bits by the masks of red, green, blue and alpha
    (alpha zero: opaque); null for other widths and short data."""
    step = bits // 8
    if bits not in (24, 32) or len(raw) < width * height * step:
        return None
    out = np.full((width * height, 4), 255, dtype=np.uint8)
    if bits == 24:
        out[:, :3] = np.frombuffer(raw, dtype=np.uint8, count=3 * len(out)).reshape(-1, 3)
        return out.tobytes()
    value = np.frombuffer(raw, dtype="<u4", count=len(out))
    for k, m in enumerate(masks):
        if m or k < 3:
            # shifted to its lowest bit; masks of more than eight bits keep their low eight
            out[:, k] = ((value & np.uint32(m)) >> np.uint32((m & -m).bit_length() - 1 if m else 0)).astype(np.uint8)
    return out.tobytes()


@F.pandas_udf(T.StructType().add("width", "integer").add("height", "integer").add("rgba", "binary").add("error", "string"))
def surface_rgba(files: pd.Series) -> pd.DataFrame:
    """Surface files with blocks in DXT1 or DXT5: their sides and pixels, or what is wrong."""

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return None, None, None, None
        if len(raw) < DDS_BLOCKS:
            return None, None, None, "shorter than its header"
        width, height = (int.from_bytes(raw[at : at + 4], "little") for at in (DDS_WIDTH, DDS_HEIGHT))
        kind = raw[DDS_FORMAT : DDS_FORMAT + 4]
        if kind not in (b"DXT1", b"DXT5"):
            return width, height, None, f"unknown format {kind.decode('latin-1')}"
        return width, height, blocks_rgba(raw[DDS_BLOCKS:], width, height, kind == b"DXT5"), None

    return pd.DataFrame([one(x) for x in files], columns=["width", "height", "rgba", "error"]).astype({"width": "Int32", "height": "Int32"})
