"""Catalogs of resources: key files, locators, archives, overrides."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import binary as B

#: Resource type codes and their extensions (fixed values of the format).
TYPE_CODES = {
    0x0001: "BMP", 0x0002: "MVE", 0x0004: "WAV", 0x0006: "PLT", 0x03E8: "BAM", 0x03E9: "WED", 0x03EA: "CHU", 0x03EB: "TIS",
    0x03EC: "MOS", 0x03ED: "ITM", 0x03EE: "SPL", 0x03EF: "BCS", 0x03F0: "IDS", 0x03F1: "CRE", 0x03F2: "ARE", 0x03F3: "DLG",
    0x03F4: "2DA", 0x03F5: "GAM", 0x03F6: "STO", 0x03F7: "WMP", 0x03F8: "EFF", 0x03F9: "BS", 0x03FA: "CHR", 0x03FB: "VVC",
    0x03FD: "PRO", 0x0404: "PVRZ",
}
UNKNOWN_TYPE = "UNKN"
#: Header and entry widths of key files and archives, and the tile header that slices get.
KEY_HEADER, KEY_ARCHIVE, KEY_RESOURCE = 24, 12, 14
ARCHIVE_FILE, ARCHIVE_TILES = 16, 20
TILE_HEADER, TILE_EDGE = 24, 64


def type_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*(x for k, v in TYPE_CODES.items() for x in (F.lit(k), F.lit(v))))[code.cast("int")], F.lit(UNKNOWN_TYPE))


def located(locator: Column) -> dict[str, Column]:
    """The parts of a locator: 14 bits of file index, 6 of tileset index, 12 of archive."""
    return {"resource_index": B.bits(locator, 0, 0x3FFF), "tileset_index": B.bits(locator, 14, 0x3F), "bif_index": B.bits(locator, 20, 0xFFF)}


def repeated(content: Column, start: Column, count: Column, stride: int, **more: Callable[[Column, Column], Column]) -> Column:
    """Each entry's index and bytes, for explode; more: what else is read of the content by an entry's bytes."""
    n = F.coalesce(count, F.lit(0)).cast("int")

    def cut(w: Column, i: Column) -> Column:
        raw = B.slice_at(w["content"], w["start"] + i * stride, stride)
        return F.struct(i.alias("i"), raw.alias("raw"), *(f(w["content"], raw).alias(k) for k, f in more.items()))

    # content is bound once: each entry would copy all of it out of its row
    whole = F.array(F.struct(content.alias("content"), start.alias("start")))
    return F.when(n > 0, F.flatten(F.transform(whole, lambda w: F.transform(F.sequence(F.lit(0), n - 1), lambda i: cut(w, i)))))


def key_entries(keys: DataFrame, game: str = "game", content: str = "content") -> DataFrame:
    """(game, entry, resref, res_type, resource_index, tileset_index, bif_index) of key files;
    entries without a name are dropped."""
    c = F.col(content)
    rows = keys.select(game, F.explode(repeated(c, B.uint_le(c, 20, 4), B.uint_le(c, 12, 4), KEY_RESOURCE)).alias("e"))
    raw = F.col("e.raw")
    name = B.name_key(F.decode(B.slice_at(raw, 0, 8), "ISO-8859-1"))
    rows = rows.select(game, F.col("e.i").alias("entry"), name.alias("resref"), type_name(B.uint_le(raw, 8, 2)).alias("res_type"), B.uint_le(raw, 10, 4).alias("locator"))
    return rows.where("resref <> ''").select("*", *(c.alias(n) for n, c in located(F.col("locator")).items())).drop("locator")


def key_archives(keys: DataFrame, game: str = "game", content: str = "content") -> DataFrame:
    """(game, bif_index, file) of key files, file names in plain form."""
    c = F.col(content)
    name = lambda whole, raw: B.text_at(whole, B.uint_le(raw, 4, 4), B.uint_le(raw, 8, 2))
    rows = keys.select(game, F.explode(repeated(c, B.uint_le(c, 16, 4), B.uint_le(c, 8, 4), KEY_ARCHIVE, name=name)).alias("e"))
    return rows.select(game, F.col("e.i").alias("bif_index"), file_path(F.col("e.name")).alias("file"))


def file_path(name: Column) -> Column:
    """A stored file name: to its first NUL, slashes forward, without drive, root or dots."""
    out = F.regexp_replace(F.trim(B.to_nul(name)), r"\\", "/")
    out = F.regexp_replace(out, "^[A-Za-z]:/*", "")
    return F.regexp_replace(F.regexp_replace(out, r"(^|/)(\./)+", "$1"), "^/+", "")


def first_entry(catalog: DataFrame, resref: str, res_type: str | None = None) -> DataFrame:
    """The entry of a name and type, the first one without a type; none if the type is absent."""
    found = catalog.where(F.col("resref") == resref.upper())
    if res_type is not None:
        found = found.where(F.col("res_type") == res_type.upper())
    return found.orderBy("entry").limit(1)


def preferred(copies: DataFrame, keys: list[str], priority: list[Column]) -> DataFrame:
    """For each key the copy with the least priority, e.g. override before archive.

    A minimum with partial aggregation, so a key with many copies is no task of its own.
    """
    rest = [c for c in copies.columns if c not in keys]
    rank = F.struct(*(p.alias(f"p{k}") for k, p in enumerate(priority)))
    return copies.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("best")).select(*keys, "best.*")


@F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]))
def unpacked(content: pd.Series) -> pd.DataFrame:
    """Archives as they are, of signature BIFF, or inflated: whole (BIF ) or by blocks (BIFC)."""
    u32 = lambda raw, at: int.from_bytes(raw[at : at + 4], "little")

    def one(raw: bytes) -> tuple[bytes | None, str | None]:
        kind = raw[:4]
        try:
            if kind == b"BIFF":
                return raw, None
            if kind == b"BIF ":
                at = 12 + u32(raw, 8)
                out = zlib.decompress(raw[at + 8 :])
                return (out, None) if len(out) == u32(raw, at) else (None, "wrong inflated size")
            if kind == b"BIFC":
                out, at = [], 12
                while at + 8 <= len(raw) and (u32(raw, at) or u32(raw, at + 4)):
                    size, packed = u32(raw, at), u32(raw, at + 4)
                    out.append(zlib.decompress(raw[at + 8 : at + 8 + packed]))
                    if len(out[-1]) != size:
                        return None, "wrong block size"
                    at += 8 + packed
                whole = b"".join(out)
                return (whole, None) if len(whole) == u32(raw, 8) else (None, "wrong inflated size")
            return None, f"unknown archive signature {kind!r}"
        except zlib.error as e:
            return None, str(e)

    return pd.DataFrame([(None, None) if raw is None else one(raw) for raw in content], columns=["content", "error"])


@F.pandas_udf(T.BinaryType())
def inflated(content: pd.Series) -> pd.Series:
    """zlib data; null where it is none."""

    def one(raw: bytes | None) -> bytes | None:
        try:
            return None if raw is None else zlib.decompress(raw)
        except zlib.error:
            return None

    return content.map(one)


def file_slice(archive: Column, index: Column) -> Column:
    """The bytes of a file in an archive, null outside its table."""
    at = B.uint_le(archive, 16, 4) + index * ARCHIVE_FILE
    inside = index < B.uint_le(archive, 8, 4)
    return F.when(inside, B.slice_at(archive, B.uint_le(archive, at + 4, 4), B.uint_le(archive, at + 8, 4)))


def tiles_slice(archive: Column, index: Column) -> Column:
    """A tileset with a header of its own; null outside the table or for a short payload."""
    at = B.uint_le(archive, 16, 4) + B.uint_le(archive, 8, 4) * ARCHIVE_FILE + index * ARCHIVE_TILES
    count, size = B.uint_le(archive, at + 8, 4), B.uint_le(archive, at + 12, 4)
    body = B.slice_at(archive, B.uint_le(archive, at + 4, 4), count * size)
    head = F.concat(F.lit(b"TIS V1  "), B.bytes_le(count, 4), B.bytes_le(size, 4), B.bytes_le(F.lit(TILE_HEADER), 4), B.bytes_le(F.lit(TILE_EDGE), 4))
    good = (index < B.uint_le(archive, 12, 4)) & (count > 0) & (size > 0) & (F.length(body) == count * size)
    return F.when(good, F.concat(head, body))


def contents(catalog: DataFrame, archives: DataFrame) -> DataFrame:
    """catalog with the content of each resource.

    Archives (game, bif_index, content) are inflated once each and meet the catalog by a
    join on their key, so a large archive is not read for every resource in it.
    """
    ready = archives.select("game", "bif_index", unpacked("content").alias("u")).select("game", "bif_index", F.col("u.content").alias("archive"), F.col("u.error").alias("error"))
    both = catalog.join(ready, ["game", "bif_index"], "left")
    own = F.when(F.col("res_type") == "TIS", tiles_slice(F.col("archive"), F.col("tileset_index"))).otherwise(file_slice(F.col("archive"), F.col("resource_index")))
    return both.withColumn("content", own).drop("archive")


def saved(resources: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content to folder/RESREF.ext; (resref, res_type, path, error) of each.

    The folder is a path that executors share; a file that can't be written is a row with
    its error.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for batch in batches:
            rows = []
            for name, kind, raw in zip(batch["resref"], batch["res_type"], batch["content"]):
                path, error = f"{folder}/{name}.{kind.lower()}", None
                try:
                    os.makedirs(folder, exist_ok=True)
                    with open(f"{path}.part", "wb") as f:
                        f.write(raw or b"")
                    os.replace(f"{path}.part", path)
                except OSError as e:
                    error = str(e)
                rows.append((name, kind, path, error))
            yield pd.DataFrame(rows, columns=["resref", "res_type", "path", "error"])

    return resources.select("resref", "res_type", "content").mapInPandas(write, "resref string, res_type string, path string, error string")
