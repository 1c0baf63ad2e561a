"""Column expressions over little-endian binary: integers, flags, labels, displays.

All of them are built-in functions, so that decoding stays inside generated code and
fields that a query doesn't read are pruned.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_at(content: Column, offset: Column | int, size: int | Column) -> Column:
    """Bytes from a zero-based offset; shorter or empty past the end."""
    start = F.lit(offset) if isinstance(offset, int) else offset
    return F.substring(content, start.cast("int") + 1, F.lit(size) if isinstance(size, int) else size.cast("int"))


def swapped(hexed: Column, size: int) -> Column:
    """The hex digits of so many bytes, last byte first."""
    return F.concat(*(F.substring(hexed, 2 * k + 1, 2) for k in range(size - 1, -1, -1)))


def turned(number: Column, size: int) -> Column:
    """The whole number of 1, 2 or 4 bytes with its bytes in the other order. Products copy them side by side and
    never leave 63 bits; number is named once, at 4 bytes twice, as a filter computes it anew for each name."""
    if size == 1:
        return number
    part = lambda x, shift, mask: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask).cast("bigint"))
    if size == 2:
        return part(number * 0x10001, 8, 0xFFFF)
    odd, even = part(number, 0, 0xFF00FF), part(number, 8, 0xFF00FF)
    return part(odd * 0x100000001, 8, 0xFF00FF00).bitwiseOR(part(even * 0x100000001, 16, 0xFF00FF))


def uint_le(content: Column, offset: Column | int, size: int) -> Column:
    """Unsigned integer of 1 to 7 bytes (8: as decimal); null if bytes are missing."""
    part = slice_at(content, offset, size)
    # the condition stands inside: what only a branch of it reads is computed anew for each byte
    digits = F.hex(F.when(F.length(part) == size, part))
    if size in (1, 2, 4):
        return turned(F.conv(digits, 16, 10).cast("bigint"), size)
    return F.conv(swapped(digits, size), 16, 10).cast("bigint" if size < 8 else "decimal(20,0)")


def sint_le(content: Column, offset: Column | int, size: int) -> Column:
    """Two's complement integer of 1 to 8 bytes."""
    value = uint_le(content, offset, size)
    return F.when(value >= 2 ** (8 * size - 1), value - F.lit(2 ** (8 * size)).cast("decimal(20,0)" if size == 8 else "bigint")).otherwise(value).cast("bigint")


def nearest(value: Column) -> Column:
    """A double as round() has it, halves away from zero, without its way over decimal text: what
    rint takes from a value is exact."""
    even = F.rint(value)
    off = value - even
    return F.when((off == 0.5) & (value > 0), even + 1).when((off == -0.5) & (value < 0), even - 1).otherwise(even)


def digits_le(value: Column, size: int) -> Column:
    """The hex digits of bytes_le(): what only becomes part of a longer text of digits needs no bytes of its own."""
    whole = F.coalesce(value, F.lit(0)).cast("bigint")
    total = F.lit(0).cast("bigint")
    for k in range(size):
        byte = F.shiftrightunsigned(whole, 8 * k).bitwiseAND(F.lit(0xFF).cast("bigint"))
        total = total.bitwiseOR(F.shiftleft(byte, 8 * (size - 1 - k)))
    return F.lpad(F.hex(total), 2 * size, "0")


def bytes_le(value: Column, size: int) -> Column:
    """value as so many bytes; null as zero, negative values in two's complement."""
    return F.unhex(digits_le(value, size))


def text_at(content: Column, offset: Column | int, size: int | Column) -> Column:
    """Latin-1 text without trailing NULs."""
    return F.rtrim(F.decode(slice_at(content, offset, size), "ISO-8859-1"), F.lit("\0"))


def fixed_text(value: Column, size: int) -> Column:
    """Text as exactly so many bytes, cut or filled with NULs."""
    raw = F.encode(F.coalesce(value, F.lit("")), "ISO-8859-1")
    return F.substring(F.concat(raw, F.lit(bytes(size))), 1, size)


def bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(mask).cast("bigint"))


def bit_parts(value: Column, parts: Mapping[str, tuple[int, int]]) -> Column:
    """A struct of (shift, mask) parts, and _unknown for bits that no part covers."""
    covered = 0
    for shift, mask in parts.values():
        covered |= mask << shift
    rest = value.bitwiseAND(F.bitwise_not(F.lit(covered).cast("bigint")))
    return F.struct(*(bits(value, s, m).alias(name) for name, (s, m) in parts.items()), F.when(rest != 0, rest).alias("_unknown"))


def flags(value: Column, masks: Mapping[str, int]) -> Column:
    """A struct of booleans by mask, and _unknown for bits without a name."""
    covered = 0
    for mask in masks.values():
        covered |= mask
    rest = value.bitwiseAND(F.bitwise_not(F.lit(covered).cast("bigint")))
    named = (((value.bitwiseAND(F.lit(m).cast("bigint"))) != 0).alias(n) for n, m in masks.items())
    return F.struct(*named, F.when(rest != 0, rest).alias("_unknown"))


def label(value: Column, labels: Mapping[int, str]) -> Column:
    """The label of a code; codes without one as decimal text."""
    pairs = (x for k, v in labels.items() for x in (F.lit(k).cast("bigint"), F.lit(v)))
    return F.coalesce(F.create_map(*pairs)[value.cast("bigint")], value.cast("string"))


def sentinel(value: Column, size: int) -> Column:
    """All bits set reads as -1."""
    return F.when(value == 2 ** (8 * size) - 1, F.lit(-1)).otherwise(value).cast("bigint")


def to_nul(text: Column) -> Column:
    return F.split_part(text, F.lit("\0"), F.lit(1))


def spaced_hex(raw: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.hex(raw), "(..)", "$1 "))


def cstring(content: Column) -> Column:
    """Text up to the first NUL; with other than printable ASCII, its bytes in hex."""
    text = to_nul(F.decode(content, "ISO-8859-1"))
    return F.when(text.rlike("^[ -~]*\\z"), text).otherwise(F.concat(F.lit("<binary data: "), spaced_hex(F.encode(text, "ISO-8859-1")), F.lit(">")))


def bytes_shown(content: Column) -> Column:
    n = F.length(content)
    zero = F.translate(F.hex(content), "0", "") == ""
    long_zero = F.concat(F.lit("<zeroed ("), n.cast("string"), F.lit(" bytes)>"))
    return F.when(n == 0, "").when((n > 8) & zero, long_zero).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(content))))


def name_key(text: Column) -> Column:
    """A resource name for comparison: to the first NUL, trimmed, upper case."""
    return F.upper(F.trim(to_nul(text)))


def name_shown(content: Column) -> Column:
    text = to_nul(F.decode(content, "ISO-8859-1"))
    odd = F.concat(F.lit("<non-text resref:"), F.lower(F.hex(F.encode(text, "ISO-8859-1"))), F.lit(">"))
    return F.when(text == "", F.lit(None).cast("string")).when(text.rlike("^[ -~]*\\z"), text).otherwise(odd)


def reference_shown(number: Column, text: Column) -> Column:
    """A string reference: "(n) text", "(n)" for empty text, n alone without text."""
    n = number.cast("string")
    return F.when(text.isNull(), n).when(text == "", F.concat(F.lit("("), n, F.lit(")"))).otherwise(F.concat(F.lit("("), n, F.lit(") "), text))


def first_difference(a: Column, b: Column, step: int = 4096) -> Column:
    """The zero-based offset of the first byte in which two blobs differ, null if equal.

    Blocks are compared first, then the bytes of the first block that differs. Both
    blobs are bound once: a lambda that reads a column copies the whole of it each time.
    """

    def block(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(x["a"]), F.length(x["b"]), F.lit(1)) - 1, F.lit(step))
        at = F.get(F.filter(starts, lambda s: slice_at(x["a"], s, step) != slice_at(x["b"], s, step)), F.lit(0))
        return F.transform(F.array(at), lambda k: F.struct(k.alias("at"), slice_at(x["a"], k, step).alias("a"), slice_at(x["b"], k, step).alias("b")))

    def inside(x: Column) -> Column:
        offsets = F.sequence(F.lit(0), F.greatest(F.length(x["a"]), F.length(x["b"])) - 1)
        return x["at"] + F.get(F.filter(offsets, lambda i: slice_at(x["a"], i, 1) != slice_at(x["b"], i, 1)), F.lit(0))

    both = F.array(F.struct(a.alias("a"), b.alias("b")))
    found = F.transform(F.flatten(F.transform(both, block)), inside)
    return F.when(a.isNotNull() & b.isNotNull(), F.get(found, F.lit(0)))
