"""Reads, writes and predicates on binary columns, as column expressions.

Every read is guarded by the carrier's length: a read past the end is NULL, and
``truncated`` tells the offset, the bytes needed and the bytes there.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytelode.functions.codecs import bytes_udf


def span(c: Column, offset, length) -> Column:
    """Exactly ``length`` bytes at ``offset``; NULL if they are not all there."""
    offset, length = (x if isinstance(x, Column) else F.lit(x) for x in (offset, length))
    return F.when((offset >= 0) & (length >= 0) & (F.octet_length(c) >= offset.cast("long") + length), F.substring(c, (offset + 1).cast("int"), length.cast("int")))


def truncated(c: Column, offset: int, length: int) -> Column:
    """The error of a read past the end, NULL where the read fits."""
    there = F.octet_length(c).cast("long")
    return F.when(there < offset + length, F.struct(F.lit(offset).cast("long").alias("offset"), F.lit(length).cast("long").alias("needed"), F.greatest(there - offset, F.lit(0).cast("long")).alias("available")))


def uint(c: Column, offset: int, width: int, big: bool = False) -> Column:
    """An unsigned number of 1 to 8 bytes: BIGINT, or DECIMAL(20,0) for 8."""
    at = range(offset, offset + width)
    digits = F.concat(*(F.hex(F.substring(c, i + 1, 1)) for i in (at if big else reversed(at))))
    return F.when(F.octet_length(c) >= offset + width, F.conv(digits, 16, 10).cast("decimal(20,0)" if width == 8 else "bigint"))


def sint(c: Column, offset: int, width: int, big: bool = False) -> Column:
    """A signed number of 1 to 4 bytes."""
    v = uint(c, offset, width, big)
    return v - F.when(v >= 1 << 8 * width - 1, F.lit(1 << 8 * width)).otherwise(F.lit(0))


def byte_at(c: Column, offset: Column) -> Column:
    """The byte at a place, as BIGINT; NULL past the end."""
    return F.when((offset >= 0) & (offset < F.octet_length(c)), F.conv(F.hex(F.substring(c, (offset + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex_word(digits: Column, width: int, big: bool) -> Column:
    """The number of a word's hex digits."""
    order = range(width) if big else reversed(range(width))
    return F.conv(digits if big else F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in order)), 16, 10).cast("bigint")


def word_at(c: Column, offset: Column, width: int = 4, big: bool = False) -> Column:
    """An unsigned number of 1 to 7 bytes at a place that differs by row; NULL past the end."""
    digits = F.hex(F.substring(c, (offset + 1).cast("int"), F.lit(width)))
    return F.when((offset >= 0) & (F.octet_length(c) >= offset.cast("long") + width), _hex_word(digits, width, big))


def words_at(c: Column, offset: Column, count: Column, width: int = 4, big: bool = False) -> Column:
    """``count`` unsigned numbers, one after the other; none for a count below one."""
    none = F.array().cast("array<bigint>")
    digits = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(offset + i * width >= 0, F.hex(F.substring(c, (offset + i * width + 1).cast("int"), F.lit(width)))))
    return F.when(count >= 1, F.transform(digits, lambda h: F.when(F.length(h) == 2 * width, _hex_word(h, width, big)))).otherwise(none)


def uints(c: Column, offset: int, count: int, width: int, big: bool = False) -> Column:
    """A fixed array of unsigned numbers; NULL unless all of it is there."""
    return F.when(F.octet_length(c) >= offset + count * width, F.array(*(uint(c, offset + k * width, width, big) for k in range(count))))


def sints(c: Column, offset: int, count: int, width: int, big: bool = False) -> Column:
    """A fixed array of signed numbers; NULL unless all of it is there."""
    return F.when(F.octet_length(c) >= offset + count * width, F.array(*(sint(c, offset + k * width, width, big) for k in range(count))))


def f32(c: Column, offset: int, big: bool = False) -> Column:
    """A single float as ``(bits, value)``: its bit pattern as it is, and what it stands for."""
    bits = uint(c, offset, 4, big)
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit(0x7FFFFF))
    size = (
        F.when(exponent == 0, fraction * 2.0**-149)
        .when(exponent < 255, (fraction + (1 << 23)) * F.pow(F.lit(2.0), exponent - 150))
        .when(fraction == 0, F.lit(float("inf")))
        .when(fraction > 0, F.lit(float("nan")))
    )
    value = F.when(F.shiftright(bits, 31) == 1, -size).otherwise(size)
    return F.when(bits.isNotNull(), F.struct(bits.alias("bits"), value.alias("value")))


def floats(c: Column, offset: int, count: int, big: bool = False) -> Column:
    """A fixed array of single floats; NULL unless all of it is there."""
    return F.when(F.octet_length(c) >= offset + 4 * count, F.array(*(f32(c, offset + 4 * k, big) for k in range(count))))


def _hex_bytes(digits: Column, width: int, big: bool) -> Column:
    parts = [F.substring(digits, 2 * i + 1, 2) for i in range(width)]
    return F.unhex(F.concat(*(parts if big else reversed(parts))))


def _uint_hex(v: Column, width: int, big: bool) -> Column:
    """The hex digits of ``uint_bytes``, for 1 to 7 bytes by whole-number arithmetic."""
    v = v.try_cast("long")
    turned = v if big or width == 1 else sum((F.shiftleft(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)), 8 * (width - 1 - k)) for k in range(1, width)), F.shiftleft(v.bitwiseAND(F.lit(255)), 8 * (width - 1)))
    return F.when((v >= 0) & (v < 1 << 8 * width), F.lpad(F.hex(turned), 2 * width, "0"))


def uint_bytes(v: Column, width: int, big: bool = False) -> Column:
    """The bytes of an unsigned number of 1 to 8 bytes (BIGINT or DECIMAL(20,0)); NULL if it is negative or too wide."""
    if width < 8:
        return F.unhex(_uint_hex(v, width, big))
    whole = v.cast("decimal(20,0)")
    return F.when((whole >= 0) & (whole < F.lit(str(1 << 8 * width)).cast("decimal(20,0)")), _hex_bytes(F.lpad(F.conv(whole.cast("string"), 10, 16), 2 * width, "0"), width, big))


def sint_bytes(v: Column, width: int, big: bool = False) -> Column:
    """The bytes of a signed number of 1 to 8 bytes in two's complement; NULL if it is too wide."""
    low, high = -(1 << 8 * width - 1), (1 << 8 * width - 1) - 1
    v = v.cast("long")
    return F.when((v >= low) & (v <= high), _hex_bytes(F.right(F.lpad(F.hex(v), 16, "0"), F.lit(2 * width)), width, big))


def array_bytes(values: Column, width: int, signed: bool = False, big: bool = False) -> Column:
    """The bytes of an array of numbers; NULL if any does not fit."""
    if signed or width == 8:
        one = sint_bytes if signed else uint_bytes
        packed = F.transform(values, lambda v: F.hex(one(v, width, big)))
    else:
        packed = F.transform(values, lambda v: _uint_hex(v, width, big))
    return F.unhex(F.array_join(packed, "", "?"))  # NULL for what is no digit


def splice(c: Column, offset, replacement: Column) -> Column:
    """The carrier with bytes replaced in place; NULL if they do not lie within it."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    n = F.octet_length(replacement)
    return F.when((offset >= 0) & (offset + n <= F.octet_length(c)), F.overlay(c, replacement, (offset + 1).cast("int"), n))


def scaled(c: Column, offset: int, unit: int, base: int = 0) -> Column:
    """A little-endian u32 that counts units, in bytes from ``base``."""
    return uint(c, offset, 4) * unit + base


def div(a: Column, b: int | Column) -> Column:
    """Whole division of whole numbers, towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def unscaled(v: Column, unit: int, base: int = 0) -> Column:
    """The stored count of a byte value; NULL if it is no multiple, below ``base`` or too wide."""
    rest = v - base
    return F.when((rest >= 0) & (rest % unit == 0) & (rest < unit << 32), div(rest, unit))


def put_scaled(c: Column, offset: int, v: Column, unit: int, base: int = 0) -> Column:
    """The carrier with a byte value stored as a count of units; NULL, and nothing changed, if it cannot be."""
    return splice(c, offset, uint_bytes(unscaled(v, unit, base), 4))


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def zero_tail(c: Column, content_end, maximum: int) -> Column:
    """Whether fewer than ``maximum`` bytes follow the content, all zero."""
    end = content_end if isinstance(content_end, Column) else F.lit(content_end)
    n = F.octet_length(c) - end
    return F.coalesce((n >= 0) & (n < maximum) & (F.substring(c, (end + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int")) == zeros(F.greatest(n, F.lit(0)))), F.lit(False))


def nul_length(c: Column, maximum: int) -> Column:
    """Bytes before the first NUL within ``maximum``; NULL if there is none."""
    field = F.substring(c, 1, maximum)
    before = F.octet_length(F.substring_index(field.cast("string"), "\x00", 1))  # compares bytes, whatever they encode
    return F.when(before < F.octet_length(field), before.cast("long"))


def fixed_string(c: Column, width: int) -> Column:
    """A field of ``width`` bytes, up to its NUL if it has one; NULL if the field is not all there."""
    n = F.coalesce(nul_length(c, width), F.lit(width))
    return F.when(F.octet_length(c) >= width, F.substring(c, F.lit(1), n.cast("int")))


def string_field(c: Column, offset: int, width: int, policy: str) -> Column:
    """A positioned field's bytes by policy: ``nul`` (NULL without a NUL), ``nul_or_full``, or ``padded`` (NULL unless all after the NUL is zero)."""
    field = span(c, offset, width)
    n = nul_length(field, width)
    if policy == "nul":
        return F.when(n.isNotNull(), F.substring(field, F.lit(1), n.cast("int")))
    value = F.substring(field, F.lit(1), F.coalesce(n, F.lit(width)).cast("int"))
    if policy == "nul_or_full":
        return F.when(field.isNotNull(), value)
    return F.when(field == F.concat(value, zeros(F.lit(width) - F.octet_length(value))), value)


def put_string(c: Column, offset: int, width: int, value: Column, policy: str) -> Column:
    """The carrier with a field written by policy: ``nul`` keeps what follows the value's NUL, ``padded`` and ``nul_or_full`` fill with NULs; NULL if it does not fit."""
    if policy == "nul":
        fits = (F.octet_length(value) < width) & (F.position(F.unhex(F.lit("00")), value) == 0) & (F.octet_length(c) >= offset + width)
        return F.when(fits, splice(c, offset, F.concat(value, F.unhex(F.lit("00")))))
    return F.when(F.octet_length(c) >= offset + width, splice(c, offset, padded(value, width, policy == "padded")))


def prefixed(c: Column, width: int) -> Column:
    """Bytes after a length of 1 or 2 bytes (little-endian)."""
    return span(c, width, uint(c, 0, width))


def padded(value: Column, width: int, need_nul: bool = True) -> Column:
    """The value with NULs up to ``width``; NULL if it holds a NUL or does not fit (with its NUL, if one is needed)."""
    n = F.octet_length(value)
    fits = (n < width) if need_nul else (n <= width)
    return F.when(fits & (F.position(F.unhex(F.lit("00")), value) == 0), F.concat(value, zeros(F.greatest(F.lit(width) - n, F.lit(0)))))


def align_up(v: Column, to: int, power_of_two: bool = False) -> Column:
    """The next multiple; NULL where ``to`` is not positive (or no power of two, if it must be one) and past BIGINT."""
    if to <= 0 or power_of_two and to & (to - 1):
        return F.lit(None).cast("long")
    v = v.cast("long")
    return F.try_add(v, F.pmod(F.lit(to).cast("long") - F.pmod(v, F.lit(to).cast("long")), F.lit(to).cast("long")))


def monotone_bounded(boundaries: Column, minimum: int, maximum: int, alignment: int) -> Column:
    """Whether boundaries never fall, lie within bounds and are aligned to a power of two."""
    if alignment <= 0 or alignment & (alignment - 1) or minimum > maximum:
        return F.lit(False)
    inside = F.forall(boundaries, lambda x: x.between(minimum, maximum) & (x % alignment == 0))
    pairs = F.arrays_zip(F.slice(boundaries, F.lit(1), F.greatest(F.size(boundaries) - 1, F.lit(0))).alias("a"), F.slice(boundaries, F.lit(2), F.greatest(F.size(boundaries) - 1, F.lit(0))).alias("b"))
    return inside & F.forall(pairs, lambda p: p["a"] <= p["b"])


def extent_contains(start: Column, size: Column, place: Column) -> Column:
    return (place >= start) & (place - start < size)


def audit_extent(start: Column, size: Column, available: Column) -> Column:
    """``ok``, ``overflow`` (the end is past BIGINT) or ``outside`` of a declared extent in what is there."""
    end = F.try_add(start.cast("long"), size.cast("long"))
    return F.when(end.isNull(), "overflow").when((start < 0) | (size < 0) | (end > available), "outside").otherwise("ok")


def test_bit(word: Column, bit: int) -> Column:
    return F.shiftright(word, bit).bitwiseAND(F.lit(1)) == 1


def replace_bit(word: Column, bit: int, value: Column) -> Column:
    cleared = word.bitwiseAND(F.lit(~(1 << bit)))
    return F.when(value, cleared.bitwiseOR(F.lit(1 << bit))).otherwise(cleared)


def bit_range(word: Column, start: int, width: int) -> Column:
    return F.shiftright(word, start).bitwiseAND(F.lit((1 << width) - 1))


def replace_bits(word: Column, start: int, width: int, value: Column) -> Column:
    """The word with a range replaced; NULL if the value is too wide for it."""
    mask = (1 << width) - 1
    return F.when((value >= 0) & (value <= mask), word.bitwiseAND(F.lit(~(mask << start))).bitwiseOR(F.shiftleft(value, start)))


def zero_one(v: Column) -> Column:
    """0 and 1 as a boolean; other numbers are NULL."""
    return F.when(v.isin(0, 1), v == 1)


def contiguous_mask(mask: Column) -> Column:
    """Whether the set bits of a 32-bit mask (signed or not) are one unbroken run."""
    m = mask.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    low = m.bitwiseAND(-m)
    return (m != 0) & ((m + low).bitwiseAND(m) == 0)


def safe_path(path: Column, most_bytes: int = 4096, most_depth: int = 32) -> Column:
    """Why a relative path is refused, or ``ok``: the first reason in a fixed order."""
    parts = F.split(path, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.octet_length(path) > most_bytes, "too long")
        .when(F.contains(path, F.lit("\x00")), "nul")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.startswith("/"), "absolute")
        .when(path.rlike("^[A-Za-z]:"), "drive")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "component")
        .when(F.size(parts) > most_depth, "too deep")
        .otherwise("ok")
    )


def half_value(word: Column) -> Column:
    """The double that a 16-bit half float stands for: subnormals exact, infinities and NaN as such; null stays null."""
    w = word.cast("long")
    exponent, fraction = F.shiftright(w, 10).bitwiseAND(F.lit(31)), w.bitwiseAND(F.lit(1023))
    size = (
        F.when(exponent == 0, fraction * 2.0**-24)
        .when(exponent < 31, (fraction + 1024) * F.pow(F.lit(2.0), exponent - 25))
        .when(fraction == 0, F.lit(float("inf")))
        .when(fraction > 0, F.lit(float("nan")))
    )
    return F.when(w.bitwiseAND(F.lit(0x8000)) != 0, -size).otherwise(size)


def adler32(c: Column) -> Column:
    """Adler-32 of a carrier, by zlib in an Arrow UDF; 1 for no bytes."""
    return bytes_udf(zlib.adler32, "long")(c)
