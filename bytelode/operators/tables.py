"""Directory tables at the start of a carrier: each is read, checked and turned to ranges within its row.

A table's words are an array, read once, of a table that is all there and no longer than
allowed, and neighbours are compared by array functions: no row meets another, so nothing is shuffled. Results are a struct
``(status, at, ranges)``: the first error in a fixed order of checks, the index of the word
that it is about (NULL where it is about none), and, of a table without error, its ranges as
``(start, length)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytelode.functions.binary import let, word_at, words_at, zeros

_RANGES = "array<struct<start: bigint, length: bigint>>"


def _judged(checks: list[tuple[str, Column, Column | None]], otherwise: Column) -> Column:
    """The first of (name, broken, index) that holds, without ranges, else what comes otherwise, which is not worked out before."""
    none, found = F.lit(None).cast("int"), otherwise
    for name, broken, index in reversed(checks):
        one = F.struct(F.lit(name).alias("status"), (none if index is None else index.cast("int")).alias("at"), F.lit(None).cast(_RANGES).alias("ranges"))
        found = F.when(F.coalesce(broken, F.lit(False)), one).otherwise(found)
    return found


def _ok(ranges: Column) -> Column:
    return F.struct(F.lit("ok").alias("status"), F.lit(None).cast("int").alias("at"), ranges.cast(_RANGES).alias("ranges"))


def _first(values: Column, bad) -> Column:
    """The least index whose (value, index) is bad, else NULL."""
    marked = F.transform(values, lambda x, i: F.when(bad(x, i), i))
    return F.array_min(marked)


def _between(bounds: Column) -> Column:
    """Ranges between neighbours of an array; NULL for fewer than two bounds."""
    starts = F.slice(bounds, F.lit(1), F.size(bounds) - 1)
    return F.when(F.size(bounds) >= 2, F.transform(starts, lambda x, i: F.struct(x.alias("start"), (F.get(bounds, i + 1) - x).alias("length"))))


def counted_boundaries(content: Column, members: Column, alignment: int, source_length: Column | None = None, resident: bool = True) -> Column:
    """A count word and one boundary more than members, all 32-bit little-endian.

    Checks: ``truncated``; ``boundary`` (unaligned or past the source); ``closure`` (the
    first lies within the directory, the last is not the source's end, or, if the carrier is
    ``resident``, the gap after the directory is not zero); ``order`` (not above the one before).
    """
    source = source_length if source_length is not None else F.octet_length(content).cast("long")
    directory = (members + 2).cast("long") * 4

    def judged(words: Column) -> Column:
        boundary = _first(words, lambda x, i: (x % alignment != 0) | (x > source))
        order = _first(words, lambda x, i: (i > 0) & (x <= F.get(words, i - 1)))
        first, last = F.get(words, F.lit(0)), F.get(words, members)
        checks = [("boundary", boundary.isNotNull(), boundary), ("closure", (first < directory) | (last != source), None)]
        if resident:
            gap = (first - directory).cast("int")
            checks.append(("closure", F.substring(content, (directory + 1).cast("int"), gap) != zeros(gap), None))
        return _judged([*checks, ("order", order.isNotNull(), order)], _ok(_between(words)))

    return _judged([("truncated", F.octet_length(content) < directory, None)], let(words_at(content, F.lit(4), F.when(F.octet_length(content) >= directory, members + 1).otherwise(0)), judged))


def first_word_offsets(content: Column, source_length: Column, ceiling: int) -> Column:
    """Offsets whose first word is both the table's size and the first offset; the last range ends at the source's end.

    Checks: ``truncated``, ``table_length``, ``table_at_end``, ``unavailable`` (the carrier
    holds less than the table), ``offset`` (not above the one before, or not before the end).
    """

    def judged(size: Column) -> Column:
        faults = [("truncated", size.isNull(), None), ("table_length", (size < 4) | (size % 4 != 0) | (size > ceiling), None), ("table_at_end", size >= source_length, None), ("unavailable", F.octet_length(content) < size, None)]

        def checked(words: Column) -> Column:
            bad = _first(words, lambda x, i: (i > 0) & ((x <= F.get(words, i - 1)) | (x >= source_length)))
            return _judged([("offset", bad.isNotNull(), bad)], _ok(_between(F.concat(words, F.array(source_length.cast("long"))))))

        return _judged(faults, let(words_at(content, F.lit(0), F.shiftright(size, 2).cast("int")), checked))

    return let(word_at(content, F.lit(0)), judged)


def terminal_offsets(content: Column, source_length: Column, ceiling: int) -> Column:
    """A first word with the table's size, then offsets that never fall; the last is the source's end, and equal ones are empty slots.

    Checks: ``truncated``, ``table_length``, ``unavailable``, ``offset`` (unaligned, within
    the table, past the end or below the one before), ``terminal`` (the last is not the end).
    """

    def judged(size: Column) -> Column:
        faults = [("truncated", size.isNull(), None), ("table_length", (size < 8) | (size % 4 != 0) | (size > ceiling) | (size > source_length), None), ("unavailable", F.octet_length(content) < size, None)]

        def checked(words: Column) -> Column:
            bad = _first(words, lambda x, i: (i > 0) & ((x % 4 != 0) | (x < size) | (x > source_length) | (x < F.get(words, i - 1))))
            return _judged([("offset", bad.isNotNull(), bad), ("terminal", F.element_at(words, -1) != source_length, None)], _ok(_between(words)))

        return _judged(faults, let(words_at(content, F.lit(0), F.shiftright(size, 2).cast("int")), checked))

    return let(word_at(content, F.lit(0)), judged)


def offset_length_rows(content: Column, start: int, count: int, stride: int, offset_at: int, length_at: int, big: bool = False) -> Column:
    """``count`` rows of a fixed stride as an array of (start, length); NULL unless all rows are there. No order is asked."""
    if stride < 4 or max(offset_at, length_at) > stride - 4 or abs(offset_at - length_at) < 4:
        raise ValueError("fields do not fit their row")
    rows = F.array(*(F.struct(word_at(content, F.lit(start + k * stride + offset_at), 4, big).alias("start"), word_at(content, F.lit(start + k * stride + length_at), 4, big).alias("length")) for k in range(count)))
    return F.when(F.octet_length(content) >= start + count * stride, rows)


def chunk(content: Column, offset: int, big: bool = False, inclusive: bool = False) -> Column:
    """One chunk header, a tag of four bytes and a 32-bit size: ``(status, tag, start, end)`` of its payload.

    ``inclusive`` sizes count the eight header bytes. Status: ``short_header``, ``too_small``, ``past_end`` or ``ok``.
    """
    n = F.octet_length(content).cast("long")
    head = F.when(n >= offset + 8, F.hex(F.substring(content, F.lit(offset + 1), F.lit(4))))
    start = F.lit(offset + 8).cast("long")

    def judged(size: Column) -> Column:
        end = size + (offset if inclusive else offset + 8)
        status = F.when(size.isNull(), "short_header")
        if inclusive:
            status = status.when(size < 8, "too_small")
        return let(status.when(end > n, "past_end").otherwise("ok"), lambda s: F.struct(s.alias("status"), head.alias("tag"), F.when(s == "ok", start).alias("start"), F.when(s == "ok", end).alias("end")))

    return let(word_at(content, F.lit(offset + 4), 4, big), judged)


def child_run(first: Column, count: Column, total: Column) -> Column:
    """Bounds ``(start, end)`` of a parent's children in a list; NULL unless they lie within it. An empty run at the end is one."""
    end = F.try_add(first.cast("long"), count.cast("long"))
    return F.when((first >= 0) & (count >= 0) & (end <= total), F.struct(first.cast("long").alias("start"), end.alias("end")))


def evidence(ranges: Column, length: Column) -> Column:
    """Why ranges ``(start, length)`` of one source are refused as evidence, or ``ok``: 1 to 64 of them, not empty, inside, in order without overlap."""
    n = F.size(ranges)
    late = F.exists(F.transform(ranges, lambda r, i: (i > 0) & (r["start"] < F.get(ranges, i - 1)["start"] + F.get(ranges, i - 1)["length"])), lambda x: x)
    return (
        F.when((n < 1) | (n > 64), "count")
        .when(F.exists(ranges, lambda r: r["length"] <= 0), "empty")
        .when(F.exists(ranges, lambda r: (r["start"] < 0) | (r["start"] + r["length"] > length)), "outside")
        .when(late, "order")
        .otherwise("ok")
    )
