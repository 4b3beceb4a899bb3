"""Directory tables and extents: neighbour and prefix relations within a group.

Rows are keyed by a group (a carrier) and an ordinal within it. Each operator is one
exchange by the group and a window over it; the first error of a group is the least
(ordinal, check).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelode.functions.binary import align_up, div, span, zeros
from bytelode.sources.scratch import written


def _in_order(group: str, order: str):
    return Window.partitionBy(group).orderBy(order)


def _named(code: Column, *names: str) -> Column:
    """The name of a check by its number from 1, ``ok`` for NULL."""
    out = F.lit("ok")
    for n, name in enumerate(names, 1):
        out = F.when(code == n, name).otherwise(out)
    return out


def ends(starts: Column, sizes: Column) -> Column:
    return starts + sizes


def aligned_chain(sizes: DataFrame, first: int, alignment: int, group: str = "group_id", order: str = "idx") -> DataFrame:
    """Sizes to extents, each at the next aligned place after its predecessor's end.

    The place of a row is a running sum of aligned sizes, so no row waits for another:
    all but the first start are multiples, and only the first size is aligned from ``first``.
    """
    w = _in_order(group, order)
    nth = F.row_number().over(w)
    step = F.when(nth == 1, align_up(F.col("size") + first, alignment)).otherwise(align_up(F.col("size"), alignment))
    stepped = sizes.withColumns({"nth": nth, "step": step})
    start = F.when(F.col("nth") == 1, F.lit(first).cast("long")).otherwise(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return stepped.withColumn("start", start).select(group, order, "size", "start", ends(F.col("start"), F.col("size")).alias("end"))


def positive_sizes(sizes: DataFrame, first: int, divisor: int, source_length: Column, group: str = "group_id", order: str = "idx") -> DataFrame:
    """One row a group: its first error (zero, unaligned, past the end, or not closing at the end) or none, and where it ends."""
    w = _in_order(group, order)
    run = sizes.withColumns({"run": F.lit(first) + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "limit": source_length})
    code = F.when(F.col("size") <= 0, 1).when(F.col("size") % divisor != 0, 2).when(F.col("run") > F.col("limit"), 3)
    worst = F.min(F.when(code.isNotNull(), F.struct(F.col(order).alias("at"), code.alias("code"))))
    found = run.groupBy(group).agg(worst.alias("worst"), F.max("run").alias("end"), F.max("limit").alias("limit"))
    status = F.when(F.col("worst").isNull() & (F.col("end") != F.col("limit")), "open").otherwise(_named(F.col("worst.code"), "zero", "unaligned", "past_end"))
    return found.select(group, "end", F.col("worst.at").alias("at"), status.alias("status"))


def audit(extents: DataFrame, kind: str, origin: int | Column = 0, terminal: Column | None = None, group: str = "group_id", order: str = "idx") -> DataFrame:
    """The first violation of each group, or none: ``ordered`` (no extent starts before its predecessor's end), ``contiguous`` (each starts there), ``tiling`` (and the last ends at ``terminal``)."""
    w = _in_order(group, order)
    origin = origin if isinstance(origin, Column) else F.lit(origin).cast("long")
    end = F.col("start") + F.col("size")
    expected = F.coalesce(F.lag(end).over(w), origin if kind != "ordered" else F.lit(-(1 << 62)))
    bad = (F.col("start") < expected) if kind == "ordered" else (F.col("start") != expected)
    marked = extents.withColumns({"bad": bad, "end": end, "terminal": terminal if terminal is not None else F.lit(None).cast("long")})
    found = marked.groupBy(group).agg(F.min(F.when(F.col("bad"), F.col(order))).alias("at"), F.max_by("end", order).alias("end"), F.max("terminal").alias("terminal"))
    status = F.when(F.col("at").isNotNull(), "overlap" if kind == "ordered" else "gap_or_overlap")
    if kind == "tiling":
        status = status.when(F.col("end") != F.col("terminal"), "open")
    return found.select(group, "at", "end", status.otherwise("ok").alias("status"))


def successor_ranges(starts: DataFrame, terminal: Column, strict: bool, group: str = "group_id", order: str = "idx") -> DataFrame:
    """Ranges from each start to the next, the last to ``terminal``; ``valid`` is false in every row of a group that breaks the order.

    Strict starts increase and lie before the terminal; otherwise equal starts give
    empty ranges, and a start may be the terminal.
    """
    w = _in_order(group, order)
    nearby = starts.withColumn("next", F.coalesce(F.lead("start").over(w), terminal))
    ok = (F.col("start") < F.col("next")) if strict else (F.col("start") <= F.col("next"))
    whole = F.bool_and(ok).over(Window.partitionBy(group))
    return nearby.select(group, order, "start", (F.col("next") - F.col("start")).alias("length"), whole.alias("valid"))


def stored_range_admission(members: DataFrame, max_entries: int, max_name: int, max_names: int, source_length: Column, group: str = "group_id", order: str = "idx") -> DataFrame:
    """One row a namespace: the first limit that its members break, in entry order, or none.

    Members have offset, size and name (NULL: unnamed). Checks of a member go: number
    of entries, extent within the source, bytes of its name, bytes of all names so far.
    """
    w = _in_order(group, order)
    length = F.coalesce(F.octet_length("name"), F.lit(0))
    run = members.withColumns({"nth": F.row_number().over(w), "names": F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)), "limit": source_length})
    code = F.when(F.col("nth") > max_entries, 1).when(F.col("offset") + F.col("size") > F.col("limit"), 2).when(length > max_name, 3).when(F.col("names") > max_names, 4)
    found = run.groupBy(group).agg(F.min(F.when(code.isNotNull(), F.struct(F.col(order).alias("at"), code.alias("code")))).alias("worst"), F.count("*").alias("members"))
    return found.select(group, "members", F.col("worst.at").alias("at"), _named(F.col("worst.code"), "entries", "outside", "name", "names").alias("status"))


def budget_admission(charges: DataFrame, limit: int, group: str = "group_id", order: str = "idx") -> DataFrame:
    """Spent after each charge, up to the first that is denied, which ends the job and spends nothing."""
    w = _in_order(group, order).rowsBetween(Window.unboundedPreceding, 0)
    run = charges.withColumn("total", F.sum("amount").over(w))
    denied = F.min(F.when(F.col("total") > limit, F.col(order)))
    return run.groupBy(group).agg(denied.alias("denied_at"), F.coalesce(F.max(F.when(F.col("total") <= limit, F.col("total"))), F.lit(0).cast("long")).alias("spent"))


def triangles(indices: DataFrame, fan: bool = False, group: str = "group_id", order: str = "idx") -> DataFrame:
    """Triangles of a strip (every other one turned, so that all wind alike) or of a fan around the first index."""
    w = _in_order(group, order)
    nth = F.row_number().over(w)
    back = F.first("v").over(w.rowsBetween(Window.unboundedPreceding, 0)) if fan else F.lag("v", 2).over(w)
    near = indices.withColumns({"nth": nth, "a": back, "b": F.lag("v", 1).over(w)}).where("nth >= 3")
    turned = F.lit(False) if fan else F.col("nth") % 2 == 0
    return near.select(group, (F.col("nth") - 3).alias("triangle"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), F.col("v").alias("c"))


def composite_read(segments: DataFrame, requests: DataFrame, bucket: int = 4096) -> DataFrame:
    """Pieces of segments that each request needs: ``(composite_id, request_id, seg_no, source_start, length)``.

    Segments ``(composite_id, seg_no, source_start, length)`` follow one another; their
    places are a prefix sum. Requests ``(composite_id, request_id, start, length)`` meet
    them through the places' buckets, so the interval join is an equality join.
    """
    w = Window.partitionBy("composite_id").orderBy("seg_no")
    placed = segments.withColumn("at", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))

    def over(start: Column, length: Column) -> Column:
        return F.explode(F.sequence(div(start, bucket), div(start + length - 1, bucket)))

    s = placed.where("length > 0").withColumn("bucket", over(F.col("at"), F.col("length"))).alias("s")
    r = requests.where("length > 0").withColumn("bucket", over(F.col("start"), F.col("length"))).alias("r")
    low, high = F.greatest("s.at", "r.start"), F.least(F.col("s.at") + F.col("s.length"), F.col("r.start") + F.col("r.length"))
    met = s.join(r, (F.col("s.composite_id") == F.col("r.composite_id")) & (F.col("s.bucket") == F.col("r.bucket"))).where((low < high) & (div(low, bucket) == F.col("s.bucket")))
    return met.select("s.composite_id", "r.request_id", "s.seg_no", (F.col("s.source_start") + low - F.col("s.at")).alias("source_start"), (high - low).alias("length"))


def strided_offsets(start: int, stride: int, payload_offset: int, payload: int, logical: Column) -> Column:
    """The physical place of a logical one in records of which only a payload counts; NULL for impossible geometry and past BIGINT."""
    if stride <= 0 or payload <= 0 or payload_offset + payload > stride:
        return F.lit(None).cast("long")
    record = div(logical, payload)
    return F.try_add(F.try_multiply(record, F.lit(stride).cast("long")), start + payload_offset + (logical - record * payload))


def read_ranges(carriers: DataFrame, ranges: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Exact ranges of carriers, each as a row: ``(key, range_no, bytes, status)``; ``outside`` ranges have no bytes, empty ones are legal.

    Ranges are ``(key, range_no, start, length)``; those of one carrier are cut from it where it is read once.
    """
    asked = ranges.groupBy(key).agg(F.collect_list(F.struct("range_no", "start", "length")).alias("__ranges"))
    each = carriers.join(asked, key).select(key, content, F.explode("__ranges").alias("__r"))
    got = span(F.col(content), F.col("__r.start"), F.col("__r.length"))
    return each.select(key, F.col("__r.range_no").alias("range_no"), got.alias("bytes"), F.when(got.isNull(), "outside").otherwise("ok").alias("status"))


def composite_bytes(segments: DataFrame, sources: DataFrame, key: str = "composite_id") -> DataFrame:
    """The whole of each composite: ``(key, content)``.

    Segments ``(key, seg_no, source_id, start, length)`` follow one another; one without a source is a
    hole of zeros. A composite with a segment outside its source has NULL content. Sources are
    ``(source_id, content)``; a composite's own bytes come together, as its content is one value.

    Every range that segments share is cut from its source once and written, so that segments meet
    pieces, not sources; few pieces are sent to the segments, which are then shuffled only by composite.
    """
    at = ["source_id", "start", "length"]
    ranges = segments.where("source_id is not null").select(*at).distinct().groupBy("source_id").agg(F.collect_list(F.struct("start", "length")).alias("__ranges"))
    each = sources.select("source_id", F.col("content").alias("__c")).join(ranges, "source_id").select("source_id", "__c", F.explode("__ranges").alias("__r"))
    cut = each.select("source_id", "__r.start", "__r.length", span(F.col("__c"), F.col("__r.start"), F.col("__r.length")).alias("__piece"))
    met = segments.join(written(cut, "pieces"), at, "left")
    piece = F.when(F.col("source_id").isNull(), zeros(F.col("length"))).otherwise(F.col("__piece"))
    by = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg_no", piece.alias("piece")))).alias("p"))
    whole = F.when(~F.exists("p", lambda x: x["piece"].isNull()), F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), "")))
    return by.select(key, whole.alias("content"))
