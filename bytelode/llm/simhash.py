"""SimHash fingerprints and near-duplicate groups with pivot distance tables."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import bounded_batches, fresh_name, written
from bytelode.llm.components import connected_components

#: Fingerprints whose distances to all others of a bucket are taken pairwise; larger buckets go the linear way.
BUCKET = 256
PIVOTS = 8
_BLOCKS = list(combinations(range(4), 2))
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Bytes of a text from which its words are found one by one.
_WHOLE = 1 << 22


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number; 0 without words. A long text's words are taken in blocks."""
    import numpy as np
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z and ASCII white space only
    found = iter(data.split()) if len(data) < _WHOLE else (m.group() for m in _WORD.finditer(data))
    h, ones, n, words = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0, []
    while more := list(islice(found, 65536)):
        words += more
        if n or len(words) >= shingle:
            hashes = [h(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
            ones += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n += len(hashes)
            words = words[len(words) - shingle + 1 :]
    if not n and words:
        return h(b" ".join(words), 42)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", *also: str) -> DataFrame:
    """``(doc_id, fp)`` and the columns ``also``, one row per row of ``docs``; a null text counts as empty."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def signed(texts: pa.Array) -> pa.Array:
        return pa.array(((f := fingerprint(t)) - (1 << 64) * (f >> 63) for t in texts.to_pylist()), pa.int64())

    return docs.select(F.col(key).alias("doc_id"), signed(F.col(text)).alias("fp"), *also)


def _pivots(n: int) -> list[int]:
    """Reference fingerprints that do not depend on the data."""
    import xxhash

    return [(f := xxhash.xxh64_intdigest(f"pivot {k}", 42)) - (1 << 64) * (f >> 63) for k in range(n)]


def _bits(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * block).bitwiseAND(F.lit(0xFFFF))


def near_links(fps: DataFrame, pivots: int = PIVOTS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(u, v)`` over distinct fingerprints, connecting all that differ in 2 bits or fewer.

    Two such fingerprints agree in two of four 16-bit blocks at least, so each is
    filed under six keys of 32 bits. Within a key, a pair is dropped when any
    coordinate of the pivot distance table differs by more than 2 (the triangle
    inequality makes that safe), and survivors are verified. A key with more than
    ``bucket`` fingerprints would make a square of pairs; its members are filed
    instead under their value with each two of the 32 free bits cleared, and linked
    to the least of each such file: all in one file are within 2 bits, and each pair
    within 2 bits shares a file, so the same groups arise from linearly many rows.
    """
    fp = F.col("fp")
    coordinates = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte").alias(f"p{k}") for k, p in enumerate(_pivots(pivots))]
    keys = F.array(*(F.lit(n << 32).bitwiseOR(F.shiftleft(_bits(fp, a), 16)).bitwiseOR(_bits(fp, b)) for n, (a, b) in enumerate(_BLOCKS)))
    filed = fps.select("fp", *coordinates, F.explode(keys).alias("key"))
    hot = written(filed.groupBy("key").count().where(F.col("count") > bucket).select("key"), "hot-keys")
    some_hot = not hot.isEmpty()
    cold = filed.join(hot, "key", "left_anti") if some_hot else filed
    left, right = cold.alias("a"), cold.alias("b")
    near = reduce(lambda x, y: x & y, [F.abs(F.col(f"a.p{k}") - F.col(f"b.p{k}")) <= 2 for k in range(pivots)])
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2
    links = left.join(right, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near & verified)
    edges = links.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
    if some_hot:
        edges = edges.union(_wildcard_links(filed.join(hot, "key").select("fp", F.shiftrightunsigned("key", 32).alias("n")).distinct()))
    return edges


def _wildcard_links(members: DataFrame) -> DataFrame:
    masks = []
    for kept in _BLOCKS:
        free = [i for i in range(64) if i // 16 not in kept]
        masks.append(F.array(*(F.lit((m := 1 << i | 1 << j) - (1 << 64) * (m >> 63)) for i, j in combinations(free, 2))))
    mask = F.element_at(F.array(*masks), (F.col("n") + 1).cast("int"))
    files = members.select("fp", F.explode(mask).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest")).distinct()
    least = files.groupBy("mask", "rest").agg(F.min("fp").alias("m"), F.count("*").alias("c")).where("c > 1")
    return files.join(least, ["mask", "rest"]).where("fp <> m").select(F.col("m").alias("u"), F.col("fp").alias("v")).distinct()


def _groups(fps: DataFrame) -> DataFrame:
    """``(fp, component_id)`` of distinct fingerprints of ``fps(doc_id, fp)``."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(near_links(distinct.select("fp")))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return joined.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Documents are linked when their fingerprints differ in 2 bits or fewer, so texts
    without words (null, empty, blank) are one group: their fingerprint is zero.
    ``component_id`` is the least ``doc_id`` reachable. Only distinct fingerprints are
    compared, so a group of copies of any size costs one row; links are kept as
    edges to be contracted, never as all pairs of a group. Rows that repeat a
    ``doc_id`` keep a row each; a null ``doc_id`` is never a component's least unless
    all of its ids are null. Other columns are not looked at. An empty table gives
    an empty result.
    """
    fps = written(fingerprints(docs, key, text), "fingerprints")
    return fps.join(_groups(fps).drop("root"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group; all columns stay as they are.

    Rows are judged one by one, whatever ids they share: of a group the row of the least
    id stays (null ids come last), of more rows with that id the one whose hash over all
    columns is least, of rows equal in all columns one. So a text that is near no other
    always stays. An empty table gives an empty result.
    """
    mark, of, n = (fresh_name(docs, x) for x in ("row_hash", "kept_id", "n_rows"))
    columns = [F.map_entries(c) if docs.schema[c].dataType.typeName() == "map" else F.col(c) for c in docs.columns]
    marked = docs.withColumn(mark, F.xxhash64(*columns))
    prints = fingerprints(marked, key, text, mark)
    rows = written(prints.groupBy("fp", "doc_id", mark).agg(F.count("*").alias(n)), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias(of), F.col(mark).alias(mark), F.col(n).alias(n)))
    stay = rows.join(_groups(rows).select("fp", "root"), "fp").groupBy("root").agg(first.alias("s")).select("s.*").drop("no_id").withColumnRenamed(mark, f"{mark}_")
    kept = marked.join(stay, marked[key].eqNullSafe(F.col(of)) & (F.col(mark) == F.col(f"{mark}_")))
    once, more = kept.where(F.col(n) == 1), kept.where(F.col(n) > 1).dropDuplicates([key, mark])
    return once.unionByName(more).select(*docs.columns)
