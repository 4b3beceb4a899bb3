"""Byte carriers and ordinals from the tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelode.functions.binary import uint_bytes, word_at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, content)``: each document's UTF-8 bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(group_id, idx, size)``: the quantities of each order in a total order of its lines, as line numbers repeat.

    Lines that are equal up to their quantity have the same size, so further columns cannot change a row.
    Orders have their name before the window, so that a later step by ``group_id`` finds them together.
    """
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    w = Window.partitionBy("group_id").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return line.select("group_id", F.row_number().over(w).alias("idx"), F.col("l_quantity").cast("long").alias("size"))


def size_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(group_id, z, n)``: the quantities of each order as one array, in the order of ``sizes``, and how many they are.

    Lines come together once and are put in order within their array, without a window over them.
    """
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity").alias("line"))
    by = line.repartition("group_id").groupBy("group_id").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.count("*").alias("n"))
    return by.select("group_id", F.col("lines.l_quantity").cast("array<bigint>").alias("z"), "n")


def files(spark: SparkSession, folder: str, extension: str, recursive: bool = False) -> DataFrame:
    """Files of a folder with an extension, whatever its case, as ``(path, modificationTime, length, content)`` in order of path.

    Dot files and the three expectation files are left out; an empty extension is no file's.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.substring_index("path", "/", -1)
    kept = found.where(~name.startswith(".") & ~name.isin("spec.json", "manifest.json", "versions.json"))
    return kept.where(F.lower(name).endswith("." + extension.lower()) if extension else F.lit(False)).orderBy("path")


_PAIR = b"SCEPAIR1"


def pair_bytes(codec: str, provenance: str, raw: bytes, stored: bytes) -> bytes:
    c, p = codec.encode(), provenance.encode()
    sizes = (len(c).to_bytes(4, "little"), len(p).to_bytes(4, "little"), len(raw).to_bytes(8, "little"), len(stored).to_bytes(8, "little"))
    return b"".join((_PAIR, *sizes, c, p, raw, stored))


def parse_pair(data: bytes | None) -> dict | None:
    """codec, provenance, raw and stored of a pair file; NULL if it is malformed. Bytes after the bodies are ignored."""
    if data is None or len(data) < 32 or data[:8] != _PAIR:
        return None
    n = [int.from_bytes(data[a:b], "little") for a, b in ((8, 12), (12, 16), (16, 24), (24, 32))]
    if len(data) < 32 + sum(n):
        return None
    parts, at = [], 32
    for k in n:
        parts.append(data[at : at + k])
        at += k
    try:
        return {"codec": parts[0].decode(), "provenance": parts[1].decode(), "raw": parts[2], "stored": parts[3]}
    except UnicodeDecodeError:
        return None


def pairs(found: DataFrame) -> DataFrame:
    """Pair files that parse, as ``(path, codec, provenance, raw, stored)``."""

    @F.arrow_udf("struct<codec: string, provenance: string, raw: binary, stored: binary>")
    def parse(values: pa.Array) -> pa.Array:
        kind = pa.struct([("codec", pa.string()), ("provenance", pa.string()), ("raw", pa.binary()), ("stored", pa.binary())])
        return pa.array(map(parse_pair, values.to_pylist()), kind)

    return found.select("path", parse("content").alias("p")).where("p is not null").select("path", "p.*")


def as_pairs(rows: DataFrame, codec: Column, provenance: Column, raw: Column, stored: Column, key: str) -> DataFrame:
    """``(key, name, content)``: pair files, named by the first 32 digits of a digest over codec, raw and stored bytes."""
    c, p = F.encode(codec, "utf-8"), F.encode(provenance, "utf-8")
    nul = F.unhex(F.lit("00"))
    digest = F.sha2(F.concat(c, nul, raw, nul, stored), 256)
    lengths = F.concat(uint_bytes(F.octet_length(c), 4), uint_bytes(F.octet_length(p), 4), uint_bytes(F.octet_length(raw), 8), uint_bytes(F.octet_length(stored), 8))
    content = F.concat(F.lit(_PAIR.decode()).cast("binary"), lengths, c, p, raw, stored)
    return rows.select(key, F.concat(F.left(digest, F.lit(32)), F.lit(".pair")).alias("name"), content.alias("content"))


def write_pairs(rows: DataFrame, codec: Column, provenance: Column, raw: Column, stored: Column, key: str, folder: str) -> None:
    """Write pair files' names and bytes as a table partitioned by the first digit of the name; equal pairs are one row."""
    made = as_pairs(rows, codec, provenance, raw, stored, key).drop(key).dropDuplicates(["name"])
    made.withColumn("head", F.left("name", F.lit(1))).write.partitionBy("head").parquet(folder)


def read_pairs(files: DataFrame, *keys: str, codec: str | None = None) -> DataFrame:
    """Pair files that are whole, by column expressions: ``(*keys, codec, provenance, raw, stored)``, of one codec if it is named. Bytes after the bodies are ignored."""
    c = F.col("content")
    names = ("codec", "provenance", "raw", "stored")
    lengths = F.array(*(word_at(c, F.lit(at), 4) for at in (8, 12, 16, 24)), word_at(c, F.lit(20), 4), word_at(c, F.lit(28), 4))
    sized = files.select(*keys, c, lengths.alias("__n")).where((F.substring(c, 1, 8) == F.lit(_PAIR.decode()).cast("binary")) & (F.get("__n", F.lit(4)) == 0) & (F.get("__n", F.lit(5)) == 0))
    ends = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.aggregate(F.slice("__n", F.lit(1), k), F.lit(32).cast("long"), lambda a, x: a + x))
    placed = sized.withColumn("__at", ends).where(F.octet_length(c) >= F.get("__at", F.lit(4)))
    parts = [F.substring(c, (F.get("__at", F.lit(k)) + 1).cast("int"), F.get("__n", F.lit(k)).cast("int")) for k in range(4)]
    found = placed.select(*keys, *(x.cast("string").alias(n) if k < 2 else x.alias(n) for k, (n, x) in enumerate(zip(names, parts, strict=True))))
    found = found.where(F.is_valid_utf8("codec") & F.is_valid_utf8("provenance"))
    return found if codec is None else found.where(F.col("codec") == codec)
