"""Token-id shards with a minimal perfect hash index for keyed access.

A shard is two files. ``*.ids`` is the raw payload: the ids of its documents in ascending
key order, little-endian, two bytes each if the vocabulary allows, else four. ``*.idx`` is
the index: a JSON header (counts, width, level sizes), the levels of the perfect hash, and
by slot the key's 32-bit fingerprint, the first id's position and the number of ids. The
keys themselves are not stored: a looked-up key whose fingerprint differs is absent.
"""

from __future__ import annotations

import json
import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import bounded_batches, fresh_dir, held, open_fs, read_tasks, written
from bytelode.llm.perfect_hash import PerfectHash, mix
from bytelode.llm.tokens import TokenEncoder

_MAGIC = b"TOKSHRD1"
_MANIFEST = "shard string, doc_id long, copy long, position long, n_tokens long"
_READ = 4 << 20


def key_hashes(ids, copies):
    """64-bit keys of (id, how many rows with that id come before); a null id is another value."""
    import numpy as np

    null = np.array([i is None for i in ids], dtype=np.uint64)
    own = np.array([0 if i is None else i for i in ids], dtype=np.int64).view(np.uint64)
    copies = np.asarray(copies, dtype=np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return mix(own) ^ (mix(copies, 7) * np.uint64(2) * (copies > 0)) ^ (null * np.uint64(0xA5A5A5A5A5A5A5A5))


def write_index(path: str, fs, ids, copies, positions, counts, width: int) -> None:
    import numpy as np

    keys = key_hashes(ids, copies)
    perfect = PerfectHash.build(keys)
    slots = perfect.slots(keys)
    by_slot = [np.zeros(len(keys), dtype=d) for d in ("<u4", "<i8", "<i8")]
    for to, values in zip(by_slot, (mix(keys, 99) >> np.uint64(32), positions, counts), strict=True):
        to[slots] = values
    head = json.dumps({"n": len(keys), "width": width, "levels": [len(x) for x in perfect.levels]}).encode()
    with fs.open_output_stream(path) as f:
        f.write(_MAGIC + struct.pack("<I", len(head)) + head)
        for x in [x.astype("<u8") for x in perfect.levels] + by_slot:
            f.write(x.tobytes())


class Shard:
    """Keyed access to one shard: constant time a key, by hash, slot and fingerprint."""

    def __init__(self, base: str, fs):
        import numpy as np

        with fs.open_input_file(base + ".idx") as f:
            data = f.read()
        if data[:8] != _MAGIC:
            raise ValueError(f"{base}: not a token shard")
        at = 12 + struct.unpack_from("<I", data, 8)[0]
        head = json.loads(data[12:at])
        self.width = head["width"]

        def take(n: int, dtype: str):
            nonlocal at
            out = np.frombuffer(data, dtype=dtype, count=n, offset=at)
            at += out.nbytes
            return out

        self.perfect = PerfectHash([take(n, "<u8") for n in head["levels"]])
        self.fingerprints, self.positions, self.counts = (take(head["n"], d) for d in ("<u4", "<i8", "<i8"))
        self.payload = fs.open_input_file(base + ".ids")

    def find(self, ids, copies):
        """(there, position, count) for each key."""
        import numpy as np

        keys = key_hashes(ids, copies)
        slots = self.perfect.slots(keys)
        safe = np.maximum(slots, 0)
        if not len(self.counts):
            return slots >= 0, slots, slots
        there = (slots >= 0) & (self.fingerprints[safe] == (mix(keys, 99) >> np.uint64(32)).astype(np.uint32))
        return there, self.positions[safe], self.counts[safe]

    def read(self, position: int, count: int) -> bytes:
        return self.payload.read_at(count * self.width, position * self.width)


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encode all documents into shards in ascending ``doc_id`` order; the manifest ``(shard, doc_id, copy, position, n_tokens)``.

    The texts, not the longer ids, are dealt out by ranges of ``doc_id``, sorted, encoded
    and appended as they come. Files bear the task attempt's number and only those of a
    successful attempt are in the manifest, which Spark commits: a lost executor leaves
    files that nobody refers to. Rows that repeat a ``doc_id`` are told apart by ``copy``
    (0, 1, ...); null ids come first; null and empty texts hold ``end_id`` alone; an empty
    table has no shard.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    largest = max(json.loads(tokenizer_json)["model"]["vocab"].values()) + 1
    dtype = "<u2" if max(largest, end_id) < 1 << 16 else "<u4"
    shared, root = spark.sparkContext.broadcast(tokenizer_json), fresh_dir(spark, "token-store")

    def write(batches):
        encoder = None
        context = TaskContext.get()
        name = f"{root}/shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, base = open_fs(name)
        ids, copies, positions, counts, at, out = [], [], [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                import numpy as np

                encoder = held("encoder", root, lambda: TokenEncoder(shared.value, dtype))
                end = np.array([end_id], dtype=dtype).tobytes()
                fs.create_dir(open_fs(root)[1], recursive=True)
                out = fs.open_output_stream(base + ".ids")
            first = len(ids)
            for i, body in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist()), strict=True):
                out.write(body)
                out.write(end)
                copies.append(copies[-1] + 1 if ids and ids[-1] == i else 0)
                ids.append(i)
                positions.append(at)
                counts.append(len(body) // len(end) + 1)
                at += counts[-1]
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(ids) - first)), pa.array(ids[first:], pa.int64()), *(pa.array(x[first:], pa.int64()) for x in (copies, positions, counts))], names=["shard", "doc_id", "copy", "position", "n_tokens"])
        if encoder is not None:
            out.close()
            write_index(base + ".idx", fs, ids, copies, positions, counts, len(end))

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(dealt.mapInArrow(write, _MANIFEST), "token-manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """``(shard, base)``: the ids of all shards before. One row a shard."""
    from pyspark.sql import Window

    sizes = manifest.groupBy("shard").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.col("first").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_keys(keys: DataFrame) -> DataFrame:
    """Look up ``(shard, doc_id, copy)`` in the shards' files: ``(shard, doc_id, copy, position, n_tokens, ids_crc32)``.

    Keys are brought to their shard and each is found by hash and fingerprint; payloads
    next to each other are read together. There are as many tasks as the payload
    asks for, if ``keys`` has its n_tokens, else as shards. Absent keys give no row,
    keys that repeat repeated rows, an empty table none. ids_crc32 is over the
    ids as little-endian unsigned 32-bit numbers.
    """

    def read(batches):
        import numpy as np

        base, shard = None, None
        for batch in batches:
            names, ids, copies = (batch.column(k).to_pylist() for k in range(3))
            at = 0
            while at < len(names):
                to = at + 1
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if names[at] != base:
                    base = names[at]
                    fs, path = open_fs(base)
                    shard = Shard(path, fs)
                there, positions, counts = shard.find(ids[at:to], copies[at:to])
                rows, data_held, start, stop = [], b"", 0, 0
                for k in np.flatnonzero(there):
                    p, n = int(positions[k]), int(counts[k])
                    if not start <= p <= p + n <= stop:
                        start, stop = p, max(p + n, p + _READ // shard.width)
                        data_held = shard.read(p, stop - start)
                    data = data_held[(p - start) * shard.width : (p - start + n) * shard.width]
                    crc = zlib.crc32(np.frombuffer(data, dtype=f"<u{shard.width}").astype("<u4").tobytes())
                    rows.append((base, ids[at + k], copies[at + k], p, n, crc))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=cols)
                at = to

    kinds = [pa.string(), *[pa.int64()] * 5]
    cols = ["shard", "doc_id", "copy", "position", "n_tokens", "ids_crc32"]
    if "n_tokens" in keys.columns:
        tasks = read_tasks(keys.sparkSession, 4 * (keys.agg(F.sum("n_tokens")).first()[0] or 0))
    else:
        tasks = max(1, keys.select("shard").distinct().count())
    dealt = keys.select("shard", "doc_id", "copy").repartition(tasks, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "copy")
    return dealt.mapInArrow(read, "shard string, doc_id long, copy long, position long, n_tokens long, ids_crc32 long")


def stored_documents(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every stored document, read back from the files.

    ``start`` counts the ids of all documents before, in order of doc_id (null ids first, rows
    that repeat an id in turn). An empty manifest gives an empty result.
    """
    found = read_keys(manifest).join(shard_starts(manifest), "shard")
    return found.select("doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")
