"""WARC archives with an index: written by tasks, read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import bounded_batches, fresh_dir, open_fs, read_tasks, written

#: Payloads of fewer bytes are stored each time, however often they occur.
LEAST_REVISIT = 1000
_INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string, refers_to long"
_GAP, _SPAN, _FILE = 64 << 10, 8 << 20, 1 << 30
_DATE = "2025-01-01T00:00:00Z"


def _header_value(s: str) -> str:
    return s.replace("\r", "%0D").replace("\n", "%0A")


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = _DATE) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(member: bytes) -> dict:
    """What a record says: page_id, url, record_type, refers_to, payload (null in a revisit), payload_bytes and payload_digest of the full payload.

    A response's digest is taken from its bytes and must be the one in its header.
    """
    opened = zlib.decompressobj(31)
    data = opened.decompress(member)
    if not opened.eof or opened.unused_data:
        raise ValueError("not one whole record")
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("malformed record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    n = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    revisit, digest = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not match its digest")

    def page(name: str | None) -> int | None:
        of = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
        return None if of in ("", "null") else int(of)

    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")), "payload": None if revisit else payload, "payload_bytes": n, "payload_digest": digest}


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` and return the index.

    Index: page_id, url, file, offset, length, digest, record_type, refers_to. Of rows
    with equal payloads of ``least`` bytes or more, that with the largest page_id is the
    response (rows that repeat it are responses too; where all ids are null, all are),
    the others revisit it. Null html is an empty payload, a null url has no header line,
    line ends in a url are escaped in the header and kept in the index. An empty table
    writes nothing.

    Payloads that occur once are told from a light table first, so that only rows of the
    repeated ones must find their response; one shuffle at most moves html, and a hot
    payload's rows are split by the adaptive skew join. Files bear the number of the task attempt; the index,
    which Spark commits, lists those of successful attempts only.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("n"))
    keyed = p.select("page_id", "digest", "n").where(F.col("n") >= least)
    first = keyed.groupBy("digest", "n").agg(F.max("page_id").alias("winner"), F.count("*").alias("c")).where("c > 1 and winner is not null")
    first = written(first.select("digest", "n", "winner"), "repeated-payloads")
    rows = p.join(first, ["digest", "n"], "left").select("page_id", "url", F.encode("html", "utf-8").alias("html"), "digest", "winner")
    root = fresh_dir(spark, "warc")

    def write(batches):
        context = TaskContext.get()
        fs, base = open_fs(f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}")
        out, at, n, name = None, 0, 0, ""
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if out is None or at >= _FILE:
                    if out is None:
                        fs.create_dir(base.rsplit("/", 1)[0], recursive=True)
                    else:
                        out.close()
                    name, at, n = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{n}.warc.gz", 0, n + 1
                    out = fs.open_output_stream(open_fs(name)[1], compression=None)
                revisit = r["winner"] is not None and r["winner"] != r["page_id"]
                refers_to = r["winner"] if revisit else None
                data = record(r["page_id"], r["url"], r["html"], r["digest"], refers_to, revisit)
                out.write(data)
                index.append((r["page_id"], r["url"], name, at, len(data), r["digest"], "revisit" if revisit else "response", refers_to))
                at += len(data)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), kinds, strict=True)], names=names)
        if out is not None:
            out.close()

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in _INDEX.split(", ")]
    return written(rows.mapInArrow(write, _INDEX), "warc-index")


def read_records(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that rows of the index select, parsed from the archives.

    Rows are brought together by file and stretch of 4 MB, in as many tasks as the bytes
    that they select ask for, sorted by offset, and ranges that lie within 64 KB of each
    other are read at once, 8 MB at most (a longer record alone). With ``payloads`` false
    the payload column is left out. Index rows that repeat give repeated records, an empty
    selection none; a record whose payload does not match its digest is an error.
    """

    def read(batches):
        name, source, held, start, stop = None, None, b"", 0, 0
        for batch in batches:
            files, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            rows = []
            for k, (file, offset, length) in enumerate(zip(files, offsets, lengths, strict=True)):
                if file != name:
                    fs, path = open_fs(file)
                    name, source, held, start, stop = file, fs.open_input_file(path), b"", 0, 0
                if not start <= offset <= offset + length <= stop:
                    start, stop, j = offset, offset + length, k + 1
                    while j < len(files) and files[j] == file and offsets[j] - stop <= _GAP and offsets[j] + lengths[j] - start <= _SPAN:
                        stop, j = max(stop, offsets[j] + lengths[j]), j + 1
                    held = source.read_at(stop - start, start)
                got = parse(held[offset - start : offset - start + length])
                rows.append([got[c] for c in cols])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=cols)

    cols = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    stretch = F.shiftright("offset", 22)
    tasks = read_tasks(selected.sparkSession, selected.agg(F.sum("length")).first()[0] or 0)
    dealt = selected.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, schema)
