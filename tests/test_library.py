"""Operators against definitions in plain Python, and every registered query on the smallest tables."""

import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bytelode.functions import binary, codecs, pixels
from bytelode.operators import catalog, layout, tables
from bytelode.plans import registry
from bytelode.sources import carriers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object).where(frame[cols].notna(), None)
    return sorted(repr(tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_its_oracle(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLE_SQL:
        want = db.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(want.columns) == sorted(got.columns) and rows_of(got) == rows_of(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_reads_at_the_edges(spark):
    df = spark.createDataFrame([(bytearray(range(n)),) for n in (0, 3, 4, 5, 12)], "c binary")
    c = F.col("c")
    got = df.select(F.octet_length(c), binary.uint(c, 1, 4), binary.truncated(c, 1, 4)["available"], binary.uint(c, 4, 8).cast("string"), F.hex(binary.span(c, 2, 3)), F.hex(binary.span(c, 5, 0))).collect()
    le = int.from_bytes(bytes(range(1, 5)), "little")
    assert [tuple(r) for r in got] == [(0, None, 0, None, None, None), (3, None, 2, None, None, None), (4, None, 3, None, None, None), (5, le, None, None, "020304", ""), (12, le, None, str(int.from_bytes(bytes(range(4, 12)), "little")), "020304", "")]


def test_signs_and_writes(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\x80\x00\x7f\xff\xff\xff\xff"), -1), (bytearray(b"\x01\x00\x00\x80\x00\x00\x00\x80"), 70000)], "c binary, v long")
    c, v = F.col("c"), F.col("v")
    got = df.select(binary.sint(c, 0, 1), binary.sint(c, 0, 2), binary.sint(c, 0, 4), binary.uint(c, 0, 8).cast("string"), F.hex(binary.uint_bytes(v, 2)), F.hex(binary.uint_bytes(v, 4)), F.hex(binary.uint_bytes(v, 3, True))).collect()
    for r, data, value in zip(got, (b"\xff\x80\x00\x7f\xff\xff\xff\xff", b"\x01\x00\x00\x80\x00\x00\x00\x80"), (-1, 70000), strict=True):
        want = [int.from_bytes(data[:n], "little", signed=True) for n in (1, 2, 4)] + [str(int.from_bytes(data, "little"))]
        want += [None, None, None] if value < 0 else [None, value.to_bytes(4, "little").hex().upper(), value.to_bytes(3, "big").hex().upper()]
        assert list(r) == want


def test_nul_fields_count_bytes(spark):
    df = spark.createDataFrame([(bytearray(x),) for x in (b"\xc3\xa9\x00x", b"\xff\xfe\x00", b"abcd", b"\x00", b"")], "c binary")
    got = df.select(binary.nul_length(F.col("c"), 8), F.hex(binary.fixed_string(F.col("c"), 3)), F.hex(binary.padded(F.col("c"), 4)), binary.zero_tail(F.col("c"), 0, 2)).collect()
    assert [tuple(r) for r in got] == [(2, "C3A9", None, False), (2, "FFFE", None, False), (None, "616263", None, False), (0, None, None, True), (None, None, "00000000", True)]


def crc_by_bits(data, width, poly, start, reflected, final):
    c = start
    for b in data:
        for k in range(8):
            bit = b >> (k if reflected else 7 - k) & 1
            top = c & 1 if reflected else c >> width - 1
            c = (c >> 1 if reflected else c << 1 & (1 << width) - 1) ^ (poly if top ^ bit else 0)
    return c ^ final


def test_checksums_follow_their_definitions():
    rng = random.Random(1)
    for n in (0, 1, 9, 300):
        data = rng.randbytes(n)
        assert codecs.crc32_mpeg2(data) == crc_by_bits(data, 32, 0x04C11DB7, 0xFFFFFFFF, False, 0)
        assert codecs.crc16_ibm(data) == crc_by_bits(data, 16, 0xA001, 0, True, 0)
        assert zlib.crc32(data) == crc_by_bits(data, 32, 0xEDB88320, 0xFFFFFFFF, True, 0xFFFFFFFF)
    assert codecs.crc16_ibm(b"123456789") == 0xBB3D


def test_decoders_are_whole_or_nothing():
    data = b"the fox " * 400
    for wbits in (-15, 15, 31):
        c = zlib.compressobj(6, zlib.DEFLATED, wbits)
        packed = c.compress(data) + c.flush()
        assert codecs.inflate(packed + b"rest", wbits) == (data, len(packed))
        assert codecs.inflate(packed[:-3], wbits) is None and codecs.inflate(packed, wbits, len(data) - 1) is None
        assert codecs.inflate(packed, wbits, len(data)) == (data, len(packed))
    assert codecs.inflate(b"", 15) is None
    for n in (0, 1, 65535, 65536):
        assert zlib.decompress(codecs.zlib_stored(b"a" * n)) == b"a" * n


@pytest.mark.parametrize("msb", [False, True])
def test_lzss_round_trips(msb):
    rng = random.Random(2)
    for n in (0, 1, 7, 8, 9, 17, 18, 19, 4096, 8193):
        for alphabet in (4, 127, 255):
            data = bytes(rng.randrange(alphabet) for _ in range(n))
            assert codecs.lzss_decode(codecs.lzss_encode(data, msb), n, msb, strict=True) == data
    assert codecs.lzss_decode(bytes.fromhex("034142EEF0"), 5) == b"ABABA"
    assert codecs.lzss_decode(b"\0\0\0", 1) == b"\0" and codecs.lzss_decode(b"\0\0\0", 1, strict=True) is None
    assert codecs.lzss_decode(b"\x00\xfe\xff", 18, fill=32) == b" " * 18
    assert codecs.lzss_decode(b"", 1) is None


def test_block_textures_texel_by_texel():
    rng = random.Random(3)

    def expand(c):
        r, g, b = c >> 11, c >> 5 & 63, c & 31
        return r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2

    for kind, size in (("dxt1", 8), ("dxt3", 16), ("dxt5", 16)):
        for w, h in ((4, 4), (5, 3), (9, 8)):
            across = -(-w // 4)
            data = rng.randbytes(across * -(-h // 4) * size)
            got = pixels.texels(data, w, h, kind)
            for y in range(h):
                for x in range(w):
                    block = data[(y // 4 * across + x // 4) * size :][:size]
                    c, t = block[size - 8 :], y % 4 * 4 + x % 4
                    c0, c1 = int.from_bytes(c[:2], "little"), int.from_bytes(c[2:4], "little")
                    k, (a, z) = int.from_bytes(c[4:], "little") >> 2 * t & 3, (expand(c0), expand(c1))
                    alpha = 255
                    if kind == "dxt1" and c0 <= c1 and k >= 2:
                        rgb, alpha = (tuple((p + q) // 2 for p, q in zip(a, z, strict=True)), 255) if k == 2 else ((0, 0, 0), 0)
                    else:
                        rgb = (a, z, tuple((2 * p + q) // 3 for p, q in zip(a, z, strict=True)), tuple((p + 2 * q) // 3 for p, q in zip(a, z, strict=True)))[k]
                    if kind == "dxt3":
                        alpha = (int.from_bytes(block[:8], "little") >> 4 * t & 15) * 17
                    if kind == "dxt5":
                        e0, e1, j = block[0], block[1], int.from_bytes(block[2:8], "little") >> 3 * t & 7
                        alpha = (e0, e1)[j] if j < 2 else ((8 - j) * e0 + (j - 1) * e1) // 7 if e0 > e1 else ((6 - j) * e0 + (j - 1) * e1) // 5 if j < 6 else (0, 255)[j - 6]
                    assert tuple(got[(y * w + x) * 4 :][:4]) == (*rgb, alpha)
    assert pixels.texels(b"\0" * 7, 4, 4, "dxt1") is None and pixels.texels(b"", 0, 4, "dxt1") is None


def test_aligned_chain_is_the_sequential_one(spark):
    rng = random.Random(4)
    sizes = [(g, i, rng.randrange(60)) for g in range(5) for i in range(12)]
    got = {(r.group_id, r.idx): r.start for r in layout.aligned_chain(spark.createDataFrame(sizes, "group_id long, idx int, size long"), 13, 8).collect()}
    for g in range(5):
        end = None
        for i in range(12):
            start = 13 if end is None else -(-end // 8) * 8
            assert got[g, i] == start
            end = start + sizes[g * 12 + i][2]


def test_pairs_and_files(spark, tmp_path):
    good = carriers.pair_bytes("lzss", "made", b"raw", b"st")
    for name, data in (("a.pair", good + b"ignored"), ("b.PAIR", good[:-1]), (".c.pair", good), ("spec.json", b"{}"), ("d.bin", b"x")):
        (tmp_path / name).write_bytes(data)
    assert carriers.files(spark, str(tmp_path), "").count() == 0
    found = carriers.pairs(carriers.files(spark, str(tmp_path), "pair")).collect()
    assert [(r.codec, r.provenance, bytes(r.raw), bytes(r.stored)) for r in found] == [("lzss", "made", b"raw", b"st")]


def test_half_values_over_the_whole_domain(spark):
    words = spark.range(65536).select("id", binary.half_value(F.col("id")).alias("v")).toPandas().sort_values("id")
    assert np.array_equal(words["v"].to_numpy(), np.arange(65536, dtype="<u2").view("<f2").astype("f8"), equal_nan=True)
    assert spark.sql("SELECT CAST(NULL AS INT) AS w").select(binary.half_value(F.col("w"))).first()[0] is None


def test_detection_reads_whole_carriers(spark, tmp_path):
    late = "<!-- " + "x" * 100 + " -->"
    spark.createDataFrame([(1, "http://a/b", " " * 100 + "<html>"), (2, "http://a/b.html", late)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "{ " + " " * 80 + '"k":1}'), (2, None)], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(1, "y" * 90 + ": z"), (2, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.carrier_kind, r.carrier_id): (r.status, r.format, r.method) for r in registry.detect_formats(spark, str(tmp_path)).collect()}
    unknown = ("unknown", None, None)
    assert got == {("page", 1): ("selected", "html-any", "structural"), ("page", 2): ("selected", "markup", "magic"), ("event", 1): ("selected", "pairs", "structural"), ("event", 2): unknown, ("document", 1): ("selected", "colon-prose", "structural"), ("document", 2): unknown}


def test_contextual_probes_and_byte_alignment(spark):
    probes = spark.createDataFrame([("a", 1, "structural", 0, b": ", None, None), ("b", 2, "contextual", 0, b"x", "DAT", "maps/Low")], "format string, precedence int, kind string, at int, digits binary, extension string, parent string")
    hints = spark.createDataFrame([], "format string, ext string")
    rows = [(b"\x13\xa2\x01", "", None), (b"_: ", "", None), (b"_x", "dat", "g//Maps/./low/f.dat"), (b"_x", "dat", "g/xmaps/low/f.dat"), (b"_x", "bin", "maps/low/f.bin"), (b"_x", "dat", None), (b"_y", "dat", "maps/low/f.dat")]
    carriers_ = spark.createDataFrame([("c", k, *r) for k, r in enumerate(rows)], "carrier_kind string, carrier_id int, content binary, ext string, path string")
    got = {r.carrier_id: (r.format, r.method) for r in catalog.detect(carriers_, probes, hints).collect()}
    none = (None, None)
    assert got == {0: none, 1: ("a", "structural"), 2: ("b", "structural"), 3: none, 4: none, 5: none, 6: none}


def test_run_digests_see_sizes_and_bound_their_runs(spark):
    rows = [("s", k, f"n{k}", 256 + k) for k in range(-3, 8)]
    frame = spark.createDataFrame(rows, "g string, o long, name string, size long")
    got = catalog.run_digests(frame, "g", "o", F.col("name"), F.col("size"), 4).first()
    runs = [[r for r in rows if r[1] // 4 == at] for at in (-1, 0, 1)]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    names = sha("\n".join(sha("\n".join(r[2] for r in run).encode()) for run in runs).encode())
    sizes = sha("\n".join(sha(b"".join(r[3].to_bytes(8, "little") for r in run)) for run in runs).encode())
    assert tuple(got) == ("s", 11, names, sizes)
    other = catalog.run_digests(frame, "g", "o", F.col("name"), F.when(F.col("o") == 5, 1).otherwise(F.col("size")), 4).first()
    assert other.names_sha256 == names and other.sizes_sha256 != sizes


def test_shared_extension_counts_are_rows(spark):
    hints = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b"), ("y", "a"), ("", "a"), ("", "a")], "ext string, format string")
    assert sorted(map(tuple, catalog.shared_extension_counts(hints).collect())) == [("x", "a", 2, 3), ("x", "b", 1, 3)]


def test_alignment_masks_and_writes_at_the_ends_of_their_ranges(spark):
    big = (1 << 60) + 200
    rows = [(big, 0x7FFFFFFF), ((1 << 63) - 2, -(1 << 31)), (-5, 0x80000001 - (1 << 32)), (0, 0), (512, -1), (513, 0b0110), (7, 0b0101)]
    df = spark.createDataFrame(rows, "v long, m int")
    v, m = F.col("v"), F.col("m")
    got = df.select(binary.align_up(v, 256), binary.align_up(v, 3), binary.align_up(v, 3, True), binary.align_up(v, 0), binary.contiguous_mask(m)).collect()
    assert [r[0] for r in got] == [(1 << 60) + 256, None, 0, 0, 512, 768, 256]
    assert [r[1] for r in got] == [-(-big // 3) * 3, (1 << 63) - 2, -3, 0, 513, 513, 9]
    assert all(r[2] is None and r[3] is None for r in got)
    assert [r[4] for r in got] == [True, True, False, False, True, True, False]
    wide = spark.createDataFrame([("18446744073709551615",), ("18446744073709551616",), ("-1",), ("9223372036854775808",)], "d string").select(F.hex(binary.uint_bytes(F.col("d").cast("decimal(20,0)"), 8, True)))
    assert [r[0] for r in wide.collect()] == ["F" * 16, None, None, "80" + "0" * 14]
    signed = spark.createDataFrame([(-(1 << 63),), (-1,), ((1 << 63) - 1,)], "v long").select(F.hex(binary.sint_bytes(F.col("v"), 8)), F.hex(binary.sint_bytes(F.col("v"), 1))).collect()
    assert [tuple(r) for r in signed] == [("0" * 14 + "80", None), ("F" * 16, "FF"), ("F" * 14 + "7F", None)]
    strided = df.where("v >= 0").select(layout.strided_offsets(0, 20, 4, 10, v)).collect()
    assert strided[0][0] == big // 10 * 20 + 4 + big % 10


def test_directory_tables_on_the_smallest_carriers(spark):
    from bytelode.operators import edits, tables

    def words(*values):
        return bytearray(b"".join(v.to_bytes(4, "little") for v in values))

    df = spark.createDataFrame([(words(1, 12, 16) + b"abcd",), (words(0, 8),), (words(1, 16, 20) + b"\0\0\0\1abcd",), (bytearray(b""),), (None,)], "c binary")
    c = F.col("c")
    counted = df.select(tables.counted_boundaries(c, F.get(F.array(F.lit(1)), F.lit(0)), 4).alias("r")).collect()
    assert [r.r.status for r in counted[:4]] == ["ok", "truncated", "closure", "truncated"]
    assert [tuple(x) for x in counted[0].r.ranges] == [(12, 4)]
    gap = df.select(tables.counted_boundaries(c, F.lit(1), 4, F.lit(20), resident=False).alias("r")).collect()
    assert gap[2].r.status == "ok"  # the gap's bytes are left to the owner
    first = spark.createDataFrame([(words(4),), (words(8, 9),), (words(0),), (words(1 << 31),)], "c binary").select(tables.first_word_offsets(c, F.lit(12), 16).alias("r")).collect()
    assert [r.r.status for r in first] == ["ok", "ok", "table_length", "table_length"]
    assert [tuple(x) for x in first[1].r.ranges] == [(8, 1), (9, 3)]
    last = spark.createDataFrame([(words(8, 8),), (words(12, 12, 8),), (words(8, 12),)], "c binary").select(tables.terminal_offsets(c, F.lit(8), 16).alias("r")).collect()
    assert [(r.r.status, r.r.at) for r in last] == [("ok", None), ("table_length", None), ("offset", 1)]
    spliced = spark.createDataFrame([(bytearray(b"0123"), [])], "c binary, e array<struct<start: long, length: long, bytes: binary>>").select(edits.same_size_splice(c, F.col("e")).alias("r")).collect()
    assert spliced[0].r.status == "ok" and bytes(spliced[0].r.content) == b"0123"


def test_tables_read_their_words_once(spark):
    df = spark.createDataFrame([(b"".join(x.to_bytes(4, "little") for x in (1, 12, 16)) + b"abcd",)], "c binary")
    c = F.col("c")
    found = {"counted": tables.counted_boundaries(c, F.lit(1), 4), "first": tables.first_word_offsets(c, F.lit(16), 8), "terminal": tables.terminal_offsets(c, F.lit(16), 8)}
    for name, column in found.items():
        plan = df.select(column.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("conv(") <= 2, name  # the size word and the words


def test_sizes_of_an_order_come_together_once(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("terminal_offsets", "first_word_offsets", "counted_boundaries", "budget_admission"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, name
    listed = {r.group_id: (list(r.z), r.n) for r in carriers.size_lists(spark, sf).collect()}
    by = {}
    for r in carriers.sizes(spark, sf).orderBy("group_id", "idx").collect():
        by.setdefault(r.group_id, []).append(r.size)
    assert listed == {g: (z, len(z)) for g, z in by.items()} and max(map(len, by.values())) > 7


def test_bounds_are_running_sums(spark):
    from bytelode.plans import directories

    orders = spark.createDataFrame([(1, [3, 4, 5]), (2, []), (3, [1] * 5000)], "group_id long, z array<long>")
    began = time.time()
    got = {r.group_id: r.bounds for r in directories._with_bounds(orders, F.lit(8).cast("long"), 4).collect()}
    assert got[1] == [8, 20, 36, 56] and got[2] == [8] and got[3] == list(range(8, 8 + 4 * 5001, 4))
    assert time.time() - began < 15
    for name in ("terminal_offsets", "first_word_offsets", "counted_boundaries"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(") == 1, name


def test_a_table_without_content_has_no_ranges(spark):
    df = spark.createDataFrame([(None, 1), (bytearray(b""), 1)], "c binary, n int")
    counted = df.select(tables.counted_boundaries(F.col("c"), F.col("n"), 4).alias("r")).collect()
    assert [(r.r.status, r.r.ranges) for r in counted] == [("ok", None), ("truncated", None)]
    for of in (tables.first_word_offsets, tables.terminal_offsets):
        assert [(r.r.status, r.r.at, r.r.ranges) for r in df.select(of(F.col("c"), F.lit(9), 16).alias("r")).collect()] == [("truncated", None, None)] * 2
    packed = spark.createDataFrame([([1, 2],), ([1, None],), ([1 << 32],), ([],), (None,)], "v array<long>").select(F.hex(binary.array_bytes(F.col("v"), 4)).alias("h"), F.hex(binary.array_bytes(F.col("v"), 2, True)).alias("s")).collect()
    assert [tuple(r) for r in packed] == [("0100000002000000", "01000200"), (None, None), (None, None), ("", ""), (None, None)]


def test_words_and_their_bytes_at_the_limits(spark):
    values = [0, 1, 255, 256, (1 << 24) - 1, (1 << 32) - 1, 1 << 32, -1, (1 << 56) - 1, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for width in range(1, 9):
        for big in (False, True):
            got = [r[0] and bytes(r[0]) for r in df.select(binary.uint_bytes(F.col("v"), width, big)).collect()]
            assert got == [None if v is None or not 0 <= v < 1 << 8 * width else v.to_bytes(width, "big" if big else "little") for v in values]
    data = bytes(range(200, 256))
    c = spark.createDataFrame([(bytearray(data),)], "c binary")
    for width in range(1, 8):
        for big in (False, True):
            order = "big" if big else "little"
            got = c.select(binary.words_at(F.col("c"), F.lit(1), F.lit(9), width, big).alias("w"), binary.word_at(F.col("c"), F.lit(3), width, big).alias("x"), binary.word_at(F.col("c"), F.lit(56 - width + 1), width, big).alias("none")).first()
            want = [data[at : at + width] for at in range(1, 1 + 9 * width, width)]
            assert got.w == [int.from_bytes(x, order) if len(x) == width else None for x in want]
            assert (got.x, got.none) == (int.from_bytes(data[3 : 3 + width], order), None)


def test_divergences_of_long_carriers_are_found_quickly(spark):
    from bytelode.operators import rules

    long = bytes(range(256)) * 80_000
    rows = [(1, b"abc", b"abd"), (2, b"abc", b"xbc"), (3, b"abc", b"ab"), (4, b"", b"a"), (5, b"abc", b"abc"), (6, b"abc", None), (7, b"abcde", b"abcXeYY"), (8, b"", b"")]
    df = spark.createDataFrame([(f"c{k}", k, a, b) for k, a, b in rows], "codec string, id long, stored binary, encoded binary")
    got = {r.codec: (r.shallowest, r.exact, r.refused, r.diverged, r.other_length, r.samples) for r in rules.pair_ledger(df).collect()}
    assert got == {"c1": (2, 0, 0, 1, 0, [1]), "c2": (0, 0, 0, 1, 0, [2]), "c3": (None, 0, 0, 0, 1, [3]), "c4": (None, 0, 0, 0, 1, [4]), "c5": (None, 1, 0, 0, 0, None), "c6": (None, 0, 1, 0, 0, [6]), "c7": (3, 0, 0, 1, 0, [7]), "c8": (None, 1, 0, 0, 0, None)}
    big = spark.createDataFrame([("c", 1, bytearray(long), bytearray(long[:-2] + b"!" + long[-1:]))], "codec string, id long, stored binary, encoded binary")
    began = time.time()
    assert rules.pair_ledger(big).first().shallowest == len(long) - 2
    assert time.time() - began < 15


def test_usage_is_one_exchange_where_charges_come_by_group(spark):
    from bytelode.operators import rules

    rows = [("g", 1, "a", 3), ("g", 2, "a", 3), ("g", 2, "b", 1), ("g", 3, "a", 1), ("h", 1, "a", 5), (None, 1, "a", 1)]
    charges = spark.createDataFrame(rows, "g string, i int, dimension string, amount long").repartition(4, "g")
    used = rules.usage_snapshot(charges, {"a": 5, "b": 5}, "g", "i")
    got = {(r.g, r.dimension): (r.spent, r.peak, r.remaining, r.complete) for r in used.collect()}
    assert got == {("g", "a"): (3, 3, 2, False), ("g", "b"): (0, 0, 5, False), ("h", "a"): (5, 5, 0, True)}
    assert used._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_conflicts_of_copies_are_not_gathered_by_pair(spark):
    rnd = random.Random(5)
    rows = [(k // 2, rnd.randint(1, 2), 2 * rnd.randint(0, 2), "".join(rnd.choices("0a", k=rnd.choice((0, 2, 4))))) for k in range(120)] + [(300, 1, 0, None), (None, 1, 0, "0a")]
    got = catalog.probe_conflicts(spark.createDataFrame(rows, "format long, precedence int, at int, digits string"))
    want = set()
    for f, p, a, d in rows:
        for g, q, b, e in rows:
            if None not in (f, g, d, e) and f < g and p == q:
                low, high = max(a, b), min(a + len(d), b + len(e))
                if low < high and d[low - a : high - a] == e[low - b : high - b]:
                    want.add((f, g))
    pairs = [(r.a, r.b) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and want
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_block_digests_are_those_of_the_decoded_images(spark):
    data = random.Random(3).randbytes(512)
    df = spark.createDataFrame([(bytearray(data), 16, 16), (bytearray(data), 13, 7), (bytearray(b"short"), 16, 16), (None, 4, 4)], "c binary, w int, h int")
    for kind in ("dxt1", "dxt3", "dxt5"):
        rows = df.select(pixels.block_digests(kind)("c", "w", "h"), F.sha2(pixels.decode_blocks(kind)("c", "w", "h"), 256)).collect()
        assert [r[0] for r in rows] == [r[1] for r in rows] and rows[0][0] and rows[2][0] is None
    plan = registry.QUERIES["block_textures"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "decode(" not in plan and "sha2" not in plan  # no decoded image leaves a worker


def test_lzss_of_many_values_is_that_of_each_and_quick():
    rnd = random.Random(9)
    values = [b"", b"ab", b"aaaa" * 900, *(bytes(rnd.choices(b"abc ", k=rnd.randint(0, 900))) for _ in range(40)), b""]
    for msb in (False, True):
        packed = list(codecs.lzss_encode_all(values, msb, 5000))
        assert packed == [codecs.lzss_encode(v, msb) for v in values]
        assert [codecs.lzss_decode(p, len(v), msb, strict=True) for p, v in zip(packed, values)] == values
    prose = b" ".join(rnd.choices([rnd.randbytes(rnd.randint(2, 9)) for _ in range(2000)], k=250_000))
    began = time.process_time()
    assert codecs.lzss_decode(codecs.lzss_encode(prose), len(prose), strict=True) == prose
    assert time.process_time() - began < 1.2e-6 * len(prose)


def test_golden_rows_that_are_missing(spark):
    expected, actual = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string"), spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id long, v string")
    got = {r.id: (r.status, r.fields) for r in catalog.compare_golden(expected, actual, "id", ["v"]).collect()}
    assert got == {1: ("missing", None), 2: ("different", "v"), 3: ("equal", None), 4: ("unexpected", None)}


def test_composite_bytes_meet_pieces_and_not_whole_sources(spark):
    sources = spark.createDataFrame([(1, bytearray(b"abcdef")), (2, bytearray(b"xyz"))], "source_id long, content binary")
    rows = [(7, 2, 2, 0, 3), (7, 0, 1, 1, 3), (7, 1, None, 0, 2), (8, 0, 2, 1, 3), (9, 0, 3, 0, 1), (10, 0, 1, 1, 3), (10, 1, 1, 6, 0)]
    got = layout.composite_bytes(spark.createDataFrame(rows, "composite_id long, seg_no int, source_id long, start long, length long"), sources)
    assert {r.composite_id: r.content and bytes(r.content) for r in got.collect()} == {7: b"bcd\0\0xyz", 8: None, 9: None, 10: b"bcd"}
    assert "__c" not in got._jdf.queryExecution().optimizedPlan().toString()  # sources are not shuffled or copied by segment


def test_adler_and_bits_by_definition(spark):
    data = [b"", b"a", bytes(range(256)) * 20, b"\xff" * 9000]
    got = spark.createDataFrame([(bytearray(x),) for x in data], "c binary").select(binary.adler32(F.col("c"))).collect()
    assert [r[0] for r in got] == [zlib.adler32(x) for x in data]


def test_adler_of_a_long_carrier_is_quick(spark):
    long = spark.range(1).select(F.encode(F.repeat(F.lit("0123456789abcdef"), 2_000_000), "utf-8").alias("c"))
    began = time.time()
    assert long.select(binary.adler32(F.col("c"))).first()[0] == zlib.adler32(b"0123456789abcdef" * 2_000_000)
    assert time.time() - began < 8
    nothing = spark.createDataFrame([(None,)], "c binary").select(binary.adler32(F.col("c"))).first()[0]
    assert nothing is None


def test_walks_end_with_their_frontier_and_are_bounded(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    got = sorted((r.node, r.depth, r.event) for r in catalog.walk(edges, roots, 128).collect())
    assert got == [("a", 1, "mounted"), ("a", 4, "cycle"), ("b", 2, "mounted"), ("c", 3, "mounted")]
    for depth in (0, 129):
        with pytest.raises(ValueError):
            catalog.walk(edges, roots, depth)


def test_names_that_repeat_are_ambiguous_with_their_first_two(spark):
    rows = [("g", "x", 5), ("g", "x", 5), ("g", "y", 1), ("h", "x", 3), ("h", "x", 2), ("h", "x", 9)]
    got = {(r.g, r.n): (r.first, r.second, r.status) for r in catalog.select_by_name(spark.createDataFrame(rows, "g string, n string, k long"), "g", "n", "k").collect()}
    assert got == {("g", "x"): (5, 5, "ambiguous"), ("g", "y"): (1, None, "selected"), ("h", "x"): (2, 3, "ambiguous")}


def test_stream_detection_is_the_batch_one(spark, tmp_path):
    from bytelode.streaming.detection import detect_stream

    probes, hints = registry._probes(spark)
    rows = spark.createDataFrame([("page", k, bytearray(t), "html") for k, t in enumerate([b"<!DOCTYPE html>", b'{"a": 1}', b"nothing", b""])], "carrier_kind string, carrier_id long, content binary, ext string")
    rows.write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    stream = detect_stream(arriving, probes, hints, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    stream.processAllAvailable()
    stream.stop()
    got = spark.read.parquet(f"{tmp_path}/out").select("carrier_id", "status", "format").collect()
    want = catalog.detect(rows, probes, hints).select("carrier_id", "status", "format").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 4
