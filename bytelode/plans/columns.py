"""Queries over typed fields, strings, geometry and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.functions import binary as b
from bytelode.functions import geometry as g
from bytelode.functions import pixels
from bytelode.plans.base import _D, _h, query
from bytelode.sources.carriers import documents, table


def _listed(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


def _signed(at: int, width: int) -> str:
    v = _h(at, *reversed(range(width))) + "::BIGINT"
    return f"({v} - CASE WHEN {v} >= {1 << 8 * width - 1} THEN {1 << 8 * width} ELSE 0 END)"


def _list(width: int, signed: bool) -> str:
    return "[" + ", ".join(_signed(4 + k * width, width) if signed else _h(4 + k * width, *reversed(range(width))) + "::BIGINT" for k in range(3)) + "]::VARCHAR"


@query(_D + f"""SELECT doc_id, {_list(2, False)} AS u16s, {_list(2, True)} AS i16s, {_list(4, False)} AS u32s, {_list(4, True)} AS i32s, (({_h(4, 7, 6, 5, 4, 3, 2, 1, 0)})::UBIGINT)::VARCHAR AS u64, (({_h(4, 0, 1, 2, 3, 4, 5, 6, 7)})::UBIGINT)::VARCHAR AS u64_be FROM d WHERE n >= 16""")
def number_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of three numbers from offset 4 of each document, and one 64-bit number in both orders."""
    c = F.col("content")
    return documents(spark, sf_dir).where(F.octet_length(c) >= 16).select("doc_id", _listed(b.uints(c, 4, 3, 2)).alias("u16s"), _listed(b.sints(c, 4, 3, 2)).alias("i16s"), _listed(b.uints(c, 4, 3, 4)).alias("u32s"), _listed(b.sints(c, 4, 3, 4)).alias("i32s"), b.uint(c, 4, 8).cast("string").alias("u64"), b.uint(c, 4, 8, True).cast("string").alias("u64_be"))


@query(_D + f""", f AS (SELECT doc_id, {_h(0, 3, 2, 1, 0)}::BIGINT AS w, {_h(0, 0, 1, 2, 3)}::BIGINT AS v FROM d WHERE n >= 8)
SELECT doc_id, w AS bits, (CASE WHEN w >= 2147483648 THEN -1 ELSE 1 END * CASE WHEN (w // 8388608) % 256 = 0 THEN (w % 8388608) * pow(2.0, -149) ELSE (w % 8388608 + 8388608) * pow(2.0, (w // 8388608) % 256 - 150) END)::DOUBLE AS value, v AS big_bits FROM f WHERE (w // 8388608) % 256 < 255""")
def single_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four bytes of each document as a single float, but for infinities and no numbers; the same bits in the other order."""
    c = F.col("content")
    rows = documents(spark, sf_dir).where(F.octet_length(c) >= 8).select("doc_id", b.floats(c, 0, 2).alias("f"), b.f32(c, 0, True)["bits"].alias("big_bits"))
    one = F.get("f", F.lit(0))
    return rows.where(F.shiftright(one["bits"], 23).bitwiseAND(F.lit(255)) < 255).select("doc_id", one["bits"].alias("bits"), one["value"].alias("value"), "big_bits")


@query("""WITH k AS (SELECT o_orderkey, (o_orderkey * 7919) % 70000 - 2000 AS v, (o_orderkey * 104729) % 70000 - 35000 AS w FROM orders),
 x AS (SELECT *, CASE WHEN w < 0 THEN w + 65536 ELSE w END AS u FROM k)
SELECT o_orderkey, CASE WHEN v BETWEEN 0 AND 65535 THEN format('{:04X}', v % 256 * 256 + v // 256) END AS u16, CASE WHEN v >= 0 THEN format('{:06X}', v) END AS be3, CASE WHEN w BETWEEN -32768 AND 32767 THEN format('{:04X}', u % 256 * 256 + u // 256) END AS i16,
 CASE WHEN w BETWEEN -32768 AND 32767 THEN format('{:08X}', CASE WHEN w < 0 THEN w + 4294967296 ELSE w END) END AS i32_be, CASE WHEN v BETWEEN 0 AND 65535 THEN format('{:016X}', 18446744073709551615::UBIGINT - v::UBIGINT) END AS u64_be,
 CASE WHEN v >= 16 AND (v - 16) % 4 = 0 THEN '00000000' || format('{:04X}', ((v - 16) // 4) % 256 * 256 + (v - 16) // 4 // 256) || '0000FFFF' END AS put, CASE WHEN v BETWEEN 0 AND 65535 AND w BETWEEN -32768 AND 32767 THEN format('{:04X}', u % 256 * 256 + u // 256) || format('{:04X}', 5 * 256) END AS words FROM x""")
def typed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as fields of several kinds; those that do not fit are NULL."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ((k * 7919) % 70000 - 2000).alias("v"), ((k * 104729) % 70000 - 35000).alias("w"))
    v, w = F.col("v"), F.col("w")
    fits = w.between(-32768, 32767)
    top = F.lit(str((1 << 64) - 1)).cast("decimal(20,0)") - v
    base = F.unhex(F.lit("0000000000000000FFFF"))
    return rows.select(
        "o_orderkey",
        F.hex(b.uint_bytes(v, 2)).alias("u16"),
        F.hex(b.uint_bytes(v, 3, True)).alias("be3"),
        F.hex(b.sint_bytes(w, 2)).alias("i16"),
        F.hex(F.when(fits, b.sint_bytes(w, 4, True))).alias("i32_be"),
        F.hex(F.when(v.between(0, 65535), b.uint_bytes(top, 8, True))).alias("u64_be"),
        F.hex(b.put_scaled(base, 4, v, 4, 16)).alias("put"),
        F.hex(F.when(v.between(0, 65535) & fits, b.array_bytes(F.array(w, F.lit(5).cast("long")), 2, True))).alias("words"),
    )


@query("""WITH p AS (SELECT p_partkey, p_brand AS s, p_partkey % 3 AS k FROM part), f AS (SELECT *, octet_length(encode(s)) AS n FROM p)
SELECT p_partkey, CASE WHEN k <> 1 THEN s END AS nul, s AS nul_or_full, CASE WHEN k <> 2 THEN s END AS padded,
 'FFFF' || CASE WHEN k = 1 THEN '58592E2E2E2E2E2E' ELSE '585900' || repeat('2E', 5) END AS put, CASE WHEN k = 0 THEN hex(encode(s)) END AS prefixed, k = 0 AS zero_tail, (p_partkey % 256)::BIGINT - CASE WHEN p_partkey // 4 % 2 = 1 THEN 4 ELSE 0 END AS cleared,
 ((p_partkey * 7) % 512) IN (SELECT (2 ** (a + n) - 2 ** a)::BIGINT FROM range(0, 10) t(a), range(1, 10) u(n)) AS one_run FROM f""")
def string_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's brand as a positioned field: with NULs after it, filling the field, or with other bytes after its NUL; and fields written, prefixed, with tails, and bits."""
    k, s = F.col("p_partkey") % 3, F.encode("p_brand", "utf-8")
    n = F.octet_length(s)
    field = F.when(k == 1, s).when(k == 2, F.concat(s, F.unhex(F.lit("00414141")))).otherwise(F.concat(s, b.zeros(F.lit(4))))
    rows = table(spark, sf_dir, "part").select("p_partkey", k.alias("k"), F.concat(F.unhex(F.lit("FFFF")), field).alias("c"), s.alias("s"), F.octet_length(s).alias("n"))
    c, k = F.col("c"), F.col("k")
    rows = rows.withColumn("whole", F.concat(F.unhex(F.lit("FFFF")), F.unhex(F.repeat(F.lit("2E"), 8))))

    def read(policy: str) -> Column:
        by = [F.when(F.octet_length(c) == 2 + w, b.string_field(c, 2, w, policy)) for w in range(6, 16)]
        return F.decode(F.coalesce(*by), "utf-8").alias(policy)

    put = F.when(k == 1, b.splice(F.col("whole"), 2, F.encode(F.lit("XY"), "utf-8"))).otherwise(b.put_string(F.col("whole"), 2, 8, F.encode(F.lit("XY"), "utf-8"), "nul"))
    prefix = F.when(k == 0, b.prefixed(F.concat(b.uint_bytes(F.col("n"), 1), "s"), 1)).when(k == 1, b.prefixed(F.concat(b.uint_bytes(F.col("n") + 1, 2), "s"), 2))
    key = F.col("p_partkey")
    return rows.select("p_partkey", read("nul"), read("nul_or_full"), read("padded"), F.hex(put).alias("put"), F.hex(prefix).alias("prefixed"), b.zero_tail(c, F.col("n") + 2, 5).alias("t"), b.replace_bit(key % 256, 2, F.lit(False)).alias("cleared"), b.contiguous_mask((key * 7) % 512).alias("one_run")).withColumn("zero_tail", F.col("t") & (key % 3 == 0)).drop("t")


_K = "WITH k AS (SELECT c_custkey, (c_custkey * 37) % 8192 - 4096 AS x, (c_custkey * 101) % 8192 - 4096 AS y, (c_custkey * 7) % 4096 AS a FROM customer)"


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", ((k * 37) % 8192 - 4096).alias("x"), ((k * 101) % 8192 - 4096).alias("y"), ((k * 7) % 4096).alias("a"))


@query(_K + """, r AS (SELECT *, round(sin(a * 2 * pi() / 4096) * 4096)::BIGINT AS s, round(cos(a * 2 * pi() / 4096) * 4096)::BIGINT AS c FROM k),
 f AS (SELECT *, floor(s * 8192 / 4096)::BIGINT AS s2, floor(c * 8192 / 4096)::BIGINT AS c2 FROM r)
SELECT c_custkey, s AS turn_sin, c AS turn_cos, [least(floor(c * 8192 / 4096), 32767), floor(-s * 4096 / 4096), 0, floor(s * 8192 / 4096), floor(c * 4096 / 4096), 0, 0, 0, 2048]::BIGINT[]::VARCHAR AS turned,
 [greatest(least(floor((c2 * x - s * y) / 4096) + 10 , 2147483647), -2147483648), floor((s2 * x + c * y) / 4096) - 20, floor((2048 * 100) / 4096) + 2000000000]::BIGINT[]::VARCHAR AS moved,
 least(greatest(floor((c2 * x - s * y) / 4096) + 10, -32768), 32767)::BIGINT AS moved16, [x + 10, y - 20, 2147483647]::BIGINT[]::VARCHAR AS composed_t FROM f""")
def fixed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn about z with scales 2, 1 and one half, vectors moved by it, and a composition of translations."""
    x, y, a = F.col("x"), F.col("y"), F.col("a")
    zero = F.lit(0).cast("long")
    t = [F.lit(10), F.lit(-20), F.lit(2_000_000_000)]
    turned = g.from_turns([zero, zero, a], [F.lit(8192), F.lit(4096), F.lit(2048)], t)
    rows = _vector(spark, sf_dir).withColumn("m", turned)
    v = F.array(x, y, F.lit(100).cast("long"))
    s, c = g.turn_sin_cos(a)
    both = g.compose(g.translation([F.lit(10), F.lit(-20), F.lit(2_000_000_000)]), g.translation([x, y, F.lit(2_000_000_000)]))
    return rows.select("c_custkey", s.alias("turn_sin"), c.alias("turn_cos"), _listed(F.col("m.m")).alias("turned"), _listed(g.apply(F.col("m"), v)).alias("moved"), F.get(g.apply(F.col("m"), v, 16), F.lit(0)).alias("moved16"), _listed(both["t"]).alias("composed_t"))


@query(_K + """, q AS (SELECT c_custkey, (x / 4096)::FLOAT AS a, (y / 4096)::FLOAT AS b, (x / 64)::FLOAT AS c, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 1 END::FLOAT AS w FROM k),
 p AS (SELECT c_custkey, w, (w * b + a * w + b * a - c * c)::FLOAT AS p0, (w * c - a * a + b * w + c * b)::FLOAT AS p1, (w * a + a * c - b * b + c * w)::FLOAT AS p2, (w * w - a * b - b * c - c * a)::FLOAT AS p3, a, b, c FROM q),
 l AS (SELECT *, sqrt((a * a + b * b + c * c + w * w)::FLOAT::DOUBLE)::FLOAT AS n FROM p)
SELECT c_custkey, p0::DOUBLE AS p0, p1::DOUBLE AS p1, p2::DOUBLE AS p2, p3::DOUBLE AS p3, CASE WHEN n > 1.0::FLOAT THEN (l.a::DOUBLE / n::DOUBLE)::FLOAT ELSE 0 END::DOUBLE AS unit_x, CASE WHEN n > 1.0::FLOAT THEN (w::DOUBLE / n::DOUBLE)::FLOAT ELSE 1 END::DOUBLE AS unit_w, (x.x / 4096.0)::FLOAT::DOUBLE AS q12 FROM l JOIN k x USING (c_custkey)""")
def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of quaternions in single precision, and their normal forms with a least length."""
    x, y = F.col("x"), F.col("y")
    rows = _vector(spark, sf_dir).select("c_custkey", "x", (x.cast("double") / 4096).cast("float").alias("a"), (y.cast("double") / 4096).cast("float").alias("b"), (x.cast("double") / 64).cast("float").alias("c"), F.when(F.col("c_custkey") % 9 == 0, 0).otherwise(1).cast("float").alias("w"))
    a, bb, c, w = (F.col(n) for n in "abcw")
    product = g.quaternion_product([a, bb, c, w], [bb, c, a, w])
    unit = g.normalised(F.array(a, bb, c, w), 1.0, F.array(*(F.lit(v).cast("float") for v in (0, 0, 0, 1))))
    return rows.select("c_custkey", *(F.get(product, F.lit(k)).cast("double").alias(f"p{k}") for k in range(4)), F.get(unit, F.lit(0)).cast("double").alias("unit_x"), F.get(unit, F.lit(3)).cast("double").alias("unit_w"), g.q12_value(x).cast("double").alias("q12"))


@query(_D + """, x AS (SELECT doc_id, h, n, ('0x' || substr(h, 1, 2))::BIGINT AS b0, ('0x' || substr(h, 3, 2))::BIGINT AS b1, ('0x' || substr(h, 5, 2))::BIGINT AS b2, ('0x' || substr(h, 7, 2))::BIGINT AS b3 FROM d WHERE n >= 8)
SELECT doc_id, substr(h, 5, 4) AS bit_row, b0 // 64 % 2 = 1 AS pixel_1_0, b3 // 128 % 2 = 1 AS pixel_8_1, [b0 % 16, b0 // 16, b1 % 16]::INTEGER[]::VARCHAR AS nibbles, [b0, b1, b2]::INTEGER[]::VARCHAR AS bytes,
 [(b1 // 8) * 8 + b1 // 32, ((b1 % 8) * 8 + b0 // 32) * 4 + (b1 % 8) // 2, (b0 % 32) * 8 + b0 % 32 // 4, 255]::INTEGER[]::VARCHAR AS texel16, [b2, b1, b0, b3]::INTEGER[]::VARCHAR AS texel32, CASE WHEN n * b0 * 4 <= 400000 THEN n * b0 * 4 END AS rgba_bytes, CASE WHEN n % 2 = 0 THEN n // 2 END AS frames FROM x""")
def pixel_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bytes of each document as rows of nine one-bit pixels, as indices, and as texels by masks."""
    c = F.col("content")
    four = F.substring(c, 1, 4)
    rows = documents(spark, sf_dir).where(F.octet_length(c) >= 8).withColumns({"rows": pixels.bit_rows(four, F.lit(9), F.lit(2)), "n": F.octet_length(c).cast("long")})
    one = F.lit(1)
    return rows.select(
        "doc_id",
        F.hex(F.get("rows", F.lit(1))).alias("bit_row"),
        pixels.bit_pixel(F.col("rows"), F.lit(9), F.lit(1), F.lit(0)).alias("pixel_1_0"),
        pixels.bit_pixel(F.col("rows"), F.lit(9), F.lit(8), F.lit(1)).alias("pixel_8_1"),
        _listed(pixels.expand_indices4(F.substring(c, 1, 2), F.lit(3))).alias("nibbles"),
        _listed(pixels.expand_indices8(F.substring(c, 1, 4), F.lit(3))).alias("bytes"),
        _listed(F.get(pixels.masked_texels(F.substring(c, 1, 2), one, one, 16, (0xF800, 0x07E0, 0x001F, 0)), F.lit(0))).alias("texel16"),
        _listed(F.get(pixels.masked_texels(four, one, one, 32, (0xFF0000, 0xFF00, 0xFF, 0xFF000000)), F.lit(0))).alias("texel32"),
        pixels.rgba_length(F.col("n"), b.byte_at(c, F.lit(0)), 400_000).alias("rgba_bytes"),
        pixels.pcm_frames(F.col("n"), F.lit(2), F.lit(44_100)).alias("frames"),
    )


@query(_D + """, x AS (SELECT doc_id, n, h, unnest(range(0, 8)) AS i FROM d WHERE n >= 4), v AS (SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN ('0x' || substr(h, (1 + i)::BIGINT + 1, 1))::BIGINT ELSE ('0x' || substr(h, i::BIGINT, 1))::BIGINT END AS k FROM x),
 p AS (SELECT n_nationkey AS k, n_name AS colour FROM nation WHERE n_nationkey < 14)
SELECT doc_id, CASE WHEN count(*) FILTER (p.k IS NULL) = 0 THEN string_agg(colour, ',' ORDER BY i) END AS colours, min(i) FILTER (p.k IS NULL) AS failed_at FROM v LEFT JOIN p ON p.k = v.k GROUP BY doc_id""")
def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nibbles of each document's first four bytes as indices of a palette of fourteen nations."""
    indices = documents(spark, sf_dir).where(F.octet_length("content") >= 4).select("doc_id", F.lit(1).alias("palette_id"), pixels.expand_indices4(F.substring("content", 1, 4), F.lit(8)).alias("indices"))
    palettes = table(spark, sf_dir, "nation").where("n_nationkey < 14").select(F.lit(1).alias("palette_id"), F.col("n_nationkey").cast("int").alias("index"), F.col("n_name").alias("colour"))
    found = pixels.palette_colours(indices, palettes, ["doc_id"])
    return found.select("doc_id", F.array_join("colours", ",").alias("colours"), "failed_at")
