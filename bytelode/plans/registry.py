"""All registered queries of the library and their SQL oracles.

Oracles are written from the operators' definitions by other means: hex digits for byte
reads, recursive or self-joined forms for windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.functions import binary as b
from bytelode.functions import codecs, pixels
from bytelode.operators import catalog, layout
from bytelode.plans.base import _D, _S, ORACLE_SQL, QUERIES, _h, query
from bytelode.sources.carriers import documents, sizes, table

_PROBES = """(VALUES ('html', 10, 'magic', '<!DOCTYPE html'), ('markup', 10, 'magic', '<!'), ('html-any', 5, 'structural', '<html'),
 ('object', 10, 'magic', '{"'), ('pairs', 20, 'structural', '":'), ('the-prose', 10, 'magic', 'The'), ('colon-prose', 5, 'structural', ': '))"""
_HINTS = "(VALUES ('html', 'html'), ('object', 'json'))"
_CARRIERS = """SELECT 'page' AS carrier_kind, page_id AS carrier_id, html AS t, coalesce(regexp_extract(url, '[.]([a-z]+)$', 1), '') AS ext FROM pages
 UNION ALL SELECT 'event', event_id, props, 'json' FROM events UNION ALL SELECT 'document', doc_id, text, '' FROM documents"""


def _probes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [("html", 10, "magic", 0, b"<!DOCTYPE html"), ("markup", 10, "magic", 0, b"<!"), ("html-any", 5, "structural", 0, b"<html"), ("object", 10, "magic", 0, b'{"'), ("pairs", 20, "structural", 0, b'":'), ("the-prose", 10, "magic", 0, b"The"), ("colon-prose", 5, "structural", 0, b": ")]
    probes = spark.createDataFrame(rows, "format string, precedence int, kind string, at int, digits binary")
    return probes, spark.createDataFrame([("html", "html"), ("object", "json")], "format string, ext string")


@query(f"""
WITH c AS (SELECT carrier_kind, carrier_id, ext, coalesce(t, '') AS t FROM ({_CARRIERS})),
 p(format, precedence, kind, digits) AS (SELECT * FROM {_PROBES}), hi(format, ext) AS (SELECT * FROM {_HINTS}),
 m AS (SELECT c.*, p.format, p.precedence, p.kind, max(p.precedence) OVER (PARTITION BY carrier_kind, carrier_id) AS top
       FROM c JOIN p ON CASE p.kind WHEN 'magic' THEN starts_with(c.t, digits) ELSE contains(c.t, digits) END),
 t AS (SELECT m.*, count(*) OVER w AS n, count(hi.format) OVER w AS nh, hi.format IS NOT NULL AS hinted
       FROM m LEFT JOIN hi ON hi.format = m.format AND hi.ext = m.ext WHERE precedence = top WINDOW w AS (PARTITION BY carrier_kind, carrier_id)),
 g AS (SELECT carrier_kind, carrier_id, max(n) AS n, max(CASE WHEN n = 1 OR (nh = 1 AND hinted) THEN format END) AS format, max(CASE WHEN n = 1 OR (nh = 1 AND hinted) THEN kind END) AS method FROM t GROUP BY ALL)
SELECT c.carrier_kind, c.carrier_id, CASE WHEN g.n IS NULL THEN 'unknown' WHEN format IS NULL THEN 'ambiguous' ELSE 'selected' END AS status,
 format, method, coalesce(g.n, 0)::BIGINT AS n_contenders FROM c LEFT JOIN g USING (carrier_kind, carrier_id)""")
def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of every page, event and document from all of its bytes."""
    pages, events, docs = (table(spark, sf_dir, t) for t in ("pages", "events", "documents"))
    ext = F.coalesce(F.regexp_extract("url", r"[.]([a-z]+)$", 1), F.lit(""))
    carriers = pages.select(F.lit("page").alias("carrier_kind"), F.col("page_id").alias("carrier_id"), F.col("html").alias("t"), ext.alias("ext"))
    carriers = carriers.union(events.select(F.lit("event"), "event_id", "props", F.lit("json"))).union(docs.select(F.lit("document"), "doc_id", "text", F.lit("")))
    content = F.encode(F.coalesce("t", F.lit("")), "utf-8")
    return catalog.detect(carriers.select("carrier_kind", "carrier_id", "ext", content.alias("content")), *_probes(spark))


@query(_D + f"""SELECT doc_id, CASE WHEN n >= 5 THEN {_h(4, 0)}::BIGINT END AS u8, CASE WHEN n >= 6 THEN {_h(4, 1, 0)}::BIGINT END AS u16_le,
 CASE WHEN n >= 6 THEN {_h(4, 0, 1)}::BIGINT END AS u16_be, CASE WHEN n >= 8 THEN {_h(4, 3, 2, 1, 0)}::BIGINT END AS u32_le, CASE WHEN n >= 8 THEN {_h(4, 0, 1, 2, 3)}::BIGINT END AS u32_be,
 CASE WHEN n >= 7 THEN {_h(4, 0, 1, 2)}::BIGINT END AS be3, CASE WHEN n >= 12 THEN ({_h(4, 7, 6, 5, 4, 3, 2, 1, 0)}::UBIGINT)::VARCHAR END AS u64_le,
 CASE WHEN n < 12 THEN greatest(n - 4, 0) END AS available FROM d""")
def unsigned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned numbers at offset 4 of every document, and how many bytes a failed 8-byte read had."""
    c = F.col("content")
    return documents(spark, sf_dir).select("doc_id", b.uint(c, 4, 1).alias("u8"), b.uint(c, 4, 2).alias("u16_le"), b.uint(c, 4, 2, True).alias("u16_be"), b.uint(c, 4, 4).alias("u32_le"), b.uint(c, 4, 4, True).alias("u32_be"), b.uint(c, 4, 3, True).alias("be3"), b.uint(c, 4, 8).cast("string").alias("u64_le"), b.truncated(c, 4, 8)["available"].alias("available"))


@query(_D + f"""SELECT doc_id, ((({_h(2, 0)}::BIGINT) + 128) % 256) - 128 AS i8, ((({_h(2, 1, 0)}::BIGINT) + 32768) % 65536) - 32768 AS i16_le,
 ((({_h(2, 3, 2, 1, 0)}::BIGINT) + 2147483648) % 4294967296) - 2147483648 AS i32_le, ((({_h(2, 0, 1, 2, 3)}::BIGINT) + 2147483648) % 4294967296) - 2147483648 AS i32_be FROM d WHERE n >= 6""")
def signed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return documents(spark, sf_dir).where(F.octet_length("content") >= 6).select("doc_id", b.sint(c, 2, 1).alias("i8"), b.sint(c, 2, 2).alias("i16_le"), b.sint(c, 2, 4).alias("i32_le"), b.sint(c, 2, 4, True).alias("i32_be"))


@query(_D + f"""SELECT doc_id, {_h(0, 3, 2, 1, 0)}::BIGINT * 2048 + 16 AS scaled, {_h(0, 3, 2, 1, 0)}::BIGINT AS back FROM d WHERE n >= 4""")
def scaled_u32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count of 2048-byte units from base 16, and back."""
    value = b.scaled(F.col("content"), 0, 2048, 16)
    return documents(spark, sf_dir).where(F.octet_length("content") >= 4).select("doc_id", value.alias("scaled"), b.unscaled(value, 2048, 16).alias("back"))


@query(_D + """SELECT doc_id, i::INTEGER AS record, substr(h, (i * 16 * 2 + 1)::BIGINT, 32) AS bytes FROM (SELECT *, unnest(range(0, n // 16)) AS i FROM d)""")
def fixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole 16-byte record of every document."""
    count = F.floor(F.octet_length("content") / 16).cast("int")
    rows = documents(spark, sf_dir).where(count > 0).select("doc_id", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("record"))
    return rows.select("doc_id", "record", F.hex(F.substring("content", F.col("record") * 16 + 1, F.lit(16))).alias("bytes"))


@query(_D + f"""SELECT doc_id, [{", ".join(_h(2 * k, 1, 0) + "::BIGINT" for k in range(4))}]::VARCHAR AS words FROM d WHERE n >= 8""")
def word_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four little-endian 16-bit words at the start, in brackets."""
    words = F.array(*(b.uint(F.col("content"), 2 * k, 2) for k in range(4)))
    return documents(spark, sf_dir).where(F.octet_length("content") >= 8).select("doc_id", F.concat(F.lit("["), F.array_join(words.cast("array<string>"), ", "), F.lit("]")).alias("words"))


@query(_D + """SELECT doc_id, substr(h, 1, 8) || 'DEADBEEF' || substr(h, 17) AS spliced, CASE WHEN n < 24 THEN h || repeat('00', (24 - n)::BIGINT) END AS padded FROM d WHERE n >= 8""")
def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bytes replaced at offset 4 of each document, and short documents as NUL-padded fields of 24 bytes."""
    c = F.col("content")
    return documents(spark, sf_dir).where(F.octet_length("content") >= 8).select("doc_id", F.hex(b.splice(c, 4, F.unhex(F.lit("DEADBEEF")))).alias("spliced"), F.hex(b.padded(c, 24)).alias("padded"))


@query("""SELECT doc_id, instr(text, chr(10)) = 0 AS no_nul, CASE WHEN instr(text, chr(10)) > 0 THEN octet_length(encode(split_part(text, chr(10), 1)))::BIGINT END AS nul_length,
 sha256(split_part(text, chr(10), 1)) AS field_sha256 FROM documents""")
def nul_terminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as NUL-terminated carriers (line ends become NUL): where the first NUL is, and the string before it."""
    c = F.encode(F.replace("text", F.lit("\n"), F.lit("\x00")), "utf-8")
    rows = table(spark, sf_dir, "documents").select("doc_id", c.alias("c"), F.octet_length("text").alias("n"))
    n = b.nul_length(F.col("c"), 1 << 30)
    field = F.substring(F.col("c"), F.lit(1), F.coalesce(n, F.col("n")).cast("int"))
    return rows.select("doc_id", n.isNull().alias("no_nul"), n.alias("nul_length"), F.sha2(field, 256).alias("field_sha256"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey * 7919 + l_partkey) % 65536 AS w FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, w // 8 % 2 = 1 AS bit3, (w // 32) % 64 AS bits5_6, w - ((w // 32) % 64) * 32 + 21 * 32 AS replaced, (w + 255) // 256 * 256 AS aligned,
 CASE WHEN l_linenumber IN (0, 1) THEN l_linenumber = 1 END AS zero_one FROM k""")
def bits_and_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = (F.col("l_orderkey") * 7919 + F.col("l_partkey")) % 65536
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", w.alias("w"))
    w = F.col("w")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", b.test_bit(w, 3).alias("bit3"), b.bit_range(w, 5, 6).alias("bits5_6"), b.replace_bits(w, 5, 6, F.lit(21).cast("long")).alias("replaced"), b.align_up(w, 256).alias("aligned"), b.zero_one(F.col("l_linenumber")).alias("zero_one"))


@query(f"""WITH RECURSIVE {_S}, r AS (SELECT group_id, idx, size, 20::BIGINT AS start, 20 + size AS e FROM s WHERE idx = 1
 UNION ALL SELECT s.group_id, s.idx, s.size, (r.e + 15) // 16 * 16, (r.e + 15) // 16 * 16 + s.size FROM r JOIN s ON s.group_id = r.group_id AND s.idx = r.idx + 1)
SELECT group_id, idx::INTEGER AS idx, size, start, e AS "end" FROM r""")
def aligned_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.aligned_chain(sizes(spark, sf_dir), 20, 16)


@query(f"""WITH {_S}, t AS (SELECT *, 64 + sum(size) OVER (PARTITION BY group_id ORDER BY idx) AS run FROM s),
 g AS (SELECT group_id, max(run)::BIGINT AS e, min(CASE WHEN size % 2 <> 0 OR run > 200 THEN idx END) AS "at" FROM t GROUP BY group_id)
SELECT g.group_id, e AS "end", "at"::INTEGER AS "at", CASE WHEN "at" IS NULL THEN CASE WHEN e = 200 THEN 'ok' ELSE 'open' END WHEN t.size % 2 <> 0 THEN 'unaligned' ELSE 'past_end' END AS status
FROM g LEFT JOIN t ON t.group_id = g.group_id AND t.idx = g.at""")
def positive_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.positive_sizes(sizes(spark, sf_dir), 64, 2, F.lit(200).cast("long"))


def _extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents that mostly follow one another: an idx divisible by 4 leaves a gap of one, by 5 overlaps by one."""
    s = layout.aligned_chain(sizes(spark, sf_dir), 0, 1)
    return s.select("group_id", "idx", "size", (F.col("start") + F.expr("int(idx % 4 = 0) - int(idx % 5 = 0)")).alias("start"))


_X = f"""{_S}, x AS (SELECT group_id, idx, size, sum(size) OVER (PARTITION BY group_id ORDER BY idx) - size + (idx % 4 = 0)::INT - (idx % 5 = 0)::INT AS start FROM s),
 v AS (SELECT c.*, p.start + p.size AS before FROM x c LEFT JOIN x p ON p.group_id = c.group_id AND p.idx = c.idx - 1),
 l AS (SELECT group_id, arg_max(start + size, idx)::BIGINT AS e FROM x GROUP BY group_id)"""


@query(f"""WITH {_X} SELECT l.group_id, min(v.idx) FILTER (v.start < v.before)::INTEGER AS "at", l.e AS "end", CASE WHEN count(*) FILTER (v.start < v.before) > 0 THEN 'overlap' ELSE 'ok' END AS status
FROM l JOIN v USING (group_id) GROUP BY l.group_id, l.e""")
def audit_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.audit(_extents(spark, sf_dir), "ordered")


@query(f"""WITH {_X}, z AS (SELECT *, start <> coalesce(before, 0) AS bad FROM v)
SELECT l.group_id, min(idx) FILTER (bad)::INTEGER AS "at", l.e AS "end", CASE WHEN count(*) FILTER (bad) > 0 THEN 'gap_or_overlap' WHEN l.e <> 90 THEN 'open' ELSE 'ok' END AS status
FROM l JOIN z USING (group_id) GROUP BY l.group_id, l.e""")
def audit_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.audit(_extents(spark, sf_dir), "tiling", 0, F.lit(90).cast("long"))


@query(f"""WITH {_S}, y AS (SELECT group_id, idx, size AS start FROM s),
 n AS (SELECT a.group_id, a.idx, a.start, coalesce(c.start, 51) AS nxt FROM y a LEFT JOIN y c ON c.group_id = a.group_id AND c.idx = a.idx + 1)
SELECT group_id, idx::INTEGER AS idx, start, nxt - start AS length, (SELECT bool_and(m.start < m.nxt) FROM n m WHERE m.group_id = n.group_id) AS valid FROM n""")
def successor_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities taken for starts, in line order: most orders break the strict order, and say so."""
    return layout.successor_ranges(sizes(spark, sf_dir).withColumnRenamed("size", "start"), F.lit(51).cast("long"), True)


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, octet_length(encode(lang)) AS nl FROM documents),
 r AS (SELECT *, sum(nl) OVER (PARTITION BY source ORDER BY doc_id) AS names FROM o),
 e AS (SELECT source, doc_id, CASE WHEN k > 45 THEN 'entries' WHEN n_chars > 20000 THEN 'outside' WHEN nl > 8 THEN 'name' WHEN names > 84 THEN 'names' END AS bad FROM r)
SELECT source AS group_id, count(*)::BIGINT AS members, min(doc_id) FILTER (bad IS NOT NULL) AS "at", coalesce(arg_min(bad, doc_id) FILTER (bad IS NOT NULL), 'ok') AS status FROM e GROUP BY source""")
def stored_range_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a namespace of its documents, named by language."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("idx"), F.lit(0).alias("offset"), F.col("n_chars").alias("size"), F.col("lang").alias("name"))
    return layout.stored_range_admission(d, 45, 8, 84, F.lit(20000).cast("long"))


@query(f"""WITH RECURSIVE {_S}, r AS (SELECT group_id, idx, CASE WHEN size > 100 THEN 0 ELSE size END AS spent, CASE WHEN size > 100 THEN idx END AS denied FROM s WHERE idx = 1
 UNION ALL SELECT s.group_id, s.idx, CASE WHEN r.spent + s.size > 100 THEN r.spent ELSE r.spent + s.size END, CASE WHEN r.spent + s.size > 100 THEN s.idx END
 FROM r JOIN s ON s.group_id = r.group_id AND s.idx = r.idx + 1 WHERE r.denied IS NULL)
SELECT group_id, max(denied)::INTEGER AS denied_at, max(spent)::BIGINT AS spent FROM r GROUP BY group_id""")
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.budget_admission(sizes(spark, sf_dir).withColumnRenamed("size", "amount"), 100)


@query(f"""WITH {_S} SELECT a.group_id, (a.idx - 1)::INTEGER AS triangle, CASE WHEN a.idx % 2 = 0 THEN q.size ELSE a.size END AS a, CASE WHEN a.idx % 2 = 0 THEN a.size ELSE q.size END AS b, c.size AS c
FROM s a JOIN s q ON q.group_id = a.group_id AND q.idx = a.idx + 1 JOIN s c ON c.group_id = a.group_id AND c.idx = a.idx + 2""")
def triangle_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.triangles(sizes(spark, sf_dir).withColumnRenamed("size", "v"))


@query(f"""WITH {_S} SELECT a.group_id, (q.idx - 2)::INTEGER AS triangle, a.size AS a, q.size AS b, c.size AS c
FROM s a JOIN s q ON q.group_id = a.group_id AND q.idx >= 2 JOIN s c ON c.group_id = a.group_id AND c.idx = q.idx + 1 WHERE a.idx = 1""")
def triangle_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.triangles(sizes(spark, sf_dir).withColumnRenamed("size", "v"), True)


@query(f"""WITH {_S}, g AS (SELECT *, sum(size) OVER (PARTITION BY group_id ORDER BY idx) - size AS "at" FROM s),
 q AS (SELECT DISTINCT group_id, (group_id % 7)::BIGINT AS start, 40::BIGINT AS n FROM s)
SELECT g.group_id AS composite_id, 1 AS request_id, g.idx::INTEGER AS seg_no, (1000 * g.idx + greatest("at", start) - "at")::BIGINT AS source_start, (least("at" + size, start + n) - greatest("at", start))::BIGINT AS length
FROM g JOIN q ON q.group_id = g.group_id AND "at" < start + n AND "at" + size > start""")
def composite_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sizes(spark, sf_dir)
    segments = s.select(F.col("group_id").alias("composite_id"), F.col("idx").alias("seg_no"), (F.col("idx") * 1000).cast("long").alias("source_start"), F.col("size").alias("length"))
    requests = s.select(F.col("group_id").alias("composite_id")).distinct().select("composite_id", F.lit(1).alias("request_id"), (F.col("composite_id") % 7).alias("start"), F.lit(40).cast("long").alias("length"))
    return layout.composite_read(segments, requests, 64)


@query("""SELECT o_orderkey, 16 + (o_orderkey // 2048) * 2352 + 24 + o_orderkey % 2048 AS physical FROM orders""")
def strided_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", layout.strided_offsets(16, 2352, 24, 2048, F.col("o_orderkey")).alias("physical"))


@query("""WITH x AS (SELECT doc_id, source, lang, count(*) OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents)
SELECT source, lang, min(doc_id) AS first, max(CASE WHEN k = 2 THEN doc_id END) AS second, CASE WHEN count(*) = 1 THEN 'selected' ELSE 'ambiguous' END AS status FROM x GROUP BY source, lang""")
def select_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.select_by_name(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("""WITH e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey % 5 = 0)
SELECT 'r' || r_regionkey AS node, NULL AS parent, 1 AS depth, 'mounted' AS event FROM region
UNION ALL SELECT child, parent, 2, 'mounted' FROM e WHERE parent LIKE 'r%'
UNION ALL SELECT e.child, e.parent, 3, CASE WHEN e.child = f.parent THEN 'cycle' ELSE 'mounted' END FROM e JOIN e f ON f.child = e.parent AND f.parent LIKE 'r%'
UNION ALL SELECT e.child, e.parent, 4, 'depth' FROM e JOIN e f ON f.child = e.parent AND f.parent LIKE 'n%' AND f.child LIKE 'c%'""")
def walk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions hold nations, those customers, those orders; some nations hold their region again, and orders lie too deep."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")}

    def edge(df: DataFrame, p: str, parent: str, c: str, child: str) -> DataFrame:
        return df.select(F.concat(F.lit(p), parent).alias("parent"), F.concat(F.lit(c), child).alias("child"))

    edges = edge(t["nation"], "r", "n_regionkey", "n", "n_nationkey").union(edge(t["customer"], "n", "c_nationkey", "c", "c_custkey")).union(edge(t["orders"], "c", "o_custkey", "o", "o_orderkey"))
    edges = edges.union(edge(t["nation"].where("n_nationkey % 5 = 0"), "n", "n_nationkey", "r", "n_regionkey"))
    return catalog.walk(edges, t["region"].select(F.concat(F.lit("r"), "r_regionkey").alias("node")), 3)


@query("""SELECT p_partkey, CASE WHEN NOT regexp_full_match(lower(replace(p_name, ' ', '-')), '[a-z0-9]+(-[a-z0-9]+)*') THEN 'id' WHEN p_size % 11 = 0 THEN 'precedence' WHEN p_brand <> lower(p_brand) AND p_size > 25 THEN 'hint'
 WHEN (SELECT count(*) FROM part q WHERE q.p_name = p.p_name AND q.p_partkey < p.p_partkey) > 0 THEN 'duplicate' ELSE 'ok' END AS violation FROM part p""")
def catalog_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts taken for descriptors: the first rule that each breaks."""
    p = table(spark, sf_dir, "part")
    earlier = p.groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    rows = p.join(earlier, "p_name")
    checks = [("id", ~F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).rlike("^[a-z0-9]+(-[a-z0-9]+)*$")), ("precedence", F.col("p_size") % 11 == 0), ("hint", (F.col("p_brand") != F.lower("p_brand")) & (F.col("p_size") > 25)), ("duplicate", F.col("first") < F.col("p_partkey"))]
    return catalog.first_violation(rows, ["p_partkey"], checks)


@query("""WITH p AS (SELECT p_partkey AS f, p_size AS pr, 2 * (p_partkey % 3) AS "at", CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 12 END AS w, hex(encode(p_brand || p_type)) AS h FROM part),
 m AS (SELECT f, pr, "at", w, substr(h, 9, w) AS d FROM p)
SELECT DISTINCT least(a.f, b.f) AS a, greatest(a.f, b.f) AS b FROM m a JOIN m b ON a.pr = b.pr AND a.f < b.f AND greatest(a."at", b."at") < least(a."at" + a.w, b."at" + b.w)
 AND substr(a.d, greatest(a."at", b."at") - a."at" + 1, least(a."at" + a.w, b."at" + b.w) - greatest(a."at", b."at")) = substr(b.d, greatest(a."at", b."at") - b."at" + 1, least(a."at" + a.w, b."at" + b.w) - greatest(a."at", b."at"))""")
def catalog_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts taken for magics of six shapes: pairs of equal precedence that overlap and agree."""
    p = table(spark, sf_dir, "part")
    width = F.when(F.col("p_partkey") % 2 == 0, 8).otherwise(12)
    probes = p.select(F.col("p_partkey").alias("format"), F.col("p_size").alias("precedence"), (2 * (F.col("p_partkey") % 3)).cast("int").alias("at"), F.substring(F.hex(F.encode(F.concat("p_brand", "p_type"), "utf-8")), F.lit(9), width).alias("digits"))
    return catalog.probe_conflicts(probes)


@query("""WITH e AS (SELECT regexp_extract(url, '[.]([a-z]+)$', 1) AS ext, regexp_extract(url, '://([^/?#]*)', 1) AS format FROM pages)
SELECT ext, count(*)::BIGINT AS n, string_agg(format, ',' ORDER BY format) AS formats FROM e GROUP BY ext HAVING count(*) > 1""")
def shared_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.shared_extensions(table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"[.]([a-z]+)$", 1).alias("ext"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("format")))


@query("""WITH e AS (SELECT regexp_extract(url, '[.]([a-z]+)$', 1) AS ext, regexp_extract(url, '://([^/?#]*)', 1) AS format FROM pages WHERE regexp_extract(url, '[.]([a-z]+)$', 1) <> ''),
 x AS (SELECT ext, format, count(*) OVER (PARTITION BY ext) AS n_ext FROM e) SELECT ext, format, count(*)::BIGINT AS n, any_value(n_ext)::BIGINT AS n_ext FROM x WHERE n_ext > 1 GROUP BY ext, format""")
def shared_extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of each extension that several pages have, as rows with counts."""
    return catalog.shared_extension_counts(table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"[.]([a-z]+)$", 1).alias("ext"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("format")))


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'system') AS s, count(*) AS n FROM conversations GROUP BY conv_id),
 f AS (SELECT conv_id, u >= 1 AND a BETWEEN 1 AND 3 AND u + a = n AS plain, u >= 1 AND a >= 1 AND s = 1 AND u + a + s = n AS guided FROM c)
SELECT conv_id, CASE WHEN plain::INT + guided::INT = 1 THEN 'bound' WHEN plain THEN 'several_forms' ELSE 'no_form' END AS status, CASE WHEN plain AND NOT guided THEN 'plain' WHEN guided AND NOT plain THEN 'guided' END AS form FROM f""")
def bind_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that each conversation's roles bind to."""
    forms = spark.createDataFrame([("plain", "user", 1, None), ("plain", "assistant", 1, 3), ("guided", "user", 1, None), ("guided", "assistant", 1, None), ("guided", "system", 1, 1)], "form string, role string, least int, most int")
    return catalog.bind_inputs(table(spark, sf_dir, "conversations"), forms, "conv_id")


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/]*/(.*)', 1), '^en/', '../') AS path FROM pages)
SELECT page_id, CASE WHEN path = '' THEN 'empty' WHEN octet_length(encode(path)) > 24 THEN 'too long' WHEN path LIKE '/%' THEN 'absolute' WHEN len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) > 0 THEN 'component'
 WHEN len(string_split(path, '/')) > 2 THEN 'too deep' ELSE 'ok' END AS reason FROM p""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", "://[^/]*/(.*)", 1), "^en/", "../")
    return table(spark, sf_dir, "pages").select("page_id", b.safe_path(path, 24, 2).alias("reason"))


@query("""WITH e AS (SELECT doc_id, quality::VARCHAR AS q, toxic::VARCHAR AS t FROM labels), a AS (SELECT doc_id, (n_chars % 2)::VARCHAR AS q, '0' AS t FROM documents)
SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' WHEN e.q = a.q AND e.t = a.t THEN 'equal' ELSE 'different' END AS status,
 CASE WHEN e.q <> a.q AND e.t <> a.t THEN 'q,t' WHEN e.q <> a.q THEN 'q' WHEN e.t <> a.t THEN 't' END AS fields FROM e FULL JOIN a ON e.doc_id = a.doc_id""")
def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as expectations of what two columns of all documents say."""
    expected = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("q"), F.col("toxic").cast("string").alias("t"))
    actual = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("string").alias("q"), F.lit("0").alias("t"))
    return catalog.compare_golden(expected, actual, "doc_id", ["q", "t"])


@query("""SELECT source, count(*)::BIGINT AS entries, sha256(string_agg(lang || doc_id, chr(10) ORDER BY doc_id)) AS names_sha256 FROM documents GROUP BY source""")
def archive_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each source as an archive: their number and the digest of their names in order."""
    name = F.struct("doc_id", F.concat("lang", F.col("doc_id").cast("string")).alias("name"))
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("entries"), F.array_sort(F.collect_list(name)).alias("m"))
    return by.select("source", "entries", F.sha2(F.array_join(F.transform("m", lambda x: x["name"]), "\n"), 256).alias("names_sha256"))


@query("""WITH m AS (SELECT source, doc_id, doc_id // 1000 AS run, lang || doc_id AS name, format('{:016x}', octet_length(encode(text))) AS w FROM documents),
 r AS (SELECT source, run, count(*) AS n, sha256(string_agg(name, chr(10) ORDER BY doc_id)) AS names, sha256(unhex(string_agg(substr(w, 15, 2) || substr(w, 13, 2) || substr(w, 11, 2) || substr(w, 9, 2) || substr(w, 7, 2) || substr(w, 5, 2) || substr(w, 3, 2) || substr(w, 1, 2), '' ORDER BY doc_id))) AS sizes FROM m GROUP BY source, run)
SELECT source, sum(n)::BIGINT AS entries, sha256(string_agg(names, chr(10) ORDER BY run)) AS names_sha256, sha256(string_agg(sizes, chr(10) ORDER BY run)) AS sizes_sha256 FROM r GROUP BY source""")
def archive_run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each source as an archive: their number and the two-level digests of their names and sizes."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", F.octet_length(F.encode("text", "utf-8")).alias("size"))
    return catalog.run_digests(docs, "source", "doc_id", F.concat("lang", F.col("doc_id").cast("string")), F.col("size"))


@query(_D + """, y AS (SELECT doc_id, n, unnest(range(0, n)) AS i, h FROM d), v AS (SELECT doc_id, n, i, ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT AS b FROM y),
 z AS (SELECT doc_id, (((n + sum((n - i) * b)) % 65521) * 65536 + (1 + sum(b)) % 65521)::BIGINT AS adler32 FROM v GROUP BY doc_id, n)
SELECT t.doc_id, coalesce(adler32, 1) AS adler32, sha256(t.text) AS sha256 FROM documents t LEFT JOIN z ON z.doc_id = t.doc_id""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adler-32 and SHA-256 of every document."""
    return documents(spark, sf_dir).select("doc_id", b.adler32(F.col("content")).alias("adler32"), F.sha2("content", 256).alias("sha256"))


@query()
def cyclic_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 in two conventions and CRC-16 of every document; tested against bit-by-bit definitions."""
    return documents(spark, sf_dir).select("doc_id", F.crc32("content").alias("crc32"), codecs.bytes_udf(codecs.crc32_mpeg2, "long")("content").alias("crc32_mpeg2"), codecs.bytes_udf(codecs.crc16_ibm, "long")("content").alias("crc16"))


def _round_trip(encode, decode, together: bool = False):
    def query_(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = documents(spark, sf_dir).select("doc_id", codecs.bytes_udf(encode, together=together)("content").alias("packed"), F.octet_length("content").alias("n"))
        back = packed.select("doc_id", codecs.bytes_udf(decode)("packed").alias("back"))
        return back.select("doc_id", F.octet_length("back").cast("long").alias("n"), F.sha2("back", 256).alias("sha256"))

    return query_


def _first(x):
    return None if x is None else x[0]


def _deflate(data: bytes) -> bytes:
    import zlib

    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def _gzip(data: bytes) -> bytes:
    import zlib

    c = zlib.compressobj(9, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _lzma(data: bytes) -> bytes:
    import lzma

    return lzma.compress(data, format=lzma.FORMAT_ALONE, preset=1)


def _lzss(values):
    sizes = []

    def noted(v: bytes) -> bytes:
        sizes.append(len(v).to_bytes(4, "little"))
        return v

    for k, packed in enumerate(codecs.lzss_encode_all(map(noted, values))):
        yield sizes[k] + packed


_ROUND_TRIPS = {
    "deflate": (_deflate, lambda d: _first(codecs.inflate(d, -15))),
    "zlib_stored": (codecs.zlib_stored, lambda d: _first(codecs.inflate(d, 15))),
    "gzip": (_gzip, lambda d: _first(codecs.inflate(d, 31))),
    "lzma_alone": (_lzma, codecs.lzma_alone),
    "lzss": (_lzss, lambda d: codecs.lzss_decode(d[4:], int.from_bytes(d[:4], "little"), strict=True), True),
}
for _name, _pair in _ROUND_TRIPS.items():
    QUERIES[f"round_trip_{_name}"] = _round_trip(*_pair)
    ORACLE_SQL[f"round_trip_{_name}"] = "SELECT doc_id, octet_length(encode(text))::BIGINT AS n, sha256(text) AS sha256 FROM documents"


def _five(v: str) -> str:
    return f"(({v}) * 8 + ({v}) // 4)"


_W = "WITH k AS (SELECT o_orderkey, (o_orderkey * 40503 + 12345) % 65536 AS w FROM orders) "


@query(_W + f"""SELECT o_orderkey, [{_five("w // 2048")}, ((w // 32 % 64) * 4 + (w // 32 % 64) // 16), {_five("w % 32")}, 255]::INTEGER[]::VARCHAR AS rgb565,
 [(w % 16) * 17, (w // 16 % 16) * 17, (w // 256 % 16) * 17, (w // 4096) * 17]::INTEGER[]::VARCHAR AS rgba4444, [{_five("w % 32")}, {_five("w // 32 % 32")}, {_five("w // 1024 % 32")}, (w // 32768) * 255]::INTEGER[]::VARCHAR AS rgba5551,
 greatest(w // 8, 1)::INTEGER AS mip3 FROM k""")
def colour_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ((F.col("o_orderkey") * 40503 + 12345) % 65536).cast("int")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", w.alias("w"))

    def shown(kind: str) -> F.Column:
        return F.concat(F.lit("["), F.array_join(pixels.rgba(F.col("w"), pixels.FIELDS[kind]).cast("array<string>"), ", "), F.lit("]")).alias(kind)

    return rows.select("o_orderkey", shown("rgb565"), shown("rgba4444"), shown("rgba5551"), pixels.mip_extent(F.col("w"), F.lit(3)).alias("mip3"))


@query()
def block_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as rows of S3TC blocks, 64 texels wide: digests of the three decodings; tested texel by texel."""
    c = F.col("content")
    rows = documents(spark, sf_dir).withColumn("rows1", F.floor(F.octet_length(c) / 128).cast("int")).where("rows1 >= 2")
    height3 = (F.floor(F.octet_length(c) / 256) * 4).cast("int")
    return rows.select("doc_id", pixels.block_digests("dxt1")(c, F.lit(64), F.col("rows1") * 4).alias("dxt1"), pixels.block_digests("dxt3")(c, F.lit(64), height3).alias("dxt3"), pixels.block_digests("dxt5")(c, F.lit(64), height3).alias("dxt5"))


@query("""WITH k AS (SELECT c_custkey, (c_custkey * 37) % 8192 - 4096 AS x, (c_custkey * 101) % 8192 - 4096 AS y FROM customer)
SELECT c_custkey, floor((x * y)::DOUBLE / 4096)::BIGINT AS q12_product, round(sin(x * 2 * pi() / 4096) * 4096)::BIGINT AS turn_sin, least(greatest(x * 20, -32768), 32767)::BIGINT AS saturated FROM k""")
def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of twelve fraction bits (rounded down), the sine of a turn of 4096 units, and saturation to 16 bits."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", ((k * 37) % 8192 - 4096).alias("x"), ((k * 101) % 8192 - 4096).alias("y"))
    x = F.col("x")
    import math

    return rows.select("c_custkey", F.shiftright(x * F.col("y"), 12).alias("q12_product"), F.round(F.sin(x * (2 * math.pi) / 4096) * 4096).cast("long").alias("turn_sin"), F.least(F.greatest(x * 20, F.lit(-32768)), F.lit(32767)).alias("saturated"))


@query("""
WITH k AS (SELECT p_partkey, (p_partkey * 8191) % 65536 AS word FROM part), e AS (SELECT *, (word // 1024) % 32 AS e, word % 1024 AS f FROM k)
SELECT p_partkey, word, CASE WHEN e < 31 THEN 'finite' WHEN f = 0 THEN 'infinite' ELSE 'nan' END AS kind,
  CASE WHEN e < 31 THEN (CASE WHEN word >= 32768 THEN -1.0 ELSE 1.0 END * (CASE e WHEN 0 THEN f * 16 ELSE (1024 + f) * 8 * pow(2, e) END))::BIGINT END AS scaled FROM e""")
def half_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half floats by kind, finite ones as whole multiples of 2 to the minus 28."""
    v = F.col("v")
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 8191 % 65536).alias("word")).withColumn("v", b.half_value(F.col("word")))
    kind = F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), "infinite").otherwise("finite")
    return rows.select("p_partkey", "word", kind.alias("kind"), F.when(kind == "finite", (v * 2.0**28).cast("long")).alias("scaled"))


@query("""WITH o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS index FROM documents), w AS (SELECT DISTINCT source, unnest([0, 3, 100000000])::BIGINT AS index FROM documents)
SELECT w.source, w.index, doc_id, CASE WHEN doc_id IS NULL THEN 'missing' ELSE 'selected' END AS status FROM w LEFT JOIN o ON o.source = w.source AND o.index = w.index""")
def select_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, fourth and an absent member of each source."""
    d = table(spark, sf_dir, "documents")
    wanted = d.select("source").distinct().select("source", F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 3, 100_000_000)))).alias("index"))
    return catalog.select_by_index(d.select("source", "doc_id"), wanted, "source", "doc_id")


@query("""SELECT p_partkey AS id, p_size, s.s_name AS family, c.c_mktsegment AS context, s.s_suppkey IS NOT NULL AS supported FROM part LEFT JOIN supplier s ON s.s_suppkey = p_partkey LEFT JOIN customer c ON c.c_custkey = p_partkey""")
def merged_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as descriptors, with suppliers and customers of the same number as their support and context."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    support, context = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    found = catalog.merged_support(p, support=support, context=context)
    return found.select("id", "p_size", F.col("support.s_name").alias("family"), F.col("context.c_mktsegment").alias("context"), F.col("support").isNotNull().alias("supported"))


@query(f"""WITH {_X}, z AS (SELECT *, start <> coalesce(before, 0) AS bad FROM v)
SELECT l.group_id, min(idx) FILTER (bad)::INTEGER AS "at", l.e AS "end", CASE WHEN count(*) FILTER (bad) > 0 THEN 'gap_or_overlap' ELSE 'ok' END AS status FROM l JOIN z USING (group_id) GROUP BY l.group_id, l.e""")
def audit_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.audit(_extents(spark, sf_dir), "contiguous")


@query(f"""WITH {_S}, y AS (SELECT group_id, idx, sum(size - size % 3) OVER (PARTITION BY group_id ORDER BY idx) - CASE WHEN group_id % 5 = 0 THEN 30 * (idx % 3) ELSE 0 END AS start FROM s),
 n AS (SELECT a.group_id, a.idx, a.start::BIGINT AS start, coalesce(c.start, 200)::BIGINT AS nxt FROM y a LEFT JOIN y c ON c.group_id = a.group_id AND c.idx = a.idx + 1)
SELECT group_id, idx::INTEGER AS idx, start, nxt - start AS length, bool_and(start <= nxt) OVER (PARTITION BY group_id) AS valid FROM n""")
def loose_successor_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running quantities in threes taken for starts: equal ones are empty ranges; every fifth order falls back somewhere."""
    from pyspark.sql import Window

    w = Window.partitionBy("group_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("size") - F.col("size") % 3).over(w) - F.when(F.col("group_id") % 5 == 0, 30 * (F.col("idx") % 3)).otherwise(0)
    return layout.successor_ranges(sizes(spark, sf_dir).select("group_id", "idx", start.alias("start")), F.lit(200).cast("long"), False)


from bytelode.plans import columns, directories, rules  # noqa: E402, F401  (they register their queries)
