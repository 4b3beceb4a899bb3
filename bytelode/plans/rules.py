"""Queries over rule sets, ledgers and accounts, with catalogues derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.operators import rules
from bytelode.plans.base import _D, query
from bytelode.sources.carriers import documents, sizes, table

_CAPS = """CASE p_partkey % 10 WHEN 0 THEN ['parse', 'round_trip', 'write'] WHEN 1 THEN ['decode'] WHEN 2 THEN ['parse', 'round_trip', 'write', 'edit'] ELSE ['parse', 'decode'] END"""


def _capabilities() -> Column:
    k = F.col("p_partkey") % 10
    return F.when(k == 0, F.array(*map(F.lit, ("parse", "round_trip", "write")))).when(k == 1, F.array(F.lit("decode"))).when(k == 2, F.array(*map(F.lit, ("parse", "round_trip", "write", "edit")))).otherwise(F.array(F.lit("parse"), F.lit("decode")))


@query(f"""WITH d AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 23 = 0 THEN 'Bad Id' ELSE 'f-' || (p_partkey % 190) END AS id, p_size % 12 AS precedence, CASE WHEN p_partkey % 29 = 0 THEN '.x' ELSE 'x' || (p_partkey % 4) END AS hint,
  CASE WHEN p_partkey % 31 = 0 THEN '-g' WHEN p_partkey % 3 = 0 THEN 'g' || (p_partkey % 2) END AS g, p_partkey % 7 = 0 AS ambiguous, {_CAPS} AS caps, 'dec' || (p_partkey % 41) AS decoder FROM part),
 b AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 6 < 4 THEN 'magic' WHEN p_partkey % 6 = 4 THEN 'structural' ELSE 'contextual' END AS kind, (p_partkey % 2)::INTEGER AS "at", substr(hex(encode(p_brand)), 2 * (p_partkey % 2)::INTEGER + 11, CASE WHEN p_partkey % 6 < 2 THEN 4 ELSE 2 END) AS digits,
  'has-' || (p_partkey % 3) AS predicate, 'E' || (p_partkey % 2) AS ext FROM part WHERE p_partkey % 19 > 0),
 n AS (SELECT b.*, d.precedence, d.g FROM b JOIN d USING (position)),
 c AS (SELECT DISTINCT y.position FROM n x JOIN n y ON x.precedence = y.precedence AND x.position < y.position AND NOT coalesce(x.g = y.g, false) AND CASE
   WHEN x.kind = 'magic' AND y.kind = 'magic' THEN greatest(2 * x."at", 2 * y."at") < least(2 * x."at" + length(x.digits), 2 * y."at" + length(y.digits)) AND substr(x.digits, greatest(x."at", y."at") * 2 - x."at" * 2 + 1, least(2 * x."at" + length(x.digits), 2 * y."at" + length(y.digits)) - 2 * greatest(x."at", y."at"))
     = substr(y.digits, greatest(x."at", y."at") * 2 - y."at" * 2 + 1, least(2 * x."at" + length(x.digits), 2 * y."at" + length(y.digits)) - 2 * greatest(x."at", y."at"))
   WHEN x.kind = 'magic' OR y.kind = 'magic' THEN false ELSE x.predicate = y.predicate AND (x.kind <> 'contextual' OR y.kind <> 'contextual' OR x.ext = y.ext) END)
SELECT position, id, CASE WHEN position % 23 = 0 THEN 'id' WHEN position % 19 = 0 THEN 'no_probes' WHEN precedence = 0 THEN 'precedence' WHEN hint LIKE '.%' THEN 'hint' WHEN g = '-g' THEN 'group' WHEN ambiguous AND g IS NULL THEN 'missing_group'
  WHEN position % 10 IN (0, 1) THEN 'capabilities' WHEN EXISTS (SELECT 1 FROM d e WHERE e.id = d.id AND e.position < d.position) THEN 'duplicate' WHEN position IN (SELECT position FROM c) THEN 'conflict' WHEN decoder = 'dec5' THEN 'decoder' ELSE 'ok' END AS violation FROM d""")
def catalogue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts taken for format descriptors with a probe each, under all of a catalogue's rules in order."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    descriptors = p.select(
        k.alias("position"),
        F.when(k % 23 == 0, "Bad Id").otherwise(F.concat(F.lit("f-"), (k % 190).cast("string"))).alias("id"),
        (F.col("p_size") % 12).alias("precedence"),
        F.array(F.when(k % 29 == 0, ".x").otherwise(F.concat(F.lit("x"), (k % 4).cast("string")))).alias("hints"),
        F.when(k % 31 == 0, "-g").when(k % 3 == 0, F.concat(F.lit("g"), (k % 2).cast("string"))).alias("ambiguity_group"),
        F.when(k % 7 == 0, "ambiguous").otherwise("sure").alias("confidence"),
        _capabilities().alias("capabilities"),
        F.concat(F.lit("dec"), (k % 41).cast("string")).alias("decoder"),
    )
    kind = F.when(k % 6 < 4, "magic").when(k % 6 == 4, "structural").otherwise("contextual")
    digits = F.substring(F.encode("p_brand", "utf-8"), (k % 2).cast("int") + 6, F.when(k % 6 < 2, 2).otherwise(1))
    probes = p.where("p_partkey % 19 > 0").select(k.alias("position"), kind.alias("kind"), (k % 2).cast("int").alias("at"), digits.alias("digits"), F.concat(F.lit("has-"), (k % 3).cast("string")).alias("predicate"), F.concat(F.when(k % 6 == 5, "E").otherwise("e"), (k % 2).cast("string")).alias("extension"), F.lit("").alias("parent"))
    decoders = p.select(F.concat(F.lit("dec"), (k % 41).cast("string")).alias("decoder")).where("decoder <> 'dec5'").distinct()
    return rules.catalogue_rules(descriptors, probes, decoders)


@query("""SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 1 THEN 'reproduction' WHEN 2 THEN 'edit_order' WHEN 3 THEN 'edit_scope' WHEN 4 THEN 'edit_oracle' WHEN 5 THEN 'edit_mode' WHEN 6 THEN 'authoring' WHEN 7 THEN 'edit_capability' WHEN 8 THEN 'write_capability' WHEN 9 THEN 'no_operation'
 ELSE CASE WHEN p_size > 40 THEN 'edit_mode' ELSE 'ok' END END AS violation FROM part""")
def writer_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts taken for writer contracts: a confined edit of the format and a rebuild of a dialect, with a fault by number."""
    k = F.col("p_partkey") % 12

    def edit(mode: Column, scope: Column, precondition: Column, length: str, relocation: str, oracle: Column) -> Column:
        return F.struct(mode.alias("mode"), scope.alias("scope"), precondition.alias("precondition"), F.lit(length).alias("length"), F.lit(relocation).alias("relocation"), oracle.alias("oracle"))

    confined = edit(F.lit("confined"), F.lit(""), F.when(k == 5, "any-mutation").when(k.isin(0, 10, 11) & (F.col("p_size") > 40), "fits-allocation").otherwise("semantic-fields"), "preserved", "preserve-offsets", F.lit("t"))
    rebuild = edit(F.lit("rebuild"), F.when(k == 3, "bad scope").otherwise("d.1"), F.lit("any-mutation"), "may-change", "relocation-plan", F.when(k == 4, " ").otherwise("t"))
    both = F.when(k == 2, F.array(rebuild, confined)).when(k == 9, F.slice(F.array(confined), 1, 0)).otherwise(F.array(confined, rebuild))
    operation = F.struct(F.lit("").alias("scope"), F.lit("t").alias("oracle"))
    silent = F.struct(F.lit("").alias("scope"), F.lit("").alias("oracle"))
    caps = F.when(k == 7, F.array(F.lit("parse"), F.lit("write"))).when(k == 9, F.array(F.lit("parse"))).otherwise(F.array(F.lit("parse"), F.lit("edit"), F.lit("write")))
    contracts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", caps.alias("capabilities"), F.when(k == 1, silent).when(k != 9, operation).alias("reproduction"), F.when(k == 6, silent).when(~k.isin(8, 9), operation).alias("authoring"), both.alias("edits"))
    return rules.writer_rules(contracts)


@query("""WITH m AS (SELECT s_suppkey AS position, s_suppkey % 14 AS k, CASE WHEN s_suppkey % 14 = 1 THEN '-x' ELSE 'f' || (s_suppkey % 90) END AS format FROM supplier)
SELECT position, format, CASE WHEN k = 1 THEN 'format' WHEN k = 2 THEN 'owner' WHEN EXISTS (SELECT 1 FROM m o WHERE o.format = m.format AND o.position < m.position) THEN 'duplicate' WHEN k = 4 THEN 'empty' WHEN k = 5 THEN 'identity' WHEN k = 6 THEN 'declared_owner' WHEN k = 7 THEN 'operation_name'
 WHEN k = 8 THEN 'operation_purpose' WHEN k = 9 THEN 'operation_id' WHEN k = 10 THEN 'operation_capabilities' WHEN k = 11 THEN 'union' ELSE 'ok' END AS violation FROM m""")
def module_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers taken for modules of two operations each, with a fault by number."""
    k = F.col("s_suppkey") % 14
    name = F.when(k == 1, "-x").otherwise(F.concat(F.lit("f"), (F.col("s_suppkey") % 90).cast("string")))

    def operation(label: Column, purpose: Column, identity: Column, caps: Column) -> Column:
        return F.struct(label.alias("name"), purpose.alias("purpose"), identity.alias("id"), caps.alias("capabilities"))

    none = F.array().cast("array<string>")
    one = operation(F.when(k == 7, "Read It").otherwise("read"), F.when(k == 8, " ").otherwise("reads"), F.lit("a"), F.array(F.lit("parse")))
    two = operation(F.lit("decode"), F.lit("decodes"), F.when(k == 9, "a").otherwise("b"), F.when(k == 10, none).otherwise(F.array(F.lit("decode"), F.lit("parse"))))
    modules = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("position"), name.alias("format"), F.when(k == 2, "").otherwise("own").alias("owner"), F.when(k == 5, "other").when(k != 4, name).alias("descriptor"), F.lit(None).cast("string").alias("embedded"),
        F.array(F.when(k == 6, "another").otherwise("own")).alias("declared_owners"), F.when(k.isin(11, 12), F.array(F.lit("parse"))).otherwise(F.array(F.lit("parse"), F.lit("decode"))).alias("capabilities"), F.array(one, two).alias("operations"), (k != 12).alias("strict"),
    )
    return rules.module_rules(modules)


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position, octet_length(encode(text))::BIGINT AS size, sha256(text) AS h FROM conversations),
 d AS (SELECT conv_id, position, CASE WHEN conv_id % 13 = 1 AND position = 2 THEN '/t' || position WHEN conv_id % 13 = 2 AND position = 2 THEN 'c/t1' WHEN conv_id % 13 = 3 AND position = 2 THEN 'c/t1/x' ELSE 'c/t' || position END AS path, size, h FROM t),
 f AS (SELECT conv_id, CASE WHEN conv_id % 13 = 5 AND position = 1 THEN 'c/extra' ELSE path END AS path, CASE WHEN conv_id % 13 = 6 AND position = 1 THEN size + 1 ELSE size END AS size, CASE WHEN conv_id % 13 = 7 AND position = 1 THEN 'x' ELSE h END AS h FROM d WHERE NOT (conv_id % 13 = 4 AND position = 2)),
 r AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY position) AS total, count(*) OVER (PARTITION BY conv_id, path ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM d),
 v AS (SELECT conv_id, 0 AS phase, lpad(position::VARCHAR, 20, '0') AS o, 'cases' AS status, path FROM d WHERE position = 9
  UNION ALL SELECT conv_id, 1, lpad(position::VARCHAR, 20, '0'), CASE WHEN size > 900 THEN 'case_bytes' WHEN total > 2500 THEN 'total_bytes' WHEN path LIKE '/%' THEN 'path' WHEN seen > 0 THEN 'duplicate' END, path FROM r WHERE size > 900 OR total > 2500 OR path LIKE '/%' OR seen > 0
  UNION ALL SELECT DISTINCT a.conv_id, 2, a.path, 'prefix', a.path FROM d a JOIN d b ON a.conv_id = b.conv_id AND starts_with(b.path, a.path || '/')
  UNION ALL SELECT d.conv_id, 3, d.path, 'missing', d.path FROM d LEFT JOIN f ON f.conv_id = d.conv_id AND f.path = d.path WHERE f.path IS NULL
  UNION ALL SELECT f.conv_id, 4, f.path, 'undeclared', f.path FROM f LEFT JOIN d ON f.conv_id = d.conv_id AND f.path = d.path WHERE d.path IS NULL
  UNION ALL SELECT d.conv_id, 5, lpad(d.position::VARCHAR, 20, '0'), CASE WHEN d.size <> f.size THEN 'size' ELSE 'sha256' END, d.path FROM d JOIN f ON f.conv_id = d.conv_id AND f.path = d.path WHERE d.size <> f.size OR d.h <> f.h),
 w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY phase, o) AS n FROM v)
SELECT c.conv_id AS package, coalesce(w.status, 'ok') AS status, w.path FROM (SELECT DISTINCT conv_id FROM d) c LEFT JOIN w ON w.conv_id = c.conv_id AND w.n = 1""")
def package_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a package of its turns, declared by a manifest and found as files, with a fault by number."""
    from pyspark.sql import Window

    k, at = F.col("conv_id") % 13, F.col("position")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(w).alias("position"), F.octet_length(F.encode("text", "utf-8")).cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    own = F.concat(F.lit("c/t"), at.cast("string"))
    path = F.when((k == 1) & (at == 2), F.concat(F.lit("/t"), at.cast("string"))).when((k == 2) & (at == 2), "c/t1").when((k == 3) & (at == 2), "c/t1/x").otherwise(own)
    declared = t.select(F.col("conv_id").alias("package"), "position", path.alias("path"), "size", "sha256")
    k = F.col("package") % 13
    found = declared.where(~((k == 4) & (at == 2))).select("package", F.when((k == 5) & (at == 1), "c/extra").otherwise(F.col("path")).alias("path"), F.when((k == 6) & (at == 1), F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when((k == 7) & (at == 1), "x").otherwise(F.col("sha256")).alias("sha256"))
    return rules.package_admission(declared, found, 8, 900, 2500, 4096, 32)


@query(_D + """, p AS (SELECT doc_id, n, h, 'c' || (doc_id % 40) AS codec, doc_id % 5 AS k, (doc_id * 31) % greatest(n, 1) AS w FROM d),
 o AS (SELECT doc_id, codec, CASE WHEN k = 1 THEN 'refused' WHEN k = 2 AND n > 0 THEN 'divergence' WHEN k = 3 THEN 'length' ELSE 'exact' END AS outcome, CASE WHEN k = 2 AND n > 0 THEN w END AS "at" FROM p),
 s AS (SELECT codec, string_agg(doc_id, ',' ORDER BY doc_id) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY codec ORDER BY doc_id) AS r FROM o WHERE outcome <> 'exact') WHERE r <= 5 GROUP BY codec)
SELECT o.codec, count(*)::BIGINT AS total, count(*) FILTER (outcome = 'exact')::BIGINT AS exact, count(*) FILTER (outcome = 'refused')::BIGINT AS refused, count(*) FILTER (outcome = 'divergence')::BIGINT AS diverged, count(*) FILTER (outcome = 'length')::BIGINT AS other_length,
 min("at")::BIGINT AS shallowest, any_value(samples) AS samples, count(*) FILTER (outcome <> 'exact') = 0 AS bit_exact FROM o LEFT JOIN s USING (codec) GROUP BY o.codec""")
def pair_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against altered copies of themselves, by a codec of forty: refused, one byte changed, one byte longer, or exact."""
    c, k = F.col("content"), F.col("doc_id") % 5
    n = F.octet_length(c)
    at = (F.col("doc_id") * 31) % F.greatest(n, F.lit(1))
    changed = F.overlay(c, F.unhex(F.lit("FF")), (at + 1).cast("int"), F.lit(1))
    encoded = F.when(k == 1, F.lit(None)).when((k == 2) & (n > 0), changed).when(k == 3, F.concat(c, F.unhex(F.lit("00")))).otherwise(c)
    pairs = documents(spark, sf_dir).select(F.concat(F.lit("c"), (F.col("doc_id") % 40).cast("string")).alias("codec"), F.col("doc_id").alias("id"), c.alias("stored"), encoded.cast("binary").alias("encoded"))
    return rules.pair_ledger(pairs).withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ",")).withColumn("shallowest", F.col("shallowest").cast("long"))


@query(f"""SELECT p_partkey AS id, '| ' || p_partkey || ' | ' || array_to_string(list_transform(['parse', 'decode', 'edit', 'write', 'round_trip'], lambda c: CASE WHEN list_contains(caps, c) THEN 'yes' ELSE 'no' END), ' | ') || ' |' AS line FROM (SELECT p_partkey, {_CAPS} AS caps FROM part)""")
def capability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _capabilities().alias("capabilities"))
    return rules.capability_matrix(d, ["parse", "decode", "edit", "write", "round_trip"])


_S7 = "SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS i, l_quantity::BIGINT AS q FROM lineitem"


@query(f"""WITH s AS ({_S7}), c AS (SELECT g, i, 'read_bytes' AS dimension, q AS amount FROM s UNION ALL SELECT g, i, 'read_calls', 1 FROM s UNION ALL SELECT g, i, 'output_bytes', 2 * (q % 20) FROM s),
 r AS (SELECT *, sum(amount) OVER (PARTITION BY g, dimension ORDER BY i) AS total, CASE dimension WHEN 'read_bytes' THEN 120 WHEN 'read_calls' THEN 5 ELSE 70 END AS lim FROM c),
 d AS (SELECT g, min(i) FILTER (total > lim) AS denied FROM r GROUP BY g)
SELECT g AS group_id, dimension, sum(CASE WHEN denied IS NULL OR i < denied THEN amount ELSE 0 END)::BIGINT AS spent, max(CASE WHEN denied IS NULL OR i < denied THEN amount ELSE 0 END)::BIGINT AS peak, (any_value(lim) - sum(CASE WHEN denied IS NULL OR i < denied THEN amount ELSE 0 END))::BIGINT AS remaining, bool_and(denied IS NULL) AS complete
FROM r JOIN d USING (g) GROUP BY g, dimension""")
def usage_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order is a batch of three charges against limits of bytes read, calls and bytes written."""
    s = sizes(spark, sf_dir)
    charges = s.select("group_id", "idx", F.explode(F.create_map(F.lit("read_bytes"), F.col("size"), F.lit("read_calls"), F.lit(1).cast("long"), F.lit("output_bytes"), 2 * (F.col("size") % 20))).alias("dimension", "amount"))
    return rules.usage_snapshot(charges, {"read_bytes": 120, "read_calls": 5, "output_bytes": 70}, "group_id", "idx")


@query("""WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), x AS (SELECT d.doc_id, sha256(d.text) = CASE WHEN d.doc_id % 6 = 0 THEN repeat('0', 64) ELSE sha256(d.text) END AS gate, ['metadata', 'selective', 'whole'][1 + d.doc_id % 3] AS ceiling, ['metadata', 'selective', 'whole'][1 + (d.doc_id // 3) % 3] AS cost, text FROM documents d)
SELECT doc_id, gate, list_position(['metadata', 'selective', 'whole'], cost) <= list_position(['metadata', 'selective', 'whole'], ceiling) AS admitted, (contains(text, 'tion'))::INT + (contains(text, 'ch') AND doc_id % 2 = 0)::INT AS n_recognised FROM x""")
def gates_and_recognitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a digest gate and a cost ceiling, and how many report-only rules recognise each."""
    names = F.array(*map(F.lit, ("metadata", "selective", "whole")))
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(k % 2 == 0, "txt").otherwise("dat").alias("ext"), F.encode("text", "utf-8").alias("content"))
    expected = F.when(k % 6 == 0, F.repeat(F.lit("0"), 64)).otherwise(F.sha2("content", 256))
    known = spark.createDataFrame([("endings", bytearray(b"tion"), None), ("sounds", bytearray(b"ch"), "TXT")], "rule string, digits binary, guard string")
    hits = rules.recognitions(d.withColumnRenamed("doc_id", "carrier_id"), known).groupBy("carrier_id").count()
    gated = d.select("doc_id", (F.sha2("content", 256) == expected).alias("gate"), rules.admits(F.get(names, (k % 3).cast("int")), F.get(names, (F.floor(k / 3) % 3).cast("int"))).alias("admitted"))
    return gated.join(hits, gated.doc_id == hits.carrier_id, "left").select("doc_id", "gate", "admitted", F.coalesce("count", F.lit(0)).cast("int").alias("n_recognised"))


@query("""WITH e AS (SELECT c_custkey AS position, c_custkey % 16 AS k, CASE WHEN c_custkey % 16 = 1 THEN 'Bad' WHEN c_custkey % 16 IN (2, 3, 4, 5) THEN 's' || c_custkey % 10 ELSE 'e' || c_custkey END AS id, c_custkey % 25 AS f, c_nationkey AS disc FROM customer),
 x AS (SELECT *, min(position) OVER (PARTITION BY CASE WHEN k = 7 THEN -1 ELSE f END, disc) AS one, min(position) OVER (PARTITION BY id) AS first FROM e)
SELECT position, id, CASE WHEN k = 1 THEN 'id' WHEN k = 2 THEN 'duplicate' WHEN k = 3 THEN 'context' WHEN k = 4 THEN 'agreement' WHEN k = 6 THEN 'context' WHEN k = 7 THEN 'family' WHEN k = 8 THEN 'untyped' WHEN k = 9 THEN 'capabilities' WHEN k = 10 THEN 'evidence'
 WHEN one < position AND NOT (position % 2 = 0 AND one % 2 = 0) THEN 'discriminator' ELSE 'ok' END AS violation FROM x""")
def support_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers taken for embedded formats, with suppliers as descriptors, and a fault by number."""
    c = F.col("c_custkey")
    k = c % 16
    strings = lambda *x: F.array(*map(F.lit, x))
    name = F.when(k == 1, "Bad").when(k.isin(2, 3, 4, 5), F.concat(F.lit("s"), (c % 10).cast("string"))).otherwise(F.concat(F.lit("e"), c.cast("string")))
    family = F.when(k == 7, "").otherwise(F.concat(F.lit("f"), (c % 25).cast("string")))
    embedded = table(spark, sf_dir, "customer").select(
        c.alias("position"), name.alias("id"), F.when(k.isin(3, 4, 5), name).when(k == 6, "other").alias("carrier"), family.alias("family"), F.when(k == 4, "else").otherwise("dec").alias("decoder"), F.col("c_nationkey").cast("string").alias("discriminator"),
        F.when(k == 3, "siblings").otherwise("paired").alias("context"), F.when(k == 8, "strange").otherwise(family).alias("context_family"), F.lit(True).alias("typed"), F.when(c % 2 == 0, "g").alias("dialect_group"),
        F.when(k == 9, strings("decode")).when(k == 10, strings("parse", "corpus")).otherwise(strings("parse")).alias("capabilities"), F.lit(None).cast("struct<handler: string, floor: int>").alias("evidence"),
    )
    described = table(spark, sf_dir, "customer").select((c % 10).alias("d")).distinct().select(F.concat(F.lit("s"), F.col("d").cast("string")).alias("id"), F.lit(True).alias("detectable"), F.lit("paired").alias("requirement"), F.lit("dec").alias("decoder"), strings("parse").alias("capabilities"))
    return rules.support_rules(embedded, described)


@query("""WITH s AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 17 = 0 THEN '-' ELSE 'p' || (p_partkey % 150) END AS id, ['carrier', 'view', 'none'][1 + p_partkey % 3] AS kind, CASE WHEN p_partkey % 5 < 2 THEN 'named' WHEN p_partkey % 5 = 2 THEN 'selective' END AS addressing, CASE WHEN p_partkey % 7 < 3 THEN 'external' ELSE 'native' END AS execution FROM part)
SELECT position, id, CASE WHEN id = '-' THEN 'id' WHEN position > min(position) OVER (PARTITION BY id) THEN 'duplicate' WHEN id NOT IN (SELECT 'p' || s_suppkey FROM supplier UNION ALL SELECT 'p' || (c_custkey * 2) FROM customer) THEN 'unknown'
 WHEN (kind <> 'none' AND addressing IS NOT NULL AND (execution = 'native' OR addressing = 'selective')) OR (kind = 'none' AND addressing IS NULL AND execution = 'native') THEN 'ok' ELSE 'combination' END AS violation FROM s""")
def namespace_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts taken for declared namespace semantics; suppliers and customers are the known formats."""
    k = F.col("p_partkey")
    semantics = table(spark, sf_dir, "part").select(k.alias("position"), F.when(k % 17 == 0, "-").otherwise(F.concat(F.lit("p"), (k % 150).cast("string"))).alias("id"), F.get(F.array(*map(F.lit, ("carrier", "view", "none"))), (k % 3).cast("int")).alias("kind"), F.when(k % 5 < 2, "named").when(k % 5 == 2, "selective").alias("addressing"), F.when(k % 7 < 3, "external").otherwise("native").alias("execution"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("id")).union(table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), (F.col("c_custkey") * 2).cast("string"))))
    return rules.namespace_rules(semantics, known)


@query("""WITH f AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id > 3), s AS (SELECT doc_id, CASE WHEN quality = 1 THEN sha256(text) ELSE 'old' END AS h FROM documents JOIN labels USING (doc_id)),
 l AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang <> 'de')
SELECT coalesce(f.doc_id, s.doc_id) AS path, CASE WHEN s.h IS NULL THEN CASE WHEN f.doc_id % 2 = 0 THEN 'excluded' ELSE 'undeclared' END WHEN f.h IS NULL THEN 'absent' WHEN f.h <> s.h THEN 'changed' WHEN f.h NOT IN (SELECT h FROM l) THEN 'unversioned' ELSE 'ok' END AS status FROM f FULL JOIN s ON s.doc_id = f.doc_id""")
def golden_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a directory's files (the first ones are gone), labelled ones as its samples, even ones excluded, and a ledger without one language."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), "lang")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), "quality")
    samples = d.join(labels, "path").select("path", F.when(F.col("quality") == 1, F.col("sha256")).otherwise("old").alias("sha256"))
    return rules.golden_run(d.where("path > 3").drop("lang"), samples, d.where("path % 2 = 0").select("path"), d.where("lang <> 'de'").select("sha256"))
