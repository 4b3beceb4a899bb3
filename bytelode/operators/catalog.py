"""Format catalogues: detection, validation, shared extensions, input binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelode.sources.scratch import written

_ASCII_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _in_role(path: Column, parent: Column) -> Column:
    """Whether the last components of a path's folder are those of ``parent``, whatever the case of ASCII letters."""
    plain = F.regexp_replace(F.regexp_replace(path, "/(?:[.]?/)+", "/"), "(?:/[.]?)+$", "")
    folder = F.regexp_extract(plain, "^(.*)/[^/]*$", 1)
    return F.endswith(F.translate(F.concat(F.lit("/"), folder), *_ASCII_CASE), F.translate(F.concat(F.lit("/"), parent), *_ASCII_CASE))


#: Rows of a catalogue that detection folds into its expression.
MOST_PROBES = 10_000


def detect(carriers: DataFrame, probes: DataFrame, hints: DataFrame) -> DataFrame:
    """One row a carrier: ``(carrier_kind, carrier_id, status, format, method, n_contenders)``.

    Carriers have ``content`` (all of their bytes), ``ext`` and, for contextual probes, ``path``.
    Probes are ``(format, precedence, kind, at, digits)``: ``magic`` bytes at a place; bytes that some
    place of the content must hold for ``structural`` probes; ``contextual`` probes are structural
    ones that also ask for an ``extension`` and the last components of the path's folder
    (``parent``), in two more columns. A format's evidence
    is its best probe (magic over structural, then the longer); the highest precedence
    stays; of several formats one is selected only if exactly one has the carrier's
    extension as a hint.

    The catalogue, of ``MOST_PROBES`` rows at most (more are an error), becomes an array in
    the expression, so each carrier is judged where it is read, without a shuffle.
    """
    context = {"extension", "parent"} <= set(probes.columns) and "path" in carriers.columns
    known = probes.select("format", "precedence", "kind", "at", "digits", *(("extension", "parent") if context else ())).limit(MOST_PROBES + 1).collect()
    known_hints = hints.select("format", "ext").distinct().limit(MOST_PROBES + 1).collect()
    if max(len(known), len(known_hints)) > MOST_PROBES:
        raise ValueError(f"a catalogue of more than {MOST_PROBES} probes or hints")

    def literal(r) -> Column:
        fields = {"format": r["format"], "precedence": r["precedence"], "kind": r["kind"], "at": r["at"], "digits": bytes(r["digits"]).hex()}
        cols = [F.unhex(F.lit(v)).alias(k) if k == "digits" else F.lit(v).alias(k) for k, v in fields.items()]
        return F.struct(*cols, *(F.lit(r[k] if context else None).cast("string").alias(k) for k in ("extension", "parent")))

    def fits(p: Column) -> Column:
        magic = F.substring(F.col("content"), p["at"] + 1, F.octet_length(p["digits"])) == p["digits"]
        holds = F.contains(F.col("content"), p["digits"])
        found = F.when(p["kind"] == "magic", magic).when(p["kind"] == "structural", holds)
        if context:
            asked = (F.translate("ext", *_ASCII_CASE) == F.translate(p["extension"], *_ASCII_CASE)) & _in_role(F.col("path"), p["parent"])
            found = found.when(p["kind"] == "contextual", asked & holds)
        return F.coalesce(found, F.lit(False))

    of = "array<struct<format: string, precedence: int, kind: string, at: int, digits: binary, extension: string, parent: string>>"
    all_probes = (F.array(*map(literal, known)) if known else F.array()).cast(of)
    all_hints = (F.array(*(F.struct(F.lit(r["format"]).alias("format"), F.lit(r["ext"]).alias("ext")) for r in known_hints)) if known_hints else F.array()).cast("array<struct<format: string, ext: string>>")
    hits = carriers.withColumn("__hits", F.filter(all_probes, fits))
    best = F.array_max(F.transform("__hits", lambda p: p["precedence"]))
    top = hits.withColumn("__top", F.filter("__hits", lambda p: p["precedence"] == best))
    formats = top.withColumn("__formats", F.array_distinct(F.transform("__top", lambda p: p["format"])))
    hinted = F.filter("__formats", lambda f: F.exists(all_hints, lambda h: (h["format"] == f) & (h["ext"] == F.col("ext"))))
    n = F.size("__formats")
    judged = formats.withColumn("__hinted", hinted).withColumn("__one", F.when(n == 1, F.get("__formats", F.lit(0))).when(F.size("__hinted") == 1, F.get("__hinted", F.lit(0))))
    strength = F.transform(F.filter("__top", lambda p: p["format"] == F.col("__one")), lambda p: F.struct((p["kind"] == "magic").cast("int").alias("m"), F.octet_length(p["digits"]).alias("n")))
    method = F.when(F.array_max(strength)["m"] == 1, "magic").otherwise("structural")
    status = F.when(n == 0, "unknown").when(F.col("__one").isNull(), "ambiguous").otherwise("selected")
    return judged.select("carrier_kind", "carrier_id", status.alias("status"), F.col("__one").alias("format"), F.when(F.col("__one").isNotNull(), method).alias("method"), n.cast("long").alias("n_contenders"))


def first_violation(rows: DataFrame, key: list[str], checks: list[tuple[str, Column]]) -> DataFrame:
    """Each row with the name of the first check that it breaks, or ``ok``."""
    out = F.lit("ok")
    for name, broken in reversed(checks):
        out = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(out)
    return rows.select(*key, out.alias("violation"))


def probe_conflicts(probes: DataFrame) -> DataFrame:
    """Pairs of formats of equal precedence whose magics overlap and agree where they do: ``(a, b)``.

    Magics are ``(format, precedence, at, digits)``. Formats with the same magics are a class, and
    only classes meet; pairs of classes are then spread to their formats, where each pair
    comes once, so that nothing is gathered by pair of formats.

    Magics at the same place and of one width meet by equality. Others meet by the digits of
    the shared stretch, which is the same for all pairs of two shapes, and shapes are few.
    """
    alike = probes.where("format is not null").groupBy("format").agg(F.array_sort(F.collect_set(F.struct("precedence", "at", "digits"))).alias("magics"))
    classes = alike.groupBy("magics").agg(F.min("format").alias("class"))
    members = alike.join(classes, "magics").select("class", "format")
    shaped = classes.select("class", F.inline("magics")).withColumns({"w": F.length("digits")})
    shapes = shaped.select("at", "w").distinct()
    left, right = shapes.select(F.col("at").alias("a1"), F.col("w").alias("w1")), shapes.select(F.col("at").alias("a2"), F.col("w").alias("w2"))
    low, high = F.greatest("a1", "a2"), F.least(F.col("a1") + F.col("w1"), F.col("a2") + F.col("w2"))
    meeting = left.join(right, low < high).withColumns({"low": low, "high": high})

    def side(n: int, name: str) -> DataFrame:
        at, w = f"a{n}", f"w{n}"
        joined = shaped.join(meeting, (F.col("at") == F.col(at)) & (F.col("w") == F.col(w)))
        shared = F.substring("digits", F.col("low") - F.col("at") + 1, F.col("high") - F.col("low"))
        return joined.select("precedence", "a1", "w1", "a2", "w2", shared.alias("shared"), F.col("class").alias(name))

    met = side(1, "c1").join(side(2, "c2"), ["precedence", "a1", "w1", "a2", "w2", "shared"]).where("c1 <= c2").select("c1", "c2").distinct()
    one, two = members.select(F.col("class").alias("c1"), F.col("format").alias("f1")), members.select(F.col("class").alias("c2"), F.col("format").alias("f2"))
    spread = met.join(one, "c1").join(two, "c2").where("c1 <> c2 or f1 < f2")
    return spread.select(F.least("f1", "f2").alias("a"), F.greatest("f1", "f2").alias("b"))


def shared_extensions(hints: DataFrame) -> DataFrame:
    """Extensions of two or more hint rows, with the sorted formats of those rows."""
    return hints.groupBy("ext").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("format")), ",").alias("formats")).where("n > 1")


def shared_extension_counts(hints: DataFrame) -> DataFrame:
    """``shared_extensions`` as one row an extension and format: ``(ext, format, n, n_ext)``.

    Hints are counted before they meet, so no row or task grows with an extension's hints.
    Rows without an extension hint at nothing and are left out.
    """
    by = hints.where("ext != ''").groupBy("ext", "format").agg(F.count("*").alias("n"))
    shared = by.groupBy("ext").agg(F.sum("n").alias("n_ext")).where("n_ext > 1")
    return by.join(shared, "ext").select("ext", "format", "n", "n_ext")


def run_digests(members: DataFrame, group: str, order: str, name: Column, size: Column, run: int = 1000) -> DataFrame:
    """An archive's digest in two levels: ``(group, entries, names_sha256, sizes_sha256)``.

    A group's members in order are cut into runs of at most ``run``: those whose ``order`` (whole
    numbers, unique within the group) lies between the same two multiples of ``run``. A run's digests are the SHA-256 of its names
    joined by line feeds and of its sizes as little-endian 64-bit words; an archive's are
    those of its runs' hex digests, in order, joined by line feeds. So a task holds a run, or
    one line for each run, and not all the names of a group.
    """
    at = F.col(order) - F.pmod(F.col(order), F.lit(run))
    word = F.reverse(F.lpad(F.hex(size.cast("long")), 16, "0"))  # the two digits of each byte are swapped in turn
    little = F.regexp_replace(word, "(.)(.)", "$2$1")
    entry = F.struct(F.col(order).alias("o"), name.alias("name"), little.alias("size"))
    runs = members.groupBy(group, at.alias("run")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("m"))
    names = F.sha2(F.array_join(F.col("m.name"), "\n"), 256)
    sizes = F.sha2(F.unhex(F.array_join(F.col("m.size"), "")), 256)
    line = F.struct(F.col("run").alias("run"), names.alias("names"), sizes.alias("sizes"))
    by = runs.select(group, "n", line.alias("d")).groupBy(group).agg(F.sum("n").alias("entries"), F.array_sort(F.collect_list("d")).alias("d"))
    return by.select(group, "entries", F.sha2(F.array_join("d.names", "\n"), 256).alias("names_sha256"), F.sha2(F.array_join("d.sizes", "\n"), 256).alias("sizes_sha256"))


def bind_inputs(supplied: DataFrame, forms: DataFrame, group: str) -> DataFrame:
    """The one form that accepts a group's roles, or why none does: ``(group, status, form)``.

    Supplied rows are ``(group, role)``, forms ``(form, role, least, most)`` with ``most`` NULL for any
    number. A form accepts a group when it knows all of its roles and each of the
    form's roles occurs within its bounds.
    """
    counts = supplied.groupBy(group, "role").agg(F.count("*").alias("n"))
    asked = forms.groupBy("form").agg(F.sum(F.expr("int(least > 0)")).alias("needed"))
    within = (F.col("n") >= F.col("least")) & (F.col("most").isNull() | (F.col("n") <= F.col("most")))
    met = counts.join(forms, "role").groupBy(group, "form").agg(F.count("*").alias("known"), F.bool_and(within).alias("within"), F.sum(F.expr("int(least > 0)")).alias("met"))
    roles = counts.groupBy(group).agg(F.count("*").alias("roles"))
    good = roles.join(met, group, "left").join(asked, "form", "left").withColumn("good", F.coalesce((F.col("known") == F.col("roles")) & F.col("within") & (F.col("met") == F.col("needed")), F.lit(False)))
    n = F.count_if("good")
    return good.groupBy(group).agg(F.when(n == 1, "bound").when(n == 0, "no_form").otherwise("several_forms").alias("status"), F.when(n == 1, F.max(F.when(F.col("good"), F.col("form")))).alias("form"))


def select_by_name(members: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Each name of a namespace: selected (one member), or ambiguous with its first two members."""
    counted = members.groupBy(group, name, order).agg(F.count("*").alias("__n"))
    first = counted.groupBy(group, name).agg(F.min(order).alias("__first"), F.min_by("__n", order).alias("__n_first"))
    later = counted.join(first, [group, name]).where(F.col(order) > F.col("__first")).groupBy(group, name).agg(F.min(order).alias("__later"))
    second = F.when(F.col("__n_first") > 1, F.col("__first")).otherwise(F.col("__later"))
    by = first.join(later, [group, name], "left").select(group, name, F.col("__first").alias("first"), second.alias("second"))
    return by.withColumn("status", F.when(F.col("second").isNull(), "selected").otherwise("ambiguous"))


def walk(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """A namespace walk: ``(node, parent, depth, event)`` for everything reachable from the roots, ``max_depth`` of 1 to 128.

    A member that is its own ancestor is a ``cycle`` and is not entered; a member below
    ``max_depth`` is the error ``depth``. Each level is one join with the edges and is written,
    so that no level works out those before it again; only keys of ancestors are carried.
    """
    if not 1 <= max_depth <= 128:
        raise ValueError("a walk is 1 to 128 levels deep")
    level = written(roots.select("node", F.lit(None).cast("string").alias("parent"), F.lit(1).alias("depth"), F.lit("mounted").alias("event"), F.array("node").alias("path")), "walk")
    out = level
    for depth in range(2, max_depth + 2):
        entered = level.where("event = 'mounted'").select(F.col("node").alias("parent"), "path")
        event = F.when(F.array_contains("path", F.col("child")), "cycle").otherwise("mounted" if depth <= max_depth else "depth")
        level = written(entered.join(edges, "parent").select(F.col("child").alias("node"), "parent", F.lit(depth).alias("depth"), event.alias("event"), F.concat("path", F.array("child")).alias("path")), "walk")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("path")


def select_by_index(members: DataFrame, wanted: DataFrame, group: str, order: str) -> DataFrame:
    """Members at wanted 0-based places ``(group, index)`` of a namespace: ``(group, index, order, status)``, ``missing`` where there are not so many."""
    placed = members.withColumn("index", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long") - 1)
    met = wanted.join(placed.select(group, "index", order), [group, "index"], "left")
    return met.select(group, "index", order, F.when(F.col(order).isNull(), "missing").otherwise("selected").alias("status"))


def merged_support(descriptors: DataFrame, **others: DataFrame) -> DataFrame:
    """Descriptors by id with the columns of other tables by id, each as a struct of its name, NULL where it has no row."""
    out = descriptors
    for name, df in others.items():
        out = out.join(df.select("id", F.struct(*(c for c in df.columns if c != "id")).alias(name)), "id", "left")
    return out


def compare_golden(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Expected against actual by key: missing, unexpected, different (with the fields), or equal; NULLs are equal."""
    e, a = expected.withColumn("__e", F.lit(True)).alias("e"), actual.withColumn("__a", F.lit(True)).alias("a")
    joined = e.join(a, F.col(f"e.{key}").eqNullSafe(F.col(f"a.{key}")), "full_outer")
    differing = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields))), ",")
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(differing != "", "different").otherwise("equal")
    return joined.select(F.coalesce(f"e.{key}", f"a.{key}").alias(key), status.alias("status"), F.when(status == "different", differing).alias("fields"))
