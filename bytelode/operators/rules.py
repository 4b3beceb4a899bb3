"""Rule sets over catalogues: which rule each row breaks first, in the rules' order.

A catalogue's own first error is the row of the least position whose violation is not ``ok``.
Rules that look at earlier rows do so by grouped minima, never by pairs of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelode.operators.catalog import first_violation


def lexical(c: Column) -> Column:
    """Lower-case letters, digits and hyphens within."""
    return F.coalesce(c.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"), F.lit(False))


def capability_rules(caps: Column) -> Column:
    """Whether capabilities imply what is missing: all others imply ``parse``, and ``round_trip`` both ``write`` and ``edit``."""

    def has(name: str) -> Column:
        return F.array_contains(caps, name)

    operations = has("decode") | has("edit") | has("write") | has("round_trip")
    return (~has("parse") & operations) | (has("round_trip") & ~(has("write") & has("edit")))


def _earlier_other(asks: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Positions of ``asks`` for which ``answers`` with equal keys has an earlier row of another ambiguity group (or of none).

    Of each key only two rows of ``answers`` matter: the earliest, and the earliest of another group.
    """
    first = answers.groupBy(*keys).agg(F.min(F.struct("position", "group")).alias("one"))
    other = ~F.col("group").eqNullSafe(F.col("one.group")) | F.col("group").isNull()
    second = answers.join(first, keys).where(other & (F.col("position") != F.col("one.position"))).groupBy(*keys).agg(F.min("position").alias("two"))
    both = first.join(second, keys, "left")
    same = F.coalesce(F.col("group") == F.col("one.group"), F.lit(False))
    met = asks.join(both, keys)
    clash = ((F.col("one.position") < F.col("position")) & ~same) | F.coalesce(F.col("two") < F.col("position"), F.lit(False))
    return met.where(clash).select("position").distinct()


def probe_clashes(descriptors: DataFrame, probes: DataFrame) -> DataFrame:
    """Positions of descriptors with a probe that overlaps one of an earlier descriptor of equal precedence and not of the same group.

    Descriptors are ``(position, precedence, ambiguity_group)``, probes ``(position, kind, at, digits,
    predicate, extension, parent)``. Magics overlap where their bytes meet and agree there,
    structural and contextual probes by predicate; two contextual ones also need equal
    extension and parent, whatever their case. A magic meets no other kind.
    """
    named = descriptors.select("position", "precedence", F.col("ambiguity_group").alias("group")).join(probes, "position")
    magic = named.where("kind = 'magic'").withColumn("w", F.octet_length("digits"))
    shapes = magic.select("at", "w").distinct()
    one, two = shapes.select(F.col("at").alias("a1"), F.col("w").alias("w1")), shapes.select(F.col("at").alias("a2"), F.col("w").alias("w2"))
    low, high = F.greatest("a1", "a2"), F.least(F.col("a1") + F.col("w1"), F.col("a2") + F.col("w2"))
    meeting = one.join(two, low < high).withColumns({"low": low, "high": high})

    def side(n: int) -> DataFrame:
        met = magic.join(meeting, (F.col("at") == F.col(f"a{n}")) & (F.col("w") == F.col(f"w{n}")))
        shared = F.substring("digits", F.col("low") - F.col("at") + 1, F.col("high") - F.col("low"))
        return met.select("precedence", "a1", "w1", "a2", "w2", shared.alias("shared"), "position", "group")

    found = _earlier_other(side(1), side(2), ["precedence", "a1", "w1", "a2", "w2", "shared"])
    by_name = named.where("kind <> 'magic'").select("precedence", "predicate", "kind", F.lower("extension").alias("extension"), F.lower("parent").alias("parent"), "position", "group")
    structural, contextual = by_name.where("kind = 'structural'"), by_name.where("kind = 'contextual'")
    name = ["precedence", "predicate"]
    for asks, answers, keys in ((structural, by_name, name), (contextual, structural, name), (contextual, contextual, [*name, "extension", "parent"])):
        found = found.union(_earlier_other(asks.select(*keys, "position", "group"), answers.select(*keys, "position", "group"), keys))
    return found.distinct()


def catalogue_rules(descriptors: DataFrame, probes: DataFrame, decoders: DataFrame | None = None) -> DataFrame:
    """``(position, id, violation)``: the first rule of a format catalogue that each descriptor breaks.

    Descriptors are ``(position, id, precedence, hints, ambiguity_group, confidence,
    capabilities, decoder)``. In order: ``id``, ``no_probes``, ``precedence``, ``hint``, ``group``,
    ``missing_group``, ``capabilities``, ``duplicate``, ``conflict``, ``decoder``.
    """
    earliest = descriptors.groupBy("id").agg(F.min("position").alias("first"))
    rows = descriptors.join(earliest, "id", "left")
    rows = rows.join(probes.select("position").distinct().withColumn("probed", F.lit(True)), "position", "left")
    rows = rows.join(probe_clashes(descriptors, probes).withColumn("clash", F.lit(True)), "position", "left")
    if decoders is not None:
        rows = rows.join(decoders.select(F.col("decoder")).distinct().withColumn("known", F.lit(True)), "decoder", "left")
    else:
        rows = rows.withColumn("known", F.lit(True))
    hint = F.exists("hints", lambda h: (h == "") | h.startswith(".") | h.rlike("[A-Z]"))
    checks = [
        ("id", ~lexical(F.col("id"))),
        ("no_probes", F.col("probed").isNull()),
        ("precedence", F.col("precedence") == 0),
        ("hint", hint),
        ("group", F.col("ambiguity_group").isNotNull() & ~lexical(F.col("ambiguity_group"))),
        ("missing_group", (F.col("confidence") == "ambiguous") & F.col("ambiguity_group").isNull()),
        ("capabilities", capability_rules(F.col("capabilities"))),
        ("duplicate", F.col("first") < F.col("position")),
        ("conflict", F.col("clash").isNotNull()),
        ("decoder", F.col("decoder").isNotNull() & F.col("known").isNull()),
    ]
    return first_violation(rows, ["position", "id"], checks)


#: What each edit mode asks for: preconditions, output lengths and relocations that it allows.
EDIT_MODES = {
    "confined": (["semantic-fields"], ["preserved"], ["not-applicable", "preserve-offsets"]),
    "same-size": (["lengths-unchanged"], ["preserved"], ["preserve-offsets"]),
    "allocation-fitting": (["fits-allocation"], ["preserved"], ["preserve-offsets"]),
    "rebuild": (["layout-not-preserved", "any-mutation"], ["may-change"], ["not-applicable", "recompute-offsets", "relocation-plan"]),
}


def writer_rules(contracts: DataFrame) -> DataFrame:
    """``(id, violation)``: the first rule of a writer contract that each row breaks.

    Contracts are ``(id, capabilities, reproduction, authoring, edits)``; reproduction and authoring
    are ``(scope, oracle)`` or NULL, edits ``(mode, scope, precondition, length, relocation, oracle)``
    in order; a scope is empty for the whole format or a dialect's name. In order:
    ``reproduction``, ``edit_order`` (by mode, then scope, each once), ``edit_scope``,
    ``edit_oracle``, ``edit_mode``, ``authoring``, ``edit_capability``, ``write_capability``, ``no_operation``.
    """
    order = F.create_map(*(x for n, mode in enumerate(EDIT_MODES) for x in (F.lit(mode), F.lit(n))))
    edits = F.coalesce("edits", F.array().cast(contracts.schema["edits"].dataType))

    def dialect(scope: Column) -> Column:
        return (scope == "") | scope.rlike("^[A-Za-z0-9._-]+$")

    def told(operation: Column) -> Column:
        return dialect(operation["scope"]) & (F.trim(operation["oracle"]) != "")

    def allowed(e: Column) -> Column:
        fits = F.lit(False)
        for mode, sets in EDIT_MODES.items():
            asked = [e[name].isin(values) for name, values in zip(("precondition", "length", "relocation"), sets, strict=True)]
            fits = fits | ((e["mode"] == mode) & asked[0] & asked[1] & asked[2])
        return fits

    keys = F.transform(edits, lambda e: F.struct(F.element_at(order, e["mode"]).alias("m"), e["scope"].alias("s")))
    late = F.exists(F.transform(keys, lambda k, i: (i > 0) & ~(F.get(keys, i - 1) < k)), lambda x: x)
    no_edits = F.size(edits) == 0
    checks = [
        ("reproduction", F.col("reproduction").isNotNull() & ~told(F.col("reproduction"))),
        ("edit_order", late),
        ("edit_scope", F.exists(edits, lambda e: ~dialect(e["scope"]))),
        ("edit_oracle", F.exists(edits, lambda e: F.trim(e["oracle"]) == "")),
        ("edit_mode", F.exists(edits, lambda e: ~allowed(e))),
        ("authoring", F.col("authoring").isNotNull() & ~told(F.col("authoring"))),
        ("edit_capability", F.array_contains("capabilities", "edit") == no_edits),
        ("write_capability", F.array_contains("capabilities", "write") != F.col("authoring").isNotNull()),
        ("no_operation", F.col("reproduction").isNull() & no_edits & F.col("authoring").isNull()),
    ]
    return first_violation(contracts, ["id"], checks)


#: What an embedded format's context asks of a decoder of the same id.
CONTEXT_REQUIREMENTS = {"selection": "none", "paired": "paired", "address-space": "address-space", "siblings": "siblings", "carrier-member": "carrier-member"}


def support_rules(embedded: DataFrame, descriptors: DataFrame) -> DataFrame:
    """``(position, id, violation)``: the first rule of a support catalogue that each embedded format breaks.

    Embedded formats are ``(position, id, carrier, family, decoder, discriminator, context,
    context_family, typed, dialect_group, capabilities, evidence)`` with evidence ``(handler, floor)`` or NULL,
    descriptors ``(id, detectable, requirement, decoder, capabilities)``. In order: ``id`` (its own or
    its carrier's), ``duplicate`` (of a descriptor that it does not name as carrier while that
    is detectable, or of an earlier row), ``context`` (not what the descriptor requires, or a
    carrier that is no descriptor of its id), ``agreement`` (decoder and capabilities are not the
    descriptor's), ``family`` (or decoder or discriminator empty), ``untyped`` (or of another family),
    ``capabilities``, ``evidence`` (exactly with ``corpus``), ``discriminator`` (an earlier row of the family has it, and not in the same dialect group).
    """
    of = descriptors.select("id", F.struct("detectable", "requirement", F.col("decoder").alias("decoder"), F.array_sort("capabilities").alias("capabilities")).alias("described"))
    earliest = embedded.groupBy("id").agg(F.min("position").alias("first"))
    one = embedded.groupBy("family", "discriminator").agg(F.min(F.struct("position", "dialect_group")).alias("one"))
    rows = embedded.join(of, "id", "left").join(earliest, "id").join(one, ["family", "discriminator"], "left")
    known, d = F.col("described").isNotNull(), F.col("described")
    own = F.col("carrier").eqNullSafe(F.col("id"))
    wants = F.element_at(F.create_map(*(F.lit(x) for pair in CONTEXT_REQUIREMENTS.items() for x in pair)), F.col("context"))
    corpus = F.array_contains("capabilities", "corpus")
    evidence = F.coalesce((F.col("evidence.handler") != "") & (F.col("evidence.floor") > 0), F.lit(False))
    checks = [
        ("id", ~lexical(F.col("id")) | (F.col("carrier").isNotNull() & ~lexical(F.col("carrier")))),
        ("duplicate", (F.col("first") < F.col("position")) & ~(known & d["detectable"] & own) | (known & ~(d["detectable"] & own))),
        ("context", F.when(known, ~d["requirement"].eqNullSafe(wants)).otherwise(F.col("carrier").isNotNull())),
        ("agreement", known & (~d["decoder"].eqNullSafe(F.col("decoder")) | (d["capabilities"] != F.array_sort("capabilities")))),
        ("family", ~lexical(F.col("family")) | (F.col("decoder") == "") | (F.col("discriminator") == "")),
        ("untyped", ~F.col("typed") | F.coalesce(F.col("context_family") != F.col("family"), F.lit(False))),
        ("capabilities", capability_rules(F.col("capabilities"))),
        ("evidence", F.when(corpus, ~evidence).otherwise(F.col("evidence").isNotNull())),
        ("discriminator", (F.col("one.position") < F.col("position")) & ~F.coalesce(F.col("dialect_group") == F.col("one.dialect_group"), F.lit(False))),
    ]
    return first_violation(rows, ["position", "id"], checks)


def namespace_rules(semantics: DataFrame, known: DataFrame) -> DataFrame:
    """``(position, id, violation)`` of declared namespace semantics ``(position, id, kind, addressing, execution)``.

    In order: ``id``, ``duplicate``, ``unknown`` (no format of that id), ``combination``: carriers and views
    have an addressing, and ask for an external transform only if it is selective or
    reconstructed; what is no namespace has none and is native.
    """
    earliest = semantics.groupBy("id").agg(F.min("position").alias("first"))
    rows = semantics.join(earliest, "id").join(known.select("id").distinct().withColumn("there", F.lit(True)), "id", "left")
    spaces = F.col("kind").isin("carrier", "view") & F.col("addressing").isNotNull()
    external = (F.col("execution") == "external") & F.col("addressing").isin("selective", "reconstructed")
    none = (F.col("kind") == "none") & F.col("addressing").isNull() & (F.col("execution") == "native")
    legal = (spaces & ((F.col("execution") == "native") | external)) | none
    return first_violation(rows, ["position", "id"], [("id", ~lexical(F.col("id"))), ("duplicate", F.col("first") < F.col("position")), ("unknown", F.col("there").isNull()), ("combination", ~legal)])


def golden_run(files: DataFrame, samples: DataFrame, exclusions: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(path, status)`` of a directory's files and samples: ``ok``, ``excluded``, ``undeclared`` (neither a sample nor excluded), ``absent``, ``changed``, or ``unversioned`` (its digest is not in the version ledger).

    Files are ``(path, sha256)``, samples ``(path, sha256)``, exclusions ``(path)``, the ledger ``(sha256)``.
    """
    f = files.select("path", F.col("sha256").alias("has"))
    joined = f.join(samples.select("path", "sha256"), "path", "full_outer").join(exclusions.select("path").distinct().withColumn("out", F.lit(True)), "path", "left")
    joined = joined.join(ledger.select(F.col("sha256").alias("has")).distinct().withColumn("versioned", F.lit(True)), "has", "left")
    status = F.when(F.col("sha256").isNull(), F.when(F.col("out"), "excluded").otherwise("undeclared")).when(F.col("has").isNull(), "absent").when(F.col("has") != F.col("sha256"), "changed").when(F.col("versioned").isNull(), "unversioned").otherwise("ok")
    return joined.select("path", status.alias("status"))


def module_rules(modules: DataFrame) -> DataFrame:
    """``(position, format, violation)``: the first rule of module composition that each row breaks.

    Modules are ``(position, format, owner, descriptor, embedded, declared_owners, capabilities,
    operations, strict)``: descriptor and embedded are ids or NULL, operations ``(name, purpose, id,
    capabilities)``. In order: ``format``, ``owner``, ``duplicate`` (an earlier row of the format),
    ``empty`` (neither descriptor nor support), ``identity`` (a contributed id is another's),
    ``declared_owner``, ``operation_name``, ``operation_purpose``, ``operation_id`` (twice),
    ``operation_capabilities`` (none), ``union`` (a strict row's operations do not give exactly
    its capabilities).
    """
    earliest = modules.groupBy("format").agg(F.min("position").alias("first"))
    rows = modules.join(earliest, "format", "left")
    ids = F.transform("operations", lambda o: o["id"])
    given = F.array_sort(F.array_distinct(F.flatten(F.transform("operations", lambda o: o["capabilities"]))))
    checks = [
        ("format", ~lexical(F.col("format"))),
        ("owner", ~lexical(F.col("owner"))),
        ("duplicate", F.col("first") < F.col("position")),
        ("empty", F.col("descriptor").isNull() & F.col("embedded").isNull()),
        ("identity", F.coalesce(F.col("descriptor") != F.col("format"), F.lit(False)) | F.coalesce(F.col("embedded") != F.col("format"), F.lit(False))),
        ("declared_owner", F.exists("declared_owners", lambda o: o != F.col("owner"))),
        ("operation_name", F.exists("operations", lambda o: ~lexical(o["name"]))),
        ("operation_purpose", F.exists("operations", lambda o: F.trim(o["purpose"]) == "")),
        ("operation_id", F.size(F.array_distinct(ids)) != F.size(ids)),
        ("operation_capabilities", F.exists("operations", lambda o: F.size(o["capabilities"]) == 0)),
        ("union", F.col("strict") & (given != F.array_sort(F.array_distinct("capabilities")))),
    ]
    return first_violation(rows, ["position", "format"], checks)


def package_admission(declared: DataFrame, found: DataFrame, max_cases: int, max_bytes: int, max_total: int, max_path: int, max_depth: int) -> DataFrame:
    """One row a package, ``(package, status, path)``: the first rule that it breaks, and where, or ``ok``.

    ``declared(package, position, path, size, sha256)`` are a manifest's cases in order,
    ``found(package, path, size, sha256)`` its files. In order: ``cases`` (too many); by case
    ``case_bytes``, ``total_bytes``, ``path`` (absolute, empty or dotted components, too long or
    deep), ``duplicate``; ``prefix`` (a declared path is a folder of another); ``missing``,
    ``undeclared``; then by case ``size`` and ``sha256``.
    """
    from pyspark.sql import Window

    from bytelode.functions.binary import safe_path

    w = Window.partitionBy("package").orderBy("position")
    run = declared.withColumns({"nth": F.row_number().over(w), "total": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    earliest = declared.groupBy("package", "path").agg(F.min("position").alias("first"))
    parents = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/")))
    nested = declared.where(F.contains(F.col("path"), F.lit("/"))).select("package", parents.alias("path")).distinct().withColumn("folder", F.lit(True))
    rows = run.join(earliest, ["package", "path"]).join(nested, ["package", "path"], "left")
    at_case = F.when(F.col("size") > max_bytes, 1).when(F.col("total") > max_total, 2).when(safe_path(F.col("path"), max_path, max_depth) != "ok", 3).when(F.col("first") < F.col("position"), 4)
    names = {(0, 0): "cases", (1, 1): "case_bytes", (1, 2): "total_bytes", (1, 3): "path", (1, 4): "duplicate", (2, 0): "prefix", (3, 0): "missing", (4, 0): "undeclared", (5, 1): "size", (5, 2): "sha256"}

    def broken(df: DataFrame, phase: int, position: Column, code: Column, when: Column) -> DataFrame:
        found_ = F.struct(F.lit(phase).alias("phase"), position.cast("string").alias("order"), code.alias("code"), F.col("path").alias("path"))
        return df.where(when).select("package", found_.alias("v"))

    place = F.lpad(F.col("position").cast("string"), 20, "0")
    joined = declared.join(found.select("package", "path", F.col("size").alias("has_size"), F.col("sha256").alias("has_sha256")), ["package", "path"], "left")
    wrong = F.when(F.col("size") != F.col("has_size"), 1).when(F.col("sha256") != F.col("has_sha256"), 2)
    every = (
        broken(run, 0, place, F.lit(0), F.col("nth") == max_cases + 1)
        .union(broken(rows, 1, place, at_case, at_case.isNotNull()))
        .union(broken(rows, 2, F.col("path"), F.lit(0), F.col("folder").isNotNull()))
        .union(broken(joined, 3, F.col("path"), F.lit(0), F.col("has_size").isNull()))
        .union(broken(found.join(declared, ["package", "path"], "left_anti"), 4, F.col("path"), F.lit(0), F.lit(True)))
        .union(broken(joined, 5, place, wrong, wrong.isNotNull()))
    )
    worst = every.groupBy("package").agg(F.min("v").alias("v"))
    status = F.lit("ok")
    for (phase, code), name in names.items():
        status = F.when((F.col("v.phase") == phase) & (F.col("v.code") == code), name).otherwise(status)
    packages = declared.select("package").union(found.select("package")).distinct()
    return packages.join(worst, "package", "left").select("package", status.alias("status"), F.col("v.path").alias("path"))


def admits(ceiling: Column, cost: Column) -> Column:
    """Whether a strategy's ceiling admits a cost: ``metadata`` below ``selective`` below ``whole``; unknown names are NULL."""
    order = F.create_map(*(x for n, name in enumerate(("metadata", "selective", "whole")) for x in (F.lit(name), F.lit(n))))
    return F.element_at(order, cost) <= F.element_at(order, ceiling)


def capability_matrix(descriptors: DataFrame, capabilities: list[str]) -> DataFrame:
    """``(id, line)``: each format's row of a Markdown table, in order of id; descriptors have id and an array of capabilities."""
    flags = [F.when(F.array_contains("capabilities", c), "yes").otherwise("no") for c in capabilities]
    return descriptors.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", "id", *flags), F.lit(" |")).alias("line")).orderBy("id")


def pair_ledger(pairs: DataFrame, codec: str = "codec", key: str = "id", samples: int = 5) -> DataFrame:
    """Encoded bytes against stored ones by codec: total, exact, refused, diverged and other lengths, the shallowest divergence, sample keys, and whether all are exact.

    Pairs are ``(codec, key, stored, encoded)``; a NULL encoding is a refusal. A divergence is
    at the first byte that differs within the shorter of the two: the longest equal start is found by halving steps.
    Samples are the ``samples`` least keys of pairs that are not exact.
    """
    n = F.least(F.octet_length("stored"), F.octet_length("encoded"))

    def grown(same: Column, size: Column) -> Column:
        equal = F.when(size <= n - same, F.substring("stored", same + 1, size) == F.substring("encoded", same + 1, size))
        return F.when(equal, same + size).otherwise(same)

    same = F.aggregate(F.array(*(F.lit(1 << bit) for bit in range(30, -1, -1))), F.lit(0), grown)
    at = F.when(F.col("encoded").isNotNull() & (F.col("encoded") != F.col("stored")), same)
    at = F.when(at < n, at)
    outcome = F.when(F.col("encoded").isNull(), "refused").when(F.col("encoded") == F.col("stored"), "exact").when(F.col("at").isNotNull(), "divergence").otherwise("length")
    judged = pairs.withColumn("at", at).withColumn("outcome", outcome)
    exact = F.count_if(F.col("outcome") == "exact")
    by = judged.groupBy(codec).agg(F.count("*").alias("total"), exact.alias("exact"), F.count_if(F.col("outcome") == "refused").alias("refused"), F.count_if(F.col("outcome") == "divergence").alias("diverged"), F.count_if(F.col("outcome") == "length").alias("other_length"), F.min("at").alias("shallowest"))
    least = pairs.where(F.col("encoded").isNull() | ~F.col("encoded").eqNullSafe(F.col("stored"))).select(codec, key)
    ranked = least.groupBy(codec, F.pmod(F.xxhash64(key), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_set(key)), 1, samples).alias("keys"))
    sampled = ranked.groupBy(codec).agg(F.slice(F.array_sort(F.flatten(F.collect_list("keys"))), 1, samples).alias("samples"))
    return by.join(sampled, codec, "left").withColumn("bit_exact", (F.col("total") > 0) & (F.col("exact") == F.col("total")))


def usage_snapshot(charges: DataFrame, limits: dict[str, int], group: str, order: str) -> DataFrame:
    """``(group, dimension, spent, peak, remaining, complete)`` of charges ``(group, order, dimension, amount)`` against limits.

    Charges of one order are a batch, admitted as a whole or not at all; the first batch that
    any dimension denies ends the job and spends nothing. ``peak`` is the largest admitted charge;
    ``complete`` says that nothing was denied. Charges that come together by group stay so.
    """
    from pyspark.sql import Window

    limit = F.create_map(*(x for name, n in limits.items() for x in (F.lit(name), F.lit(n).cast("long"))))
    batch = charges.where(F.col(group).isNotNull()).groupBy(group, order, "dimension").agg(F.sum("amount").alias("amount"))
    w = Window.partitionBy(group, "dimension").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = batch.withColumn("total", F.sum("amount").over(w)).withColumn("limit", F.element_at(limit, F.col("dimension")))
    first = F.min(F.when(F.col("total") > F.col("limit"), F.col(order))).over(Window.partitionBy(group))
    admitted = F.col("denied").isNull() | (F.col(order) < F.col("denied"))
    amount = F.when(admitted, F.col("amount")).otherwise(F.lit(0).cast("long"))
    by = run.withColumn("denied", first).groupBy(group, "dimension").agg(F.sum(amount).alias("spent"), F.max(amount).alias("peak"), F.first("limit").alias("limit"), F.bool_and(F.col("denied").isNull()).alias("complete"))
    return by.select(group, "dimension", "spent", "peak", (F.col("limit") - F.col("spent")).alias("remaining"), "complete")


def recognitions(carriers: DataFrame, rules: DataFrame) -> DataFrame:
    """Report-only recognition: ``(carrier_id, rule)`` of every rule whose digits a carrier holds and whose guard, if any, its extension meets.

    Rules are ``(rule, digits, guard)``. They grant nothing and exclude nothing.
    """
    fits = F.contains(F.col("content"), F.col("digits")) & (F.col("guard").isNull() | (F.lower("ext") == F.lower("guard")))
    return carriers.join(rules, fits).select("carrier_id", "rule")
