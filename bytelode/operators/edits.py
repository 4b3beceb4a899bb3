"""Edits of a carrier in place: all are checked before any byte changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytelode.functions.binary import zeros


def _first(edits: Column, codes) -> Column:
    """``(at, code)`` of the first edit with a code, else NULL."""
    return F.array_min(F.filter(F.transform(edits, lambda e, i: F.struct(i.alias("at"), codes(e, i).alias("code"))), lambda x: x["code"].isNotNull()))


def same_size_splice(content: Column, edits: Column) -> Column:
    """Replacements ``(start, length, bytes)`` in order, of which a later one wins: ``(status, at, content)``.

    The first edit whose bytes are not as many as its extent (``size``) or that does not lie
    within the carrier (``range``) refuses all. No edits leave the carrier as it is.
    """
    worst = _first(edits, lambda e, i: F.when(F.octet_length(e["bytes"]) != e["length"], 1).when((e["start"] < 0) | (e["start"] + e["length"] > F.octet_length(content)), 2))
    done = F.aggregate(edits, content, lambda c, e: F.overlay(c, e["bytes"], (e["start"] + 1).cast("int"), e["length"].cast("int")))
    status = F.when(worst.isNull(), "ok").when(worst["code"] == 1, "size").otherwise("range")
    return F.struct(status.alias("status"), worst["at"].alias("at"), F.when(worst.isNull(), done).alias("content"))


_PATCH = ("ok", "id", "duplicate", "source", "source_nul", "target_nul", "capacity", "range", "source_long", "target_long", "overlap", "mismatch", "no_nul")


def patch_strings(content: Column, patches: Column, expected_sha256: Column | None = None) -> Column:
    """Strings in fixed slots replaced: ``(status, content)``.

    Patches are ``(id, offset, capacity, source, target)``. Checks: the carrier's digest; then by
    patch an empty or repeated id, an empty source, a NUL in source or target, no capacity, a
    slot outside the carrier, a source or target that does not fit with its NUL; then slots
    that overlap; then, in slot order, bytes that are not the source or lack its NUL. The
    target is written with NULs up to the slot's end.
    """
    nul = F.unhex(F.lit("00"))

    def code(p: Column, i: Column) -> Column:
        return (
            F.when(p["id"] == "", 1)
            .when(F.exists(F.slice(patches, F.lit(1), i), lambda q: q["id"] == p["id"]), 2)
            .when(F.octet_length(p["source"]) == 0, 3)
            .when(F.position(nul, p["source"]) > 0, 4)
            .when(F.position(nul, p["target"]) > 0, 5)
            .when(p["capacity"] <= 0, 6)
            .when((p["offset"] < 0) | (p["offset"] + p["capacity"] > F.octet_length(content)), 7)
            .when(F.octet_length(p["source"]) + 1 > p["capacity"], 8)
            .when(F.octet_length(p["target"]) + 1 > p["capacity"], 9)
        )

    def found(p: Column, i: Column) -> Column:
        n = F.octet_length(p["source"])
        return F.when(F.substring(content, (p["offset"] + 1).cast("int"), n) != p["source"], 11).when(F.substring(content, (p["offset"] + n + 1).cast("int"), F.lit(1)) != nul, 12)

    slots = F.array_sort(F.transform(patches, lambda p: F.struct(p["offset"].alias("offset"), p["capacity"].alias("capacity"), p["source"].alias("source"), p["target"].alias("target"))))
    overlap = F.exists(F.transform(slots, lambda p, i: (i > 0) & (p["offset"] < F.get(slots, i - 1)["offset"] + F.get(slots, i - 1)["capacity"])), lambda x: x)
    number = F.coalesce(_first(patches, code)["code"], F.when(overlap, 10), _first(slots, found)["code"], F.lit(0))
    status = F.element_at(F.array(*map(F.lit, _PATCH)), number + 1)
    if expected_sha256 is not None:
        status = F.when(F.sha2(content, 256) != expected_sha256, "sha256").otherwise(status)
    done = F.aggregate(slots, content, lambda c, p: F.overlay(c, F.concat(p["target"], zeros(p["capacity"] - F.octet_length(p["target"]))), (p["offset"] + 1).cast("int"), p["capacity"].cast("int")))
    return F.struct(status.alias("status"), F.when(status == "ok", done).alias("content"))
