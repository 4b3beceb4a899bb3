"""Benchmark passages in documents, found by one Aho-Corasick automaton.

The automaton is over words, as numbers. Any ``size`` consecutive words of an item hold one
of its aligned blocks of half that many, so the blocks are its patterns (an item of fewer
than ``size`` words is one pattern): one node a word, not ``size``. A text is scanned once,
and each match is carried on to both sides along the item's words.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import bounded_batches, fresh_name, held, written

#: Bytes of benchmark text in one automaton, which takes some 15 to 25 times as much memory in a Python
#: worker. A larger benchmark takes several, and a written pass over the documents for each.
MAX_BYTES = 16 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

_HITS = "struct<n_words: long, n_hit: long, item_ids: array<string>, spans: array<struct<start: long, end: long>>>"


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8: A-Z lower-cased, split at ASCII other than letters and digits."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Passages:
    """The automaton over all items' blocks, with the items' words to carry matches on."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = 10):
        import ahocorasick

        self.size, self.block = size, max(1, size // 2)
        self.number: dict[bytes, int] = {}
        same: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = tuple(self.number.setdefault(x, len(self.number) + 1) for x in words(text))
            if w:
                same.setdefault(w, set()).add(item)
        #: The distinct word sequences and the items of each.
        self.words, self.ids = list(same), [sorted(x) for x in same.values()]
        #: By pattern: (sequence, where in it the pattern starts).
        self.places: list[list[tuple[int, int]]] = []
        self.machine, known = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
        for k, w in enumerate(self.words):
            n = self.block if len(w) >= size else len(w)
            for at in range(0, len(w) - n + 1, n):
                x = w[at : at + n]
                if x not in known:
                    known[x] = len(self.places)
                    self.places.append([])
                    self.machine.add_word(x, known[x])
                self.places[known[x]].append((k, at))
        self.lengths = [0] * len(self.places)
        for x, k in known.items():
            self.lengths[k] = len(x)
        if known:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, set[int], set[str]]:
        """(number of words, numbers of the words inside any occurrence, ids of the items found)."""
        import numpy as np

        found = words(text)
        if not found or not self.places:
            return len(found), set(), set()
        get = self.number.get
        ids = tuple([get(w, 0) for w in found])
        edge, items, runs = None, set(), {}
        for end, pattern in self.machine.iter(ids):
            for k, at in self.places[pattern]:
                w = self.words[k]
                first = end - self.lengths[pattern] + 1
                if runs.get((k, first - at), -1) >= end:
                    continue
                low, high, p, q = first, end + 1, at, at + end - first + 1
                if len(w) >= self.size:
                    while p and low and ids[low - 1] == w[p - 1]:
                        low, p = low - 1, p - 1
                    while q < len(w) and high < len(ids) and ids[high] == w[q]:
                        high, q = high + 1, q + 1
                    runs[k, first - at] = high - 1
                    if high - low < self.size:
                        continue
                if edge is None:
                    edge = np.zeros(len(ids) + 1, dtype=np.int64)
                edge[low] += 1
                edge[high] -= 1
                items.update(self.ids[k])
        return len(ids), set() if edge is None else set(np.flatnonzero(np.cumsum(edge[:-1])).tolist()), items


def original_spans(text: str, hit: set[int]) -> list[tuple[int, int]]:
    """Character spans in the text as it was given, one for each run of hit words."""
    spans: list[tuple[int, int]] = []
    before = -2
    for n, m in enumerate(_WORD.finditer(text.translate(_LOWER))):
        if n in hit:
            spans = [*spans[:-1], (spans[-1][0], m.end())] if n == before + 1 else [*spans, m.span()]
            before = n
    return spans


def _scanner(items: Broadcast, size: int):
    key = uuid.uuid4().hex

    @F.arrow_udf(_HITS)
    def hits(texts: pa.Array) -> pa.Array:
        passages = held("automaton", key, lambda: Passages(items.value, size))
        out = []
        for t in texts.to_pylist():
            n, hit, ids = passages.scan(t)
            out.append({"n_words": n, "n_hit": len(hit), "item_ids": sorted(ids), "spans": [{"start": a, "end": b} for a, b in original_spans(t, hit)] if hit else []})
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        return pa.array(out, kind)

    return hits


def _merge_spans(a: F.Column, b: F.Column) -> F.Column:
    """Sorted, disjoint spans that cover both lists; spans of neighbouring words of two lists may stay apart."""
    start = F.array_sort(F.concat(a, b))
    return F.aggregate(
        start,
        F.slice(a, 1, 0),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = 10, max_bytes: int = MAX_BYTES, to: str = "hits") -> DataFrame:
    """``docs`` with a struct column ``to``: n_words, n_hit, item_ids (sorted), spans in the original text.

    The benchmark is the bounded side: its bytes are summed first, and the automata
    are built from shards of ``max_bytes`` at most, each sent to the workers by
    broadcast; most benchmarks fit in one automaton and take one scan. With more
    shards the documents pass each in turn, row by row and without a shuffle, written
    between two, so that a worker holds one automaton at a time; n_hit is then counted
    from the merged spans. Null and empty texts have no words and no
    hits; items without words never occur; repeated items report each id once; items
    of fewer than ``size`` words are one window. Extra columns pass
    through; a column ``to`` that is there is replaced.
    """
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // max_bytes) or 1
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    for n in range(shards):
        part = benchmark if shards == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == n)
        rows = [(r[0], r[1]) for r in part.select(item, "text").where("text is not null").toLocalIterator()]
        one = _scanner(sc.broadcast(rows), size)(F.col(text))
        if not n:
            docs = docs.withColumn(to, one)
            continue
        docs = written(docs, "scanned")
        new = fresh_name(docs, "more_hits")
        docs = docs.withColumn(new, one)
        spans = _merge_spans(F.col(to)["spans"], F.col(new)["spans"])
        folded = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + F.regexp_count(F.substring(folded, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))
        docs = docs.withColumn(to, F.struct(F.col(to)["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.array_sort(F.array_union(F.col(to)["item_ids"], F.col(new)["item_ids"])).alias("item_ids"), spans.alias("spans"))).drop(new)
    return docs


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; their columns stay as they are.

    Rows are judged by their text alone: null and empty texts stay, rows that repeat are
    judged alike. An empty benchmark drops nothing, an empty table stays empty.
    """
    to = fresh_name(docs, "hits")
    return find_passages(docs, benchmark, text, to=to).where(F.col(to)["n_hit"] == 0).drop(to)


def brute_force(text: str | None, items: dict, size: int = 10) -> tuple[int, int, int, str]:
    """The same by comparing every window with every position, for tests."""
    w = _WORD.findall((text or "").translate(_LOWER))
    hit, ids = set(), set()
    for item, t in items.items():
        v = _WORD.findall((t or "").translate(_LOWER))
        k = min(size, len(v))
        for x in {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else ():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == x:
                    hit |= set(range(i, i + k))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
