"""Byte-level BPE: token counts with the whole-token shortcut, and token ids.

Texts are cut where a character that is no white space is followed by white space.
No pre-token of the byte-level pattern spans such a cut and none is chosen by what
lies beyond it, so a chunk has the same tokens wherever it occurs, and a distinct
chunk is worked out once as long as it is kept (the memory for that is bounded in
bytes; long chunks are not kept). Chunks not met lately are worked out together: their
pre-tokens are merged in arrays, one merge of each a step.
"""

from __future__ import annotations

import json
import os
import re
import uuid

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import Kept, bounded_batches, held

#: Unicode's White_Space, as the pattern of the tokenizer has it.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_WS}]+[^{_WS}]*|[^{_WS}]+")
#: Two white spaces in a row; without any, cutting at each space and line end is cutting before white space.
_RUN = re.compile(r"\s\s")
#: Before chunks that stand for themselves; no text holds it.
_LITERAL = "\ud800"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{space}{others}]+|[{space}]+(?![^{space}])|[{space}]+"
_ASCII = re.compile(_PATTERN.format(letter="[A-Za-z]", number="[0-9]", space=r"\t-\r ", others="A-Za-z0-9"))
#: Latin, Greek and Cyrillic, whose letters and numbers no Unicode version changes; the library splits what holds others.
_OLD = regex.compile(r"[\x00-\u052f]*")
_WIDE = regex.compile(_PATTERN.format(letter=r"\p{L}", number=r"\p{N}", space=_WS, others=r"\p{L}\p{N}"))
#: Bytes of a pre-token that is merged in arrays; the library merges longer ones.
_LONGEST = 32
_NEVER = 1 << 30


def chunks(text: str) -> list[str]:
    """Keys of a text's chunks: a chunk after a space without that space, one after a line end as it is, others behind a mark."""
    if _RUN.search(text):
        return [_LITERAL + c for c in _CHUNK.findall(text)]
    keys = text.replace("\n", " \n").split(" ")
    if keys[0]:
        keys[0] = _LITERAL + keys[0]
        return keys
    return keys[1:]


def chunk_of(key: str) -> str:
    return key[1:] if key[:1] == _LITERAL else key if key[:1] == "\n" else " " + key


def load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def special_strings(tokenizer_json: str) -> list[str]:
    """Strings that stand for one token wherever they occur in a text."""
    return [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]


def check_supported(tokenizer_json: str) -> None:
    """The cuts are proven for byte-level pre-tokenising without normaliser or prefix space only."""
    j = json.loads(tokenizer_json)
    pre = j["pre_tokenizer"] or {}
    plain = [t for t in j["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
    if j["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or j["model"]["type"] != "BPE" or plain:
        raise ValueError("only byte-level BPE without normaliser, prefix space and stripping added tokens")


def prove_whole(tokenizer_json: str) -> frozenset[str]:
    """The vocabulary's strings that are one pre-token and encode alone as one token, each tried with the library."""
    t = load(tokenizer_json)
    special = set(special_strings(tokenizer_json))
    strings = [t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())]
    strings = [s for s in dict.fromkeys(strings) if s and s not in special and "�" not in s]
    alone = t.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, alone, strict=True) if len(e.ids) == 1 and len(t.pre_tokenizer.pre_tokenize_str(s)) == 1)


class ByteMerger:
    """Byte-level BPE of many pre-tokens at once, by the merges of a tokenizer file."""

    def __init__(self, tokenizer_json: str):
        import numpy as np

        check_supported(tokenizer_json)
        model = json.loads(tokenizer_json)["model"]
        self.tokenizer, vocab = load(tokenizer_json), model["vocab"]
        # How byte-level vocabularies write bytes: printing ones of Latin-1 as they are, the others from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.of_byte = np.array([vocab[self.shown[b]] for b in range(256)], dtype=np.int32)
        self.width = max(vocab.values()) + 1
        pairs: dict[int, int] = {}
        #: What the merge of each rank gives.
        self.by_rank = np.zeros(len(model["merges"]), dtype=np.int32)
        for rank, m in enumerate(model["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            pairs.setdefault(vocab[x] * self.width + vocab[y], rank)
            self.by_rank[rank] = vocab[x + y]
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        first = self.of_byte.astype(np.int64)
        self.rank_of_bytes = self.rank(first[:, None] * self.width + first[None, :])

    def rank(self, keys):
        """When pairs of ids merge, or never."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NEVER).astype(np.int32)

    def pretokens(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return _ASCII.findall(chunk)
        if _OLD.fullmatch(chunk):
            return _WIDE.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]

    def merge(self, pieces: list[str]):
        """(ids of all pieces, one after the other; number of ids of each)."""
        import numpy as np

        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        counts, parts = np.zeros(len(data), dtype=np.int64), []
        flat, begin = np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(size) - size
        for low, high in ((0, 4), (4, 8), (8, 16), (16, _LONGEST)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if len(rows):
                parts.append((rows, self._merge_rows(flat, begin[rows], size[rows], high)))
        for k in np.flatnonzero(size > _LONGEST).tolist():
            ids = [t.id for t in self.tokenizer.model.tokenize("".join(map(self.shown.__getitem__, data[k])))]
            parts.append((np.array([k]), np.array([ids], dtype=np.int32)))
        for rows, ids in parts:
            counts[rows] = (ids >= 0).sum(1)
        out, start = np.zeros(int(counts.sum()), dtype=np.int32), np.cumsum(counts) - counts
        for rows, ids in parts:
            there = ids >= 0
            out[(start[rows][:, None] + np.cumsum(there, axis=1) - 1)[there]] = ids[there]
        return out, counts

    def _merge_rows(self, flat, begin, size, width: int):
        """Ids by row, padded with -1, of pieces of ``width`` bytes at most."""
        import numpy as np

        columns = np.arange(width + 1)
        there = columns < size[:, None]
        raw = np.zeros(there.shape, dtype=np.uint8)
        raw[there] = flat[(begin[:, None] + columns)[there]]
        out = np.where(there, self.of_byte[raw], np.int32(-1))
        ranks = np.full(there.shape, _NEVER, dtype=np.int32)
        ranks[:, :-1] = np.where(there[:, 1:], self.rank_of_bytes[raw[:, :-1], raw[:, 1:]], _NEVER)
        ids, rows = out.copy(), np.arange(len(out))
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(at)), at]
            go = best < _NEVER
            if not go.all():
                out[rows[~go]] = ids[~go]
                ids, ranks, rows, at, best = ids[go], ranks[go], rows[go], at[go], best[go]
            if not len(rows):
                return out
            every, after = np.arange(len(rows)), columns[:-1] > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            ids[every, at] = self.by_rank[best]
            for left in (at - 1, at):
                some = np.flatnonzero(left >= 0)
                k = left[some]
                a, b = ids[some, k].astype(np.int64), ids[some, k + 1]
                ranks[some, k] = np.where(b >= 0, self.rank(a * self.width + b), _NEVER)


class _Texts:
    """Cuts texts at special strings and into chunks."""

    def __init__(self, tokenizer_json: str, kept_bytes: int):
        self.merger, self.kept = ByteMerger(tokenizer_json), Kept(kept_bytes)
        self.special = sorted(special_strings(tokenizer_json), key=len, reverse=True)
        self.at_special = re.compile(f"({'|'.join(map(re.escape, self.special))})") if self.special else None

    def keys(self, text: str | None) -> list[str]:
        if not text:
            return []
        for x in self.special:
            if x in text:
                return [c for x in self.at_special.split(text) if x for c in ([_LITERAL + x] if x in self.special else chunks(x))]
        return chunks(text)


class TokenCounter(_Texts):
    """Numbers of tokens: pre-tokens proven whole count one, and only the rest are merged."""

    def __init__(self, tokenizer_json: str, whole: frozenset[str], kept_bytes: int = 96 << 20):
        super().__init__(tokenizer_json, kept_bytes)
        self.whole = whole.union(self.special)

    def _count(self, keys: list[str]) -> list[int]:
        import numpy as np

        whole, pretokens = self.whole, self.merger.pretokens
        n, rest, of = np.ones(len(keys), dtype=np.int64), [], []
        for k, key in enumerate(keys):
            c = chunk_of(key)
            if c not in whole:
                parts = pretokens(c)
                left = [p for p in parts if p not in whole]
                n[k] = len(parts) - len(left)
                rest += left
                of += [k] * len(left)
        if rest:
            np.add.at(n, of, self.merger.merge(rest)[1])
        return n.tolist()

    def count_all(self, texts: list[str | None]) -> list[int]:
        return self.kept.folded(map(self.keys, texts), self._count, sum)

    def count(self, text: str | None) -> int:
        return self.count_all([text])[0]


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row.

    The tokens are those of the library without added begin or end; special strings
    inside a text count as the library takes them, as one token. Null and empty texts
    have none. The vocabulary and the proof, bounded by its size, go out by broadcast;
    texts of any length are counted whole. Repeated rows give repeated results.
    """
    bounded_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, prove_whole(tokenizer_json)))
    key = uuid.uuid4().hex

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        counter = held("counter", key, lambda: TokenCounter(*shared.value))
        return pa.array(counter.count_all(texts.to_pylist()), pa.int64())

    counted = docs.select("doc_id", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), n_tokens(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


class TokenEncoder(_Texts):
    """Token ids of whole texts."""

    def __init__(self, tokenizer_json: str, dtype: str, kept_bytes: int = 96 << 20):
        super().__init__(tokenizer_json, kept_bytes)
        self.dtype = dtype

    def _encode(self, keys: list[str]) -> list[bytes]:
        import numpy as np

        pieces, n, special = [], [], {}
        for k, key in enumerate(keys):
            if key.isascii() and key.isalpha():
                pieces.append(" " + key)
                n.append(1)
                continue
            c = chunk_of(key)
            if c in self.special:
                special[k] = c
                n.append(0)
            else:
                parts = self.merger.pretokens(c)
                pieces += parts
                n.append(len(parts))
        ids, counts = self.merger.merge(pieces)
        data = ids.astype(self.dtype).tobytes()
        ends = (np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *n])] * np.dtype(self.dtype).itemsize).tolist()
        found = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for k, c in special.items():
            found[k] = np.array([self.merger.tokenizer.token_to_id(c)], dtype=self.dtype).tobytes()
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as consecutive little-endian numbers."""
        return self.kept.folded(map(self.keys, texts), self._encode, b"".join)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]
