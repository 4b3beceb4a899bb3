"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file, the transducer is the composition of

- the normaliser: an alphabet that maps every character to a symbol (a space and the escape
  sign to the same one, characters outside the lexicon to the symbol 0), and the dummy prefix;
- the lexicon: a trie over symbols whose final states are pieces, closed under repetition;
- the byte fallback: an arc over the symbol 0 that gives the character's UTF-8 bytes.

Composed with an input it is a lattice: nodes are places, arcs are pieces over stretches of
the input. The encoding is the shortest path in the tropical semiring: weights add along a
path, the least total wins. ``relax`` takes it place by place, for all inputs of a batch at
once in arrays.

- Unigram models: an arc weighs minus its piece's score.
- BPE models: scores rank merges, and the path of the best total score is not what merging
  gives. But merging gives the one sequence of pieces in which every piece is what merging
  makes of itself, and every two neighbours are what merging makes of the two together: a
  first merge across a border would also happen between the two alone. So states are
  (place, last piece), and an arc weighs zero after a piece that it stands beside under
  merging and infinity after another. One path is finite, and one state at each place, as
  the same holds for each prefix. Whether two pieces stand together is read off their
  spines (``Transducer.weight``).

No piece holds the escape sign after another character, so an input is composed stretch by
stretch, each up to the next escape sign, and a distinct stretch once as long as it is kept
(the memory for that is bounded in bytes; long stretches are not kept).
"""

from __future__ import annotations

import codecs
import re
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import Kept, bounded_batches, held

ESCAPE = "▁"
_STRETCH = re.compile(" +[^ ]*|[^ ]+")
#: Before keys that are a whole stretch; others stand for a stretch without its leading space. No text holds it.
_LITERAL = "\ud800"
#: Places of a stretch that are relaxed in step with other stretches; longer ones are relaxed by themselves.
_LONG = 48
_KEYS = 1 << 18
_PAIR_BITS = 20
codecs.register_error("each-byte", lambda e: ("�", e.start + 1))
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: ints, 4-byte floats and byte strings."""
    import struct

    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            at += 8
        else:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Transducer:
    """The compiled model: alphabet, lexicon trie, byte fallback, and for BPE what the weights are read off."""

    kind: int
    pieces: dict[str, tuple[int, float]]
    surface: list[str]
    types: list[int]
    byte_ids: dict[int, int]
    unknown: int
    prefix: bool = True
    symbols: dict[str, int] = field(default_factory=dict)
    #: Edges of the trie as sorted ``state * len(symbols) + symbol``, and the states that they lead to.
    edges: object = None
    targets: object = None
    #: By state: the piece that ends there, or -1.
    final: object = None
    #: By piece: symbols at its left and right border while it is merged, when each is formed and when consumed.
    left: tuple = ()
    right: tuple = ()
    #: Sorted ``id * number of ids + id`` of two pieces that merge, and when.
    joins: object = None
    ranks: object = None

    def weight(self, a, b):
        """Weights of arcs ``b`` after pieces ``a``, for BPE: 0 where merging leaves the border, else infinity.

        Merging takes the best rank first, the leftmost of equal ones, and the merges within
        a piece go by rank. So while the two sides are merged, the border lies between a
        symbol of ``a``'s right spine and one of ``b``'s left spine that exist at the same
        time, and is lost where these two merge at a better rank than consumes either.
        """
        import numpy as np

        lost = np.zeros(len(a), dtype=bool)
        (rs, rf, rc), (ls, lf, lc) = self.right, self.left
        width = len(self.surface)
        for i in range(rs.shape[1]):
            some = np.flatnonzero(rs[a, i] >= 0)
            if not len(some):
                break
            for j in range(ls.shape[1]):
                some = some[ls[b[some], j] >= 0]
                if not len(some):
                    break
                x, y = a[some], b[some]
                at = np.flatnonzero((rf[x, i] <= lc[y, j]) & (lf[y, j] < rc[x, i]))
                x, y = x[at], y[at]
                key = rs[x, i].astype(np.int64) * width + ls[y, j]
                place = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
                m = self.ranks[place]
                lost[some[at[(self.joins[place] == key) & (m < rc[x, i]) & (m <= lc[y, j])]]] = True
        return np.where(lost, np.inf, 0.0)


def merge_steps(pieces: dict[str, tuple[int, float]], chars: str):
    """BPE by definition: join the neighbours of the best score, the leftmost first. Yields (rank, symbols) after each step."""
    s = list(chars)
    yield -float("inf"), s
    while len(s) > 1:
        best, at = None, -1
        for i in range(len(s) - 1):
            hit = pieces.get(s[i] + s[i + 1])
            if hit and (best is None or hit[1] > best):
                best, at = hit[1], i
        if best is None:
            return
        s = [*s[:at], s[at] + s[at + 1], *s[at + 2 :]]
        yield -best, s


def _spine(steps: list[tuple[float, list[str]]], end: int) -> list[tuple[str, float, float]]:
    """(symbol, formed, consumed) of each symbol that is at an end of a piece in turn."""
    found: list[list] = []
    for rank, s in steps:
        if not found or s[end] != found[-1][0]:
            if found:
                found[-1][2] = rank
            found.append([s[end], rank, float("inf")])
    return [tuple(x) for x in found]


def _table(spines: dict[int, list], pieces: dict, n: int) -> tuple:
    import numpy as np

    width = max(map(len, spines.values()), default=1)
    ids, formed, consumed = np.full((n, width), -1, dtype=np.int32), np.zeros((n, width)), np.zeros((n, width))
    for p, spine in spines.items():
        for k, (symbol, f, c) in enumerate(spine):
            ids[p, k], formed[p, k], consumed[p, k] = pieces[symbol][0], f, c
    return ids, formed, consumed


def build(kind: int, pieces: dict[str, tuple[int, float]], surface: list[str], types: list[int], byte_ids: dict[int, int], unknown: int, prefix: bool = True) -> Transducer:
    """Compile normaliser, lexicon and byte fallback."""
    import numpy as np

    t = Transducer(kind, pieces, surface, types, byte_ids, unknown, prefix)
    t.symbols = {c: k + 1 for k, c in enumerate(sorted({c for p in pieces for c in p} | {ESCAPE}))}
    valid = pieces
    if kind == _BPE:
        if any(c not in pieces for p in pieces for c in p):
            raise ValueError("a piece holds a character that is no piece")
        valid, left, right = {}, {}, {}
        for p, (i, _) in pieces.items():
            steps = list(merge_steps(pieces, p))
            if any(a[0] > b[0] for a, b in zip(steps, steps[1:], strict=False)):
                raise ValueError("the merges within a piece do not go by score")
            if steps[-1][1] == [p]:
                valid[p], left[i], right[i] = (i, 0.0), _spine(steps, 0), _spine(steps, -1)
        t.left, t.right = _table(left, pieces, len(surface)), _table(right, pieces, len(surface))
        joins = sorted((pieces[p[:k]][0] * len(surface) + pieces[p[k:]][0], -s) for p, (_, s) in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces)
        t.joins, t.ranks = np.array([k for k, _ in joins] or [-1], dtype=np.int64), np.array([r for _, r in joins] or [0.0])
    width, edges, final = len(t.symbols) + 1, {}, [-1]
    for p, (i, _) in valid.items():
        state = 0
        for c in p:
            key = state * width + t.symbols[c]
            if key not in edges:
                edges[key] = len(final)
                final.append(-1)
            state = edges[key]
        final[state] = i
    t.edges, t.final = np.array(sorted(edges) or [-1], dtype=np.int64), np.array(final, dtype=np.int32)
    t.targets = np.array([edges.get(k, 0) for k in t.edges.tolist()], dtype=np.int32)
    return t


def compile_model(path: str) -> Transducer:
    """Read and compile a model file of the unigram or BPE kind with the identity character map."""
    with open(path, "rb") as f:
        model = f.read()
    pieces, surface, types, byte_ids = {}, [], [], {}
    kind, unknown, fallback, prefix, squeeze, charsmap, escape, suffix = _UNIGRAM, 0, False, True, True, b"", True, False
    for number, value in _fields(model):
        if number == 1:
            got = dict(_fields(value))
            piece, score, of = got.get(1, b"").decode("utf-8"), got.get(2, 0.0), got.get(3, _NORMAL)
            i = len(surface)
            surface.append(piece)
            types.append(of)
            if of == _BYTE:
                byte_ids[int(piece[3:5], 16)] = i
            elif of == _NORMAL:
                pieces[piece] = (i, score)
            elif of == _UNKNOWN:
                unknown = i
            elif of in (_USER, _UNUSED):
                raise ValueError("models with user-defined or unused pieces are not supported")
        elif number == 2:
            got = dict(_fields(value))
            kind, fallback, suffix = got.get(3, _UNIGRAM), bool(got.get(35, 0)), bool(got.get(24, 0))
        elif number == 3:
            got = dict(_fields(value))
            charsmap, prefix, squeeze, escape = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
    if kind not in (_UNIGRAM, _BPE) or charsmap or squeeze or not escape or suffix or not fallback or any(ESCAPE in p.lstrip(ESCAPE) for p in pieces):
        raise ValueError("only unigram and BPE models with identity character map, kept white space, escape prefix and byte fallback")
    return build(kind, pieces, surface, types, byte_ids, unknown, prefix)


class Encoder:
    """Composes inputs with a transducer and takes shortest paths."""

    def __init__(self, transducer: Transducer, kept_bytes: int = 96 << 20):
        import numpy as np

        t = self.t = transducer
        self.kept = Kept(kept_bytes)
        self.width, self.n_ids = len(t.symbols) + 1, len(t.surface)
        #: The normaliser: the symbol of each code point.
        self.alphabet = np.zeros(0x110000, dtype=np.int32)
        self.alphabet[[ord(c) for c in t.symbols]] = list(t.symbols.values())
        self.alphabet[ord(" ")] = t.symbols[ESCAPE]
        #: Symbols that follow one another in some piece; elsewhere a stretch can be cut.
        pairs = {t.symbols[a] * self.width + t.symbols[b] for p in t.pieces for a, b in zip(p, p[1:], strict=False)}
        self.joined = np.array(sorted(pairs) or [-1], dtype=np.int64)
        scores = [s for _, s in t.pieces.values()]
        self.cost = np.zeros(self.n_ids + 1)
        if t.kind == _UNIGRAM:
            for i, s in t.pieces.values():
                self.cost[i] = -s
            self.cost[-1] = 10 - min(scores, default=0.0)  # a byte fallback costs ten more than the worst piece
        self.pair_keys, self.pair_costs = np.full(1 << _PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << _PAIR_BITS, dtype=np.float32)
        self.byte_ids = np.array([t.byte_ids.get(b, t.unknown) for b in range(256)], dtype="<i4")
        #: What an id alone decodes to; bytes of longer UTF-8 sequences are read together.
        self.alone = [self._alone(i) for i in range(len(t.surface))]
        self.high = frozenset(i for b, i in t.byte_ids.items() if b >= 128)

    def _alone(self, i: int) -> str:
        of, surface = self.t.types[i], self.t.surface[i]
        return "" if of == _CONTROL else " ⁇ " if of == _UNKNOWN else chr(int(surface[3:5], 16)) if of == _BYTE else surface.replace(ESCAPE, " ")

    def weights(self, before, arcs):
        """Weights of arcs after the last pieces ``before`` (-1: none, the number of ids: a byte fallback)."""
        import numpy as np

        out = self.cost[arcs]
        if self.t.kind == _UNIGRAM:
            return out
        some = np.flatnonzero((before >= 0) & (before < self.n_ids) & (arcs < self.n_ids))
        key = before[some].astype(np.int64) * self.n_ids + arcs[some]
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PAIR_BITS)
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            keys, first = np.unique(key[new], return_index=True)
            at = slot[new][first]
            found = self.t.weight(keys // self.n_ids, keys % self.n_ids)
            out[some] = self.pair_costs[slot]
            out[some[new]] = found[np.searchsorted(keys, key[new])]
            self.pair_keys[at], self.pair_costs[at] = keys, found
            last = self.pair_keys[at] == keys  # of keys that share a slot one stays
            self.pair_costs[at[last]] = found[last]
        else:
            out[some] = self.pair_costs[slot]
        return out

    def arcs(self, symbols, ends, at):
        """The lattice: (first place, end place, piece) of all arcs that start at the places ``at``; ``ends`` bounds them."""
        import numpy as np

        edges, targets, final = self.t.edges, self.t.targets, self.t.final
        starts, stops, pieces = [], [], []
        state, to = np.zeros(len(at), dtype=np.int64), at
        limit = ends[at]
        while len(at):
            key = state * self.width + symbols[to]
            place = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
            on = np.flatnonzero(edges[place] == key)
            state, at, to, limit = targets[place[on]].astype(np.int64), at[on], to[on] + 1, limit[on]
            hit = np.flatnonzero(final[state] >= 0)
            starts.append(at[hit])
            stops.append(to[hit])
            pieces.append(final[state[hit]])
            on = np.flatnonzero(to < limit)
            state, at, to, limit = state[on], at[on], to[on], limit[on]
        return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, stops, pieces))

    def relax(self, segments, starts, stops, pieces, last, total, back) -> None:
        """Relax all segments in step: after round k, the nodes k places into their segment hold their least total.

        ``last``, ``total`` and ``back`` are by node: the last piece of the best path, its
        total weight and the node before. A node's best arc is the least sum of the total
        before it and its own weight (the earliest start of equal ones).
        """
        import numpy as np

        order = np.lexsort((starts, stops, stops - segments))
        starts, stops, pieces, step = starts[order], stops[order], pieces[order], (stops - segments)[order]
        bounds = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, e, p = starts[lo:hi], stops[lo:hi], pieces[lo:hi]
            reached = np.flatnonzero(np.isfinite(total[s]))
            s, e, p = s[reached], e[reached], p[reached]
            sums = total[s] + self.weights(last[s], p)
            good = np.flatnonzero(np.isfinite(sums))
            s, e, p, sums = s[good], e[good], p[good], sums[good]
            if not len(e):
                continue
            first = np.flatnonzero(np.diff(e, prepend=-1))
            if len(first) < len(e):
                least = np.minimum.reduceat(sums, first)
                group = np.cumsum(np.diff(e, prepend=-1) != 0) - 1
                best = np.flatnonzero(sums == least[group])
                best = best[np.unique(group[best], return_index=True)[1]]
                s, e, p, sums = s[best], e[best], p[best], sums[best]
            total[e], last[e], back[e] = sums, p, s

    def relax_long(self, start: int, end: int, starts, stops, pieces, last, total, back) -> None:
        """The same for one long segment, place by place; weights between neighbouring arcs are taken all at once before."""
        import numpy as np

        order = np.lexsort((starts, stops))
        starts, stops, pieces = starts[order], stops[order], pieces[order]
        bpe, allowed = self.t.kind == _BPE, set()
        if bpe:
            by_start = np.argsort(starts, kind="stable")
            for lo in range(0, len(stops), _KEYS):
                a, b = np.searchsorted(starts[by_start], stops[lo : lo + _KEYS], "left"), np.searchsorted(starts[by_start], stops[lo : lo + _KEYS], "right")
                n = b - a
                x = np.repeat(pieces[lo : lo + _KEYS], n)
                y = pieces[by_start[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]]
                keys = np.unique(x.astype(np.int64) * self.n_ids + y)
                allowed.update(keys[np.isfinite(self.t.weight(keys // self.n_ids, keys % self.n_ids))].tolist())
        cost = self.cost.tolist()
        sums, of, before = [float("inf")] * (end - start + 1), [-1] * (end - start + 1), [0] * (end - start + 1)
        sums[0] = 0.0
        for s, e, p in zip((starts - start).tolist(), (stops - start).tolist(), pieces.tolist(), strict=True):
            if sums[s] < float("inf") and (not bpe or of[s] < 0 or of[s] * self.n_ids + p in allowed):
                x = sums[s] + cost[p]
                if x < sums[e]:
                    sums[e], of[e], before[e] = x, p, s
        total[start : end + 1], last[start : end + 1], back[start : end + 1] = sums, of, np.array(before) + start

    def paths(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch (none empty), as little-endian 32-bit numbers."""
        import numpy as np

        codes = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        n, length = len(codes), np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
        symbols = self.alphabet[codes].astype(np.int64)
        cut = np.ones(n, dtype=bool)
        key = symbols[:-1] * self.width + symbols[1:]
        cut[1:] = self.joined[np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)] != key
        first_of = np.cumsum(length) - length
        cut[first_of] = True
        # A segment is what lies between cuts; it has a node before each character and one at its end.
        begins = np.flatnonzero(cut)
        segment = np.cumsum(cut) - 1
        size = np.diff(begins, append=n)
        node = np.arange(n) + segment
        n_nodes = n + len(begins)
        of_node = np.zeros(n_nodes, dtype=np.int64)
        of_node[node] = symbols
        seg_first, seg_last = begins + np.arange(len(begins)), begins + np.arange(len(begins)) + size
        ends = np.zeros(n_nodes, dtype=np.int64)
        ends[node] = seg_last[segment]
        last, total, back = np.full(n_nodes, -1, dtype=np.int64), np.full(n_nodes, np.inf), np.zeros(n_nodes, dtype=np.int64)
        total[seg_first] = 0.0
        starts, stops, pieces = self.arcs(of_node, ends, node[symbols > 0])
        # Byte fallback: a character outside the lexicon, or one that no piece starts with alone.
        alone = np.zeros(n_nodes, dtype=bool)
        alone[starts[stops - starts == 1]] = True
        out = node[~alone[node]]
        starts, stops, pieces = np.concatenate([starts, out]), np.concatenate([stops, out + 1]), np.concatenate([pieces.astype(np.int64), np.full(len(out), self.n_ids)])
        place = np.zeros(n_nodes, dtype=np.int64)
        place[node] = segment
        owner = place[starts]
        long = size > _LONG
        quick = np.flatnonzero(~long[owner])
        self.relax(seg_first[owner[quick]], starts[quick], stops[quick], pieces[quick], last, total, back)
        if long.any():
            slow = np.flatnonzero(long[owner])
            slow = slow[np.argsort(owner[slow], kind="stable")]
            for k in np.flatnonzero(long).tolist():
                mine = slow[np.searchsorted(owner[slow], k, "left") : np.searchsorted(owner[slow], k, "right")]
                self.relax_long(int(seg_first[k]), int(seg_last[k]), starts[mine], stops[mine], pieces[mine], last, total, back)
        on = np.zeros(n_nodes, dtype=bool)
        at = seg_last
        begin = seg_first
        while len(at):
            on[at] = True
            at = back[at]
            more = np.flatnonzero(at > begin)
            at, begin = at[more], begin[more]
        hits = np.flatnonzero(on)
        ids, before = last[hits], back[hits]
        # back to characters: a node's place among them, and each fallback as its bytes
        char = np.zeros(n_nodes, dtype=np.int64)
        char[node] = np.arange(n)
        char = char[before]
        c = codes[char]
        fallback = ids == self.n_ids
        many = np.where(fallback, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), 1)
        to = np.cumsum(many)
        flat = np.repeat(ids, many).astype("<i4")
        if fallback.any():
            k = np.arange(len(flat)) - np.repeat(to - many, many)
            m, x, is_byte = np.repeat(many, many), np.repeat(c, many), np.repeat(fallback, many)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[m] | (x >> (6 * (m - 1)))
            value = np.where(k == 0, lead, 0x80 | ((x >> (6 * np.maximum(m - 1 - k, 0))) & 0x3F))
            flat[is_byte] = self.byte_ids[value[is_byte]]
        sums = np.concatenate([[0], to])
        cuts = (sums[np.concatenate([np.searchsorted(char, first_of), [len(char)]])] * 4).tolist()
        data = flat.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def keys(self, text: str | None) -> list[str]:
        """Keys of the stretches of a normalised text; see ``_LITERAL``."""
        if not text:
            return []
        if ESCAPE in text:
            text = text.replace(ESCAPE, " ")
        if self.t.prefix:
            if "  " not in text and text[0] != " ":
                return text.split(" ")
            text = " " + text
        return [_LITERAL + x for x in _STRETCH.findall(text)]

    def _compose(self, keys: list[str]) -> list[bytes]:
        return self.paths([k[1:] if k[:1] == _LITERAL else " " + k for k in keys])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        return self.kept.folded(map(self.keys, texts), self._compose, b"".join)

    def encode(self, text: str | None) -> list[int]:
        import numpy as np

        return np.frombuffer(self.encode_all([text])[0], dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, runs of bytes read as UTF-8 (each bad byte as U+FFFD), escape signs as spaces, without the dummy prefix."""
        alone = self.alone
        if self.high.isdisjoint(ids):
            out = list(map(alone.__getitem__, ids))
        else:
            out, run, types, surface = [], bytearray(), self.t.types, self.t.surface
            for i in ids:
                if types[i] == _BYTE:
                    run.append(int(surface[i][3:5], 16))
                    out.append("")
                    continue
                if run:
                    out[-1] = run.decode("utf-8", "each-byte")
                    run = bytearray()
                out.append(alone[i])
            if run:
                out.append(run.decode("utf-8", "each-byte"))
        first = next((k for k, i in enumerate(ids) if self.t.types[i] != _CONTROL), None)
        if self.t.prefix and first is not None and self.t.types[ids[first]] == _NORMAL and out[first][:1] == " ":
            out[first] = out[first][1:]
        return "".join(out)


def _shared_encoder(rows: DataFrame, model_path: str):
    """A function that gives a task's worker its encoder; the compiled model, bounded by its vocabulary, goes out by broadcast."""
    bounded_batches(rows.sparkSession)
    shared, key = rows.sparkSession.sparkContext.broadcast(compile_model(model_path)), uuid.uuid4().hex
    return lambda: held("transducer", key, lambda: Encoder(shared.value))


def encoded(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text as an array. Null and empty texts have none; a column ``ids`` that is there is replaced."""
    encoder = _shared_encoder(docs, model_path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        import numpy as np

        e = encoder()
        ids = [np.frombuffer(x, dtype="<i4") for x in e.encode_all(texts.to_pylist())]
        ends = np.cumsum([0, *map(len, ids)]).astype("i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, dtype="<i4")])))

    return docs.withColumn(ids, encode(F.col(text)))


def decoded(rows: DataFrame, model_path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of each array of piece ids. A null array gives an empty text; a column ``to`` that is there is replaced."""
    encoder = _shared_encoder(rows, model_path)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        e = encoder()
        return pa.array((e.decode(x or []) for x in lists.to_pylist()), pa.string())

    return rows.withColumn(to, decode(F.col(ids)))


def encode_and_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_pieces, n_bytes_fallback, ids_sha256, n_chars_decoded, round_trip)`` for every row.

    ids_sha256 is over the ids as little-endian 32-bit numbers. round_trip: decoding
    gives back the text, with every escape sign in it as a space. Null texts count as
    empty: no pieces, and the digest of the empty string. Repeated rows give repeated
    results; other columns are not looked at.
    """
    encoder = _shared_encoder(docs, model_path)

    @F.arrow_udf("struct<n_pieces: long, n_bytes: long, ids_sha256: string, n_chars: long, same: boolean>")
    def work(texts: pa.Array) -> pa.Array:
        import hashlib

        import numpy as np

        e = encoder()
        is_byte = np.array(e.t.types) == _BYTE
        out = []
        texts = texts.to_pylist()
        for t, data in zip(texts, e.encode_all(texts), strict=True):
            ids = np.frombuffer(data, dtype="<i4")
            back = e.decode(ids.tolist())
            out.append({"n_pieces": len(ids), "n_bytes": int(is_byte[ids].sum()), "ids_sha256": hashlib.sha256(data).hexdigest(), "n_chars": len(back), "same": back == (t or "").replace(ESCAPE, " ")})
        return pa.array(out, pa.struct([("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("ids_sha256", pa.string()), ("n_chars", pa.int64()), ("same", pa.bool_())]))

    w = F.col("w")
    return docs.select("doc_id", work(F.col("text")).alias("w")).select("doc_id", w["n_pieces"].alias("n_pieces"), w["n_bytes"].alias("n_bytes_fallback"), w["ids_sha256"].alias("ids_sha256"), w["n_chars"].alias("n_chars_decoded"), w["same"].alias("round_trip"))
