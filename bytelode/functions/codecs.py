"""Checksums and bounded decoders as Arrow UDFs.

A decoder gives NULL for malformed input and for output over its limit; it never
gives part of an output.
"""

from __future__ import annotations

import lzma
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

LIMIT = 256 << 20


def _table(step) -> list[int]:
    out = []
    for k in range(256):
        for _ in range(8):
            k = step(k)
        out.append(k)
    return out


def crc32_mpeg2(data: bytes) -> int:
    """Polynomial 04C11DB7, not reflected, all ones first, no final change: what zlib's CRC of the bit-reversed bytes says, reversed."""
    turned = zlib.crc32(data.translate(_TURN)) ^ 0xFFFFFFFF
    return int(f"{turned:032b}"[::-1], 2)


_TURN = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))
_CRC16 = _table(lambda k: k >> 1 ^ 0xA001 * (k & 1))


def crc16_ibm(data: bytes) -> int:
    """Reflected polynomial A001, zero first."""
    c = 0
    for b in data:
        c = c >> 8 ^ _CRC16[(c ^ b) & 255]
    return c


def inflate(data: bytes, wbits: int, limit: int = LIMIT) -> tuple[bytes, int] | None:
    """(output, bytes consumed) of one whole stream: raw (-15), zlib (15) or one gzip member (31)."""
    d = zlib.decompressobj(wbits)
    try:
        out = d.decompress(data, limit + 1)
    except zlib.error:
        return None
    return (out, len(data) - len(d.unused_data)) if d.eof and len(out) <= limit else None


def lzma_alone(data: bytes, limit: int = LIMIT) -> bytes | None:
    if len(data) < 13:
        return None
    declared = int.from_bytes(data[5:13], "little")
    if declared != (1 << 64) - 1 and declared > limit:
        return None
    d = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
    try:
        out = d.decompress(data, limit + 1)
    except lzma.LZMAError:
        return None
    if len(out) > limit or d.unused_data or declared != (1 << 64) - 1 and len(out) != declared:
        return None
    return out if d.eof or declared == len(out) else None


def zlib_stored(data: bytes) -> bytes:
    """A zlib stream of stored blocks of up to 65,535 bytes."""
    out, parts = [b"\x78\x01"], [data[i : i + 65535] for i in range(0, len(data), 65535)] or [b""]
    for k, p in enumerate(parts):
        out.append(bytes([k == len(parts) - 1]) + len(p).to_bytes(2, "little") + (len(p) ^ 0xFFFF).to_bytes(2, "little") + p)
    return b"".join(out) + zlib.adler32(data).to_bytes(4, "big")


#: The ring of this LZSS family: size, where writing starts, and the shortest and longest match.
RING, FIRST, SHORTEST, LONGEST = 4096, 4078, 3, 18


def lzss_decode(data: bytes, size: int, msb: bool = False, fill: int = 0, strict: bool = False, limit: int = LIMIT) -> bytes | None:
    """Exactly ``size`` bytes; NULL if the input ends before. ``strict`` refuses a last match that runs over, else it is cut."""
    if size > limit:
        return None
    runs = _RUNS[msb]
    out, at, end = bytearray([fill]) * RING, 0, len(data)  # the ring as it was, then what is decoded
    whole, size = RING, size + RING
    while whole < size:
        if at >= end:
            return None
        flags, at = data[at], at + 1
        ample = at + 16 <= end and whole + 8 * LONGEST <= size  # nothing can end within these eight
        for literals in runs[flags]:
            if literals:
                if not ample:
                    literals = min(literals, size - whole)
                    if at + literals > end:
                        return None
                out += data[at : at + literals]
                at, whole = at + literals, whole + literals
            else:
                if not ample and at + 2 > end:
                    return None
                high = data[at + 1]
                n = (high & 15) + SHORTEST
                if strict and not ample and whole + n > size:
                    return None
                back = (FIRST + whole - (data[at] | (high & 0xF0) << 4) - 1) % RING + 1  # how far behind the write position
                at += 2
                src = whole - back
                if back >= n:
                    out += out[src : src + n]
                else:
                    out += (out[src:] * (n // back + 1))[:n]
                whole += n
            if whole >= size:
                break
    return bytes(out[RING:size])


def _runs(msb: bool) -> list[tuple[int, ...]]:
    """For each flag byte its literals in runs, with 0 for a match."""
    out = []
    for flags in range(256):
        runs: list[int] = []
        for k in range(8):
            literal = flags >> (7 - k if msb else k) & 1
            if literal and runs and runs[-1]:
                runs[-1] += 1
            else:
                runs.append(literal)
        out.append(tuple(runs))
    return out


_RUNS = (_runs(False), _runs(True))

#: Earlier places with the same three bytes that the encoder compares, the nearest first.
TRIES = 16


def _earlier(b):
    """For each place but the last two the nearest one before it with the same three bytes, else -1."""
    import numpy as np

    keys = b[:-2].astype(np.uint32) << 16 | b[1:-1].astype(np.uint32) << 8 | b[2:]
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # 16 bits and 8: sorted by radix
    order = order[np.argsort((keys >> 16).astype(np.uint8)[order], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    found = np.full(len(keys), -1, dtype=np.int64)
    found[order[1:][same]] = order[:-1][same]
    return found


def lzss_encode(data: bytes, msb: bool = False) -> bytes:
    """A greedy encoder of the same family, finding matches by their first three bytes. Its output decodes to the input; other encoders may choose other matches."""
    return _lzss_together([data], msb)[0]


def lzss_encode_all(values, msb: bool = False, segment: int = 1 << 18):
    """``lzss_encode`` of each value, worked out together up to ``segment`` bytes."""
    waiting, n = [], 0
    for data in values:
        if waiting and n + len(data) > segment:
            yield from _lzss_together(waiting, msb)
            waiting, n = [], 0
        waiting.append(data)
        n += len(data)
    yield from _lzss_together(waiting, msb)


def _lzss_together(values: list[bytes], msb: bool) -> list[bytes]:
    import numpy as np

    sizes = np.array([len(v) for v in values], dtype=np.int64)
    n = int(sizes.sum())
    if not n:
        return [b""] * len(values)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    b = np.frombuffer(b"".join(values) + bytes(LONGEST), dtype=np.uint8)
    places = np.arange(n)
    limit = np.minimum(LONGEST, np.repeat(ends, sizes) - places)
    begin = np.repeat(starts, sizes)
    low = np.maximum(begin, places - (RING - LONGEST))
    earlier = _earlier(b)
    ahead = np.lib.stride_tricks.sliding_window_view(b, LONGEST)
    best, where = np.full(n, SHORTEST - 1), np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(limit >= SHORTEST)
    p = earlier[at]
    for _ in range(TRIES):
        near = p >= low[at]
        at, p = at[near], p[near]
        if not len(at):
            break
        so_far = best[at]
        longer = b[p + so_far] == b[at + so_far]
        here, there = at[longer], p[longer]
        equal = ahead[here] == ahead[there]
        length = np.minimum(np.where(equal.all(axis=1), LONGEST, equal.argmin(axis=1)), limit[here])
        better = length > best[here]
        best[here[better]], where[here[better]] = length[better], there[better]
        on = best[at] < limit[at]
        at, p = at[on], earlier[p[on]]
    steps, tokens, k = np.where(best >= SHORTEST, best, 1).tolist(), [], 0
    while k < n:
        tokens.append(k)
        k += steps[k]
    token = np.array(tokens)
    match = best[token] >= SHORTEST
    firsts = np.searchsorted(token, np.append(starts, n))  # each value's first token
    nth = (np.arange(len(token)) - np.repeat(firsts[:-1], np.diff(firsts))) % 8
    after = np.cumsum(1 + match + (nth == 0))
    unit = after - 1 - match
    out = np.zeros(int(after[-1]), dtype=np.uint8)
    out[unit[~match]] = b[token[~match]]
    matched = token[match]
    ring = (FIRST + where[matched] - begin[matched]) % RING
    out[unit[match]] = ring & 255
    out[unit[match] + 1] = ring >> 4 & 0xF0 | best[matched] - SHORTEST
    groups = np.flatnonzero(nth == 0)
    out[unit[groups] - 1] = np.add.reduceat(np.where(match, 0, 1 << (7 - nth if msb else nth)), groups)
    whole, cuts = out.tobytes(), np.append(0, after)[firsts].tolist()
    return [whole[x:y] for x, y in zip(cuts, cuts[1:])]


def bytes_udf(work, returns: str = "binary", together: bool = False):
    """A row function of one binary value, as an Arrow UDF; NULL stays NULL. ``together``: the function takes an iterable and gives one."""
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    @F.arrow_udf(returns)
    def apply(values: pa.Array) -> pa.Array:
        if together:
            done = iter(work(v.as_py() for v in values if v.is_valid))
            return pa.array((next(done) if v.is_valid else None for v in values), kinds[returns])
        return pa.array((work(v.as_py()) if v.is_valid else None for v in values), kinds[returns])

    return apply
