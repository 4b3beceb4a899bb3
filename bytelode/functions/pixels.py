"""Colour words, palettes and S3TC blocks."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelode.functions.binary import bit_range, byte_at, div, words_at


def widen(v: Column, bits: int) -> Column:
    """A channel of 1 to 8 bits to 8 by repeating its high bits; none is 0."""
    if bits == 8:
        return v
    if bits == 1:
        return v * 255
    return F.shiftleft(v, 8 - bits).bitwiseOR(F.shiftright(v, 2 * bits - 8) if 2 * bits >= 8 else F.shiftleft(v, 8 - 2 * bits))


def rgba(word: Column, fields: tuple[tuple[int, int], ...]) -> Column:
    """Red, green, blue and alpha from (start, width) fields; a field of no width is 255."""
    return F.array(*((widen(bit_range(word, s, w), w) if w else F.lit(255)).cast("int") for s, w in fields))


#: (start, width) of red, green, blue, alpha.
FIELDS = {
    "rgba5650": ((0, 5), (5, 6), (11, 5), (0, 0)),
    "rgba5551": ((0, 5), (5, 5), (10, 5), (15, 1)),
    "rgba4444": ((0, 4), (4, 4), (8, 4), (12, 4)),
    "rgb565": ((11, 5), (5, 6), (0, 5), (0, 0)),
}


def mip_extent(dimension: Column, level: Column) -> Column:
    return F.when(level >= 32, 1).otherwise(F.greatest(F.floor(dimension / F.pow(F.lit(2.0), level)), F.lit(1))).cast("int")


def expand_indices4(c: Column, count: Column) -> Column:
    """Palette indices of four bits, the low nibble first, cut to ``count``."""
    pairs = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("int"))
    return F.when(F.octet_length(c) == 0, F.array().cast("array<int>")).otherwise(F.slice(F.flatten(F.transform(pairs, lambda b: F.array(b.bitwiseAND(F.lit(15)), F.shiftright(b, 4)))), F.lit(1), count))


def expand_indices8(c: Column, count: Column) -> Column:
    """Palette indices of a byte each, cut to ``count``."""
    every = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("int"))
    return F.when(F.octet_length(c) == 0, F.array().cast("array<int>")).otherwise(F.slice(every, F.lit(1), count))


def palette_colours(indices: DataFrame, palettes: DataFrame, key: list[str]) -> DataFrame:
    """Indices looked up in palettes, in order: ``(*key, colours, failed_at)``.

    ``indices(*key, palette_id, indices)`` meet ``palettes(palette_id, index, colour)`` by palette; the
    first index that a palette lacks stops its row, whose colours are then NULL. A palette is
    gathered as a map, bounded by its index width.
    """
    maps = palettes.groupBy("palette_id").agg(F.map_from_entries(F.collect_list(F.struct("index", "colour"))).alias("colours"))
    met = indices.join(maps, "palette_id", "left")
    found = F.transform("indices", lambda i: F.element_at("colours", i))
    failed = F.array_position(F.transform(found, lambda x: x.isNull()), True) - 1
    met = met.withColumns({"found": found}).withColumn("failed", F.when(F.col("found").isNull(), F.lit(0).cast("long")).otherwise(F.when(F.exists("found", lambda x: x.isNull()), failed)))
    return met.select(*key, F.when(F.col("failed").isNull(), F.col("found")).alias("colours"), F.col("failed").alias("failed_at"))


def masked_texel(texel: Column, masks: tuple[int, int, int, int]) -> Column:
    """A texel's red, green, blue and alpha by contiguous masks; a channel without a mask is 0, alpha then 255."""
    out = []
    for k, mask in enumerate(masks):
        if not mask:
            out.append(F.lit(255 if k == 3 else 0))
            continue
        low = (mask & -mask).bit_length() - 1
        bits = (mask >> low).bit_length()
        v = F.shiftright(texel.bitwiseAND(F.lit(mask)), low)
        out.append(widen(v, bits).cast("int") if bits <= 8 else F.shiftright(v, bits - 8).cast("int"))
    return F.array(*out)


def masked_texels(c: Column, width: Column, height: Column, bits: int, masks: tuple[int, int, int, int]) -> Column:
    """Tight little-endian texels of 8, 16, 24 or 32 bits as RGBA arrays; NULL where the bytes do not cover the image."""
    if bits not in (8, 16, 24, 32):
        raise ValueError("texels are of 8, 16, 24 or 32 bits")
    count = width.cast("long") * height.cast("long")
    words = words_at(c, F.lit(0), count.cast("int"), bits // 8)
    return F.when(F.octet_length(c) >= count * (bits // 8), F.transform(words, lambda x: masked_texel(x, masks)))


def bit_rows(c: Column, width: Column, height: Column) -> Column:
    """Rows of one bit a pixel as an array of bytes, each of whole bytes; NULL unless the bytes are exactly theirs, or without width."""
    stride = div(width + 7, 8).cast("int")
    rows = F.when(height >= 1, F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.substring(c, y * stride + 1, stride))).otherwise(F.array().cast("array<binary>"))
    return F.when((stride > 0) & (F.octet_length(c).cast("long") == stride.cast("long") * height), rows)


def bit_pixel(rows: Column, width: Column, x: Column, y: Column) -> Column:
    """Whether a pixel of such rows is set, the high bit first; outside, it is not."""
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < F.size(rows))
    byte = byte_at(F.get(rows, y), div(x, 8))
    return F.coalesce(inside & (F.call_function("getbit", byte, (F.lit(7) - x % 8).cast("int")) == 1), F.lit(False))


def rgba_length(width: Column, height: Column, most: int) -> Column:
    """Bytes of an RGBA image; NULL without area, past BIGINT or over ``most``."""
    n = F.try_multiply(F.try_multiply(width.cast("long"), height.cast("long")), F.lit(4).cast("long"))
    return F.when((width > 0) & (height > 0) & (n <= most), n)


def pcm_frames(samples: Column, channels: Column, rate: Column) -> Column:
    """Frames of interleaved samples; NULL without channels or rate, or where the last frame is not whole."""
    return F.when((channels > 0) & (rate > 0) & (F.pmod(samples, channels) == 0), div(samples, channels))


def decode_blocks(kind: str):
    """An Arrow UDF from (blocks, width, height) to RGBA bytes; NULL where the bytes do not cover the image.

    ``dxt1`` has 8 bytes a block of 4x4 texels, ``dxt3`` and ``dxt5`` 16 with alpha first.
    All blocks of an image are worked out together; partial blocks at the edges are clipped.
    The images of an Arrow batch, of 4 to 8 times its bytes, are held together: where only a digest
    is wanted, ``block_digests`` holds one.
    """

    @F.arrow_udf("binary")
    def decode(data: pa.Array, widths: pa.Array, heights: pa.Array) -> pa.Array:
        return pa.array((texels(d.as_py(), w.as_py(), h.as_py(), kind) for d, w, h in zip(data, widths, heights, strict=True)), pa.binary())

    return decode


def block_digests(kind: str):
    """An Arrow UDF from (blocks, width, height) to the SHA-256 of ``decode_blocks``' bytes in hex.

    A worker holds one decoded image at a time, not those of a whole batch.
    """

    @F.arrow_udf("string")
    def digest(data: pa.Array, widths: pa.Array, heights: pa.Array) -> pa.Array:
        images = (texels(d.as_py(), w.as_py(), h.as_py(), kind) for d, w, h in zip(data, widths, heights, strict=True))
        return pa.array((None if x is None else hashlib.sha256(x).hexdigest() for x in images), pa.string())

    return digest


def texels(data: bytes | None, width: int | None, height: int | None, kind: str) -> bytes | None:
    import numpy as np

    size = 8 if kind == "dxt1" else 16
    if data is None or not width or not height or width < 0 or height < 0:
        return None
    across, down = -(-width // 4), -(-height // 4)
    if len(data) < across * down * size:
        return None
    b = np.frombuffer(data, dtype=np.uint8, count=across * down * size).reshape(-1, size)
    c = b[:, size - 8 :]
    ends = c[:, :4].copy().view("<u2").astype(np.int32)
    r, g, blue = ends >> 11, ends >> 5 & 63, ends & 31
    rgb = np.stack([r << 3 | r >> 2, g << 2 | g >> 4, blue << 3 | blue >> 2], axis=2)
    a, z = rgb[:, 0], rgb[:, 1]
    four = np.stack([a, z, (2 * a + z) // 3, (a + 2 * z) // 3], axis=1)
    alpha4 = np.full(four.shape[:2], 255, dtype=np.int32)
    if kind == "dxt1":
        three = ends[:, 0] <= ends[:, 1]
        four[three, 2], four[three, 3] = ((a + z) // 2)[three], 0
        alpha4[three, 3] = 0
    pick = (c[:, 4:].copy().view("<u4") >> np.arange(0, 32, 2, dtype=np.uint32)) & 3
    out = np.empty((len(b), 16, 4), dtype=np.uint8)
    out[:, :, :3] = np.take_along_axis(four, pick[:, :, None].astype(np.int64), axis=1)
    out[:, :, 3] = np.take_along_axis(alpha4, pick.astype(np.int64), axis=1)
    if kind == "dxt3":
        out[:, :, 3] = (b[:, :8].copy().view("<u8") >> np.arange(0, 64, 4, dtype=np.uint64) & np.uint64(15)) * 17
    elif kind == "dxt5":
        e = b[:, :2].astype(np.int32)
        steps = np.arange(1, 7)
        eight = np.concatenate([e, (e[:, :1] * (7 - steps) + e[:, 1:] * steps) // 7], axis=1)
        six = np.concatenate([e, (e[:, :1] * (5 - steps[:4]) + e[:, 1:] * steps[:4]) // 5, np.zeros((len(e), 1), int), np.full((len(e), 1), 255)], axis=1)
        table = np.where((e[:, 0] > e[:, 1])[:, None], eight, six)
        bits = np.concatenate([b[:, 2:8], np.zeros((len(b), 2), np.uint8)], axis=1).copy().view("<u8") >> np.arange(0, 48, 3, dtype=np.uint64) & np.uint64(7)
        out[:, :, 3] = np.take_along_axis(table, bits.astype(np.int64), axis=1)
    image = out.reshape(down, across, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(down * 4, across * 4, 4)
    return image[:height, :width].tobytes()
