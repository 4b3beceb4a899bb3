"""Toxicity by compression distance between a toxic and an ordinary zstandard dictionary.

Training, on a bounded sample of labelled documents:

1. one half gives the dictionaries, all trained by ``zstandard.train_dictionary``. A base is
   trained on windows of ordinary texts and on those of their words that these windows do not
   explain and toxic texts do not overuse. The toxic dictionary is trained on the words of toxic texts that the base does not
   explain (it compresses them badly), the ordinary one on such words of ordinary texts. Both
   hold the base, so ordinary windows compress alike under both, and a window with toxic
   matter is shorter under the toxic one;
2. the other half, unseen by the dictionaries, calibrates: it chooses between a
   few dictionaries, the thresholds on a window's length difference and the weights that turn the windows
   of a document into a score.

A window is ``window`` words in a row, compressed with a fixed trailer (zstandard finds no
match in the last bytes of a block, and stores blocks that hardly shrink).
"""

from __future__ import annotations

import math
import random
import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import bounded_batches, fresh_name, held

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_TRAILER = b"0123456789=~-abcxyz#0123456789;;QWERTZUIOP%%ASDFGHJKL"
#: Shares of ordinary windows that the thresholds let pass.
_TAILS = (0.05, 0.01, 0.002, 0.0005)


@dataclass
class ToxicityModel:
    """Two dictionaries, thresholds on the length difference of a window, and a logistic over a document's features."""

    ordinary: bytes = b""
    toxic: bytes = b""
    level: int = 6
    window: int = 6
    thresholds: list[int] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    def gains(self):
        """A function from a text's words to how much shorter each of its windows is under the toxic dictionary."""
        one, two, n = compressor(self.ordinary, self.level), compressor(self.toxic, self.level), self.window

        def gains(words: list[bytes]) -> list[int]:
            out = []
            for i in range(0, len(words), n):
                x = b" " + b" ".join(words[i : i + n]) + b" " + _TRAILER
                out.append(len(one(x)) - len(two(x)))
            return out

        return gains

    def features(self, gains: list[int]) -> list[float]:
        """The largest difference, and for each threshold how many windows reach it and what share of all."""
        over = [sum(g >= t for g in gains) for t in self.thresholds]
        most, n = max(gains, default=0), max(1, len(gains))
        return [float(max(-4, min(24, most))), *(math.log1p(x) for x in over), *(math.log1p(100 * x / n) for x in over)]

    def score(self, gains, text: str | None) -> float:
        if not self.weights:
            return 0.0
        return self.logistic(self.features(gains(split_words(text))))

    def logistic(self, x: list[float]) -> float:
        t = self.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(self.weights[1:], x, self.mean, self.scale, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, t))))


def compressor(dictionary: bytes, level: int):
    """A function that compresses bytes with a dictionary."""
    import zstandard as z

    params = z.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    # Trained dictionaries are used for their content: two that bring their own entropy tables would tell all windows apart.
    d = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=d, compression_params=params).compress


def split_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of about ``size`` bytes; of few samples, a smaller one, and of too few their own bytes."""
    import zstandard as z

    random.Random(7).shuffle(samples)
    size = min(size, sum(map(len, samples)) // 4)
    if size >= 256:
        try:
            return z.train_dictionary(size, samples, k=segment, d=8).as_bytes()
        except z.ZstdError:
            pass
    return b"".join(samples)[-max(size, 1) :]


def _overused(ordinary: list[list[bytes]], toxic: list[list[bytes]], ratio: float = 3.0) -> set[bytes]:
    """Words that toxic texts use more often than ordinary ones, by ``ratio`` and three times at least."""
    counts = [Counter(w for d in docs for w in d) for docs in (ordinary, toxic)]
    n = [sum(c.values()) for c in counts]
    return {w for w, c in counts[1].items() if c >= 3 and c * n[0] >= ratio * (counts[0][w] + 1) * n[1]}


def _unexplained(docs: list[list[bytes]], dictionary: bytes, level: int, excess: float) -> list[bytes]:
    """Samples of four words of 4 bytes or more, each of which a dictionary compresses to ``excess`` of its length or worse."""
    compress, bad = compressor(dictionary, level), {}
    none = len(compress(b" " + _TRAILER))
    found = []
    for words in docs:
        for w in words:
            if len(w) >= 4:
                if w not in bad:
                    bad[w] = len(compress(b" " + w + b" " + _TRAILER)) - none >= excess * len(w)
                if bad[w]:
                    found.append(b" " + w + b" ")
    random.Random(7).shuffle(found)
    return [b"".join(found[i : i + 4]) for i in range(0, len(found), 4)]


def _fit_logistic(x, y):
    import numpy as np

    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [0.3] * (a.shape[1] - 1))
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    loss = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
    return w.tolist(), mean.tolist(), scale.tolist(), float(loss)


def _thresholds(usual: list[int]) -> list[int]:
    """For each of ``_TAILS``, a length difference that no larger a share of ordinary windows reaches; they rise."""
    usual, out = sorted(usual), []
    for tail in _TAILS:
        t = usual[min(len(usual) - 1, int(len(usual) * (1 - tail)))] + 1 if usual else 1
        out.append(max(t, out[-1] + 1 if out else 1))
    return out


def train(rows: list[tuple[str, int]], base_bytes: int = 384 << 10, toxic_bytes: tuple[int, ...] = (4 << 10, 12 << 10), level: int = 6, window: int = 6, excess: float = 0.6) -> ToxicityModel:
    """A model from (text, label) rows; without rows of both labels in each half, one that gives every text 0.

    ``base_bytes`` bounds each of the base's two parts, ``toxic_bytes`` are sizes of the
    toxic dictionary, and ``excess`` is the share of its length from which a compressed word
    is unexplained. Windows of the base with and without overused words are tried with each
    size, and what loses least on the calibrating half is taken.
    """
    import numpy as np

    docs = [(split_words(t), int(y)) for t, y in rows]
    halves = [[d for k, d in enumerate(x[0] for x in docs if x[1] == y) if k % 2 == half] for half in (0, 1) for y in (0, 1)]
    ordinary, toxic, *check = halves
    if not all(halves):
        return ToxicityModel()
    overused = _overused(ordinary, toxic)
    common = [[w for w in d if w not in overused] for d in ordinary]
    y = np.array([0.0] * len(check[0]) + [1.0] * len(check[1]))
    best, least = ToxicityModel(), math.inf
    for texts in (ordinary, common):
        passages = [b" " + b" ".join(w[i : i + 16]) + b" " for w in texts for i in range(0, len(w), 16)]
        random.Random(7).shuffle(passages)
        enough, size = 0, 0
        while enough < len(passages) and size < 12 * base_bytes:
            size += len(passages[enough])
            enough += 1
        windows = _trained(passages[:enough], base_bytes, 64)
        base = _trained(_unexplained(common, _TRAILER + windows, level, excess), base_bytes, 24) + _TRAILER + windows
        left = [_unexplained(x, base, level, excess) for x in (common, toxic)]
        for n in toxic_bytes if left[1] else ():
            parts = [_trained(list(x), n, 24) for x in left]
            width = max(map(len, parts))  # both of one length, so that the base is as far away
            model = ToxicityModel(parts[0].rjust(width, b"#") + base, parts[1].rjust(width, b"#") + base, level, window)
            gains = model.gains()
            found = [gains(w) for of in check for w in of]
            model.thresholds = _thresholds([g for of in found[: len(check[0])] for g in of])
            model.weights, model.mean, model.scale, loss = _fit_logistic(np.array([model.features(g) for g in found]), y)
            if loss < least - 1e-9:
                best, least = model, loss
    return best


def train_on(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_chars: int = 20_000) -> ToxicityModel:
    """Fit on labelled documents: of each label ``max_rows`` at most, by the hash of their ids, none of over ``max_chars``.

    ``labels`` has doc_id and toxic (0 or 1; null rows are left out, of repeated ids the
    largest label counts). The rows drawn are light, and their texts (bounded by the two
    parameters) come to the driver. Texts that are scored have no such bounds.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    light = docs.where("text is not null").where(F.length("text") <= max_chars).select("doc_id").distinct().join(known, "doc_id")
    draw = [light.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    drawn = F.broadcast(draw[0].union(draw[1]))
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").where("text is not null").where(F.length("text") <= max_chars).select("doc_id", "text", "y").collect()
    return train([(r.text, r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))])


def _scorer(model: Broadcast):
    key = uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        gain = held("toxicity", key, model.value.gains) if model.value.weights else None
        return pa.array((model.value.score(gain, t) for t in texts.to_pylist()), pa.float64())

    return score


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in column ``to``; a column of that name is replaced.

    Every window of the whole text counts. Null, empty and wordless texts have no
    window and get the score of a text of which no window reaches a threshold. Repeated
    rows get equal scores; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn(to, _scorer(docs.sparkSession.sparkContext.broadcast(model))(F.col(text)))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay as they are.

    Rows are judged by their text alone, so null and empty texts are all kept or (by no
    usual model) all dropped, and rows that repeat are judged alike. An empty table stays empty.
    """
    to = fresh_name(docs, "toxic_score")
    return score(docs, model, to=to).where(F.col(to) < threshold).drop(to)
