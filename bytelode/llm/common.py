"""What the operators of this subpackage share: tables, the shared folder, file access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytelode.sources.scratch import fresh_dir, shared_dir, written  # noqa: F401  (the operators take them from here)

_HELD: dict = {}
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one that nothing reads any more."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Bound what one Arrow batch holds, so that long texts do not fill a worker.

    Only Spark's default of 10,000 rows is lowered; a value the user chose stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is not None and int(now.rstrip("bB")) > megabytes << 20:
        spark.conf.set(key, str(megabytes << 20))


def read_tasks(spark: SparkSession, n_bytes: int) -> int:
    """Tasks for reading so many bytes of payload: 64 MB each, but no fewer than the cluster runs at once unless they are under 1 MB."""
    return max(1, -(-n_bytes // (64 << 20)), min(spark.sparkContext.defaultParallelism, -(-n_bytes // (1 << 20))))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def open_fs(uri: str):
    """(file system, path) of a folder named by URI or absolute path.

    Spark's names of an object store are those of its Hadoop connectors; credentials come
    from the environment or the machine's role.
    """
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


def arrow_uri(uri: str) -> str:
    """A URI that Spark writes to as the file systems of Arrow name it."""
    scheme, colon, rest = uri.partition("://")
    return _SCHEMES.get(scheme, scheme) + colon + rest


def held(kind: str, key: str, make):
    """What ``make`` builds, once for each key in a Python worker; of a kind only the last key's is kept."""
    if kind not in _HELD or _HELD[kind][0] != key:
        _HELD.pop(kind, None)
        _HELD[kind] = key, make()
    return _HELD[kind][1]


class Kept:
    """What was worked out for keys, for the keys of later texts: two generations, bounded in bytes.

    The older generation goes when the newer has grown to ``max_bytes``; keys of over
    ``longest`` characters are worked out each time and not kept.
    """

    OVERHEAD = 180

    def __init__(self, max_bytes: int = 64 << 20, longest: int = 256):
        self.max_bytes, self.longest = max_bytes, longest
        self.new: dict = {}
        self.old: dict = {}
        self.size = 0

    def learn(self, keys: set[str], make) -> list[str]:
        """Have all ``keys`` in ``new``; ``make`` works out those missing. Returns the long ones, to be dropped after use."""
        if self.size >= self.max_bytes:
            self.old, self.new, self.size = self.new, {}, 0
        new, old = self.new, self.old
        away = keys.difference(new)
        back = [k for k in away if k in old]
        new.update(zip(back, map(old.__getitem__, back), strict=True))
        missing = [k for k in away if k not in old] if back else list(away)
        if missing:
            new.update(zip(missing, make(missing), strict=True))
        long = [k for k in missing if len(k) > self.longest]
        self.size += sum(map(len, back)) + sum(map(len, missing)) - sum(map(len, long)) + self.OVERHEAD * len(away)
        return long

    def folded(self, lists, make, fold, segment: int = 1 << 18) -> list:
        """For each list of keys, ``fold`` of their values. Lists are taken together up to ``segment`` keys, longer ones in parts."""
        out, waiting, n = [], [], 0

        def flush() -> None:
            long = self.learn(set().union(*waiting), make)
            out.extend(fold(map(self.new.__getitem__, keys)) for keys in waiting)
            for k in long:
                del self.new[k]
            waiting.clear()

        for keys in lists:
            if waiting and n + len(keys) > segment:
                flush()
                n = 0
            if len(keys) <= segment:
                waiting.append(keys)
                n += len(keys)
                continue
            before = len(out)
            for at in range(0, len(keys), segment):
                waiting.append(keys[at : at + segment])
                flush()
            out[before:] = [fold(out[before:])]
        if waiting:
            flush()
        return out
