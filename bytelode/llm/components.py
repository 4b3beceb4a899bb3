"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import discard, fresh_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` that is not its component's least.

    ``u`` and ``v`` are BIGINT; loops and repeated edges change nothing; an empty
    edge table gives an empty result. Each round is two grouped minima with joins
    (a hub's edges are split by the adaptive skew join, never gathered), and ends
    in a written table, so a lost executor costs one round at most. The edges form
    stars when a round leaves them as they were. A round's table goes when the next is written.
    """
    spark = edges.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str]:
        df.write.parquet(path := fresh_dir(spark, "edges"))
        return spark.read.schema("u long, v long").parquet(path), path

    (now, path), seen = write(edges.where("u <> v").select("u", "v")), None
    for _ in range(max_rounds):
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not print_of[0] or print_of == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = print_of
        old = path
        now, path = write(_small_star(_large_star(now)))
        discard(spark, old)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
