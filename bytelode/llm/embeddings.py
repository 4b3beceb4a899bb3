"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept of each group."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.llm.common import bounded_batches, written
from bytelode.llm.components import connected_components

#: Vectors of a block; a group that comes to one task has two blocks at most.
BLOCK = 4096
#: Vectors of a label in a cell, about.
CELL = 1024
#: Rows of a block whose products are held at once.
_SLAB = 512
#: Numbers of the sample that centroids are fitted to.
_SAMPLE_VALUES = 16 << 20


def unit_rows(lists):
    """Vectors (an Arrow list array or lists, of one length, without nulls) as rows of length 1 in double precision."""
    import numpy as np

    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if isinstance(lists, pa.Array):
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    else:
        x = np.array(lists, dtype=np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # first, so that no square is too small or large
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x, k: int, rounds: int = 12, seed: int = 7):
    """``k`` unit centroids of unit rows; fewer if there are fewer rows."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            s = x[own == j].sum(0)
            n = np.linalg.norm(s)
            if n > 1e-12:
                c[j] = s / n
    return np.unique(c, axis=0)


def _grow(pairs, rows: int, cols: int):
    """Least member of each bipartite component of a boolean matrix, for rows and for columns."""
    import numpy as np

    none = rows + cols
    left, right = np.arange(rows, dtype=np.int32), np.full(cols, none, dtype=np.int32)
    while True:
        new_left, new_right = left.copy(), np.full(cols, none, dtype=np.int32)
        for k in range(0, rows, _SLAB):
            part = slice(k, k + _SLAB)
            np.minimum(new_right, np.where(pairs[part], left[part, None], none).min(0, initial=none), out=new_right)
        for k in range(0, rows, _SLAB):
            part = slice(k, k + _SLAB)
            new_left[part] = np.minimum(left[part], np.where(pairs[part], new_right[None, :], none).min(1, initial=none))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def near_vectors(embeddings: DataFrame, threshold: float = 0.98, cells: int | None = None, margin: float | None = None, sample: int = 20_000, block: int = BLOCK, sigmas: float = 4.5) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``embeddings(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null and their cosine, in double
    precision, is ``threshold`` or more. n_links counts the other rows linked directly,
    component_id is the least vec_id reachable, kept that it is one's own. Vectors that
    are null, empty or zero, or that hold null or non-finite components, and those of a
    length that no other of their label has, link with nothing. Rows that repeat a vec_id
    are rows of their own; null vec_ids are never a component's least unless alone.

    Equal vectors of a label are one class first. Centroids are fitted to a bounded
    sample of the classes (``sample`` rows, fewer of very long vectors); there are as many
    as leave a label about a thousand vectors a cell, so they grow with the table, to a
    sixteenth of the sample at most. Every class has the cell of its nearest centroid for
    home and is a guest wherever it lies within ``margin`` of the plane between the two
    centroids. With the chord of the threshold's angle for margin no pair is lost, as a
    vector nearer to its own centroid than that cannot reach one of the other cell; but
    spread-out vectors then visit a good part of all cells. The default is the smaller of
    that chord and ``sigmas`` standard deviations of how far a step of the chord in a random
    direction of the space leads towards a plane (the chord over the root of the dimension):
    links whose difference has no direction are then lost with a chance of a few in a
    million, at any size of the table. Each class counts its links in its home cell. Cells of
    a label are cut into blocks of about ``block`` rows, and tasks get pairs of blocks: no
    label, cell or group of near copies comes whole to one, and a task returns a count and a
    root for each row, never pairs.
    """
    import numpy as np

    spark = embeddings.sparkSession
    bounded_batches(spark)
    sc = spark.sparkContext
    e = F.col("embedding")
    finite = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    valid = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0)
    rows = embeddings.select("vec_id", "label", "embedding")
    classes = written(rows.where(valid).groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    by_label = classes.groupBy("label", F.size("embedding").alias("d")).count()
    most = {r["d"]: r["n"] for r in by_label.groupBy("d").agg(F.max("count").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    sample = max(1, min(sample, _SAMPLE_VALUES // max(most, default=1)))
    drawn = [r[0] for r in classes.orderBy(F.xxhash64("embedding"), "cid").limit(sample).select("embedding").collect()]
    chord = math.sqrt(max(0.0, 2 - 2 * threshold))
    centroids = {}
    for d in {len(x) for x in drawn}:
        x = unit_rows([v for v in drawn if len(v) == d])
        c = spherical_kmeans(x, cells or max(1, min(most.get(d, 1) // CELL, len(x) // 16)))
        apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
        centroids[d] = c, apart, min(chord, sigmas * chord / math.sqrt(d)) if margin is None else margin
    shared = sc.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            label, vectors, cid, n = (batch.column(k) for k in range(4))
            length = np.array(vectors.value_lengths().to_pylist(), dtype=np.int64)
            out: list[list] = [[], [], []]
            for d in np.unique(length).tolist():
                at = np.flatnonzero(length == d)
                fitted = shared.value.get(d)
                if fitted is None:  # of a length that the sample lacks: one cell
                    out = [a + [b] for a, b in zip(out, [at, np.zeros(len(at), dtype=np.int64), np.ones(len(at), dtype=bool)], strict=True)]
                    continue
                c, apart, near = fitted
                x = unit_rows(vectors.take(pa.array(at)))
                for k in range(0, len(at), _SLAB):
                    dots = x[k : k + _SLAB] @ c.T
                    home = dots.argmax(1)
                    away = (dots.max(1, keepdims=True) - dots) / np.maximum(apart[home], 1e-300)
                    away[np.arange(len(home)), home] = 0
                    i, j = np.nonzero(away <= near + 1e-9)
                    out = [a + [b] for a, b in zip(out, [at[k + i], j, home[i] == j], strict=True)]
            rows, cell, is_home = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)
            for k in range(0, len(rows), 4096):
                take = pa.array(rows[k : k + 4096], pa.int64())
                yield pa.RecordBatch.from_arrays([label.take(take), pa.array(cell[k : k + 4096], pa.int32()), pa.array(is_home[k : k + 4096], pa.bool_()), cid.take(take), n.take(take), vectors.take(take)], names=["label", "cell", "home", "cid", "n", "embedding"])

    label_type = classes.schema["label"].dataType.simpleString()
    vector_type = classes.schema["embedding"].dataType.simpleString()
    placed = classes.select("label", "embedding", "cid", "n").mapInArrow(assign, f"label {label_type}, cell int, home boolean, cid long, n long, embedding {vector_type}")
    placed = written(placed.withColumn("length", F.size("embedding")), "vector-cells")
    of_cell = ["label", "length", "cell"]
    sizes = placed.groupBy(*of_cell).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cut = placed.join(sizes, of_cell).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    as_home = cut.where("home").withColumn("other", others).select(*of_cell, F.col("own").alias("b1"), F.col("other").alias("b2"), F.lit(True).alias("asks"), "cid", "n", "embedding")
    as_any = cut.withColumn("other", others).select(*of_cell, F.col("other").alias("b1"), F.col("own").alias("b2"), F.lit(False).alias("asks"), "cid", "n", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy().astype(bool)
        cid, n = table.column("cid").to_numpy(), table.column("n").to_numpy()
        x = unit_rows(table.column("embedding")) if len(asks) else np.zeros((0, 1))
        ours, theirs = x[asks], x[~asks].T
        near = np.zeros((len(ours), theirs.shape[1]), dtype=bool)
        for k in range(0, len(ours), _SLAB):
            near[k : k + _SLAB] = ours[k : k + _SLAB] @ theirs >= threshold
        counts = np.concatenate([near[k : k + _SLAB] @ n[~asks] for k in range(0, len(ours), _SLAB)] or [np.zeros(0, dtype=np.int64)])
        left, right = _grow(near, int(asks.sum()), int((~asks).sum()))
        homes, members = cid[asks], cid[~asks]
        ok = counts > 0
        seen = right < len(homes)
        node = np.concatenate([homes[ok], members[seen]])
        root = np.concatenate([homes[left[ok]], homes[right[seen]]])
        links = np.concatenate([counts[ok], np.zeros(int(seen.sum()), dtype=np.int64)])
        keep = (links > 0) | (node != root)
        return pa.table({"node": node[keep], "root": root[keep], "links": links[keep].astype(np.int64)})

    found = as_home.unionByName(as_any).groupBy(*of_cell, "b1", "b2").applyInArrow(compare, "node long, root long, links long")
    found = written(found, "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "cid")
    roots = connected_components(found.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")).distinct())
    joined = classes.join(counts, "cid", "left").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
    joined = joined.select("label", "embedding", "cid", "n", "first_id", F.coalesce("links", F.col("n")).alias("links"), F.coalesce("root", "cid").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("least"))
    of_class = joined.join(least, "root").select(F.col("label").alias("l"), F.col("embedding").alias("v"), (F.col("links") - 1).alias("links"), "least")
    back = rows.join(of_class, (F.col("label") == F.col("l")) & (e == F.col("v")), "left")
    component = F.coalesce("least", "vec_id")
    return back.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
