"""Embedding near-duplicates by cosine: spherical k-means cells, blocked products within.

Every vector lives in the cell of its nearest centre. A partner within the angle can live
in another cell only if this vector is near the border: for a partner y nearer to c than
to this vector's own centre a, cos(x, y) >= t implies x.(a - c) <= sqrt(1 - t^2) |a - c|.
And it can only live in a cell whose radius and that angle together reach this vector.
A vector visits every later cell for which both hold, so each linked pair meets exactly
once, in the later of its two cells. Cells are cut into blocks and a block's visitors into
chunks, as many as its visitors need, so a cell that holds a third of all vectors is many
bounded tasks, and a block is sent only where visitors come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest, materialize, mix64, scratch
from .components import connected_components

#: rows that the centres are fitted on; cells at most; rounds
SAMPLE, CELLS, ROUNDS = 16_384, 2048, 8
#: rows of a block, of a chunk of visitors, of a product; rows dealt at once
BLOCK, CHUNK, TILE, STEP = 8192, 16_384, 1024, 2048


def centres(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on a bounded sample of unit vectors; the same rows give the same centres."""
    if not len(x):
        return np.zeros((0, 0))
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def _unit(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<f8").reshape(len(cells), -1)


def units(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit binary): float64 unit vectors; null for vectors that link with nothing:
    null, zero, empty, or holding null or non-finite components."""

    def unit(x: np.ndarray) -> bytes | None:
        size = np.abs(x).max(initial=0) if np.isfinite(x).all() else 0.0
        if not size > 0:
            return None
        x = x / size  # no under- or overflow in the squares
        return (x / np.sqrt((x * x).sum())).astype("<f8").tobytes()

    def run(batches):
        for b in batches:
            vectors = b.column(1)
            x = pc.fill_null(vectors.flatten(), np.nan).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))]).astype(int).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unit(x[i:j]) for i, j in zip(ends, ends[1:])], pa.binary())], names=["id", "unit"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, unit binary")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row: other vectors with cosine at least
    ``threshold``, the least id reachable by links, and whether that is its own.

    Equal vectors meet as one before cells are made and count as often as they occur.
    Vectors of different lengths never link. Null ids are left out of components' names and
    keep nothing. Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    with scratch(spark) as made:
        rows = made.keep(units(df, id_col, vector_col), "units")
        groups = rows.where("unit is not null").groupBy("unit").agg(F.min("id").alias("low"), F.count("*").alias("times"))
        groups, _ = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")
        widths = [r[0] for r in groups.select(F.octet_length("unit")).distinct().collect()]
        links = None
        for width in widths:  # one for each length of vector in the table
            got = _links(groups.where(F.octet_length("unit") == width), threshold)
            links = got if links is None else links.unionByName(got)
        if links is None:
            links = spark.createDataFrame([], "node long, links long, root long")
        links, _ = materialize(links, "links")
        roots = connected_components(links.where("node <> root"), "node", "root").withColumnRenamed("root", "top")
        counts = links.groupBy("node").agg(F.sum("links").alias("links"))
        g = groups.join(counts, "node", "left").join(roots, "node", "left").withColumn("top", F.coalesce("top", "node"))
        least = g.groupBy("top").agg(F.min("low").alias("component"))
        g = made.keep(g.join(least, "top").select("unit", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), "component"), "classes")
    alone = rows.where("unit is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    out = rows.join(g, "unit").select("id", "n", "component").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def _links(groups: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): a node's links to others, by tasks, and one it is connected to."""
    n = groups.count()
    k = max(1, min(CELLS, SAMPLE // 8, -(-n // BLOCK)))
    # fitted on at most SAMPLE rows, 8 a cell; only where pairs meet depends on it, never which
    sample = groups.orderBy(F.xxhash64("unit")).limit(min(SAMPLE, max(2048, 8 * k))).select("unit").collect()
    c = centres(_unit([bytes(r.unit) for r in sample]), k)
    k = len(c)
    reach = np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
    angle = np.arccos(np.clip(threshold, -1, 1)) + 1e-7

    def border(x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """For each vector and cell, could a partner that is nearest to that cell live there?"""
        if threshold <= 0:
            return np.ones((len(x), k), bool)
        gaps = np.sqrt(np.maximum(0, 2 - 2 * (c[near] @ c.T)))
        dots = x @ c.T
        return dots[np.arange(len(x)), near][:, None] - dots <= reach * gaps + 1e-9

    def home(batches):
        for b in batches:
            dots = _unit(b.column("unit").to_pylist()) @ c.T if b.num_rows else np.zeros((0, k))
            near = dots.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("unit"), b.column("times"), pa.array(near, pa.int32()), pa.array(dots[np.arange(len(near)), near])], names=["node", "unit", "times", "cell", "dot"])

    homes, _ = materialize(groups.select("node", "unit", "times").mapInArrow(home, "node long, unit binary, times long, cell int, dot double"), "homes")
    sizes, radius = np.zeros(k, np.int64), np.zeros(k)
    for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.min("dot").alias("dot")).collect():  # k rows at most
        sizes[r.cell], radius[r.cell] = r.n, np.arccos(np.clip(r.dot, -1, 1))
    blocks = np.maximum(1, -(-sizes // BLOCK))
    # a vector at an angle beyond a cell's radius and the partners' angle has no partner there
    least = np.where(radius + angle < np.pi, np.cos(np.minimum(np.pi, radius + angle)), -2.0) - 1e-9

    def visits(x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of each later cell that a row visits."""
        return np.nonzero(border(x, near) & (x @ c.T >= least) & (near[:, None] < np.arange(k)) & (sizes > 0))

    def count(batches):
        total = np.zeros(k, np.int64)
        for b in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            total += np.bincount(visits(_unit(b.column("unit").to_pylist()), b.column("cell").to_numpy())[1], minlength=k)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["cell", "n"])

    come = np.zeros(k, np.int64)
    for r in homes.select("unit", "cell").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        come[r.cell] = r.n
    # the members of earlier blocks visit a cell's later ones
    chunks = np.maximum(1, -(-(come + (blocks - 1) * BLOCK) // CHUNK))

    def deal(batches):
        for b in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            node, near = b.column("node").to_numpy(), b.column("cell").to_numpy()
            # mixed, for numbers of one partition follow each other
            mixed = mix64(node.astype(np.uint64))
            own, slot = (mixed % blocks[near].astype(np.uint64)).astype(np.int64), (mixed >> np.uint64(32)).astype(np.int64)

            def times(row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Each row n times, numbered from 0."""
                total = np.cumsum(n)
                return np.repeat(row, n), np.arange(total[-1] if len(n) else 0) - np.repeat(total - n, n)

            every = np.arange(len(node))
            home_row, home_chunk = times(every, chunks[near])
            row, cell = visits(_unit(b.column("unit").to_pylist()), near)
            at, block = times(np.arange(len(row)), blocks[cell])
            row, cell = row[at], cell[at]
            later, step = times(every, blocks[near] - 1 - own)
            row, cell, block = np.concatenate([row, later]), np.concatenate([cell, near[later]]), np.concatenate([block, own[later] + 1 + step])
            take = np.concatenate([home_row, row])
            cols = [
                np.concatenate([near[home_row], cell]).astype(np.int32), np.concatenate([own[home_row], block]).astype(np.int32),
                np.concatenate([home_chunk, slot[row] % chunks[cell]]).astype(np.int32), np.arange(len(take)) >= len(home_row),
            ]
            for i in range(0, len(take), 4 * STEP):
                some = pa.array(take[i : i + 4 * STEP])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[i : i + 4 * STEP]) for x in cols), *(b.column(x).take(some) for x in ("node", "unit", "times"))], names=["cell", "block", "chunk", "visitor", "node", "unit", "times"]
                )

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # in the order of the nodes, so that a lost task's second run finds the same trees
        table = table.sort_by("node")
        visitor = np.array(table.column("visitor").to_pylist(), bool)
        node, times = table.column("node").to_numpy(), table.column("times").to_numpy()
        x = _unit(table.column("unit").to_pylist())
        h, v = np.flatnonzero(~visitor), np.flatnonzero(visitor)
        links = np.zeros(len(node), np.int64)
        us, vs = [], []

        def tile(a, b, upper):
            near = x[a] @ x[b].T >= threshold
            if upper:
                near = np.triu(near, 1)
            if near.any():
                links[a] += near @ times[b]
                links[b] += near.T @ times[a]
                # each tile gives a forest: its rows' first partners, and its columns' first partners
                i, j = np.nonzero(near)
                us.append(a[i])
                vs.append(b[j])

        for s in range(0, len(h), TILE):
            a = h[s : s + TILE]
            for t in range(0, len(v), TILE):
                tile(a, v[t : t + TILE], False)
            if key[2].as_py() == 0:
                for t in range(s, len(h), TILE):
                    tile(a, h[t : t + TILE], t == s)
            if sum(map(len, us)) > 1 << 20:
                shrink(us, vs, len(node))
        root = forest(np.concatenate(us), np.concatenate(vs), len(node)) if us else np.arange(len(node))
        ok = links > 0
        return pa.table({"node": node[ok], "links": links[ok], "root": node[root[ok]]})

    def shrink(us, vs, size):
        root = forest(np.concatenate(us), np.concatenate(vs), size)
        linked = np.flatnonzero(root != np.arange(size))
        us[:], vs[:] = [linked], [root[linked]]

    dealt = homes.mapInArrow(deal, "cell int, block int, chunk int, visitor boolean, node long, unit binary, times long")
    return dealt.groupBy("cell", "block", "chunk").applyInArrow(compare, "node long, links long, root long")
