"""Exact top-k search by inner product, on vectors floored to multiples of 1/256.

Rows are put in blocks by descending length. A first pass over the longest block gives each
query a score that its k-th best reaches; blocks too short for all queries of a chunk are
not sent to it. A task walks its blocks from the longest vectors to the shortest, in tiles,
and holds the k best of each query: queries whose length times the tile's longest vector
cannot reach their k-th best (Cauchy-Schwarz) are left out; for others partial sums over
the first 16, 32, 64, ... coordinates after an SVD rotation, and the lengths of the rests,
bound each pair, and after each depth only the pairs that could still reach it go on. What
remains is multiplied in full, in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

#: rows that the rotation is fitted on; first depth
SAMPLE, HEAD = 8192, 16
#: bytes of a block of rows, and of a chunk of queries; blocks of a task; rows and queries of a tile
BLOCK_BYTES, CHUNK_BYTES, BLOCKS_PER_TASK, TILE = 2 << 20, 32 << 20, 8, 512
#: where there are fewer than k rows yet: no score is this low
NONE, NO_ID = -(2**63) + 1, 2**63 - 1


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, vec binary of int64 floors, norm) of the rows whose vectors are whole.

    Vectors that are null or hold null or non-finite components take no part. A component
    that is no long after scaling is an error."""

    def run(batches):
        for b in batches:
            vectors = b.column(1)
            x = pc.fill_null(vectors.flatten(), np.nan).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            fine = np.isfinite(x)
            whole = np.diff(np.concatenate([[0], np.cumsum(~fine)])[ends]) == 0
            rows = np.flatnonzero(whole & ~pc.or_(vectors.is_null(), b.column(0).is_null()).to_numpy(zero_copy_only=False))
            q = np.floor(scale * np.where(fine, x, 0.0))
            if len(q) and np.abs(q).max() >= 2.0**63:
                raise ValueError("a component does not fit a long")
            q = q.astype("<i8")
            vec = [q[a:z].tobytes() for a, z in zip(ends[rows].tolist(), ends[rows + 1].tolist())]
            norm = [float(np.linalg.norm(np.frombuffer(v, "<i8").astype(float))) for v in vec]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(vec, pa.binary()), pa.array(norm, pa.float64())], names=["id", "vec", "norm"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, vec binary, norm double")


def _matrix(cells: list[bytes], width: int) -> np.ndarray:
    """Rows of int64; shorter vectors are filled with zeros, which changes no product."""
    if cells and len(set(map(len, cells))) == 1 and len(cells[0]) == 8 * width:
        return np.frombuffer(b"".join(cells), "<i8").reshape(-1, width)
    out = np.zeros((len(cells), width), np.int64)
    for i, c in enumerate(cells):
        x = np.frombuffer(c, "<i8")
        out[i, : len(x)] = x
    return out


def _exact(bound: float, few, many, whole):
    """A product of integers: by floats below 2**53, by longs below 2**63, else by Python's integers."""
    if bound < 1 << 53:
        return few().astype(np.int64)
    if bound < 2.0**62:
        return many()
    got = whole()
    if got.size and max(abs(int(got.max())), abs(int(got.min()))) > NO_ID:
        raise OverflowError("a score does not fit a long")
    return got.astype(np.int64)


def _bound(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two sets of integer vectors."""
    return _exact(_bound(a, b), lambda: a.astype(float) @ b.astype(float).T, lambda: a @ b.T, lambda: a.astype(object) @ b.astype(object).T)


def _pair_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each vector of a with that of b in the same place."""
    return _exact(_bound(a, b), lambda: np.einsum("ij,ij->i", a.astype(float), b.astype(float)), lambda: np.einsum("ij,ij->i", a, b), lambda: (a.astype(object) * b.astype(object)).sum(1))


class Side:
    """Vectors with their lengths, their rotated coordinates, and at each depth the lengths of the rests."""

    def __init__(self, vec: np.ndarray, ids: np.ndarray, rotation: np.ndarray):
        self.vec, self.ids, self.turned = vec, ids, vec.astype(float) @ rotation
        self.norm = np.sqrt((self.turned**2).sum(1))
        self.depths = [d for d in (HEAD << i for i in range(32)) if d < vec.shape[1]] or [vec.shape[1]]
        self.rest = {d: np.sqrt((self.turned[:, d:] ** 2).sum(1)) for d in self.depths}


class Best:
    """The k best scores of each query, descending, ties by id; ``floor`` is known to be reached."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.full((n, k), NO_ID)
        self.floor = np.full(n, -np.inf) if floor is None else floor

    def worst(self, at=slice(None)) -> np.ndarray:
        last = self.score[at, self.k - 1]
        return np.maximum(np.where(last == NONE, -np.inf, last.astype(float)), self.floor[at])

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(query)
        if not len(some):
            return
        q = np.concatenate([np.repeat(some, self.k), query])
        s, d = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.id[some].ravel(), ids])
        order = np.lexsort((d, -s, q))
        first = np.searchsorted(q[order], some)
        top = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[some], self.id[some] = s[top].reshape(-1, self.k), d[top].reshape(-1, self.k)


def search_block(q: Side, rows: Side, best: Best) -> int:
    """Merge a block of rows into ``best``; the number of pairs multiplied in full."""
    order, scored = np.argsort(-rows.norm, kind="stable"), 0
    for s in range(0, len(order), TILE):
        t = order[s : s + TILE]
        top = rows.norm[t[0]]
        # far above what rounding adds to a bound
        need = best.worst() - 1e-6 * (1 + q.norm * top)
        alive = np.flatnonzero(q.norm * top >= need)
        for a in range(0, len(alive), TILE):
            scored += _search_tile(q, rows, best, alive[a : a + TILE], t, need)
    return scored


def _search_tile(q: Side, rows: Side, best: Best, qi: np.ndarray, t: np.ndarray, need: np.ndarray) -> int:
    d = q.depths[0]
    part = q.turned[qi, :d] @ rows.turned[t, :d].T
    could = part + q.rest[d][qi][:, None] * rows.rest[d][t][None, :] >= need[qi][:, None]
    could &= q.ids[qi][:, None] != rows.ids[t][None, :]
    i, j = np.nonzero(could)
    if 4 * len(i) > could.size:  # most are left: one product of all costs less than theirs one by one
        scored, score = could.size, _products(q.vec[qi], rows.vec[t])[i, j]
        i, j = qi[i], t[j]
    else:
        part = part[i, j]
        i, j = qi[i], t[j]
        for before, d in zip(q.depths, q.depths[1:]):
            part = part + np.einsum("ij,ij->i", q.turned[i, before:d], rows.turned[j, before:d])
            keep = part + q.rest[d][i] * rows.rest[d][j] >= need[i]
            i, j, part = i[keep], j[keep], part[keep]
        scored, score = len(i), _pair_products(q.vec[i], rows.vec[j])
    keep = score.astype(float) >= need[i]
    best.add(i[keep], score[keep], rows.ids[j[keep]])
    return scored


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of highest integer inner
    product, its own id left out, ties to the smaller id; fewer where there are fewer rows.

    Queries and rows meet in blocks; each query's k best of each task are merged at the
    end. Rows with a null id take no part; a query id that repeats is asked once; rows that
    repeat an id each count. What a shorter vector lacks counts as zero. Scores are exact
    longs; one beyond a long is an error. Other columns are ignored; an empty table gives none.
    """
    spark = df.sparkSession
    with scratch(spark) as made:
        rows, _ = materialize(quantised(df, id_col, vector_col, scale), "vectors")
        asked, _ = materialize(quantised(queries, id_col, vector_col, scale).dropDuplicates(["id"]), "queries")
        n, width = rows.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
        m, q_width = asked.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
        width = max(1, max(width or 0, q_width or 0) // 8)
        a_block, a_chunk = (max(64, x // (8 * width)) for x in (BLOCK_BYTES, CHUNK_BYTES))
        blocks, chunks = max(1, -(-n // a_block)), max(1, -(-m // a_chunk))
        tasks = max(1, -(-blocks // BLOCKS_PER_TASK), min(blocks, 6))
        # the rotation is fitted on at most SAMPLE rows and only sharpens bounds
        sample = _matrix([bytes(r.vec) for r in rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").collect()], width).astype(float)
        rotation = np.linalg.svd(sample if len(sample) >= width else np.eye(width), full_matrices=False)[2].T

        def pack(batches):
            for b in batches:
                for i in range(0, b.num_rows, a_block):
                    part = b.slice(i, a_block)
                    cells = [part.column("id").to_numpy().astype("<i8").tobytes(), _matrix(part.column("vec").to_pylist(), width).astype("<i8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells] + [pa.array([max(part.column("norm").to_pylist())])], names=["ids", "vecs", "top"])

        kind = "ids binary, vecs binary, top double"
        packed = rows.repartitionByRange(blocks, F.col("norm").desc(), "id").sortWithinPartitions(F.col("norm").desc()).mapInArrow(pack, kind)
        packed, _ = materialize(packed, "blocks")
        longest = packed.orderBy(F.col("top").desc()).limit(1).collect()  # one block

        def side(ids: bytes, vecs: bytes) -> Side:
            return Side(np.frombuffer(vecs, "<i8").reshape(-1, width), np.frombuffer(ids, "<i8"), rotation)

        def seed(batches):
            block = side(bytes(longest[0].ids), bytes(longest[0].vecs)) if longest else None
            for b in batches:
                floors, least = [], []
                for ids, vecs in zip(b.column("ids").to_pylist(), b.column("vecs").to_pylist()):
                    q = side(ids, vecs)
                    best = Best(len(q.ids), k)
                    if block:
                        search_block(q, block, best)
                    floor = best.worst()
                    floors.append(floor.astype("<f8").tobytes())
                    # rows shorter than this cannot be among the k best of any of these queries
                    least.append(float(np.where((floor > 0) & (q.norm > 0), floor / np.maximum(q.norm, 1), 0.0).min()) * (1 - 1e-6))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(floors, pa.binary()), pa.array(least, pa.float64()), b.column("chunk")], names=["ids", "vecs", "floors", "least", "chunk"])

        sets = asked.repartition(chunks, "id").mapInArrow(pack, kind).withColumn("chunk", F.pmod(F.spark_partition_id(), F.lit(chunks)))
        sets, _ = materialize(sets.mapInArrow(seed, "ids binary, vecs binary, floors binary, least double, chunk int"), "sets")
        # dealt by hash, so every task has blocks of all lengths
        left = packed.withColumn("task", F.pmod(F.xxhash64("ids"), F.lit(tasks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        left = left.join(sets.groupBy("chunk").agg(F.min("least").alias("least")), "chunk").where("top >= least").select(F.struct("task", "chunk").alias("cell"), "ids", "vecs", "top")
        right = sets.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).select(F.struct("task", "chunk").alias("cell"), "ids", "vecs", "floors")

        def run(_: tuple[pa.Scalar, ...], a: pa.Table, q: pa.Table) -> pa.Table:
            order = np.argsort(-np.array(a.column("top").to_pylist(), float), kind="stable").tolist()
            asked = [(side(ids, vecs), np.frombuffer(floors, "<f8")) for ids, vecs, floors in zip(*(q.column(c).to_pylist() for c in ("ids", "vecs", "floors")))]
            best = [Best(len(x.ids), k, floor) for x, floor in asked]
            for i in order:
                block = side(a.column("ids")[i].as_py(), a.column("vecs")[i].as_py())
                for (x, _), b in zip(asked, best):
                    search_block(x, block, b)
            found = [(np.repeat(x.ids, (b.score != NONE).sum(1)), b.id[b.score != NONE], b.score[b.score != NONE]) for (x, _), b in zip(asked, best)]
            cols = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
            return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), cols)})

        got = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, "query_id long, vec_id long, score long")
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return made.keep(got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk")
