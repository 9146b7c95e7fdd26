"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A pair that differs in at most 3 bits has a value between them, one bit from one
and two from the other. Its fingerprints' parities differ exactly when the
distance is odd, so it suffices that every fingerprint emits itself and its 64
neighbours, and those of even parity also all values two bits away. A variant's
bucket is its first p bits. A fingerprint's variants lie in 1 + p + p(p-1)/2 buckets
at most (1 + p for odd parity), so it is sent to each of those once, in packed blocks,
and a bucket makes its own share of the variants, part by part; no variant is ever a
row. p follows from the bytes that a bucket may hold: what is sent of a fingerprint
grows with the square of log n, not with n.

Each run of equal variants links its members to one that is at most one bit away, and
linked pairs are verified; where the key is a slice of a longer sketch, members that
this leaves apart are compared with each other. Buckets return spanning forests, so a
dense group of m fingerprints returns at most m - 1 edges a bucket, not its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, equal_runs, forest, materialize, mix64, parts, scratch
from .components import connected_components

#: variants that a task makes at once; memory that a bucket's rows may take in its task, and
#: what a row takes there beside its own bytes: its key, its place in order and its tree
VARIANTS_AT_ONCE, BUCKET_BYTES, ROW_EXTRA = 1_500_000, 320 << 20, 24
#: emitted bytes that a task holds before it sends them on, and pairs verified at once
HELD_BYTES, PACK = 32 << 20, 65_536
#: bytes of text that are sketched at once; a longer text is one part
PART = 4 << 20
#: members of a run that are compared with those next to them, before any are searched for trees
NEXT = 8
#: lanes of a sketch that a pair met in a slice is compared by
CHECK = 2
#: members of a group of candidates in one block, and bytes of their texts together
BLOCK, BLOCK_BYTES = 256, 16 << 20


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k lower-cased words, repeats included; of the
    whole sequence where there are fewer words; empty where there are none."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = partial(xxhash.xxh64_intdigest, seed=42)
    join = b" ".join
    if n <= k:
        return np.array([h(join(words))], np.uint64)
    return np.fromiter(map(h, map(join, zip(*(words[i:] for i in range(k))))), np.uint64, n - k + 1)


def simhash(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """64 * lanes majority bits, little-endian; further lanes mix the same hashes anew."""
    n, total = len(hashes), np.zeros(64 * lanes, np.int64)
    if not n:
        return bytes(8 * lanes)
    add = np.array([lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for lane in range(lanes)], np.uint64)
    for i in range(0, n, 255):  # 255 ones are the most that a byte counts
        h = hashes[i : i + 255, None] + add
        h[:, 1:] = mix64(h[:, 1:])
        total += np.unpackbits(np.ascontiguousarray(h, "<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * total > n, bitorder="little").tobytes()


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, lanes: int) -> DataFrame:
    """(id, sketch binary of 8 * lanes bytes) of each row."""

    def run(batches):
        for b in (part for whole in batches for part in parts(whole, 1, PART)):
            got = [simhash(shingle_hashes(t, shingle), lanes) for t in bytes_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["id", "sketch"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, sketch binary")


def set_sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, lanes: int) -> DataFrame:
    """(id, hash, digest, sketch) of each row: an MD5 of the text, a digest of its set of
    shingles, and the sketch of that set."""

    def run(batches):
        for b in (part for whole in batches for part in parts(whole, 2, PART)):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in bytes_of(b.column(2))]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            got = [pa.array(digests, pa.binary()), pa.array([simhash(s, lanes) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *got], names=["id", "hash", "digest", "sketch"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    t = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), text_hash(text_col).alias("hash"), t.alias("t")).mapInArrow(run, f"id {kind}, hash string, digest binary, sketch binary")


def text_hash(text_col: str):
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def _errors(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of weight at most 1, and of weight 2."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    i, j = np.triu_indices(bits, 1)
    return np.concatenate([[np.uint64(0)], one]), one[i] ^ one[j]


def _classes(errors: np.ndarray, bits: int, p: int) -> dict[int, np.ndarray]:
    """The errors by their first p bits."""
    first = (errors >> np.uint64(bits - p)).astype(np.int64) if p else np.zeros(len(errors), np.int64)
    return {int(x): errors[first == x] for x in np.unique(first)}


def sent_to(keys: np.ndarray, bits: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) for each bucket that holds a variant of a row's key, once each."""
    near, far = _errors(bits)
    home = (keys >> np.uint64(bits - p)).astype(np.int64) if p else np.zeros(len(keys), np.int64)
    even = np.flatnonzero((np.bitwise_count(keys) & 1) == 0)
    all_rows = np.arange(len(keys))
    few, more = _classes(near, bits, p), _classes(far, bits, p)
    to, rows = [], []
    for e in few.keys() | more.keys():
        who = all_rows if e in few else even
        to.append(home[who] ^ e)
        rows.append(who)
    return np.concatenate(to), np.concatenate(rows)


def _bucket_runs(keys: np.ndarray, bits: int, bucket: int, p: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(run, owner, is near) of this bucket's variants, by runs of two or more equal ones.
    ``keys`` are ascending. A bucket of too many variants is made in parts, by further bits."""
    shift = bits - p
    near, far = _errors(bits)
    few, more = _classes(near, bits, p), _classes(far, bits, p)
    kinds = sorted(few.keys() | more.keys())
    low = np.array([(bucket ^ e) << shift for e in kinds], np.uint64)
    a = np.searchsorted(keys, low, "left")
    b = np.searchsorted(keys, low | np.uint64((1 << shift) - 1), "right")
    size = sum((y - x) * (len(few.get(e, ())) + len(more.get(e, ())) // 2) for e, x, y in zip(kinds, a.tolist(), b.tolist()))
    if size > VARIANTS_AT_ONCE and shift > 1:
        for half in (0, 1):
            yield from _bucket_runs(keys, bits, 2 * bucket + half, p + 1)
        return
    values, owners, is_near = [], [], []
    for e, x, y in zip(kinds, a.tolist(), b.tolist()):
        who = np.arange(x, y, dtype=np.int32)
        even = who[(np.bitwise_count(keys[x:y]) & 1) == 0]
        for rows, errors, flag in ((who, few.get(e, ()), True), (even, more.get(e, ()), False)):
            if len(rows) and len(errors):
                values.append((keys[rows][:, None] ^ errors[None, :]).ravel())
                owners.append(np.repeat(rows, len(errors)))
                is_near.append(np.full(len(values[-1]), flag))
    if values:
        index, run = equal_runs(np.concatenate(values))
        yield run, np.concatenate(owners)[index], np.concatenate(is_near)[index]


def _star(run: np.ndarray, owners: np.ndarray, is_near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run's members and one that is at most a bit away, as index pairs."""
    if not len(run):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    none = np.iinfo(np.int64).max
    centre = np.full(run[-1] + 1, none)
    np.minimum.at(centre, run[is_near], owners[is_near])
    c = centre[run]
    ok = (c != none) & (c != owners)
    return c[ok], owners[ok]


def _bucket_edges(keys: np.ndarray, bits: int, bucket: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that meet in this bucket: linear in the number of emissions."""
    found = [_star(*part) for part in _bucket_runs(keys, bits, bucket, p)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The trees ``root`` with the edges (u, v) added."""
    a, b = root[u], root[v]
    if (a == b).all():
        return root
    nodes, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(root))
    up[nodes] = nodes[forest(of[: len(a)], of[len(a) :], len(nodes))]
    return up[root]


def _verified(words: np.ndarray, u: np.ndarray, v: np.ndarray, root: np.ndarray, most: int) -> np.ndarray:
    """``root`` with those of the pairs that differ in at most ``most`` bits joined."""
    for i in range(0, len(u), PACK):
        a, b = u[i : i + PACK], v[i : i + PACK]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        ok = _distance(words[a], words[b]) <= most
        root = _joined(root, a[ok], b[ok])
    return root


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1)


def _open_run_edges(words: np.ndarray, run: np.ndarray, owners: np.ndarray, root: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``most`` that connect what any pairs of a run's members do.

    ``root`` has the trees known so far: a run inside one tree needs nothing more, nor one
    whose members were all next to each other. In others a member just reached is compared with all not reached yet, so that every pair
    is compared unless its members are connected already.
    """
    u, v, seen = [np.empty(0, np.int64)], [np.empty(0, np.int64)], set()
    if len(run):
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        ends = np.append(starts[1:], len(run))
        tree = root[owners]
        several = np.minimum.reduceat(tree, starts) != np.maximum.reduceat(tree, starts)
        for i in np.flatnonzero(several & (ends - starts > NEXT + 1)):  # others are compared in full already
            rest = np.sort(owners[starts[i] : ends[i]]).astype(np.int64)
            if rest.tobytes() in seen:
                continue
            seen.add(rest.tobytes())
            while len(rest) > 1:
                reached, rest = [rest[0]], rest[1:]
                while reached and len(rest):
                    c = reached.pop()
                    near = _distance(words[rest], words[c]) <= most
                    hit, rest = rest[near], rest[~near]
                    u.append(np.full(len(hit), c))
                    v.append(hit)
                    reached.extend(hit)
    return np.concatenate(u), np.concatenate(v)


def buckets_bits(count: int, row_bytes: int, bits: int, least: int) -> int:
    """p: so many first bits of a variant name its bucket that a bucket's share of ``count``
    fingerprints takes at most about ``BUCKET_BYTES``, and at least ``least``."""
    p = least
    while p < bits - 2 and count * (row_bytes + ROW_EXTRA) * sent_times(p) / (1 << p) > BUCKET_BYTES:
        p += 1
    return p


def sent_times(p: int) -> float:
    """To how many buckets a fingerprint is sent, on average."""
    return (min(1 << p, 1 + p) + min(1 << p, 1 + p + p * (p - 1) // 2)) / 2


def ball_links(nodes: DataFrame, lanes: int, tables: int, bits: int, most: int, count: int) -> DataFrame:
    """Edges (u, v) between ``nodes`` (node long; sketch binary of 8 * lanes bytes, if more than one).

    With one lane the 64-bit sketch is the key, ``node`` is its value as a long, and pairs
    within ``most`` (3) bits link: that finds every such pair's connection. With more, a table
    is a slice of ``bits`` bits, and pairs within 3 bits in a slice and within ``most`` of the
    CHECK lanes that follow the slice's own link.
    """
    whole = lanes == 1
    kind = np.dtype([("node", "<i8")] if whole else [("node", "<i8"), ("key", f"<u{bits // 8}"), ("check", "<u8", (CHECK,))])
    p = buckets_bits(count, kind.itemsize, bits, 5 if whole else 1)

    def packed(node: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t in range(tables):
            rows = np.empty(len(node), kind)
            rows["node"] = node
            if whole:
                keys = node.view(np.uint64)
            else:
                keys, own = _slice(sketch, t, bits), t * bits // 64
                rows["key"] = keys
                rows["check"] = sketch.view("<u8")[:, [(own + 1 + i) % lanes for i in range(CHECK)]]
            to, who = sent_to(keys, bits, p)
            order = np.argsort(to, kind="stable")
            to, rows = to[order], rows[who[order]]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            ends = np.append(first, len(to)) * kind.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(to[first] | t << 40, pa.int64()), data.cast(pa.binary())], names=["bucket", "rows"])

    def emit(batches):
        held, most_held = [], max(1, int(HELD_BYTES / (kind.itemsize * sent_times(p))))
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= most_held:
                yield from flush(held)
                held = []
        yield from flush(held)

    def flush(held):
        if sum(x.num_rows for x in held):
            node = np.concatenate([x.column(0).to_numpy() for x in held]).astype("<i8")
            yield from packed(node, None if whole else np.frombuffer(b"".join(c for x in held for c in x.column(1).to_pylist()), np.uint8).reshape(-1, 8 * lanes))

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py() & (1 << 40) - 1
        cells = [x for b in batches for x in b.column("rows").to_pylist()]
        n, at = sum(map(len, cells)) // kind.itemsize, 0
        columns = {name: np.empty((n, *kind[name].shape), kind[name].base) for name in kind.names}
        for i, cell in enumerate(cells):
            rows = np.frombuffer(cell, kind)
            for name, column in columns.items():
                column[at : at + len(rows)] = rows[name]
            at += len(rows)
            cells[i] = None  # so that the rows are there once
        del rows, cell
        node = columns.pop("node")
        # by key, and by node within one, so that a second run of a lost task finds the same trees
        keys = node.view(np.uint64) if whole else columns["key"]
        order = np.argsort(node, kind="stable").astype(np.int32) if not whole else None
        order = np.argsort(keys) if whole else order[np.argsort(keys[order], kind="stable")]
        node, keys = node[order], keys[order].astype(np.uint64)
        words = keys[:, None] if whole else columns["check"][order]
        del order, columns
        root = np.arange(n)
        for run, owners, is_near in _bucket_runs(keys, bits, bucket, p):
            root = _verified(words, *_star(run, owners, is_near), root, most)
            if not whole:  # members of a run share a slice only: its centre need not link them
                for step in range(1, NEXT + 1):
                    i = np.flatnonzero(run[step:] == run[:-step])
                    if not len(i):
                        break
                    root = _verified(words, owners[i], owners[i + step], root, most)
                root = _joined(root, *_open_run_edges(words, run, owners, root, most))
        linked = np.flatnonzero(root != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["u", "v"])

    sent = nodes.select("node", *(() if whole else ("sketch",))).mapInArrow(emit, "bucket long, rows binary")
    return sent.groupBy("bucket").applyInArrow(meet, "u long, v long")


def _slice(sketch: np.ndarray, t: int, bits: int) -> np.ndarray:
    n = bits // 8
    return np.ascontiguousarray(sketch[:, t * n : (t + 1) * n]).view(f"<u{n}").ravel().astype(np.uint64)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) of each row: 64-bit fingerprints, linked at
    3 or fewer differing bits; component_id is the least id reachable.

    Exact copies meet as one fingerprint before any variant is made. Null and
    blank texts have fingerprint zero, linked like any other. Rows with a null id
    take part and get the component of their fingerprint (null if it has no id).
    Repeated rows each get a result. Other columns are ignored.
    """
    with scratch(df.sparkSession) as made:
        docs = made.keep(sketches(df, id_col, text_col, shingle, 1), "simhash")
        # big-endian hex, and as a signed long, which is exact for any 64 bits
        hexed = F.hex("sketch")
        big = F.lower(F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)]))
        half = lambda a: F.conv(F.substring("fingerprint", a, 8), 16, 10).cast("long")
        docs = docs.withColumn("fingerprint", big).withColumn("node", F.shiftleft(half(1), 32).bitwiseOR(half(9)))
        groups, _ = materialize(docs.groupBy("node").agg(F.min("id").alias("low")), "groups")
        roots = connected_components(ball_links(groups.select("node"), 1, 1, 64, 3, groups.count()))
        member = groups.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
        least = member.groupBy("root").agg(F.min("low").alias("component_id"))
        classes = made.keep(member.join(least, "root").select("node", "component_id"), "classes")
    return docs.join(classes, "node").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def exact_links(members: DataFrame, df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Edges (u, v) that connect what the pairs of one root's members do whose sets of
    shingles have a Jaccard similarity of at least ``similarity``, a fraction.

    ``members`` is (node, root, id, hash), each root among its own members. A root's members
    are dealt into blocks, and each block is compared in itself and with the root's own text.
    Members that this leaves apart from the root's visit all other blocks, in parts; two
    members that are connected to it need not meet. So a group of copies of one text costs
    one comparison a member, and no pair is left out.
    """
    over, under = similarity
    texts = df.select(F.col(id_col).alias("id"), text_hash(text_col).alias("hash"), F.col(text_col).cast("string").alias("t"))
    rows = texts.join(members, ["id", "hash"]).groupBy("id", "hash").agg(*[F.first(c).alias(c) for c in ("t", "node", "root")])
    rows, _ = materialize(rows.select("root", "node", "t"), "texts")

    def blocks_of(some: DataFrame, name: str) -> DataFrame:
        size = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum(F.coalesce(F.octet_length("t"), F.lit(0))) / F.lit(BLOCK_BYTES)), F.lit(1))
        return some.groupBy("root").agg(size.cast("long").alias(name))

    sized = rows.join(blocks_of(rows, "blocks"), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    to = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))

    def within(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sets = _node_sets(batches, shingle)
        root = key[0].as_py()["root"]
        centre = np.argsort(node != root, kind="stable")
        node, sets = node[centre], [sets[i] for i in centre.tolist()]
        label = forest(*_set_edges(sets, over, under), len(sets))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), root)), pa.array(node), pa.array(node[label])], names=["root", "u", "v"])

    # one key of all columns: rows that lie by root already would else stay there, a group in one task
    inside = sized.withColumn("to", F.explode(to)).select(F.struct("root", "to").alias("cell"), "node", "t").groupBy("cell").applyInArrow(within, "root long, u long, v long")
    inside, _ = materialize(inside, "within")
    apart = inside.where("v <> root").select(F.col("u").alias("node"))
    left = sized.where("blocks > 1").join(apart, "node", "left_semi")
    left = left.join(blocks_of(left, "parts"), "root").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
    left, _ = materialize(left, "apart")
    visits = left.withColumn("to", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("block"))))
    parts = left.select("root", "parts").distinct()
    homes = sized.join(parts, "root").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = visits.select(F.struct("root", "to", "part").alias("cell"), F.lit(True).alias("visits"), "node", "t")
    cells = cells.unionByName(homes.select(F.struct("root", F.col("block").alias("to"), "part").alias("cell"), F.lit(False).alias("visits"), "node", "t"))

    def across(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        visitor = np.concatenate([b.column("visits").to_numpy(zero_copy_only=False) for b in batches])
        node, sets = _node_sets(batches, shingle)
        label = forest(*_set_edges(sets, over, under, visitor), len(sets))
        linked = label != np.arange(len(label))
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], names=["u", "v"])

    return cells.groupBy("cell").applyInArrow(across, "u long, v long").unionByName(inside.where("u <> v").select("u", "v"))


def _node_sets(batches: Iterable[pa.RecordBatch], shingle: int) -> tuple[np.ndarray, list[np.ndarray]]:
    nodes, sets = [], []
    for x in batches:
        nodes += x.column("node").to_pylist()
        sets += [np.unique(shingle_hashes(t, shingle)) for t in bytes_of(x.column("t"))]
    return np.array(nodes, np.int64), sets


def _set_edges(sets: list[np.ndarray], over: int, under: int, visitor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what the pairs do that have a Jaccard similarity of at least
    over / under; with ``visitor`` only pairs of a visitor and another count.

    One member after another is compared with all that are not reached yet, in one pass."""
    size = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(size)
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(kinds), bool)
    u, v, rest = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(sets))

    def similar(c: int, to: np.ndarray) -> np.ndarray:
        own = flat[ends[c] - size[c] : ends[c]]
        mark[own] = True
        upto = np.concatenate([[0], np.cumsum(mark[flat])])
        mark[own] = False
        both = upto[ends[to]] - upto[ends[to] - size[to]]
        return under * both >= over * (size[c] + size[to] - both)

    if visitor is not None:
        homes = np.flatnonzero(~visitor)
        for c in np.flatnonzero(visitor).tolist() if len(homes) else ():
            hit = homes[similar(c, homes)]
            u.append(np.full(len(hit), c))
            v.append(hit)
        return np.concatenate(u), np.concatenate(v)
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            c = reached.pop()
            near = similar(c, rest)
            hit, rest = rest[near], rest[~near]
            u.append(np.full(len(hit), c))
            v.append(hit)
            reached.extend(hit)
    return np.concatenate(u), np.concatenate(v)


#: two sets at a Jaccard similarity of 0.8 have a cosine of 0.89 or more and differ in 19.4 of
#: 128 bits, with a deviation of 4.1; candidates may differ in 40, five deviations more.
PIPELINE = {"shingle": 5, "lanes": 8, "tables": 16, "bits": 32, "most": 40}


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, lanes: int = 8, tables: int = 16, bits: int = 32, most: int = 40, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row of each group of near copies, the one with the least id; all columns stay.

    Near copies are texts whose sets of word 5-shingles have a Jaccard similarity of 0.8 or
    more. Candidates meet in any of sixteen 32-bit slices of a sketch within 3 bits; all
    texts that candidates connect are then compared by their sets. Rows with a null id are
    no one's copies here: all stay. Rows that repeat an id with other texts are judged each
    by its text; of one id's near copies the least MD5 of a text stays, and of rows alike in
    id and text any one. Null and blank texts have the empty set and are copies of each other:
    one of them stays. An empty table gives an empty one.
    """
    with_id = df.where(F.col(id_col).isNotNull())
    with scratch(df.sparkSession) as made:
        docs, _ = materialize(set_sketches(with_id, id_col, text_col, shingle, lanes), "simhash")
        groups = docs.groupBy("digest").agg(F.min(F.struct("id", "hash")).alias("low"), F.first("sketch").alias("sketch"))
        groups, _ = materialize(groups.select(F.monotonically_increasing_id().alias("node"), "low.id", "low.hash", "sketch"), "groups")
        loose = connected_components(ball_links(groups.select("node", "sketch"), lanes, tables, bits, most, groups.count()))
        members, _ = materialize(groups.drop("sketch").join(loose, "node"), "members")
        roots = connected_components(exact_links(members, with_id, id_col, text_col, shingle, similarity))
        member = groups.join(roots, "node", "left").select(F.struct("id", "hash").alias("low"), F.coalesce("root", "node").alias("root"))
        low = member.groupBy("root").agg(F.min("low").alias("low"))
        kept = made.keep(low.select(F.col("low.id").alias("_id"), F.col("low.hash").alias("_hash")), "kept")
    with_id = with_id.withColumn("_hash", text_hash(text_col)).withColumn("_id", F.col(id_col))
    with_id = with_id.join(kept, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select(df.columns)
    return with_id.unionByName(df.where(F.col(id_col).isNull())).select(df.columns)
