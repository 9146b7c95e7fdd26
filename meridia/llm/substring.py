"""Exact substring dedup: words covered by a window of 35 that starts anywhere else.

Windows travel as super-k-mers: consecutive windows that share a minimiser (the
least hash of their 4-word grams) go as one packed string to that minimiser's
bucket. Rows are first dealt into blocks; a block sends each distinct string once,
with its count, so a passage that a third of all documents share arrives once a
block and not once a document. Minimisers of too many windows, by a sample, are
refined by the window's least gram under another hash, so a frequent phrase with ever
new surroundings is dealt over many buckets. A bucket sorts its windows, compares
equal hashes word by word, and answers each block with one bit a window. Blocks then
mark words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_words, equal_runs, mix64, parts

GRAM = 4
LONGEST_RUN = 2048
#: bytes of text of a block, and of the texts whose windows a bucket holds
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
#: blocks or buckets that one task works off, one after another
GROUPS_PER_TASK = 16
#: bytes of text that frequent minimisers are sought in; they decide where windows meet, never which
SAMPLE_BYTES, LEAST_HOT = 32 << 20, 1000


def _hash_words(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    return known[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)


def _grams(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        g = h.copy()
        for j in range(1, GRAM):
            g[:-j or None] = g[:-j or None] * np.uint64(0x9E3779B97F4A7C15) + h[j:]
        return mix64(g)


def _least(g: np.ndarray, window: int) -> np.ndarray:
    """For each start, the least gram hash within its window (starts near the end are meaningless)."""
    g, span, step = g.copy(), window - GRAM + 1, 1
    while step < span:
        by = min(step, span - step)
        g[:-by] = np.minimum(g[:-by], g[by:])
        step += by
    return g


def _minimisers(h: np.ndarray, window: int, hot: np.ndarray) -> np.ndarray:
    """For each start, its window's minimiser; one of ``hot`` (ascending) with another."""
    g = _grams(h)
    low = _least(g, window)
    if len(hot):
        often = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
        if often.any():
            with np.errstate(over="ignore"):
                other = _least(mix64(g + np.uint64(0x9E3779B97F4A7C15)), window)
                low = np.where(often, mix64(low ^ (other * np.uint64(0xD6E8FEB86659FD93))), low)
    return low


def count_minimisers(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in parts(whole, 0, BLOCK_BYTES)):
        block = Block(b.column(0), window, 1)
        low, of = np.unique(block.low, return_inverse=True)
        n = np.bincount(of, block.count, minlength=len(low)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(n)], names=["low", "n"])


class Block:
    """The words of some texts, cut into super-k-mers."""

    def __init__(self, texts: pa.Array, window: int, buckets: int, hot: np.ndarray = np.empty(0, np.uint64)):
        words, self.starts = arrow_words(texts)
        n = len(words)
        lengths = pc.binary_length(words).to_numpy().astype(np.int64) if n else np.empty(0, np.int64)
        #: the words joined by one space, and where each begins there
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.at, self.n, self.window = at, n, window
        self.joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), words.cast(pa.string())), " ")[0].as_buffer().to_pybytes() if n else b""
        self.first = self.count = np.empty(0, np.int64)
        self.low = np.empty(0, np.uint64)
        if n < window:
            return
        low = _minimisers(_hash_words(words), window, hot)
        valid = np.zeros(n, bool)
        delta = np.zeros(n + 1, np.int64)
        ends = np.maximum(self.starts[1:] - window + 1, self.starts[:-1])
        np.add.at(delta, self.starts[:-1], 1)
        np.add.at(delta, ends, -1)
        valid = np.cumsum(delta)[:n] > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        doc_start = self.starts[:-1][self.starts[:-1] < n]
        new[doc_start] |= valid[doc_start]
        first = np.flatnonzero(new)
        stop = np.minimum(np.concatenate([first[1:], [n]]), n)
        invalid = np.concatenate([np.flatnonzero(~valid), [n]])
        stop = np.minimum(stop, invalid[np.searchsorted(invalid, first)])
        if len(first) and (stop - first).max() > LONGEST_RUN:
            cut = [(a, b) for s, e in zip(first, stop) for a, b in [(x, min(x + LONGEST_RUN, e)) for x in range(s, e, LONGEST_RUN)]]
            first, stop = (np.array(x, np.int64) for x in zip(*cut))
        bucket = (low[first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.first, self.count, self.bucket, self.low = first[order], (stop - first)[order], bucket[order], low[first][order]

    def packed(self):
        """For each bucket: its number, distinct strings in order, and of each super-k-mer the string's index."""
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1)) if len(self.first) else []
        begin = self.at[self.first] if len(self.first) else None
        end = self.at[self.first + self.count + self.window - 1] - 1 if len(self.first) else None
        for i, a in enumerate(edges):
            b = edges[i + 1] if i + 1 < len(edges) else len(self.first)
            index: dict[bytes, int] = {}
            of = [index.setdefault(self.joined[x:y], len(index)) for x, y in zip(begin[a:b].tolist(), end[a:b].tolist())]
            yield int(self.bucket[a]), a, index, np.array(of, np.int64)


def _window_duplicates(ids: np.ndarray, line_words: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """One flag a window, in order: does its word sequence occur more than once? Exact."""
    windows = line_words - window + 1
    total = int(windows.sum())
    if not total:
        return np.empty(0, bool)
    word0 = np.concatenate([[0], np.cumsum(line_words)])[:-1]
    win0 = np.concatenate([[0], np.cumsum(windows)])[:-1]
    start = np.arange(total) + np.repeat(word0 - win0, windows)
    with np.errstate(over="ignore"):
        odd = 0x9E3779B97F4A7C15
        inverse = pow(odd, -1, 1 << 64)
        power, back = np.full(len(ids) + 1, odd, np.uint64), np.full(len(ids) + 1, inverse, np.uint64)
        power[0] = back[0] = 1
        power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(odd)) * power[:-1], dtype=np.uint64)])
        h = (sums[start + window] - sums[start]) * back[start]
    del power, back, sums
    multiple = np.repeat(counts > 1, windows)
    out = multiple.copy()
    index, run = equal_runs(h)
    same = run[1:] == run[:-1]
    one, other = index[:-1][same], index[1:][same]
    a, b = start[one], start[other]
    equal = np.ones(len(a), bool)
    for j in range(window):
        equal &= ids[a + j] == ids[b + j]
    out[one[equal]] = True
    out[other[equal]] = True
    if not equal.all():  # unequal windows with one hash: group that run by its words
        for r in np.unique(run[1:][same][~equal]):
            seen: dict[bytes, list[int]] = {}
            for w in index[run == r]:
                seen.setdefault(ids[start[w] : start[w] + window].tobytes(), []).append(w)
            for group in seen.values():
                out[group] = len(group) > 1 or multiple[group[0]]
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, texts: bool = True) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept]) of each row: words covered by a
    window that also starts elsewhere, same document included, are removed.

    Windows are judged on the input. Null and blank texts have no words; texts
    shorter than a window lose none. Repeated rows are copies of each other. Null
    ids are kept. A run of one repeated word is cut to strings of bounded length.
    Other columns are ignored; an empty table gives an empty result. Rows alike in both id
    and text are dealt to one block, and one row must fit a worker.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, blocks = (min(1 << 30, max(32, -(-total // x))) for x in (BUCKET_BYTES, BLOCK_BYTES))
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    # a window a word, of about six bytes; a fourth of a bucket is too much for one minimiser
    often = some.mapInArrow(partial(count_minimisers, window), "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") > max(LEAST_HOT, share * BUCKET_BYTES / 24))
    # at most 24 * SAMPLE_BYTES / BUCKET_BYTES of them, whatever the table
    hot = np.sort(np.array([r.low for r in often.collect()], np.int64).view(np.uint64))

    def ordered(table: pa.Table) -> pa.Table:
        # by text, so that both passes see one order; equal texts are alike
        table = table.combine_chunks()
        return table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")]))

    def column(table: pa.Table, name: str) -> pa.Array:
        got = table.column(name).combine_chunks()
        return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got

    def send(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ordered(pa.Table.from_batches(batches))
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for bucket, _, index, of in Block(column(table, "text"), window, buckets, hot).packed():
            counts = np.bincount(of, minlength=len(index)).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([key[0].as_py()], pa.int32()), pa.array([zip_(b"\n".join(index))], pa.binary()), pa.array([zip_(counts.tobytes())], pa.binary())],
                names=["bucket", "block", "strings", "counts"],
            )

    def judge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        who, lines, counts, rows = [], [], [], []
        for b in batches:
            for block, strings, count in zip(*(b.column(x).to_pylist() for x in ("block", "strings", "counts"))):
                who.append(block)
                lines += unzip(strings).split(b"\n")
                counts.append(np.frombuffer(unzip(count), "<i4"))
                rows.append(len(counts[-1]))
        words, starts = arrow_words(pa.array(lines, pa.large_binary()).cast(pa.large_string()))
        del lines
        ids, line_words = words.dictionary_encode().indices.to_numpy(), np.diff(starts)
        ends = np.cumsum(rows)
        windows = np.concatenate([[0], np.cumsum(line_words - window + 1)])[ends]
        flags = _window_duplicates(ids, line_words, np.concatenate(counts), window)
        rows = np.diff(windows, prepend=0).tolist()
        zip_, at, out = zstandard.ZstdCompressor(level=3).compress, 0, []
        for block, n in zip(who, rows):
            if flags[at : at + n].any():
                out.append((block, zip_(np.packbits(flags[at : at + n]).tobytes())))
            at += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["block", "bucket", "flags"]
        )

    def mark(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor().decompress
        table = ordered(left)
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("id", left.schema.field("id").type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *((("kept", pa.string()),) if texts else ()))})
        block = Block(column(table, "text"), window, buckets, hot)
        verdict = dict(zip(right.column("bucket").to_pylist(), right.column("flags").to_pylist()))
        delta = np.zeros(block.n + 1, np.int64)
        for bucket, a, index, of in block.packed() if verdict else ():
            if bucket not in verdict:
                continue
            count = np.zeros(len(index), np.int64)
            count[of] = block.count[a : a + len(of)]
            bits = np.unpackbits(np.frombuffer(unzip(verdict[bucket]), np.uint8))[: count.sum()]
            begin = np.cumsum(count) - count
            long = count[of]
            place = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            start = (np.repeat(block.first[a : a + len(of)], long) + place)[bits[np.repeat(begin[of], long) + place] > 0]
            np.add.at(delta, start, 1)
            np.add.at(delta, start + window, -1)
        gone = np.cumsum(delta)[: block.n] > 0
        gone_to = np.concatenate([[0], np.cumsum(gone)])
        n_words, n_removed, sha, kept = [], [], [], []
        for s, e in zip(block.starts[:-1].tolist(), block.starts[1:].tolist()):
            removed = int(gone_to[e] - gone_to[s])
            if s == e:
                body = b""
            elif not removed:
                body = block.joined[block.at[s] : block.at[e] - 1]
            else:
                edge = np.flatnonzero(np.diff(np.concatenate([[True], gone[s:e], [True]])))
                body = b" ".join(block.joined[block.at[s + a] : block.at[s + b] - 1] for a, b in edge.reshape(-1, 2).tolist())
            n_words.append(e - s)
            n_removed.append(removed)
            sha.append(hashlib.sha256(body).hexdigest())
            if texts:
                kept.append(body.decode())
        cols = {"id": column(table, "id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"kept": pa.array(kept, pa.string())} if texts else {}))

    def dealt(rows: DataFrame, key: str, groups: int) -> DataFrame:
        # as many tasks as the data need, where the session's number of partitions is too small for them
        tasks = groups // GROUPS_PER_TASK
        return rows.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows

    docs = dealt(docs, "block", blocks)
    sent = docs.groupBy("block").applyInArrow(send, "bucket int, block int, strings binary, counts binary")
    told = dealt(sent, "bucket", buckets).groupBy("bucket").applyInArrow(judge, "block int, bucket int, flags binary")
    out = docs.groupBy("block").cogroup(dealt(told, "block", blocks).groupBy("block")).applyInArrow(mark, f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
    return out.withColumnRenamed("id", id_col)
