"""Shared helpers: words, the cluster's shared folder, materialised tables, plan sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of characters other than ASCII white space. ``bytes.split()``
#: and Arrow's ``ascii_split_whitespace`` cut UTF-8 at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (local tests) is a temporary folder made
    and set as the checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="meridia-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: folders made and not deleted, those of the innermost open ``scratch`` last
_made: list[list[str]] = [[]]


def new_folder(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    return path


class scratch:
    """Deletes the folders made within it, but for those kept: what a result is read from.
    Those pass to the ``scratch`` around it, and go at the end of the session at last."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def __enter__(self) -> scratch:
        _made.append([])
        return self

    def keep(self, df: DataFrame, what: str = "result") -> DataFrame:
        """``df``, written to a folder that stays."""
        df, path = materialize(df, what)
        self.kept.append(path)
        return df

    def __exit__(self, *_) -> None:
        for path in _made.pop():
            if path in self.kept:
                _made[-1].append(path)
            else:
                delete(self.spark, path)


@atexit.register
def _tidy() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in sum(_made, []):
            try:
                delete(spark, path)
            except (Py4JError, OSError):  # the session's JVM has ended
                return


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, path: str) -> str:
    p, fs = _hadoop_path(spark, path)
    fs.mkdirs(p)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, what: str = "table") -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back: its lineage is cut
    there, later stages survive lost executors, and nothing is computed twice."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def equal_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, run) of the values that occur more than once, by runs of equal ones."""
    n = len(values)
    mask = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    # sorting one number each is far quicker than sorting indices; hashes cut short only find candidates
    packed = np.sort((mix64(values) & ~mask) | np.arange(n, dtype=np.uint64))
    same = (packed[1:] & ~mask) == (packed[:-1] & ~mask)
    some = np.zeros(n, bool)
    some[1:] |= same
    some[:-1] |= same
    index = (packed[some] & mask).astype(np.int64)
    if not len(index):
        return index, index
    index = index[np.lexsort((index, values[index]))]
    value = values[index]
    run = np.cumsum(np.concatenate([[True], value[1:] != value[:-1]])) - 1
    keep = np.bincount(run)[run] > 1
    return index[keep], run[keep]


def arrow_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in one Arrow array, and each text's first word's index
    (one more entry than texts). Nulls have no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.all():  # white space at an end of a text leaves an empty string
        flat = flat.filter(pa.array(real))
        before = np.concatenate([[0], np.cumsum(real)])
        offsets = before[offsets]
    return flat, offsets


def parts(batch: pa.RecordBatch, place: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows whose texts, column ``place``, have about ``most`` bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def bytes_of(texts: pa.Array) -> list:
    """The UTF-8 of each text, None for nulls."""
    return texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    return os.path.join(os.environ.get("MERIDIA_TOKENIZERS", "/opt/tokenizers"), name)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each node's component, for edges between 0..n-1."""
    label = np.arange(n)
    if not len(u):
        return label
    while True:
        lu, lv = label[u], label[v]
        low = np.minimum(lu, lv)
        new = label.copy()
        np.minimum.at(new, lu, low)
        np.minimum.at(new, lv, low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new
