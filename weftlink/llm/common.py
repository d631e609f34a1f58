"""Shared pieces of the training-data operators.

Conventions held by every operator of this subpackage:

* only the columns an operator names are read, under internal names, so further
  columns with clashing names in the input do no harm;
* a null text counts as the empty text unless an operator says otherwise;
* what has to survive a lost executor is written to the folder named by
  ``spark.checkpoint.dir`` (``checkpoint()`` or Parquet), never to a local one.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Bytes handled at once by the vectorised text routines.
BLOCK = 1 << 20
#: Rows of an Arrow batch, where the session has not chosen less: texts can be long.
BATCH_ROWS = 2000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Where none is configured, a fresh temporary one on a single machine, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="weftlink-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed and kept in the shared folder; lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """As ``cut`` by a compressed Parquet table in the shared folder: for wide rows. ``discard`` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftlink-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs; Spark drops them once their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key of more rows than this, and than all rows over ``HOT_KEYS``, is hot: there are at most ``HOT_KEYS`` such keys.
HOT, HOT_KEYS = 1000, 1000


def join_hot(rows: DataFrame, found: DataFrame, key: str, times: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, one row a key; ``times`` are a key's rows, which sum to ``total`` at most.

    What was found for hot keys is broadcast, so that their rows stay where they are; the others meet by a shuffle.
    """
    most = max(HOT, total // HOT_KEYS)
    if total > most:
        hot = cut(found.where(F.col(times) > most).drop(times))
        if not hot.isEmpty():
            rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.drop(times), key, how)
            return rows.join(F.broadcast(hot), key).unionByName(rest)
    return rows.join(found.drop(times), key, how)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, BLOCK + 1), base, dtype=_U)
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def text_bytes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end and the offset of each; null counts as empty. lower: A-Z only."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    if lower and len(raw):
        raw = raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
    return raw, at - at[0]


def runs(raw: np.ndarray, at: np.ndarray, broken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each longest run of bytes that are not ``broken``; runs end with their text."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.ones(n + 1, bool)
    edge[1:n] = broken[:-1]
    edge[at[:-1]] = True
    starts = np.flatnonzero(~broken & edge[:n])
    edge[:] = True
    edge[1:n] = broken[1:]
    edge[at] = True
    ends = np.flatnonzero(~broken & edge[1:]) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, in blocks of bounded size."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        lo, hi = starts[i], ends[j - 1]
        with np.errstate(over="ignore"):
            sums = np.empty(hi - lo + 1, _U)
            sums[0] = 0
            np.cumsum((raw[lo:hi].astype(_U) + _U(1)) * _power(_BASE, hi - lo, "p"), out=sums[1:])
            value = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * _power(_INVERSE, hi - lo + 1, "q")[starts[i:j] - lo]
            out[i:j] = mix(value + (ends[i:j] - starts[i:j]).astype(_U))
        i = j
    return out


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def slices(batch: pa.RecordBatch, column: str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of ``column`` each; a longer text makes a piece of its own."""
    sizes = np.fromiter((len(x) for x in _views(batch.column(column))), np.int64, len(batch))
    i = 0
    while i < len(batch):
        ends = np.cumsum(sizes[i:])
        j = i + max(1, int(np.searchsorted(ends, most, side="right")))
        yield batch.slice(i, j - i)
        i = j


class _views:
    """Byte lengths of an Arrow string column, as ranges."""

    def __init__(self, column: pa.Array):
        _, self.at = text_bytes(column, False)

    def __iter__(self):
        return (range(int(a), int(b)) for a, b in zip(self.at[:-1], self.at[1:], strict=True))


def code_points(raw: np.ndarray) -> np.ndarray:
    """Code points in each prefix of the bytes."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def words_of(text) -> F.Column:
    """Words of a text column: runs of ``[^\\x20\\x09-\\x0D]``, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda x: x != "")
