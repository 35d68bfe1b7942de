"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.operators.layout import shared_dir, write_out

__all__ = ["shared_dir", "store", "write_out", "discard", "table", "text_rows", "text_buffer", "words_in", "mix64", "prefix_hash", "span_hash", "run_starts", "WORD_SPACE", "slices"]

#: The six bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WORD_SPACE)] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Arrow batches are kept small because texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string, null as empty): all that text operators look at, whatever else the table has."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Cut a batch into runs of rows whose ``column`` holds about ``most`` bytes; a longer row is a run of its own."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column without nulls, and where each row starts (one entry more than rows)."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    if data is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def words_in(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the joined bytes, and the row it belongs to. No word crosses a row."""
    solid = ~_IS_SPACE[buf]
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = solid.copy(), solid.copy()
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first[1:] &= ~solid[:-1] | cut[1:n]
    last[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit integers evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Spans are told apart modulo the prime 2**61 - 1, where no word is a multiple of another as it is modulo 2**64.
_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x1B7E151628AED2A6
_INVERSE = pow(_BASE, -1, (1 << 61) - 1)
#: Products are made for so many places at a time, whose intermediate results stay in the processor's cache.
_STEP = 1 << 16
_powers: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - _PRIME)  # a difference below zero wraps round to a large number


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2**31 for x below the prime, to be reduced."""
    return ((x & np.uint64((1 << 30) - 1)) << np.uint64(31)) + (x >> np.uint64(30))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> np.uint64(31), x & np.uint64((1 << 31) - 1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime."""
    (a1, a0), (b1, b0) = _halves(a), _halves(b)
    # 2**62 is 2 modulo the prime
    return _reduced(((a1 * b1) << np.uint64(1)) + _shifted(_reduced(a1 * b0 + a0 * b1)) + _reduced(a0 * b0))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64) if have is None else have
        while len(have) < max(n, _STEP):
            have = np.concatenate((have, _product(have, np.uint64(pow(base, len(have), int(_PRIME))))))
        _powers[base] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**61 - 1; span_hash() gets the hash of any span from them."""
    s = np.zeros(len(buf) + 1, np.uint64)
    power = _power(_BASE, len(buf))
    for at in range(0, len(buf), _STEP):
        value = buf[at:at + _STEP].astype(np.uint64) + np.uint64(1)
        high, low = (np.cumsum(x * value) for x in _halves(power[at:at + _STEP]))
        s[at + 1:at + 1 + len(value)] = _reduced(_shifted(_reduced(high)) + _reduced(low) + s[at])
    return s


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes between starts and ends, the same wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    back = _power(_INVERSE, len(prefix))
    for at in range(0, len(starts), _STEP):
        a, b = starts[at:at + _STEP], ends[at:at + _STEP]
        out[at:at + len(a)] = mix64(_product(_reduced(prefix[b] + (_PRIME - prefix[a])), back[a]))
    return out


def run_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a path of the shared folder names, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)


def discard(written: DataFrame) -> None:
    """Delete a table of write_out() that no later step reads, and let Spark drop the shuffles that made it.

    Spark deletes shuffle files once the driver's JVM has collected the plans that refer to them, which in a loop of
    rounds may be long after.
    """
    spark = written.sparkSession
    files = written.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark._jvm.System.gc()
