"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import inspect
import re
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, as used by every word pattern ``[^\x20\x09-\x0D]+`` here.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only on one machine where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_siltstone_dir", None)
        if found is None:
            folder = tempfile.mkdtemp(prefix="siltstone-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = "file://" + folder
            spark.sparkContext._siltstone_dir = found
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/siltstone/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Plans of these nodes alone give the same rows in the same partitions each time they run.
_REPEATABLE = ("Project", "Filter", "LogicalRelation", "SubqueryAlias", "LocalRelation")


def repeatable(df: DataFrame, tag: str) -> DataFrame:
    """The table itself if it only reads files, else a written copy: passes that number rows must meet the same rows again."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in _REPEATABLE and not node.nodeName().startswith("Relation"):
            return written(df, tag)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return df


#: Rows of an Arrow batch, where the session has Spark's default of 10,000: whole texts make large batches.
BATCH_ROWS = 2000


def in_small_batches(df: DataFrame) -> DataFrame:
    """The table; batches sent to Python are kept small, so that a worker's memory is bounded by a few texts' size."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def tidy(f):
    """The function of a map over batches or groups, giving freed memory back to the system as it ends: workers live on."""
    if inspect.isgeneratorfunction(f):
        def batches_(it):
            try:
                yield from f(it)
            finally:
                _POWERS.clear()
                _release()

        return batches_

    def group(table):
        try:
            return f(table)
        finally:
            if time.monotonic() - _LAST[0] > 0.5:
                _release()

    return group


_LAST = [0.0]


def _release() -> None:
    _LAST[0] = time.monotonic()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Rows of one range of :func:`batches`.
MAX_ROWS = 1 << 14


def batches(column: pa.Array, limit: int = 4 << 20):
    """Yield (start, stop) row ranges of a string or binary column that hold at most ``limit`` bytes (one row at least)."""
    n = len(column)
    sizes = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    ends = np.frombuffer(sizes.buffers()[1], np.int64, n + 1, sizes.offset * 8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        stop = min(stop, n, start + MAX_ROWS)
        yield start, stop
        start = stop


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    return text.translate(LOWER_BYTES).split()


#: Odd 64-bit multiplier of the rolling word hash, its inverse modulo 2**64, and a fixed random value for each byte.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95 & (2**64 - 1)))
_POWERS: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        size = max(1 << 12, n + n // 8)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            more = min(done, size - done)
            have[done : done + more] = have[:more] * step
            done += more
        _POWERS[str(base)] = have
    return have[:n]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' UTF-8 bytes (null: empty) with one space after each, and the rows' start offsets (n + 1 of them)."""
    rows = [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer(b" ".join(rows) + b" ", np.uint8)
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in rows], out=starts[1:])
    return data, starts


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_TO_LOWER = np.frombuffer(LOWER_BYTES, np.uint8)


def word_hashes(data: np.ndarray, starts: np.ndarray, spans: bool = False, lower: bool = True) -> tuple:
    """64-bit hashes of all words of :func:`joined` rows (A-Z lower-cased), and the index of each row's first word (n + 1).

    With ``spans`` also the words' begins and ends in ``data``.
    """
    if len(starts) < 2:
        none = np.empty(0, np.int64)
        return (np.empty(0, np.uint64), np.zeros(len(starts), np.int64), *((none, none) if spans else ()))
    found, begins, ends = [], [], []
    i = 0
    while i < len(starts) - 1:  # rows of about a megabyte at a time stay in the cache
        j = min(max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 20), side="right")) - 1), len(starts) - 1)
        part = data[starts[i] : starts[j]]
        space = _IS_SPACE[part]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        begin, end = edge[0::2], edge[1::2]  # each row ends with a space
        values = _BYTES[_TO_LOWER[part] if lower else part]
        values *= powers(_INVERSE, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        hashes = (sums[end] - sums[begin]) * powers(_BASE, len(part))[begin]
        hashes += (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        found.append(mix64(hashes))
        begins.append(begin + starts[i])
        ends.append(end + starts[i])
        i = j
    hashes, begin = np.concatenate(found), np.concatenate(begins)
    return (hashes, np.searchsorted(begin, starts), *((begin, np.concatenate(ends)) if spans else ()))


def whole_numbers(docs: DataFrame, id_col: str) -> DataFrame:
    """The table, if its ids are whole numbers, which are compared and sent as 8-byte integers; an error at once if not."""
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be whole numbers, but {id_col} is {kind}; number the rows first")
    return docs
