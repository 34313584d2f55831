"""Packing along a space-filling curve.

A document is encoded, its token ids are hashed into a vector of ``DIMENSIONS`` components, and the cells that the vector
falls in give a key on a Hilbert curve.  Documents sorted by the key are laid end to end and cut into sequences, so that
neighbours on the curve share sequences; only the very last sequence can be short.

Scale: the curve is cut into ranges at quantiles of the whole key, so that crowded cells are cut as finely as they need; a range
that still has many documents holds ties of one key (copies, or texts whose means agree) and is dealt into several by a hash of the
id, so that they don't meet in one task.  Only marks and sums of ranges (at most ``2 * MAX_RANGES``) reach the driver.

Defined results: a null text is empty and gives the end id only; repeated rows are packed each; an empty table gives no
piece; only id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import batches, in_small_batches, mix64, tidy, written
from siltstone.llm.tokens import Encoder

DIMENSIONS, BITS = 4, 10
#: Documents of a range, and the most ranges.
RANGE, MAX_RANGES = 1000, 1 << 14


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of integer cells (n x d, each below 2**bits)."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest level down
        p = np.uint64(q - 1)
        for i in range(len(x)):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for k in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> np.uint64(k)) & one != 0, np.uint64((1 << k) - 1), np.uint64(0))
    x = [v ^ t for v in x]
    key = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for v in x:
            key = (key << one) | ((v >> np.uint64(k)) & one)
    return key.astype(np.int64)


def directions(size: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed pseudo-random sign vector for each token id."""
    bits = mix64(np.arange(size, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (((bits[:, None] >> np.arange(dimensions, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1)


def document_keys(ids: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents: ids of all, and the number (1 at least) of each."""
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    cells = np.empty((len(counts), table.shape[1]), np.int64)
    for k in range(table.shape[1]):
        mean = np.add.reduceat(table[ids, k], begin, dtype=np.float64) / counts
        cells[:, k] = np.clip((np.tanh(3 * mean) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_key(cells, BITS)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, Hilbert key, n ids and the ids (little-endian, 2 bytes if they fit) of every row."""

    def encode(it):
        encoder = Encoder(tokenizer)
        vocab = max(encoder.tok.get_vocab_size(), end_id + 1)
        table, kind = directions(vocab), np.uint16 if vocab <= 1 << 16 else np.uint32
        for batch in it:
            for a, b in batches(batch.column(1).cast(pa.large_string()), 2 << 20):
                ids, counts = encoder.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                wide = ids.astype(kind)
                blobs = [wide[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(document_keys(ids, counts, table)), pa.array(counts), pa.array(blobs, pa.binary())], names=["doc_id", "hkey", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(encode), f"doc_id {kind}, hkey long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, as 4-byte integers)."""
    table = written(encoded(in_small_batches(docs), tokenizer, end_id, id_col, text_col), "packing")
    n = table.count()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE)))
    marks = table.agg(F.percentile_approx("hkey", [i / ranges for i in range(1, ranges)], 4 * ranges)).first()[0] if n and ranges > 1 else []
    marks = np.unique(np.array(marks, np.int64))

    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(marks, keys.to_numpy(), side="right").astype(np.int32))

    table = table.withColumn("_at", F.pandas_udf(place, "int")("hkey"))
    counts = {r["_at"]: r["c"] for r in table.groupBy("_at").agg(F.count("*").alias("c")).collect()}  # at most MAX_RANGES rows
    target = 4 * max(RANGE, -(-n // MAX_RANGES))
    parts = np.array([max(1, -(-counts.get(k, 0) // target)) for k in range(len(marks) + 1)], np.int64)
    base = np.concatenate(([0], np.cumsum(parts)))
    pick = lambda values: F.element_at(F.lit([int(v) for v in values]), F.col("_at") + 1)
    table = table.withColumn("_range", (pick(base[:-1]) + F.pmod(F.xxhash64("doc_id", "n"), pick(parts))).cast("int"))
    sums = np.zeros(int(base[-1]) + 1, np.int64)
    for r in table.groupBy("_range").agg(F.sum("n").alias("s")).collect():  # at most 2 * MAX_RANGES rows
        sums[r["_range"] + 1] = r["s"]
    first = np.cumsum(sums)  # ids before each range
    sent = table.sparkSession.sparkContext.broadcast(first)

    def cut(it):
        at, now = 0, None
        for batch in it:
            out: list[list] = [[] for _ in range(8)]
            for doc, n, ids, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if part != now:
                    now, at = part, int(sent.value[part])
                raw = ids.as_buffer()
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                start = 0
                while start < n:
                    size = min(n - start, length - at % length)
                    piece = ids[start : start + size].tobytes()
                    for column, value in zip(out, (doc, start, size, zlib.crc32(piece), n, at // length, at % length, piece if keep_ids else None), strict=True):
                        column.append(value)
                    start, at = start + size, at + size
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in out[0]], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in out[1:7]), *([pa.array(out[7], pa.binary())] if keep_ids else [])], names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join(f"`{c}` {kind if c == id_col else 'binary' if c == 'ids' else 'long'}" for c in names)
    ordered = table.repartition("_range").sortWithinPartitions("_range", "hkey", "doc_id", "n")
    return ordered.select("doc_id", "n", "ids", "_range").mapInArrow(tidy(cut), schema)
