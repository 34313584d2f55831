"""Removal of repeated passages: every byte covered by a ``LENGTH``-byte string that also starts earlier.

Suffixes are sorted blockwise with a cover sample, as in Kaerkkaeinen's construction in small space, to the depth that the
question needs.  The cover is set by content: in each window of ``LENGTH`` bytes the ``GRAM``-byte string of least hash (the
leftmost of several) is a cover position.  Equal windows have a cover position at equal offsets, which is the property
a difference cover modulo v gives the construction, with 3 % of all positions instead of the 14 % and more of a positional
cover of this period.  Windows are told apart by what lies before their cover position and by the rank of the suffix that starts there:

1. Each cover position's *core*, the bytes that all its windows hold, is hashed; shards count the hashes, and a split learns
   which of its cores occur twice at least.  All other windows are unique and go no further.
2. What the windows of a repeated core span is sent to the core's shard, once a split.  A shard sorts the suffixes at its cover
   positions, and the reversed texts before them, each once, with the longest common prefixes of neighbours: the precomputed
   ranks.  Then it takes one bucket of windows, those of one offset to the cover position, at a time; ties are resolved by the
   ranks, cut to the bucket's depth, and the earliest place of every class of equal windows is found.
3. Splits are told, a bit a window, whether an earlier place exists, and remove what these windows cover.

Comparisons are on bytes: hashes (of 48 bits) only choose candidates, and strings of a split that share one are compared.  A core
with more than ``HOT`` places is cut into finer cores, which spread over the shards and are resolved in two steps: of the equal
strings of a group of splits, of which there are about as many as splits in a group, only the earliest goes on to the shard.  So
a passage that stands in every split is one string a group there.  No document, passage or group of copies is gathered in one
task, and nothing but numbers reaches the driver.

Defined results: a null text is empty; texts shorter than ``LENGTH`` bytes are kept whole; places are (id, start), null ids first,
and rows that repeat an id share their places, so that neither removes the other's bytes; an id must be a whole number (a
TypeError tells if the column isn't); an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.shared import _BASE, _BYTES, _INVERSE, batches, in_small_batches, mix64, powers, repeatable, tidy, whole_numbers, written

LENGTH, GRAM, SPLIT, HOT, FINE = 100, 32, 2 << 20, 4096, 5
SPAN = LENGTH - GRAM + 1  # places of a gram in a window
HALF = SPAN // 2 + 1  # offsets below it share one core, the others another
KEY = 48
_LOW = np.uint64((1 << KEY) - 1)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def covers(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cover positions, first and last window start of each) of documents laid end to end."""
    found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
    i = 0
    while i < len(starts) - 1:
        j = min(max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 19), side="right")) - 1), len(starts) - 1)
        base, part = int(starts[i]), data[starts[i] : starts[j]]
        n = len(part)
        if n >= LENGTH:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[part] * powers(_INVERSE, n), out=sums[1:])
            key = (sums[GRAM:] - sums[:-GRAM]) * powers(_BASE, n)[: n - GRAM + 1]
            key ^= key >> np.uint64(29)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            key &= _HIGH
            key |= np.arange(len(key), dtype=np.uint64)
            width = 1
            while 2 * width <= SPAN:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            rest = SPAN - width
            least = np.minimum(key[:-rest], key[rest:]) if rest else key
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            bad = np.zeros(len(at) + LENGTH, np.int8)  # windows that leave their document
            for e in (starts[i + 1 : j] - base).tolist():
                bad[max(0, e - LENGTH + 1) : e] = 1
            ok = np.flatnonzero(bad[: len(at)] == 0)
            if len(ok):
                edge = np.flatnonzero((np.diff(at[ok]) != 0) | (np.diff(ok) != 1))
                first, last = np.concatenate(([0], edge + 1)), np.concatenate((edge, [len(ok) - 1]))
                for column, value in zip(found, (at[ok[first]], ok[first], ok[last]), strict=True):
                    column.append(value + base)
        i = j
    return tuple(np.concatenate(c) for c in found)


class Split:
    """Some documents in the order of their ids, and the units (cover position, least and greatest offset) of their windows."""

    def __init__(self, ids: np.ndarray, texts: list[bytes | None]):
        order = np.argsort(ids, kind="stable")
        self.order = order
        texts = [texts[i] or b"" for i in order]
        self.ids = ids[order]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        at, first, last = covers(self.data, self.starts)
        low, high = at - last, at - first
        near, far = np.flatnonzero(low < HALF), np.flatnonzero(high >= HALF)
        self.at = np.concatenate((at[near], at[far]))
        self.low = np.concatenate((low[near], np.maximum(low[far], HALF)))
        self.high = np.concatenate((np.minimum(high[near], HALF - 1), high[far]))
        n = len(self.data)
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum(_BYTES[self.data] * powers(_INVERSE, n), out=self.sums[1:])
        far_ = self.low >= HALF
        self.core = self.hashed(self.at - np.where(far_, HALF, 0), self.at + LENGTH - np.where(far_, SPAN - 1, HALF - 1))
        self.keys, self.which = np.unique(self.core, return_inverse=True)

    def hashed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the strings from a to b."""
        n = len(self.data)
        return mix64((self.sums[b] - self.sums[a]) * powers(_BASE, n + 1)[a] + (b - a).astype(np.uint64)) & _LOW

    def units(self, flags: np.ndarray) -> None:
        """Keep the units whose core occurs twice (flag 1); cut those of hot cores (flag 2) into finer ones; find equal ones."""
        flag = flags[self.which]
        keep, hot = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
        at, low, high, core = [self.at[keep]], [self.low[keep]], [self.high[keep]], [self.core[keep]]
        whole = len(keep)
        for f in range(0, SPAN, FINE):
            a, l, h = self.at[hot], np.maximum(self.low[hot], f), np.minimum(self.high[hot], f + FINE - 1)
            some = l <= h
            a, l, h = a[some], l[some], h[some]
            at, low, high = [*at, a], [*low, l], [*high, h]
            core.append(self.hashed(a - f, a + LENGTH - np.minimum(f + FINE - 1, LENGTH - 1)) ^ np.uint64(f + 1) if len(a) else np.empty(0, np.uint64))
        self.at, self.low, self.high, self.core = (np.concatenate(x) for x in (at, low, high, core))
        self.fine = np.arange(len(self.at)) >= whole
        text = mix64(self.hashed(self.at - self.high, self.at + LENGTH - self.low) + (self.low * 128 + self.high).astype(np.uint64)) ^ mix64(self.core)
        order = np.lexsort((self.at, text))
        new = np.concatenate(([True], text[order][1:] != text[order][:-1])) if len(order) else np.empty(0, bool)
        old = np.flatnonzero(~new)
        new[old] = ~self._equal(order[old], order[old - 1])
        self.first = order[new]  # the earliest place of each string
        self.member = np.empty(len(order), np.int64)
        self.member[order] = np.cumsum(new) - 1
        rank = np.lexsort((self.first, self.core[self.first], self.fine[self.first]))
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        self.first, self.member = self.first[rank], back[self.member]

    def dealt(self, shards: int) -> np.ndarray:
        """Bounds, in ``first``, of the shards of whole cores, and after them of those of fine cores."""
        return np.searchsorted(shard_of(self.core[self.first], shards) + shards * self.fine[self.first], np.arange(2 * shards + 1))

    def _equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the strings of two units, and the places of the cover positions in them, are equal."""
        out = (self.low[x] == self.low[y]) & (self.high[x] == self.high[y])
        a, b, size = self.at[x] - self.high[x], self.at[y] - self.high[y], LENGTH - self.low[x] + self.high[x]
        for k in range(int(size.max()) if len(size) else 0):
            on = np.flatnonzero(out & (size > k))
            out[on] = self.data[a[on] + k] == self.data[b[on] + k]
        return out

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, offset) of positions."""
        row = np.searchsorted(self.starts, at, side="right") - 1
        return self.ids[row], at - self.starts[row]

    def covered(self, told: np.ndarray) -> np.ndarray:
        """Which bytes go; told: a bit for each offset of each string of ``first``, set if an earlier place exists."""
        n = len(self.data)
        change = np.zeros(n + 1, np.int32)
        head = self.first[self.member]
        id_, off = self.place(self.at)
        later = (id_ > id_[head]) | ((id_ == id_[head]) & (off > off[head]))
        bits = np.where(later, np.uint64(2**64 - 1), told[self.member])
        for k in range(HALF):
            on = np.flatnonzero((self.low + k <= self.high) & ((bits >> np.uint64(k)) & np.uint64(1) == 1))
            s = self.at[on] - self.low[on] - k
            np.add.at(change, s, 1)
            np.add.at(change, s + LENGTH, -1)
        return np.cumsum(change[:n]) > 0


def _matrix(data: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes read from ``begin`` in the direction of ``step``, padded with zeros."""
    width = int(size.max()) if len(size) else 0
    out = np.zeros((len(begin), max(1, width)), np.uint8)
    for k in range(width):
        on = size > k
        out[on, k] = data[begin[on] + step * k]
    return out


def _ranks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each row with the one before it in the order) of rows of bytes."""
    pad = -rows.shape[1] % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    sorted_ = rows[order]
    common = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = sorted_[1:] != sorted_[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, common


def resolve(data: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For strings of a shard, with their earliest places, a bit for each offset: whether an equal window starts earlier."""
    n = len(size)
    out = np.zeros(n, np.uint64)
    begin = np.cumsum(size) - size
    at = begin + high  # cover positions
    right, right_common = _ranks(_matrix(data, at, LENGTH - low, 1))
    left, left_common = _ranks(_matrix(data, at - 1, high, -1))
    place = np.empty(n, np.int64)
    order = np.lexsort((offs, ids))
    place[order] = np.cumsum(np.concatenate(([True], (np.diff(ids[order]) != 0) | (np.diff(offs[order]) != 0)))) if n else 0
    name = np.empty((2, n), np.int64)
    for offset in range(int(low.min()) if n else 0, int(high.max()) + 1 if n else 0):  # one bucket at a time
        on = np.flatnonzero((low <= offset) & (offset <= high))
        if len(on) < 2:
            continue
        name[0, right] = np.cumsum(right_common < LENGTH - offset)
        name[1, left] = np.cumsum(left_common < offset)
        key = name[0, on] * (n + 1) + name[1, on]
        o = np.lexsort((place[on], key))
        k, p = key[o], place[on][o]
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        least = np.repeat(p[head], np.diff(np.append(head, len(o))))
        hit = on[o[p > least]]
        out[hit] |= np.uint64(1) << (offset - low[hit]).astype(np.uint64)
    return out


def later(data: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, core: np.ndarray, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which strings have an equal one, with equal offsets and core, at an earlier place."""
    n = len(size)
    if not n:
        return np.empty(0, bool)
    ends = [x.astype(np.uint8)[:, None] for x in (low, high)]
    rows = np.hstack([_matrix(data, np.cumsum(size) - size, size, 1), *ends, np.ascontiguousarray(core, np.uint64).view(np.uint8).reshape(n, 8)])
    _, which = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((offs, ids, which))
    head = np.flatnonzero(np.concatenate(([True], np.diff(which[order]) != 0)))
    least = np.empty(n, np.int64)
    least[order] = np.repeat(order[head], np.diff(np.append(head, n)))
    return (ids > ids[least]) | ((ids == ids[least]) & (offs > offs[least]))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, : KEY // 8].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // (KEY // 8), 8), np.uint8)
    out[:, : KEY // 8] = np.frombuffer(data, np.uint8).reshape(-1, KEY // 8)
    return out.view(np.uint64).ravel()


def _zip(values: np.ndarray, kind=np.uint8) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, kind).tobytes())


def _unzip(data: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _rows(batch: pa.RecordBatch):
    """(key of the split, range of rows) of a batch of (row, doc_id, text)."""
    for a, b in batches(batch.column(2).cast(pa.large_binary()), SPLIT):
        yield batch.column(0)[a].as_py(), a, b


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _table(columns: dict) -> pa.Table:
    return pa.table({n: pa.array(v, t) for n, (v, t) in columns.items()})


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row (and kept, the bytes that stay, and columns to carry along)."""
    spark, docs = docs.sparkSession, repeatable(in_small_batches(whole_numbers(docs, id_col)).select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col, *carry))]), "passage-input")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest") if carry else F.lit(None).cast("string").alias("rest"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = base.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(shards, -(-size // (24 << 20)), 1)

    def cores(it):
        for batch in it:
            for key, a, b in _rows(batch):
                s = Split(_ids(batch.column(1).slice(a, b - a)), batch.column(2).slice(a, b - a).to_pylist())
                many = np.minimum(np.bincount(s.which, minlength=len(s.keys)), HOT + 1)
                bound = np.searchsorted(shard_of(s.keys, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(bound)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([key] * len(some), pa.int64()), pa.array([_pack(s.keys[bound[i] : bound[i + 1]]) for i in some], pa.binary()), pa.array([_zip(many[bound[i] : bound[i + 1]], np.uint16) for i in some], pa.binary())], names=["shard", "split", "keys", "many"])

    def count(table: pa.Table) -> pa.Table:
        keys = [_unpack(x) for x in table["keys"].to_pylist()]
        many = np.concatenate([_unzip(x, np.uint16) for x in table["many"].to_pylist()]).astype(np.int64)
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(which, many)[which]
        flags = np.split(np.where(sums > HOT, 2, sums > 1).astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])
        return _table({"kind": (["flags"] * len(keys), pa.string()), "split": (table["split"].to_pylist(), pa.int64()), "shard": (table["shard"].to_pylist(), pa.int32()), "data": ([_zip(f) for f in flags], pa.binary())})

    told = "kind string, split long, shard int, data binary"
    flags = written(base.drop("rest").mapInArrow(tidy(cores), "shard int, split long, keys binary, many binary").groupBy("shard").applyInArrow(tidy(count), told), "passage-flags")

    def send(it):
        for batch in it:
            for key, a, b in _rows(batch):
                out = pa.BufferOutputStream()
                part = batch.slice(a, b - a)
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array(["text"]), pa.array([key], pa.int64()), pa.array([0], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["kind", "split", "shard", "data"])

    texts = base.mapInArrow(tidy(send), told)

    def opened(table: pa.Table) -> tuple[Split, pa.Table, dict]:
        got = {(k, i): x for k, i, x in zip(table["kind"].to_pylist(), table["shard"].to_pylist(), table["data"].to_pylist(), strict=True)}
        part = pa.ipc.open_stream(got["text", 0]).read_all()
        s = Split(_ids(part["doc_id"].combine_chunks()), part["text"].to_pylist())
        bound = np.searchsorted(shard_of(s.keys, shards), np.arange(shards + 1))
        s.units(np.concatenate([np.empty(0, np.uint8)] + [_unzip(got["flags", i]) for i in np.flatnonzero(np.diff(bound)).tolist()]))
        return s, part, got

    groups = max(1, math.isqrt(size // SPLIT))  # of splits
    row_types = {"shard": pa.int32(), "split": pa.int64(), "core": pa.binary(), "text": pa.binary(), "low": pa.binary(), "high": pa.binary(), "ids": pa.binary(), "offs": pa.binary(), "n": pa.int64()}

    def packed(shard: int, split: int, core: np.ndarray, text: bytes, low: np.ndarray, high: np.ndarray, ids: np.ndarray, offs: np.ndarray) -> tuple:
        return shard, split, _pack(core), zstandard.ZstdCompressor(level=3).compress(text), low.astype(np.uint8).tobytes(), high.astype(np.uint8).tobytes(), _zip(ids, np.int64), _zip(offs, np.uint32), len(core)

    def unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
        """(core, data, low, high, ids, offs) of all strings of the rows."""
        get = lambda c: table[c].to_pylist()
        low, high = (np.concatenate([np.frombuffer(x, np.uint8) for x in get(c)]).astype(np.int64) for c in ("low", "high"))
        ids, offs = np.concatenate([_unzip(x, np.int64) for x in get("ids")]), np.concatenate([_unzip(x, np.uint32) for x in get("offs")]).astype(np.int64)
        return np.concatenate([_unpack(x) for x in get("core")]), np.concatenate([_unzip(x) for x in get("text")]), low, high, ids, offs

    def as_rows(rows: list[tuple]) -> pa.Table:
        return _table({c: ([r[k] for r in rows], t) for k, (c, t) in enumerate(row_types.items())})

    def answer(kind: str, table: pa.Table, parts: list[bytes]) -> pa.Table:
        return _table({"kind": ([kind] * len(parts), pa.string()), "split": (table["split"].to_pylist(), pa.int64()), "shard": (table["shard"].to_pylist(), pa.int32()), "data": (parts, pa.binary())})

    def strings(table: pa.Table) -> pa.Table:
        s, _, _ = opened(table)
        key = table["split"][0].as_py()
        bound = s.dealt(shards)
        raw, out = s.data.tobytes(), []
        for i in np.flatnonzero(np.diff(bound)).tolist():
            unit = s.first[bound[i] : bound[i + 1]]
            at, low, high = s.at[unit], s.low[unit], s.high[unit]
            text = b"".join([raw[a:b] for a, b in zip((at - high).tolist(), (at + LENGTH - low).tolist(), strict=True)])
            out.append(packed(i, key, s.core[unit], text, low, high, *s.place(at)))
        return as_rows(out)

    def rank(table: pa.Table) -> pa.Table:
        core, data, low, high, ids, offs = unpacked(table)
        size = high - low + LENGTH
        begin = np.cumsum(size) - size
        bits = np.zeros(len(core), np.uint64)
        order = np.argsort(core, kind="stable")
        edge = np.append(np.flatnonzero(np.concatenate(([True], core[order][1:] != core[order][:-1]))), len(core))
        blocks = np.unique(np.append(edge[np.searchsorted(edge, np.arange(0, len(core), 40_000))], len(core)))
        for a, b in zip(blocks[:-1], blocks[1:], strict=True):  # whole cores, some at a time
            rows = order[a:b]
            where = np.arange(int(size[rows].sum())) + np.repeat(begin[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows])
            bits[rows] = resolve(data[where], size[rows], low[rows], high[rows], ids[rows], offs[rows])
        return answer("bits", table, [_zip(x, np.uint64) for x in np.split(bits, np.cumsum(table["n"].to_pylist())[:-1])])

    def earliest(table: pa.Table) -> pa.Table:
        """Of fine cores: which strings of a group of splits have an earlier equal one there, and the others, for their shards."""
        core, data, low, high, ids, offs = unpacked(table)
        size = high - low + LENGTH
        gone = later(data, size, low, high, core, ids, offs)
        begin, raw = np.cumsum(size) - size, data.tobytes()
        bound = np.concatenate(([0], np.cumsum(table["n"].to_pylist()))).tolist()
        told, rest = [], []
        for a, b, shard, split in zip(bound[:-1], bound[1:], table["shard"].to_pylist(), table["split"].to_pylist(), strict=True):
            told.append(_zip(gone[a:b]))
            on = a + np.flatnonzero(~gone[a:b])
            text = b"".join([raw[x : x + n] for x, n in zip(begin[on].tolist(), size[on].tolist(), strict=True)])
            out = pa.BufferOutputStream()
            row = as_rows([packed(shard, split, core[on], text, low[on], high[on], ids[on], offs[on])] if len(on) else [])
            with pa.ipc.new_stream(out, row.schema) as w:
                w.write_table(row)
            rest.append(out.getvalue().to_pybytes())
        return pa.concat_tables([answer("early", table, told), answer("rest", table, rest)])

    def resolved(table: pa.Table) -> pa.Table:
        return earliest(table) if table["shard"][0].as_py() >= shards else rank(table)

    def rank_rest(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table["data"].to_pylist()])
        return rank(rows) if rows.num_rows else answer("bits", rows, [])

    sent = texts.unionByName(flags).groupBy("split").applyInArrow(tidy(strings), "shard int, split long, core binary, text binary, low binary, high binary, ids binary, offs binary, n long")
    group = F.when(F.col("shard") >= shards, F.pmod(F.xxhash64("split"), F.lit(groups)))
    first = written(sent.groupBy("shard", group.alias("group")).applyInArrow(tidy(resolved), told), "passage-bits")
    second = written(first.where("kind = 'rest'").groupBy("shard").applyInArrow(tidy(rank_rest), told), "passage-fine-bits")
    answers = first.where("kind <> 'rest'").unionByName(second)

    def remove(table: pa.Table) -> pa.Table:
        s, part, got = opened(table)
        bits = [np.empty(0, np.uint64)]
        for i in np.flatnonzero(np.diff(s.dealt(shards))).tolist():
            if i < shards:
                bits.append(_unzip(got["bits", i], np.uint64))
                continue
            early = _unzip(got["early", i]) > 0
            bits.append(np.full(len(early), 2**64 - 1, np.uint64))
            if not early.all():
                bits[-1][~early] = _unzip(got["bits", i], np.uint64)
        gone = s.covered(np.concatenate(bits))
        out: list[list] = [[], [], [], [], []]
        for a, b in zip(s.starts[:-1], s.starts[1:], strict=True):
            g, text = gone[a:b], s.data[a:b]
            kept = text[~g].tobytes()
            for column, value in zip(out, (b - a, int(g.sum()), int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        result = {"row": part["row"].take(pa.array(s.order)), "doc_id": part["doc_id"].take(pa.array(s.order))}
        for n, c, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True):
            if n != "kept" or keep_text:
                result[n] = pa.array(c, t)
        if carry:
            result["rest"] = part["rest"].take(pa.array(s.order))
        return pa.table(result)

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    schema = schema.add("kept", T.BinaryType()) if keep_text else schema
    schema = schema.add("rest", base.schema["rest"].dataType) if carry else schema
    return texts.unionByName(flags).unionByName(answers).groupBy("split").applyInArrow(tidy(remove), schema).withColumnRenamed("doc_id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with the same columns, after repeated passages are removed (bytes of a character cut in two go as well)."""
    out = deduplicated(docs, id_col, text_col, keep_text=True, carry=[c for c in docs.columns if c not in (id_col, text_col)])
    def decoded(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))

    text = F.when(F.col("n_removed") > 0, F.pandas_udf(decoded, "string")("kept")).otherwise(F.col("kept").cast("string"))
    pick = {id_col: F.col(id_col), text_col: text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[(pick[c] if c in pick else F.col("rest").getField(c)).alias(c) for c in docs.columns])

