"""Content-addressed store of token ids.

Rolling hashes cut a document's id stream into chunks at places that its content sets, so that equal passages give equal
chunks.  Unique chunks are stored once under their digests; a document is a recipe, the list of its chunks' digests, with
the root of their Merkle tree; a manifest has the roots of all recipes, and one root above them.

Files (Parquet, in ``path``):

* ``chunks`` (shard, digests, lengths, ids): some chunks of a shard a row, their 16-byte digests, 2-byte lengths and
  little-endian 2- or 4-byte ids laid end to end, the ids compressed;
* ``recipes`` (range, place, before, doc_id, row, n_tokens, digests, lengths, root), in ascending doc_id order: the recipes are
  cut into ranges, each in one file; place and before are the numbers of documents and ids before it in its range;
* ``manifest`` (level, range, part, documents, tokens, shards, root): level 0 for each PART recipes of a range, 1 for each range, 2
  for the whole store.

Reading works the manifest out anew from the recipes and fails on any difference; it holds every chunk against its digest and
every recipe against its root; and it rebuilds the ids, failing where a chunk is missing.

Scale: what is exchanged is packed, one row a batch and shard.  A chunk is sent once a task, and kept once as its shard's rows
stream by, so that a task remembers one shard's digests only, however often a chunk occurs.  To rebuild, a block of recipes asks
each shard once for each different chunk, and the shards stream their answers.  A few numbers a range (at most RANGES) reach
the driver.

Defined results: a null text is empty and has the end id only; repeated rows get a recipe each (told apart by ``row``); ids of any
type that Spark orders are allowed, null ids come first; an empty table gives an empty store; only id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.shared import batches, in_small_batches, mix64, new_path, tidy
from siltstone.llm.tokens import Encoder

#: A chunk ends where the hash of the last WINDOW ids has MASK bits zero; lengths are held within LEAST and MOST.
WINDOW, MASK, LEAST, MOST = 4, np.uint64(255), 64, 2048
DIGEST = 16
#: Bytes of text a shard of chunks; ids a stored row of chunks, and a block of recipes that is rebuilt at once.
SHARD, ROW, BLOCK = 24 << 20, 1 << 21, 1 << 22
#: Recipes a range (RANGES at most) and a part of a range.
RANGE, RANGES, PART = 20_000, 8192, 1 << 12
#: Digests a task remembers not to send a chunk twice.
SENT = 500_000


def cuts(ids: np.ndarray, counts: np.ndarray) -> tuple[list[int], list[int]]:
    """(ends of the chunks, number of chunks of each document) of documents of so many ids, laid end to end.

    The hash at a document's first ids looks back into the one before it, but no chunk is so short.
    """
    wide = mix64(ids.astype(np.uint64) + np.uint64(1))
    rolling = wide.copy()
    for k in range(1, WINDOW):
        rolling[k:] += wide[:-k] * np.uint64(2 * k + 1)
    marks = (np.flatnonzero(mix64(rolling) & MASK == 0) + 1).tolist()
    ends, many, last, i = [], [], 0, 0
    for stop in np.cumsum(counts).tolist():
        first = len(ends)
        while last < stop:
            while i < len(marks) and marks[i] < min(stop, last + LEAST):
                i += 1
            last = min(marks[i] if i < len(marks) else stop, stop, last + MOST)
            ends.append(last)
        many.append(len(ends) - first)
    return ends, many


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary Merkle tree; a level's odd last node moves up as it is."""
    level = list(leaves) or [b""]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _each(digests: bytes) -> list[bytes]:
    return [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]


def _shard_of(digests: bytes, shards: int) -> np.ndarray:
    """The shard of each digest: ranges of its first four bytes."""
    high = np.frombuffer(digests, "<u4").reshape(-1, DIGEST // 4)[:, 0].astype(np.uint64)
    return (high * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _Chunks:
    """Chunks laid end to end: their digests, their lengths in ids, and the bytes of their ids."""

    def __init__(self):
        self.digests, self.lengths, self.data, self.size = [], [], [], 0

    def add(self, d: bytes, length: int, data: bytes) -> None:
        self.digests.append(d)
        self.lengths.append(length)
        self.data.append(data)
        self.size += length

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return b"".join(self.digests), np.array(self.lengths, "<u2").tobytes(), _zip(b"".join(self.data))

    @staticmethod
    def opened(digests: bytes, lengths: bytes, ids: bytes) -> list[tuple[bytes, int, bytes]]:
        """(digest, length, bytes of the ids) of each chunk."""
        data, sizes = _unzip(ids), np.frombuffer(lengths, "<u2").astype(np.int64)
        width = len(data) // max(1, int(sizes.sum()))
        ends = (np.cumsum(sizes) * width).tolist()
        return [(d, n, data[a:b]) for d, n, a, b in zip(_each(digests), sizes.tolist(), [0, *ends], ends, strict=False)]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _struct(fields: str, *more: T.StructField) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(fields), *more])


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write the store to ``path``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    id_field = T.StructField("doc_id", docs.schema[id_col].dataType)
    made_schema = _struct("kind string, shard int, digests binary, lengths binary, ids binary, row long, n_tokens long, root binary", id_field)
    made_arrow = _arrow(made_schema)

    def encode(it):
        encoder, sent = Encoder(tokenizer), set()
        kind = "<u2" if max(encoder.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in it:
            for a, b in batches(batch.column(2).cast(pa.large_string()), 4 << 20):
                part = batch.slice(a, b - a)
                ids, counts = encoder.encode(part.column(2))
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                ends, many = cuts(ids, counts)
                width = np.dtype(kind).itemsize
                raw, begins = ids.astype(kind).tobytes(), [0, *ends[:-1]]
                digests = [digest(raw[x * width : y * width]) for x, y in zip(begins, ends, strict=True)]
                lengths = np.diff(ends, prepend=0).astype("<u2")
                new: dict[int, _Chunks] = {}
                for d, shard, n, x in zip(digests, _shard_of(b"".join(digests), shards).tolist(), lengths.tolist(), begins, strict=True):
                    if d not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(d)
                        new.setdefault(shard, _Chunks()).add(d, n, raw[x * width : (x + n) * width])
                rows = [("chunk", shard, *c.packed(), None, None, None, None) for shard, c in new.items()]
                at = 0
                for doc, row, n, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), counts.tolist(), many, strict=True):
                    own = digests[at : at + m]
                    rows.append(("recipe", row % shards, b"".join(own), lengths[at : at + m].tobytes(), None, row, n, merkle_root(own), doc))
                    at += m
                yield _batch(rows, made_arrow)

    def once(it):
        """Rows of one shard follow each other: each chunk stays once, and rows are packed anew."""
        shard, seen, open_ = None, set(), _Chunks()
        close = lambda: _batch([("chunk", shard, *open_.packed(), None, None, None, None)] if open_.size else [], made_arrow)
        for batch in it:
            kinds = batch.column(0).to_pylist()
            yield batch.filter(pa.array([k == "recipe" for k in kinds]))
            for k, s, *packed in zip(kinds, *(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if k == "recipe":
                    continue
                if s != shard or open_.size >= ROW:
                    yield close()
                    open_ = _Chunks()
                if s != shard:
                    shard, seen = s, set()
                for d, n, data in _Chunks.opened(*packed):
                    if d not in seen:
                        seen.add(d)
                        open_.add(d, n, data)
        yield close()

    rows = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("_text"))
    made = rows.mapInArrow(tidy(encode), made_schema).repartition(shards, "shard").sortWithinPartitions("kind", "shard").mapInArrow(tidy(once), made_schema)
    stage = new_path(spark, "store")
    made.write.option("compression", "zstd").partitionBy("kind").parquet(stage)
    _move(spark, f"{stage}/kind=chunk", f"{path}/chunks", _CHUNKS)
    recipes = _read(spark, f"{stage}/kind=recipe", _struct("digests binary, lengths binary, row long, n_tokens long, root binary", id_field))
    ranges = max(1, min(RANGES, -(-recipes.count() // RANGE)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    numbered = _struct("range int, place long, before long", id_field, *T.StructType.fromDDL("row long, n_tokens long, digests binary, lengths binary, root binary"))

    def number(it):
        place = before = 0
        for batch in it:
            n = batch.column(3).to_numpy()
            ends = np.cumsum(n) + before
            columns = [batch.column(0), pa.array(np.arange(place, place + len(n))), pa.array(ends - n), *batch.columns[1:]]
            place, before = place + len(n), int(ends[-1]) if len(n) else before
            yield pa.RecordBatch.from_arrays(columns, names=numbered.names)

    ordered = recipes.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("range"), "doc_id", "row", "n_tokens", "digests", "lengths", "root")
    ordered.mapInArrow(tidy(number), numbered).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark.read.schema(numbered).parquet(f"{path}/recipes"), shards).write.parquet(f"{path}/manifest")


_CHUNKS = "shard int, digests binary, lengths binary, ids binary"
_MANIFEST = "level int, range int, part long, documents long, tokens long, shards int, root binary"


def _move(spark: SparkSession, old: str, new: str, schema: str) -> None:
    """Rename a finished folder (no copy); an empty table takes the place of a missing one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = source.getFileSystem(conf)
    if not fs.exists(source):
        spark.createDataFrame([], schema).write.parquet(new)
        return
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{old} can't be moved to {new}")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _manifest(recipes: DataFrame, shards: int) -> DataFrame:
    """Merkle roots of the parts (PART recipes each), of the ranges above them, and of the store."""

    arrow = _arrow(_struct(_MANIFEST))

    def above(level: int, key: str, docs: str):
        def root(table: pa.Table) -> pa.Table:
            table = table.sort_by(key)
            total = lambda c: table[c].to_numpy().sum()
            row = (level, table["range"][0].as_py(), -1 if level else table["part"][0].as_py(), int(total(docs)) if level else len(table), int(total("tokens")), shards, merkle_root(table["root"].to_pylist()))
            return pa.Table.from_batches([_batch([row], arrow)])

        return tidy(root)

    parts = recipes.select("range", F.floor(F.col("place") / PART).cast("long").alias("part"), "place", F.col("n_tokens").alias("tokens"), "root").groupBy("range", "part").applyInArrow(above(0, "place", ""), _MANIFEST)
    ranges = parts.groupBy("range").applyInArrow(above(1, "part", "documents"), _MANIFEST)
    rows = sorted(map(tuple, ranges.collect()), key=lambda r: r[1])  # at most RANGES
    whole = (2, -1, -1, sum(r[3] for r in rows), sum(r[4] for r in rows), shards, merkle_root([bytes(r[6]) for r in rows]))
    return parts.unionByName(recipes.sparkSession.createDataFrame([*rows, whole], _MANIFEST).coalesce(1))


def verified_manifest(spark: SparkSession, path: str) -> tuple[dict[int, int], int]:
    """Hold the manifest against the recipes: (ids before each range, number of shards); an error if anything differs."""
    kept = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    top = {r["range"]: r for r in kept.where("level > 0").collect()}  # at most RANGES + 1
    if -1 not in top:
        raise ValueError(f"the manifest of {path} has no row for the whole store")
    fresh = _manifest(spark.read.parquet(f"{path}/recipes"), top[-1]["shards"])
    differ = [side.select(F.lit(name).alias("side"), "level", "range", "part", "documents") for name, side in (("manifest", kept.exceptAll(fresh)), ("recipes", fresh.exceptAll(kept)))]
    if found := differ[0].unionByName(differ[1]).limit(3).collect():
        raise ValueError(f"the manifest of {path} doesn't match its recipes: {[tuple(r) for r in found]}")
    first, total = {}, 0
    for k in sorted(k for k in top if k >= 0):
        first[k], total = total, total + top[k]["tokens"]
    return first, top[-1]["shards"]


_TOLD = "range int, block long, kind string, shard int, digests binary, lengths binary, ids binary"


def _rebuilt(spark: SparkSession, path: str, value, kind: str) -> DataFrame:
    """doc_id, row, start, n_tokens of every document, and what ``value`` makes of its ids (an array of 4-byte integers)."""
    first, shards = verified_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    told = _arrow(_struct(_TOLD))

    def blocks(batch: pa.RecordBatch):
        """(range, block, rows) of a batch of recipes."""
        key = np.stack([batch.column("range").to_numpy(), batch.column("before").to_numpy() // BLOCK], 1)
        edge = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1).tolist(), len(key)]
        for a, b in zip(edge, edge[1:], strict=False):
            if a < b:
                yield *key[a].tolist(), batch.slice(a, b - a)

    def ask(it):
        for batch in it:
            rows = []
            for r, block, part in blocks(batch):
                own = part.column("digests").to_pylist()
                for d, root, row in zip(own, part.column("root").to_pylist(), part.column("row").to_pylist(), strict=True):
                    if merkle_root(_each(d)) != root:
                        raise ValueError(f"recipe {row} doesn't match its Merkle root")
                wanted = sorted(set(_each(b"".join(own))))
                shard = _shard_of(b"".join(wanted), shards)
                order = np.argsort(shard, kind="stable")
                bound = np.searchsorted(shard[order], np.arange(shards + 1))
                rows += [(r, block, "2 ask", i, b"".join([wanted[j] for j in order[bound[i] : bound[i + 1]]]), None, None) for i in np.flatnonzero(np.diff(bound)).tolist()]
            yield _batch(rows, told)

    def answer(it):
        """A shard's chunks come first, then what is asked of it."""
        shard, held = None, {}
        for batch in it:
            rows = []
            for r, block, kind_, s, *packed in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if s != shard:
                    shard, held = s, {}
                if kind_ == "1 chunk":
                    for d, n, data in _Chunks.opened(*packed):
                        if digest(data) != d:
                            raise ValueError(f"chunk {d.hex()} doesn't match its digest")
                        held[d] = n, data
                    continue
                out = _Chunks()
                for d in _each(packed[0]):
                    if d not in held:
                        raise ValueError(f"chunk {d.hex()} is missing")
                    out.add(d, *held[d])
                rows.append((r, block, "chunks", s, *out.packed()))
            yield _batch(rows, told)

    def send(it):
        for batch in it:
            rows = []
            for r, block, part in blocks(batch):
                out, part = pa.BufferOutputStream(), part
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(part)
                rows.append((r, block, "recipes", 0, None, None, out.getvalue().to_pybytes()))
            yield _batch(rows, told)

    def build(table: pa.Table) -> pa.Table:
        held = {}
        for k, *packed in zip(*(table[c].to_pylist() for c in ("kind", "digests", "lengths", "ids")), strict=True):
            if k == "chunks":
                held.update((d, (n, data)) for d, n, data in _Chunks.opened(*packed))
        out = []
        for k, data in zip(table["kind"].to_pylist(), table["ids"].to_pylist(), strict=True):
            if k != "recipes":
                continue
            part = pa.ipc.open_stream(data).read_all()
            made = []
            for d, n, row in zip(part["digests"].to_pylist(), part["n_tokens"].to_pylist(), part["row"].to_pylist(), strict=True):
                raw = b"".join([held[x][1] for x in _each(d)])
                if sum(held[x][0] for x in _each(d)) != n:
                    raise ValueError(f"document {row} can't be rebuilt")
                made.append(value(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")))
            start = pa.array(part["before"].to_numpy() + first[table["range"][0].as_py()])
            out.append(pa.table([part["doc_id"], part["row"], start, part["n_tokens"], pa.array(made, schema_arrow.field("value").type)], schema=schema_arrow))
        return pa.concat_tables(out)

    schema = _struct("", recipes.schema["doc_id"], *T.StructType.fromDDL(f"row long, start long, n_tokens long, value {kind}"))
    schema_arrow = _arrow(schema)
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").select(F.lit(0).alias("range"), F.lit(0).cast("long").alias("block"), F.lit("1 chunk").alias("kind"), "shard", "digests", "lengths", "ids")
    asked = recipes.select("range", "before", "row", "digests", "root").mapInArrow(tidy(ask), _TOLD)
    answers = chunks.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(tidy(answer), _TOLD)
    sent = recipes.select("range", "before", "doc_id", "row", "n_tokens", "digests", "root").mapInArrow(tidy(send), _TOLD)
    return sent.unionByName(answers).groupBy("range", "block").applyInArrow(tidy(build), schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild every document: doc_id, row, start, n_tokens, ids (array of long)."""
    return _rebuilt(spark, path, lambda ids: ids.astype(np.int64), "array<long>").withColumnRenamed("value", "ids")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the rebuilt ids as little-endian 4-byte integers) of every document."""
    return _rebuilt(spark, path, lambda ids: zlib.crc32(ids.tobytes()), "long").select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))
