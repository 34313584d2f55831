"""Interpolated modified Kneser-Ney language model (order 2), counted in Spark and kept as sorted hash arrays.

    P(v | u) = max(c(u v) - D(c(u v)), 0) / c(u) + g(u) P1(v)
    P1(v)    = max(t(v) - E(t(v)), 0) / T + g1 / (V + 1)

c: counts; t(v): number of different words before v; T: number of different pairs; D and E: the three modified discounts of Chen and
Goodman, from the counts of counts.  A text is its words (A-Z lower-cased) and an end; the first word follows a start mark.

Nothing of the size of the vocabulary is broadcast or collected.  The rows are read in splits of about ``SPLIT`` bytes; a
split numbers its words and counts its distinct pairs, and sends each pair once to the shard that its first word's hash
names (``SHARDED`` pairs a shard; a word with more than 1 / ``HEAVY`` of all words is dealt over all shards by the second
word).  A shard sorts its pairs' hashes into an array, which is written to a file and memory-mapped, sums the counts, answers
every split by binary search, and tells the second words' shards how many different words it has seen before them.  These
answer the splits likewise.  Only sums (counts of counts, and the stats of at most ``HEAVY`` heavy words) reach the driver.

The shards' sorted arrays are the model.  They are kept in a folder (``path``), from which :func:`score_with` scores other texts:
their pairs and words are sent to the shards in the same way, and a task maps its shard's arrays and answers.  A shard that is
asked for more than ``SHARDED`` pairs is copied for each part of its requests.

Words are told apart by ``KEY`` = 56 bits of a 64-bit hash: among a hundred million different words 0.07 pairs are expected to
collide, among a billion 7.

Defined results: a null text is empty and has the end token only; a row whose training flag is null isn't learnt from;
without training rows every token has the probability 1 / (V + 1) = 1; repeated rows count each; an empty table gives an empty
result; a word that the model doesn't know has the probability of P1's last term; only id and text are read.
"""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import batches, in_small_batches, joined, mix64, new_path, repeatable, tidy, word_hashes, written

SPLIT, SHARDED, HEAVY = 8 << 20, 2_500_000, 2000
KEY = 56
_LOW = np.uint64((1 << KEY) - 1)
START, END = np.uint64(1), np.uint64(2)


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, : KEY // 8].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // (KEY // 8), 8), np.uint8)
    out[:, : KEY // 8] = np.frombuffer(data, np.uint8).reshape(-1, KEY // 8)
    return out.view(np.uint64).ravel()


def _small(values: np.ndarray) -> bytes:
    """Mostly small numbers, compressed; the last byte tells their width."""
    values = np.asarray(values)
    wide = len(values) > 0 and int(values.max()) >> 32 > 0
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint64 if wide else np.uint32).tobytes()) + (b"\x08" if wide else b"\x04")


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[:-1]), np.uint64 if data[-1] == 8 else np.uint32).astype(np.int64)


def _framed(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _table(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(columns.items())})


class Split:
    """Some rows: their distinct words, their tokens as numbers of these words, and their distinct pairs."""

    def __init__(self, column: pa.Array, train: np.ndarray):
        hashes, first = word_hashes(*joined(column))
        hashes = np.maximum(hashes & _LOW, np.uint64(3))
        self.words = np.diff(first)
        self.train = train
        n = len(train)
        stream = np.insert(hashes, first[1:], END)
        self.vocab, number = np.unique(np.concatenate(([START, END], stream)), return_inverse=True)
        self.stream = number[2:]
        self.stop = first[1:] + np.arange(1, n + 1)  # after each row's end token
        before = np.concatenate(([0], self.stream[:-1])) if len(self.stream) else self.stream
        starts = self.stop - self.words - 1
        before[starts] = 0  # START is the smallest key
        self.learnt = np.repeat(train, self.words + 1)
        code = before.astype(np.int64) * len(self.vocab) + self.stream
        self.pairs, self.pair = np.unique(code, return_inverse=True)
        self.count = np.bincount(self.pair[self.learnt], minlength=len(self.pairs)) if len(self.pairs) else np.empty(0, np.int64)
        self.u, self.v = self.pairs // len(self.vocab), self.pairs % len(self.vocab)

    def dealt(self, shards: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order of the pairs by shard, bounds of the shards in it)."""
        ku, kv = self.vocab[self.u], self.vocab[self.v]
        shard = shard_of(ku, shards)
        hot = np.isin(self.vocab, heavy)[self.u]
        shard[hot] = shard_of(mix64(ku[hot] ^ mix64(kv[hot])) & _LOW, shards)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of mixed keys; the keys of the two marks are mixed as well."""
    return ((mix64(keys) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _ranges(batch: pa.RecordBatch):
    """(key, row range) of a batch of (row, doc_id, train, text)."""
    for a, b in batches(batch.column(3).cast(pa.large_string()), SPLIT):
        yield batch.column(0)[a].as_py(), (a, b)


def _splits(batch: pa.RecordBatch):
    """(key, row range, Split) of a batch of (row, doc_id, train, text)."""
    for key, (a, b) in _ranges(batch):
        yield key, (a, b), Split(batch.column(3).slice(a, b - a), batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool))


class Counts:
    """Sorted hash array of pairs with their counts, in a file that is memory-mapped."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, folder: str):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        self.one = order[edge]  # a request that holds each key
        self.paths = [os.path.join(folder, f) for f in ("keys.npy", "counts.npy")]
        np.save(self.paths[0], keys[edge])
        np.save(self.paths[1], np.add.reduceat(counts, edge) if len(edge) else counts)
        self.keys, self.counts = (np.load(p, mmap_mode="r") for p in self.paths)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


def discounts(n: list[int]) -> np.ndarray:
    """D(0..3+) from the numbers of things counted 1, 2, 3 and 4 times; 0.5, 1 and 1.5 where these don't allow an estimate."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n[0] > 0 and n[1] > 0:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] > 0:
                d = k - (k + 1) * y * n[k] / n[k - 1]
                out[k] = d if 0 < d < k else out[k]
    return out


class Shard:
    """A shard's pairs with their counts, mapped from a file, and its contexts: c(u) and the numbers of pairs counted 1, 2 and 3+ times."""

    def __init__(self, pairs: Counts, contexts: np.ndarray, stats: np.ndarray):
        self.pairs, self.contexts, self.stats = pairs, contexts, stats

    def answer(self, us: np.ndarray, keys: np.ndarray) -> bytes:
        told = np.zeros((4, len(us)), np.int64)
        if len(self.contexts):
            at = np.minimum(np.searchsorted(self.contexts, us), len(self.contexts) - 1)
            told = np.where(self.contexts[at] == us, self.stats[:, at], 0)
        return _framed(_small(self.pairs.find(keys)), _small(told.ravel()))


@dataclass
class Sums:
    """What all tasks need of a model: a few numbers, and the stats of the heavy words."""

    shards: int
    heavy: list[int]
    hot_stats: dict[int, list[int]]
    d: list[float]
    e: list[float]
    n_train: int
    n_docs: int
    vocabulary: int
    types: int
    g1: float

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "sums string").coalesce(1).write.parquet(f"{path}/sums")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Sums:
        found = json.loads(spark.read.schema("sums string").parquet(f"{path}/sums").first()["sums"])
        return Sums(**{**found, "hot_stats": {int(k): v for k, v in found["hot_stats"].items()}})


_TOLD = {"kind": pa.string(), "key": pa.int64(), "shard": pa.int32(), "data": pa.binary()}
TOLD = "kind string, key long, shard int, data binary"


def _kept(df: DataFrame, path: str) -> DataFrame:
    """The table, written with a folder for each kind of rows, so that a kind is read without the others."""
    df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return _read(df.sparkSession, path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOLD).parquet(path).select("kind", "key", "shard", "data")


def _rows(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    rows = repeatable(in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).alias("text")), "lm-input")
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "train", "text")


def _pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(u * np.uint64(0x9E3779B97F4A7C15) + mix64(v))


def _asked_pairs(rows: DataFrame, shards: int, heavy: np.ndarray) -> DataFrame:
    """Each split's distinct pairs, once, for the shards: first words, how many pairs each has, second words, training counts."""
    columns = {"shard": pa.int32(), "split": pa.int64(), "n": pa.int64(), "us": pa.binary(), "degrees": pa.binary(), "vs": pa.binary(), "counts": pa.binary()}

    def ask(it):
        for batch in it:
            for key, _, s in _splits(batch):
                order, bound = s.dealt(shards, heavy)
                out = []
                for i in np.flatnonzero(np.diff(bound)).tolist():
                    at = order[bound[i] : bound[i + 1]]
                    edge = np.flatnonzero(np.diff(s.u[at], prepend=-1))
                    out.append((i, key, len(at), _pack(s.vocab[s.u[at[edge]]]), _small(np.diff(edge, append=len(at))), _pack(s.vocab[s.v[at]]), _small(s.count[at])))
                yield from _table(columns, out).to_batches()

    return rows.mapInArrow(tidy(ask), "shard int, split long, n long, us binary, degrees binary, vs binary, counts binary")


def _asked_words(rows: DataFrame, shards: int) -> DataFrame:
    """Each split's distinct words, once, for the shards."""
    columns = {"shard": pa.int32(), "split": pa.int64(), "n": pa.int64(), "data": pa.binary()}

    def ask(it):
        for batch in it:
            for key, _, s in _splits(batch):
                order, bound = _by_shard(s.vocab, shards)
                yield from _table(columns, [(i, key, int(bound[i + 1] - bound[i]), _pack(s.vocab[order[bound[i] : bound[i + 1]]])) for i in np.flatnonzero(np.diff(bound)).tolist()]).to_batches()

    return rows.mapInArrow(tidy(ask), "shard int, split long, n long, data binary")


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    to = shard_of(keys, shards)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(shards + 1))


def _requests(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """(first words and their numbers of pairs a split, first and second words of all pairs) of a shard's requests."""
    us, degrees = [_unpack(x) for x in table["us"].to_pylist()], [_large(x) for x in table["degrees"].to_pylist()]
    none = [np.empty(0, np.uint64)]
    return us, degrees, np.concatenate(none + [np.repeat(a, d) for a, d in zip(us, degrees, strict=True)]), np.concatenate(none + [_unpack(x) for x in table["vs"].to_pylist()])


def _answers(shard: Shard, number: int, table: pa.Table, us: list[np.ndarray], degrees: list[np.ndarray], keys: np.ndarray) -> list[tuple]:
    out, at = [], 0
    for split, ours, degree in zip(table["split"].to_pylist(), us, degrees, strict=True):
        n = int(degree.sum())
        out.append(("pairs", split, number, shard.answer(ours, keys[at : at + n])))
        at += n
    return out


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score and score of every row, learning from those in training.

    The model is kept in ``path`` (a new folder of the shared folder where it is None), for :func:`score_with`.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "lm-model")
    rows = _rows(docs, training, id_col, text_col)

    def common(it):
        for batch in it:
            for _, _, s in _splits(batch):
                words = np.bincount(s.stream[s.learnt], minlength=len(s.vocab))
                all_ = np.bincount(s.stream, minlength=len(s.vocab))
                hot = np.flatnonzero(all_ * HEAVY > len(s.stream))
                keys, counts = np.append(s.vocab[hot], [np.uint64(0), START]).astype(np.int64), np.append(all_[hot], [int(words.sum()), len(s.stream)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["k", "c"])

    sums = rows.mapInArrow(tidy(common), "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    total = sums.where("k in (0, 1)").collect()
    tokens = {r["k"]: r["c"] for r in total}
    n_train, n_all = tokens.get(0, 0), tokens.get(1, 0)
    heavy = np.array(sorted([r["k"] for r in sums.where(F.col("k") > 1).where(F.col("c") * HEAVY > n_all).orderBy(F.desc("c")).limit(HEAVY).collect()] + [1]), np.uint64)  # START follows no row's size
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_all // SHARDED), 1)

    def count(table: pa.Table) -> pa.Table:
        number = table["shard"][0].as_py()
        us, degrees, u, v = _requests(table)
        keys, counts = _pair_keys(u, v), np.concatenate([_large(x) for x in table["counts"].to_pylist()])
        with tempfile.TemporaryDirectory() as folder:
            seen = np.flatnonzero(counts > 0)
            all_ = Counts(keys[seen], counts[seen], folder)
            c, one = np.asarray(all_.counts), seen[all_.one]
            contexts, which = np.unique(u[one], return_inverse=True)
            stats = np.array([np.bincount(which, w, len(contexts)).astype(np.int64) for w in (c, c == 1, c == 2, c >= 3)])
            out = _answers(Shard(all_, contexts, stats), number, table, us, degrees, keys)
            out.append(("model", number, number, _framed(np.asarray(all_.keys).tobytes(), _small(c), _pack(contexts), _small(stats.ravel()))))
            hot = np.isin(contexts, heavy)
            out += [("heavy", int(contexts[i]), number, stats[:, i].tobytes()) for i in np.flatnonzero(hot)]
            sums_ = [int((c == k).sum()) for k in (1, 2, 3, 4)] + [len(c), int((~hot & (contexts > 2)).sum())]
            out.append(("sums", 0, number, np.array(sums_, np.int64).tobytes()))
            after, before = np.unique(v[one], return_counts=True)
            order, bound = _by_shard(after, shards)
            for i in np.flatnonzero(np.diff(bound)).tolist():
                mine = order[bound[i] : bound[i + 1]]
                out.append(("before", i, number, _framed(_pack(after[mine]), _small(before[mine]))))
            del all_
        return _table(_TOLD, out)

    first = _kept(_asked_pairs(rows, shards, heavy).drop("n").groupBy("shard").applyInArrow(tidy(count), TOLD), f"{path}/pairs")

    def count_before(table: pa.Table) -> pa.Table:
        number = table["key"][0].as_py()
        is_words = [k == "words" for k in table["kind"].to_pylist()]
        keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for data, words in zip(table["data"].to_pylist(), is_words, strict=True):
            if not words:
                a, b = _unframed(data)
                keys.append(_unpack(a))
                counts.append(_large(b))
        with tempfile.TemporaryDirectory() as folder:
            words = Counts(np.concatenate(keys), np.concatenate(counts), folder)
            t = np.asarray(words.counts)
            out = [("sums", 0, number, np.array([(t == k).sum() for k in (1, 2, 3, 4)] + [t.sum(), (t >= 3).sum(), len(t)], np.int64).tobytes())]
            out.append(("model", number, number, _framed(_pack(np.asarray(words.keys)), _small(t))))
            out += [("words", split, number, _small(words.find(_unpack(data)))) for data, split, asked in zip(table["data"].to_pylist(), table["split"].to_pylist(), is_words, strict=True) if asked]
            del words
        return _table(_TOLD, out)

    wanted = _asked_words(rows, shards).select(F.lit("words").alias("kind"), F.col("shard").cast("long").alias("key"), "split", "data")
    before = first.where("kind = 'before'").select("kind", "key", F.lit(0).cast("long").alias("split"), "data")
    second = _kept(before.unionByName(wanted).groupBy("key").applyInArrow(tidy(count_before), TOLD), f"{path}/words")

    add = lambda df, n: np.sum([np.frombuffer(r["data"], np.int64) for r in df.where("kind = 'sums'").select("data").collect()] or [np.zeros(n, np.int64)], axis=0)  # noqa: E731  a few numbers a shard
    of_pairs, of_words = add(first, 6), add(second, 7)
    hot_stats: dict[int, np.ndarray] = {}
    for r in first.where("kind = 'heavy'").select("key", "data").collect():  # at most HEAVY words a shard
        hot_stats[r["key"]] = hot_stats.get(r["key"], 0) + np.frombuffer(r["data"], np.int64)
    types = int(of_words[4])
    n_docs = types and int(rows.where("train").count())
    vocabulary = int(of_pairs[5]) + sum(1 for k, s in hot_stats.items() if k > 2 and s[0]) + (n_docs > 0)
    d, e = discounts(of_pairs[:4].tolist()), discounts(of_words[:4].tolist())
    g1 = float((e[1] * of_words[0] + e[2] * of_words[1] + e[3] * of_words[5]) / types) if types else 1.0
    model = Sums(shards, heavy.tolist(), {k: s.tolist() for k, s in hot_stats.items()}, d.tolist(), e.tolist(), n_train, n_docs, vocabulary, types, g1)
    model.save(spark, path)
    return _scored(rows, first.where("kind = 'pairs'").unionByName(second.where("kind = 'words'")), model, docs.schema[id_col].dataType.simpleString(), id_col)


def score_with(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row by the model that score_texts kept in ``path``.

    A text's perplexity is ``10 ** (-score / n_tokens)``.
    """
    spark = docs.sparkSession
    model, rows = Sums.load(spark, path), _rows(docs, F.lit(False), id_col, text_col)

    def arrays(kind: str) -> DataFrame:
        return _read(spark, f"{path}/{kind}").where("kind = 'model'").select("shard", F.col("data").alias("model"))

    def held(table: pa.Table) -> tuple[list[bytes], pa.Table]:
        """(the shard's arrays, the requests) of a group."""
        found = [x for x in table["model"].to_pylist() if x is not None]
        return _unframed(found[0]) if found else [], table.filter(table["split"].is_valid())

    def pairs(table: pa.Table) -> pa.Table:
        number = table["shard"][0].as_py()
        data, table = held(table)
        with tempfile.TemporaryDirectory() as folder:
            none = np.empty(0, np.uint64)
            keys, contexts = (np.frombuffer(data[0], np.uint64), _unpack(data[2])) if data else (none, none)
            counts, stats = (_large(data[1]), _large(data[3]).reshape(4, -1)) if data else (none.astype(np.int64), np.empty((4, 0), np.int64))
            us, degrees, u, v = _requests(table)
            out = _answers(Shard(Counts(keys, counts, folder), contexts, stats), number, table, us, degrees, _pair_keys(u, v))
        return _table(_TOLD, out)

    def words(table: pa.Table) -> pa.Table:
        number = table["shard"][0].as_py()
        data, table = held(table)
        with tempfile.TemporaryDirectory() as folder:
            known = Counts(_unpack(data[0]) if data else np.empty(0, np.uint64), _large(data[1]) if data else np.empty(0, np.int64), folder)
            out = [("words", split, number, _small(known.find(_unpack(x)))) for split, x in zip(table["split"].to_pylist(), table["data"].to_pylist(), strict=True)]
            del known
        return _table(_TOLD, out)

    asked = written(_asked_pairs(rows, model.shards, np.array(model.heavy, np.uint64)).drop("counts"), "lm-asked-pairs")
    asked_words = written(_asked_words(rows, model.shards), "lm-asked-words")
    answers = _dealt(asked, arrays("pairs")).applyInArrow(tidy(pairs), TOLD).unionByName(_dealt(asked_words, arrays("words")).applyInArrow(tidy(words), TOLD))
    return _scored(rows, answers, model, docs.schema[id_col].dataType.simpleString(), id_col).drop("train")


def _dealt(asked: DataFrame, model: DataFrame) -> GroupedData:
    """Requests and the shards' arrays, in parts of about SHARDED requests, of which each has a copy of its shard's arrays."""
    parts = asked.groupBy("shard").agg(F.ceil(F.sum("n") / F.lit(SHARDED)).cast("int").alias("parts"))
    requests = asked.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("split"), F.col("parts")).cast("int"))
    copies = model.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return requests.drop("parts", "n").unionByName(copies.drop("parts"), allowMissingColumns=True).groupBy("shard", "part")


def _scored(rows: DataFrame, answers: DataFrame, model: Sums, kind: str, id_col: str) -> DataFrame:
    """The rows' scores, from the shards' answers to their splits."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def streams(it):
        for batch in it:
            for key, (a, b) in _ranges(batch):
                data = pa.BufferOutputStream()
                part = batch.slice(a, b - a).select(["doc_id", "train", "text"])
                with pa.ipc.new_stream(data, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(part)
                yield from _table(_TOLD, [("text", key, 0, data.getvalue().to_pybytes())]).to_batches()

    def score(table: pa.Table) -> pa.Table:
        m = sent.value
        d, e, heavy = np.array(m.d), np.array(m.e), np.array(m.heavy, np.uint64)
        data = {(k, i): x for k, i, x in zip(table["kind"].to_pylist(), table["shard"].to_pylist(), table["data"].to_pylist(), strict=True)}
        part = pa.ipc.open_stream(data["text", 0]).read_all().combine_chunks()
        texts = part["text"].chunk(0) if part.num_rows else pa.array([], pa.string())
        s = Split(texts, part["train"].to_numpy().astype(bool))
        c_pair, c, g = np.zeros(len(s.pairs)), np.zeros(len(s.vocab)), np.zeros(len(s.vocab))
        order, bound = s.dealt(m.shards, heavy)
        for i in np.flatnonzero(np.diff(bound)).tolist():
            at = order[bound[i] : bound[i + 1]]
            counts, stats = (_large(x) for x in _unframed(data["pairs", i]))
            c_pair[at] = counts
            us = s.u[at[np.flatnonzero(np.diff(s.u[at], prepend=-1))]]
            stats = stats.reshape(4, -1).astype(np.float64)
            c[us], g[us] = stats[0], d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3]
        for i in np.flatnonzero(np.isin(s.vocab, heavy)):
            stats = m.hot_stats.get(int(s.vocab[i]), np.zeros(4))
            c[i], g[i] = stats[0], d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3]
        t = np.zeros(len(s.vocab))
        order, bound = _by_shard(s.vocab, m.shards)
        for i in np.flatnonzero(np.diff(bound)).tolist():
            t[order[bound[i] : bound[i + 1]]] = _large(data["words", i])
        p1 = np.maximum(t - e[np.minimum(t, 3).astype(int)], 0) / max(m.types, 1) + m.g1 / (m.vocabulary + 1)
        own, context = c_pair - d[np.minimum(c_pair, 3).astype(int)], c[s.u]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(context > 0, np.maximum(own, 0) / context + g[s.u] / context * p1[s.v], p1[s.v])
        c[s.vocab == END] = m.n_docs
        logs, base = np.log10(p)[s.pair], np.log10((c + 1) / (m.n_train + m.vocabulary + 1))[s.stream]
        start = s.stop - s.words - 1
        fold = lambda x: np.add.reduceat(x, start) if len(start) else x  # noqa: E731  each row has a token
        return pa.table({"doc_id": part["doc_id"], "train": part["train"], "n_tokens": pa.array(s.words + 1), "n_known": pa.array(fold((c > 0).astype(np.int64)[s.stream])), "train_tokens": pa.array(np.full(len(start), m.n_train)), "base_score": pa.array(fold(base)), "score": pa.array(fold(logs))})

    both = rows.mapInArrow(tidy(streams), TOLD).unionByName(answers)
    return both.groupBy("key").applyInArrow(tidy(score), f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("doc_id", id_col)
