"""URL filter: a sorted array of 64-bit digests, memory-mapped by the workers and probed by binary search.

A rule is (host, path prefix, verdict).  It fits its host and all subdomains when the url's path starts with the rule's
path; the longest rule string (host + path) wins.  Rules are kept as sorted xxhash64 keys of ``host + path`` beside their
full strings; a key that is found counts only if the stored string equals the probed one.  The array is one file for each
``SHARD`` rules or so, cut by the first bits of the keys, so that a list may have any number of rules.

Defined results: a null url or one without ``://`` has an empty host and path and gets the default verdict; repeated rows
are judged one by one; of several rules with one host and path the last counts; a rule whose host holds a ``/`` or whose path
doesn't begin with one (or is empty) is refused; an empty table gives an empty result; only the id and url columns are read, so
that other columns may have any name.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.shared import LOWER, UPPER

#: Rules of a file.
SHARD = 1_000_000


class DigestArray:
    """Sorted 64-bit digests, and the strings they stand for, in one file that is memory-mapped.

    The file holds 8-byte integers (how many digests and path lengths; the digests; ends of the strings; a code each; the
    path lengths) and then the strings.
    """

    def __init__(self, path: str):
        n, lengths = (int(x) for x in np.memmap(path, np.int64, "r", 0, (2,)))
        part = lambda at, size, kind=np.int64: np.memmap(path, kind, "r", 16 + 8 * at, (size,)) if size else np.empty(0, kind)
        self.keys = part(0, n, np.uint64)
        self.ends = part(n, n + 1)
        self.codes = part(2 * n + 1, n)
        self.lengths = part(3 * n + 1, lengths)
        self.text = part(3 * n + 1 + lengths, int(self.ends[-1]), np.uint8)

    @staticmethod
    def build(path: str, strings: Sequence[str], codes: Sequence[int], path_lengths: Iterable[int], key=xxhash.xxh64_intdigest) -> None:
        rows = sorted((key(s.encode()), s.encode(), c) for s, c in zip(strings, codes, strict=True))
        lengths = sorted(set(path_lengths))
        with open(path, "wb") as f:
            f.write(np.array([len(rows), len(lengths)], np.int64).tobytes())
            f.write(np.array([r[0] for r in rows], np.uint64).tobytes())
            f.write(np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int64).tobytes())
            f.write(np.array([*(r[2] for r in rows), *lengths], np.int64).tobytes())
            f.write(b"".join(r[1] for r in rows))

    def stored(self, i: int) -> bytes:
        return self.text[self.ends[i] : self.ends[i + 1]].tobytes()

    def probe(self, strings: list[bytes], key=xxhash.xxh64_intdigest) -> np.ndarray:
        """The index of each string, or -1."""
        want = np.fromiter((key(s) for s in strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, want)
        out = np.full(len(strings), -1, np.int64)
        open_ = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == want)) if len(self.keys) else []
        for i in open_:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == want[i]:  # equal digests of different strings lie side by side
                if self.stored(k) == strings[i]:
                    out[i] = k
                    break
                k += 1
        return out


class Shards:
    """Digest arrays that share the 64-bit keys by their first bits."""

    def __init__(self, paths: Sequence[str]):
        self.arrays = [DigestArray(p) for p in paths]
        self.lengths = sorted({int(n) for a in self.arrays for n in a.lengths})

    @staticmethod
    def shard_of(key: int, shards: int) -> int:
        return key * shards >> 64

    def probe(self, strings: list[bytes], key=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
        """(shard, index or -1) of each string."""
        shard = np.array([self.shard_of(key(s), len(self.arrays)) for s in strings] if len(self.arrays) > 1 else [0] * len(strings), np.int64)
        found = np.full(len(strings), -1, np.int64)
        for i in np.unique(shard).tolist():
            at = np.flatnonzero(shard == i)
            found[at] = self.arrays[i].probe([strings[j] for j in at.tolist()], key)
        return shard, found


def shared_files(spark: SparkSession, strings: list[str], codes: list[int], path_lengths: list[int]) -> list[str]:
    """Names of the files of the rules, sent to every worker; the same rules are sent once."""
    sent = spark.sparkContext.__dict__.setdefault("_siltstone_rules", {})
    name = hashlib.blake2b(repr((SHARD, strings, codes)).encode(), digest_size=16).hexdigest()
    if name not in sent:
        folder = tempfile.mkdtemp(prefix="siltstone-")  # of the driver, which serves the files while it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shards = max(1, -(-len(strings) // SHARD))
        part = np.array([Shards.shard_of(xxhash.xxh64_intdigest(s.encode()), shards) for s in strings], np.int64)
        sent[name] = [f"rules-{name}-{i}" for i in range(shards)]
        for i, file in enumerate(sent[name]):
            at = np.flatnonzero(part == i).tolist()
            DigestArray.build(os.path.join(folder, file), [strings[j] for j in at], [codes[j] for j in at], [path_lengths[j] for j in at])
            spark.sparkContext.addFile(os.path.join(folder, file))
    return sent[name]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null and where there is no ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(str.maketrans(UPPER, LOWER)), path


def url_filter(df: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url of ``df``: id, host, path, rule, verdict.  ``rules``: (host, path prefix, verdict)."""
    once: dict[str, tuple[int, str]] = {}
    for host, path, verdict in rules:
        if "/" in host or path[:1] not in ("", "/"):
            raise ValueError(f"{host!r}, {path!r} isn't a host and a path")
        once[host + path] = (len(path), verdict)
    verdicts = sorted({v for _, v in once.values()})
    names = shared_files(df.sparkSession, list(once), [verdicts.index(v) for _, v in once.values()], [n for n, _ in once.values()])
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def judge(it):
        index = Shards([SparkFiles.get(name) for name in names])
        for batch in it:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            owner, probes = [], []
            for i, (host, path) in enumerate(parts):
                if not host:
                    continue
                pieces = [n for n in index.lengths if n <= len(path)]
                at = 0
                while at >= 0:
                    suffix = host[at:]
                    for n in pieces:
                        owner.append(i)
                        probes.append((suffix + path[:n]).encode())
                    dot = host.find(".", at)
                    at = dot + 1 if dot >= 0 else -1
            shard, hits = index.probe(probes)
            best: dict[int, tuple[int, int, int]] = {}
            for j in np.flatnonzero(hits >= 0).tolist():
                found = (len(probes[j].decode()), int(shard[j]), int(hits[j]))
                if found > best.get(owner[j], (-1, -1, -1)):
                    best[owner[j]] = found
            rule = [index.arrays[best[i][1]].stored(best[i][2]).decode() if i in best else None for i in range(len(parts))]
            verdict = [verdicts[index.arrays[best[i][1]].codes[best[i][2]]] if i in best else default for i in range(len(parts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], rule, verdict))], names=[f.name for f in schema])

    return df.select(F.col(id_col), F.col(url_col).alias("_url")).mapInArrow(judge, schema)
