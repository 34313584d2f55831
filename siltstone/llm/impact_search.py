"""Exact top-k inner products over an impact-ordered index, read score-at-a-time.

Vectors of one length are dealt into blocks of about ``BLOCK`` rows, and each block's index is built once and written: every
dimension's postings, sorted by value and cut into segments by values quantised to ``LEVELS`` steps of the block's range.  A
query multiplies a segment's largest value by its weight (the smallest, where the weight is negative) and so gets the segment's
impact.  Segments of all dimensions are processed by descending impact, and their postings' products are added to the vectors'
running sums.  A vector that hasn't been met yet in a dimension can gain there no more than the next segment's impact, nor more than
the dimension's largest one, which bounds every vector's score.  After each step the best vectors so far are scored exactly; the
search stops once all vectors whose bound lies below the k-th exact score are proved not to be members and the others
can be scored exactly with fewer products than the segments that are left hold.

Queries are dealt into blocks as well: a task holds one block of each, so that neither side is sent whole to all workers.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; a vector is compared with
those of its own length; ties go to the smaller id; rows that repeat an id are one query (its smallest vector, component by
component), and candidates each (a query's own id never is); ids must be whole numbers; an empty table gives an
empty result; only id and vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import whole_numbers, written

BLOCK, QUERIES, LEVELS, STEPS = 8192, 2048, 256, 16


def usable(df: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """vec_id, vec (array of double), its length d, and is_query of the rows that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = whole_numbers(df, id_col).where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vec"), F.size(v).alias("d"), F.coalesce(is_query, F.lit(False)).alias("is_query"))


def lengths(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For each length of vectors, commonest first: the numbers of rows and of rows that are queries."""
    found = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()  # a row a length
    return {r["d"]: (r["n"], r["q"]) for r in sorted(found, key=lambda r: (-r["n"], r["d"]))}


def queries(rows: DataFrame) -> DataFrame:
    """One row for each query's id and length: vec_id, d, vec."""
    return rows.where("is_query").groupBy("vec_id").agg(F.min(F.struct("vec", "d")).alias("q")).select("vec_id", "q.d", "q.vec")


def by_length(values: dict[int, int]) -> Column:
    """The value for each row's length d."""
    return F.element_at(F.create_map(*[F.lit(int(x)) for kv in values.items() for x in kv]), F.col("d"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class ImpactIndex:
    """Postings of a block of integer vectors: each dimension's rows by value, cut into segments of quantised values.

    Values are kept as doubles: products and sums of scaled vectors are exact below 2**53.
    """

    def __init__(self, x: np.ndarray, order: np.ndarray | None = None):
        self.x = x.astype(np.float64)
        n, d = x.shape
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16) if order is None else order
        self.values = np.take_along_axis(self.x.T, self.order.astype(np.int64), 1)
        low, high = self.values[:, 0].min(), self.values[:, -1].max()
        level = np.minimum((self.values - low) * (LEVELS / max(high - low, 1.0)), LEVELS - 1).astype(np.int64)
        edge = np.diff(level, axis=1, prepend=-1) != 0  # no segment is empty
        self.dimension, begin = np.nonzero(edge)
        self.begin = self.dimension * n + begin
        self.end = np.append(self.begin[1:], n * d)
        flat = self.values.ravel()
        self.low, self.high = flat[self.begin], flat[self.end - 1]
        self.read = 0  # postings that the last search has processed

    def packed(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(self.x.tobytes() + self.order.tobytes())

    @classmethod
    def opened(cls, data: bytes, d: int) -> ImpactIndex:
        data = zstandard.ZstdDecompressor().decompress(data)
        n = len(data) // (10 * d)
        return cls(np.frombuffer(data, np.float64, n * d).reshape(n, d), np.frombuffer(data, np.uint16, n * d, 8 * n * d).reshape(d, n))

    def search(self, q: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all vectors but ``skip`` that can be among the k best, ties included."""
        n, d = self.x.shape
        q = q.astype(np.float64)
        k, self.read = min(k, n - len(skip)), 0
        if k <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        weight = q[self.dimension]
        impact = weight * np.where(weight >= 0, self.high, self.low)
        walk = np.argsort(-impact, kind="stable")
        most = np.maximum.reduceat(impact, np.searchsorted(self.dimension, np.arange(d)))  # of each dimension
        size = (self.end - self.begin)[walk]
        upto = np.cumsum(size)
        flat, values = self.order.ravel(), self.values.ravel()
        sums, met, sure = np.zeros(n), np.zeros(n), -np.inf
        a = 0
        while a < len(walk):
            b = min(len(walk), int(np.searchsorted(upto, self.read + n * d // STEPS, side="right")) + 1)
            part = walk[a:b]
            many = size[a:b]
            at = np.repeat(self.begin[part] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            row = flat[at]
            sums += np.bincount(row, values[at] * np.repeat(weight[part], many), n)
            met += np.bincount(row, minlength=n)
            a, self.read = b, int(upto[b - 1])
            ahead = impact[walk[b]] if b < len(walk) else 0.0
            begun = most > ahead if b < len(walk) else np.ones(d, bool)
            bound = sums + (begun.sum() - met) * ahead + most[~begun].sum()
            bound[skip] = -np.inf
            best = np.argpartition(-bound, min(n - 1, 2 * k))[: 2 * k]
            best = best[bound[best] > -np.inf]
            if len(best) >= k:
                sure = max(sure, np.sort(self.x[best] @ q)[::-1][k - 1])
            member = np.flatnonzero((bound >= sure) & (bound > -np.inf))  # all others are proved to be below
            if len(member) * d <= n * d - self.read:
                break
        return member, np.rint(self.x[member] @ q).astype(np.int64)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of ``floor(scale * x)`` vectors."""
    rows = usable(df, id_col, vec_col, is_query)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("long")))
    sizes = lengths(rows) or {0: (0, 0)}
    parts, slots = ({d: max(1, -(-s[i] // most)) for d, s in sizes.items()} for i, most in ((0, BLOCK), (1, QUERIES)))

    def deal(name: str, values: dict[int, int], *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), by_length(values)).cast("int").alias(name)

    def each(name: str, values: dict[int, int]) -> Column:
        return F.explode(F.sequence(F.lit(0), by_length(values) - 1)).alias(name)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        index = ImpactIndex(matrix(table["vec"]))
        return pa.table({"d": table["d"][:1], "part": table["part"][:1], "ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()), "data": pa.array([index.packed()], pa.binary())})

    index = written(rows.select("d", "vec_id", "vec", deal("part", parts, "vec_id", "vec")).groupBy("d", "part").applyInArrow(build, "d int, part int, ids binary, data binary"), "impact-index")
    asked = queries(rows).select("d", "vec_id", "vec", deal("slot", slots, "vec_id"), each("part", parts))
    held = index.select("d", "part", each("slot", slots), "ids", "data")
    both = held.withColumns({"vec_id": F.lit(None).cast("long"), "vec": F.lit(None).cast("array<bigint>")}).unionByName(asked.withColumns({"ids": F.lit(None).cast("binary"), "data": F.lit(None).cast("binary")}))

    def search(table: pa.Table) -> pa.Table:
        at = [i for i, x in enumerate(table["ids"].to_pylist()) if x is not None]
        asks = table.filter(table["vec_id"].is_valid())
        out: list[list] = [[], [], []]
        for i in at:
            ids, index = np.frombuffer(table["ids"][i].as_py(), np.int64), ImpactIndex.opened(table["data"][i].as_py(), table["d"][i].as_py())
            for query, q in zip(asks["vec_id"].to_numpy(), matrix(asks["vec"]) if len(asks) else (), strict=True):
                member, score = index.search(q, k, np.flatnonzero(ids == query))
                best = np.lexsort((ids[member], -score))[:k]
                for column, value in zip(out, (np.full(len(best), query), ids[member][best], score[best]), strict=True):
                    column.append(value)
        return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = both.groupBy("d", "part", "slot").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, len(embedding) AS d, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(CASE WHEN q.d = c.d THEN list_dot_product(q.e, c.e) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND q.d = c.d),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
