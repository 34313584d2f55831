"""Approximate nearest neighbours with a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver on at most ``SAMPLE`` vectors, chosen by a digest of their ids, and has at most ``LEAVES``
leaves, so that it can be sent to all workers.  Every row is put into a leaf.  A query walks the tree with a priority queue
ordered by the distance to the centroids, and visits leaves in that order.  How many it visits is calibrated: visits are
widened until sample queries find ``recall`` of their true neighbours in the sample.  Candidates are compared exactly, in double
precision.

A leaf with more than ``DEEP`` rows has a tree of its own, fitted in Spark on about ``SUB_SAMPLE`` of its rows with visits of its own,
so that what a query is compared with grows with the table only beyond some hundred million rows (two levels, no more).  These trees are sent to the rows and queries of their leaves
only.  A leaf of the last level with many rows is dealt into blocks of about ``BLOCK`` rows, so that copies of one vector don't meet
in one task.  The tree is that of the commonest length of vectors; those of another length are compared with all of their own
length, in blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; a vector is compared with
those of its own length; ties go to the smaller id; rows that repeat an id are one query (its smallest vector, component by
component), and candidates each (a query's own id never is); a query visits leaves until these hold at least ``4 * (k + 1)`` rows,
whatever was calibrated; ids must be whole numbers; an empty table gives an empty result; only id and vector are read.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.impact_search import lengths, matrix, queries, usable
from siltstone.llm.shared import written

SAMPLE, LEAVES, BRANCHES, BLOCK = 20_000, 4096, 12, 2048
DEEP, SUB_SAMPLE = 32_768, 4096
#: Rows of a table that is broadcast; a larger one is joined by exchange.
FEW = 200_000
#: Components of the sample in all, which bounds its bytes whatever the vectors' length is.
COMPONENTS = 1 << 23


@dataclass
class Tree:
    """Node i has the centroid ``centers[i]`` and the children ``children[i]``; one without children is leaf ``leaf[i]``."""

    centers: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, most: int, rng: np.random.Generator) -> Tree:
        """Split the fullest node, from the root on, until none has more than ``most`` rows or there are LEAVES of them."""
        open_ = [(-len(x), self._node(x), x)]
        while open_ and self.leaves + len(open_) + BRANCHES - 1 <= LEAVES and -open_[0][0] > most:
            _, at, part = heapq.heappop(open_)
            label = kmeans(part, BRANCHES, rng)
            if label.max() == label.min():  # copies of one vector
                self._close(at)
                continue
            for j in np.unique(label):
                child = part[label == j]
                self.children[at].append(self._node(child))
                heapq.heappush(open_, (-len(child), self.children[at][-1], child))
        for _, at, _ in sorted(open_, key=lambda node: node[1]):
            self._close(at)
        return self.pack()

    def _node(self, x: np.ndarray) -> int:
        self.centers.append(x.mean(0))
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centers) - 1

    def _close(self, at: int) -> None:
        self.leaf[at] = self.leaves
        self.leaves += 1

    def pack(self) -> Tree:
        self.stacked = [np.stack([self.centers[c] for c in ch]) if ch else None for ch in self.children]
        return self

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = np.argmin(_squares(x[rows], self.stacked[node]), 1)
            todo += [(c, rows[near == j]) for j, c in enumerate(self.children[node]) if (near == j).any()]
        return out

    def visit(self, q: np.ndarray):
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
            else:
                for d, c in zip(((self.stacked[node] - q) ** 2).sum(1).tolist(), self.children[node], strict=True):
                    heapq.heappush(queue, (d, c))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = np.argmin(_squares(x, centers), 1)
        centers = np.stack([x[label == j].mean(0) if (label == j).any() else centers[j] for j in range(len(centers))])
    return label


def calibrated(tree: Tree, x: np.ndarray, k: int, recall: float, rng: np.random.Generator, queries: int = 300) -> int:
    """The least number of leaves at which sample queries reach the recall against the whole sample."""
    leaf = tree.assign(x)
    picks = rng.choice(len(x), min(queries, len(x)), replace=False)
    at = []
    for i in picks:
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        true = np.argsort(far, kind="stable")[: min(k, len(x) - 1)]
        order = {v: j for j, v in enumerate(tree.visit(x[i]))}
        at += [order[v] for v in leaf[true].tolist()]
    if not at:
        return tree.leaves
    visits = np.sort(np.array(at)) + 1
    return int(visits[min(len(visits) - 1, int(np.ceil(recall * len(visits))) - 1)])


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.985, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by Euclidean distance."""
    rows = usable(df, id_col, vec_col, is_query).where(F.exists("vec", lambda x: x != 0))
    sizes = lengths(rows)
    if not sizes:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    d, (n, _) = next(iter(sizes.items()))
    main, asked, spark = rows.where(F.col("d") == d), queries(rows), rows.sparkSession
    size = max(1, min(SAMPLE, COMPONENTS // d))
    x = matrix(main.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("vec").toArrow()["vec"])
    rng = np.random.default_rng(seed)
    tree = Tree().grow(x, min(64, max(8, len(x) // 16)) if n <= size else max(8, int(256 * len(x) / n)), rng)
    visits = calibrated(tree, x, k, recall, rng)
    sent = spark.sparkContext.broadcast(tree)

    def place(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.assign(matrix(batch.column(1))))], names=["vec_id", "vec", "leaf"])

    placed = written(main.select("vec_id", "vec").mapInArrow(place, "vec_id long, vec array<double>, leaf long"), "vector-leaves")
    others = rows.where(F.col("d") != d).select("vec_id", "vec", (-F.col("d")).cast("long").alias("leaf"))  # a leaf for each other length
    counts = {r["leaf"]: r["c"] for r in placed.groupBy("leaf").agg(F.count("*").alias("c")).collect()}  # at most LEAVES rows
    counts |= {-length: c for length, (c, _) in sizes.items() if length != d}
    deep = {leaf: c for leaf, c in counts.items() if leaf >= 0 and c > DEEP}
    blocks = {leaf: 1 if leaf in deep else -(-c // BLOCK) for leaf, c in counts.items()}
    held = spark.sparkContext.broadcast((counts, blocks))

    def walk(it):
        for batch in it:
            counts, blocks = held.value
            keep, leaf, block = [], [], []
            for i, q in enumerate(matrix(batch.column(1))):
                rows_ = seen = 0
                for v in sent.value.visit(q):
                    if seen >= visits and rows_ >= 4 * (k + 1):
                        break
                    seen, rows_ = seen + 1, rows_ + counts.get(v, 0)
                    for b in range(blocks.get(v, 0)):
                        keep.append(i)
                        leaf.append(v)
                        block.append(b)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(leaf, pa.int64()), pa.array(block, pa.int64())], names=["vec_id", "vec", "leaf", "block"])

    many = F.element_at(F.create_map(*[F.lit(int(v)).cast("long") for kv in blocks.items() for v in kv]), F.col("leaf"))
    found = asked.where(F.col("d") == d).select("vec_id", "vec").mapInArrow(walk, "vec_id long, vec array<double>, leaf long, block long")
    if deep:
        found = written(found, "vector-walks")
        is_deep = F.col("leaf").isin(list(deep))
        deep_rows, deep_queries = _second_level(placed.where(is_deep), found.where(is_deep), deep, k, recall, seed)
        placed, found = placed.where(~is_deep), found.where(~is_deep)
    if len(sizes) > 1:
        rest = asked.where(F.col("d") != d).select("vec_id", "vec", (-F.col("d")).cast("long").alias("leaf"))
        found = found.unionByName(rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))))
        placed = placed.unionByName(others)
    held_rows = placed.select("vec_id", "vec", "leaf", F.lit(0).cast("long").alias("sub"), F.pmod(F.xxhash64("vec_id", "vec"), many).alias("block"))
    found = found.withColumn("sub", F.lit(0).cast("long"))
    if deep:
        held_rows, found = held_rows.unionByName(deep_rows), found.unionByName(deep_queries)
    both = held_rows.withColumn("is_query", F.lit(False)).unionByName(found.withColumn("is_query", F.lit(True)))

    def compare(table: pa.Table) -> pa.Table:
        is_q = table["is_query"].to_numpy(zero_copy_only=False)
        ids, x = table["vec_id"].to_numpy(), matrix(table["vec"])
        data_ids, data = ids[~is_q], x[~is_q]
        out: list[list] = [[], [], []]
        for query, q in zip(ids[is_q], x[is_q], strict=True) if len(data_ids) else ():
            far = np.sqrt(((data - q) ** 2).sum(1))
            best = np.lexsort((data_ids, far))
            best = best[data_ids[best] != query][:k]
            out[0].append(np.full(len(best), query))
            out[1].append(data_ids[best])
            out[2].append(far[best])
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0, t)) for n, c, t in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})

    found = both.groupBy("leaf", "sub", "block").applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _second_level(rows: DataFrame, asked: DataFrame, counts: dict[int, int], k: int, recall: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id, vec, leaf, sub, block of the rows, the same of the queries) of leaves that have a tree of their own."""
    of_leaf = lambda f: F.element_at(F.create_map(*[F.lit(int(v)).cast("long") for leaf, c in counts.items() for v in (leaf, f(c))]), F.col("leaf"))
    chance = 1 << 40
    drawn = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(chance)) < of_leaf(lambda c: chance * SUB_SAMPLE // c)

    def fit(table: pa.Table) -> pa.Table:
        leaf = table["leaf"][0].as_py()
        rng = np.random.default_rng([seed, leaf])
        x = np.unique(matrix(table["vec"]), axis=0)  # copies don't hide the rest
        tree = Tree().grow(x, max(8, BLOCK // 8 * len(x) // counts[leaf]), rng)
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "tree": pa.array([pickle.dumps((tree, calibrated(tree, x, k, recall, rng)))], pa.binary())})

    trees = written(rows.withColumn("drawn", drawn).where("drawn").select("leaf", "vec").groupBy("leaf").applyInArrow(fit, "leaf long, tree binary"), "vector-trees")

    def with_trees(df: DataFrame, trees: DataFrame, parts: Column):
        """Rows dealt into parts, each with its own copy of the leaf's tree."""
        dealt = df.withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), parts))
        return dealt.unionByName(trees.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), allowMissingColumns=True).groupBy("leaf", "part")

    def opened(table: pa.Table) -> tuple[Tree | None, int, pa.Table]:
        found = [x for x in table["tree"].to_pylist() if x is not None]
        return (*(pickle.loads(found[0]) if found else (None, 1)), table.filter(table["vec"].is_valid()))

    def settle(table: pa.Table) -> pa.Table:
        tree, _, table = opened(table)
        sub = tree.assign(matrix(table["vec"])) if tree and len(table) else np.zeros(len(table), np.int64)
        return table.select(["vec_id", "vec", "leaf"]).append_column("sub", pa.array(sub, pa.int64()))

    settled = written(with_trees(rows, trees, of_leaf(lambda c: -(-c // DEEP))).applyInArrow(settle, "vec_id long, vec array<double>, leaf long, sub long"), "vector-subleaves")
    sizes = written(settled.groupBy("leaf", "sub").agg(F.count("*").alias("c")), "vector-sizes")
    full = sizes.groupBy("leaf").agg(F.collect_list(F.struct("sub", "c")).alias("sizes"))  # at most LEAVES a leaf
    loads = asked.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(DEEP)).alias("n")).collect()  # a number a leaf
    parts = F.element_at(F.create_map(*[F.lit(int(v)).cast("long") for r in loads for v in r]), F.col("leaf")) if loads else F.lit(1).cast("long")

    def walk(table: pa.Table) -> pa.Table:
        sizes = next((x for x in table["sizes"].to_pylist() if x is not None), [])
        tree, visits, table = opened(table)
        sizes = {r["sub"]: r["c"] for r in sizes}
        take, sub, block = [], [], []
        for i, q in enumerate(matrix(table["vec"])) if len(table) else ():
            rows_ = seen = 0
            for v in tree.visit(q) if tree else sizes:
                if tree and seen >= visits and rows_ >= 4 * (k + 1):
                    break
                seen, rows_ = seen + 1, rows_ + sizes.get(v, 0)
                for b in range(-(-sizes.get(v, 0) // BLOCK)):
                    take.append(i)
                    sub.append(v)
                    block.append(b)
        table = table.select(["vec_id", "vec", "leaf"]).take(pa.array(take, pa.int64()))
        return table.append_column("sub", pa.array(sub, pa.int64())).append_column("block", pa.array(block, pa.int64()))

    queries_ = with_trees(asked.drop("block"), full.join(trees, "leaf", "left").join(asked.select("leaf").distinct(), "leaf", "left_semi"), parts)
    queries_ = queries_.applyInArrow(walk, "vec_id long, vec array<double>, leaf long, sub long, block long")
    large = sizes.where(F.col("c") > BLOCK).select("leaf", "sub", F.ceil(F.col("c") / F.lit(BLOCK)).alias("blocks"))
    if large.limit(FEW + 1).count() <= FEW:
        large = F.broadcast(large)
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.coalesce("blocks", F.lit(1).cast("long")))
    return settled.join(large, ["leaf", "sub"], "left").withColumn("block", block).drop("blocks"), queries_
