"""Near-duplicate documents by MinHash banding and sequential Bayesian verification.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Documents with equal sets (by size and two sums of
mixed hashes, 128 bits) form a class, and only one document a class goes on.  MinHash values are cut into bands, as many as
:func:`layout` derives from the threshold; documents that share a band are candidates.
Signatures of candidates are compared a batch at a time, and a pair is dropped as soon as the posterior probability (flat
prior) that its similarity reaches the threshold falls below ``MISS``.  Survivors are verified exactly on full sets.

No group is expanded into pairs of rows.  First every member of a band's bucket is compared with the bucket's smallest document, its
head, and components are built from the links.  Where the members of a head still belong to several components, the smallest
member outside the first one becomes a second head, for REHEADS rounds, so that large groups of copies close up.  Whatever is
still mixed then is compared across components in blocks, within the tasks: first by signatures alone, which tells the
members that can have a link at all, then, for these, on full sets.  Only links that join components leave a task, and no link is
lost.  A pair at the threshold t shares no band with probability ``(1 - t ** rows) ** bands``, below LOST at every threshold.

Scale: signatures are one row a document; counts of shared bands are pre-aggregated; joins on hot keys are sort-merge joins of
written tables, which Spark splits; a head's members are dealt into slots, and its text is read once a slot; texts are sent for
candidates only (chosen by a bit table of at most BITS bits, and beyond BITS / 8 candidates by a join as well).  Components are
built by the large-star / small-star rounds of Kiveris et al., on tables in the shared folder.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; with one to four words the
whole sequence is the one shingle; rows that repeat an id share its component; an id must be a whole number (a TypeError tells
if the column isn't), one that is null is linked with nothing; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import MAX_ROWS, batches, in_small_batches, joined, mix64, tidy, whole_numbers, word_hashes, written

WORDS, ROWS, LOST, MISS = 5, 5, 1e-5, 1e-6
STEP = 20  # hashes compared at a time
MOST = 200  # hashes beyond which bands get fewer rows
REHEADS = 2  # rounds with further heads
SLOT, SIGNED, BLOCK, SHINGLES = 1024, 1024, 1024, 500_000  # members of a head compared in a task: with it, by signatures, on sets
BITS = 1 << 26
#: Heads (a few numbers each) up to which a table of them is sent to all tasks; their members then stay where they are.
HEADS = 100_000
_PLACE = mix64(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within a row, and the index of each row's first (n + 1)."""
    words, first = word_hashes(*joined(column))
    rows, n = np.diff(first), len(first) - 1
    count = np.where(rows >= WORDS, rows - WORDS + 1, np.minimum(rows, 1))
    owner = np.repeat(np.arange(n), count)
    at = np.repeat(first[:-1], count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    left = np.minimum(np.repeat(rows, count), WORDS)
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    found = left.astype(np.uint64)
    for k in range(WORDS):
        found += np.where(k < left, padded[at + k], np.uint64(0)) * _PLACE[k]
    found = mix64(found)
    order = np.argsort(found)
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]  # by row, then by hash
    key, row = found[order], owner[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))) if len(key) else np.empty(0, bool)
    return key[new], np.searchsorted(row[new], np.arange(n + 1))


def layout(percent: int) -> tuple[int, int]:
    """(bands, rows of a band): the fewest bands with which a pair at the threshold shares none with probability below LOST.

    Bands have ROWS rows, fewer where that takes more than MOST hashes; the number of hashes is a multiple of STEP.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    for rows in range(ROWS, 0, -1):
        shared = (percent / 100) ** rows
        bands = math.floor(math.log(LOST) / math.log1p(-shared)) + 1 if shared < 1 else 1
        step = STEP // math.gcd(rows, STEP)
        bands = -(-bands // step) * step
        if bands * rows <= MOST or rows == 1:
            return bands, rows


def least_matches(threshold: float, hashes: int) -> dict[int, int]:
    """For each number of hashes compared, the fewest matches that keep P(similarity >= threshold) at MISS or more."""
    grid = (np.arange(20000) + 0.5) / 20000
    out = {}
    for n in range(STEP, hashes + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(logs - logs.max())
            if mass[grid >= threshold].sum() >= MISS * mass.sum():
                out[n] = m
                break
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (keys of the set), bands (hashes), sig (two bytes a hash)."""
    n_bands, n_rows = layout(percent)
    hashes = n_bands * n_rows
    odd = mix64(np.arange(101, 101 + hashes, dtype=np.uint64)) | np.uint64(1)

    def sign(it):
        for batch in it:
            for a, b in batches(batch.column(1).cast(pa.large_string()), 2 << 20):
                sets, first = shingles(batch.column(1).slice(a, b - a))
                size = np.diff(first)
                some = np.flatnonzero(size)
                sig = np.zeros((b - a, hashes), np.uint64)
                key = np.zeros((2, b - a), np.uint64)
                if len(some):
                    for k in range(hashes):
                        sig[some, k] = np.minimum.reduceat(sets * odd[k], first[some])
                    key[0, some] = np.add.reduceat(sets, first[some])
                    key[1, some] = np.add.reduceat(mix64(sets), first[some])
                band = np.zeros((b - a, n_bands), np.uint64)
                for k in range(n_rows):
                    band = mix64(band + sig[:, k::n_rows] + np.uint64(k + 1))
                band = mix64(band + np.arange(n_bands, dtype=np.uint64))
                short = (sig >> np.uint64(48)).astype("<u2")
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * n_bands, n_bands), pa.int32()), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), bands, pa.array([r.tobytes() for r in short], pa.binary())], names=["doc_id", "n", "k1", "k2", "bands", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(sign), "doc_id long, n long, k1 long, k2 long, bands array<long>, sig binary")


def _alike(x: np.ndarray, y: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Of rows of signatures, which pairs survive the comparison batch by batch."""
    live, match = np.arange(len(x)), np.zeros(len(x), np.int64)
    for n, m in least.items():
        match = match + (x[live, n - STEP : n] == y[live, n - STEP : n]).sum(1)
        keep = match >= m
        live, match = live[keep], match[keep]
    return live


def _sigs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def bit_table(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of so many bits with one set for each id."""
    bit = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    rows = ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v"))
    out = np.zeros(bits >> 6, np.int64)
    table = rows.toArrow()  # at most bits / 64 rows
    out[table["w"].to_numpy()] = table["v"].to_numpy()
    return out


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i and t, the texts of the ids in column i (and of a few others, by chance): one pass over the documents."""
    n = ids.count()
    bits = min(BITS, 1 << max(10, (16 * n).bit_length()))
    table = docs.sparkSession.sparkContext.broadcast(bit_table(ids, "i", bits))

    def asked(it):
        for batch in it:
            b = batch.column(2).to_numpy()
            on = (table.value[b >> 6] >> (b & 63)) & 1 == 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string())], names=["i", "t"]).filter(pa.array(on))

    bit = F.pmod(F.xxhash64(F.col("_i")), F.lit(bits))
    rows = docs.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("_t")).where("_i is not null").withColumn("_b", bit)
    found = rows.mapInArrow(tidy(asked), "i long, t string")
    if n > BITS // 8:  # the table is too full to choose alone
        found = found.join(ids.select("i").distinct(), "i", "left_semi")
    return written(found, "near-texts")


def verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The pairs (a, b), many of them with one a, with ``100 * intersection >= percent * union``."""
    least = least_matches(percent / 100, np.prod(layout(percent)))
    sides = [sigs.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))

    def prune(it):
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(_alike(_sigs(batch.column(2)), _sigs(batch.column(3)), least)))

    left = written(both.select("a", "b", "sa", "sb").mapInArrow(tidy(prune), "a long, b long"), "near-pairs")
    texts = texts_of(docs, left.select(F.col("a").alias("i")).unionByName(left.select(F.col("b").alias("i"))), id_col, text_col)
    many = written(left.groupBy("a").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("p")), "near-slots")
    members = left.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("p")).cast("int").alias("slot"))
    members = members.join(texts, members.b == texts.i).select("a", "slot", "b", "t")
    heads = many.join(texts, many.a == texts.i).select("a", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("slot"), F.lit(None).cast("long").alias("b"), "t")

    def exact(it):
        now, own = None, None
        for batch in it:
            for x, y in batches(batch.column(3).cast(pa.large_string()), 2 << 20):
                keep = []
                sets, first = shingles(batch.column(3).slice(x, y - x))
                for i, (a, slot, b) in enumerate(zip(*(batch.column(c).slice(x, y - x).to_pylist() for c in range(3)), strict=True)):
                    q = sets[first[i] : first[i + 1]]
                    if b is None:  # the head comes first
                        now, own = (a, slot), q.copy()
                    elif now == (a, slot):
                        common = len(np.intersect1d(own, q, assume_unique=True))
                        if common and 100 * common >= percent * (len(own) + len(q) - common):
                            keep.append(x + i)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    rows = heads.unionByName(members).repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())
    return rows.mapInArrow(tidy(exact), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of the nodes of links (a, b)."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links")  # large star
        edges = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "links")  # small star
        small = edges.join(least, "u")
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")


def joined_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The components after some more links."""
    return written(components(links.unionByName(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b"))), "near-labels")


def small(heads: DataFrame, tag: str) -> DataFrame:
    """A written table of heads, to be broadcast where it has at most HEADS rows."""
    heads = written(heads, tag)
    return F.broadcast(heads) if heads.count() <= HEADS else heads


def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """head, doc_id, component c, and the head's least component c0, of the members of heads whose members belong to several."""
    rows = members.join(labels, members.doc_id == labels.node, "left").select("head", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    rows = written(rows, "near-labelled")
    some = rows.groupBy("head").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("head", "c0")
    return written(rows.join(small(some, "near-heads"), "head"), "near-mixed")


def dealt(rows: DataFrame, size: int, weight: int, *columns: str) -> DataFrame:
    """Members (head, doc_id, c, n, ...) dealt into blocks, and every two blocks of a head brought together as (head, x, y).

    A block has at most ``size`` rows, or ``weight`` shingles, on average.
    """
    parts = F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum("n") / weight)).cast("int")
    rows = rows.join(small(rows.groupBy("head").agg(parts.alias("p")), "near-parts"), "head").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("p")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    return rows.select("head", F.least("i", "o").alias("x"), F.greatest("i", "o").alias("y"), "i", "doc_id", "c", "n", *columns)


def crossing(members: DataFrame, labels: DataFrame, sigs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The labels after all links between members (head, doc_id) of one head.

    A pair that shares a bucket shares its head, and heads have been compared with their members.  Once members of two
    components are linked these count as one, so that a task gives fewer links than it has rows, however alike they are.
    """
    least = least_matches(percent / 100, np.prod(layout(percent)))
    for _ in range(REHEADS):
        rows = mixed(members, labels)
        if rows.isEmpty():
            return labels
        second = rows.where("c <> c0").groupBy("head").agg(F.min(F.struct("doc_id", "c")).alias("s"))
        pairs = rows.join(small(second, "near-seconds"), "head").where("c <> s.c").select(F.col("s.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
        links = written(verified(pairs, sigs, docs, id_col, text_col, percent), "near-links")
        if links.isEmpty():
            break
        labels = joined_labels(links, labels)
    rows = mixed(members, labels)
    if rows.isEmpty():
        return labels
    rows = written(rows.join(sigs.select("doc_id", "n", "sig"), "doc_id"), "near-members")

    def possible(table: pa.Table) -> pa.Table:
        """Members that some member of another component may be linked with, by their signatures."""
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        n, block, comp, sig = table["n"].to_numpy(), table["i"].to_numpy(), table["c"].to_numpy(), _sigs(table["sig"])
        on = np.zeros(len(n), bool)
        right = np.flatnonzero(block == y)
        for i in np.flatnonzero(block == x).tolist():
            j = right[~on[right]] if on[i] else right
            j = j[(comp[j] != comp[i]) & (n[j] * 100 >= n[i] * percent) & (n[i] * 100 >= n[j] * percent)]
            j = j[_alike(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], least)]
            if len(j):
                on[i] = on[j] = True
        return table.select(["head", "doc_id"]).filter(pa.array(on))

    some = dealt(rows, SIGNED, 1 << 62, "sig").groupBy("head", "x", "y").applyInArrow(tidy(possible), "head long, doc_id long").distinct()
    rows = written(rows.join(some, ["head", "doc_id"]), "near-members")
    texts = texts_of(docs, rows.select(F.col("doc_id").alias("i")), id_col, text_col)
    full = dealt(rows.join(texts.select(F.col("i").alias("doc_id"), "t"), "doc_id"), BLOCK, SHINGLES, "sig", "t")

    def compare(table: pa.Table) -> pa.Table:
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        ids, n, block = (table[k].to_numpy() for k in ("doc_id", "n", "i"))
        _, comp = np.unique(table["c"].to_numpy(), return_inverse=True)
        sig = _sigs(table["sig"])
        parts_ = [shingles(table["t"].combine_chunks().slice(a, MAX_ROWS)) for a in range(0, len(table), MAX_ROWS)]
        sizes = np.concatenate([np.diff(f) for _, f in parts_])
        first = np.concatenate(([0], np.cumsum(sizes)))
        known, which = np.unique(np.concatenate([s for s, _ in parts_]), return_inverse=True)
        mine = np.zeros(len(known), bool)
        out: list[list] = [[], []]
        right = np.flatnonzero(block == y)
        for i in np.flatnonzero(block == x).tolist():
            j = right[(comp[right] != comp[i]) & (n[right] * 100 >= n[i] * percent) & (n[i] * 100 >= n[right] * percent)]
            j = j[j > i] if x == y else j
            j = j[_alike(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], least)]
            if not len(j):
                continue
            own = which[first[i] : first[i + 1]]
            mine[own] = True
            if len(j) < 16:
                common = np.array([np.count_nonzero(mine[which[first[k] : first[k + 1]]]) for k in j.tolist()])
            else:
                common = np.add.reduceat(mine[which].astype(np.int64), first[:-1])[j]
            mine[own] = False
            for k in j[100 * common >= percent * (n[i] + n[j] - common)].tolist():
                if comp[k] != comp[i]:
                    comp[comp == comp[k]] = comp[i]
                    out[0].append(min(ids[i], ids[k]))
                    out[1].append(max(ids[i], ids[k]))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip("ab", out, strict=True)})

    links = written(full.groupBy("head", "x", "y").applyInArrow(tidy(compare), "a long, b long").distinct(), "near-crossing")
    return labels if links.isEmpty() else joined_labels(links, labels)


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document is its component's smallest) of every row."""
    table = written(signatures(in_small_batches(whole_numbers(docs, id_col)), id_col, text_col, percent), "near-signatures")
    full = table.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "near-classes")
    sigs = written(full.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id"]), "near-reps")
    spread = sigs.select("doc_id", F.explode("bands").alias("key"))
    heads = written(spread.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("m")).where("m > 1").select("key", "head"), "near-heads")
    members = written(spread.join(heads, "key").where("doc_id <> head").select("head", "doc_id").distinct(), "near-shared")
    links = written(verified(members.select(F.col("head").alias("a"), F.col("doc_id").alias("b")), sigs, docs, id_col, text_col, percent), "near-links")
    labels = crossing(members, written(components(links), "near-labels"), sigs, docs, id_col, text_col, percent)
    keys = ("n", "k1", "k2")
    named = written(classes.join(labels, F.col("rep") == F.col("node"), "left").select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce("component", "rep").alias("_c")), "near-named")
    out = table.select("doc_id", *keys).join(named, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    component = F.coalesce(F.when(F.col("n") > 0, F.col("_c")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with the same columns, of which one a component stays."""
    name = "gone"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    gone = written(near_duplicates(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "near-gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")


#: DuckDB SQL for the rows of :func:`near_duplicates` with its defaults.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(x, y) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, s.doc_id = coalesce(c.c, s.doc_id) AS kept FROM s LEFT JOIN c ON c.x = s.doc_id
"""
