"""Approximate nearest neighbours by a hierarchical k-means tree.

1. The tree is fitted on at most ``SAMPLE`` rows (and ``SAMPLE_BYTES``), chosen by a hash: a
   node of more than ``LEAF`` sampled rows is split by k-means into ``BRANCHES`` children.
   The fitted centres are all that is ever broadcast.  Every row descends to a leaf.
2. A query walks the tree best bin first: a priority queue of nodes by the distance of
   their centres, a leaf that leaves the queue is visited.  Leaves are visited until as many
   were as calibrated, and hold the query's k candidates in any case (all, if there are
   fewer).
3. Calibration: the true neighbours of ``CALIBRATED`` queries (chosen by a hash) among all
   rows are found by brute force.  Their leaves' places in the queries' own walks tell the
   recall of any number of visits, which is widened until ``recall`` is reached.
4. Rows and visiting queries meet in cells: a leaf's rows and its queries are dealt to parts
   of bounded size, so a leaf that holds a third of all rows, or that every query visits,
   is many cells.  A first pass takes the nearest leaves of each query, its k-th distance
   bounds what the second pass, over the other leaves, sends on.  Distances are those of the
   original vectors in double precision; equal ones rank by id.

Vectors that are null, zero or hold a null or a non-finite component take no part, rows
with a null id neither.  Vectors of unequal lengths meet as if padded with zeros.  A query's
own row is every row with its id, and of rows that repeat a query's id the least vector
(element by element) asks; as candidates repeated rows count each.  No rows, no queries or
no candidates give no rows.  Other columns are ignored; they may have the result's names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, gathered, release, small_batches, written

K = 10
RECALL = 0.97
SAMPLE, SAMPLE_BYTES = 32_768, 64 << 20
BRANCHES, LEAF, ITERATIONS = 8, 128, 10
CALIBRATED = 128
CELL_QUERIES, CELL_ROWS = 1024, (256, 2048)  # rows of a cell: those of a mean leaf, within these bounds
_GATHERED = 8192


def clean(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row (a number of its own), vec_id, vec, dim of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            ends, flat = vecs.offsets.to_numpy(), vecs.values.to_numpy(zero_copy_only=False).astype(float)
            count = lambda mask, ends=ends: np.concatenate([[0], np.cumsum(mask)])[ends]
            odd, some = np.diff(count(~np.isfinite(flat))), np.diff(count(flat != 0))
            kept = pc.and_(pc.and_(ids.is_valid(), vecs.is_valid()), pa.array((odd == 0) & (some > 0)))
            ids, vecs = ids.filter(kept), vecs.filter(kept)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(ids))), ids, vecs, pc.list_value_length(vecs)], names=["row", "vec_id", "vec", "dim"])
            number += len(ids)

    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return vectors.mapInArrow(run, "row long, vec_id long, vec array<double>, dim int")


def matrix(vecs: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of ``dim`` components, padded with zeros."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    flat, sizes = vecs.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a and b, as products; rounding may make them a little wrong."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


# ------------------------------------------------------------------------------ tree


class Tree:
    """Nodes in the order of their making; the children of a node follow each other."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        centres, self.first, self.count, waiting = [sample.mean(axis=0)], [0], [0], [sample]
        at = 0
        while at < len(centres):
            mine, waiting[at] = waiting[at], sample[:0]
            if len(mine) > leaf:
                parts = self._split(mine, branches, rng)
                if len(parts) > 1:
                    self.first[at], self.count[at] = len(centres), len(parts)
                    for p in parts:
                        centres.append(p.mean(axis=0))
                        self.first.append(0)
                        self.count.append(0)
                        waiting.append(p)
            at += 1
        self.centres = np.asarray(centres)
        ends = np.asarray(self.count) == 0
        self.leaf = np.where(ends, np.cumsum(ends) - 1, -1)
        self.leaves = int(ends.sum())

    @staticmethod
    def _split(rows: np.ndarray, branches: int, rng: np.random.Generator) -> list[np.ndarray]:
        centres = np.unique(rows[rng.choice(len(rows), branches, replace=False)], axis=0)
        for _ in range(ITERATIONS):
            own = _squares(rows, centres).argmin(axis=1)
            centres = np.asarray([rows[own == c].mean(axis=0) for c in np.unique(own)])
        own = _squares(rows, centres).argmin(axis=1)
        return [rows[own == c] for c in np.unique(own)]

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf to which each row descends."""
        node = np.zeros(len(rows), np.int64)
        while True:
            inner = np.unique(node[self.leaf[node] < 0])
            if not len(inner):
                return self.leaf[node].astype(np.int32)
            for x in inner:
                here, a = np.flatnonzero(node == x), self.first[x]
                node[here] = a + _squares(rows[here], self.centres[a : a + self.count[x]]).argmin(axis=1)

    def walk(self, squares: np.ndarray) -> Iterator[int]:
        """Leaves in the order of visits, for the squared distances of all nodes' centres."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
            else:
                for child in range(self.first[node], self.first[node] + self.count[node]):
                    heapq.heappush(queue, (squares[child], child))


def fitted(vectors: DataFrame, dim: int, n: int) -> Tree:
    """The tree of a bounded sample of the rows."""
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dim))))
    order = F.xxhash64("row", F.lit(1))
    some = vectors.filter(F.pmod(order, F.lit(n)) < 2 * size) if n > 2 * size else vectors
    return Tree(matrix(some.orderBy(order).limit(size).select("vec").toArrow().column(0), dim))


# ------------------------------------------------------------------------------ distances


def nearest(qids: np.ndarray, queries: np.ndarray, bound: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query places, row places, distances): the k nearest rows of each query within its bound."""
    top = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    if not 1e-100 < top < 1e100:  # squares would leave the range of doubles
        q, r, d = nearest(qids, queries / top, bound / top, ids, rows / top, k)
        return q, r, d * top
    near = _squares(queries, rows)
    slack = 1e-9 * ((queries * queries).sum(1) + (rows * rows).sum(1).max(initial=0))
    near[qids[:, None] == ids] = np.inf
    least = np.partition(near, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(qids), np.inf)
    q, r = np.nonzero(np.isfinite(near) & (near <= (np.minimum(least, bound * bound) + slack)[:, None]))
    d = np.sqrt(((queries[q] - rows[r]) ** 2).sum(axis=1))
    order = np.lexsort((ids[r], d, q))
    q, r, d = q[order], r[order], d[order]
    first = np.searchsorted(q, q)
    kept = (np.arange(len(q)) - first < k) & (d <= bound[q])
    return q[kept], r[kept], d[kept]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_neighbours(rows: DataFrame, qids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, leaf, score, rank of a bounded number of queries against all rows."""
    sent = rows.sparkSession.sparkContext.broadcast((qids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = sent.value
        bound = np.full(len(ids), np.inf)
        try:
            for batch in gathered(batches, _GATHERED):
                own = batch.column(0).to_numpy()
                q, r, d = nearest(ids, vecs, bound, own, matrix(batch.column(1), vecs.shape[1]), k)
                sizes = np.bincount(q, minlength=len(ids))
                full = sizes >= k  # k rows of this batch lie within the last one's distance
                bound[full] = np.minimum(bound[full], d[np.cumsum(sizes)[full] - 1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[r]), batch.column(2).take(pa.array(r)), pa.array(d)], names=["query_id", "vec_id", "leaf", "score"])
        finally:
            release()

    return _ranked(rows.select("vec_id", "vec", "leaf").mapInArrow(run, "query_id long, vec_id long, leaf int, score double"), k)


# ------------------------------------------------------------------------------ search


def needed_visits(tree: Tree, places: dict[int, list[int]], recall: float) -> int:
    """How many visits reach the recall; ``places``: the leaves' places of the queries' true neighbours."""
    at = np.asarray([p for ps in places.values() for p in ps])
    visits = 1
    while len(at) and visits < tree.leaves and (at < visits).mean() < recall:
        visits += max(1, visits // 16)
    return min(visits, tree.leaves)


def _visits(queries: DataFrame, sent, sizes: np.ndarray, visits: int, k: int) -> DataFrame:
    """query_id, vec, leaf, near: the leaves of each query's walk; near: the first that hold some 4 k rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            squares = _squares(matrix(batch.column(1), tree.dim), tree.centres)
            at, leaf, near = [], [], []
            for i, own in enumerate(batch.column(2).to_pylist()):
                seen = walked = 0
                for x in tree.walk(squares[i]):
                    if walked >= visits and seen >= k + own:
                        break
                    walked += 1
                    if sizes[x]:
                        at.append(i)
                        leaf.append(x)
                        near.append(seen < 4 * k + own)
                    seen += sizes[x]
            took = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(leaf, pa.int32()), pa.array(near, pa.bool_())], names=["query_id", "vec", "leaf", "near"])

    return queries.mapInArrow(run, "query_id long, vec array<double>, leaf int, near boolean")


def _met(rows: DataFrame, visits: DataFrame, sizes: np.ndarray, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the nearest rows of each query in each cell, within its ``bound``."""
    spark = rows.sparkSession
    least, most = CELL_ROWS
    size = int(min(most, max(least, sizes.mean())))
    parts = spark.createDataFrame([(i, -(-int(n) // size)) for i, n in enumerate(sizes) if n], "leaf int, parts int")  # a row a leaf
    asked = visits.groupBy("leaf").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("qparts"))
    cells = F.broadcast(parts.join(asked, "leaf"))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(cells, "leaf").select("query_id", "vec", "bound", "leaf", every("parts").alias("part"), dealt("query_id", "qparts").alias("qpart"))
    right = rows.join(cells, "leaf").select("vec_id", "vec", "leaf", dealt("row", "parts").alias("part"), every("qparts").alias("qpart"))

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        qids, ids = asking.column("query_id").to_numpy(), held.column("vec_id").to_numpy()
        q, r, d = nearest(qids, matrix(asking.column("vec"), dim), asking.column("bound").to_numpy(), ids, matrix(held.column("vec"), dim), k)
        return pa.table({"query_id": pa.array(qids[q], pa.int64()), "vec_id": pa.array(ids[r], pa.int64()), "score": pa.array(d, pa.float64())})

    key = ["leaf", "part", "qpart"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")


def neighbours(rows: DataFrame, is_query: Callable[[Column], Column], k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows of every query.

    ``is_query``: a Column over the id that tells which rows ask.
    """
    spark = rows.sparkSession
    small_batches(spark)
    vectors = written(clean(rows, id_col, vec_col), "ann-vectors")
    seen = vectors.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n, dim = seen["n"], seen["dim"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(fitted(vectors, dim, n))
    tree = sent.value

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in gathered(batches, _GATHERED):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.leaf_of(matrix(batch.column(2), own.dim)))], names=["row", "vec_id", "vec", "leaf"])

    table = written(vectors.select("row", "vec_id", "vec").mapInArrow(descend, "row long, vec_id long, vec array<double>, leaf int"), "ann-leaves")
    dropped(vectors)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in table.groupBy("leaf").count().collect():  # a row a leaf
        sizes[r["leaf"]] = r["count"]
    queries = written(table.filter(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"), F.count("*").alias("own")), "ann-queries")

    some = queries.orderBy(F.xxhash64("query_id", F.lit(2))).limit(CALIBRATED).select("query_id", "vec").toArrow()
    qids, asked = some.column(0).to_numpy(), matrix(some.column(1), dim)
    places: dict[int, list[int]] = {}
    if len(qids):
        walks = {int(q): {leaf: i for i, leaf in enumerate(tree.walk(s))} for q, s in zip(qids, _squares(asked, tree.centres), strict=True)}
        for r in exact_neighbours(table, qids, asked, k).collect():  # k rows for each calibrated query
            places.setdefault(r["query_id"], []).append(walks[r["query_id"]][r["leaf"]])
    visits = written(_visits(queries, sent, sizes, needed_visits(tree, places, recall), k), "ann-visits")

    first = written(_met(table, visits.filter("near").withColumn("bound", F.lit(float("inf"))), sizes, dim, k), "ann-first")
    reach = _ranked(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("reach"))
    far = visits.filter("not near").join(reach, "query_id", "left").withColumn("bound", F.coalesce("reach", F.lit(float("inf")))).drop("reach")
    found = first.unionAll(_met(table, far, sizes, dim, k))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
