"""Exact top-k inner products by distributed histogram selection.

Components become floor(64 x), so scores are integers.  Queries are a stated set of rows;
they are taken in blocks of ``block`` at most, and only such a block is ever broadcast.
For a block, every candidate is scored, and each query's k-th best score is located by
refining a histogram of all scores: each task counts scores into ``bins`` equal bins of
the query's range and sends on its highest bins, as far down as they hold k scores (lower
ones cannot matter); the bins are added up over all tasks, and the bin that holds the
k-th score becomes the next, narrower range, until a bin is one score wide.  A last pass
keeps the scores above it and, of those equal to it, the smallest ids that are needed.

Vectors that are null or hold a null or a non-finite component take no part; rows with a
null id neither.  Vectors of unequal lengths meet as if padded with zeros.  A query's own
row is every row with its id.  Scores beyond +-(2**63 - 1) are set to the nearer of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

BLOCK = 4096
BINS = 256
_SCORES = 1 << 20  # scores held at once in a task
_MOST = (1 << 63) - 1  # largest magnitude of a score
_ZERO = np.uint64(1 << 63)  # where scores as unsigned numbers have their zero


def quantised(rows: DataFrame, id_col: str, vec_col: str, scale: float = 64.0) -> DataFrame:
    """vec_id, vec (floor(scale * x) as packed doubles), top (largest magnitude), dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                q = np.floor(np.asarray(v, np.float64) * scale)
                if np.isfinite(q).all():
                    ids.append(i)
                    vecs.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([v.tobytes() for v in vecs], pa.binary()), pa.array([float(np.abs(v).max(initial=0)) for v in vecs], pa.float64()), pa.array([len(v) for v in vecs], pa.int32())], names=["vec_id", "vec", "top", "dim"])

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).mapInArrow(run, "vec_id long, vec binary, top double, dim int")


class Scorer:
    """Scores of a block of queries against batches of candidates, as exact integers."""

    def __init__(self, ids: np.ndarray, vecs: list[bytes], dim: int, top: float):
        bound = dim * top * top
        self.kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 and top < 1 << 53 else object
        self.ids, self.dim = ids, dim
        self.matrix = self.rows(vecs)

    def rows(self, vecs: list[bytes]) -> np.ndarray:
        out = np.zeros((len(vecs), self.dim))
        for i, v in enumerate(vecs):
            x = np.frombuffer(v)
            out[i, : len(x)] = x
        if self.kind is object:
            return np.asarray([[int(x) for x in r] for r in out], object).reshape(out.shape)
        return out.astype(self.kind)

    def reach(self, top: float) -> np.ndarray:
        """No query's score is larger in magnitude."""
        return np.asarray([min(sum(abs(int(x)) for x in r) * int(top), _MOST) for r in self.matrix], np.int64)

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(candidate ids, scores by query and candidate); own rows get the lowest score."""
        step = max(1, _SCORES // max(1, len(self.ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy()
                scores = self.matrix @ self.rows(part.column(1).to_pylist()).T
                scores = np.clip(scores, -_MOST, _MOST).astype(np.int64) if self.kind is object else scores.astype(np.int64)
                order = np.argsort(self.ids, kind="stable")
                left, right = (np.searchsorted(self.ids[order], ids, side) for side in ("left", "right"))
                for c in np.flatnonzero(right > left):
                    scores[order[left[c] : right[c]], c] = np.iinfo(np.int64).min
                yield ids, scores


def _unsigned(scores: np.ndarray) -> np.ndarray:
    """The scores in the same order, from 1 on; own rows are 0.  Ranges of these fit 64 bits."""
    return scores.view(np.uint64) ^ _ZERO


def _counted(rows: DataFrame, block, lo: np.ndarray, span: np.ndarray, width: np.ndarray, bins: int, k: int) -> DataFrame:
    """q, bin, n: unsigned scores in each bin of [lo, lo + span), from the highest down."""
    given = rows.sparkSession.sparkContext.broadcast((lo, span, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, (low, long, wide) = block.value, given.value
        n = len(low)
        counts = np.zeros((n, bins), np.int64)
        for _, scores in scorer.of(batches):
            scores = _unsigned(scores)
            at = scores - low[:, None]
            inside = (scores >= low[:, None]) & (at < long[:, None])
            q, _ = np.nonzero(inside)
            counts += np.bincount(q * bins + (at[inside] // wide[q]).astype(np.int64), minlength=n * bins).reshape(n, bins)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return rows.select("vec_id", "vec").mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kept(rows: DataFrame, block, least: np.ndarray, ties: np.ndarray) -> DataFrame:
    """query_id, vec_id, score above ``least``; of those equal to it the smallest ids."""
    given = rows.sparkSession.sparkContext.broadcast((least, ties))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, (low, need) = block.value, given.value
        equal: list[np.ndarray] = [np.empty(0, np.int64) for _ in low]
        for ids, scores in scorer.of(batches):
            q, c = np.nonzero((scores > low[:, None]) & (scores > np.iinfo(np.int64).min))
            yield _found(scorer.ids[q], ids[c], scores[q, c])
            for t in np.flatnonzero(((scores == low[:, None]) & (need > 0)[:, None]).any(axis=1)):
                equal[t] = np.sort(np.concatenate([equal[t], ids[scores[t] == low[t]]]))[: need[t]]
        sizes = [len(x) for x in equal]
        yield _found(np.repeat(scorer.ids, sizes), np.concatenate(equal) if equal else np.empty(0, np.int64), np.repeat(low, sizes))

    return rows.select("vec_id", "vec").mapInArrow(run, "query_id long, vec_id long, score long")


def _found(q: np.ndarray, c: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])


def kth_scores(rows: DataFrame, block, n: int, reach: np.ndarray, k: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k-th best score and how many equal to it belong to the best k."""
    lo, span, above = _unsigned(-reach), 2 * reach.astype(np.uint64) + 1, np.zeros(n, np.int64)
    width = (span - 1) // bins + 1
    all_in = np.zeros(n, bool)  # fewer than k candidates in all
    while True:
        counts = np.zeros((n, bins), np.int64)
        found = _counted(rows, block, lo, span, width, bins, k).toPandas()
        counts[found["q"], found["bin"]] = found["n"]
        higher = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts + above[:, None]
        here = (higher < k) & (higher + counts >= k)
        all_in |= ~here.any(axis=1)
        at = np.where(all_in, 0, here.argmax(axis=1))
        above = np.where(all_in, 0, higher[np.arange(n), at])
        last, lo = lo + (span - 1), lo + at.astype(np.uint64) * width
        if (width == 1).all() or all_in.all():
            least = np.where(all_in, np.iinfo(np.int64).min, (lo ^ _ZERO).view(np.int64))
            return least, np.where(all_in, 0, k - above)
        span = np.minimum(width, last - lo + 1)  # the last bin may reach beyond the range
        width = (span - 1) // bins + 1


def top_k(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query.

    ``is_query``: a Column over the id that tells which rows are queries.
    """
    spark = rows.sparkSession
    small_batches(spark)
    table = written(quantised(rows, id_col, vec_col), "vectors")
    queries = table.filter(is_query(F.col("vec_id")))
    seen = table.agg(F.max("top").alias("top"), F.max("dim").alias("dim")).first()
    n = queries.count()
    out: DataFrame | None = None
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = mine.select("vec_id", "vec").dropDuplicates(["vec_id"]).toPandas().sort_values("vec_id") if n else None
        if got is None or got.empty:
            continue
        scorer = Scorer(got["vec_id"].to_numpy(np.int64), [bytes(v) for v in got["vec"]], int(seen["dim"]), seen["top"])
        sent = spark.sparkContext.broadcast(scorer)
        least, ties = kth_scores(table, sent, len(got), scorer.reach(seen["top"]), k, bins)
        found = _kept(table, sent, least, ties)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
