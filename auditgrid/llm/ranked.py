"""Ranked lexical search over a tiered index.

``build_index`` writes an index of every document and every term: one row for a block of
documents, with the block's terms and, for each term, its postings from the highest impact
down.  The best ``TIERS[0]`` postings of a term stand in the columns of tier 0, the next
``TIERS[1]`` in those of tier 1, the rest in the last tier; beside every tier stands, for
each term, the residual bound: the highest impact that a lower tier still holds.  A search
that stops at a tier reads no column of those below.  Building reads the texts twice (the
statistics come first, as impacts need them) and shuffles nothing.

``search`` takes items in groups of bounded size.  Round r reads tiers 0 to r.  In a block
a document's score lies between the sum over the postings seen (low) and that sum plus the
residual bounds of the terms not seen for it (high).  An item is proven for a block once
every document whose high reaches the item's k-th best low of the whole corpus has
low = high: these are its exact candidates.  Items without that proof fall through: the
next round reads the next tier, of the blocks that hold such items alone, with a k-th best
low that the round before has raised.  The last tier leaves no residual, so scores are exact.

Terms are maximal runs of 0-9, A-Z, a-z and characters outside ASCII, with A-Z lower-cased;
64-bit hashes stand for them (two of n terms are taken for one with a chance of n*n / 2**65).
The statistics N (documents with a term), L (terms of all of them), n, df and tf, the weight
floor(1000 * ln((2 N + 2) / (2 df + 1))), the length norm m = 10 + (90 n N) div L and the
impact (10**9 tf) div (1000 tf + 8 m) are those of the contract.

A null or termless text is no document of N and is never found; an item of such a text has
no rows.  Every row is a document or an item of its own, whether ids repeat or are null;
equal scores rank by id, null last, then in no stated order among equal ids.  A text of any
length is one document: only texts of one block (about 2**18 postings or one document) are
held at once.  Scores must be above 0.  No documents or no items give no rows.  Other
columns are ignored; they may have the names of the index or of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW_GROUP_BYTES, WORD_BYTE, dropped, scratch_path, small_batches, text_bytes, word_hashes, worker, written

K = 10
TIERS = (8, 64)  # postings of a term and block in each tier but the last
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 18
GROUP_ITEMS, GROUP_TERMS = 1024, 1 << 20
CELLS = 1 << 20  # items x documents that are scored together
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_counts(texts: pa.Array) -> np.ndarray:
    """The number of terms of each text."""
    raw, offsets = text_bytes(texts)
    word = WORD_BYTE[_LOWER[raw]]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = word[first]  # no term crosses texts
    upto = np.concatenate([[0], np.cumsum(begins)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def postings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of every distinct term of each text, by text, and the texts' numbers of terms."""
    raw, offsets = text_bytes(texts)
    terms, starts, _ = word_hashes(_LOWER[raw], offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(doc, minlength=len(texts))
    order = np.lexsort((terms, doc))
    doc, terms = doc[order], terms[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (terms[1:] != terms[:-1])])) if len(doc) else np.empty(0, np.int64)
    return doc[first], terms[first], np.diff(np.append(first, len(doc))), n


def length_norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of texts of n terms; exact for any size."""
    return np.asarray([10 + 90 * int(x) * docs // total for x in n], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# ------------------------------------------------------------------------------ index


def _columns(upto: int) -> list[str]:
    """The columns that tiers 0 to ``upto`` need."""
    return ["block", "doc_ids", "terms", "df", *(f"{what}{t}" for t in range(upto + 1) for what in (("docs", "impacts", "rest") if t < len(TIERS) else ("docs", "impacts")))]


_SCHEMA = ", ".join(f"{c} {'long' if c == 'block' else 'array<long>' if c == 'doc_ids' else 'binary'}" for c in _columns(len(TIERS)))


def counts_of_tiers(df: np.ndarray) -> list[np.ndarray]:
    """How many of ``df`` postings lie in each tier."""
    out, left = [], df.astype(np.int64)
    for size in TIERS:
        out.append(np.minimum(left, size))
        left = left - out[-1]
    return [*out, left]


def _block(number: int, ids: list, parts: list[tuple[np.ndarray, ...]], n: np.ndarray, docs: int, total: int) -> pa.RecordBatch:
    """One row of the index: the postings of a block's documents, cut into tiers."""
    doc, term, tf = (np.concatenate([p[i] for p in parts]) for i in range(3))
    impact = impacts(tf, length_norms(n, docs, total)[doc])
    order = np.lexsort((doc, -impact, term))
    doc, term, impact = doc[order].astype(np.int32), term[order], impact[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    df = np.diff(np.append(first, len(term)))
    nth = np.arange(len(term)) - np.repeat(first, df)
    columns = {"block": number, "doc_ids": ids, "terms": term[first].tobytes(), "df": df.astype(np.int32).tobytes()}
    low = 0
    for t in range(len(TIERS) + 1):
        high = low + TIERS[t] if t < len(TIERS) else len(term)
        here = (nth >= low) & (nth < high)
        columns |= {f"docs{t}": doc[here].tobytes(), f"impacts{t}": impact[here].tobytes()}
        if t < len(TIERS):
            rest = np.where(df > high, impact[np.minimum(first + high, len(term) - 1)], 0)
            columns[f"rest{t}"] = rest.astype(np.int32).tobytes()
        low = high
    kinds = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([columns[c]], kinds.get(c, pa.binary())) for c in _columns(len(TIERS))], names=_columns(len(TIERS)))


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of all documents to ``path``: ``blocks`` and ``stats`` (N and L)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    @worker
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = word_counts(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "total"])

    sums = texts.select("text").mapInArrow(count, "docs long, total long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "total")))
    sums.write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats").first()
    all_docs, total = stats["docs"], stats["total"]

    @worker
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        sizes: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            doc, term, tf, n = postings(batch.column(1))
            kept = np.flatnonzero(n)
            place = np.cumsum(n > 0) - 1 + len(ids)
            ids += batch.column(0).take(pa.array(kept)).to_pylist()
            sizes.append(n[kept])
            parts.append((place[doc], term, tf))
            if len(ids) >= BLOCK_DOCS or sum(len(p[0]) for p in parts) >= BLOCK_POSTINGS:
                yield _block(number, ids, parts, np.concatenate(sizes), all_docs, total)
                number, ids, sizes, parts = number + 1, [], [], []
        if ids:
            yield _block(number, ids, parts, np.concatenate(sizes), all_docs, total)

    # a row is some MB: the writer looks at its size after each
    options = {"parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size.row.check.min": "1"}
    texts.mapInArrow(blocks, _SCHEMA).write.mode("overwrite").options(**options).parquet(f"{path}/blocks")


# ------------------------------------------------------------------------------ search


class Group:
    """A group of items: their terms with weights, and which items hold each."""

    def __init__(self, terms: list[np.ndarray]):
        self.size = len(terms)
        item = np.repeat(np.arange(self.size), [len(t) for t in terms])
        flat = np.concatenate(terms) if terms else np.empty(0, np.uint64)
        order = np.lexsort((item, flat))
        self.terms, begins = np.unique(flat[order], return_index=True)
        self.items = np.split(item[order], begins[1:]) if len(begins) else []
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, docs: int, df: dict[int, int]) -> None:
        self.weights = np.asarray([weight(docs, df[int(t)]) if int(t) in df else 0 for t in self.terms.view(np.int64)], np.int64)

    def matched(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in this group's terms, places in ``terms``) of the terms that both have."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        own = np.flatnonzero(terms[at] == self.terms)
        return own, at[own]


def _numbers(row: dict, name: str, kind=np.int32) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.arange(len(scores))


class BlockScorer:
    """Scores of items for the documents of one block, from the tiers read so far."""

    def __init__(self, group: Group, row: dict):
        self.row, self.docs = row, len(row["doc_ids"])
        self.ids = np.asarray([np.iinfo(np.int64).max if x is None else x for x in row["doc_ids"]], np.int64)
        self.own, self.at = group.matched(_numbers(row, "terms", np.uint64))
        heavy = group.weights[self.own] > 0
        self.own, self.at = self.own[heavy], self.at[heavy]
        self.group, sizes = group, counts_of_tiers(_numbers(row, "df"))
        self.spans = [(np.cumsum(s) - s, s) for s in sizes]

        self.tiers = [(_numbers(row, f"docs{t}"), _numbers(row, f"impacts{t}")) for t in range(len(TIERS) + 1) if f"docs{t}" in row]

    def rest(self, t: int) -> np.ndarray:
        """The residual bound of each matched term below tier t, with its weight."""
        if t == len(TIERS):
            return np.zeros(len(self.at), np.int64)
        return _numbers(self.row, f"rest{t}")[self.at] * self.group.weights[self.own]

    def rounds(self, lo: int, hi: int, upto: int, theta: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(item, documents, scores, whether it is proven) of items lo to hi; ``theta`` is raised."""
        mine = []  # (matched term, its items in this range, from 0)
        for j, q in enumerate(self.own):
            items = self.group.items[q]
            a, b = np.searchsorted(items, (lo, hi))
            if b > a:
                mine.append((j, items[a:b] - lo))
        active = np.zeros(hi - lo, bool)
        for _, items in mine:
            active[items] = True
        low = np.zeros((hi - lo, self.docs), np.int64)
        for t in range(upto + 1):
            docs, impact = self.tiers[t]
            begin, size = self.spans[t]
            for j, items in mine:
                a = begin[self.at[j]]
                here = slice(a, a + size[self.at[j]])
                if size[self.at[j]] and len(items := items[active[items]]):
                    low[np.ix_(items, docs[here])] += impact[here] * self.group.weights[self.own[j]]
            if t < upto - 1:
                continue  # the rounds before have tried these tiers' proof
            high = low.copy()
            if t < len(TIERS):
                rest = self.rest(t)
                for j, items in mine:
                    if rest[j] and len(items := items[active[items]]):
                        high[items] += rest[j]
                        for s in range(t + 1):
                            a, m = self.spans[s][0][self.at[j]], self.spans[s][1][self.at[j]]
                            if m:
                                high[np.ix_(items, self.tiers[s][0][a : a + m])] -= rest[j]
            for i in np.flatnonzero(active):
                if self.docs >= k:
                    theta[lo + i] = max(theta[lo + i], np.partition(low[i], self.docs - k)[self.docs - k])
                found = np.flatnonzero((high[i] >= theta[lo + i]) & (high[i] > 0))
                proven = bool((high[i][found] == low[i][found]).all())
                if proven or t == upto:
                    active[i] = False
                    if not proven:
                        found = np.flatnonzero((low[i] >= theta[lo + i]) & (low[i] > 0))
                    found = found[_best(low[i][found], self.ids[found], k)]
                    yield lo + i, found, low[i][found], proven
            if not active.any():
                return


_FOUND = "block long, item int, doc int, doc_id long, score long, proven boolean"


def _round(blocks: DataFrame, upto: int, sent, theta: np.ndarray, k: int) -> DataFrame:
    """What tiers 0 to ``upto`` tell: proven candidates, and lows of items that fall through.

    An item that falls through has a row for the block in any case, with doc -1 at least.
    """
    given = blocks.sparkSession.sparkContext.broadcast(theta)

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, least = sent.value, given.value.copy()
        for batch in batches:
            for row in batch.to_pylist():
                scorer = BlockScorer(group, row)
                if not len(scorer.own):
                    continue
                step = max(1, CELLS // scorer.docs)
                for lo in range(0, group.size, step):
                    item, doc, score, proven = [], [], [], []
                    for i, docs, scores, ok in scorer.rounds(lo, min(lo + step, group.size), upto, least, k):
                        if not ok and not len(docs):
                            docs, scores = np.asarray([-1]), np.asarray([0])
                        item.append(np.full(len(docs), i))
                        doc.append(docs)
                        score.append(scores)
                        proven.append(np.full(len(docs), ok))
                    if item:
                        doc = np.concatenate(doc)
                        ids = pa.array([row["doc_ids"][d] if d >= 0 else None for d in doc.tolist()], pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(doc), row["block"])), pa.array(np.concatenate(item), pa.int32()), pa.array(doc, pa.int32()), ids, pa.array(np.concatenate(score), pa.int64()), pa.array(np.concatenate(proven))],
                            names=["block", "item", "doc", "doc_id", "score", "proven"],
                        )

    return written(blocks.select(_columns(upto)).mapInArrow(run, _FOUND), "ranked-round")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; tasks rank their own before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "doc")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _document_counts(blocks: DataFrame, sent) -> dict[int, int]:
    """In how many documents each term of the group stands."""

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = sent.value
        total = np.zeros(len(group.terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own, at = group.matched(_numbers(row, "terms", np.uint64))
                total[own] += _numbers(row, "df")[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(group.terms[some].view(np.int64)), pa.array(total[some])], names=["term", "df"])

    rows = blocks.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.toLocalIterator()}


def _search_group(blocks: DataFrame, docs: int, ids: list, terms: list[np.ndarray], k: int, out: str) -> None:
    """Add the ranking of a group's items to the table ``out``."""
    spark = blocks.sparkSession
    group = Group(terms)
    sent = spark.sparkContext.broadcast(group)
    group.weigh(docs, _document_counts(blocks, sent))
    sent.destroy()
    sent = spark.sparkContext.broadcast(group)
    theta = np.zeros(group.size, np.int64)
    rounds: list[DataFrame] = []
    opened: list[DataFrame] = []
    left = blocks
    for tier in range(len(TIERS) + 1):
        rounds.append(_round(left, tier, sent, theta, k))
        if tier < len(TIERS):
            best = _ranked(rounds[-1].filter("score > 0"), k).filter(F.col("rank") == k)
            for r in best.select("item", "score").collect():
                theta[r["item"]] = max(theta[r["item"]], r["score"])
            opened.append(written(rounds[-1].filter("not proven").select("block").distinct(), "ranked-open"))  # its size lets Spark choose the join
            left = blocks.join(opened[-1], "block", "left_semi")
    proven = rounds[0].filter("proven")
    for r in rounds[1:]:
        proven = proven.unionAll(r.filter("proven"))
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item int, item_id long")
    ranked = _ranked(proven.dropDuplicates(["item", "block", "doc"]), k)
    ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out)
    dropped(*rounds, *opened)
    sent.destroy()


def search(spark: SparkSession, path: str, items: DataFrame, k: int = K, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, from the index at ``path``."""
    small_batches(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    docs = spark.read.parquet(f"{path}/stats").first()["docs"]

    @worker
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, term, _, _ = postings(batch.column(1))
            cuts = np.searchsorted(at, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([term[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["item_id", "terms"])

    out = scratch_path(spark, "ranked")
    spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").write.parquet(out)
    ids: list = []
    held: list[np.ndarray] = []
    for r in items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(terms, "item_id long, terms binary").toLocalIterator():
        ids.append(r["item_id"])
        held.append(np.frombuffer(bytes(r["terms"]), np.uint64))
        if len(ids) == GROUP_ITEMS or sum(map(len, held)) >= GROUP_TERMS:
            _search_group(blocks, docs, ids, held, k, out)
            ids, held = [], []
    if ids:
        _search_group(blocks, docs, ids, held, k, out)
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(out)


def ranked_search(docs: DataFrame, items: DataFrame, path: str, k: int = K) -> DataFrame:
    """Index all documents at ``path``, then rank them for every item."""
    build_index(docs, path)
    return search(docs.sparkSession, path, items, k)
