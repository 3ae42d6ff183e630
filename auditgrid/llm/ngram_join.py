"""N-gram Jaccard self-join with Bayesian pruning of candidates.

A document is the set of its runs of ``size`` words (lower case; a shorter text is one
run).  Documents of equal sets form a copy class and are joined once, as one.

1. One pass takes every document's set, its 64-bit key, and min-hashes of ``bands`` x
   ``rows``; classes that share a band's min-hashes are candidates.  At the threshold a
   pair is missed with a chance of (1 - 0.8**5)**30, under 1 in 100 000.
2. A band's classes hang on their least key (the leader), so a bucket of m classes gives
   m - 1 rows, never all its pairs.  Leaders' groups are dealt to blocks of bounded size
   by a hash, and a task gets two blocks: a hot group is split over many tasks.
3. In a task, pairs are compared by fresh min-hashes, a few at a time.  With a uniform
   prior, after m agreements of n the posterior chance of reaching the threshold is
   P(Binomial(n + 1, threshold) <= m); below ``tolerance`` the pair is dropped.  Pairs that
   stay are verified exactly on their sets.
4. Links never leave a task as pairs: a task sends, for each linked class, how many
   documents its links reach and one class that it is connected with.  The sums are the
   documents' links, the connections make the components.

Sets are taken anew, for candidates only, from the texts; nothing that grows with the
corpus reaches the driver.  Keys are 64-bit hashes: two different sets share one with a
chance of n*n / 2**65.

A text that is null or has no words has no links and a class of its own.  Rows of a null
id take part and are listed with it.  Repeated rows are copies of each other.  Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, mixed, small_batches, text_bytes, word_hashes, worker, written
from .graph import components

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
TOLERANCE = 1e-6
STEP, STEPS = 32, 4  # min-hashes compared at once, and how often
BLOCK_ROWS, BLOCK_BYTES = 100, 4 << 20
BROADCAST_ROWS = 1_000_000
_RNG = np.random.Generator(np.random.PCG64(0xB0A7))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_HASH = (_RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_BAYES_HASH = (_RNG.integers(1, 1 << 31, STEP * STEPS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_CHUNK = 4096


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct runs of words."""
    raw, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    words, starts, _ = word_hashes(raw, offsets)
    bounds = np.searchsorted(starts, offsets)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for i in range(size):
            runs += words[i : len(words) - size + 1 + i] * _PLACE[i]
        runs = mixed(runs)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                yield distinct(runs[a : b - size + 1])
            else:
                yield mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)) if b > a else words[:0]


def set_key(runs: np.ndarray) -> int:
    """A 64-bit key of a set, as a signed number."""
    with np.errstate(over="ignore"):
        total = mixed(runs ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(runs))
    return int(mixed(np.asarray([total]))[0].astype(np.int64))


def min_hashes(runs: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of factor * run (32 bits, wrapping) for every factor."""
    x = (runs >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _CHUNK):
        np.minimum(out, (factors[:, None] * x[None, at : at + _CHUNK]).min(axis=1), out=out)
    return out


def band_keys(runs: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band: its own min-hashes and its place."""
    h = min_hashes(runs, _BAND_HASH).reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed((h * _PLACE[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE[ROWS]).astype(np.int64)


def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest agreements with which a pair goes on."""
    out = []
    for n in range(STEP, STEP * STEPS + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, least: list[int]) -> list[tuple[int, int]]:
    """Pairs (i in left, j in right, i before j where both are the same) that reach the threshold."""
    sizes = np.asarray([len(s) for s in sets])
    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    keep = i < j if left is right else np.ones(len(i), bool)
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep &= small >= threshold * large
    i, j = i[keep], j[keep]
    if not len(i):
        return []
    used = np.unique(np.concatenate([i, j]))
    signs = np.zeros((len(sets), STEP * STEPS), np.uint32)
    for u in used:
        signs[u] = min_hashes(sets[u], _BAYES_HASH)
    agree = np.zeros(len(i), np.int32)
    for k, need in enumerate(least):
        at = slice(k * STEP, (k + 1) * STEP)
        agree += (signs[i, at] == signs[j, at]).sum(axis=1, dtype=np.int32)
        keep = agree >= need
        i, j, agree = i[keep], j[keep], agree[keep]
    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        both = np.sort(np.concatenate([sets[a], sets[b]]))
        common = int((both[1:] == both[:-1]).sum())
        if common >= threshold * (len(sets[a]) + len(sets[b]) - common):
            out.append((a, b))
    return out


# ------------------------------------------------------------------------------ stages


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (null without words), bands of every row."""

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bands = [], []
            for runs in shingle_sets(batch.column(2)):
                keys.append(set_key(runs) if len(runs) else None)
                bands.append(band_keys(runs) if len(runs) else np.empty(0, np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bands], dtype=np.int64)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), lists], names=["doc_id", "text_hash", "key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, key long, bands array<long>")


def leader_groups(profile: DataFrame) -> DataFrame:
    """(leader, key): every class that shares a band with others, under the band's least key."""
    banded = profile.filter("key IS NOT NULL").select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("leader"), F.max("key").alias("top")).filter("leader < top").drop("top")
    return banded.join(shared, "band").select("leader", "key").distinct()


def candidate_sets(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, runs): the packed sets of the classes that have candidates, from their texts."""
    needed = written(groups.select("key").distinct().join(classes, "key").select("key", "text_hash"), "needed")
    side = needed.select("text_hash")
    side = F.broadcast(side) if needed.count() <= BROADCAST_ROWS else side
    rows = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).join(side, "text_hash").dropDuplicates(["text_hash"])

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "runs"])

    return rows.select("text").mapInArrow(run, "key long, runs binary")


def class_links(groups: DataFrame, sets: DataFrame, classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(key, root, others): for each class with links, rows of one component's tree and link counts.

    A pair belongs to the least leader that its classes share, so it is met once.  A task
    sends one row for each linked class, never the pairs: how many documents its links
    reach, and a class that it is connected with.
    """
    about = groups.groupBy("key").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    held = written(sets.join(classes.select("key", "copies"), "key").join(about, "key"), "held")
    sized = groups.join(held.select("key", F.octet_length("runs").alias("bytes")), "key")
    blocks = sized.groupBy("leader").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("n"))
    many = written(blocks.filter("n > 1"), "blocks")
    side = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("n")).cast("int")
    dealt = groups.join(side, "leader", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "key").join(held, "key")
    least = least_agreements(threshold, tolerance)

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []

        def done() -> pa.RecordBatch:
            leader, i, j = at
            side = np.asarray([m[0] for m in members])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            pairs = linked_pairs([np.frombuffer(m[2], np.uint64) for m in members], left, left if i == j else right, threshold, least)
            root, others = list(range(len(members))), [0] * len(members)

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in pairs:
                first = leader if len(members[a][4]) == 1 else min(set(members[a][4]) & set(members[b][4]))
                if first != leader:
                    continue
                others[a] += members[b][3]
                others[b] += members[a][3]
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            linked = [x for x in range(len(members)) if others[x]]
            return pa.RecordBatch.from_arrays([pa.array([members[x][1] for x in linked], pa.int64()), pa.array([members[find(x)][1] for x in linked], pa.int64()), pa.array([others[x] for x in linked], pa.int64())], names=["key", "root", "others"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    if len(members) > 1:
                        yield done()
                    at, members = row[:3], []
                members.append(row[3:])
        if len(members) > 1:
            yield done()

    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.select("leader", "i", "j", "side", "key", "runs", "copies", "leaders").repartition(tasks, "leader", "i", "j").sortWithinPartitions("leader", "i", "j", "side", "key")
    return ordered.mapInArrow(run, "key long, root long, others long")


def joined_rows(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, text_hash, key, label, copy_id, class_id, n_links of every row.

    ``key`` and ``label`` (of the copy class and of the component) are null without words.
    """
    small_batches(docs.sparkSession)
    profile = written(profiles(docs), "profiles")
    classes = written(profile.filter("key IS NOT NULL").groupBy("key").agg(F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies")), "classes")
    groups = written(leader_groups(profile), "groups")
    sets = written(candidate_sets(docs, classes, groups), "sets")
    links = written(class_links(groups, sets, classes, threshold, tolerance), "links")
    label = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("key").agg(F.sum("others").alias("others"))
    labelled = classes.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = labelled.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    about = labelled.join(least, "label").join(counts, "key", "left").select("key", "label", "copy_id", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rows = profile.select("doc_id", "text_hash", "key").join(written(about, "about"), "key", "left")
    return rows.select("doc_id", "text_hash", "key", "label", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def ngram_jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, copy_id, class_id, n_links for every row of ``docs(doc_id, text)``.

    ``copy_id``: the least id of documents with the same set; ``class_id``: of documents
    that links connect; ``n_links``: how many other rows have a Jaccard similarity of the
    threshold or more with this one.
    """
    return joined_rows(docs, threshold, tolerance).select("doc_id", "copy_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One document of every linked group - the least id, then text hash - with all its columns.

    Null ids come last.  Documents without words all stay, repeated rows of them too.
    """
    found = written(joined_rows(docs, threshold, tolerance), "joined")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    groups = found.filter("label IS NOT NULL").groupBy("label").agg(F.min(place).alias("p")).select("p._doc", "p._hash")
    one = written(groups, "kept")
    gone = written(found.filter("label IS NOT NULL").join(one, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left_anti").select("doc_id", "text_hash").distinct(), "gone")
    again = written(found.filter("label IS NOT NULL").groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"), "again")

    def side(rows: DataFrame) -> DataFrame:
        return (F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows).alias("r")

    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("d.text") == F.col("r.text_hash"))
    left = docs.alias("d").join(side(gone), same, "left_anti")
    if again.isEmpty():
        return left
    repeated = side(again)
    few = left.alias("d").join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.alias("d").join(repeated, same, "left_anti").unionByName(few)
