"""Line deduplication by an exact set-similarity join.

A line is the set of its words (lower case).  Lines are in the order of (document id,
line number); a line is removed when an earlier line has a Jaccard similarity of
``threshold`` or more with it.  Lines without words always stay.

1. One pass takes every line's 64-bit set key, and counts in how many lines each token
   is, in a table of fixed size (2**20 counters by the token's hash; the sum of all tasks'
   tables is broadcast, a byte each).  Lines of one key are one class with one first place;
   all its other lines are removed.
2. The tokens of a line are put in order of rarity (counter, then hash: one order for all
   lines).  Two lines that reach the threshold share a token among their first
   n - ceil(threshold * n) + 1: these prefixes are the postings.  Lines so short that only
   an equal set can reach the threshold have none.  Postings travel as packed blocks, by
   token, to so many tasks that each gets about ``TASK_BYTES``.
3. Within a token's list, pairs must pass the length filter, the positional filter (what
   can still be shared after this place) and a bitmap filter (128 bits of the sets: the
   difference is at least the number of bits that differ).  For every later class a task
   hands on its few most alike candidates, so rows grow with the classes, not with pairs.
   A task whose lists outgrow ``HELD_BYTES`` passes its postings on, in groups by token;
   large groups are dealt to blocks of ``BLOCK`` postings, and each two blocks of a group
   meet in a task: a hot token's work is split over tasks, each of bounded memory.
4. Candidates are verified on whole sets, taken anew from the texts that hold them (found
   by Bloom filters of bounded size; texts are not shuffled).  Classes whose handed-on
   candidates all fail, and that had more, get all of them in one second round: up to
   ``OPEN`` of them are held against the sizes and bitmaps of all earlier classes, more take
   their prefixes' postings again.  Nothing is left out.

Words and sets are told apart by 64-bit hashes: two of n different ones are taken for one
with a chance of n*n / 2**65.  A null text has no lines; a null id comes before all others;
rows equal in id and text count as one place and get the same result.  Without documents
there are no rows.  A text of any length is taken whole: its words are in a worker's memory
together, at some 80 bytes each.  Other columns, whatever their names, are passed through
by ``deduplicated`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom, dropped, gathered, mixed, small_batches, text_bytes, word_hashes, worker, written

THRESHOLD = 0.8
COUNTERS = 1 << 20
_BLOCKS = 64  # a task's table of counters is sent as so many rows
HANDED_ON = 6  # candidates of a class that a task hands on at first; few classes need more
OPEN = 2048  # classes of the second round that are held against all others directly
TASK_BYTES, HELD_BYTES = 6 << 20, 14 << 20  # postings that a task should get, and that it may hold
BLOCK = 1 << 16  # postings of a hot token in a block
GROUPS = 64  # groups by token that a part is passed on in
REMOVED_BYTES = 32 << 20  # numbers of removed lines that are broadcast at most
_LINE = 2654435761  # odd, so that lines of a text differ
_PAIRS = 1 << 17  # pairs filtered at once
_SEND = 4 << 20  # bytes of postings that are packed at once
POSTING = np.dtype([("tok", "<u4"), ("n", "<u4"), ("at", "<u4"), ("line", "<u4"), ("doc", "<i8"), ("key", "<i8"), ("b0", "<u8"), ("b1", "<u8")])
PACKED = "a long, b long, more boolean, grp long, packed binary"


def ordered_tokens(line: np.ndarray, rare: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (line, token), by line, rarity and token."""
    lead = line.astype(np.uint64) << np.uint64(46) | rare.astype(np.uint64) << np.uint64(38) | token >> np.uint64(26)
    order = np.argsort(lead)
    lead, line, token = lead[order], line[order], token[order]
    same = lead[1:] == lead[:-1]
    if (same & (token[1:] != token[:-1])).any():  # tokens of one line that differ in their last bits alone
        order = np.lexsort((token, lead))
        line, token = line[order], token[order]
    fresh = np.ones(len(line), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
    return line[fresh], token[fresh]


def reached(edges: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the edges each place has reached, both ascending: a search for each edge, of which there are few."""
    at = np.searchsorted(places, edges)
    return np.repeat(np.arange(len(edges) + 1), np.diff(np.concatenate([[0], at, [len(places)]])))


def line_sets(texts: pa.Array, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, key of each line, size of each line, line of each token, token).

    Tokens are distinct within a line and in order of rarity; a line without words has size 0.
    """
    raw, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    tokens, starts, _ = word_hashes(raw, offsets)
    breaks = np.flatnonzero(raw == 10) + 1
    # `breaks` is the place after a line feed: at a text's end it opens an empty last line
    upto = np.searchsorted(breaks, offsets, "right")
    per_text = np.diff(upto) + 1
    # every break and every text but the first opens a line
    line = reached(breaks, starts) - upto[0] + reached(offsets, starts) - 1
    rare = rarity[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)] if rarity is not None else np.zeros(len(tokens), np.uint8)
    n, limit = int(per_text.sum()), 1 << 18
    parts = []
    for lo in range(0, max(1, n), limit):
        a, b = np.searchsorted(line, [lo, lo + limit])
        got, token = ordered_tokens(line[a:b] - lo, rare[a:b], tokens[a:b])
        parts.append((got + lo, token))
    line, token = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    sizes = np.bincount(line, minlength=n).astype(np.int64)
    sums = np.zeros(len(token) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mixed(token + np.uint64(1)), out=sums[1:])
        ends = np.cumsum(sizes)
        keys = mixed(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).astype(np.int64)
    return per_text, keys, sizes, line, token


def prefix_sizes(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """n - ceil(threshold * n) + 1, in whole numbers; 0 if only an equal set can be near."""
    t = Fraction(str(threshold))
    prefix = sizes - -(-sizes * t.numerator // t.denominator) + 1
    return np.where(sizes * t.denominator >= (sizes + 1) * t.numerator, prefix, 0)


class FirstSeen:
    """Whether a key comes at an earlier place than before, in fixed memory.

    A slot holds the latest key that fell into it, so a key may be taken for new again.
    """

    def __init__(self, slots: int = 1 << 17):
        self.mask = np.uint64(slots - 1)
        self.key, self.doc, self.line = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max), np.zeros(slots, np.int64)

    def fresh(self, key: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The first row of each key among the given ones that is new or earlier."""
        order = np.lexsort((line, doc, key))
        first = np.ones(len(key), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        rows = order[first]
        at = (key[rows].view(np.uint64) & self.mask).astype(np.int64)
        known = (self.key[at] == key[rows]) & ((self.doc[at] < doc[rows]) | (self.doc[at] == doc[rows]) & (self.line[at] <= line[rows]))
        rows, at = rows[~known], at[~known]
        self.key[at], self.doc[at], self.line[at] = key[rows], doc[rows], line[rows]
        return np.sort(rows)


# ------------------------------------------------------------------------------ passes


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def line_keys(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, text_hash, keys, sizes and bitmaps of each line (key null without words), n (postings) - and blocks of counters."""
    names = ["doc_id", "text_hash", "keys", "sizes", "b0", "b1", "n", "block", "counts"]

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            per_text, keys, sizes, _, token = line_sets(batch.column(2))
            per_text = np.where(batch.column(2).is_null().to_numpy(zero_copy_only=False), 0, per_text)
            real = np.repeat(per_text > 0, np.maximum(per_text, 1))
            counts += np.bincount((token & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            each = [pa.array(keys[real], mask=sizes[real] == 0), pa.array(sizes[real].astype(np.int32)), *(pa.array(b[real].view(np.int64)) for b in _bitmaps(token, sizes))]
            at = pa.array(np.concatenate([[0], per_text.cumsum()]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, flat) for flat in each]
            upto = np.concatenate([[0], np.cumsum(prefix_sizes(sizes, threshold))])[np.concatenate([[0], np.cumsum(np.maximum(per_text, 1))])]
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(np.diff(upto)), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        size = COUNTERS // _BLOCKS
        blocks = [(i, counts[i * size : (i + 1) * size].tobytes()) for i in range(_BLOCKS) if counts[i * size : (i + 1) * size].any()]
        none = pa.nulls(len(blocks))
        columns = [none.cast(kind) for kind in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())]
        columns += [pa.array([i for i, _ in blocks], pa.int32()), pa.array([raw for _, raw in blocks], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return _rows(docs).mapInArrow(run, "doc_id long, text_hash long, keys array<long>, sizes array<int>, b0 array<long>, b1 array<long>, n long, block int, counts binary")


def rarity_table(found: DataFrame) -> np.ndarray:
    """The logarithm of every counter's sum over all tasks, on a scale of 0 to 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"])

    rows = found.filter("block IS NOT NULL").select("block", "counts").repartition(_BLOCKS, "block").mapInArrow(run, "block int, counts binary")
    total = np.zeros((_BLOCKS, COUNTERS // _BLOCKS), np.int64)
    for r in rows.toLocalIterator():
        total[r["block"]] += np.frombuffer(bytes(r["counts"]), np.int64)
    return np.minimum(255, np.log2(total.ravel() + 1.0) * 8).astype(np.uint8)


def _bitmaps(token: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """128 bits for each line, as two halves: the parity of its tokens on each bit."""
    bits = np.uint64(1) << (token & np.uint64(63))
    some, masks = np.flatnonzero(sizes > 0), []
    begin = (np.cumsum(sizes) - sizes)[some]
    for half in (0, 1):
        mine = np.where((token >> np.uint64(6) & np.uint64(1)) == half, bits, np.uint64(0))
        mask = np.zeros(len(sizes), np.uint64)
        if len(some):
            mask[some] = np.bitwise_xor.reduceat(mine, begin)
        masks.append(mask)
    return masks


def postings(docs: DataFrame, rarity, threshold: float, parts: int, only=None) -> DataFrame:
    """part, packed: blocks of POSTING records, dealt by token; of the tokens in the ``Bloom`` ``only``, if given."""

    def found(batch: pa.RecordBatch, seen: FirstSeen) -> tuple[np.ndarray, np.ndarray]:
        per_text, keys, sizes, line, token = line_sets(batch.column(2), rarity.value)
        doc_of = np.repeat(pc.fill_null(batch.column(0), np.iinfo(np.int64).min).to_numpy(), per_text)
        number = np.arange(len(keys)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        prefix = prefix_sizes(sizes, threshold)
        some = np.flatnonzero(prefix > 0)
        wanted = np.zeros(len(keys), bool)
        wanted[some[seen.fresh(keys[some], doc_of[some], number[some])]] = True
        begin = np.cumsum(sizes) - sizes
        at = np.arange(len(token)) - begin[line]
        used = wanted[line] & (at < prefix[line])
        if only is not None:
            used[used] = only.value.has(token[used].view(np.int64))
        of = line[used]
        out = np.empty(len(of), POSTING)
        out["tok"] = token[used] & np.uint64(0xFFFFFFFF)
        out["n"], out["at"], out["line"], out["doc"], out["key"] = sizes[of], at[used], number[of], doc_of[of], keys[of]
        out["b0"], out["b1"] = (mask[of] for mask in _bitmaps(token, sizes))
        return out, (mixed(token[used]) % np.uint64(4 * parts)).astype(np.int32)  # tasks get four parts each, about alike

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        out, part = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        order = np.argsort(part, kind="stable")
        out, part = out[order], part[order]
        which, begins = np.unique(part, return_index=True)
        cuts = [*begins.tolist(), len(part)]
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["part", "packed"])

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = FirstSeen(), [], 0
        for batch in batches:
            held.append(found(batch, seen))
            size += held[-1][0].nbytes
            if size > _SEND:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return _rows(docs).mapInArrow(run, "part int, packed binary")


# -------------------------------------------------------------------------- candidates


def _passing(p: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of postings, of near sizes, that pass the positional and bitmap filters.

    With them comes how many parities differ.
    """
    both = p["n"][i] + p["n"][j]
    need = -(-both * t.numerator // (t.numerator + t.denominator))
    ok = np.minimum(p["left"][i], p["left"][j]) >= need
    i, j, spare = i[ok], j[ok], both[ok] - 2 * need[ok]
    differ = np.bitwise_count(p["b0"][i] ^ p["b0"][j]).astype(np.int64) + np.bitwise_count(p["b1"][i] ^ p["b1"][j])
    ok = differ <= spare
    return i[ok], j[ok], differ[ok]


def _pairs(lists: np.ndarray, n: np.ndarray, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one list whose sizes are within the threshold, about _PAIRS at a time.

    ``lists`` ascends, and the sizes ``n`` ascend within a list.
    """
    if not len(n):
        return
    wide, n = np.int64(1) << 33, n.astype(np.int64)
    lists = np.cumsum(np.concatenate([[0], lists[1:] != lists[:-1]]))  # small numbers, so that nothing overflows
    least = -(-n * t.numerator // t.denominator)
    begin = np.searchsorted(lists * wide + n, lists * wide + least)
    many = np.arange(len(n)) - begin
    upto = np.cumsum(many)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS, "right")))
        m = many[lo:hi]
        j = np.repeat(np.arange(lo, hi), m)
        i = np.arange(len(j)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[lo:hi], m)
        yield i, j
        lo = hi


def first_places(p: np.ndarray) -> np.ndarray:
    """Postings of lists with two classes or more, by token and size, each class at its first place."""
    tok = np.ascontiguousarray(p["tok"])
    order = np.argsort(tok)
    tok = tok[order]
    same = np.concatenate([[False], tok[1:] == tok[:-1], [False]])
    p = p[order[same[1:] | same[:-1]]] if len(p) else p
    lead = p["tok"].astype(np.uint64) << np.uint64(32) | p["n"]
    p = p[np.lexsort((p["key"], lead))]
    if len(p):
        again = (p["tok"][1:] == p["tok"][:-1]) & (p["key"][1:] == p["key"][:-1])
        copies = np.flatnonzero(np.concatenate([[False], again]) | np.concatenate([again, [False]]))
        if len(copies):  # places count among a class's copies alone
            c = p[copies]
            p[copies] = c[np.lexsort((c["line"], c["doc"], c["key"], c["n"], c["tok"]))]
        p = p[np.concatenate([[True], ~again])]
    return p


def _handed_on(found: np.ndarray, few: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (a, b, difference), the most alike of each class a first; all, or ``few`` and one more."""
    found = found[np.lexsort((found[:, 1], found[:, 2], found[:, 0]))]
    a = found[:, 0]
    new = np.ones(len(found), bool)
    new[1:] = (a[1:] != a[:-1]) | (found[1:, 1] != found[:-1, 1])
    found = found[new]
    if few is None or not len(found):
        return found, np.zeros(len(found), bool)
    a = found[:, 0]
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.concatenate([begin, [len(a)]]))
    keep = np.arange(len(a)) - np.repeat(begin, size) <= few  # the one above tells that there are more
    return found[keep], np.repeat(size > few, size)[keep]


def likely(p: np.ndarray, t: Fraction, few: int, only=None, side: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Candidates among postings in the order of ``first_places``: a is the later class, b the earlier.

    A class gets its ``few`` most alike.  ``only``: a ``Bloom`` of the later classes that are
    wanted, which then get all candidates.
    ``side``: pairs of one side are left out.
    """
    columns = {"n": p["n"].astype(np.int64), "left": p["n"].astype(np.int64) - p["at"], "b0": p["b0"].copy(), "b1": p["b1"].copy()}
    held, size, limit = [np.empty((0, 3), np.int64)], 0, 2 * _PAIRS
    for i, j in _pairs(p["tok"], p["n"], t):
        if side is not None:
            across = side[i] != side[j]
            i, j = i[across], j[across]
        i, j, differ = _passing(columns, i, j, t)
        x, y = p[i], p[j]
        swap = (x["doc"] > y["doc"]) | (x["doc"] == y["doc"]) & ((x["line"] > y["line"]) | (x["line"] == y["line"]) & (x["key"] > y["key"]))
        rows = np.column_stack([np.where(swap, x["key"], y["key"]), np.where(swap, y["key"], x["key"]), differ])
        if only is not None:
            rows = rows[only.value.has(rows[:, 0])]
            if len(rows):
                yield _candidates(*_handed_on(rows, None))
            continue
        held.append(rows)
        size += len(rows)
        if size > limit:  # what is cut off is told by the one above the few, which stays
            held = [_handed_on(np.concatenate(held), few)[0]]
            size = len(held[0])
            limit = max(2 * _PAIRS, 2 * size)
    if only is None:
        yield _candidates(*_handed_on(np.concatenate(held), few))


def _candidates(found: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    n = len(found)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(more), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["a", "b", "more", "grp", "packed"])


def _passed_on(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Empties a list of (part, postings): a row for each part and group of it by token."""
    parts: dict[int, list[np.ndarray]] = {}
    while held:
        part, p = held.pop()
        parts.setdefault(part, []).append(p)
    for part in list(parts):
        yield _grouped(part, np.concatenate(parts.pop(part)))


def _grouped(part: int, p: np.ndarray) -> pa.RecordBatch:
    """Postings of a part in groups by token, one row for each group."""
    group = (mixed(p["tok"].astype(np.uint64)) % np.uint64(GROUPS)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    which, begin = np.unique(group[order], return_index=True)
    cuts = [*begin.tolist(), len(p)]
    raw = pa.array([p[order[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    none = pa.nulls(len(which), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(which), pa.bool_()), pa.array(part * GROUPS + which), raw], names=["a", "b", "more", "grp", "packed"])


def candidate_pairs(blocks: DataFrame, threshold: float, parts: int, only=None) -> DataFrame:
    """(a, b, more): class a may be like the earlier class b; a written table.

    A task hands on HANDED_ON candidates of a class at most and tells if there are more;
    for the classes in ``only`` it hands on all.
    """
    t, few = Fraction(str(threshold)), HANDED_ON

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, hot = [], 0, False
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p = np.frombuffer(raw.as_buffer(), POSTING)
                held.append((part, p.copy()))
                size += p.nbytes
                if size > HELD_BYTES:
                    yield from _passed_on(held)
                    hot, size = True, 0
        if hot:
            yield from _passed_on(held)
        elif held:
            p = np.concatenate([p for _, p in held])
            held.clear()
            yield from likely(first_places(p), t, few, only)

    first = written(blocks.repartition(parts, "part").mapInArrow(run, PACKED), "pairs")
    pairs = first.filter("packed IS NULL").select("a", "b", "more")
    hot = first.filter("packed IS NOT NULL").select("grp", "packed")
    if not hot.isEmpty():
        pairs = pairs.union(hot_pairs(hot, t, parts, only))
    out = written(pairs.groupBy("a", "b").agg(F.max("more").alias("more")), "candidates")
    dropped(first)
    return out


def hot_pairs(hot: DataFrame, t: Fraction, parts: int, only=None) -> DataFrame:
    """(a, b, more) of groups (grp, packed) that were too much for a task: by pairs of blocks."""
    sizes = hot.groupBy("grp").agg(F.sum(F.octet_length("packed") / POSTING.itemsize).alias("n"))
    blocks = sizes.select("grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("n"))
    few = HANDED_ON

    @worker
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for grp, raw, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = np.frombuffer(raw, POSTING)
                own = (mixed(p["key"].view(np.uint64)) % np.uint64(n)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                which, begin = np.unique(own[order], return_index=True)
                cuts = [*begin.tolist(), len(p)]
                rows += [(grp, n, w, p[order[a:b]].tobytes()) for w, a, b in zip(which.tolist(), cuts[:-1], cuts[1:], strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["grp", "n", "own", "packed"])

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def met() -> Iterator[pa.RecordBatch]:
            p = first_places(np.concatenate([np.frombuffer(x, POSTING) for _, x in held]))
            left = np.concatenate([np.frombuffer(x, POSTING)["key"] for s, x in held if s == 0] or [np.empty(0, np.int64)])
            yield from likely(p, t, few, only, None if at[1] == at[2] else np.isin(p["key"], left))

        for batch in batches:
            for *place, side, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    if held:
                        yield from met()
                    at, held = place, []
                held.append((side, raw))
        if held:
            yield from met()

    dealt = hot.join(blocks, "grp").select("grp", "packed", "n").mapInArrow(deal, "grp long, n int, own int, packed binary")
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    place = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")]
    ordered = both.select("grp", *place, "packed").repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return ordered.mapInArrow(run, PACKED).select("a", "b", "more")


# ------------------------------------------------------------------------ verification


def _place(text_hash, line):
    """A number for a line of a text; Columns and arrays alike."""
    return text_hash ^ (line * _LINE) if isinstance(text_hash, np.ndarray) else text_hash.bitwiseXOR(line.cast("long") * F.lit(_LINE))


def chosen_lines(texts: pa.Array, chosen) -> pa.Array:
    """The lines for which ``chosen`` (of the text's number and the line's) holds, as texts."""
    raw, offsets = text_bytes(texts)
    breaks = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    text = np.repeat(np.arange(len(per_text)), per_text)
    keep = chosen(text, np.arange(len(text)) - (np.cumsum(per_text) - per_text)[text])
    start, end = start[keep], end[keep]
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    data = raw[np.cumsum(edge[:-1]) > 0]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)), pa.py_buffer(data.tobytes()))


def whole_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, tokens of every class in the pairs (and of a few others), from one line of each; a written table."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    lines = written(keys.join(classes, "key").select("at.*"), "needed")
    texts = written(lines.select("text_hash").distinct(), "needed")
    some_texts, some_lines = bloom(texts), bloom(lines.select(_place(F.col("text_hash"), F.col("line")).alias("place")))
    dropped(lines, texts)

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latest, slots = np.zeros(1 << 16, np.int64), np.uint64((1 << 16) - 1)
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            at = (hashes.view(np.uint64) & slots).astype(np.int64)
            wanted = some_texts.value.has(hashes) & (latest[at] != hashes)  # copies of a text say nothing new
            latest[at] = hashes
            if not wanted.any():
                continue
            mine = hashes[wanted]
            lines = chosen_lines(batch.column(1).filter(pa.array(wanted)), lambda text, line, mine=mine: some_lines.value.has(_place(mine[text], line)))
            _, keys, sizes, _, token = line_sets(lines)
            here = np.flatnonzero(sizes > 0)
            here = here[np.unique(keys[here], return_index=True)[1]]
            begin = np.cumsum(sizes) - sizes
            flat = np.concatenate([token[begin[i] : begin[i] + sizes[i]] for i in here.tolist()]) if len(here) else token[:0]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes[here].cumsum()]).astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[here]), lists], names=["key", "tokens"])

    got = _rows(docs).select("text_hash", "text").mapInArrow(run, "key long, tokens array<long>")
    return written(got.dropDuplicates(["key"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The later classes of the pairs (a, b) whose whole sets reach the threshold; a written table."""
    t = Fraction(str(threshold))
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return written(both.filter(shared * t.denominator >= (F.size("x") + F.size("y") - shared) * t.numerator).select("a").distinct(), "verified")


def prefix_tokens(sets: DataFrame, rarity, threshold: float) -> DataFrame:
    """token: those of the prefixes of the sets (tokens); a written table."""

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = pc.list_value_length(lists).to_numpy()
            token = lists.flatten().to_numpy().view(np.uint64)
            line = np.repeat(np.arange(len(sizes)), sizes)
            rare = rarity.value[(token & np.uint64(COUNTERS - 1)).astype(np.int64)]
            line, token = ordered_tokens(line, rare, token)
            at = np.arange(len(token)) - (np.cumsum(sizes) - sizes)[line]
            used = np.unique(token[at < prefix_sizes(sizes, threshold)[line]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(used)], names=["token"])

    return written(sets.select("tokens").mapInArrow(run, "token long").distinct(), "tokens")


def scanned_pairs(classes: DataFrame, todo: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a few classes with all the earlier ones that the length and bitmap filters leave; a written table."""
    t, lowest = Fraction(str(threshold)), np.iinfo(np.int64).min
    flat = classes.select("key", F.coalesce("first.doc_id", F.lit(lowest)).alias("doc"), F.col("first.line").alias("line"), "at.n", "at.b0", "at.b1")
    mine = todo.join(flat, F.col("a") == F.col("key")).drop("a").toPandas()
    given = classes.sparkSession.sparkContext.broadcast({c: mine[c].to_numpy(np.int64) for c in mine})

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = given.value
        for batch in gathered(batches, 1 << 15):
            some = {c: batch.column(c).to_numpy().astype(np.int64) for c in batch.schema.names}
            for k in range(len(late["key"])):
                both = some["n"] + late["n"][k]
                need = -(-both * t.numerator // (t.numerator + t.denominator))
                ok = (np.minimum(some["n"], late["n"][k]) >= need) & ((some["doc"] < late["doc"][k]) | (some["doc"] == late["doc"][k]) & ((some["line"] < late["line"][k]) | (some["line"] == late["line"][k]) & (some["key"] < late["key"][k])))
                here = np.flatnonzero(ok)
                differ = sum(np.bitwise_count((some[b][here] ^ late[b][k]).view(np.uint64)).astype(np.int64) for b in ("b0", "b1"))
                here = here[differ <= (both - 2 * need)[here]]
                if len(here):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), late["key"][k])), pa.array(some["key"][here])], names=["a", "b"])

    return written(flat.mapInArrow(run, "a long, b long"), "candidates")


def late_classes(docs: DataFrame, found: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a: the classes that an earlier class resembles; a written table."""
    spark = docs.sparkSession
    rarity = spark.sparkContext.broadcast(rarity_table(found))
    n = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * POSTING.itemsize // TASK_BYTES))
    handed = candidate_pairs(postings(docs, rarity, threshold, parts), threshold, parts)
    sets = whole_sets(docs, classes, handed)
    late = verified(handed.select("a", "b"), sets, threshold)
    todo = written(handed.filter("more").select("a").distinct().join(late, "a", "left_anti"), "open")
    n_open = todo.count()
    if n_open:
        if n_open <= OPEN:
            rest = scanned_pairs(classes, todo, threshold)
        else:  # only the postings of these classes' own prefixes travel again
            tokens = prefix_tokens(todo.join(sets, F.col("a") == F.col("key")), rarity, threshold)
            rest = candidate_pairs(postings(docs, rarity, threshold, parts, bloom(tokens)), threshold, parts, bloom(todo))
            dropped(tokens)
        again = whole_sets(docs, classes, rest)
        more = verified(rest.select("a", "b"), again, threshold)
        dropped(rest, again)
        late = written(late.union(more).distinct(), "verified")
    dropped(handed, sets, todo)
    return late


def duplicate_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n_lines, removed (ascending line numbers from 0) of every row."""
    small_batches(docs.sparkSession)
    found = written(line_keys(docs, threshold), "lines")
    texts = found.filter("block IS NULL").select("doc_id", "text_hash", "keys")
    lines = texts.select("doc_id", "text_hash", F.posexplode("keys").alias("line", "key")).filter("key IS NOT NULL")
    zipped = F.posexplode(F.arrays_zip("keys", "sizes", "b0", "b1")).alias("line", "x")
    marked = found.filter("block IS NULL").select("doc_id", "text_hash", zipped).select("doc_id", "text_hash", "line", F.col("x.keys").alias("key"), F.col("x.sizes").alias("n"), "x.b0", "x.b1").filter("key IS NOT NULL")
    classes = written(marked.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.min(F.struct("text_hash", "line", "n", "b0", "b1")).alias("at"), F.count(F.lit(1)).alias("m")), "classes")
    late = late_classes(docs, found, classes, threshold)
    gone = classes.join(late.select(F.col("a").alias("key"), F.lit(True).alias("late")), "key", "left").filter("m > 1 OR late")  # the one line of any other class stays
    gone = gone.select("key", F.when(F.col("late").isNull(), F.col("first")).alias("kept"))
    gone = written(gone, "kept")
    dropped(classes, late)
    off = lines.join(gone, "key").filter(~F.struct("doc_id", "line").eqNullSafe(F.col("kept")))
    removed = off.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    sizes = texts.select("doc_id", "text_hash", F.size("keys").alias("n_lines"))
    same = (F.col("s.text_hash") == F.col("r.text_hash")) & F.col("s.doc_id").eqNullSafe(F.col("r.doc_id"))
    return sizes.alias("s").join(removed.alias("r"), same, "left").select("s.doc_id", "s.text_hash", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def line_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0, joined by commas)."""
    found = duplicate_lines(docs, threshold)
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of these ascending numbers (from 0), in time linear in its lines.

    The runs of lines between two removed ones are sliced out; the lines are split once,
    as the lambda's variable holds them.
    """
    ends = lambda lines: F.concat(removed, F.array(F.size(lines)))
    runs = lambda lines: F.zip_with(F.concat(F.array(F.lit(-1)), removed), ends(lines), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.flatten(runs(lines)), "\n"))[0]


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without their duplicate lines, with all columns of ``docs``.

    A document whose lines were all removed, and which had any, is dropped.
    """
    found = duplicate_lines(docs, threshold).filter(F.size("removed") > 0)
    one = found.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("n_lines"))).filter("turn = 1")
    one = written(one.select("doc_id", "text_hash", "n_lines", "removed"), "removed")
    size = one.agg(F.sum(F.size("removed") * 4 + 64).alias("n")).first()["n"] or 0
    side = (F.broadcast(one) if size <= REMOVED_BYTES else one).alias("r")
    rows = docs.alias("d").join(side, (F.xxhash64("d.text") == F.col("r.text_hash")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")), "left")
    text = F.when(F.col("r.removed").isNull(), F.col("d.text")).otherwise(without_lines(F.col("d.text"), F.col("r.removed")))
    left = F.col("r.removed").isNull() | (F.size("r.removed") < F.col("r.n_lines"))
    return rows.filter(left).select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
