"""Exact one-to-one matches over all images of a label, without comparing all pairs at once.

Greedy matching takes pairs from the largest overlap down, ties by the smaller places, so it
can be done in bands of falling overlap: a band's pairs are matched, matched boxes leave, and
the next band looks at what is left.

1. Equal boxes of a label are one class with a queue of boxes, in the order of their places: all
   of them overlap others alike, so greedy matching takes them from the queue's head.  A match
   is a run: so many boxes from some turn on of one queue with as many of another.
2. Boxes that equal each other come first: the k-th predicted one goes to the k-th expected one.
3. Boxes that overlap by t lie within 1 - t of the longest side of each other on both axes, so a band's pairs of classes come from an equi-join on cells of a grid, salted so that a full
   cell is spread over tasks.  Pairs are only counted at first, by label and overlap.
4. The counts cut the band where no label has more than ``FOLD_PAIRS`` pairs of classes: these
   are folded, a label a task.  Where a single step of overlap has more (ties), rounds of
   locally best pairs, which greedy matching takes in any case, thin them out until they fit.
5. Places matter only where pairs of classes tie.  A fold gets the heads of the queues,
   ``FOLD_ROWS`` boxes a label at most (and one of each queue); where it would need a place
   beyond them it stops, as all that it has matched stands, and the next one goes on from there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES, iou
from .scratch import settled

FOLD_PAIRS = 1_000_000
FOLD_ROWS = 4_000_000
LEVELS = (0.9, 0.7, 0.5)
STEPS = 1000  # of overlap, in which pairs are counted
CELL_ROWS = 4096
_SLICE = 1024  # pairs of a fold that are looked at together
SIDES = ("p", "g")
#: n boxes of class p from its turn p_at on (from 0) with as many of g; n is 0 where a label's fold had to stop.
_RUN = "finding string, p long, p_at long, g long, g_at long, n long, iou double"
_COLUMNS = ("finding", "p", "p_at", "g", "g_at", "n", "iou")

def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add each row's place, from 1, among those of equal keys: no key is sorted in one task.

    Ranges of (keys, order) are dealt out; a row's place is that within its range and the
    sizes of the ranges before.
    """
    parts = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    parts = settled(parts, "ranges")
    sizes = parts.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    local = parts.withColumn(name, F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)).cast("long"))
    same = (local["_part"] == before["_part"]) & _all(local[k].eqNullSafe(before[k]) for k in keys)
    kept = [local[c] for c in rows.columns]
    return local.join(before, same).select(*kept, (local[name] + F.coalesce(before["_before"], F.lit(0))).alias(name))


def _all(conditions: Iterator[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def classes_of(rows: DataFrame) -> DataFrame:
    """finding, box, c (a number), p and g (boxes of each side), m (those that an equal box takes).

    ``rows``: side, finding, box.  Boxes with another one closer than 1e-9, or without area, are left to the bands.
    """
    sizes = rows.groupBy("finding", "box").agg(*[F.count_if(F.col("side") == n).alias(n) for n in SIDES])
    sizes = settled(sizes.withColumn("c", F.monotonically_increasing_id()), "classes")
    near = [F.round(f"box.{a}", 9).alias(a) for a in AXES]
    alone = sizes.groupBy("finding", *near).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("_n")).filter("_n = 1 AND y1 > y0 AND x1 > x0").select("c", F.lit(True).alias("_alone"))
    return settled(sizes.join(alone, "c", "left").withColumn("m", F.when(F.col("_alone"), F.least(*SIDES)).otherwise(0)).drop("_alone"), "classes")


def close_pairs(p: DataFrame, g: DataFrame, least: float) -> DataFrame:
    """finding, p, g, their turns and numbers of boxes left, iou of all pairs of classes of a label that overlap by ``least`` or more."""
    span = lambda c, a: F.col(f"{c}.{a}1") - F.col(f"{c}.{a}0")
    most = p.select("box").unionByName(g.select("box")).agg(F.max(span("box", "y")).alias("y0"), F.max(span("box", "x")).alias("x0")).first()
    # boxes that overlap by t lie within 1 - t of the longer side of each other
    wide = {a: max((1.0 - least) * (most[a] or 0.0), 0.005) * (1 + 1e-9) for a in ("y0", "x0")}
    cell = lambda a: F.floor(F.col(f"box.{a}") / wide[a]).cast("int")
    placed = p.withColumns({"cy": cell("y0"), "cx": cell("x0")})
    full = placed.groupBy("finding", "cy", "cx").count().agg(F.max("count")).first()[0] or 0
    salts = -(-full // CELL_ROWS) or 1
    around = lambda a: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell(a) + d))
    copies = g.select("finding", "g", "g_at", "g_n", F.col("box").alias("other"), around("y0").alias("cy"), "box")
    copies = copies.select("finding", "g", "g_at", "g_n", "other", "cy", around("x0").alias("cx"))
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(salts)).cast("int"))
    # the classes are few and their pairs many: dealt anew, as a small table is read by one task
    dealt = salted.repartition(2 * p.sparkSession.sparkContext.defaultParallelism, "p")
    shared = lambda a: F.least(f"box.{a}1", f"other.{a}1") - F.greatest(f"box.{a}0", f"other.{a}0") >= F.greatest(span("box", a), span("other", a)) * least - 1e-9
    pairs = dealt.join(copies, ["finding", "cy", "cx", "salt"]).filter(shared("y") & shared("x"))
    return pairs.select("finding", "p", "p_at", "p_n", "g", "g_at", "g_n", iou(F.col("box"), F.col("other")).alias("iou")).filter(F.col("iou") >= least)


class _Queues:
    """What is left of the classes of one side of a label (by a number within it), and the places of their heads."""

    def __init__(self, classes: np.ndarray, turns: np.ndarray, left: np.ndarray, heads: dict[int, np.ndarray]):
        self.classes, self.start, self.turn, self.left = classes.tolist(), turns.tolist(), turns.tolist(), left.tolist()
        self.heads = [heads.get(c, ()) for c in self.classes]
        self.some = left > 0

    def head(self, c: int) -> int | None:
        """The place of a class's next box; None if it was not handed over."""
        at, known = self.turn[c] - self.start[c], self.heads[c]
        return int(known[at]) if at < len(known) else None

    def take(self, c: int, n: int) -> int:
        at = self.turn[c]
        self.turn[c] += n
        self.left[c] -= n
        self.some[c] = self.left[c] > 0
        return at


def _tied(pairs: list[tuple[int, int]], p: _Queues, g: _Queues, runs: list[list]) -> bool:
    """Match the boxes of pairs of classes that overlap equally, by their places; False if one is not known."""
    near: dict[int, list[int]] = {}
    shared: dict[int, int] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        shared[b] = shared.get(b, 0) + 1
    for a, b in pairs:  # nothing else wants either of them
        if len(near[a]) == 1 and shared[b] == 1:
            n = min(p.left[a], g.left[b])
            runs.append([a, p.take(a, n), b, g.take(b, n), n])
            del near[a]
    heads = [(p.head(a), a) for a in near]
    if any(x is None for x, _ in heads):
        return False
    heapq.heapify(heads)
    while heads:
        _, a = heads[0]
        free = near[a] = [b for b in near[a] if g.left[b]]
        if not free:
            heapq.heappop(heads)
            continue
        places = [g.head(b) for b in free] if len(free) > 1 else [0]
        if None in places:
            return False
        b = free[places.index(min(places))]
        at, to = p.take(a, 1), g.take(b, 1)
        last = runs[-1] if runs else None
        if last and (last[0], last[1] + last[4], last[2], last[3] + last[4]) == (a, at, b, to):
            last[4] += 1
        else:
            runs.append([a, at, b, to, 1])
        if not p.left[a]:
            heapq.heappop(heads)
        elif (head := p.head(a)) is None:
            return False
        else:
            heapq.heapreplace(heads, (head, a))
    return True


def _heads_by_class(rows: pa.Table, side: str) -> dict[int, np.ndarray]:
    mine = rows.filter(pc.equal(rows.column("side"), side))
    c, k, place = (mine.column(n).to_numpy() for n in ("c", "k", "place"))
    order = np.lexsort((k, c))
    c, place = c[order], place[order]
    cuts = np.flatnonzero(np.diff(c)) + 1
    return dict(zip(c[np.concatenate([[0], cuts])].tolist() if len(c) else [], np.split(place, cuts), strict=False))


def _fold(pairs: pa.Table, heads: pa.Table) -> pa.Table:
    """The runs of one label, as far as the places go."""
    cols = {n: pairs.column(n).to_numpy() for n in pairs.column_names if n != "finding"}
    out: list[list] = []
    if pairs.num_rows:
        order = np.argsort(-cols["iou"], kind="stable")
        overlap, ends, queues = cols["iou"][order], {}, []
        for n in SIDES:
            classes, first, at = np.unique(cols[n], return_index=True, return_inverse=True)
            ends[n] = at[order]
            queues.append(_Queues(classes, cols[f"{n}_at"][first], cols[f"{n}_n"][first], _heads_by_class(heads, n)))
        p, g = queues
        cuts = np.concatenate([np.flatnonzero(np.diff(overlap)) + 1, [len(order)]])
        lo, whole = 0, True
        while whole and lo < len(order):
            # most pairs have lost an end when their turn comes: they are left out a slice at a time
            hi = int(cuts[min(np.searchsorted(cuts, lo + _SLICE), len(cuts) - 1)])
            free = lo + np.flatnonzero(p.some[ends["p"][lo:hi]] & g.some[ends["g"][lo:hi]])
            for level in np.split(free, np.flatnonzero(np.diff(overlap[free])) + 1):
                tied = [(a, b) for a, b in zip(ends["p"][level].tolist(), ends["g"][level].tolist(), strict=True) if p.left[a] and g.left[b]]
                if not tied:
                    continue
                runs: list[list] = []
                whole = _tied(tied, p, g, runs)
                out += [[p.classes[a], x, g.classes[b], y, n, float(overlap[level[0]])] for a, x, b, y, n in runs]
                if not whole:
                    out.append([-1, 0, -1, 0, 0, None])
                    break
            lo = hi
    label = pairs.column("finding")[0].as_py() if pairs.num_rows else None
    kinds = [pa.int64()] * 5 + [pa.float64()]
    arrays = [pa.array([label] * len(out), pa.string()), *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]]
    return pa.Table.from_arrays(arrays, names=list(_COLUMNS))


def folded(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Greedy runs of a bounded number of pairs of classes a label; ``heads``: finding, side, c, k, place."""
    return pairs.groupBy("finding").cogroup(heads.drop("turn").groupBy("finding")).applyInArrow(_fold, _RUN)


def locally_best(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Runs of the pairs that are the best of both their ends: of all their boxes, or of one where others tie with them."""
    place = {n: heads.filter((F.col("side") == n) & (F.col("turn") == 0)).select(F.col("c").alias(n), F.col("place").alias(f"{n}_place")) for n in SIDES}
    near = pairs.join(place["p"], "p").join(place["g"], "g")

    def best(end: str, other: str) -> DataFrame:
        mine = near.groupBy("finding", end).agg(F.min(F.struct((-F.col("iou")).alias("less"), f"{other}_place", other)).alias("m"), F.max("iou").alias("_top"))
        ties = near.join(mine.select("finding", end, "_top"), ["finding", end]).filter("iou = _top").groupBy("finding", end).agg((F.count(F.lit(1)) > 1).alias(f"{end}_tie"))
        return mine.select("finding", end, F.col(f"m.{other}").alias(other)).join(ties, ["finding", end])

    both = best("p", "g").join(best("g", "p"), ["finding", "p", "g"]).join(pairs, ["finding", "p", "g"])
    n = F.when(F.col("p_tie") | F.col("g_tie"), F.lit(1).cast("long")).otherwise(F.least("p_n", "g_n"))
    return both.withColumn("n", n).select(*_COLUMNS)


def _advanced(left: DataFrame, runs: DataFrame, side: str) -> DataFrame:
    """The classes that still have boxes once the runs have left."""
    gone = runs.groupBy(side).agg(F.sum("n").alias("_gone"))
    now = left.join(gone, side, "left").withColumn("_gone", F.coalesce("_gone", F.lit(0).cast("long")))
    return now.withColumns({f"{side}_at": F.col(f"{side}_at") + F.col("_gone"), f"{side}_n": F.col(f"{side}_n") - F.col("_gone")}).filter(f"{side}_n > 0").drop("_gone")


def _heads(rows: DataFrame, left: dict[str, DataFrame], most: int | None) -> DataFrame:
    """The next boxes of the queues, ``most`` a label (and one a class): finding, side, c, k, turn, place; without ``most`` the first."""
    both = left["p"].select(F.lit("p").alias("side"), F.col("p").alias("c"), F.col("p_at").alias("_at"), F.col("p_n").alias("_n"), "finding")
    both = both.unionByName(left["g"].select(F.lit("g").alias("side"), F.col("g").alias("c"), F.col("g_at").alias("_at"), F.col("g_n").alias("_n"), "finding"))
    share = 0.0
    if most is not None:
        full = both.groupBy("finding").agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 1
        share = min(1.0, most / full)
    upto = F.ceil(F.col("_n") * F.lit(share)) if share else F.lit(1)
    turn = F.col("k") - 1 - F.col("_at")
    mine = rows.join(both.withColumn("_upto", F.greatest(upto, F.lit(1))).drop("finding"), ["side", "c"])
    return mine.withColumn("turn", turn).filter("turn >= 0 AND turn < _upto").select("finding", "side", "c", "k", "turn", "place")


def pooled_runs(rows: DataFrame, classes: DataFrame, threshold: float, fold_pairs: int = FOLD_PAIRS, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Greedy matches as runs; ``rows``: side, finding, at, box, settled; ``classes``: those of the rows."""
    equal = classes.filter("m > 0").select("finding", F.col("c").alias("p"), F.lit(0).cast("long").alias("p_at"), F.col("c").alias("g"), F.lit(0).cast("long").alias("g_at"), F.col("m").alias("n"), F.lit(1.0).alias("iou"))
    left = {n: classes.filter(f"{n} > m").select("finding", "box", F.col("c").alias(n), F.col("m").alias(f"{n}_at"), (F.col(n) - F.col("m")).alias(f"{n}_n")) for n in SIDES}
    over = classes.filter("p > m OR g > m")
    ahead = rows.join(over.select("finding", "box", "c", "m", *[F.col(n).alias(f"_{n}") for n in SIDES]), ["finding", "box"])
    ahead = ahead.filter("side = 'p' AND _p > m OR side = 'g' AND _g > m").select("side", "finding", "c", "m", "at", "box")
    turns = numbered(ahead.drop("box"), ["side", "c"], ["at"], "k").filter("k > m").drop("m")
    boxes = over.select("c", "box")
    spread = numbered(turns.join(boxes, "c"), ["side", "finding"], ["at", "box", "k"], "place").select("finding", "side", "c", "k", "place")
    queues = settled(spread, "queues")
    done = equal
    least = max(threshold, 1e-12)
    for level in [*[x for x in LEVELS if x > least], least]:
        while True:
            pairs = close_pairs(left["p"], left["g"], level)
            step = F.least(F.floor(F.col("iou") * STEPS), F.lit(STEPS - 1)).cast("int")
            counts = pairs.groupBy("finding", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # STEPS rows a label at most
            if not counts:
                break
            upto: dict[str, int] = {}
            cut = None
            for at in sorted({r["step"] for r in counts}, reverse=True):
                for r in counts:
                    if r["step"] == at:
                        upto[r["finding"]] = upto.get(r["finding"], 0) + r["n"]
                if max(upto.values()) > fold_pairs:
                    break
                cut = at
            if cut is None:  # too many pairs in one step: those that greedy matching takes in any case
                best = pairs.filter(step >= max(r["step"] for r in counts))
                found, whole = settled(locally_best(settled(best, "band"), _heads(queues, left, None)), "matches"), False
            else:
                found = settled(folded(pairs.filter(step >= cut), _heads(queues, left, fold_rows)), "matches")
                whole = cut == min(r["step"] for r in counts) and found.filter("n = 0").isEmpty()
                found = found.filter("n > 0")
            done = done.unionByName(found)
            left = {n: settled(_advanced(x, found, n), "left") for n, x in left.items()}
            if whole:
                break
    return done.filter(F.col("iou") >= threshold)


def _both(predicted: DataFrame, expected: DataFrame, id_col: str) -> DataFrame:
    one = lambda rows, n: rows.filter("box IS NOT NULL").select(F.lit(n).alias("side"), "finding", F.struct(id_col, "ord").alias("at"), "box")
    return settled(one(predicted, "p").unionByName(one(expected, "g")), "boxes")


def pooled_overlaps(predicted: DataFrame, expected: DataFrame, threshold: float, id_col: str = "image_id", fold_pairs: int = FOLD_PAIRS, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """finding, iou, n: how many greedy matches of a label over all images overlap so much; see pooled_matches."""
    rows = _both(predicted, expected, id_col)
    return pooled_runs(rows, classes_of(rows), threshold, fold_pairs, fold_rows).select("finding", "iou", "n")


def pooled_matches(predicted: DataFrame, expected: DataFrame, threshold: float, id_col: str = "image_id", fold_pairs: int = FOLD_PAIRS, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """finding, i, j, iou: greedy matches by label over all images; i and j are (id, ord).

    Ties go to the smaller i, then j.  Boxes lie in [0, 1]; a threshold of 0 or less counts
    every overlap.  Rows without a box take no part.
    """
    rows = _both(predicted, expected, id_col)
    classes = classes_of(rows)
    runs = pooled_runs(rows, classes, threshold, fold_pairs, fold_rows)
    queued = settled(numbered(rows.join(classes.select("finding", "box", "c"), ["finding", "box"]).select("side", "c", "at"), ["side", "c"], ["at"], "k"), "places")
    turn = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_turn")
    out = runs.select("finding", "iou", "p", "p_at", "g", "g_at", turn)
    for n, name in (("p", "i"), ("g", "j")):
        mine = queued.filter(F.col("side") == n).select(F.col("c").alias(n), F.col("k").alias("_k"), F.col("at").alias(name))
        out = out.withColumn("_k", F.col(f"{n}_at") + F.col("_turn")).join(mine, [n, "_k"]).drop("_k")
    return out.select("finding", "i", "j", "iou")
