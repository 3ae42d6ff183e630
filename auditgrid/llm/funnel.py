"""Ordered funnels over time buckets.

Events are distinct (client, kind, time).  Each row of a funnel's first kind starts an
attempt.  The next step is the client's earliest row of its kind that is later than the
previous step; it is reached unless it lies more than ``within`` after the first step, or a
row of the excluded kind lies after the previous step and not after the next.  Otherwise
the attempt ends.

1. A row goes to the time bucket that it lies in and to every earlier one from which an
   attempt can still see it, so a bucket holds all that its own first steps need up to the
   full horizon of all steps.  One shuffle deals (client, bucket) out; a client's rows are
   spread over its buckets.
2. A task reads its buckets in order of time and follows the attempts at home in them with
   ``merge_asof`` forward, without exact matches.  It holds ``CHUNK`` rows and, of a bucket
   that is larger, the rows of one horizon: a bucket of any size fits.  Attempts leave the
   task as counts of (funnel, client, step, time since the previous step).
3. Order statistics of the times come from two rounds of counting: counts by ranges of
   about the square root of the horizon find the range that holds the wanted place, counts
   of single times within it the value.  No client's times are gathered or sorted at once.

Rows with a null client, kind or time are left out, repeated rows count once, kinds that no
funnel names and other columns are ignored (columns may have the names of the result).  A
time without a zone is taken as it stands.  A funnel may name a kind twice, also as its
first and its excluded one; an excluded row at the time of the next step ends the attempt,
one at the time of the previous step does not.  No events give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, release, small_batches, written

CHUNK = 1 << 16  # rows that a task follows at once
BUCKET = 3600 * 1_000_000
WITHIN = 300 * 1_000_000


class Funnel(NamedTuple):
    name: str
    steps: tuple[str, ...]
    excluded: str


def micros(events: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without a zone is not moved by the session's."""
    at = F.col(name)
    if isinstance(events.schema[name].dataType, T.TimestampNTZType):
        return ((at - F.lit("1970-01-01").cast("timestamp_ntz")).cast("decimal(18,6)") * 1_000_000).cast("long")
    return F.unix_micros(at)


def bucketed(events: DataFrame, kinds: list[str], client: str, kind: str, time: str, bucket: int, within: int) -> DataFrame:
    """client, bucket (its first microsecond), t, kind (place in ``kinds``), with the copies for earlier buckets."""
    rows = events.select(F.col(client).alias("client"), micros(events, time).alias("t"), F.array_position(F.array(*map(F.lit, kinds)), F.col(kind)).cast("int").alias("kind"))
    rows = rows.filter(F.col("client").isNotNull() & F.col("t").isNotNull() & (F.col("kind") > 0))
    start = lambda x: x - F.pmod(x, F.lit(bucket))
    return rows.withColumn("bucket", F.explode(F.sequence(start(F.col("t") - within), start(F.col("t")), F.lit(bucket))))


def _next(cur: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
    """For each attempt (by ``prev``) the earliest time of its group in ``rows`` that is later, or nan."""
    return pd.merge_asof(cur, rows, left_on="prev", right_on="t", by="g", direction="forward", allow_exact_matches=False)["t"].to_numpy(float)


def followed(rows: pd.DataFrame, first: np.ndarray, funnels: list[Funnel], kinds: list[str], within: int) -> pd.DataFrame:
    """funnel, g, step, dt of every step that the attempts starting in the rows ``first`` reach.

    rows: g (the group), t, kind; ordered by t.
    """
    of = {k: rows.loc[rows["kind"] == i, ["g", "t"]] for i, k in enumerate(kinds, 1)}
    out = []
    for i, f in enumerate(funnels):
        start = rows.loc[first & (rows["kind"] == kinds.index(f.steps[0]) + 1).to_numpy(), ["g", "t"]]
        cur = pd.DataFrame({"g": start["g"].to_numpy(), "prev": start["t"].to_numpy(), "start": start["t"].to_numpy()})
        out.append(pd.DataFrame({"funnel": i, "g": cur["g"], "step": 1, "dt": 0}))
        for step, kind in enumerate(f.steps[1:], 2):
            then, barred = _next(cur, of[kind]), _next(cur, of[f.excluded])
            reached = (then - cur["start"].to_numpy() <= within) & ~(barred <= then)
            cur, then = cur[reached], then[reached].astype(np.int64)
            out.append(pd.DataFrame({"funnel": i, "g": cur["g"], "step": step, "dt": then - cur["prev"].to_numpy()}))
            cur = cur.assign(prev=then).sort_values("prev", kind="stable", ignore_index=True)
    return pd.concat(out, ignore_index=True)


def _steps(rows: DataFrame, funnels: list[Funnel], kinds: list[str], bucket: int, within: int) -> DataFrame:
    """funnel, client, step, dt, n from buckets that lie together and in order."""
    kind = rows.schema["client"].dataType

    def settled(held: pd.DataFrame, ended: bool) -> tuple[pa.RecordBatch | None, pd.DataFrame]:
        """Counts of the attempts that can be followed to their end, and the rows that later ones need."""
        held = held[(held != held.shift()).any(axis=1)]  # a repeated row follows its like
        new = (held["client"] != held["client"].shift()) | (held["bucket"] != held["bucket"].shift())
        g, t = new.cumsum().to_numpy(), held["t"].to_numpy()
        last = g == g[-1]
        home = t >= held["bucket"].to_numpy()
        home &= t < held["bucket"].to_numpy() + bucket
        rest = held[last & (t >= t[-1] - within)] if not ended else held[:0]
        if not ended:
            home &= ~last | (t < t[-1] - within)
        order = np.argsort(t, kind="stable")
        got = followed(pd.DataFrame({"g": g, "t": t - t.min(), "kind": held["kind"].to_numpy()}).iloc[order], home[order], funnels, kinds, within)
        if got.empty:
            return None, rest
        client = held["client"].to_numpy()[np.flatnonzero(new.to_numpy())]
        got = got.assign(client=client[got["g"].to_numpy() - 1]).groupby(["funnel", "client", "step", "dt"], sort=False).size().reset_index(name="n")
        return pa.RecordBatch.from_pandas(got.astype({"funnel": "int32", "step": "int32", "dt": "int64", "n": "int64"}), preserve_index=False), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0
        try:
            for batch in batches:
                held.append(batch.to_pandas())
                size += len(held[-1])
                if size >= CHUNK:
                    out, rest = settled(pd.concat(held, ignore_index=True), False)
                    held, size = [rest], 0  # rows of one horizon may be many: a full chunk of new ones comes first
                    if out is not None:
                        yield out
            if held and (rows := pd.concat(held, ignore_index=True)).size:
                out, _ = settled(rows, True)
                if out is not None:
                    yield out
        finally:
            release()

    schema = T.StructType([T.StructField("funnel", T.IntegerType()), T.StructField("client", kind), T.StructField("step", T.IntegerType()), T.StructField("dt", T.LongType()), T.StructField("n", T.LongType())])
    dealt = rows.repartition("client", "bucket").sortWithinPartitions("client", "bucket", "t", "kind")
    return dealt.mapInArrow(run, schema).groupBy("funnel", "client", "step", "dt").agg(F.sum("n").alias("n"))


def kth_times(steps: DataFrame, within: int, percent: int) -> DataFrame:
    """funnel, client, step, q: the ceil(percent * n / 100)-th smallest dt of n, by two rounds of counting."""
    key = ["funnel", "client", "step"]
    wide = math.isqrt(within) + 1
    in_order = lambda by: Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    times = steps.filter("step > 1").withColumn("bin", (F.col("dt") - F.pmod("dt", F.lit(wide))))
    bins = times.groupBy(*key, "bin").agg(F.sum("n").alias("m"))
    bins = bins.withColumn("upto", F.sum("m").over(in_order("bin"))).withColumn("all", F.sum("m").over(Window.partitionBy(*key)))
    place = F.expr(f"({percent} * `all` + 99) div 100")
    found = bins.withColumn("need", place - (F.col("upto") - F.col("m"))).filter((F.col("need") > 0) & (F.col("need") <= F.col("m"))).select(*key, "bin", "need")
    inside = times.join(found, [*key, "bin"]).withColumn("upto", F.sum("n").over(in_order("dt")))
    return inside.filter(F.col("upto") >= F.col("need")).groupBy(*key).agg(F.min("dt").alias("q"))


def ordered_funnels(events: DataFrame, funnels: list[Funnel], client: str = "client_id", kind: str = "kind", time: str = "arrived_at", within: int = WITHIN, percent: int = 25, bucket: int = BUCKET) -> DataFrame:
    """funnel, client, n1.., deepest, t2.., same_depth: one row for each funnel and client with attempts.

    within, bucket: microseconds.  n: attempts that reach each step; t: the
    ceil(percent * n / 100)-th smallest time from the step before; same_depth: clients of
    equal funnel and deepest.
    """
    small_batches(events.sparkSession)
    kinds = sorted({k for f in funnels for k in (*f.steps, f.excluded)})
    longest = max(len(f.steps) for f in funnels)
    steps = written(_steps(bucketed(events, kinds, client, kind, time, bucket, within), funnels, kinds, bucket, within), "funnel-steps")
    n = steps.select("funnel", "client", "step", "n", F.lit(None).cast("long").alias("q"))
    q = kth_times(steps, within, percent).select("funnel", "client", "step", F.lit(0).cast("long").alias("n"), "q")
    at = lambda k, name: F.when(F.col("step") == k, F.col(name))
    each = n.unionByName(q).groupBy("funnel", "client").agg(
        *(F.coalesce(F.sum(at(k, "n")), F.lit(0)).alias(f"n{k}") for k in range(1, longest + 1)),
        F.max("step").alias("deepest"),
        *(F.max(at(k, "q")).alias(f"t{k}") for k in range(2, longest + 1)),
    )
    each = written(each, "funnel-clients")
    dropped(steps)
    depth = each.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # a row for each funnel and step
    name = F.element_at(F.array(*(F.lit(f.name) for f in funnels)), F.col("funnel") + 1)
    return each.join(F.broadcast(depth), ["funnel", "deepest"]).select(name.alias("funnel"), F.col("client").alias(client), *(f"n{k}" for k in range(1, longest + 1)), "deepest", *(f"t{k}" for k in range(2, longest + 1)), "same_depth")
