"""Seeded selection that does not depend on partitions: by the md5 of seed and id.

Exact quotas are met without sorting a stratum in one task: rows are counted by the first
hex digits of their hash; whole buckets under the quota are in, and only the bucket in
which the quota falls is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import NO_FINDING, POSITIVE, URGENT

_DIGITS = 3


def seeded(seed: int, id_col: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")).cast("binary"))


def within_quota(rows: DataFrame, quotas: DataFrame, stratum: str, id_col: str, seed: int) -> DataFrame:
    """Rows with ``_in``: whether they are among the ``quota`` least hashes of their stratum.

    ``quotas``: a row (stratum, quota) for each stratum.
    """
    keyed = rows.withColumn("_h", seeded(seed, F.col(id_col))).withColumn("_b", F.left(F.col("_h"), F.lit(_DIGITS)))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = keyed.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before).join(quotas, stratum)
    side = buckets.select(stratum, "_b", (F.col("quota") - F.col("_before")).alias("_room"), "_n")
    joined = keyed.join(side, [stratum, "_b"])
    whole = joined.filter((F.col("_room") >= F.col("_n")) | (F.col("_room") <= 0)).withColumn("_in", F.col("_room") > 0)
    split = joined.filter((F.col("_room") < F.col("_n")) & (F.col("_room") > 0))
    turn = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", id_col))
    return whole.unionByName(split.withColumn("_in", turn <= F.col("_room"))).drop("_h", "_b", "_room", "_n")


def balanced(sets: DataFrame, ratio: float = 1.0, seed: int = 0, id_col: str = "image_id") -> DataFrame:
    """All positives, and round(ratio * positives) normals (all, if there are fewer).

    Halves are rounded to even.
    """
    counts = sets.groupBy("is_normal").count()
    n = counts.filter("NOT is_normal").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    quotas = n.select(F.lit(True).alias("is_normal"), F.bround(F.lit(float(ratio)) * F.col("n")).cast("long").alias("quota"))
    normals = within_quota(sets.filter("is_normal"), quotas, "is_normal", id_col, seed).filter("_in").drop("_in")
    return sets.filter("NOT is_normal").unionByName(normals)


def stratified_split(sets: DataFrame, fraction: float = 0.1, seed: int = 0, id_col: str = "image_id", stratum: str = "signature") -> DataFrame:
    """Rows with ``split``: round(n * fraction) of each stratum are 'val', the others 'train'."""
    quotas = sets.groupBy(stratum).agg(F.bround(F.count(F.lit(1)) * F.lit(float(fraction))).cast("long").alias("quota"))
    return within_quota(sets, quotas, stratum, id_col, seed).withColumn("split", F.when(F.col("_in"), "val").otherwise("train")).drop("_in")


def stratified_subset(sets: DataFrame, size: int = 280, seed: int = 20260612, id_col: str = "image_id") -> DataFrame:
    """All urgent rows, filled up to ``size`` by turns over the other labels and the normals.

    A row may stand in several strata and is taken once.  A turn can pass over at most as
    many taken rows as were filled in, so 2 * size rows of each stratum are enough; these
    alone come to the driver, where turns are taken.  Urgent rows may exceed the size.
    """
    urgent = F.arrays_overlap("labels", F.array(*map(F.lit, URGENT)))
    kept, others = sets.filter(urgent), sets.filter(~urgent)
    room = size - kept.count()
    if room <= 0:
        return kept
    strata = [x for x in POSITIVE if x not in URGENT] + [NO_FINDING]
    pools = []
    for s in strata:
        mine = others.filter("is_normal" if s == NO_FINDING else F.array_contains("labels", s))
        pools.append([r[0] for r in mine.select(id_col).orderBy(seeded(seed, F.concat(F.lit(f"{s}|"), F.col(id_col).cast("string"))), id_col).limit(2 * size).collect()])
    taken, turns = set(), [iter(p) for p in pools]
    moved = True
    while moved and len(taken) < room:
        moved = False
        for turn in turns:
            x = next((x for x in turn if x not in taken), None) if len(taken) < room else None
            if x is not None:
                taken.add(x)
                moved = True
    chosen = sets.sparkSession.createDataFrame([(x,) for x in sorted(taken)], sets.select(id_col).schema)
    return kept.unionByName(others.join(F.broadcast(chosen), id_col, "left_semi"))


def pool_union(pools: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each content key: that of the first pool (``pool_ord``), then by ``order``.

    The winning row travels in the aggregate, so there is one shuffle and no join.
    """
    place = ["pool_ord", *order]
    others = [c for c in pools.columns if c != key]
    best = F.min_by(F.struct(*others), F.struct(*place)).alias("best")
    return pools.groupBy(key).agg(best).select(*[F.col(c) if c == key else F.col(f"best.{c}").alias(c) for c in pools.columns])


def pool_report(pools: DataFrame, key: str, order: list[str]) -> DataFrame:
    """pool, raw, kept, within_pool and cross_pool duplicates of each pool.

    With ``labels`` among the columns also urgent_<label>: the kept rows that have it, a
    content's labels being those of its row that is kept.
    """
    first = {"n": F.count(F.lit(1))}
    if "labels" in pools.columns:
        first["labels"] = F.min_by("labels", F.struct("pool_ord", *order))
    per = pools.groupBy(key, "pool", "pool_ord").agg(*[c.alias(n) for n, c in first.items()])
    rows = per.withColumn("first_ord", F.min("pool_ord").over(Window.partitionBy(key)))
    owns = F.col("pool_ord") == F.col("first_ord")
    one = owns.cast("long")
    sums = [F.sum("n").alias("raw"), F.sum(one).alias("kept"), F.sum(F.col("n") - 1).alias("within_pool"), F.sum(1 - one).alias("cross_pool")]
    if "labels" in pools.columns:
        sums += [F.count_if(owns & F.array_contains("labels", x)).alias(f"urgent_{x}") for x in URGENT]
    return rows.groupBy("pool", "pool_ord").agg(*sums)


def without_leaks(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose content key is not among the excluded."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def pool_pairs(**flags: list[str]) -> list[dict[str, str]]:
    """The pools that repeatable settings name together: the i-th values of all; unequal numbers are an error."""
    numbers = {name: len(values) for name, values in flags.items()}
    if len(set(numbers.values())) > 1:
        raise ValueError(f"settings of pools differ in number: {numbers}")
    return [dict(zip(flags, values, strict=True)) for values in zip(*flags.values(), strict=True)]
