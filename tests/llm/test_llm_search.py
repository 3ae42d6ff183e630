"""Funnels, ranked search and neighbour search against brute force, and their odd inputs."""

from __future__ import annotations

import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from auditgrid.llm import funnel, neighbours, queries, ranked

SF = "/root/testdata/sf0.001"

# ------------------------------------------------------------------------------ funnels


def brute_funnels(events, funnels, within):
    """funnel, client -> (n by step, quartiles) by walking every attempt."""
    by: dict = {}
    for c, k, t in {e for e in events if None not in e}:
        by.setdefault(c, []).append((t, k))
    out = {}
    for f in funnels:
        for c, rows in by.items():
            took: list[list[int]] = [[] for _ in f.steps]
            for start, kind in rows:
                if kind != f.steps[0]:
                    continue
                took[0].append(0)
                prev = start
                for i, step in enumerate(f.steps[1:], 1):
                    then = min((t for t, k in rows if k == step and t > prev), default=None)
                    if then is None or then - start > within or any(k == f.excluded and prev < t <= then for t, k in rows):
                        break
                    took[i].append(then - prev)
                    prev = then
            if took[0]:
                out[f.name, c] = [len(x) for x in took] + [sorted(x)[math.ceil(25 * len(x) / 100) - 1] if x else None for x in took[1:]]
    return out


def funnel_table(spark, events, zone=True):
    base = datetime(2024, 1, 1)
    rows = [(c, k, None if t is None else base + timedelta(microseconds=t), "x", 1) for c, k, t in events]
    return spark.createDataFrame(rows, f"client_id long, kind string, arrived_at {'timestamp' if zone else 'timestamp_ntz'}, funnel string, same_depth int")


@pytest.mark.parametrize("chunk", [3, 50, funnel.CHUNK])
def test_funnels_equal_every_attempt_walked(spark, monkeypatch, chunk):
    rng = random.Random(chunk)
    kinds = ["view", "click", "purchase", "signup", "error", "other", None]
    events = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choices(kinds, [8, 6, 4, 2, 1, 1, 1])[0], rng.choice([rng.randrange(0, 2_000_000_000, 500_000), rng.randrange(2_000_000_000), None if rng.random() < 0.1 else 777])) for _ in range(700)]
    events += events[:100]
    within, bucket = 60_000_000, 100_000_000
    monkeypatch.setattr(funnel, "CHUNK", chunk)
    want = brute_funnels(events, queries.FUNNELS, within)
    for parts in (1, 7):
        got = funnel.ordered_funnels(funnel_table(spark, events).repartition(parts), queries.FUNNELS, within=within, bucket=bucket).collect()
        assert {(r["funnel"], r["client_id"]): [r[f"n{k}"] for k in range(1, 5)] + [r[f"t{k}"] for k in range(2, 5)] for r in got} == want
        depth = {(r["funnel"], r["client_id"]): r["deepest"] for r in got}
        assert all(depth[x] == max(k for k in range(1, 5) if want[x][k - 1]) for x in depth)
        assert all(r["same_depth"] == sum(f == r["funnel"] and d == r["deepest"] for (f, _), d in depth.items()) for r in got)


def test_funnel_edges_and_empty_tables(spark):
    f = [funnel.Funnel("F", ("a", "b", "c"), "x")]
    one = lambda events: [tuple(r)[2:9] for r in funnel.ordered_funnels(funnel_table(spark, events, zone=False), f, within=100, bucket=1000).collect()]
    assert one([(1, "a", 990), (1, "b", 1000), (1, "c", 1090)]) == [(1, 1, 1, 3, 10, 90, 1)]  # over a bucket's end, at the horizon
    assert one([(1, "a", 990), (1, "b", 1000), (1, "c", 1091)]) == [(1, 1, 0, 2, 10, None, 1)]
    assert one([(1, "a", 0), (1, "b", 0), (1, "b", 9), (1, "x", 9)]) == [(1, 0, 0, 1, None, None, 1)]  # excluded with the next step
    assert one([(1, "a", 5), (1, "x", 5), (1, "b", 9)]) == [(1, 1, 0, 2, 4, None, 1)]  # excluded with the previous step
    assert one([(1, "b", 5), (None, "a", 5), (1, None, 5), (1, "a", None)]) == []
    assert one([]) == []


def test_times_without_a_zone_stay_as_they_are(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:30 of 10 March is not there
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.000001' AS t")
        assert df.select(funnel.micros(df, "t")).first()[0] == 1_710_037_800_000_001
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_bucket_larger_than_a_chunk_is_followed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(funnel, "CHUNK", 500)
    events = [(7, ("view", "click")[i % 2], 1000 * i) for i in range(6000)]
    r = funnel.ordered_funnels(funnel_table(spark, events), queries.FUNNELS[:1], within=50_000).first()
    assert (r["n1"], r["n2"], r["n3"], r["n4"]) == (3000, 3000, 2999, 0) and (r["t2"], r["t3"]) == (1000, 1000)


# ------------------------------------------------------------------------------ ranked search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranking(texts, items, k):
    words = [(i, WORD.findall((t or "").translate(CASE))) for i, t in texts]
    words = [(i, w) for i, w in words if w]
    n_docs, total = len(words), sum(len(w) for _, w in words)
    out = []
    for item, text in items:
        terms = set(WORD.findall((text or "").translate(CASE)))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in words) + 1))) for t in terms}
        scores = []
        for i, w in words:
            m = 10 + 90 * len(w) * n_docs // total
            s = sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, tmp_path, texts, items, k=10):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, score string, rank int")
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in ranked.ranked_search(docs.repartition(3), asked, f"file://{tmp_path}/index", k).collect()), key=repr)


@pytest.mark.parametrize(("docs", "group", "cells"), [(4096, 1024, 1 << 20), (20, 2, 50), (7, 3, 1)])
def test_ranked_search_equals_brute_force(spark, tmp_path, monkeypatch, docs, group, cells):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", docs)
    monkeypatch.setattr(ranked, "GROUP_ITEMS", group)
    monkeypatch.setattr(ranked, "CELLS", cells)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "日本", "A1"]
    text = lambda n: " ,".join(rng.choice(vocabulary[: rng.choice([5, 20, 43])]) for _ in range(n))
    texts = [(i, text(rng.choice([1, 3, 30, 200]))) for i in range(150)] + [(500, None), (501, ""), (502, "--- !"), (None, text(20)), (3, text(9)), (600, "w1 " * 30_000)]
    texts += [(i, "same old w2 text") for i in range(700, 740)]  # ties beyond k
    items = [(0, text(6)), (1, text(30)), (1, "w1 w1 w2 nowhere"), (2, None), (3, "-"), (4, "nothing here"), (None, "same old")]
    assert found(spark, tmp_path, texts, items) == brute_ranking(texts, items, 10)


def test_ranked_search_of_empty_tables(spark, tmp_path):
    assert found(spark, tmp_path, [], [(0, "a b")]) == [] and found(spark, tmp_path, [(0, "a b"), (1, None)], []) == []


def rows_of_index(texts, docs, total):
    """The index of one block, as a worker writes it."""
    import pyarrow as pa

    doc, term, tf, n = ranked.postings(pa.array(texts))
    return ranked._block(0, list(range(len(texts))), [(doc, term, tf)], n, docs, total).to_pylist()[0]


@pytest.mark.parametrize("tiers", [(1,), (1, 2), (3, 5, 9)])
def test_a_block_proves_or_falls_through_tier_by_tier(monkeypatch, tiers):
    import pyarrow as pa

    monkeypatch.setattr(ranked, "TIERS", tiers)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.choice([1, 2]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    total = sum(len(t.split()) for t in texts)
    row = rows_of_index(texts, len(texts), total)
    items = [rng.sample(["a", "b", "cc", "dd", "e", "ff", "g", "hh"], rng.randrange(1, 6)) for _ in range(12)]
    group = ranked.Group([ranked.postings(pa.array([" ".join(x)]))[1] for x in items])
    group.weigh(len(texts), {int(t): sum(1 for x in texts if int(t) in set(ranked.postings(pa.array([x]))[1].view(np.int64).tolist())) for t in group.terms.view(np.int64)})
    want = brute_ranking(list(enumerate(texts)), [(i, " ".join(x)) for i, x in enumerate(items)], 5)
    proven_at: dict = {}
    for upto in range(len(tiers) + 1):
        theta = np.zeros(group.size, np.int64)
        seen = {k: v for k, v in row.items() if k in ranked._columns(upto)}  # no column below the tier is there
        for item, docs, scores, proven in ranked.BlockScorer(group, seen).rounds(0, group.size, upto, theta, 5):
            if proven:
                got = [(item, r, int(d), int(s)) for r, (s, d) in enumerate(sorted(zip(scores, docs, strict=True), key=lambda x: (-x[0], x[1]))[:5], 1)]
                assert got == sorted((w for w in want if w[0] == item), key=lambda w: w[1])
                proven_at.setdefault(item, upto)
    assert set(proven_at) == set(range(12))


# ------------------------------------------------------------------------------ neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def brute_neighbours(rows, k):
    fit = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    dim = max(len(v) for _, v in fit)
    fit = [(i, np.pad(v, (0, dim - len(v)))) for i, v in fit]
    out = {}
    for q in {i for i, _ in fit if i % 100 == 0}:
        x = min((v for i, v in fit if i == q), key=lambda v: v.tolist())
        out[q] = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in fit if i != q)[:k]
    return out


def test_neighbours_of_few_odd_rows_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(260)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 2.0]), (304, [math.nan] * 6), (305, [math.inf] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(400, [1.0, 2.0]), (400, [0.5, 2.0]), (401, [1.0, 2.0]), (401, [1.0, 2.0])] + [(i, [3.0] * 6) for i in range(600, 640)] + [(700, [3.0] * 6)]
    got: dict = {}
    for r in neighbours.neighbours(vectors(spark, rows).repartition(5), lambda i: i % 100 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = brute_neighbours(rows, 10)
    assert set(got) == set(want) and 300 not in got
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        np.testing.assert_allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-13, atol=1e-12)


def test_neighbours_fewer_than_k_none_and_huge_magnitudes(spark):
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])]
    assert [tuple(r) for r in neighbours.neighbours(vectors(spark, few), lambda i: i % 100 == 0).orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, math.sqrt(2))]
    assert neighbours.neighbours(vectors(spark, few[1:]), lambda i: i % 100 == 0).collect() == []
    assert neighbours.neighbours(vectors(spark, []), lambda i: i % 100 == 0).collect() == []
    q, r, d = neighbours.nearest(np.asarray([0]), np.asarray([[1e200, 0.0]]), np.asarray([np.inf]), np.asarray([1, 2]), np.asarray([[3e200, 0.0], [2e200, 0.0]]), 1)
    assert (q.tolist(), r.tolist()) == ([0], [1]) and math.isclose(d[0], 1e200)


def test_a_leaf_with_a_third_of_all_rows_is_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", (16, 32))
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 4)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1000)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(2000, 2500)]
    got = neighbours.neighbours(vectors(spark, rows), lambda i: i % 100 == 0).toPandas()
    want = brute_neighbours(rows, 10)
    assert len(got) == 10 * len(want)
    assert np.mean([len(set(got[got["query_id"] == q]["vec_id"]) & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    assert got[got["query_id"] == 2000].sort_values("rank")["vec_id"].tolist() == list(range(2001, 2011))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    want = brute_neighbours(list(zip(rows["vec_id"].tolist(), rows["embedding"].tolist(), strict=True)), 10)
    got = queries.op12_neighbours(spark, f"/root/testdata/{sf}").toPandas()
    assert np.mean([len(set(got[got["query_id"] == q]["vec_id"]) & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
