from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from auditgrid.llm import line_dedup, ngram_join, topk
from auditgrid.llm.common import text_bytes, word_hashes
from auditgrid.llm.graph import components
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, n_lines string, key string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").lower())


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def test_word_hashes_across_segments(monkeypatch):
    from auditgrid.llm import common

    texts = ["", None, "ab cd ab", "é ab", "x" * 50 + " ab", "ab", "…"]
    raw, offsets = text_bytes(pa.array([t.lower() if t else t for t in texts]))
    whole = word_hashes(raw, offsets)
    monkeypatch.setattr(common, "SEGMENT", 7)
    small = word_hashes(raw, offsets)
    assert all((a == b).all() for a, b in zip(whole, small, strict=True))
    assert [raw[a:b].tobytes().decode() for a, b in zip(*whole[1:], strict=True)] == [w for t in texts for w in words(t)]
    assert len(set(whole[0].tolist())) == len({w for t in texts for w in words(t)})


def varied(seed, n_groups=12, size=5, length=60):
    """Texts in groups of near copies, some exact, and loners."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for g in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for c in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(length)] = rng.choice(vocabulary)
            out.append((" ".join(copy) if c % 2 else ", ".join(copy).upper()) + (" tail" if g % 3 else ""))
        out.append(" ".join(rng.choice(vocabulary) for _ in range(length)))
    rng.shuffle(out)
    return out


def brute_join(texts, ids, threshold=0.8):
    def runs(t):
        w = words(t)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [runs(t) for t in texts]
    n = len(sets)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(n)]
    group = list(range(n))
    for i in range(n):  # spread the least place until nothing moves
        group[i] = i
    moved = True
    while moved:
        moved = False
        for i in range(n):
            low = min([group[i], *(group[j] for j in links[i])])
            moved |= low != group[i]
            group[i] = low
    out = []
    for i in range(n):
        same = [ids[j] for j in range(n) if group[j] == group[i]]
        copies = [ids[j] for j in range(n) if sets[j] == sets[i]] if sets[i] else [ids[i]]
        out.append((ids[i], min(copies), min(same), len(links[i])))
    return sorted(out)


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    texts = [*varied(1), "", None, "one two", "ONE  two!", "three", "a b c d e", "a b c d e f g"]
    ids = list(range(100, 100 + len(texts)))
    want = brute_join(texts, ids)
    for block, parts in ((100, 1), (3, 5)):  # small blocks: groups are split over tasks
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0 if block == 3 else 1000)
        got = ngram_join.ngram_jaccard_join(table(spark, texts, ids).repartition(parts))
        assert sorted(map(tuple, got.collect())) == want


def test_one_of_each_keeps_all_columns_and_repeated_rows_once(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    docs = table(spark, [a, a + " tail", b, b, "", None, ""], [5, 3, None, None, 7, 8, 7])
    got = ngram_join.one_of_each(docs).toPandas()
    assert list(got.columns) == docs.columns
    assert sorted(got["doc_id"].fillna(-1).tolist()) == [-1, 3, 7, 7, 8]


def test_joins_of_nothing(spark):
    empty = table(spark, [])
    assert ngram_join.ngram_jaccard_join(empty).count() == 0
    assert ngram_join.one_of_each(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.deduplicated(empty).count() == 0
    assert ngram_join.ngram_jaccard_join(table(spark, [None, ""])).select("n_links").distinct().collect() == [(0,)]


def test_pruning_keeps_pairs_at_the_threshold():
    least = ngram_join.least_agreements()
    assert least == sorted(least) and least[0] < 0.8 * ngram_join.STEP
    rng = np.random.default_rng(0)
    agree = rng.binomial(1, 0.8, (100_000, ngram_join.STEP * ngram_join.STEPS)).cumsum(axis=1)
    lost = np.zeros(len(agree), bool)
    for k, need in enumerate(least):
        lost |= agree[:, (k + 1) * ngram_join.STEP - 1] < need
    assert lost.mean() < 1e-4


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 120), (120, 110), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (100, 110, 120)} == {100}


# ------------------------------------------------------------------------------- lines


def brute_lines(docs, threshold=0.8):
    lines = sorted((i is not None, i or 0, n, frozenset(words(x))) for i, t in docs if t is not None for n, x in enumerate(t.split("\n")))
    gone: dict = {}
    seen: list = []
    for some, i, n, s in lines:
        key = i if some else None
        if s and any(len(s & t) >= threshold * len(s | t) - 1e-12 for t in seen):
            gone.setdefault(key, []).append(n)
        if s:
            seen.append(s)
    return sorted(((i, len(t.split("\n")) if t is not None else 0, len(gone.get(i, [])) if t is not None else 0, ",".join(map(str, sorted(gone.get(i, [])))) if t is not None else "") for i, t in docs), key=repr)


def line_docs(seed):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 14))] for _ in range(40)]
    docs = []
    for i in range(60):
        body = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(pool))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            body.append((" ".join(line)).upper() if rng.random() < 0.3 else ", ".join(line))
        docs.append((i * 7 % 60, "\n".join(body) + ("\n" if rng.random() < 0.3 else "")))
    return [*docs, (1000, ""), (1001, None), (1002, "\n\n"), (None, "t1 t2 t3"), (1003, "Ünïc ödé\nünïc ÖDÉ")]


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    docs = line_docs(3)
    want = brute_lines(docs)
    for handed, batch, parts in ((4, 512, 1), (0, 3, 4)):  # few handed on: the second round finds the rest
        monkeypatch.setattr(line_dedup, "HANDED_ON", handed)
        monkeypatch.setattr(line_dedup, "small_batches", lambda s, n=batch: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n)))
        monkeypatch.setattr(line_dedup, "HELD_BYTES", 48 << 20 if handed == 4 else 200)  # all postings are passed on as hot
        monkeypatch.setattr(line_dedup, "BLOCK", 3)
        monkeypatch.setattr(line_dedup, "OPEN", 0)
        got = line_dedup.line_dedup(table(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(parts))
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_pair_lists_and_prefixes():
    lists, n = np.asarray([1, 3, 3, 3, 3, 7, 7]), np.asarray([5, 3, 8, 10, 11, 2, 2])
    pairs = [p for i, j in line_dedup._pairs(lists, n, line_dedup.Fraction(4, 5)) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(pairs) == [(2, 3), (3, 4), (5, 6)]
    assert line_dedup.prefix_sizes(np.asarray([1, 3, 4, 5, 10]), 0.8).tolist() == [0, 0, 1, 2, 3]


def test_tokens_that_differ_in_their_last_bits_are_told_apart():
    line, token = np.asarray([0, 0, 0, 1, 1]), np.asarray([5, 3, 5, 3, 5], np.uint64)
    got = line_dedup.ordered_tokens(line, np.zeros(5, np.uint8), token)
    assert [x.tolist() for x in got] == [[0, 0, 1, 1], [3, 5, 3, 5]]


def test_chosen_lines_are_whole_lines():
    texts = ["ab\n\ncd", "", "é\n", None, "x"]
    all_lines = [x for t in texts for x in (t or "").split("\n")]
    assert line_dedup.chosen_lines(pa.array(texts), lambda t, n: n >= 0).to_pylist() == all_lines
    assert line_dedup.chosen_lines(pa.array(texts), lambda t, n: (t == 0) & (n == 2) | (t == 2) & (n == 0)).to_pylist() == ["cd", "é"]
    assert line_dedup.chosen_lines(pa.array(texts), lambda t, n: n < 0).to_pylist() == []


def test_a_token_in_every_line_is_dealt_to_blocks(spark, monkeypatch):
    # five words a line, of which any two lines share four at most: all lists are hot
    rng = random.Random(8)
    common = ["all", "of", "them", "here"]
    docs = [(i, "\n".join(" ".join([*rng.sample(common, 4), *[f"x{rng.randrange(40)}" for _ in range(rng.randrange(1, 3))]]) for _ in range(6))) for i in range(40)]
    monkeypatch.setattr(line_dedup, "HELD_BYTES", 300)
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    monkeypatch.setattr(line_dedup, "GROUPS", 3)
    monkeypatch.setattr(line_dedup, "HANDED_ON", 2)
    got = line_dedup.line_dedup(table(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(docs)


@pytest.mark.parametrize("most", [0, 2048])
def test_second_round_is_needed_and_taken(spark, monkeypatch, most):
    # the first candidates of the last line share its prefix and pass the filters but fail on whole sets
    monkeypatch.setattr(line_dedup, "HANDED_ON", 0)
    monkeypatch.setattr(line_dedup, "OPEN", most)
    texts = ["a b c d e f g h i j", "a b c d e f g h i j"[::-1], "a b c d e f g h i k"]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_deduplicated_rewrites_texts_and_keeps_columns(spark):
    docs = table(spark, ["first line here\nshared words of all\n", "shared words of all\nown line", "shared words of all", "", None, "first line here"], [1, 2, 3, 4, 5, 1])
    got = line_dedup.deduplicated(docs).toPandas().sort_values("doc_id")
    assert list(got.columns) == docs.columns
    # rows of one id are told apart by their texts: the shorter one's line equals its own first place
    assert {(r.doc_id, r.text) for r in got.itertuples()} >= {(1, "first line here\nshared words of all\n"), (2, "own line"), (4, ""), (5, None)}
    assert 3 not in set(got["doc_id"])


def test_lines_are_cut_in_time_linear_in_them(spark):
    cases = [("a\nb\nc", [1]), ("a\nb\nc", [0, 1, 2]), ("a\nb\nc", [0, 2]), ("a\n\n", [2]), ("", [0]), ("a", []), (None, [0]), ("é\n\nx\n", [1, 3])]
    long = "\n".join(str(i) for i in range(1_000_000)), [i for i in range(1_000_000) if i % 3]
    rows = spark.createDataFrame([*cases, long], "text string, removed array<int>")
    want = [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(r)) for t, r in cases]
    want.append("\n".join(str(i) for i in range(0, 1_000_000, 3)))
    began = time.monotonic()
    got = [r["kept"] for r in rows.select(line_dedup.without_lines(F.col("text"), F.col("removed")).alias("kept")).collect()]
    assert got == want and time.monotonic() - began < 60  # a search of all numbers for each line takes hours


# ------------------------------------------------------------------------------- top k


@pytest.mark.parametrize(("scale", "block", "bins"), [(1.0, 4096, 256), (1.0, 3, 2), (1e6, 4096, 16), (1e8, 4096, 256)])
def test_top_k_equals_brute_force(spark, scale, block, bins):
    rng = np.random.default_rng(4)
    vecs = (rng.integers(-3, 4, (60, 5)) / 64 * scale).tolist()
    vecs[7] = vecs[9] = vecs[11] = vecs[13]
    bad = [None, [1.0, None], [float("nan")], [float("inf"), 1.0], [0.5], []]
    data = [(i, v) for i, v in enumerate([*vecs, *bad])]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4), lambda i: i % 5 == 0, k=4, block=block, bins=bins)
    q = {i: [int(np.floor(x * 64)) for x in v] for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for i in q:
        if i % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=False)), j) for j in q if j != i)
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:4], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("bins", [2, 256])
def test_top_k_ranks_scores_up_to_64_bits(spark, bins):
    most = 2**63 - 1
    q = {0: [2**31, 0], 5: [-(2**31), 0], **{i: [2**31 + (i - 10) * 2**27, 7] for i in range(10, 26)}, 30: [2**33, 1], 31: [2**34, 0], 32: [-(2**33), 0]}
    rows = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in q.items()], "vec_id long, embedding array<double>").repartition(3)
    for k in (1, 9, 30):
        got = topk.top_k(rows, lambda i: i.isin(0, 5, 12), k=k, bins=bins)
        want = []
        for i in (0, 5, 12):
            scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(q[i], q[j], strict=True)))), j) for j in q if j != i)
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_of_few_or_no_rows(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(rows, lambda i: i >= 0).collect())) == [(0, 1, 1, 64 * 128), (1, 1, 0, 64 * 128)]
    assert topk.top_k(rows.limit(0), lambda i: i >= 0).count() == 0
    assert topk.top_k(rows, lambda i: i > 5).count() == 0
    assert topk.top_k(rows.filter(F.col("vec_id") == 0), lambda i: i >= 0).count() == 0


def test_lines_and_first_places_are_those_of_plain_searches():
    import numpy as np
    from auditgrid.llm import line_dedup

    rng = np.random.default_rng(7)
    for n in (0, 1, 400):
        places, edges = np.sort(rng.integers(0, 90, n)), np.sort(rng.integers(0, 90, 12))
        assert (line_dedup.reached(edges, places) == np.searchsorted(edges, places, "right")).all()
        p = np.zeros(n, line_dedup.POSTING)
        for name, high in (("tok", 9), ("key", 11), ("doc", 4), ("line", 3)):
            p[name] = rng.integers(0, high, n)
        p["n"] = p["key"] % 5 + 1
        want = {}
        for r in sorted(p.tolist(), key=lambda r: (r[0], r[1], r[5], r[4], r[3])):
            want.setdefault((r[0], r[5]), r)
        many = {t for t in p["tok"].tolist() if (p["tok"] == t).sum() > 1}
        assert line_dedup.first_places(p).tolist() == [r for (t, _), r in want.items() if t in many]


def test_only_classes_with_copies_or_near_lines_are_joined_to_lines(spark, monkeypatch):
    from auditgrid.llm import line_dedup

    kept, plain = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda rows, tag: kept.append(plain(rows, tag)) or kept[-1] if tag == "kept" else plain(rows, tag))
    docs = spark.createDataFrame([(1, "one two three\nalone here\nx y"), (2, "three two one\nonly this"), (3, "x y"), (3, "x y")], "doc_id long, text string")
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: "", 2: "0", 3: "0"} and kept[0].count() == 2


def test_hot_postings_are_passed_on_in_few_rows():
    p = np.zeros(6400, line_dedup.POSTING)
    p["tok"], p["key"] = np.arange(6400) % 640, np.arange(6400)
    held = [(part, p[k : k + 64]) for k in range(0, 6400, 64) for part in (3, 5)]
    rows = list(line_dedup._passed_on(held))
    assert not held and sum(b.num_rows for b in rows) <= 2 * line_dedup.GROUPS
    got = {}
    for b in rows:
        for grp, raw in zip(b.column("grp").to_pylist(), b.column("packed").to_pylist(), strict=True):
            got.setdefault(grp // line_dedup.GROUPS, []).append(np.frombuffer(raw, line_dedup.POSTING))
    assert {part: np.sort(np.concatenate(x)["key"]).tolist() for part, x in got.items()} == {3: list(range(6400)), 5: list(range(6400))}
