from __future__ import annotations

import random

import corpus_pipeline as p
import pytest
from auditgrid.llm import langid
from auditgrid.llm.common import written
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def run(spark, docs, bench, tmp_path):
    bench.write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    out = []
    for name, stage in p.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)), name)
        out.append((name, docs))
        assert name == "packing" or docs.columns == columns
    return dict(out)


def test_stages_decide_and_keep_columns(spark, tmp_path):
    clean = {i: " ".join(f"word{(i * 31 + k * k) % 977}x{chr(97 + k % 26)}" for k in range(80)) for i in range(1, 9)}
    leak = " ".join(f"bench{k}" for k in range(20))
    texts = {**clean, 20: clean[1], 21: clean[2] + " tail", 30: "intro " + leak, 40: "123 456", 41: None, 42: "", 50: clean[3] + "\nown line of words\nmore lines that are new here"}
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, n_lines long, lang_pred string, hits string, removed string"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "k", 1, "l", "h", "r") for i, t in texts.items()], schema)
    got = run(spark, docs, spark.createDataFrame([(1, leak)], "item_id long, text string"), tmp_path)
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in got.items()}
    assert ids["language_id"] == set(texts) - {40, 41, 42}
    assert ids["line_dedup"] == ids["language_id"] - {20, 21}
    assert ids["near_duplicates"] == ids["line_dedup"]
    assert ids["decontamination"] == ids["near_duplicates"] - {30} and set(clean) <= ids["decontamination"]
    assert ids["packing"] == ids["decontamination"]
    assert {r["doc_id"]: r["text"] for r in got["line_dedup"].collect()}[50] == "own line of words\nmore lines that are new here"


def test_language_stage_rejects_letters_in_no_learnt_language(spark):
    rng = random.Random(5)

    def words(stems, n):
        return " ".join(rng.choice(stems) + rng.choice(["", rng.choice(stems)]) for _ in range(n))

    stems = {"en": "the and ing ther ould with that house thing ness ly over".split(), "fr": "le la ment eau oix dans cette maison quel tion aux être".split(), "de": "der die und schaft heit über ein keit ung haus nicht ich".split()}
    clean = [(words(s, n), x) for x, s in stems.items() for n in [3, 8, 20, 60, 200] * 12]
    foreign = [words(list(a), n) for a in ("αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшщ", "bcfgjkpqvwxz") for n in (60, 200, 900)]
    foreign += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n)) for n in (40, 200, 900)]
    foreign += ["все люди рождаются свободными и равными в своем достоинстве и правах", "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw"]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(clean)] + [(1000 + i, t, None) for i, t in enumerate(foreign)], "doc_id long, text string, lang string")
    for parts in (1, 7):
        assert {r["doc_id"] for r in p.language_id(spark, docs.repartition(parts), "").collect()} == set(range(len(clean)))


def test_near_duplicates_leave_one_of_each(spark, tmp_path):
    base = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(3, base), (1, base + " a"), (2, "b " + base), (9, base + " a"), (4, "something else altogether in five words and more")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in p.near_duplicates(spark, docs, "").collect()) == [1, 4]


@pytest.mark.parametrize("name", ["empty"])
def test_pipeline_of_no_documents(spark, tmp_path, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    got = run(spark, docs, spark.createDataFrame([], "item_id long, text string"), tmp_path)
    assert all(d.count() == 0 for d in got.values())


def test_run_gives_each_kept_token_once(spark):
    got = p.run(spark, SF).toPandas()
    for _, g in got.sort_values("start").groupby("doc_id"):
        assert g["start"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() == g["doc_tokens"].iloc[0]
    assert 100 < got["doc_id"].nunique() <= 200


def test_languages_and_bounds_are_learnt_from_all_rows(spark):
    # more rows than a sample of 60 000 would hold: a language of two rows is learnt and gets bounds
    many = spark.range(62_000).selectExpr("id AS doc_id", "concat('the word ', char(97 + id % 26), char(97 + id div 26 % 26), char(97 + id div 676 % 26)) AS text", "'en' AS lang")
    few = spark.range(40).selectExpr("100000 + id AS doc_id", "concat('qxz', char(97 + id div 2), 'vkj', char(97 + id % 2)) AS text", "concat('rare', id div 2) AS lang")
    names, _, bounds = langid.learnt(many.unionByName(few), F.lit(True))
    assert len(names) == 21 and (bounds.short < float("inf")).sum() == (bounds.least > -float("inf")).sum() >= 1


def test_workers_drop_what_other_stages_kept():
    from auditgrid.llm import common, contamination, tokens

    common.begun("one")
    contamination._BUILT["key"] = object()
    mine = tokens.encoder(p.tokenizer_path("byte_bpe_50k.json"), True, 3)
    common._POWERS.get(10)
    common.begun("one")
    assert contamination._BUILT and tokens.encoder(p.tokenizer_path("byte_bpe_50k.json"), True, 3) is mine
    common.begun("two")
    assert not contamination._BUILT and not tokens._OPEN and len(common._POWERS.up) == 1


def test_a_small_token_cache_changes_no_ids():
    from auditgrid.llm.tokens import ChunkEncoder

    path = p.tokenizer_path("byte_bpe_50k.json")
    small, usual = ChunkEncoder(path, True, 3), ChunkEncoder(path, True)
    for text in ["one two three four, five", "one two  six\n seven", "é four, five 12 one"]:
        assert (small.ids(text) == usual.ids(text)).all()
        assert len(small) <= 3 and len(small.older) <= 3


def test_packing_in_the_pipeline_holds_a_smaller_cache(monkeypatch):
    from auditgrid.llm import packing, tokens

    got = {}
    monkeypatch.setattr(packing, "pack", lambda docs, path, **more: got.update(more))
    p.pack(None, None, "")
    assert got["cache_entries"] < tokens.CACHE_ENTRIES
