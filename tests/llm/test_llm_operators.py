from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from auditgrid.llm import contamination, langid, packing, secrets, token_files, toxicity, warc
from auditgrid.llm.queries import tokenizer_path
from auditgrid.llm.tokens import ChunkEncoder
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, n_words string, score string"
ODD = ["a  b", "  x", " \n y \n\n z  ", "a\x1cb,\x1c c", "\t\ta", "a  b", "<|endoftext|> x<|endoftext|>", "ΑΣ Σ", "é ́a", "it's 'll  's", "", "\n", "a \n b", "123 4,5", "a’b ªº ªa. µm, İx ÀÉ. é́ ǅa ß", "a'. a,' don't' .' x.'s", "日本 語, ok", "x" * 300 + " y", "🙂🙂 a🙂"]


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


# ------------------------------------------------------------------------------ tokens


@pytest.mark.parametrize(("file", "keep"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_same_ids(file, keep, monkeypatch):
    from auditgrid.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    e = ChunkEncoder(tokenizer_path(file), keep)
    for text, want in zip(ODD * 2, e.tok.encode_batch(ODD * 2, add_special_tokens=False), strict=True):
        assert e.ids(text).tolist() == want.ids, repr(text)
    assert len(e.ids(None)) == 0


def test_best_fill_finds_the_closest_sum():
    assert packing.best_fill([(7, 1), (5, 2), (3, 1)], 13) == {5: 2, 3: 1}
    assert packing.best_fill([(9, 4)], 8) == {}
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = sorted(rng.integers(1, 30, 8).tolist(), reverse=True)
        best = max(s for s in (sum(x for k, x in enumerate(sizes) if m >> k & 1) for m in range(256)) if s <= 50)
        used = packing.best_fill([(x, sizes.count(x)) for x in dict.fromkeys(sizes)], 50)
        assert sum(x * n for x, n in used.items()) == best and all(n <= sizes.count(x) for x, n in used.items())


def test_packing_of_odd_documents_and_small_buffers(spark):
    texts = [*ODD, None, "word " * 3000, "word " * 3000]
    for waiting in (10, packing.WAITING_TOKENS):
        got = packing.pack(table(spark, texts), tokenizer_path("byte_bpe_50k.json"), capacity=64, waiting_tokens=waiting).toPandas()
        for _, g in got.sort_values("start").groupby("doc_id"):
            assert g["length"].sum() == g["doc_tokens"].iloc[0] and g["start"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g["length"].sum() <= 64 and g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
        assert set(got["doc_id"]) == set(range(len(texts)))
    assert packing.pack(table(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_token_files_are_ordered_indexed_and_selective(spark, tmp_path):
    texts, ids = [f"text {i} of many words " * (i % 7) for i in range(400)], list(range(400, 0, -1))
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(table(spark, [*texts, None, None], [*ids, None, 3]), path, tokenizer_path("word_bpe_49k.json"), partitions=3, row_group_bytes=1 << 20, page_bytes=1024)
    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    seen = [i for f in files for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert seen == sorted([*ids, 3, None], key=lambda x: (x is not None, x or 0)) and len(files) == 3
    group = pq.ParquetFile(files[-1]).metadata.row_group(0)
    cols = [group.column(i) for i in range(group.num_columns)]
    assert all(c.has_column_index and c.has_offset_index for c in cols)
    assert "DELTA_BINARY_PACKED" in cols[0].encodings and any("DICTIONARY" in e for e in cols[2].encodings)
    some = token_files.read_token_files(spark, path, ["doc_id", "n_tokens"], 10, 12)
    assert sorted(r["doc_id"] for r in some.collect()) == [10, 11, 12]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "GreaterThanOrEqual(doc_id,10)" in plan
    starts = token_files.token_starts(spark, path).toPandas().sort_values(["file", "row"])
    sizes = token_files.token_digests(spark, path).toPandas().sort_values(["file", "row"])["n_tokens"]
    assert starts["start"].tolist() == (sizes.cumsum() - sizes).tolist()
    token_files.write_token_files(table(spark, []), f"{path}-none", tokenizer_path("word_bpe_49k.json"))
    assert spark.read.parquet(f"{path}-none").count() == 0


# -------------------------------------------------------------------------------- warc


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_bundles_round_trip(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    monkeypatch.setattr(warc.with_revisits, "__defaults__", (warc.REVISIT_BYTES, broadcast))
    big = "<p>é\r\n\r\nx</p>" * 200
    pages = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (5, "http://a/é", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (5, "u", big), (8, "u", "z" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    warc.write_bundles(df, path, frame_bytes=4000, bundle_bytes=2000)
    got = warc.read_bundles(spark, path).toPandas()
    assert len(got) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        mine = got[got["page_id"].isna() if i is None else got["page_id"] == i]
        for r in mine.itertuples():
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
            revisit = i in (1, 2)
            assert r.record_type == ("revisit" if revisit else "response") and (r.refers_to == 5 if revisit else r.refers_to != r.refers_to)
            assert r.payload is None if revisit else bytes(r.payload) == raw
    assert warc.read_bundles(spark, path, F.col("page_id") == 3).count() == 1


def test_reads_leave_by_bytes_and_bundles_close_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 5000)
    monkeypatch.setattr(warc, "BUNDLE_ROWS", 7)
    pages = [(i, "u", f"{i}" * 900) for i in range(100, 140)] + [(1, "u", "x" * 3_000_000), (2, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write_bundles(df, path)
    assert spark.read.parquet(f"{path}/index").groupBy("bundle").count().agg(F.max("count")).first()[0] == 7
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_bundles(spark, path).collect()}
    assert got == {i: html or "" for i, _, html in pages}
    bare = warc.read_bundles(spark, path, payload=False)
    assert "payload" not in bare.columns and {(r["page_id"], r["payload_bytes"]) for r in bare.collect()} == {(i, len(html or "")) for i, _, html in pages}


def test_seek_table_finds_frames_and_frames_stand_alone(spark, tmp_path):
    import pyarrow.fs as pafs
    import zstandard

    fs = pafs.LocalFileSystem()
    b = warc.Bundle(fs, str(tmp_path), "x.warc.zst", 300)
    records = [warc.record_bytes(i, "u", b"p" * 40 * i, "d", None) for i in range(8)]
    for i, r in enumerate(records):
        b.add(i, r)
    index = b.close().to_pylist()
    frames = warc.read_seek_table(fs, f"{tmp_path}/x.warc.zst")
    whole = (tmp_path / "x.warc.zst").read_bytes()
    assert len(frames) > 2
    for row, record in zip(index, records, strict=True):
        at, packed, plain = frames[row["frame"]]
        text = zstandard.ZstdDecompressor().decompress(whole[at : at + packed], max_output_size=plain)
        assert text[row["offset"] : row["offset"] + row["length"]] == record
        assert warc.parse_record(record)["payload"] == b"p" * 40 * row["page_id"]


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_bundles(spark, path).count() == 0


# ----------------------------------------------------------------------- contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def py_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_contamination(texts, items, window=10):
    grams = {}
    for item, text in items:
        w = py_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + window]), set()).add(str(item) if item is not None else "")
    out = []
    for i, t in enumerate(texts):
        w, hit, names = py_words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    names |= found
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [1 << 24, 200])
def test_contamination_equals_brute_force(spark, limit):
    passage = " ".join(f"q{i}" for i in range(30))
    items = [(1, passage), (2, "Short ÄNSWER"), (3, None), (4, "..."), (5, passage), (None, "nul item"), (10, " ".join(f"q{i}" for i in range(12, 25)))]
    texts = ["clean text here", "pre, " + passage.upper().replace(" ", " - ") + "! post", " ".join(passage.split()[:10]), " ".join(passage.split()[:9]), "a short äNSWER", "a short Änswer b", "", None, "é" + passage, "nul item " * 3, passage + " " + passage]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contamination(table(spark, texts), bench, max_pattern_bytes=limit).toPandas().sort_values("doc_id")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert [tuple(r) for r in got[cols].itertuples(index=False)] == brute_contamination(texts, items)
    for r in got.itertuples():
        cut = [texts[r.doc_id][int(s.split(":")[0]) : int(s.split(":")[1])] for s in r.spans.split(",") if s]
        assert sum(len(py_words(x)) for x in cut) == r.n_hit
    kept = contamination.decontaminated(table(spark, texts), bench, max_pattern_bytes=limit).toPandas()
    assert sorted(kept["doc_id"]) == [r[0] for r in brute_contamination(texts, items) if not r[5]] and list(kept.columns) == ["doc_id", "text", "n_words", "score"]
    assert contamination.contamination(table(spark, texts), bench.limit(0)).filter("contaminated").count() == 0
    assert contamination.contamination(table(spark, []), bench).count() == 0


# ----------------------------------------------------------------------------- secrets

SECRETS = ["password = hunter2hunter2", "PASSWD:'abc' token=token=abcdefgh secret : \"x/y+z=.-_\"", "api_key=123456 apikey:12345 API_KEY = abcdef", "AKIA" + "A1" * 8 + " AKIAAKIA" + "Z" * 11, "é🙂 token: abcdef " + "0f" * 12 + " " + "a" * 23, "f" * 30 + "deadbeef" * 4, "", None, "token: token: abcdef", "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY-----", "secret=" + "ab" * 20, "token=abcdef token=abcdef " * 3, "ſecret=abcdefg", "eyJhbGci.eyJzdWIi.c2ln xoxb-1234567890-abc AIza" + "x" * 35]


def brute_spans(text):
    flags = re.IGNORECASE | re.ASCII
    out = []
    for k, r in enumerate((*secrets.BASE, *secrets.MORE)):
        p = re.compile(r.pattern.replace("(?i)", ""), flags if "(?i)" in r.pattern else 0)
        out += [(m.start(), k, m.end()) for m in p.finditer(text or "") if len(m.group(r.group)) >= r.least]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_secrets_equal_brute_force(spark, broadcast):
    kinds = [r.kind for r in (*secrets.BASE, *secrets.MORE)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(table(spark, SECRETS + SECRETS[:1]), broadcast_candidates=broadcast).collect()}
    for i, text in enumerate(SECRETS + SECRETS[:1]):
        spans = brute_spans(text)
        write = lambda s: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in s)
        assert got[i]["spans"] == write(spans), text
        assert got[i]["base_sha256"] == hashlib.sha256(write([s for s in spans if s[1] < 3]).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds[:3]] == [sum(s[1] == n for s in spans) for n in range(3)]
    assert secrets.scan_secrets(table(spark, [])).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == secrets.ANY
    assert secrets.trigram_query("abcd|xyz") == {frozenset(["abc", "bcd"]), frozenset(["xyz"])}
    assert secrets.trigram_query("(ab?c)def.*ghi") == {frozenset(["abc", "bcd", "cde", "def", "ghi"]), frozenset(["acd", "cde", "def", "ghi"])}
    assert secrets.trigram_query("(?:abc)+") == {frozenset(["abc"])}
    assert secrets.trigram_query("(?:abc)*x") == secrets.ANY


def test_secret_scan_has_no_python(spark):
    plan = secrets.scan_secrets(table(spark, SECRETS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------------- language, toxicity


def test_language_of_odd_texts(spark):
    en, fr = "the cat and the dog with that thing of the house " * 5, "le chat et le chien avec cette chose de la maison " * 5
    docs = spark.createDataFrame([(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(40)] + [(100, None, "en"), (101, "", "en"), (102, "123 !?", "fr"), (103, en, None), (None, fr, "fr"), (104, "ΑΒΓ", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0.0
    assert got[103]["lang_pred"] == "en" and got[None]["lang_pred"] == "fr" and got[None]["held_out"] is False
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(40))
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
    again = {r["doc_id"]: r["score"] for r in langid.identify(docs.repartition(7)).collect()}
    assert all(again[i] == pytest.approx(got[i]["score"], abs=1e-6) for i in range(40))


def plain_vector(text, dim):
    """The sum of a text's n-gram vectors, letter by letter."""
    letters = [""]
    for c in (text or ""):
        low = c.lower()[0] if c.isalpha() else ""
        if low or letters[-1]:
            letters.append(low)
    letters += [""] if letters[-1] else []
    vector = {x: 1 - 2 * np.unpackbits(langid.letter_bits(np.asarray([ord(x) if x else 0]), dim).view(np.uint8), bitorder="little").astype(int) for x in set(letters)}
    grams = [letters[i : i + 3] for i in range(len(letters) - 2)]
    return sum((np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c] for a, b, c in grams), np.zeros(dim, int)), len(grams)


TEXTS = ["Ab  c, déf!ghij k" * 20, "ДОБРЫЙ день — καλημέρα", "漢字の文 한국어", "a", "12 !", "", None, "x" * 30, "İstanbul I\nß"]


@pytest.mark.parametrize("sizes", [(1 << 18, 2048, 1 << 22, 1 << 21), (3, 2, 8, 1)])
def test_text_vectors_equal_a_plain_loop(monkeypatch, sizes):
    for name, size in zip(("_PIECE", "_GRAMS", "_COUNTS", "_DIRECT"), sizes, strict=True):
        monkeypatch.setattr(langid, name, size)
    sums, n = langid.text_sums(TEXTS, 256)
    for i, text in enumerate(TEXTS):
        want, grams = plain_vector(text, 256)
        assert n[i] == grams and sums[i].tolist() == want.tolist()


def test_languages_equal_a_plain_loop(spark):
    rng = random.Random(2)
    stems = {"aa": "kala mira tosu veni".split(), "bb": "штор мена пуда горы".split(), "cc": "grund stein haus feld".split()}
    rows = [(i, " ".join(rng.choice(stems[x]) for _ in range(rng.randrange(1, 9))), x) for i, x in enumerate(rng.choice(list(stems)) for _ in range(60))]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    unit = {i: (v := plain_vector(t, langid.DIM)[0]) / np.linalg.norm(v) for i, t, _ in rows}
    sums = [sum(unit[i] for i, _, x in rows if x == lang and zlib.crc32(str(i).encode()) % 4 != 2) for lang in stems]
    protos = np.asarray([s / np.linalg.norm(s) for s in sums])
    mid = protos.mean(axis=0)
    for i, _, _ in rows:
        cosines = [(unit[i] - mid) @ (p - mid) / np.linalg.norm(unit[i] - mid) / np.linalg.norm(p - mid) for p in protos]
        assert got[i]["lang_pred"] == list(stems)[int(np.argmax(cosines))] and got[i]["score"] == pytest.approx((1 + max(cosines)) / 2, abs=1e-5)


def test_letters_of_one_script_have_unlike_vectors():
    points = np.asarray([ord(c) for c in "абвгдежзийклмнопрстуфхцчшщъыьэюяαβγδεζηθικλμνξοπρσςτυφχψω漢字"])
    bits = np.unpackbits(langid.letter_bits(points).view(np.uint8), axis=1).astype(int)
    same = (bits[:, None, :] == bits[None, :, :]).mean(axis=2)[~np.eye(len(points), dtype=bool)]
    assert np.abs(same - 0.5).max() < 0.07


def arcs_of(matcher, text):
    return {toxicity.ARCS[i]: int(n) for i, n in enumerate(matcher.paths(text).sum(axis=0)) if n}


def test_grammar_reads_clauses():
    m = toxicity.Matcher({"=idiot": 3.0, "^moro": 5.0})
    assert arcs_of(m, "a nice day") == arcs_of(m, None) == arcs_of(m, "") == arcs_of(m, "oxymoron idiotic") == {}
    assert arcs_of(m, "you, idiot") == arcs_of(m, "idiot, you") == {"0": 1, "target": 1} and arcs_of(m, "what an idiot") == {"0": 1}
    assert arcs_of(m, "he is not an idiot") == {"0n": 1, "target-n": 1} and arcs_of(m, "not him. an idiot") == {"0": 1}
    assert arcs_of(m, "claims said idiot things") == {"0r": 1} and arcs_of(m, "so it said. idiot") == {"0": 1}
    assert arcs_of(m, 'it is "idiot" here') == {"0r": 1}
    assert arcs_of(m, "i will kill you") == arcs_of(m, "ich werde dich töten") == {"X": 1} and arcs_of(m, "i will kill time") == {}
    assert arcs_of(m, "the morons came") == {"2": 1}


def test_composed_machine_equals_its_parts_one_after_the_other():
    rng = random.Random(1)
    table = toxicity.grammar()
    for _ in range(3000):
        clause = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(1, 14))]
        tape, arcs = list(clause), []
        for machine in toxicity.MACHINES:
            state, out = 0, []
            for x in tape:
                state, y, some = machine.step(state, x)
                out.append(y)
                arcs += some
            tape = out
        state, got = 0, []
        for x in clause:
            state, some = table[state, x]
            got += [toxicity.ARCS[i] for i in some]
        assert sorted(got) == sorted(arcs)


def test_negation_report_and_target_change_the_score(spark):
    texts = ["what an idiot", "you idiot", "never an idiot", "it said idiot", "i will kill you", "i will kill time", "a b c d"]
    for model in (toxicity.Model({"=idiot": 3.0}), toxicity.learn(*graded(spark), F.lit(True))):
        rows = toxicity.score(table(spark, texts), model, ["doc_id"]).collect()
        plain, target, negated, reported, threat, harm, none = (r["score"] for r in sorted(rows, key=lambda r: r["doc_id"]))
        assert target > plain > reported > negated and threat > harm and plain > none and abs(negated - none) < 0.02


def graded(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta theta iota kappa".split()
    fill = lambda: " ".join(rng.choice(words) for _ in range(6))
    texts = [f"{fill()}. {rng.choice(['you', 'what an'])} {'idiot' if i % 2 else 'alpha'} {fill()}" for i in range(200)]
    return table(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")


def test_toxicity_learns_words_and_beginnings(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = np.random.default_rng(0)
    text = lambda i: " ".join(rng.choice(words, 12)) + f" n{i}."
    toxic = [text(i) + f" you blorg{'xyz'[i % 3]}{i} there" for i in range(120)]
    clean = [text(i) for i in range(200, 500)]
    docs = table(spark, [*toxic, *clean, None, ""])
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(420)] + [(420, 1), (None, 1), (421, None), (5, 1)], "doc_id long, toxic int")
    got = toxicity.rate(docs, labels).toPandas()
    assert len(got) == 422 and (got[got["doc_id"] < 120]["predicted"] == 1).all() and (got[got["doc_id"] >= 120]["predicted"] == 0).all()
    assert toxicity.rate(docs, labels.limit(0)).count() == 422
    assert toxicity.rate(docs.limit(0), labels).count() == 0
