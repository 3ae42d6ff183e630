"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to " w1 w2 ... wn " (A-Z lower-cased; words are runs of digits,
letters and characters outside ASCII).  A window is ``window`` consecutive words of an
item, or the whole item if it is shorter.  One automaton holds all windows of all items;
every document is normalised and scanned once, and a match's place is carried back to
word numbers and to code points of the text as it was.

The automaton is broadcast.  Its items are measured first: beyond ``max_pattern_bytes``
they are dealt to several automata of that size at most, which scan one after the other,
so memory stays bounded whatever the benchmark's size.  Documents are never shuffled.

Null and empty texts have no words and no hits; items without words have no windows.
Repeated rows each get their result; items of the same id count once, a null item id is
written as an empty string.  Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _KEPT, small_batches, worker, written

WINDOW = 10
MAX_PATTERN_BYTES = 16 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_NORMAL = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else b + 32 if 0x41 <= b < 0x5B else 32 for b in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


def windows_of(items: list[tuple[str, bytes | None]], window: int) -> dict[bytes, set[str]]:
    """Window (words between spaces) -> the ids of its items."""
    out: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            out[b" " + b" ".join(words[i : i + window]) + b" "].add(item)
    return out


def automaton(windows: dict[bytes, set[str]]):
    """An automaton over the windows; a byte of UTF-8 stands as one character."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, items in windows.items():
        a.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(sorted(items))))
    if windows:
        a.make_automaton()
    return a


_BUILT: dict[str, object] = {}
_KEPT.append(_BUILT.clear)


def _automaton_of(windows, key: str):
    """A worker builds an automaton once and keeps the latest alone."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(windows.value)
    return _BUILT[key]


def _merged_spans(text: str, hits: np.ndarray) -> str:
    """Runs of hit words as start:end in code points of the text itself."""
    at = [m.span() for m in _WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    cuts = np.flatnonzero(np.diff(hits) > 1)
    first, last = hits[np.concatenate([[0], cuts + 1])], hits[np.concatenate([cuts, [len(hits) - 1]])]
    return ",".join(f"{at[a][0]}:{at[b][1]}" for a, b in zip(first, last, strict=True))


def scan(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """c_0, c_1, ... (the columns of ``docs`` to carry), and each text's n_words, hits, items, spans.

    ``docs``: text and the carried columns; ``benchmark``: item_id, text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    # a window is written up to `window` times the item's length
    size = items.agg((F.sum(F.octet_length("text")) * window).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // max_pattern_bytes))
    empty = [F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items")]
    now = docs.select(F.col("text").cast("string").alias("t"), *[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(carry) if c != "text"], *empty)
    for k in range(shards):
        part = items if shards == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        found = windows_of([(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in part.toLocalIterator()], window)
        now = _scan_one(now, spark.sparkContext.broadcast(found), 0)
        if k + 1 < shards:
            now = written(now, "contamination")
    return now.select(*[F.col("t" if c == "text" else f"c_{i}").alias(f"c_{i}") for i, c in enumerate(carry)], "n_words", "hits", "items", "spans")


def _scan_one(docs: DataFrame, windows, text_at: int) -> DataFrame:
    """Add one automaton's matches to n_words, hits (word numbers as int64) and items."""
    schema = docs.select(*[c for c in docs.columns if c != "spans"]).schema.add("spans", "string")
    key = uuid.uuid4().hex

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _automaton_of(windows, key)
        some = len(scanner) > 0
        for batch in batches:
            texts = batch.column(text_at)
            n_words, hits, items, spans = [], [], [], []
            for i, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
                words = normal_words(raw)
                n_words.append(len(words))
                names = set(batch.column("items")[i].as_py() or [])
                was = batch.column("hits")[i].as_py()
                marked = [np.frombuffer(was, "<i8")] if was else []
                if some and words:
                    normal = (b" " + b" ".join(words) + b" ").decode("latin-1")
                    ends = []
                    for end, (n, ids) in scanner.iter(normal):
                        ends.append((end, n))
                        names.update(ids)
                    if ends:
                        spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
                        mark = np.zeros(len(words) + 1, np.int32)
                        last = np.searchsorted(spaces, [e for e, _ in ends])
                        np.add.at(mark, last, -1)
                        np.add.at(mark, last - np.asarray([n for _, n in ends]), 1)
                        marked.append(np.flatnonzero(mark.cumsum() > 0))
                all_hits = np.unique(np.concatenate(marked)).astype("<i8") if marked else np.empty(0, "<i8")
                hits.append(all_hits.tobytes())
                items.append(sorted(names))
                spans.append(_merged_spans(texts[i].as_py(), all_hits) if len(all_hits) else "")
            new = {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, pa.binary()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, pa.string())}
            names = [f.name for f in schema]
            yield pa.RecordBatch.from_arrays([new.get(n) if n in new else batch.column(n) for n in names], names=names)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every row."""
    found = scan(docs, benchmark, ["doc_id"], window, max_pattern_bytes)
    names = F.array_sort(F.array_distinct("items"))
    return found.select(
        F.col("c_0").alias("doc_id"),
        "n_words",
        (F.octet_length("hits") / 8).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.octet_length("hits") > 0).alias("contaminated"),
        "spans",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """The documents without a hit word, with all their columns."""
    kept = scan(docs, benchmark, docs.columns, window, max_pattern_bytes).filter(F.octet_length("hits") == 0)
    return kept.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])
