"""Language identification with hyperdimensional profiles.

Every letter of every script has its own random vector of +1 and -1, drawn from its code
point.  An n-gram is the elementwise product (binding) of its letters' vectors, each rotated
by its place; a text is the sum (bundle) of the vectors of its n-grams; a language's
prototype is the sum of its training texts' unit vectors.  A text gets the language whose
prototype has the largest cosine with the text's vector, both taken from the mean of all
prototypes.  Vectors are held as bits (1 for -1), so that binding is an exclusive or.

Text is lower-cased; each run of characters that are no letters counts as one boundary
symbol.  The whole text is used, in pieces of bounded size, as counts add up; sums are
whole numbers, so they depend neither on the pieces nor on the batches.

Training: rows whose language is not null and for which ``train`` holds, with a text that
has a letter.  ``learnt`` uses all of them, ``identify`` about ``train_rows`` at most: where
there are more, rows are chosen by a hash of the text.  Tasks send one partial sum for each language; Spark
adds them up, so nothing larger than (languages x dimensions) reaches the driver.

Null texts and texts without a letter are ``und`` with score 0.  Without training rows
every text is.  Ties go to the language that comes first by name.  Repeated rows each get
their result.  An empty table gives no rows.  Columns that are not asked for are ignored,
whatever their names; ``accepted`` passes all columns through, whatever their names.

The score compares languages with each other and says nothing about a text that is in none
of them: centred prototypes sum to zero, so the best is never below 0.5 where two or more
are learnt.  ``accepted`` therefore looks at the cosine with the uncentred prototype of the
text's language, against bounds that each language's training rows set (``Bounds``).  Texts
of a few distinct n-grams (a word or two, or one word over and over) cannot be told from
chance in ``DIM`` dimensions and stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, small_batches, worker, written

DIM = 2048
GRAM = 3
TRAIN_ROWS = 60_000
MAX_LANGUAGES = 4096
_SEED = 20240229
_PIECE = 1 << 17  # characters of a text that are counted at once
_GRAMS = 1024  # n-grams whose vectors are held at once
_COUNTS = 1 << 20  # counts (texts x n-grams) that are held at once
_DIRECT = 1 << 19  # n-gram codes that are found by a table; more are sorted
_BINS = 4096  # of a cosine's unit, in which training rows are counted
_TAIL = 0.001  # share of a language's training rows that its bounds may leave out


def letter_bits(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The random vector of each code point (0: the boundary) as ``dim`` bits, 1 for -1."""
    words = np.arange(dim // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return mixed(mixed(points.astype(np.uint64) + np.uint64(_SEED))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))


def rotated(bits: np.ndarray, by: int) -> np.ndarray:
    """Vectors rotated by ``by`` places, less than 64."""
    if not by:
        return bits
    return bits << np.uint64(by) | np.roll(bits, 1, axis=1) >> np.uint64(64 - by)


class _Letters:
    """The lower-case letter of every code point (0: no letter), filled as code points are met."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[points]
        if (out < 0).any():
            for c in np.unique(points[out < 0]).tolist():
                self.table[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
            out = self.table[points]
        return out


_LETTERS = _Letters()
_NUMBER = np.zeros(0x110000, np.int32)  # of the letters at hand; all 0 between uses


def pieces(text: str) -> Iterator[np.ndarray]:
    """Letters of a text, 0 for a boundary: each window of GRAM is in one piece and once."""
    tail = np.zeros(1, np.int32)
    for at in range(0, len(text), _PIECE):
        s = _LETTERS.of(text[at : at + _PIECE])
        s = np.concatenate([tail, s, np.zeros(int(at + _PIECE >= len(text)), np.int32)])
        s = s[(s > 0) | (np.concatenate([[1], s[:-1]]) > 0)]  # one boundary for a run
        yield s
        tail = s[-(GRAM - 1) :]


class Bundler:
    """Sums of the n-gram vectors of texts."""

    def __init__(self, dim: int):
        self.dim = dim

    def add(self, units: list[tuple[int, np.ndarray]], out: np.ndarray, n: np.ndarray) -> None:
        """Add the windows of (text, letters) to ``out`` (texts x dim) and their number to ``n``."""
        units = [u for u in units if len(u[1]) >= GRAM]
        if not units:
            return
        flat = np.concatenate([s for _, s in units])
        seen = np.unique(flat)
        letters = np.concatenate([[0], seen[seen > 0]])
        _NUMBER[letters] = np.arange(len(letters))
        number, base = _NUMBER[flat].astype(np.int64), len(letters)
        _NUMBER[letters] = 0
        code = np.zeros(len(flat) - GRAM + 1, np.int64)
        for i in range(GRAM):
            code = code * base + number[i : len(flat) - GRAM + 1 + i]
        texts, row = np.unique([i for i, _ in units], return_inverse=True)
        sizes = np.asarray([len(s) for _, s in units])
        inside = np.ones(len(flat), bool)
        for k in range(1, GRAM):
            inside[np.cumsum(sizes) - k] = False  # windows that begin here leave their piece
        inside = inside[: len(code)]
        code, of = code[inside], np.repeat(row, sizes - GRAM + 1)
        if base**GRAM <= _DIRECT:
            place = np.zeros(base**GRAM, np.int64)
            place[code] = 1
            grams = np.flatnonzero(place)
            place[grams] = np.arange(len(grams))
            place = place[code]
        else:
            grams, place = np.unique(code, return_inverse=True)
        if len(units) > 1 and len(texts) * len(grams) > _COUNTS:
            self.add(units[: len(units) // 2], out, n)
            self.add(units[len(units) // 2 :], out, n)
            return
        counts = np.bincount(of * len(grams) + place, minlength=len(texts) * len(grams)).astype(np.float32).reshape(len(texts), -1)
        n[texts] += counts.sum(axis=1, dtype=np.float64)
        bits = [rotated(letter_bits(letters, self.dim), i) for i in range(GRAM)]
        for at in range(0, len(grams), _GRAMS):
            bound, rest = 0, grams[at : at + _GRAMS]
            for i in range(GRAM):
                bound = bound ^ bits[i][rest % base]
                rest = rest // base
            some = counts[:, at : at + _GRAMS]
            minus = np.unpackbits(bound.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
            out[texts] += some.sum(axis=1, dtype=np.float64, keepdims=True) - 2.0 * (some @ minus)


def text_sums(texts: list[str | None], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each text's n-gram vectors, and how many n-grams there are."""
    out, n, bundler = np.zeros((len(texts), dim)), np.zeros(len(texts)), Bundler(dim)
    held, size = [], 0
    for i, text in enumerate(texts):
        for s in pieces(text or ""):
            held.append((i, s))
            size += len(s)
            if size > _PIECE:
                bundler.add(held, out, n)
                held, size = [], 0
    bundler.add(held, out, n)
    return out, n


def text_vectors(texts: list[str | None], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, and the root of how many distinct n-grams they amount to (n-grams
    over the length of their sum); zero where a text is null or has no letter."""
    out, n = text_sums(texts, dim)
    size = np.linalg.norm(out, axis=1)
    spread = np.divide(n * dim**0.5, size, out=np.zeros(len(n)), where=size > 0)
    return np.divide(out, size[:, None], out=out, where=size[:, None] > 0).astype(np.float32), spread


def _training(docs: DataFrame, train: Column, train_rows: int | None) -> DataFrame:
    """text and lang of the training rows of ``docs``; without ``train_rows`` of all of them."""
    small_batches(docs.sparkSession)
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if train_rows is not None and (n := rows.count()) > train_rows:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * train_rows / n))
    return rows.select("text", F.col("lang").cast("string").alias("lang"))


def _sums(rows: DataFrame, dim: int) -> tuple[list[str], np.ndarray]:
    """Languages and the sums of their rows' unit vectors."""

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors, _ = text_vectors(batch.column(0).to_pylist(), dim)
            langs = np.asarray(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.rint(v * (1 << 20)).astype(np.int64))], names=["lang", "at", "x"])

    # whole numbers, so that sums do not depend on the order of tasks
    summed = rows.mapInArrow(run, "lang string, at int, x long").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    got = summed.limit(MAX_LANGUAGES * dim + 1).toPandas()
    if len(got) > MAX_LANGUAGES * dim:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    got = got[got.groupby("lang")["x"].transform(lambda x: x.abs().max()) > 0] if len(got) else got
    names = sorted(got["lang"].unique()) if len(got) else []
    out = np.zeros((len(names), dim), np.float64)
    if names:
        out[got["lang"].map({x: i for i, x in enumerate(names)}), got["at"]] = got["x"] / (1 << 20)
    return names, out


def _unit(sums: np.ndarray) -> np.ndarray:
    return (sums / np.linalg.norm(sums, axis=1, keepdims=True)).astype(np.float32)


def prototypes(docs: DataFrame, train: Column, dim: int = DIM, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototype vectors, from the training rows of ``docs(text, lang)``."""
    names, sums = _sums(_training(docs, train, train_rows), dim)
    return names, _unit(sums)


def _centred(protos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prototypes' mean, and their unit vectors as seen from it."""
    mean = protos.mean(axis=0) if len(protos) > 1 else np.zeros(protos.shape[1], np.float32)
    centred = protos - mean
    return mean, centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)


def _cosines(vectors: np.ndarray, mean: np.ndarray, centred: np.ndarray) -> np.ndarray:
    off = vectors - mean
    return np.clip((off @ centred.T) / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12), -1, 1)


class Bounds(NamedTuple):
    """What a text of each language must reach; by language.

    A text of s*s distinct n-grams has a cosine of about ``mean * s`` with its language's
    prototype.  It is in the language if it falls short of that by ``short`` at most and, where
    that is three times ``least`` or more, its cosine is ``least`` at least.
    """

    mean: np.ndarray
    short: np.ndarray
    least: np.ndarray

    def hold(self, best: np.ndarray, cosine: np.ndarray, spread: np.ndarray) -> np.ndarray:
        hoped = self.mean[best] * spread
        return (hoped - cosine <= self.short[best]) & ((cosine >= self.least[best]) | (hoped < 3 * self.least[best]))


def _bin_at(fits: DataFrame, value: Column, share: float) -> DataFrame:
    """at, bin: the bin of 1 / ``_BINS`` in which a language's values reach a share of their number.

    Values are counted by bin first, so no language's values come together.
    """
    counts = fits.groupBy("at", F.floor(value * _BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("at").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("at"))
    return counts.select("at", "bin", (upto >= share * total).alias("reached")).filter("reached").groupBy("at").agg(F.min("bin").alias("bin"))


def learnt(docs: DataFrame, train: Column, dim: int = DIM, train_rows: int | None = None) -> tuple[list[str], np.ndarray, Bounds]:
    """``prototypes`` and the bounds that the same training rows set; without ``train_rows`` all of them.

    Each row that gets its own language is held against the prototype of its language's other
    rows.  All but ``_TAIL`` of these keep to some shortfall and some cosine: the bounds are
    half as much again (and three standard deviations of chance) and half of it.  A language
    without two such rows has none.
    """
    rows = _training(docs, train, train_rows)
    names, sums = _sums(rows, dim)
    bounds = Bounds(np.zeros(len(names)), np.full(len(names), np.inf), np.full(len(names), -np.inf))
    if not names:
        return names, _unit(sums), bounds
    given = docs.sparkSession.sparkContext.broadcast((names, sums, *_centred(_unit(sums))))

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, mid, profiles = given.value
        place, size = {x: i for i, x in enumerate(known)}, (total**2).sum(axis=1)
        for batch in batches:
            vectors, spread = text_vectors(batch.column(0).to_pylist(), dim)
            at = np.asarray([place.get(x, 0) for x in batch.column(1).to_pylist()], np.int64)
            along = (vectors * total[at]).sum(axis=1)
            others = size[at] - 2 * along + 1  # squared length of the sum without the row
            some = (spread > 0) & (others > 1e-3) & (_cosines(vectors, mid, profiles).argmax(axis=1) == at)
            cosine = (along[some] - 1) / np.sqrt(others[some])
            yield pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(cosine), pa.array(spread[some])], names=["at", "cosine", "spread"])

    fits = written(rows.mapInArrow(run, "at long, cosine double, spread double"), "language-fits")
    means = fits.groupBy("at").agg(F.avg(F.col("cosine") / F.col("spread")).alias("mean")).toPandas()
    bounds.mean[means["at"]] = means["mean"]
    if means.empty:
        return names, _unit(sums), bounds
    fits = fits.join(F.broadcast(docs.sparkSession.createDataFrame(means, "at long, mean double")), "at")
    short = F.col("mean") * F.col("spread") - F.col("cosine")
    slack = 3 / dim**0.5
    # the far edges of the bins, so that the rows of a bin all keep to its bound
    for r in _bin_at(fits, short, 1 - _TAIL).collect():
        bounds.short[r["at"]] = 1.5 * max((r["bin"] + 1) / _BINS, 0.0) + slack
    for r in _bin_at(fits, F.col("cosine"), _TAIL).collect():
        bounds.least[r["at"]] = r["bin"] / _BINS / 2
    return names, _unit(sums), bounds


def _predicted(docs: DataFrame, names: list[str], protos: np.ndarray, carry: list[str], bounds: Bounds | None = None) -> DataFrame:
    """c_0, c_1, ... (the columns to carry), lang_pred, score and whether the bounds hold, of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    others = [i for i, c in enumerate(carry) if c != "text"]
    rows = docs.select(F.col("text").cast("string").alias("t"), *[F.col(f"`{carry[i]}`").alias(f"c_{i}") for i in others])
    back = [f"c_{i}" for i, c in enumerate(carry) if c == "text"]
    schema = rows.drop("t").schema
    for c in back:
        schema = schema.add(c, "string")
    schema = schema.add("lang_pred", "string").add("score", "double").add("holds", "boolean")
    given = spark.sparkContext.broadcast((names, *_centred(protos), protos, bounds))

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mid, profiles, whole, limits = given.value
        for batch in batches:
            vectors, spread = text_vectors(batch.column(0).to_pylist(), profiles.shape[1])
            some = (vectors != 0).any(axis=1) if known else np.zeros(len(vectors), bool)
            cosine = _cosines(vectors, mid, profiles) if known else np.zeros((len(vectors), 1))
            best = cosine.argmax(axis=1)
            langs = [known[b] if s else "und" for b, s in zip(best, some, strict=True)]
            score = np.where(some, (1 + cosine[np.arange(len(best)), best].astype(np.float64)) / 2, 0.0)
            holds = some if limits is None or not known else some & limits.hold(best, (vectors * whole[best]).sum(axis=1, dtype=np.float64), spread)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[batch.column(0)] * len(back), pa.array(langs, pa.string()), pa.array(score), pa.array(holds)], names=schema.names)

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, names: list[str], protos: np.ndarray, carry: list[str]) -> DataFrame:
    """``carry`` columns, lang_pred and score (half of 1 + cosine) of every row."""
    out = _predicted(docs, names, protos, carry)
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score")


def accepted(docs: DataFrame, names: list[str], protos: np.ndarray, bounds: Bounds) -> DataFrame:
    """The rows, with all their columns, that have a language and keep to its bounds."""
    out = _predicted(docs, names, protos, docs.columns, bounds).filter("holds")
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, dim: int = DIM, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    names, protos = prototypes(docs, ~held_out(F.col("doc_id")), dim, train_rows)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, names, protos, ["doc_id", "held_out"])
