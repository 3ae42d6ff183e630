"""Packing of tokenised documents into fixed windows by minimum bin slack.

Every document is cut into full windows and one shorter rest.  Rests are packed by
minimum bin slack: the longest waiting rest opens a window, and a subset-sum dynamic
programme over the waiting lengths, held as bitsets (bit s: the sum s can be reached),
finds the multiset that fills the window closest to its capacity; the counts of that
multiset come from backtracking through the bitsets.  A found multiset is used as often
as the waiting counts allow.

Work is local to a partition and needs no shuffle.  Memory is bounded by ``waiting``
tokens: once so many wait, windows are filled until half of them are gone.  Windows with
no slack come first; where the best multiset leaves slack (at a partition's end, or with
too many tokens waiting), the longest rest is cut to fill it.  What is left at the end is
less than one window: it is cut at powers of two, whose sequences need no padding.  So no
sequence is padded, however many partitions there are.  A lost task is simply run again:
its rows depend only on its partition.

Null and empty texts count as documents of one token (the end id).  Null ids are kept as
null; repeated rows and equal ids are packed separately.  A text of any length is encoded
whole, and its full windows are sent as they are cut.  Columns other than the id and the
text are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker
from .tokens import encoder

CAPACITY = 2048
WAITING_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Waiting:
    """Rests by length: a queue of pieces for each."""

    def __init__(self) -> None:
        self.by: dict[int, deque] = defaultdict(deque)
        self.tokens = 0

    def add(self, length: int, piece: tuple) -> None:
        self.by[length].append(piece)
        self.tokens += length

    def take(self, length: int) -> tuple:
        queue = self.by[length]
        piece = queue.popleft()
        if not queue:
            del self.by[length]
        self.tokens -= length
        return piece

    def counts(self) -> list[tuple[int, int]]:
        """(length, how many), longest first."""
        return [(x, len(self.by[x])) for x in sorted(self.by, reverse=True)]


def best_fill(counts: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """The multiset of waiting lengths with the largest sum up to the capacity.

    ``reach`` holds the sums reached so far as bits.  Each length enters by powers of two
    of its count, and every step's bitset is kept for the way back.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length, n in counts:
        if length > capacity:
            continue
        n, part = min(n, capacity // length), 1
        while n > 0:
            part = min(part, n)
            after = (reach | reach << (length * part)) & mask
            if after != reach:
                steps.append((reach, length, part))
                reach = after
            n -= part
            part *= 2
        if reach >> capacity & 1:
            break
    left = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, part in reversed(steps):
        if not before >> left & 1:
            used[length] = used.get(length, 0) + part
            left -= length * part
    return used


def fill_windows(waiting: Waiting, capacity: int, until: int, cut: bool) -> Iterator[list[tuple[int, tuple]]]:
    """Full windows as lists of (length, piece), until so few tokens wait.

    A window that cannot be filled exactly ends the work - later rests may fit - or, with
    ``cut``, takes the tokens that it lacks from the longest rest that still waits.
    """
    while waiting.tokens > until and waiting.tokens >= capacity:
        counts = waiting.counts()
        seed = counts[0][0]
        rest = [(x, n - (x == seed)) for x, n in counts if n > (x == seed)]
        used = best_fill(rest, capacity - seed)
        used[seed] = used.get(seed, 0) + 1
        slack = capacity - sum(x * n for x, n in used.items())
        if slack and not cut:
            return
        for _ in range(1 if slack else min(len(waiting.by[x]) // n for x, n in used.items())):
            window = [(x, waiting.take(x)) for x, n in used.items() for _ in range(n)]
            if slack:  # every rest that still waits is longer than the slack, or it would be in the window
                length = max(waiting.by)
                doc, start, ids, total = waiting.take(length)
                window.append((slack, (doc, start, ids[:slack], total)))
                waiting.add(length - slack, (doc, start + slack, ids[slack:], total))
            yield window
            if waiting.tokens <= until:
                return


def packed(batches: Iterator[tuple[list, list[np.ndarray]]], capacity: int, end_id: int, waiting_tokens: int) -> Iterator[list[tuple]]:
    """Rows without sequence numbers, a sequence at a time, of (doc ids, token ids) batches."""
    waiting = Waiting()

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes())

    def rows(window: list[tuple[int, tuple]]) -> list[tuple]:
        out, offset = [], 0
        for length, (doc, start, ids, total) in window:
            out.append((doc, start, length, crc(ids), total, offset))
            offset += length
        return out

    for docs, tokens in batches:
        for doc, ids in zip(docs, tokens, strict=True):
            ids = np.append(ids, np.asarray(end_id, ids.dtype))
            total = len(ids)
            for start in range(0, total - capacity + 1, capacity):
                yield [(doc, start, capacity, crc(ids[start : start + capacity]), total, 0)]
            if rest := total % capacity:
                waiting.add(rest, (doc, total - rest, ids[total - rest :].copy(), total))
        if waiting.tokens > waiting_tokens:
            yield from map(rows, fill_windows(waiting, capacity, waiting_tokens // 2, cut=False))
            if waiting.tokens > waiting_tokens:  # nothing fits exactly
                yield from map(rows, fill_windows(waiting, capacity, waiting_tokens // 2, cut=True))
    yield from map(rows, fill_windows(waiting, capacity, 0, cut=True))
    yield from tail(waiting, capacity, crc)


def tail(waiting: Waiting, capacity: int, crc: Callable[[np.ndarray], int]) -> Iterator[list[tuple]]:
    """What is left, under one window: sequences of powers of two, pieces cut to fit."""
    room, out, at = 0, [], 0
    for length, _ in [c for c in waiting.counts() for _ in range(c[1])]:
        doc, start, ids, total = waiting.take(length)
        done = 0
        while done < length:
            if not room:
                left = length - done + waiting.tokens
                room, out, at = 1 << (min(left, capacity).bit_length() - 1), [], 0
            n = min(room, length - done)
            out.append((doc, start + done, n, crc(ids[done : done + n]), total, at))
            done, room, at = done + n, room - n, at + n
            if not room:
                yield out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, waiting_tokens: int = WAITING_TOKENS, id_col: str = "doc_id", text_col: str = "text", cache_entries: int | None = None) -> DataFrame:
    """One row for each piece of a document; see the module's text for the method.

    ``sequence_id`` joins the partition's number and a running number, so that it needs
    no pass over all sequences.  ``cache_entries``: chunks in a generation of the token
    cache, for workers with less room; it changes speed only.
    """
    small_batches(docs.sparkSession)

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer, True, cache_entries).ids
        base = TaskContext.get().partitionId() << 40

        def read() -> Iterator[tuple[list, list[np.ndarray]]]:
            for batch in batches:
                yield batch.column(0).to_pylist(), [ids_of(t) for t in batch.column(1).to_pylist()]

        held: list[tuple] = []
        for n, rows in enumerate(packed(read(), capacity, end_id, waiting_tokens)):
            held += [(*r[:5], base + n, r[5]) for r in rows]
            if len(held) >= 8192:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

