"""Token ids of whole texts by the `tokenizers` library, with a bounded cache of chunk ids.

Both tokenizers used here split a text before any merge is made, and neither split ever
crosses the cut points used below, so ``ids(text) == concat(ids(chunk))`` holds exactly:

* byte-level BPE: a white-space run and the word after it form a chunk;
* word BPE: white space is dropped, so every space is a cut.

Texts of natural language repeat their words, so each distinct chunk is encoded once by
the library and looked up afterwards.  A chunk that is one word, perhaps with ASCII marks
after it, goes straight to the library's merge model; any other chunk goes through the
library's whole pipeline.  The cache holds two generations of ``CACHE_ENTRIES`` chunks (or
as many as the caller allows) at most; dropping the older one changes speed only, never ids.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import _KEPT

CACHE_ENTRIES = 300_000
LONGEST_CACHED = 64
_RUN = re.compile(r"\s\s")
_PYTHON_ONLY_SPACE = re.compile(r"[\x1c-\x1f]")
_CHUNK = re.compile(r"\s*\S+|\s+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    table.update((b, chr(0x100 + i)) for i, b in enumerate(b for b in range(256) if b not in table))
    return table


class ChunkEncoder(dict):
    """ids(texts) for a tokenizer file; ``keep_space`` tells the byte-level kind.

    As a dict it maps chunk keys to packed ids, computing those that are missing.
    """

    def __init__(self, path: str, keep_space: bool, entries: int | None = None):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.keep_space, self.entries = keep_space, entries
        self.folds = not keep_space and self.tok.normalizer is not None and self.tok.normalizer.normalize_str("AbZ") == "abz"
        self.dtype = np.dtype("u2" if self.tok.get_vocab_size(True) <= 1 << 16 else "u4")
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.code, self.space = "H" if self.dtype.itemsize == 2 else "I", byte_alphabet()[32]
        self.latin = {i: "".join(byte_alphabet()[b] for b in chr(i).encode()) for i in range(0x250)}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            if self.folds and key.isascii() and key.isalpha() and len(key) <= LONGEST_CACHED:  # the short way of most words
                found = array(self.code, [t.id for t in self.merge(key.lower())]).tobytes()
            else:
                found, keep = self._encode(key)
                if not keep or len(key) > LONGEST_CACHED:
                    return found
        self._keep(key, found)
        return found

    def _keep(self, key: str, found: bytes) -> None:
        if len(self) >= (self.entries or CACHE_ENTRIES):
            self.older = dict(self)
            self.clear()
        self[key] = found

    def _encode(self, key: str) -> tuple[bytes, bool]:
        """Packed ids of a chunk, and whether they are worth an entry."""
        chunk = self._literal(key)
        body = chunk[1:] if self.keep_space and chunk[:1] == " " else chunk
        word = body.rstrip(_MARKS)
        if not (word.isalpha() and (word.isascii() or max(word) < "İ") and len(word) <= LONGEST_CACHED):
            return self._whole(chunk), True
        if len(word) == len(body):
            return self._merged((" " + word if body is not chunk else word) if self.keep_space else word.lower()), True
        mine = key[: len(key) - len(body) + len(word)]  # the key of the word without its marks
        known = mine in self or mine in self.older
        marks = body[len(word) :]
        if marks not in self.marks:
            if len(self.marks) >= 4096:
                self.marks.clear()
            self.marks[marks] = self._merged(marks)
        return self[mine] + self.marks[marks], known

    def _merged(self, piece: str) -> bytes:
        """Packed ids of one word or run of marks, which the pre-tokenizers leave whole."""
        if piece.isascii() and piece.isprintable():  # the byte alphabet changes the space alone
            piece = piece.replace(" ", self.space)
        else:
            piece = piece.translate(self.latin)
        return array(self.code, [t.id for t in self.merge(piece)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _chunks(self, text: str) -> list[str] | None:
        """Keys of the chunks of a text; None if it must be encoded whole."""
        if not self.keep_space:
            if self.folds and text.isascii():  # one entry for all spellings of a word
                text = text.lower()
            return text.replace("\n", " ").split(" ")
        if _PYTHON_ONLY_SPACE.search(text):
            return None
        if not text or _RUN.search(text):
            return ["\0" + c for c in _CHUNK.findall(text)]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    def _literal(self, key: str) -> str:
        """The chunk that a key stands for."""
        if not self.keep_space:
            return key
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key

    def ids(self, text: str | None) -> np.ndarray:
        """Token ids of a text; null and empty texts have none."""
        if not text:
            return np.empty(0, self.dtype)
        keys = self._chunks(text)
        return np.frombuffer(self._whole(text) if keys is None else b"".join(map(self.__getitem__, keys)), self.dtype)


_OPEN: dict[tuple[str, bool, int | None], ChunkEncoder] = {}
_KEPT.append(_OPEN.clear)


def encoder(path: str, keep_space: bool, entries: int | None = None) -> ChunkEncoder:
    """One encoder for each file, size of cache and Python worker."""
    if (path, keep_space, entries) not in _OPEN:
        _OPEN[path, keep_space, entries] = ChunkEncoder(path, keep_space, entries)
    return _OPEN[path, keep_space, entries]
