"""Exact batch encoding with a tokenizers-library vocabulary, word pieces encoded once.

A vocabulary whose pre-tokenizer drops white space and splits letters from punctuation
encodes the pieces of a text between such borders independently of one another. So a
batch is cut at ASCII white space and at borders between letters, digits and punctuation
(only where both neighbours are certain: ASCII or Latin-1 letters), each distinct piece is
encoded once by the library and kept, and a text's ids are gathered from its pieces. Words
that hold an apostrophe or ``<`` (contractions, special tokens) stay whole and unchanged.
The result equals encoding the whole text at once; tests check that.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from docweave.llm.arrays import SEPARATOR, dictionary, utf8, word_spans

KEPT = 1_000_000  # pieces kept by a worker; beyond, it starts anew
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.zeros(256, np.uint8)  # 0 unknown, 1 letter, 2 punctuation, 3 digit
_CLASS[33:127] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 3
_WHOLE = np.zeros(256, bool)
_WHOLE[[ord("'"), ord("<")]] = True


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(piece column, simple flag per piece, pieces before each row (n+1)).

    A simple piece consists of ASCII or Latin-1 letters, of punctuation, or is one digit:
    the vocabulary's pre-tokenizer leaves it in one part.
    """
    inside = ~SEPARATOR[data]
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    lead = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    low = _LOWER[data]
    if _WHOLE[data].any():
        starts, ends, _ = word_spans(data, offsets)
        odd = np.searchsorted(np.flatnonzero(_WHOLE[data]), ends) > np.searchsorted(np.flatnonzero(_WHOLE[data]), starts)
        step = np.zeros(len(data) + 1, np.int64)
        step[starts[odd]] += 1
        np.add.at(step, ends[odd], -1)
        whole = np.cumsum(step)[:-1] > 0
        kind[whole] = 0
        low[whole] = data[whole]
    border = np.zeros(len(data) + 1, bool)  # between byte i-1 and byte i
    border[offsets] = True
    border[1:-1] |= ~inside[:-1] | ((kind[:-1] > 0) & (kind[1:] > 0) & ((kind[:-1] != kind[1:]) | (kind[1:] == 3)))
    first = inside & border[:-1]
    starts = np.flatnonzero(first)
    unknown = np.flatnonzero(inside & (kind == 0))
    text = low[inside]
    bounds = np.append(np.cumsum(inside)[starts] - 1, len(text)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(text)])
    simple = np.ones(len(starts), bool)
    if len(starts):
        simple[np.searchsorted(starts, unknown, "right") - 1] = False
    return column, simple, np.searchsorted(starts, offsets)


class PieceEncoder:
    """Encodes columns of texts; lives as long as the Python worker (see ``encoder``)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keep the ids of ``words``: their ids end to end, and how many each has."""
        n, total = len(self.known), len(ids)
        while n + len(words) > len(self.at):
            self.at, self.count = np.resize(self.at, 2 * len(self.at)), np.resize(self.count, 2 * len(self.count))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:self.used + total] = ids
        self.at[n:n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.count[n:n + len(words)] = lengths
        self.used += total
        self.known.update(zip(words, range(n, n + len(words))))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _learn(self, words: list[bytes], simple: list[bool]) -> None:
        """Encode new pieces. Simple ones in few calls: each ends with the one id that closes a word."""
        easy = [w for w, s in zip(words, simple) if s]
        for lo in range(0, len(easy), 8192):
            part = easy[lo:lo + 8192]
            ids = self._ids(b" ".join(part).decode())
            closes = np.flatnonzero(self.closing[ids]) + 1
            if len(closes) != len(part):  # not such a vocabulary: one by one
                for w in part:
                    alone = self._ids(w.decode())
                    self._add([w], alone, np.array([len(alone)]))
            else:
                self._add(part, ids, np.diff(closes, prepend=0))
        hard = [w for w, s in zip(words, simple) if not s]
        for lo in range(0, len(hard), 4096):
            part = hard[lo:lo + 4096]
            found = [np.array(x.ids, np.int32) for x in
                     self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
            self._add(part, np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets n+1) of a large_string column without nulls."""
        data, offsets = utf8(texts)
        column, simple, bounds = pieces(data, offsets) if len(data) else (None, None, None)
        if column is None or not len(column):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        index, distinct = dictionary(column)
        words = distinct.to_pylist()
        if len(self.known) + len(words) > KEPT:
            self._clear()
        known = self.known
        new = [i for i, w in enumerate(words) if w not in known]
        if new:
            flag = np.empty(len(words), bool)
            flag[index] = simple
            self._learn([words[i] for i in new], flag[new].tolist())
        slot = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[index]
        count = self.count[slot]
        upto = np.cumsum(count)
        place = np.repeat((self.at[slot] - (upto - count)).astype(np.int32), count)
        place += np.arange(len(place), dtype=np.int32)
        return self.flat[place], np.concatenate([[0], upto])[bounds]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file (a path that every worker can open)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
