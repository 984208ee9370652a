"""Edit-aware token counts (operator 4).

A document is held as its pre-tokens in leaves under a segment tree of character and token
sums. An edit re-lexes from the last pre-token that could be affected (a pre-token depends
on two characters behind it) to the first old border behind the edit where the new split
meets the old one; only that region is encoded again, and only the sums above the touched
leaves change. Counts equal those of encoding the edited text as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import spread

LEAF = 64
KEPT = 500_000  # pre-tokens whose counts a worker keeps; beyond, it starts anew
LOOKAHEAD = 2


class PreTokenCounter:
    """Token counts of the pre-tokens of a byte-level BPE vocabulary; lives as long as the Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
        self.lex = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pre: list[str]) -> list[int]:
        new = list({p for p in pre if p not in self.known})
        if new:
            if len(self.known) + len(new) > KEPT:
                self.known = {}
                new = list(set(pre))
            for lo in range(0, len(new), 4096):
                part = new[lo:lo + 4096]
                self.known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        return [self.known[p] for p in pre]


class TokenTree:
    """A document's pre-tokens, with character and token sums over a binary tree of leaves."""

    def __init__(self, text: str, counter: PreTokenCounter) -> None:
        self.counter = counter
        self.reencoded = 0
        pre = counter.lex.findall(text)
        self._build([pre[i:i + LEAF] for i in range(0, len(pre), LEAF)] or [[]])

    def _build(self, leaves: list[list[str]], counts: list[list[int]] | None = None) -> None:
        if counts is None:
            flat = self.counter.counts([p for leaf in leaves for p in leaf])
            ends = np.cumsum([0, *map(len, leaves)]).tolist()
            counts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        self.leaves, self.counts = leaves, counts
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i in range(len(leaves)):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, leaves[i])), sum(counts[i])
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, position: int) -> tuple[int, int, int]:
        """(leaf, index in the leaf, start) of the pre-token that holds the character at ``position``."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if position >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        leaf = min(node - self.size, len(self.leaves) - 1)
        for k, p in enumerate(self.leaves[leaf]):
            if position < before + len(p):
                return leaf, k, before
            before += len(p)
        return leaf, len(self.leaves[leaf]), before

    def _update(self, leaf: int) -> None:
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(map(len, self.leaves[leaf])), sum(self.counts[leaf])
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def replace(self, start: int, stop: int, new: str) -> None:
        """Replace the characters start..stop of the current text."""
        start, stop = max(0, min(start, self.n_chars)), max(0, min(stop, self.n_chars))
        stop = max(start, stop)
        leaf, k, at = self._find(max(0, start - LOOKAHEAD))
        first = (leaf, k)
        head, borders, pos = [], [], at
        # old pre-tokens from the restart on; borders: old ends at or behind the edit, in the new text's offsets
        shift = len(new) - (stop - start)
        buffer_parts: list[str] = []
        while True:
            grown = 0
            while grown < LEAF and leaf < len(self.leaves):
                if k >= len(self.leaves[leaf]):
                    leaf, k = leaf + 1, 0
                    continue
                p = self.leaves[leaf][k]
                buffer_parts.append(p)
                pos += len(p)
                k += 1
                if pos >= stop:
                    borders.append((pos + shift - at, leaf, k))
                    grown += 1
            old = "".join(buffer_parts)
            text = old[:start - at] + new + old[stop - at:]
            ended = leaf >= len(self.leaves)
            ends = {b: (i, j) for b, i, j in borders}
            head, sync = [], None
            for m in self.counter.lex.finditer(text):
                if not ended and m.end() > len(text) - LOOKAHEAD:
                    break
                head.append(m[0])
                if m.end() in ends and m.end() >= start - at + len(new):
                    sync = ends[m.end()]
                    break
            if sync is not None or ended:
                break
        last = sync if sync is not None else (len(self.leaves) - 1, len(self.leaves[-1]))
        self.reencoded += sum(map(len, head))
        counts = self.counter.counts(head)
        (i, a), (j, b) = first, last
        self.leaves[i] = self.leaves[i][:a] + head + self.leaves[j][b:]
        self.counts[i] = self.counts[i][:a] + counts + self.counts[j][b:]
        for x in range(i + 1, j + 1):
            self.leaves[x], self.counts[x] = [], []
            self._update(x)
        self._update(i)
        if len(self.leaves[i]) > 8 * LEAF:  # a leaf that has grown is cut again
            cut = [(self.leaves[i][x:x + LEAF], self.counts[i][x:x + LEAF]) for x in range(0, len(self.leaves[i]), LEAF)]
            self._build(self.leaves[:i] + [x for x, _ in cut] + self.leaves[i + 1:], self.counts[:i] + [c for _, c in cut] + self.counts[i + 1:])


_COUNTERS: dict[tuple[str, str], PreTokenCounter] = {}


def counter(path: str, pattern: str) -> PreTokenCounter:
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = PreTokenCounter(path, pattern)
    return _COUNTERS[path, pattern]


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_PHONE = regex.compile(r"\+?\d[\d ()-]{7,}\d")


def addresses(line: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses, found from the ``@`` to both sides, so that a run of letters without one costs nothing."""
    free = 0
    for m in _DOMAIN.finditer(line):
        before = line[free:m.start()]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            yield m.start() - local, m.end()
        free = m.end() if local else m.start() + 1


def clean_up_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, stop, replacement) of a usual clean-up, in ascending order without overlap: e-mail addresses and
    telephone numbers masked, lines that repeat an earlier line of the text deleted with their line break."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line and line in seen:
            edits.append((at - 1, at + len(line), ""))
        else:
            seen.add(line)
            spans = [(a, b, "[EMAIL]") for a, b in addresses(line)]
            spans += [(m.start(), m.end(), "[PHONE]") for m in _PHONE.finditer(line)]
            free = 0
            for a, b, new in sorted(spans):
                if a >= free:
                    edits.append((at + a, at + b, new))
                    free = b
        at += len(line) + 1
    return edits


def edited_token_counts(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                        edits: Callable[[str], list[tuple[int, int, str]]] = clean_up_edits) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_chars_after, n_tokens_after, reencoded_chars) per row.

    ``edits`` gives a text's edits in offsets of the text as it is, ascending without
    overlap; they are applied from the last to the first. A null text counts as empty;
    repeated rows each give a row; no rows give none. Row-local, whole texts, no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, pattern)
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py() or ""
                tree = TokenTree(text, count)
                before, todo = tree.n_tokens, edits(text)
                for a, b, new in reversed(todo):
                    tree.replace(a, b, new)
                out.append((before, len(todo), tree.n_chars, tree.n_tokens, tree.reencoded))
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in columns]],
                                             ["id", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "reencoded_chars"])

    slim = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, reencoded_chars long") \
        .withColumnRenamed("id", id_col)
