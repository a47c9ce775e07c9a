"""Word-piece token counts in linear time, without building the pieces.

Greedy longest-match-first tokenising as an automaton: a trie of the vocabulary whose failure links lead to where
matching goes on after the pieces that are certain by then, with the number of these pieces beside each link. Each word
is read once, byte by byte; all different words of a batch are read at the same time.

Defined results: a null or empty text has no tokens; a word that the vocabulary cannot spell is one token, as in the
greedy rule; null ids and equal rows are treated like others; an empty table gives an empty result; columns other than
the two named ones are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffer_of, chunks, hash_ranges, texts_of, words_of
from .trie import DoubleArray

NONE = -1
#: Bytes of texts whose different words are counted at once.
TEXT_BYTES = 4 << 20


class Automaton:
    """initial: pieces that begin a word; continuing: pieces that go on with one. With one set for both, pass it twice."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        initial, continuing = set(initial), set(continuing)
        # both kinds lie in one trie, behind a byte that no UTF-8 text has
        mark = {True: b"\xfe", False: b"\xff"}
        keys = [(mark[True] + p, 1) for p in initial] + [(mark[False] + p, 1) for p in continuing]
        trie = DoubleArray([*keys, (mark[True], -1), (mark[False], -1)])
        self.first, self.next = trie.after(0, 0xFE), trie.after(0, 0xFF)
        n = len(trie.base)
        fail, pops = [NONE] * n, [0] * n
        base, check, value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        for v in trie.order[1:]:
            if v in (self.first, self.next):
                continue
            u = check[v]
            c = v - base[u]
            if value[v] >= 0:
                fail[v], pops[v] = self.next, 1
                continue
            z, popped = fail[u], pops[u]
            while z != NONE:
                to = base[z] + c
                if 0 < to < n and check[to] == z:
                    fail[v], pops[v] = to, popped
                    break
                popped += pops[z]
                z = fail[z]
        self.trie, self.fail, self.pops = trie, np.array(fail, np.int32), np.array(pops, np.int32)

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:end]; words without an end in the automaton count 1."""
        n = len(start)
        size, state = end - start, np.full(n, self.first, np.int32)
        tokens, lost = np.zeros(n, np.int64), np.zeros(n, bool)
        order = np.argsort(-size, kind="stable")
        going = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
        for i, many in enumerate(going.tolist()):
            rows = order[:many]
            rows = rows[~lost[rows]]
            while len(rows):
                to = self.trie.step(state[rows], data[start[rows] + i].astype(np.int32))
                on = to >= 0
                state[rows[on]] = to[on]
                rows = rows[~on]
                self._pop(rows, state, tokens, lost)
                rows = rows[~lost[rows]]
        rows = np.flatnonzero(~lost & (state != self.next) & (size > 0))
        while len(rows):
            self._pop(rows, state, tokens, lost)
            rows = rows[~lost[rows] & (state[rows] != self.next)]
        tokens[lost] = 1
        return tokens

    def _pop(self, rows: np.ndarray, state: np.ndarray, tokens: np.ndarray, lost: np.ndarray) -> None:
        tokens[rows] += self.pops[state[rows]]
        to = self.fail[state[rows]]
        lost[rows[to == NONE]] = True
        state[rows] = np.where(to == NONE, state[rows], to)


def byte_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary for `tokenizers`, special ones left out, as bytes."""
    # the file writes bytes that do not print as characters from U+0100 on, in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    special = {x["content"] for x in said.get("added_tokens", [])}
    return [bytes(char[c] for c in piece) for piece in said["model"]["vocab"] if piece not in special]


def default_automaton() -> Automaton:
    """Of byte_bpe_50k: a word with a space before it is spelt with its pieces, longest first."""
    import public_tokenizers

    pieces = byte_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    return Automaton(pieces, pieces)


def count_tokens(docs: DataFrame, automaton: Automaton | None = None, prefix: bytes = b" ") -> DataFrame:
    """doc_id, n_words and n_tokens for every row of docs (doc_id, text). prefix: what stands before each word."""
    # as large as the vocabulary, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast(automaton or default_automaton())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=TEXT_BYTES):
            data, at = buffer_of(part.column(1))
            start, end, owner = words_of(data, at)
            _, first, which = np.unique(hash_ranges(data, start, end), return_index=True, return_inverse=True)
            a, b, p = start[first], end[first], len(prefix)
            size = b - a + p
            to = np.r_[0, np.cumsum(size)]
            spelt = np.empty(int(to[-1]), np.uint8)
            inside = np.arange(len(spelt)) - np.repeat(to[:-1], size)
            spelt[:] = data[np.maximum(np.repeat(a, size) + inside - p, 0)] if len(spelt) else 0
            for k, c in enumerate(prefix):
                spelt[to[:-1] + k] = c
            tokens = shared.value.count(spelt, to[:-1], to[1:])[which] if len(first) else np.zeros(0, np.int64)
            n = part.num_rows
            total = np.bincount(owner, tokens, n).astype(np.int64)
            yield pa.record_batch([part.column(0), pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array(total)], names=["doc_id", "n_words", "n_tokens"])

    return texts_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
