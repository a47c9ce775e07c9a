"""SentencePiece encoding and decoding: the best path of pieces by the sum of their log scores, with byte fallback.

Spaces become the marker U+2581, one more stands before the text, and a double-array trie finds the pieces that begin
at each place. A character that no piece spells alone may be unknown, at the lowest score less 10, and is then written
as its bytes. No piece holds a marker after another character, so paths of the stretches between markers are
independent, and every different stretch of a batch is solved once, all of them side by side.

The vocabulary file of the test box holds merge ranks for scores. `zipf_scores` makes log scores of them, as chances
that fall with the rank; scores of a file that has real ones are used as they are.

Defined results: a null or empty text has no ids; U+2581 in a text decodes as a space; null ids and equal rows are
treated like others; an empty table gives an empty result; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffer_of, chunks, hash_ranges, texts_of
from .trie import DoubleArray

MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
#: Places (stretches times the longest one's bytes) that are solved at once, and bytes of texts whose stretches are.
AREA, TEXT_BYTES = 1 << 22, 4 << 20


def zipf_scores(ranks: np.ndarray) -> np.ndarray:
    """Log chances that fall with the rank: log(1 / (rank + 10)), normalised."""
    chance = 1 / (ranks + 10.0)
    return np.log(chance / chance.sum()).astype(np.float32)


class Unigram:
    def __init__(self, pieces: list[str], scores: np.ndarray, normal: np.ndarray, bytes_: dict[int, int]):
        """pieces and scores by id; normal: which of them the trie holds; bytes_: id of the piece of each byte."""
        self.scores = np.asarray(scores, np.float32)
        self.trie = DoubleArray((p.encode(), k) for k, p in enumerate(pieces) if normal[k])
        self.longest = max(len(p.encode()) for k, p in enumerate(pieces) if normal[k])
        self.unknown = np.float32(self.scores[normal].min() - UNKNOWN_PENALTY)
        self.byte_id = np.array([bytes_[b] for b in range(256)], np.int32)
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[self.byte_id] = True
        of_byte = {k: bytes([b]) for b, k in bytes_.items()}
        self.spelling = [of_byte.get(k) or (p.encode().replace(MARK, b" ") if normal[k] else b"") for k, p in enumerate(pieces)]

    @classmethod
    def load(cls, path: str, zipf: bool = True) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(k) for k in range(n)]
        bytes_ = {int(pieces[k][3:5], 16): k for k in range(n) if model.is_byte(k)}
        normal = np.array([not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)) for k in range(n)])
        scores = np.array([model.get_score(k) for k in range(n)], np.float32)
        if zipf:
            scores[normal] = zipf_scores(np.argsort(np.argsort(-scores[normal], kind="stable"), kind="stable"))
        return cls(pieces, scores, normal, bytes_)

    def paths(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches data[start:end] in a row, and the number of ids of each."""
        order = np.argsort(end - start, kind="stable")
        sizes = (end - start)[order]
        counts, made = np.zeros(len(start), np.int64), []
        first = 0
        while first < len(order):
            # as many as the area holds, by size: what they take grows with their number
            last, over = first + 1, len(order) + 1
            while over - last > 1:
                middle = (last + over) // 2
                last, over = (middle, over) if (middle - first) * (int(sizes[middle - 1]) + 1) <= AREA else (last, middle)
            rows = order[first:last]
            ids, n = self._solve(data, start[rows], end[rows])
            counts[rows] = n
            made.append((rows, ids, n))
            first = last
        to = np.r_[0, np.cumsum(counts)]
        out = np.empty(int(to[-1]), np.int32)
        for rows, ids, n in made:
            out[np.repeat(to[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(ids))] = ids
        return out, counts

    def _solve(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, longest = len(start), int((end - start).max())
        size = end - start
        best = np.full((n, longest + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, piece = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        lead = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)
        for i in range(longest):
            rows = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            whole = np.minimum(i + lead[data[start[rows] + i]], size[rows])  # end of the character here
            alone = np.zeros(n, bool)
            at, state, till = rows, np.zeros(len(rows), np.int32), whole
            for k in range(min(self.longest, longest - i)):
                state = self.trie.step(state, data[start[at] + i + k].astype(np.int32))
                on = state >= 0
                at, state, till = at[on], state[on], till[on]
                if not len(at):
                    break
                found = self.trie.value[state]
                hit = found >= 0
                to, ids = at[hit], found[hit]
                alone[to[till[hit] == i + k + 1]] = True
                new = best[to, i] + self.scores[ids]
                better = new > best[to, i + k + 1]
                to = to[better]
                best[to, i + k + 1], back[to, i + k + 1], piece[to, i + k + 1] = new[better], i, ids[better]
                on = size[at] > i + k + 1
                at, state, till = at[on], state[on], till[on]
            unknown = ~alone[rows]
            rows, whole = rows[unknown], whole[unknown]
            new = best[rows, i] + self.unknown
            better = new > best[rows, whole]
            rows, whole = rows[better], whole[better]
            best[rows, whole] = new[better]
            for k in range(4):  # the character's bytes, one step each
                to = rows[i + k < whole]
                if not len(to):
                    break
                back[to, i + k + 1], piece[to, i + k + 1] = i + k, self.byte_id[data[start[to] + i + k]]
        at, rows = size.astype(np.int64), np.arange(n)
        taken = []
        while len(rows):
            taken.append((rows, piece[rows, at]))
            at = back[rows, at].astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        counts = np.bincount(np.concatenate([r for r, _ in taken]), minlength=n)
        to, ids = np.cumsum(counts), np.empty(int(counts.sum()), np.int32)
        for k, (r, x) in enumerate(taken):
            ids[to[r] - 1 - k] = x
        return ids, counts

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        texts = len(at) - 1
        filled = at[1:] > at[:-1]
        space = data == 32
        grow = np.where(space, 3, 1)
        before = np.r_[0, np.cumsum(grow)]
        lead = np.cumsum(np.where(filled, 3, 0))  # marker bytes put before texts up to each
        moved = before[at[:-1]] + np.r_[0, lead[:-1]]  # where each text's marker goes
        size = int(before[-1] + (lead[-1] if texts else 0))
        out = np.empty(size, np.uint8)
        owner = np.repeat(np.arange(texts), np.diff(at))
        place = before[:-1] + lead[owner] if len(data) else np.zeros(0, np.int64)
        out[place] = data
        marks = np.concatenate([place[space], moved[filled]])
        for k in range(3):
            out[marks + k] = MARK[k]
        # stretches begin at the first marker of a run; U+2581 of the text itself is a marker too
        here = np.zeros(size + 3, bool)
        if size >= 3:
            here[: size - 2] = (out[:-2] == MARK[0]) & (out[1:-1] == MARK[1]) & (out[2:] == MARK[2])
        begins = here[:size].copy()
        begins[3:] &= ~here[: size - 3] if size > 3 else begins[3:]
        begins[moved[filled]] = True
        start = np.flatnonzero(begins)
        end = np.r_[start[1:], size][: len(start)]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
        _, one, which = np.unique(hash_ranges(out, start, end), return_index=True, return_inverse=True)
        ids, counts = self.paths(out, start[one], end[one])
        begin = np.r_[0, np.cumsum(counts)][:-1]
        n = counts[which]
        shift = np.repeat(begin[which] - np.r_[0, np.cumsum(n)[:-1]], n)
        flat = ids[shift + np.arange(int(n.sum()))]
        total = np.r_[0, np.cumsum(n)]
        return flat, total[np.searchsorted(start, np.r_[moved, size])]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.spelling[k] for k in ids.tolist()])
        return (text[1:] if text[:1] == b" " else text).decode(errors="replace")


_models: dict = {}


def encode_texts(docs: DataFrame, model_path: str | None = None, zipf: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, ids_crc32 and whether the ids decode to the text, for docs (doc_id, text)."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model_path, zipf) not in _models:
            _models[model_path, zipf] = Unigram.load(model_path, zipf)
        model = _models[model_path, zipf]
        for part in chunks(batches, most=TEXT_BYTES):
            ids, at = model.encode(*buffer_of(part.column(1)))
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            same = [model.decode(ids[a:b]) == text.as_py().replace("▁", " ") for a, b, text in zip(at[:-1], at[1:], part.column(1), strict=True)]
            bytes_ = np.r_[0, np.cumsum(model.is_byte[ids])]
            columns = [part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(np.diff(at)), pa.array(bytes_[at[1:]] - bytes_[at[:-1]]), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.record_batch(columns, names=["doc_id", "ids", "n_tokens", "n_byte_tokens", "ids_crc32", "decodes"])

    return texts_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_byte_tokens long, ids_crc32 long, decodes boolean")
