"""Packing of token ids into training sequences of several context sizes.

A document's full windows of the longest size go out as they are. Its rest is routed to the smallest tier that holds it.
Each tier is packed best-fit-decreasing; gaps of longer windows are filled from shorter tiers, the last filler being cut,
and what cannot fill a window waits for the next documents of the task. Only the last sequence of a task can be short,
so no shuffle is needed and padding is below one window for each task. Finished sequences are dealt to step groups,
the costliest first, each to the group with the fewest tokens so far.

Defined results: a null or empty text is the end id alone; a null doc_id stays null; equal rows are packed one by one;
an empty table gives an empty result; columns other than the two named ones are ignored. Special tokens' strings in a
text are ordinary text, or with special_tokens the added tokens of the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of

TIERS = (1024, 512, 256)
END = 0
#: Ids that a task holds before it packs them, and ids of a step group.
HELD_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16

_encoders: dict = {}


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def encoder(vocabulary: tuple[str, str], special_tokens: bool = False):
    """A function from text to uint32 ids; both files hold the same vocabulary, as ranks and for `tokenizers`.

    special_tokens: added tokens are found in texts, as `tokenizers` does by default.
    """
    if (vocabulary, special_tokens) not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary[0], "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        added = {}
        if special_tokens:
            with open(vocabulary[1], encoding="utf-8") as said:
                added = {x["content"]: x["id"] for x in json.load(said).get("added_tokens", [])}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        slow: list = []

        def ids(text: str) -> np.ndarray:
            try:
                return np.asarray(fast.encode_to_numpy(text, allowed_special=set(added), disallowed_special=()), np.uint32)
            except ValueError:  # its splitter has no stack for white space of about a million characters in a row
                pass
            if not slow:
                slow.append(Tokenizer.from_file(vocabulary[1]))
                slow[0].encode_special_tokens = not special_tokens
            return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

        _encoders[vocabulary, special_tokens] = ids
    return _encoders[vocabulary, special_tokens]


Piece = tuple[int, int, int]  # number of the document, start there, length


class Packer:
    """Makes sequences (lists of pieces) of the tiers' sizes from pieces; all but the last are full."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.pools: dict[int, list[Piece]] = {t: [] for t in self.tiers}

    def add(self, doc: int, tokens: int) -> list[tuple[int, list[Piece]]]:
        """Full windows of one document; its rest waits in its tier."""
        long = self.tiers[0]
        full = tokens - tokens % long
        if full < tokens:
            self.route((doc, full, tokens - full))
        return [(long, [(doc, at, long)]) for at in range(0, full, long)]

    def route(self, piece: Piece) -> None:
        self.pools[min(t for t in self.tiers if t >= piece[2])].append(piece)

    def pack(self) -> list[tuple[int, list[Piece]]]:
        """Full sequences from what waits; the rest goes on waiting."""
        done: list[tuple[int, list[Piece]]] = []
        for tier in self.tiers:
            pieces, self.pools[tier] = sorted(self.pools[tier], key=lambda p: -p[2]), []
            windows: list[list[Piece]] = []
            gaps: list[tuple[int, int]] = []  # (gap, window), ascending
            for piece in pieces:
                k = bisect_left(gaps, (piece[2], -1))
                if k < len(gaps):
                    gap, w = gaps.pop(k)
                else:
                    gap, w = tier, len(windows)
                    windows.append([])
                windows[w].append(piece)
                if gap > piece[2]:
                    insort(gaps, (gap - piece[2], w))
            short = {w for _, w in gaps}
            done += [(tier, pieces) for w, pieces in enumerate(windows) if w not in short]
            order = [w for _, w in gaps]  # smallest gaps first; the widest windows are taken apart if fillers run out
            while order:
                w = order.pop(0)
                gap = tier - sum(p[2] for p in windows[w])
                while gap:
                    source = next((t for t in self.tiers if t < tier and self.pools[t]), None)
                    if source is not None:
                        filler = self.pools[source].pop()
                    elif order:
                        apart = order[-1]
                        filler = windows[apart].pop()
                        if not windows[apart]:
                            order.pop()
                    else:
                        break
                    used = min(gap, filler[2])
                    windows[w].append((filler[0], filler[1], used))
                    gap -= used
                    if used < filler[2]:
                        rest = (filler[0], filler[1] + used, filler[2] - used)
                        if source is None and order and order[-1] == apart:
                            windows[apart].append(rest)
                        else:
                            self.pools[self.tiers[-1] if rest[2] <= self.tiers[-1] else next(t for t in reversed(self.tiers) if t >= rest[2])].append(rest)
                if gap:
                    self.pools[tier] += windows[w]
                else:
                    done.append((tier, windows[w]))
        return done

    def last(self) -> list[tuple[int, list[Piece]]]:
        """What still waits, in windows of the longest size; the last may be short."""
        long, out, now, room = self.tiers[0], [], [], self.tiers[0]
        for piece in [p for t in self.tiers for p in self.pools[t]]:
            doc, at, n = piece
            while n:
                used = min(room, n)
                now.append((doc, at, used))
                at, n, room = at + used, n - used, room - used
                if not room:
                    out.append((long, now))
                    now, room = [], long
        if now:
            out.append((long, now))
        self.pools = {t: [] for t in self.tiers}
        return out


def step_groups(sequences: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """For each sequence its group: the costliest first (attention grows with the square), to the group with least tokens."""
    sizes = [sum(p[2] for p in pieces) for _, pieces in sequences]
    heap = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sum(p[2] ** 2 for p in sequences[k][1])):
        held, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (held + sizes[k], g))
    return out


def _packed(vocabulary: tuple[str, str], tiers: tuple[int, ...], with_ids: bool, held_tokens: int, step_tokens: int, special_tokens: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = group = TaskContext.get().partitionId() << 36
        ids, packer = encoder(vocabulary, special_tokens), Packer(tiers)
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        done: list[tuple[int, list[Piece]]] = []
        number = tokens = 0

        def flushed() -> pa.RecordBatch:
            nonlocal sequence, group, done, tokens
            groups = step_groups(done, step_tokens)
            rows: list[tuple] = []
            for (tier, pieces), g in zip(done, groups, strict=True):
                offset = 0
                for doc, start, n in pieces:
                    doc_id, whole = held[doc]
                    part = whole[start : start + n]
                    rows.append((doc_id, start, n, zlib.crc32(part.tobytes()), len(whole), sequence, offset, tier, group + g, part if with_ids else None))
                    offset += n
                sequence += 1
            group += max(groups, default=-1) + 1
            waiting = {p[0] for pool in packer.pools.values() for p in pool}
            for doc in [d for d in held if d not in waiting]:
                del held[doc]
            done, tokens = [], 0
            columns = list(zip(*rows, strict=True)) or [()] * 10
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.int32()), pa.array(columns[8], pa.int64())]
            return pa.record_batch(arrays + [pa.array(columns[9], pa.list_(pa.int32()))] * with_ids, names=_NAMES[: 9 + with_ids])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = np.append(ids(text.as_py()), np.uint32(END))
                held[number] = doc_id, whole
                done += packer.add(number, len(whole))
                number, tokens = number + 1, tokens + len(whole)
                if tokens >= held_tokens:
                    done += packer.pack()
                    yield flushed()
        done += packer.pack()
        done += packer.last()
        if done:
            yield flushed()

    return run


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"]
_TYPES = ["long", "long", "long", "long", "long", "long", "long", "int", "long", "array<int>"]


def pack(docs: DataFrame, vocabulary: tuple[str, str] | None = None, tiers: tuple[int, ...] = TIERS, with_ids: bool = True, held_tokens: int = HELD_TOKENS, step_tokens: int = STEP_TOKENS, special_tokens: bool = False) -> DataFrame:
    """A row for each piece of docs (doc_id, text): where it lies in its document and in its sequence, its tier, its step
    group and, with_ids, its ids. vocabulary: paths of the rank file and of the same vocabulary for `tokenizers`.
    special_tokens: strings of added tokens in a text become these tokens."""
    n = 9 + with_ids
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(_NAMES[:n], _TYPES[:n], strict=True))
    return texts_of(docs, "doc_id", "text").mapInArrow(_packed(vocabulary or default_vocabulary(), tiers, with_ids, held_tokens, step_tokens, special_tokens), schema)
