"""Harmonic packing of tokenized documents into fixed-length training sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths of at most capacity / k, and each of its bins
takes exactly k pieces. A document longer than the capacity is cut into full sequences; a remainder that would leave
its class's bins too empty gives up one piece of exactly the next class's length first. Each partition fills its bins
on its own; what its unfilled bins hold (at most the sum of all k, whatever the input) is packed in a second, smaller
round, whose last unfilled bins are merged first-fit by decreasing length.

Defined results: a null or empty text is the end token alone; repeated rows are packed once each; a null doc_id is
kept; an empty table gives no pieces; other columns are ignored. Ids, cuts and fills depend on the rows and their
partitions only, so a task that is run again gives the same pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .wordtokens import word_tokens

CAPACITY, END_ID = 2048, 1
#: Share of a bin that a class may leave empty before a remainder is cut instead.
SLACK = 1 / 32
#: Leftover pieces that one task of the second round packs.
LEFTOVER_PIECES = 100_000
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def class_counts(capacity: int) -> list[int]:
    """Documents per bin of each class: every count to 16, then two steps to each doubling."""
    ks = list(range(1, 17))
    while ks[-1] < capacity:
        ks += [ks[-1] * 3 // 2, ks[-1] * 2]
    return [k for k in ks if k <= capacity]


def class_of(length: int, capacity: int, counts: list[int]) -> int:
    return next(k for k in reversed(counts) if k * length <= capacity)


def cuts(n: int, capacity: int, counts: list[int]) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r:
        k = class_of(r, capacity, counts)
        if k * r >= (1 - SLACK) * capacity or k >= 16 or capacity // (k + 1) in (0, r):
            out.append(r)
            break
        out.append(capacity // (k + 1))
        r -= out[-1]
    return out


class _Bins:
    """Open bins by class; a bin goes out when it has its count."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.counts, self.base, self.made = capacity, class_counts(capacity), base, 0
        self.open: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def put(self, piece: tuple) -> None:
        k = class_of(piece[2], self.capacity, self.counts)
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.close(self.open.pop(k))

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.out.append((*p[:5], self.base + self.made, at, *p[5:]))
            at += p[2]
        self.made += 1

    def leave(self) -> None:
        for held in self.open.values():
            self.out += [(*p[:5], None, None, *p[5:]) for p in held]

    def merge(self) -> None:
        bins: list[list] = []
        for p in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2]):
            b = next((b for b in bins if b[0] >= p[2]), None)
            if b is None:
                bins.append(b := [self.capacity, []])
            b[0] -= p[2]
            b[1].append(p)
        for _, held in bins:
            self.close(held)

    def take(self, with_ids: bool) -> pa.RecordBatch:
        rows, self.out = self.out, []
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def _first_round(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        bins = _Bins(capacity, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tokens.ids(text.as_py()), np.int32(end_id)).astype("<u4")
                at = 0
                for m in cuts(len(ids), capacity, bins.counts):
                    part = ids[at : at + m]
                    bins.put((doc, at, m, zlib.crc32(part.tobytes()), len(ids), *([part.astype(np.int32)] if with_ids else ())))
                    at += m
                if len(bins.out) >= 10_000:
                    yield bins.take(with_ids)
        bins.leave()
        yield bins.take(with_ids)

    return run


def _second_round(capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = _Bins(capacity, (1 << 62) | TaskContext.get().partitionId() << 32)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                bins.put((*row[:5], *row[7:]))
            if len(bins.out) >= 10_000:
                yield bins.take(with_ids)
        bins.merge()
        yield bins.take(with_ids)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""
    schema = _PIECE + (", ids array<int>" if with_ids else "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = written(texts.mapInArrow(_first_round(tokenizer_path, capacity, end_id, with_ids), schema), "pieces")
    rest = first.where("sequence_id is null")
    tasks = max(1, rest.count() // LEFTOVER_PIECES)
    second = rest.repartition(tasks).mapInArrow(_second_round(capacity, with_ids), schema)
    return first.where("sequence_id is not null").unionByName(second)
