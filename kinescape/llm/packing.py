"""Harmonic packing of documents into sequences of a fixed capacity."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinescape.llm.common import _arrow_schema, mapped
from kinescape.llm.pieces import CHARACTERS, encoder

#: Worker number in the upper bits of a sequence id, the worker's own count below.
WORKER_BITS = 36


class HarmonicPacker:
    """One worker's bins.

    A document gives full sequences of its own first. What remains, ``length`` ids, belongs to
    class capacity // length: a bin of class k takes k whole remainders, so each is longer than
    capacity / (k + 1) and none is cut. A bin that has its count waits with the room that is
    left. A later remainder goes whole into the waiting bin of least room that holds it; only
    when ``held`` bins wait is one cut, into the waiting bins from the least room up. Bins still
    unfilled at the end are poured, in order of class, into sequences whose lengths are powers
    of two. So no sequence is padded.
    """

    def __init__(self, capacity: int = 2048, held: int = 64):
        if capacity < 1 or capacity & (capacity - 1) or held < 0:
            raise ValueError("capacity must be a power of two, and no fewer than no bins held")
        self.capacity, self.held = capacity, held
        self.open: dict[int, list] = {}
        self.waiting: list[tuple[int, int, list]] = []  # room, number, pieces; by room
        self.count = self.number = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces of filled sequences: doc, start, ids, doc_tokens, sequence, offset."""
        at, total = 0, len(ids)
        while total - at >= self.capacity:
            yield from self._close([(doc, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        if at < total:
            yield from self._put((doc, at, ids[at:], total))

    def _put(self, piece: tuple) -> Iterator[tuple]:
        size = len(piece[2])
        at = bisect.bisect_left(self.waiting, (size,))
        if at < len(self.waiting):
            room, _, held = self.waiting.pop(at)
            yield from self._wait(room - size, [*held, piece])
        elif self.held and len(self.waiting) >= self.held:
            room, _, held = self.waiting.pop(0)  # every room is less than the piece
            doc, start, ids, total = piece
            yield from self._close([*held, (doc, start, ids[:room], total)])
            yield from self._put((doc, start + room, ids[room:], total))
        else:
            k = self.capacity // size
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                del self.open[k]
                yield from self._wait(self.capacity - sum(len(p[2]) for p in held), held)

    def _wait(self, room: int, held: list) -> Iterator[tuple]:
        if room:
            self.number += 1
            bisect.insort(self.waiting, (room, self.number, held))
        else:
            yield from self._close(held)

    def _close(self, held: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in held:
            yield doc, start, ids, total, self.count, offset
            offset += len(ids)
        self.count += 1

    def finish(self) -> Iterator[tuple]:
        """Pieces of the bins still open, cut anew to lengths that are powers of two."""
        held = [p for _, _, own in self.waiting for p in own] + [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[2]) for p in held)
        self.open.clear()
        self.waiting.clear()
        room, offset = 0, 0
        for doc, start, ids, total in held:
            while len(ids):
                if not room:
                    room = min(self.capacity, 1 << (left.bit_length() - 1))
                n = min(room, len(ids))
                yield doc, start, ids[:n], total, self.count, offset
                start, ids, room, left, offset = start + n, ids[n:], room - n, left - n, offset + n
                if not room:
                    self.count, offset = self.count + 1, 0


def _joined(batches: Iterator[pa.RecordBatch], most: int = CHARACTERS) -> Iterator[tuple[list, list]]:
    """Keys and texts of batches until they hold ``most`` bytes: the more at once, the fewer distinct words."""
    keys, texts, held = [], [], 0
    for batch in batches:
        keys += batch.column(0).to_pylist()
        texts += batch.column(1).to_pylist()
        held += batch.column(1).nbytes
        if held >= most:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def pack(
    df: DataFrame,
    path: str,
    pattern: str,
    capacity: int = 2048,
    end_id: int = 1,
    held: int = 64,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids.

    Returns ``key``, start, length, ids_crc32 (of the little-endian unsigned 32-bit ids),
    doc_tokens, sequence_id, offset, all long, and ids array<int> if asked. A document is its
    text's ids and ``end_id``; a null or empty text is ``end_id`` alone; repeated rows are
    packed as often as they come, null keys are kept. Special tokens' names in a text are
    ordinary text. Every worker packs its own partition in one scan: nothing is shuffled, and
    a task that is run again over the same rows gives the same sequences.
    """
    kind = dict(df.dtypes)[key]
    schema = (
        f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    )
    target = _arrow_schema(df.sparkSession, schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        codes, packer = encoder(path, pattern), HarmonicPacker(capacity, held)
        for keys, texts in _joined(batches):
            ids, sizes = codes.encode(texts, quick=True)
            at = 0
            for doc, n in zip(keys, sizes.tolist(), strict=True):
                yield from packer.add(doc, np.append(ids[at : at + n], np.int32(end_id)))
                at += n
        yield from packer.finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << WORKER_BITS
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=target)

        for doc, start, ids, total, sequence, offset in rows(batches):
            row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), total, base + sequence, offset)
            out.append((*row, ids) if with_ids else row)
            if len(out) >= (512 if with_ids else 8192):
                yield batch()
        if out:
            yield batch()

    return mapped(df.select(key, text), run, schema)
