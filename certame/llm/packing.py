"""Packing of token ids into windows by multiway Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from certame.llm.kernels import list_array, text_slices
from certame.llm.tokens import default_tokenizer, encoder

SEQUENCE = 1024
#: What is left of a document after its full windows is cut to pieces of so many tokens at most.
PIECE = 256
#: Pieces that are packed together.
GROUP_PIECES = 2048
SEPARATOR = 0


def _merge(a: tuple, b: tuple, ways: int) -> tuple:
    """The largest ways of one partition meet the smallest of the other.

    A partition is (sums in descending order, members of each way), of its non-empty ways only.
    """
    (x, m), (y, n) = a, b
    room = ways - len(x)
    if len(y) <= room:  # each meets an empty way
        sums, members = np.concatenate([x, y]), m + n
    else:
        meet = len(y) - room  # so many ways of y must share
        sums = x.copy()
        sums[len(x) - meet :] += y[room:][::-1]
        members = m[: len(x) - meet] + [p + q for p, q in zip(m[len(x) - meet :], n[room:][::-1], strict=True)]
        sums, members = np.concatenate([sums, y[:room]]), members + n[:room]
    order = np.argsort(-sums, kind="stable")
    return sums[order], [members[i] for i in order]


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Deals items into `ways` groups of nearly equal sums: the two partial partitions of the largest imbalance merge, again and again.

    Ties go to the earlier partition. Returns the item numbers of each non-empty group.
    """
    if not sizes:
        return []
    spread = lambda sums: int(sums[0]) - (int(sums[-1]) if len(sums) == ways else 0)
    heap = [(-s, i, (np.array([s], dtype=np.int64), [[i]])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    last = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a[0]) < len(b[0]):
            a, b = b, a
        merged = _merge(a, b, ways)
        heapq.heappush(heap, (-spread(merged[0]), last, merged))
        last += 1
    return heap[0][2][1]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the lower bound upwards, whose differencing keeps within capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, ways)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        ways += max(1, ways // 256)


def cut(length: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length): full windows, then the rest in pieces of nearly equal length."""
    full, rest = divmod(length, capacity)
    out = [(k * capacity, capacity) for k in range(full)]
    parts = -(-rest // piece)
    at = full * capacity
    for k in range(parts):
        n = rest // parts + (k < rest % parts)
        out.append((at, n))
        at += n
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, sequence: int = SEQUENCE, piece: int = PIECE, group: int = GROUP_PIECES, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Token sequences of at most `sequence` ids from the texts of docs (doc_id, text).

    One row for each piece: its document, where it starts there, its ids, the sequence and the place in it.
    A task packs the pieces that it has read, `group` at a time, so nothing is shuffled and
    memory stays bounded; sequence ids carry the partition's number. Null text counts as
    empty: its only id is the separator. A null doc_id stays null; repeated rows are
    packed each. Sequences hold no padding ids; a reader pads them to `sequence`. A text of any length is cut into pieces; an empty table
    gives no rows; pieces of equal size may stand in either order; other columns, whatever their names, are left aside.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, sequence_id = encoder(path).encode, TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []  # (doc, start, doc_tokens, ids)

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, whole, ids, at, offset = zip(*rows, strict=True)
            size = [len(x) for x in ids]
            return pa.record_batch(
                [
                    pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(whole, pa.int64()), pa.array(at, pa.int64()), pa.array(offset, pa.int64()),
                    list_array(np.concatenate(ids).astype(np.int32), np.append(0, np.cumsum(size)), pa.int32()) if keep_ids else pa.nulls(len(ids), pa.list_(pa.int32())),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        def flush(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence_id
            rows = []
            for window in windows([len(p[3]) for p in pieces], sequence):
                offset = 0
                for i in sorted(window):
                    rows.append((*pieces[i], sequence_id, offset))
                    offset += len(pieces[i][3])
                sequence_id += 1
            if rows:
                yield emit(rows)

        for batch, data, at in text_slices(batches):
            ids, first = encode(data, at)
            rows = []
            for doc, lo, hi in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.append(ids[lo:hi], np.uint32(SEPARATOR)).astype("<u4")
                for start, n in cut(len(own), sequence, piece):
                    if n == sequence:
                        rows.append((doc, start, len(own), own[start : start + n], sequence_id, 0))
                        sequence_id += 1
                    else:
                        waiting.append((doc, start, len(own), own[start : start + n].copy()))
            if rows:
                yield emit(rows)
            while len(waiting) >= group:
                yield from flush(waiting[:group])
                del waiting[:group]
        yield from flush(waiting)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
