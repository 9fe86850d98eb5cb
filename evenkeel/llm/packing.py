"""Packing of token sequences with a bounded number of open windows.

Each partition keeps a fixed number of windows open. A document's ids are cut into full windows and a
rest; the rest goes to the open window that it fills best. When none has room the fullest is
emitted, topped up with the head of the rest if more than a few places would stay empty. What is left open at
the end of each partition is merged: neighbouring partitions' leftovers are packed again, level by level, until one group
is left. A task never holds more than its open windows.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed each; null ids
stay null; an empty table gives no pieces; other columns play no part.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.encode import encoder
from evenkeel.llm.frames import batch, id_and_text, map_batches, schema_of
from evenkeel.llm.words import blocks
from evenkeel.session import materialise

LENGTH = 2048
OPEN = 64
MOST_EMPTY = 8
#: Partitions whose leftovers one task packs again.
MERGED = 32
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, task bigint"
)


@dataclass
class _Window:
    free: int
    pieces: list = field(default_factory=list)


class Packer:
    """Best fit into a bounded number of open windows. Pieces are (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, length: int, most_open: int, most_empty: int):
        self.length, self.most_open, self.most_empty = length, most_open, most_empty
        self.order: list[tuple[int, int]] = []  # (free, number), ascending
        self.windows: dict[int, _Window] = {}
        self.number = 0

    def _put(self, key: tuple[int, int], piece) -> list:
        """Put a piece that fits into an open window; the window's pieces if it is full now."""
        self.order.remove(key)
        w = self.windows[key[1]]
        w.pieces.append(piece)
        w.free -= len(piece[2]) // 4
        if w.free:
            bisect.insort(self.order, (w.free, key[1]))
            return []
        return [self.windows.pop(key[1]).pieces]

    def _emit_fullest(self) -> list:
        return self.windows.pop(self.order.pop(0)[1]).pieces

    def add(self, doc, start: int, ids: bytes, total: int) -> list:
        """Pieces of the windows that this document closes."""
        closed, at, n = [], 0, len(ids) // 4
        while n - at >= self.length:
            closed.append([(doc, start + at, ids[4 * at : 4 * (at + self.length)], total)])
            at += self.length
        while at < n:
            rest = n - at
            k = bisect.bisect_left(self.order, (rest, -1))
            if k < len(self.order):
                closed += self._put(self.order[k], (doc, start + at, ids[4 * at :], total))
                break
            if len(self.order) < self.most_open:
                self.number += 1
                self.windows[self.number] = _Window(self.length - rest, [(doc, start + at, ids[4 * at :], total)])
                bisect.insort(self.order, (self.length - rest, self.number))
                break
            free, _ = self.order[0]
            if free > self.most_empty:
                closed += self._put(self.order[0], (doc, start + at, ids[4 * at : 4 * (at + free)], total))
                at += free
            else:
                closed.append(self._emit_fullest())
        return closed

    def left(self) -> list:
        """The windows still open, fullest first."""
        return [self.windows[k].pieces for _, k in self.order]


def _rows(windows: list, first: int, with_ids: bool, task: int) -> list[list]:
    """Columns of PIECES; windows are numbered from first."""
    out: list[list] = [[] for _ in range(9)]
    for k, pieces in enumerate(windows):
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            row = (doc, start, n, zlib.crc32(ids), total, first + k, at, ids if with_ids else None, task if with_ids else None)
            for column, x in zip(out, row):
                column.append(x)
            at += n
    return out


def _first_pass(docs: DataFrame, tokenizer: str, end_id: int, length: int, most_open: int, most_empty: int) -> DataFrame:
    end = struct.pack("<I", end_id)

    def pack(batches):
        task, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        packer, number = Packer(length, most_open, most_empty), task << 32
        for b in batches:
            own, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in blocks(texts):
                closed = []
                for doc, data in zip(own[part], enc.encode(texts[part])):
                    data += end
                    closed += packer.add(doc, 0, data, len(data) // 4)
                yield _rows(closed, number, False, task)
                number += len(closed)
        yield _rows(packer.left(), number, True, task)

    return map_batches(docs, pack, PIECES)


def _merging(base: int, last: bool, length: int, most_open: int):
    """Packs a group's leftovers again; numbers start at base, and the last group keeps nothing open."""
    kind = schema_of(PIECES)

    def merge(key, table):
        group = key[0].as_py()
        number = base + (group << 32)
        packer, closed = Packer(length, most_open, 0), []
        for r in sorted(table.to_pylist(), key=lambda r: (-r["length"], r["sequence_id"], r["offset"])):
            closed += packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        # What is still open is poured together; one window at most stays unfilled.
        pour = Packer(length, 1, 0)
        for pieces in packer.left():
            for p in pieces:
                closed += pour.add(*p)
        parts = [_rows(closed, number, False, group), _rows(pour.left(), number + len(closed), not last, group)]
        return pa.Table.from_batches([batch(kind, p) for p in parts])

    return merge


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, most_open: int = OPEN, most_empty: int = MOST_EMPTY
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece."""
    first = materialise(_first_pass(id_and_text(docs), tokenizer, end_id, length, most_open, most_empty), "pieces")
    done, left, level = [first.where("ids is null")], first.where("ids is not null"), 0
    tasks = left.agg(F.max("task")).first()[0]
    kind = schema_of(PIECES)
    while tasks is not None:
        level += 1
        groups = tasks // MERGED + 1
        base, last = level << 56, groups == 1

        grouped = left.withColumn("g", F.expr(f"task div {MERGED}")).groupBy("g").applyInArrow(_merging(base, last, length, most_open), kind)
        merged = materialise(grouped, "merged")
        done.append(merged.where("ids is null"))
        left, tasks = merged.where("ids is not null"), None if last else groups - 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("ids", "task")
