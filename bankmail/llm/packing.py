"""Packing of documents into sequences, online, in bounded space.

Each input partition is packed as it is read: a document is encoded, its whole windows of
`length` ids leave at once, and what remains of it is placed best-fit into one of a fixed number
of open windows. When none fits, the fullest window is filled up with the first ids of the piece,
leaves, and the rest of the piece is placed on. At its end a partition joins its open windows, so
that less than one window is left of it; these leftovers, with their ids, are merged
group by group (GROUP partitions in one) until one is left of all. No task holds more than the open
windows, a batch of texts, or GROUP leftovers, and documents are never shuffled.

The packed table is written once to the shared folder: a lost executor repeats only its
partitions, and the merge does not encode again. Ids below 65,536, as of a vocabulary of that size, are written as 16-bit numbers. Who
wants their checksum only (`checksum=True`) has it taken in the task; then just leftovers' ids are written.

Defined cases: a null text counts as empty and still gives its end id. Rows with equal or null
ids are packed as rows of their own. Very long documents are cut into many windows. An
empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bankmail.llm.base import bounded_batches, materialize
from bankmail.llm.hashing import portions
from bankmail.llm.tokens import encoder, id_width, vocabulary

LENGTH, OPEN, GROUP, END = 1024, 64, 256, 0
PIECES = "id {id}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long"
_FIELDS = ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Open windows of one partition. A piece is (id, start, ids as bytes, doc_tokens); an id takes `width` bytes."""

    def __init__(self, length: int, windows: int, first_id: int, width: int = 4):
        self.length, self.most, self.next, self.width = length, windows, first_id, width
        self.fill: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}
        self.opened = 0
        self.done: list[tuple] = []

    def _leave(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // self.width
            self.done.append((doc, start, n, ids, total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, window = len(ids) // self.width, self.width * self.length
        whole = len(ids) - len(ids) % window
        for at in range(0, whole, window):
            self._leave([(doc, at // self.width, ids[at : at + window], total)])
        if whole < len(ids):
            self.place(doc, whole // self.width, ids[whole:], total)

    def place(self, doc, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // self.width
        at = bisect_right(self.fill, (self.length - n, self.opened)) - 1
        if at >= 0:
            fill, w = self.fill.pop(at)
        elif len(self.fill) < self.most:
            fill, w = 0, self.opened
            self.opened += 1
            self.pieces[w] = []
        else:
            fill, w = self.fill.pop()
            gap = self.width * (self.length - fill)
            self._leave([*self.pieces.pop(w), (doc, start, ids[:gap], total)])
            return self.place(doc, start + gap // self.width, ids[gap:], total)
        self.pieces[w].append((doc, start, ids, total))
        if fill + n == self.length:
            self._leave(self.pieces.pop(w))
        else:
            insort(self.fill, (fill + n, w))

    def rest(self) -> list[tuple]:
        """Joins the open windows, fullest first; what is left is shorter than one window."""
        left = [p for _, w in reversed(self.fill) for p in self.pieces[w]]
        self.fill, self.pieces = [], {}
        return self.joined(left)

    def joined(self, pieces: list[tuple]) -> list[tuple]:
        now, room = [], self.length
        for doc, start, ids, total in pieces:
            while len(ids) // self.width >= room:
                cut = self.width * room
                self._leave([*now, (doc, start, ids[:cut], total)])
                start, ids, now, room = start + room, ids[cut:], [], self.length
            if ids:
                now.append((doc, start, ids, total))
                room -= len(ids) // self.width
        return now

    def taken(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def _wide(ids: bytes, width: int) -> bytes:
    """Ids as 32-bit numbers."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _rows(kind: pa.DataType, done: list[tuple], left: list[tuple], part: int, width: int, checksum: bool) -> pa.Table:
    """Pieces that have their place with part -1, and the pieces left over with their partition."""
    rows = []
    for doc, start, n, ids, total, sequence, offset in done:
        crc = zlib.crc32(_wide(ids, width)) if checksum else None
        rows.append((doc, start, n, None if checksum else ids, crc, total, sequence, offset, -1))
    at = 0
    for doc, start, ids, total in left:
        rows.append((doc, start, len(ids) // width, ids, None, total, -1, at, part))
        at += 1
    long = pa.int64()
    types = [kind, long, long, pa.binary(), long, long, long, long, long]
    names = [*_FIELDS[:4], "ids_crc32", *_FIELDS[4:], "part"]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _merger(kind: pa.DataType, length: int, level: int, last: bool, width: int, checksum: bool):
    def merged(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        packer = Packer(length, 0, (level << 59) + (part << 32), width)
        group = group.sort_by([("part", "ascending"), ("offset", "ascending")])
        left = packer.joined(list(zip(*(group.column(c).to_pylist() for c in ("id", "start", "ids", "doc_tokens")), strict=True)))
        if last and left:
            packer._leave(left)
            left = []
        return _rows(kind, packer.taken(), left, part, width, checksum)

    return merged


def pack(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, windows: int = OPEN,
    ids_of: Callable[[str], bytes] | None = None, path: str | None = None, checksum: bool = False,
) -> DataFrame:
    """A row for each piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    `path` is a `.tiktoken` file (byte_bpe_50k by default); `ids_of` replaces the encoder and gives 32-bit ids. With `checksum`,
    ids_crc32 (of the same bytes) stands in place of ids.
    """
    path = path or vocabulary()
    width = 4 if ids_of else id_width(path)
    field = docs.schema[id].dataType
    schema, kind = PIECES.format(id=field.simpleString()), to_arrow_type(field)
    end = np.array([END], np.uint32).tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = ids_of or encoder(path).ids, TaskContext.get().partitionId()
        packer = Packer(length, windows, part << 32, width)
        for batch in portions(batches, size=1 << 20):
            for doc, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(t) + end
                packer.add(doc, ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
            yield from _rows(kind, packer.taken(), [], part, width, checksum).to_batches()
        left = packer.rest()
        yield from _rows(kind, packer.taken(), left, part, width, checksum).to_batches()

    rows = bounded_batches(docs).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = materialize(rows.mapInArrow(packed, schema), "packed")
    results, left, level = [first.where("part < 0")], first.where("part >= 0"), 0
    while True:
        level += 1
        groups = left.agg(F.max("part")).first()[0]
        if groups is None:
            break
        last = groups < GROUP
        merge = left.groupBy(F.expr(f"part div {GROUP}")).applyInArrow(_merger(kind, length, level, last, width, checksum), schema)
        step = materialize(merge, "merged")
        results.append(step.where("part < 0"))
        if last:
            break
        left = step.where("part >= 0")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    content = "ids_crc32" if checksum else "ids"
    if width == 2 and not checksum:

        def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = pa.array([_wide(x, width) for x in batch.column("ids").to_pylist()], pa.binary())
                yield batch.set_column(batch.schema.get_field_index("ids"), "ids", ids)

        out = out.mapInArrow(widened, schema)
    return out.select(F.col("id").alias(id), "start", "length", content, "doc_tokens", "sequence_id", "offset")
