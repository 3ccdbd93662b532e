"""Documents packed into training sequences of several context sizes.

A document's ids are cut into whole windows of the longest size, and its tail is routed to the shortest tier
that holds it. Each tier is packed on its own: a tail opens a window of its tier, and its gap is filled from the
shorter tiers, the longest tail that fits first; only where none fits is a shorter tail cut to close the
gap. What is left at the end is cut into windows of powers of two. No window but those is shorter than its
tier, and none has padding. Windows of equal size go to step groups of equal numbers of ids.

Packing is local to the task that encodes the documents: ids never cross the network, memory holds
one batch of documents and a bounded number of tails, and a task that runs again packs the same way.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.tokens import encoder

TIERS = (128, 256, 512, 1024)
STEP_IDS = 1 << 16
# tails held back at once in a task; the longest ones go first when there are more
_HELD = 8192
_TASK_BITS = 40

Piece = tuple[object, int, np.ndarray, int]  # document, first id's place, ids, the document's length


class Packer:
    """Packs a stream of documents' ids; ``take`` returns what has been placed since."""

    def __init__(self, tiers: Sequence[int] = TIERS, step_ids: int = STEP_IDS, held: int = _HELD):
        self.tiers, self.step_ids, self.held = sorted(tiers), step_ids, held
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two")
        self._tails: list[list[tuple[int, int, Piece]]] = [[] for _ in self.tiers]  # by length, then by arrival
        self._count = self._arrived = self._sequences = 0
        self._ids: dict[int, int] = {}  # of a tier's windows so far
        self._rows: list[tuple] = []

    def add(self, document: object, ids: np.ndarray) -> None:
        top = self.tiers[-1]
        whole = len(ids) - len(ids) % top
        for start in range(0, whole, top):
            self._window([(document, start, ids[start : start + top], len(ids))])
        if whole < len(ids):
            self._keep((document, whole, ids[whole:].copy(), len(ids)))
        if self._count > self.held:
            self._pack(self.held // 2)

    def finish(self) -> None:
        self._pack(0)

    def take(self) -> list[tuple]:
        rows, self._rows = self._rows, []
        return rows

    def _keep(self, piece: Piece) -> None:
        tier = bisect_left(self.tiers, len(piece[2]))
        self._arrived += 1
        insort(self._tails[tier], (len(piece[2]), self._arrived, piece))
        self._count += 1

    def _taken(self, most: int, tiers: int) -> Piece | None:
        """The longest tail of up to ``most`` ids in the shortest ``tiers`` tiers."""
        for tails in reversed(self._tails[:tiers]):
            at = bisect_left(tails, (most + 1,))
            if at:
                self._count -= 1
                return tails.pop(at - 1)[2]
        return None

    def _cut(self, size: int, tiers: int) -> Piece | None:
        """``size`` ids off the shortest tail that is longer; its rest is kept."""
        for tails in self._tails[:tiers]:
            if tails and tails[-1][0] > size:
                self._count -= 1
                document, start, ids, total = tails.pop(bisect_left(tails, (size + 1,)))[2]
                self._keep((document, start + size, ids[size:], total))
                return document, start, ids[:size], total
        return None

    def _pack(self, left: int) -> None:
        """Fill windows until at most ``left`` tails wait; the longest tier goes first."""
        while self._count > left:
            tier = max(i for i, tails in enumerate(self._tails) if tails)
            pieces, gap = [], self.tiers[tier]
            while gap:
                piece = self._taken(gap, tier + 1) or self._cut(gap, tier + 1)
                if piece is None:
                    break
                pieces.append(piece)
                gap -= len(piece[2])
            if not gap:
                self._window(pieces)
                continue
            # nothing waits any more: what there is becomes windows of powers of two
            size = self.tiers[tier] - gap
            while pieces:
                fit, room = [], 1 << (size.bit_length() - 1)
                size -= room
                while room:
                    document, start, ids, total = pieces.pop(0)
                    if len(ids) > room:
                        pieces.insert(0, (document, start + room, ids[room:], total))
                        ids = ids[:room]
                    fit.append((document, start, ids, total))
                    room -= len(ids)
                self._window(fit)

    def _window(self, pieces: list[Piece]) -> None:
        size = sum(len(p[2]) for p in pieces)
        done = self._ids.get(size, 0)
        self._ids[size] = done + size
        offset = 0
        for document, start, ids, total in pieces:
            self._rows.append((document, start, ids, total, self._sequences, offset, size, done // self.step_ids))
            offset += len(ids)
        self._sequences += 1


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 0,
    tiers: Sequence[int] = TIERS,
    step_ids: int = STEP_IDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: the id column, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``,
    ``sequence_length``, ``step_group``, and ``ids`` if wanted.

    ``tokenizer`` is the path of a file for the tokenizers library that every executor has; ``end_id`` follows each document
    unless None. A null text counts as empty, so it is a document of the end id alone (of no ids, and so of no
    rows, without one). Rows that repeat an id are documents of their own, a null id stays null. A long document spans
    several sequences. An empty table gives no rows. Other columns are not looked at. Sequences are numbered within a
    task, with the task's number above bit 40; steps group windows of one size up to ``step_ids`` ids.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    docs = docs.withColumn("task", F.spark_partition_id())
    end = np.array([] if end_id is None else [end_id], dtype="<u4")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = Packer(tiers, step_ids), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(2)[0].as_py() << _TASK_BITS
            ids, bounds = encoder(tokenizer).encode(batch.column(1))
            for row, name in enumerate(batch.column(0).to_pylist()):
                packer.add(name, np.concatenate([ids[bounds[row] : bounds[row + 1]], end]))
            yield placed(packer.take(), task)
        packer.finish()
        yield placed(packer.take(), task)

    def placed(rows: list[tuple], task: int) -> pa.RecordBatch:
        names, starts, ids, totals, sequences, offsets, sizes, steps = zip(*rows, strict=True) if rows else [()] * 8
        sequences = np.array(sequences, dtype=np.int64) + task
        steps = (np.array(sizes, dtype=np.int64) << 24) + np.array(steps, dtype=np.int64) + task
        columns = [
            pa.array(names, id_type),
            pa.array(starts, pa.int64()),
            pa.array(map(len, ids), pa.int64()),
            pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
            pa.array(totals, pa.int64()),
            pa.array(sequences),
            pa.array(offsets, pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array(steps),
        ]
        if with_ids:
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32)), pa.array(flat)))
        return pa.RecordBatch.from_arrays(columns, schema.names)

    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")
    fields = [T.StructField("id", docs.schema["id"].dataType), *(T.StructField(name, T.LongType()) for name in longs)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(fields[0].dataType)
    return docs.mapInArrow(packed, schema).withColumnRenamed("id", id_column)
