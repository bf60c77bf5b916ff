"""Packing of token ids into windows by sum-of-squares online placement.

Each document's ids (with an end id) are cut into full windows and one remainder. A remainder goes to
the fill level that makes the sum over levels of (number of windows partially filled to it) squared
smallest; the counts stand in a level array. Every scan partition packs on its own: nothing is shuffled. When it ends,
and whenever MOST_OPEN windows are open (that bounds a task's memory to 4 * window * MOST_OPEN bytes), the open ones are settled:
the emptiest window is taken apart and its pieces, the longest first, are placed into the others by the same rule; a piece that fits
nowhere is cut to fill the emptiest of them. At most one window of a partition stays partially filled.

Defined results: a null or empty text has its end id only; an empty table gives no rows; repeated rows
are packed each on its own; of equally good levels the fullest is taken; a very long text gives full windows and one
remainder; doc_ids keep their type, null ones too; other columns are left out.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import prepare, text_or_empty

WINDOW, END_ID = 1024, 0
#: Open windows above which a packer settles them, so that its memory is bounded.
MOST_OPEN = 8192
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Pieces are (doc, start, ids as bytes, tokens of the document); closed: rows of windows that are done."""

    def __init__(self, window: int, base: int, kind: pa.DataType | None = None):
        self.window, self.next_id, self.kind = window, base, kind or pa.int64()
        self.count = np.zeros(window + 1, dtype=np.int64)  # the level array
        self.open: list[deque] = [deque() for _ in range(window)]
        self.closed: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.closed.append((doc, start, n, ids, total, self.next_id, at))
            at += n
        self.next_id += 1

    def level(self, size: int, new: bool = True) -> int:
        """The level to which a piece of so many tokens is added; 0: a new window, or with new=False none."""
        levels = np.flatnonzero(self.count[1 : self.window - size + 1]) + 1
        if not len(levels):
            return 0
        after = levels + size
        change = 2 * (self.count[after] - self.count[levels]) + 2
        change[after == self.window] -= 1  # a full window isn't counted any more
        best = len(levels) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if not new or change[best] <= 2 * self.count[size] + 1 else 0

    def _put(self, level: int, piece: tuple) -> None:
        """Add a piece to a window of this level (0: a new one)."""
        pieces = []
        if level:
            pieces = self.open[level].popleft()
            self.count[level] -= 1
        pieces.append(piece)
        level += len(piece[2]) // 4
        if level == self.window:
            self._close(pieces)
        else:
            self.open[level].append(pieces)
            self.count[level] += 1

    def add(self, doc, ids: bytes) -> None:
        total, width = len(ids) // 4, 4 * self.window
        whole = len(ids) - len(ids) % width
        for at in range(0, whole, width):
            self._close([(doc, at // 4, ids[at : at + width], total)])
        if whole == len(ids):
            return
        rest = (doc, whole // 4, ids[whole:], total)
        self._put(self.level(len(rest[2]) // 4), rest)
        if self.count.sum() > MOST_OPEN:
            self.settle(last=False)

    def settle(self, last: bool = True) -> None:
        """Close the open windows but one: the emptiest is taken apart and its pieces, the longest first, go to the others."""
        while self.count[: self.window].sum() > 1:
            low = int(np.flatnonzero(self.count[: self.window])[0])
            pieces = sorted(self.open[low].popleft(), key=lambda p: len(p[2]))
            self.count[low] -= 1
            while pieces:
                doc, start, ids, total = pieces.pop()
                levels = np.flatnonzero(self.count[: self.window])
                if not len(levels):  # nothing else is open any more
                    self._put(0, (doc, start, ids, total))
                    for piece in reversed(pieces):
                        self._put(int(np.flatnonzero(self.count[: self.window])[0]), piece)
                    break
                level = self.level(len(ids) // 4, new=False)
                if not level:  # cut: it fills the emptiest, the rest of it is placed next
                    level = int(levels[0])
                    room = self.window - level
                    pieces.append((doc, start + room, ids[4 * room :], total))
                    ids = ids[: 4 * room]
                self._put(level, (doc, start, ids, total))
        if last:
            for level in self.open:
                while level:
                    self._close(level.popleft())
            self.count[:] = 0

    def rows(self) -> pa.RecordBatch:
        done, self.closed = self.closed, []
        kinds = (self.kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece; ids: the piece's token ids as little-endian unsigned 32-bit integers.

    Pieces of one sequence_id fill offsets from 0 on without gaps.
    """
    prepare(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def pack(batches):
        encoder = tokens.encoder(tokenizer, glue=True)
        base, packer = TaskContext.get().partitionId() << 36, None
        for batch in batches:
            packer = packer or Packer(window, base, batch.column(0).type)
            ids = encoder.encode_all(batch.column(1).to_pylist())
            for doc, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                packer.add(doc, x + end)
            yield packer.rows()
        if packer:
            packer.settle()
            yield packer.rows()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(pack, f"doc_id {id_type}, {SCHEMA}")


def op4_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, tokens.default_path("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
