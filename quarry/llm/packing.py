"""Documents packed into sequences of a fixed width by bounded-space best fit.

A task keeps at most n_open windows. A piece goes into the window it fills best; where it fits in none, the fullest one
is closed and a new one opened. A gap above most_gap is filled with the head of the piece that waits, so that whole
documents are cut only there and where they are longer than a sequence. What a task leaves open is merged: the windows of
FAN_IN tasks are taken apart and packed again, longest piece first, until one group is left; what is open then is packed
without gaps, and only the last sequence is short. Leftovers are at most n_open windows a task, so a merging task holds
FAN_IN * n_open windows, whatever the table's size.

Pieces are rows of a written table with their ids; merging reads the open ones alone.

Cases: a null or empty text is its end id alone. Rows without id and rows of one id are packed as rows of their own. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.token_ids import BLOCK, END_ID, TOKENIZER, encoder
from quarry.llm.words import blocks
from quarry.session import ship, stored

WIDTH, N_OPEN, MOST_GAP, FAN_IN = 2048, 64, 16, 64
#: Bytes of ids in a batch of rows.
BATCH = 1 << 22
ROWS = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
    ("part", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("closed", pa.bool_()),
])
ROWS_DDL = "doc_id long, start long, length long, doc_tokens long, ids binary, part long, seq long, offset long, closed boolean"
#: (doc_id, ids of the document before, ids of the document, the piece's ids as little-endian unsigned 32-bit integers)
Piece = tuple[int | None, int, int, bytes]


class Packer:
    """Windows of one task; rows of closed ones gather until they are taken."""

    def __init__(self, part: int, width: int, n_open: int, most_gap: int):
        self.part, self.width, self.n_open, self.most_gap = part, width, n_open, most_gap
        self.gaps: list[tuple[int, int]] = []
        self.windows: dict[int, list[Piece]] = {}
        self.made = self.size = 0
        self.rows: list[tuple] = []

    def close(self, seq: int, pieces: list[Piece], closed: bool = True) -> None:
        offset = 0
        for doc_id, start, tokens, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, tokens, ids, self.part, seq, offset, closed))
            self.size += len(ids)
            offset += n

    def into(self, gap: int, seq: int, piece: Piece) -> None:
        self.windows[seq].append(piece)
        gap -= len(piece[3]) // 4
        if gap:
            insort(self.gaps, (gap, seq))
        else:
            self.close(seq, self.windows.pop(seq))

    def place(self, piece: Piece) -> None:
        """Put a piece of any length into windows."""
        doc_id, start, tokens, ids = piece
        while len(ids) >= 4 * self.width:
            self.close(self.made, [(doc_id, start, tokens, ids[: 4 * self.width])])
            self.made += 1
            start, ids = start + self.width, ids[4 * self.width :]
        while ids:
            at = bisect_left(self.gaps, (len(ids) // 4, -1))
            if at < len(self.gaps):
                return self.into(*self.gaps.pop(at), (doc_id, start, tokens, ids))
            if len(self.gaps) < self.n_open:
                self.windows[self.made] = []
                self.made += 1
                return self.into(self.width, self.made - 1, (doc_id, start, tokens, ids))
            gap, seq = self.gaps.pop(0)
            if gap > self.most_gap:
                self.into(gap, seq, (doc_id, start, tokens, ids[: 4 * gap]))
                start, ids = start + gap, ids[4 * gap :]
            else:
                self.close(seq, self.windows.pop(seq))
        return None

    def leave(self) -> None:
        """Rows of what is open, as open windows."""
        for _, seq in self.gaps:
            self.close(seq, self.windows.pop(seq), closed=False)
        self.gaps = []

    def finish(self) -> None:
        """Close all: windows with more than most_gap free are packed anew, one behind the other."""
        again = []
        for gap, seq in self.gaps:
            pieces = self.windows.pop(seq)
            if gap > self.most_gap:
                again += pieces
            else:
                self.close(seq, pieces)
        self.gaps, self.n_open, self.most_gap = [], 1, 0
        for piece in again:
            self.place(piece)
        for _, seq in self.gaps:
            self.close(seq, self.windows.pop(seq))
        self.gaps = []

    def taken(self) -> pa.RecordBatch:
        rows, self.rows, self.size = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)


def pack_documents(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int, n_open: int, most_gap: int) -> Iterator[pa.RecordBatch]:
    enc, packer = encoder(path), Packer(TaskContext.get().partitionId(), width, n_open, most_gap)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in blocks(texts, BLOCK):
            for doc_id, ids in zip(doc_ids[a:b], enc.encode(texts[a:b]), strict=True):
                ids = np.frombuffer(ids, enc.dtype).astype("<u4").tobytes() + end
                packer.place((doc_id, 0, len(ids) // 4, ids))
                if packer.size >= BATCH:
                    yield packer.taken()
    packer.leave()
    if packer.rows:
        yield packer.taken()


def merging(last: bool, width: int, n_open: int, most_gap: int) -> Callable:
    """A function of the open windows of a group of tasks: they are packed again by decreasing length."""

    def merge(key, table):
        packer = Packer(key[0].as_py(), width, n_open, most_gap)
        rows = list(zip(*(table.column(c).to_pylist() for c in ("length", "part", "seq", "offset", "doc_id", "start", "doc_tokens", "ids")), strict=True))
        for *_, doc_id, start, tokens, ids in sorted(rows, key=lambda r: (-r[0], *r[1:4])):
            packer.place((doc_id, start, tokens, ids))
        if last:
            packer.finish()
        else:
            packer.leave()
        return pa.Table.from_batches([packer.taken()])

    return merge


def pack(docs: DataFrame, path: str, end_id: int = END_ID, width: int = WIDTH, n_open: int = N_OPEN, most_gap: int = MOST_GAP) -> DataFrame:
    """A row a piece: doc_id, start and length in its document, doc_tokens, ids (binary), sequence_id, offset in the sequence.

    docs has doc_id and text. Sequence ids are distinct; their bits are the level of merging, the task and its count.
    """
    ship(docs.sparkSession)
    how = {"width": width, "n_open": n_open, "most_gap": most_gap}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(docs.mapInArrow(partial(pack_documents, path=path, end_id=end_id, **how), ROWS_DDL), "packed")
    parts = rows.where("not closed").agg((F.max("part") + 1).alias("n")).first()["n"] or 0
    levels = [rows]
    while parts:
        last = parts <= FAN_IN
        group = F.floor(F.col("part") / FAN_IN).alias("group")
        levels.append(stored(levels[-1].where("not closed").groupBy(group).applyInArrow(merging(last, **how), ROWS_DDL), "packed-merged"))
        parts = 0 if last else -(-parts // FAN_IN)
    ids = [(F.lit(k << 56) + F.shiftleft("part", 32) + F.col("seq")).alias("sequence_id") for k in range(len(levels))]
    return reduce(DataFrame.unionByName, [df.where("closed").select("doc_id", "start", "length", "doc_tokens", "ids", i, "offset") for df, i in zip(levels, ids, strict=True)])


def op12_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(docs, public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
