"""Cost-balanced packing of documents into token sequences.

Attention over a packed sequence costs ``linear * tokens + quadratic * sum(piece length ** 2)``,
each piece attending to itself.  The packer takes the pieces in descending length and gives
each to the sequence of lowest cost so far that still has room for it.

Method: packing needs no shuffle.  Each task packs the documents of its own partition, a
block of ``BLOCK_IDS`` ids at a time, so memory is bounded and a lost task is simply run
again.  A block of T ids gets T // capacity whole sequences, and for the rest of T one
sequence for each power of two in it: lengths that need no padding.  Documents longer than
a sequence first fill whole sequences; the last piece of each goes through the agenda.
Only when no sequence has room for a piece is it cut, at the roomiest (the cheapest of
equals), and its rest is dealt like any piece.  Total room equals T, so every block is
packed without padding.

Defined cases: a null text is empty (its document is its end id alone); repeated ids are
separate documents; an empty table gives no pieces; an extremely long text makes a block
of its own.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lean
from ._tokens import BlockEncoder, crc32, text_blocks, with_end

#: Ids that one block of packing holds.
BLOCK_IDS = 2_000_000
#: Sequence numbers of one partition; partition p counts from p * SEQUENCES_A_PART.
SEQUENCES_A_PART = 1 << 36
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE_WITH_IDS = PIECE + ", input_ids array<int>"


def room_for(total: int, capacity: int) -> list[int]:
    """Lengths of sequences that hold ``total`` ids without padding: whole ones, then powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Packs documents of these lengths: (document, start, length, sequence, offset) of each piece.

    Every sequence is filled to its length from ``room_for``.
    """
    lengths = [int(x) for x in lengths]
    room = room_for(sum(lengths), capacity)
    cost, pieces = [0.0] * len(room), []
    filled = [0] * len(room)

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, filled[seq]))
        filled[seq] += n
        cost[seq] += linear * n + quadratic * n * n

    seq, rests = 0, []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            put(doc, start, capacity, seq)
            seq += 1
        if n % capacity:
            rests.append((n % capacity, doc))
    # the sequences that aren't whole: their cost so far and the room that is left
    so_far, left = np.zeros(len(room) - seq), np.array(room[seq:], np.int64)
    for n, doc in sorted(rests, key=lambda x: (-x[0], x[1])):
        start = lengths[doc] - n
        while n:
            k = int(np.where(left >= n, so_far, np.inf).argmin())
            if left[k] < n:  # none has room
                k = int(np.where(left == left.max(), so_far, np.inf).argmin())
            take = min(n, int(left[k]))
            put(doc, start, take, seq + k)
            so_far[k], left[k] = cost[seq + k], left[k] - take
            start, n = start + take, n - take
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (``PIECE``, or ``PIECE_WITH_IDS``), packed partition by partition."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockEncoder.of(tokenizer)
        sequence = TaskContext.get().partitionId() * SEQUENCES_A_PART

        def close(names: list, texts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal sequence
            pieces = pack([len(x) for x in texts], capacity)
            pieces.sort(key=lambda x: (x[3], x[4]))
            doc, start, n, seq, offset = zip(*pieces)
            parts = [texts[d][a : a + k] for d, a, k in zip(doc, start, n)]
            columns = [
                pa.array([names[d] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(map(crc32, parts), pa.int64()),
                pa.array([len(texts[d]) for d in doc], pa.int64()), pa.array([sequence + s for s in seq], pa.int64()), pa.array(offset, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32))))
            sequence += seq[-1] + 1
            return pa.record_batch(columns, names=[x.split()[0] for x in (PIECE_WITH_IDS if with_ids else PIECE).split(", ")])

        names, texts, held = [], [], 0
        for batch in batches:
            for i, j, data, starts in text_blocks(batch.column(1)):
                ids, bounds = with_end(*coder.encode(data, starts), end_id)
                names += batch.column(0).slice(i, j - i).to_pylist()
                texts += [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield close(names, texts)
                    names, texts, held = [], [], 0
        if texts:
            yield close(names, texts)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return rows.mapInArrow(lean(packed), PIECE_WITH_IDS if with_ids else PIECE)
