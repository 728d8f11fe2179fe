"""Token-ID output: Arrow files of equal-length sequences and masks.

``write_token_files`` encodes documents in ascending ``doc_id`` order into Arrow IPC files
(the stream format with a footer of batch offsets, so that any batch is found at once).
Each row of a file is one sequence: ``input_ids``, a fixed-size list of ``seq_len`` ids,
and ``mask``, as many booleans.  Only a file's last sequence is padded.  ``TokenFile``
memory-maps such a file and hands out any sequence or any range of ids without a copy.

Method: the documents are range-partitioned by id, hash of the text and place in the input
(one shuffle of the texts; a third of all rows may share an id) and sorted in each partition; each task encodes its partition block by block and writes one file and one
index of its documents.  A task names its files afresh at each attempt and the manifest, a
written table of one row per file, holds the names of the attempts that succeeded, so lost
executors and repeated attempts leave no wrong file behind.  Readers get one file per task.

Defined cases: a null text is empty (its document has the end id alone); null ids come
first; rows with equal ids are kept, in the order of their texts' hashes (``docs`` is a table or
anything else that gives its rows in one order, should a task run again); an empty table gives an
empty manifest; other columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import filesystem, lean, open_random, shuffle_partitions, work_dir, written
from ._tokens import BlockEncoder, text_blocks, with_end

MANIFEST = "part int, file string, index_file string, n_docs long, n_ids long, n_sequences long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, file_start long"
#: Sequences in one record batch.
BATCH_SEQUENCES = 256
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def id_type(vocab_size: int) -> pa.DataType:
    return pa.uint16() if vocab_size <= 1 << 16 else pa.uint32()


class _Writer:
    """One task's token file: takes ids in any portions, writes whole batches of sequences."""

    def __init__(self, uri: str, seq_len: int, kind: pa.DataType):
        fs, path = filesystem(uri)
        self.seq_len, self.kind = seq_len, kind
        self.schema = pa.schema([("input_ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        full = BATCH_SEQUENCES * self.seq_len
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            whole = len(flat) // full * full
            for i in range(0, whole, full):
                self._batch(flat[i : i + full], full)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _batch(self, ids: np.ndarray, n_real: int) -> None:
        mask = np.arange(len(ids)) < n_real
        lists = [pa.FixedSizeListArray.from_arrays(x, self.seq_len) for x in (pa.array(ids, self.kind), pa.array(mask))]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += len(lists[0])

    def close(self) -> None:
        flat = np.concatenate([*self.held, np.zeros(0, np.uint32)])
        if n := len(flat):
            self._batch(np.concatenate([flat, np.zeros(-n % self.seq_len, np.uint32)]), n)
        self.file.close()
        self.sink.close()


class TokenFile:
    """Random access to a token file; what it returns are views of the mapped file."""

    def __init__(self, uri: str):
        self.reader = pa.ipc.open_file(open_random(uri))
        self.seq_len = self.reader.schema.field("input_ids").type.list_size
        self._at, self._batch = -1, None

    def _get(self, batch: int) -> pa.RecordBatch:
        if batch != self._at:
            self._at, self._batch = batch, self.reader.get_batch(batch)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of the file's sequence ``i``."""
        batch, row = self._get(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        mask = batch.column(1).slice(row, 1).flatten()
        return batch.column(0).slice(row, 1).flatten().to_numpy(zero_copy_only=True), mask

    def ids(self, start: int, length: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as one view for each record batch they lie in."""
        full = BATCH_SEQUENCES * self.seq_len
        while length > 0:
            flat = self._get(start // full).column(0).flatten().to_numpy(zero_copy_only=True)
            piece = flat[start % full : start % full + length]
            yield piece
            start, length = start + len(piece), length - len(piece)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """Writes the files and returns their manifest (``MANIFEST``), in the order of ``part``."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "token-files")
    fs, path = filesystem(folder)
    fs.create_dir(f"{path}/files", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockEncoder.of(tokenizer)
        part = TaskContext.get().partitionId()
        name = f"{folder}/files/part-{part:06d}-{uuid.uuid4().hex[:8]}"
        out, index, sink, n_docs, at = None, None, None, 0, 0
        for batch in batches:
            if out is None:
                out = _Writer(f"{name}.arrow", seq_len, id_type(max(coder.vocab_size, end_id + 1)))
                where, index_path = filesystem(f"{name}.docs.arrow")
                sink = where.open_output_stream(index_path)
                index = pa.ipc.new_file(sink, _INDEX)
            for i, j, data, starts in text_blocks(batch.column(1)):
                ids, bounds = with_end(*coder.encode(data, starts), end_id)
                out.add(ids)
                lens = np.diff(bounds)
                index.write_batch(pa.record_batch([batch.column(0).slice(i, j - i), pa.array(at + bounds[:-1]), pa.array(lens)], schema=_INDEX))
                n_docs, at = n_docs + j - i, at + len(ids)
        if out is not None:
            out.close()
            index.close()
            sink.close()
            row = [[part], [f"{name}.arrow"], [f"{name}.docs.arrow"], [n_docs], [out.n_ids], [out.n_sequences]]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "file", "index_file", "n_docs", "n_ids", "n_sequences"])

    # rows of one id (or of none) are told apart, so that no range has to take them all
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("doc_id").asc_nulls_first(), "_hash", "_row"]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ordered.mapInArrow(lean(write), MANIFEST), f"{folder}/manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row (``DOCUMENT``) for each document of the files, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["file"])
                index = pa.ipc.open_file(open_random(row["index_file"]))
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    starts, lens = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    sums = []
                    for start, n in zip(starts.tolist(), lens.tolist()):
                        crc = 0
                        for ids in tokens.ids(start, n):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.record_batch([docs.column(0), pa.array(starts + row["base"]), docs.column(2), pa.array(sums, pa.int64()), pa.array([row["file"]] * len(docs)), docs.column(1)], names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "file_start"])

    # one row a file: the window's single task grows with the number of files, not of documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return based.repartitionById(shuffle_partitions(manifest.sparkSession), "part").mapInArrow(lean(read), DOCUMENT)
