"""What the operators of this subpackage share: the shared work folder and small plan helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.work import filesystem, work_dir, written

def open_random(uri: str) -> pa.NativeFile:
    """A file for random reads; memory-mapped where the store is a local or mounted one."""
    fs, path = filesystem(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, which gives freed memory back to the system when it ends: workers
    live on between tasks, and what they hold counts beside the JVM's heap."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim:
                trim(0)

    return whole


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


__all__ = ["filesystem", "lean", "open_random", "shuffle_partitions", "text_or_empty", "work_dir", "written"]
