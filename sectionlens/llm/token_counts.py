"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded once; each task counts its own lengths, so that the shuffle carries
a row for each distinct length and task.  Suffix sums over the distinct lengths then give,
for every context limit, how many documents reach it, their tokens, and the corpus total
after truncation; cumulative shares answer quantiles.  The sums are made in two levels
(within ranges of ``RANGE`` lengths, then over the ranges), so no task sorts all lengths.

Defined cases: a null text is empty and has length 0 (plus the end id if one is counted);
repeated rows count each time; an empty table gives an empty histogram.  Other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import lean
from ._tokens import BlockEncoder, text_blocks

#: Lengths whose sums one window holds.
RANGE = 1024


def length_histogram(docs: DataFrame, tokenizer: str, end_tokens: int = 0) -> DataFrame:
    """(length, n_docs): how many documents have each encoded length."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockEncoder.of(tokenizer)
        counts: dict[int, int] = {}
        for batch in batches:
            for _, _, data, starts in text_blocks(batch.column(0)):
                values, times = np.unique(coder.encode(data, starts)[1] + end_tokens, return_counts=True)
                for n, k in zip(values.tolist(), times.tolist()):
                    counts[n] = counts.get(n, 0) + k
        yield pa.record_batch([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["length", "n_docs"])

    return docs.select("text").mapInArrow(lean(lengths), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each distinct length L, taken as a context limit:

    ``docs_at_least`` and ``tokens_at_least``: documents of L tokens or more, and their tokens;
    ``truncated_tokens``: the corpus total when every document is cut at L;
    ``docs_up_to`` and ``share_up_to``: documents of at most L tokens, and their share;
    ``total_docs`` and ``total_tokens``: of the corpus.
    """
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / RANGE).alias("range"))
    sums = rows.groupBy("range").agg(F.sum("n_docs").alias("range_docs"), F.sum("n_tokens").alias("range_tokens"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row a range of lengths: bounded by the longest document, whatever the number of documents
    sums = sums.select(
        "range",
        F.coalesce(F.sum("range_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("range_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("range_docs").over(whole).alias("total_docs"),
        F.sum("range_tokens").over(whole).alias("total_tokens"),
    )
    within = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("docs_in", F.sum("n_docs").over(within)).withColumn("tokens_in", F.sum("n_tokens").over(within)).join(sums, "range")
    at_least = joined.select(
        "length", "n_docs", "n_tokens", "total_docs", "total_tokens",
        (F.col("docs_in") + F.col("docs_above")).alias("docs_at_least"),
        (F.col("tokens_in") + F.col("tokens_above")).alias("tokens_at_least"),
    )
    docs_up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return at_least.withColumns({
        "truncated_tokens": F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"),
        "docs_up_to": docs_up_to,
        "share_up_to": docs_up_to / F.col("total_docs"),
    })


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: the corpus total when every document is cut at any ``limit``, seen or not."""
    at_least = F.col("length") >= limit
    tokens = F.sum(F.when(~at_least, F.col("n_tokens")))
    return sums.agg((F.coalesce(tokens, F.lit(0)) + limit * F.coalesce(F.sum(F.when(at_least, F.col("n_docs"))), F.lit(0))).alias("tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share ``q`` of the documents do not exceed."""
    return sums.where(F.col("share_up_to") >= q).agg(F.min("length").alias("length"))
