"""Exact nearest neighbours, entity proximity, and re-ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, StructField, StructType

from ..functions import vectors as V
from ..sources.work import filesystem, work_dir, written

#: Vectors of the index that are multiplied at once, and of the queries that pass over the index
#: together (fewer of wide ones: ``QUERY_NUMBERS`` numbers at most).
INDEX_BLOCK, QUERY_BLOCK, QUERY_NUMBERS = 8192, 16384, 1 << 20
#: Queries and index vectors of one product: what it gives stays in a core's cache.
TILE = (512, 1024)
#: More than what single precision can change a cosine by.
SLACK = 2e-5
#: More than what the order of a sum in double precision can change a cosine by.
ROUNDING = 1e-9
#: Scores that are worth a task of their own.
TASK_SCORES = 1 << 24


def _numbers(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-10)


def _index_blocks(files: Sequence[str], size: int) -> Iterator[np.ndarray]:
    for uri in files:
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(size, columns=["v"]):
                if len(batch):
                    yield _numbers(batch.column(0))


def _over(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row of a, row of b) of products of ``least`` (a number for each row of a) or more.

    A tile's rows are looked through only where their greatest product gets there.
    """
    high, wide = TILE
    product = np.empty(high * wide, np.float32)
    rows, columns = [], []
    for j in range(0, len(b), wide):
        bt = np.ascontiguousarray(b[j : j + wide].T)
        n = bt.shape[1]
        for i in range(0, len(a), high):
            part, bound = a[i : i + high], least[i : i + high]
            out = product[: len(part) * n].reshape(len(part), n)
            np.matmul(part, bt, out=out)
            some = np.flatnonzero(~(out.max(axis=1) < bound))  # a row with NaN, too
            if len(some):
                row, column = np.divmod(np.flatnonzero(out[some] >= bound[some, None]), n)
                rows.append(some[row] + i)
                columns.append(column + j)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(columns)


def _nearest(q: np.ndarray, blocks: Iterator[np.ndarray], k: int, stop: np.ndarray | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and places of the k nearest index rows of each row of ``q``, the earliest of equals
    first; -inf and -1 where the index has fewer.

    Single precision finds the rows that may be among the k, ``SLACK`` allowed for; these are
    scored in double precision.  A row of ``q`` whose k-th cosine gets above its ``stop`` isn't
    searched any further: it keeps one place of those above, with a cosine of inf.  Index rows below
    its ``floor`` may be left out.
    """
    floor = np.full(len(q), -np.inf) if floor is None else floor - ROUNDING
    score, place = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    norm, first = _norms(q), 0
    low, live = (q / norm[:, None]).astype(np.float32), np.arange(len(q))
    for block in blocks:
        if not len(live):
            break
        norms, a = _norms(block), 0
        own = (block / norms[:, None]).astype(np.float32)
        while a < len(block) and len(live):
            # few rows first, so that the bound is high when the many come
            b = min(len(block), a + max(512, 4 * k, first + a))
            least = (np.maximum(score[live, -1], floor[live]) - SLACK).astype(np.float32)
            if first + a == 0 and b > k:
                least = np.maximum(least, np.concatenate([np.partition(low[i : i + 256] @ own[:b].T, -k, axis=1)[:, -k] for i in range(0, len(q), 256)]) - np.float32(2 * SLACK))
            rows, columns = _over(low, own[a:b], least)
            rows = live[rows]
            columns += a
            found = np.empty(len(rows))
            for i in range(0, len(rows), 65536):
                x, y = rows[i : i + 65536], columns[i : i + 65536]
                found[i : i + 65536] = np.round(np.einsum("ij,ij->i", q[x], block[y]) / (norm[x] * norms[y]), 12)
            better = found > np.maximum(score[rows, -1], floor[rows])  # of equals the earlier stay
            rows, columns, found = rows[better], columns[better], found[better]
            if len(rows):
                met = np.unique(rows)
                all_rows = np.concatenate([np.repeat(met, k), rows])
                all_scores = np.concatenate([score[met].ravel(), found])
                all_places = np.concatenate([place[met].ravel(), columns + first])
                order = np.lexsort((all_places, -all_scores, all_rows))
                kept = order[np.searchsorted(all_rows[order], met)[:, None] + np.arange(k)]
                score[met], place[met] = all_scores[kept], all_places[kept]
            if stop is not None:
                over = score[live, -1] > stop[live] + ROUNDING
                done = live[over]
                score[done], place[done, 1:] = np.inf, -1
                low, live = low[~over], live[~over]
            a = b
        first += len(block)
    return score, place


def _taken(files: Sequence[str], places: np.ndarray) -> list[pa.Array]:
    """The columns but the vector of the index rows at ``places``."""
    wanted, back = np.unique(places, return_inverse=True)
    parts, first = [], 0
    for uri in files:
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            names = [n for n in file.schema_arrow.names if n != "v"]
            own = wanted[slice(*np.searchsorted(wanted, [first, first + file.metadata.num_rows]))]
            if len(own):
                parts.append(file.read(columns=names).select(names).take(pa.array(own - first)))
            first += file.metadata.num_rows
    return [c.combine_chunks() for c in pa.concat_tables(parts).combine_chunks().take(pa.array(back.ravel())).columns]


def top_k(queries: DataFrame, index: DataFrame, k: int = 5, query_key: str = "query_id", index_key: str = "chunk_idx", carry: Sequence[str] = (), folder: str | None = None, stop: str | None = None, floor: str | None = None, more: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_idx, score, rank, and the index's ``carry`` columns): each query's k rows of
    greatest cosine, the least id of equals first.  Keys are of any type that can be ordered.

    ``stop`` names a column of the queries, for those who ask only whether rows up to that cosine are
    among the k: once k rows above it are found (above null: any k), none can be, and the query gets one
    of the k instead, with rank 1 and no score.

    ``floor`` names a column of the queries: a cosine below which rows may be left out.  ``more`` is a
    second part of the index, whose rows come with ``more`` true if they are among the k of both parts.
    The k rows of the first part all come then, whatever their rank, for they may serve another search.

    A stated query set against all rows: the index is written in the order of its keys; a task
    holds a block of queries, reads the index block by block, and keeps k rows a query, so that
    only rows above the k-th so far are looked at twice.  Equal queries of a block are searched
    once, and of equal index vectors only the k least ids are read, as no others can be found.
    Few queries have the index dealt out too; one shuffle by query ranks what tasks have kept.
    Neither side is broadcast or collected, whatever its size.  The index is written to ``folder``,
    if one is given, which can go when the result has been read.
    """
    spark = queries.sparkSession

    def vector(df: DataFrame) -> Column:
        single = df.schema["embedding"].dataType == ArrayType(FloatType())
        return (F.col("embedding") if single else V.doubles(F.col("embedding"))).alias("v")

    def index_files(part: DataFrame, folder: str) -> tuple[DataFrame, list[str]]:
        rows = part.where(F.col("embedding").isNotNull()).select(F.col(index_key).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), vector(part))
        rows = written(rows.withColumn("_n", copy).where(F.col("_n") <= k).drop("_n").orderBy("id"), folder)
        return rows, sorted(rows.inputFiles(), key=lambda f: f.rpartition("/")[2])

    copy = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("id"))  # sorted by a number, not by vectors
    folder, parted = folder or work_dir(spark, "search-index"), more is not None
    rows, files = index_files(index, f"{folder}/first")
    others = index_files(more, f"{folder}/more")[1] if parted else []
    bounds = [F.col(c).cast("double").alias(n) for n, c in (("stop", stop), ("floor", floor)) if c]
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col(query_key).alias("query_id"), vector(queries), *bounds)
    n_rows, (n_asked, width) = rows.count(), asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    size, query_block = INDEX_BLOCK, min(QUERY_BLOCK, max(256, QUERY_NUMBERS // width))
    least = max(1, min(2 * spark.sparkContext.defaultParallelism, n_asked * n_rows // TASK_SCORES))
    parts = max(1, math.ceil(n_asked / query_block), min(least, n_asked // 512))
    slabs = max(1, min(len(files), math.ceil(least / parts)))
    dealt, dealt_more = ([own[i * len(own) // slabs : (i + 1) * len(own) // slabs] for i in range(slabs)] for own in (files, others))

    hit = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("score", DoubleType()), StructField("chunk_idx", rows.schema["id"].dataType), *(StructField(c, rows.schema[f"c{i}"].dataType) for i, c in enumerate(carry)), *([StructField("more", BooleanType())] if parted else [])])

    def search(ids: pa.Array, vectors: pa.Array, slab: int, given: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        different, of = np.unique(_numbers(vectors), axis=0, return_inverse=True)
        of, bound = of.ravel(), {}
        for name, own in given.items():  # of equal queries the greatest stop, the least floor
            bound[name], met = (np.full(len(different), -np.inf), np.maximum) if name == "stop" else (np.full(len(different), np.inf), np.minimum)
            met.at(bound[name], of, own)
        score, place = _nearest(different, _index_blocks(dealt[slab], size), k, **bound)
        yield from handed(ids, of, dealt[slab], score, place, [False] if parted else [])
        if parted:
            score, place = _nearest(different, _index_blocks(dealt_more[slab], size), k, floor=score[:, -1])
            yield from handed(ids, of, dealt_more[slab], score, place, [True])

    def handed(ids: pa.Array, of: np.ndarray, files: list[str], score: np.ndarray, place: np.ndarray, flag: list[bool]) -> Iterator[pa.RecordBatch]:
        kept = place[of] >= 0
        if kept.any():
            owner = np.repeat(np.arange(len(ids)), kept.sum(axis=1))
            # what the different queries have found is fetched once
            there = place >= 0
            number = np.cumsum(there.ravel()).reshape(there.shape) - 1
            found, at = _taken(files, place[there]), number[of][kept]
            scores = score[of][kept]
            for i in range(0, len(owner), 65536):
                own = slice(i, i + 65536)
                columns = [ids.take(pa.array(owner[own])), pa.array(scores[own]), *(c.take(pa.array(at[own])) for c in found), *(pa.array(np.full(len(owner[own]), x)) for x in flag)]
                yield pa.record_batch(columns, names=hit.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            slab = rows.column(2).to_numpy()
            for s in np.unique(slab):
                own = rows.filter(pa.array(slab == s)).combine_chunks()
                yield from search(own.column(0).combine_chunks(), own.column(1).combine_chunks(), int(s), {n: own.column(n).combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False) for n in names[3:]})

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= query_block:
                rows = pa.Table.from_batches(held)
                whole = len(rows) // query_block * query_block
                for i in range(0, whole, query_block):
                    yield from block(rows.slice(i, query_block))
                held = rows.slice(whole).to_batches()
        if sum(map(len, held)):
            yield from block(pa.Table.from_batches(held))

    # copies of a vector stand side by side; a large group of them is dealt out by its ids
    slab = F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))
    names = ["query_id", "v", "slab", *(n for n, c in (("stop", stop), ("floor", floor)) if c)]
    asked = asked.select("query_id", "v", slab.alias("slab"), *names[3:], F.xxhash64("v").alias("h")).repartitionByRange(parts * slabs, "slab", "h", "query_id").sortWithinPartitions("slab", "h")
    found = asked.select(*names).mapInArrow(run, hit)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_idx")
    wanted = F.col("rank") <= k
    ranked = found.withColumn("rank", F.row_number().over(order)).where(wanted | ~F.col("more") if parted else wanted)
    if stop:  # in any part of the index
        beyond = F.lit(float("inf"))
        ranked = found.withColumns({"rank": F.row_number().over(order), "_most": F.max("score").over(Window.partitionBy("query_id"))})
        ranked = ranked.where((F.col("rank") <= F.when(F.col("_most") == beyond, 1).otherwise(k))).withColumn("score", F.nullif("score", beyond)).drop("_most")
    return ranked.select("query_id", "chunk_idx", "score", "rank", *carry, *(["more"] if parted else []))


def gold_cosines(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, best): the greatest cosine of a question to a chunk of its gold documents; questions
    whose gold has no chunk are left out.  ``questions``: (query_id, gold, embedding)."""
    asked = questions.where("embedding is not null").select(F.explode(F.array_distinct(F.col("gold").cast("array<string>"))).alias("_gold"), "query_id", "embedding")
    own = chunks.where("embedding is not null").groupBy(F.col("doc_id").cast("string").alias("_gold")).agg(F.collect_list("embedding").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            q, x, n = _numbers(batch.column(1)), _numbers(batch.column(2).flatten()), np.asarray(batch.column(2).value_lengths())
            of = np.repeat(np.arange(len(q)), n)
            found = np.einsum("ij,ij->i", q[of], x) / (_norms(q)[of] * _norms(x))
            yield pa.record_batch([batch.column(0), pa.array(np.maximum.reduceat(found, np.append(0, np.cumsum(n)[:-1])))], names=["query_id", "best"])

    pairs = asked.join(own, "_gold").select("query_id", "embedding", "own")
    return pairs.mapInArrow(run, StructType([pairs.schema["query_id"], StructField("best", DoubleType())])).groupBy("query_id").agg(F.max("best").alias("best"))


def proximity(hits: DataFrame, query_names: DataFrame, chunk_names: DataFrame, vectors: DataFrame, variant: str = "library") -> DataFrame:
    """(query_id, chunk_idx, kg): mean over a query's entities of the greatest cosine to the chunk's.

    ``query_names``: (query_id, name); ``chunk_names``: (chunk_idx, name).  Unknown names drop.
    ``library``: different query entities, result within [0, 1].  ``script``: entities with
    their multiplicities, each at least 0, and 1e-8 added to the product of norms.
    """
    q = query_names.join(vectors, "name").select("query_id", F.col("name").alias("q_name"), F.col("vec").alias("q_vec"))
    if variant == "library":
        q = q.dropDuplicates(["query_id", "q_name"])
    q = q.groupBy("query_id", "q_name").agg(F.count("*").alias("times"), F.first("q_vec").alias("q_vec"))
    c = chunk_names.dropDuplicates(["chunk_idx", "name"]).join(vectors, "name").select("chunk_idx", F.col("vec").alias("c_vec"))
    pairs = hits.select("query_id", "chunk_idx").join(q, "query_id").join(c, "chunk_idx")
    if variant == "library":
        sim: Column = V.cosine(F.col("q_vec"), F.col("c_vec"))
    else:
        sim = F.greatest(F.lit(0.0), V.dot(F.col("q_vec"), F.col("c_vec")) / (V.norm(F.col("q_vec")) * V.norm(F.col("c_vec")) + 1e-8))
    best = pairs.groupBy("query_id", "chunk_idx", "q_name", "times").agg(F.max(sim).alias("best"))
    mean = F.sum(F.col("best") * F.col("times")) / F.sum("times")
    if variant == "library":
        mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))
    return best.groupBy("query_id", "chunk_idx").agg(mean.alias("kg"))


def rerank(hits: DataFrame, query_names: DataFrame, chunk_names: DataFrame, vectors: DataFrame, k: int, beta: float = 0.7, variant: str = "library") -> DataFrame:
    """Hits by beta * score + (1 - beta) * kg, ties in their old order, the first k of each query.

    ``library``: queries without any entity keep their order and raw scores; ``script``:
    all are blended (kg is 0 for them).
    """
    rows = hits.join(proximity(hits, query_names, chunk_names, vectors, variant), ["query_id", "chunk_idx"], "left").withColumn("kg", F.coalesce("kg", F.lit(0.0)))
    blended = beta * F.col("score") + (1 - beta) * F.col("kg")
    if variant == "library":
        known = query_names.select("query_id").distinct().withColumn("_has", F.lit(True))
        rows = rows.join(known, "query_id", "left")
        blended = F.when(F.col("_has"), blended).otherwise(F.col("score"))
    rows = rows.withColumn("hybrid", F.round(blended, 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("hybrid"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).select("query_id", "chunk_idx", F.col("hybrid").alias("score"), "kg", F.col("new_rank").alias("rank"))
