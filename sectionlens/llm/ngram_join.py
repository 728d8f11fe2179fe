"""N-gram Jaccard join: all pairs of texts whose word 5-gram sets have Jaccard 0.8 or more.

MinHash signatures are cut into bands; texts that agree in a band meet in its bucket.
``bands_for`` chooses bands and rows for a target recall at the threshold.  The stages:

1. The texts are written once to the shared folder; each file is a *part*.  One pass gives
   each document's class (a 128-bit digest of its n-gram set: texts of one class have
   Jaccard 1) and band hashes.  All that follows handles classes, so copies cost one row.
2. Band hashes are shuffled.  A bucket's head is its least class.  A class is joined to the
   least of its buckets' heads, and so is each of these heads: about one edge a class, never
   a bucket's pairs.  The components of these edges hold every candidate pair.
3. Each component's full n-gram sets, read by the parts again, meet in one task, or in
   tiles of ``TILE`` classes a side if it is larger, and all pairs in it are verified
   exactly, by counting common n-grams.  A task reports for each class how many documents
   it links to, and a spanning forest of the links: rows grow with classes, not with pairs.
4. The forest's components are the near-duplicate groups.

Result, a row for each document: ``doc_id``; ``class_id``, the least id of its group;
``copy_id``, the least id of its class; ``n_links``, the other documents at 0.8 or more.
``representatives`` keeps one row of each group, with all its columns: that of least id
(null ids last), then first in the files.

A class with a third of all documents is one row after partial aggregation.  A component of
m different texts costs m * m / 2 comparisons, as its exact link counts require, spread
over (m / TILE) ** 2 / 2 tasks.  Recall: a pair is missed only if no chain of buckets
joins it; ``bands_for`` bounds that below 1e-4 at Jaccard 0.8, less above.

Defined cases: words are runs of characters other than ``\\x20`` and ``\\x09-\\x0D``, taken as
they are; a text of 1 to 4 words has one n-gram, all of its words; texts without words (or
null) link to nothing and are groups of their own; null ids are never a group's id unless
the group has no other; rows with equal ids count as documents; other columns aren't read.
"""

from __future__ import annotations

import math
import pickle
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._shared import lean, open_random, shuffle_partitions, work_dir, written
from ._tokens import text_blocks

NGRAM, RECALL = 5, 0.9999
#: The threshold as a ratio of whole numbers, so that verification is exact.
THRESHOLD = (4, 5)
#: Classes on each side of a tile of pairs.
TILE = 1024
BLOCK, ROWS = 1 << 20, 512
_RNG = np.random.default_rng(20_240_301)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 61, 1 << 62, dtype=np.uint64)) | 1
_PLACE = _RNG.integers(1 << 61, 1 << 62, 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SIGNED = "doc_id long, part int, row int, cls binary, bands array<long>"
RESULT = "doc_id long, class_id long, copy_id long, n_links long"


def bands_for(threshold: float, recall: float = RECALL, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most_hashes`` hashes that
    finds a pair at the threshold with probability ``recall`` or more."""
    best = (most_hashes, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + (1 << 16))
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            _POWERS.append(out)
    return _POWERS


def ngrams(data: np.ndarray, starts: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of the texts of a block, ascending in each, and each text's bounds."""
    n_docs = len(starts) - 1
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts[:-1]] = True
    begins = word & (np.append(True, ~word[:-1])[: len(data)] | first[: len(data)])
    ends = word & (np.append(~word[1:], True)[: len(data)] | np.append(first[1 : len(data)], True)[: len(data)])
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(data) + 1)
    total = np.append(np.uint64(0), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64))
    hashes = _mix((total[b] - total[a]) * down[a])
    bounds = np.searchsorted(a, starts)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(n_docs), count)
    grams = np.zeros(max(0, len(a) - n + 1), np.uint64)
    for k in range(n):
        grams += hashes[k : k + len(grams)] * _PLACE[k]
    whole = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    grams, owner = _mix(grams[whole]), doc[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        few = np.array([sum(int(hashes[bounds[d] + k]) * int(_PLACE[k + n]) for k in range(count[d])) % (1 << 64) for d in short.tolist()], np.uint64)
        grams, owner = np.append(grams, _mix(few)), np.append(owner, short)
    by = np.lexsort((grams, owner))
    grams, owner = grams[by], owner[by]
    new = np.append(True, (np.diff(grams) != 0) | (np.diff(owner) != 0))[: len(grams)]
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(n_docs + 1))


def signatures(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests (as two numbers) and band hashes of the non-empty sets of a block."""
    at = bounds[:-1][np.diff(bounds) > 0]
    digest = np.stack([np.add.reduceat(_mix(grams + c), at) for c in (_PLACE[11], _PLACE[12])], axis=1) if len(at) else np.zeros((0, 2), np.uint64)
    rng = np.random.default_rng(7)
    out = np.zeros((len(at), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(at), band + 1, np.uint64) * _PLACE[13]
        for _ in range(rows):
            times, plus = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            if len(at):
                key = _mix(key ^ np.minimum.reduceat((grams * (times | np.uint64(1)) + plus) >> np.uint64(1), at))
        out[:, band] = key
    return digest, out


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for first, ids, data, starts in _blocks(file):
                    grams, bounds = ngrams(data, starts)
                    digest, keys = signatures(grams, bounds, bands, rows)
                    has = np.flatnonzero(np.diff(bounds) > 0)
                    n = len(ids)
                    cls: list[bytes | None] = [None] * n
                    for k, d in zip(has.tolist(), digest):
                        cls[k] = d.tobytes()
                    offsets = np.append(0, np.cumsum(np.where(np.diff(bounds) > 0, bands, 0))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                    yield pa.record_batch(
                        [ids, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(cls, pa.binary()), lists],
                        names=["doc_id", "part", "row", "cls", "bands"],
                    )

    return run


def _blocks(file: str) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    row = 0
    for batch in pq.ParquetFile(open_random(file)).iter_batches(batch_size=ROWS, columns=["doc_id", "text"]):
        for i, j, data, starts in text_blocks(batch.column(1), BLOCK):
            yield row + i, batch.column(0).slice(i, j - i), data, starts
        row += len(batch)


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): the least node of each node's component.  ``edges``: (a, b), any order.

    Each round hooks every node to its least neighbour, shortens these chains, and puts labels
    in the place of the edges' ends; loops and repeats go, and so does every component that is
    settled.  Of the nodes left, each hooks in this round or the next, so their number halves
    in two rounds at most and the rounds end by themselves.  Rounds are written tables; what
    the driver sees of one is whether edges are left.
    """
    left = written(edges.where("a <> b").distinct(), f"{folder}/edges-0")
    labels = written(_hooked(left, f"{folder}/hooks-0"), f"{folder}/labels-0")
    rounds = [labels]
    while True:
        turn = len(rounds)
        of_a, of_b = (labels.select(F.col("node").alias(f"_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
        moved = left.join(of_a, left["a"] == of_a["_a"]).join(of_b, F.col("b") == of_b["_b"]).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        # a label that isn't its own label yet stays joined to it
        chains = labels.join(of_a, labels["label"] == of_a["_a"]).select(F.col("label").alias("a"), F.col("label_a").alias("b"))
        left = written(moved.union(chains).where("a <> b").distinct(), f"{folder}/edges-{turn}")
        if left.isEmpty():
            break
        labels = written(_hooked(left, f"{folder}/hooks-{turn}"), f"{folder}/labels-{turn}")
        rounds.append(labels)
    out = rounds[0]
    for later in rounds[1:]:
        of = later.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        out = out.join(of, out["label"] == of["_at"], "left").select("node", F.coalesce("_next", "label").alias("label"))
    return out


def _hooked(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): each node's least neighbour (itself, if that is less), followed four times."""
    ends = edges.union(edges.select("b", "a"))
    label = written(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), folder)
    for _ in range(2):
        of = label.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        label = label.join(of, label["label"] == of["_at"]).select("node", F.col("_next").alias("label"))
    return label


def _packed(rows: list[tuple[int, bytes, tuple]]) -> pa.RecordBatch:
    to, task, payload = zip(*rows)
    return pa.record_batch([pa.array(to, pa.int32()), pa.array(task, pa.binary()), pa.array([pickle.dumps(x, 5) for x in payload], pa.binary())], names=["to", "task", "payload"])


def _send_sets(files: list[str], n_to: int):
    """Requests (part, row, cls, n_copies, comp, tile, n_tiles) become n-gram sets at their tasks:
    a component, or two tiles of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, dict[int, tuple]] = defaultdict(dict)
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for part, row, *rest in zip(*columns):
                asked[part][row] = tuple(rest)
        for part, rows in asked.items():
            out: dict[tuple[int, bytes], list] = defaultdict(list)
            held = 0
            for first, ids, data, starts in _blocks(files[part]):
                own = [k for k in range(len(ids)) if first + k in rows]
                if not own:
                    continue
                grams, bounds = ngrams(data, starts)
                for k in own:
                    cls, copies, comp, tile, tiles = rows[first + k]
                    one = grams[bounds[k] : bounds[k + 1]]
                    for other in range(tiles):
                        i, j = min(tile, other), max(tile, other)
                        to = (int.from_bytes(comp[:6], "little") + 7919 * i + 104_729 * j) % n_to
                        # tasks sort by their number of tiles, so that whole components come first
                        out[to, struct.pack(">III", tiles, i, j) + comp].append((tile, cls, copies, one))
                        held += len(one)
                if held > 1 << 21:
                    yield _packed([(to, task, _columns(x)) for (to, task), x in out.items()])
                    out, held = defaultdict(list), 0
            if out:
                yield _packed([(to, task, _columns(x)) for (to, task), x in out.items()])

    return run


def _columns(rows: list[tuple]) -> tuple:
    tile, cls, copies, sets = zip(*rows)
    return tile, cls, np.array(copies, np.int64), np.array([len(x) for x in sets]), np.concatenate(sets)


#: N-grams that more sets than this hold are counted by matrix products, others pair by pair.
_DENSE = 24


def common_counts(owner: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """How many n-grams each two of n sets have in common."""
    by = np.argsort(grams, kind="stable")
    owner, grams = owner[by], grams[by]
    starts = np.flatnonzero(np.append(True, np.diff(grams) != 0)[: len(grams)])
    size = np.diff(np.append(starts, len(grams)))
    out = np.zeros((n, n), np.float32)
    flat = out.reshape(-1)
    for c in range(2, min(_DENSE, int(size.max(initial=0))) + 1):
        at = starts[size == c]
        if len(at):
            members = owner[at[:, None] + np.arange(c)]
            pairs = (members[:, :, None] * n + members[:, None, :]).ravel()
            flat += np.bincount(pairs, minlength=n * n) if len(pairs) > n * n // 8 else 0
            if len(pairs) <= n * n // 8:
                np.add.at(flat, pairs, 1)
    many = np.flatnonzero(size > _DENSE)
    for i in range(0, len(many), 4096):
        columns = many[i : i + 4096]
        held = np.zeros((n, len(columns)), np.float32)
        lens = size[columns]
        ends = np.cumsum(lens)
        index = np.repeat(starts[columns] - (ends - lens), lens) + np.arange(ends[-1])
        held[owner[index], np.repeat(np.arange(len(columns)), lens)] = 1
        out += held @ held.T
    return out


def _verified(cls: list[bytes], copies: np.ndarray, lens: np.ndarray, flat: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Documents linked to each class, and the root of each in a spanning forest of the links."""
    n = len(cls)
    common = common_counts(np.repeat(np.arange(n), lens), flat, n).astype(np.int64)
    over, under = THRESHOLD
    linked = under * common >= over * (lens[:, None] + lens[None, :] - common)
    np.fill_diagonal(linked, False)
    if mask is not None:
        linked &= mask
    n_links = linked @ copies
    root = np.arange(n)
    while True:  # the least label of all neighbours, until none changes
        near = np.where(linked, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, near)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return n_links, root
        root = new


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the links of each task; rows come sorted by task, so one is held at a time."""

    def close(rows: list[tuple], apart: bool = False) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[1])
        tile = np.array([r[0] for r in rows])
        cls = [r[1] for r in rows]
        mask = tile[:, None] != tile[None, :] if apart else None
        n_links, root = _verified(cls, np.array([r[2] for r in rows]), np.array([len(r[3]) for r in rows]), np.concatenate([r[3] for r in rows]), mask)
        return pa.record_batch([pa.array(cls, pa.binary()), pa.array(n_links, pa.int64()), pa.array([cls[r] for r in root], pa.binary())], names=["cls", "n_links", "root"])

    held: list[tuple] = []
    last: bytes | None = None
    for batch in batches:
        for task, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if task != last and held:
                tiles, i, j = struct.unpack_from(">III", last)
                # whole small components share a count; links between them would be true ones
                if tiles > 1 or len(held) > 512:
                    yield close(held, tiles > 1 and i != j)
                    held = []
                elif struct.unpack_from(">I", task)[0] > 1:
                    yield close(held)
                    held = []
            last = task
            tile, cls, copies, lens, flat = pickle.loads(payload)
            held += zip(tile, cls, copies, np.split(flat, np.cumsum(lens)[:-1]))
    if held:
        tiles, i, j = struct.unpack_from(">III", last)
        yield close(held, tiles > 1 and i != j)


@dataclass
class _Groups:
    """What the stages have found: the parts' files, each row's class, and the classes' groups."""

    files: list[str]
    signed: DataFrame
    known: DataFrame


def _grouped(docs: DataFrame, recall: float, carry: tuple[str, ...] = ()) -> _Groups:
    spark = docs.sparkSession
    folder = work_dir(spark, "ngram-join")
    carried = [F.struct(*carry).alias("carried")] if carry else []
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carried).write.option("compression", "zstd").parquet(f"{folder}/texts")
    files = sorted(spark.read.parquet(f"{folder}/texts").inputFiles())
    n_parts, n_to = max(1, len(files)), shuffle_partitions(spark)
    parts = spark.createDataFrame(list(enumerate(files)), "part int, file string").repartitionById(n_parts, "part")
    bands, rows = bands_for(THRESHOLD[0] / THRESHOLD[1], recall)
    signed = written(parts.mapInArrow(lean(_sign(bands, rows)), SIGNED), f"{folder}/signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "part", "row")).alias("first")
    of_class = signed.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n_copies"), first, F.first("bands").alias("bands"))
    classes = written(of_class, f"{folder}/classes")
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    # a class reaches its buckets' heads through the least of them: about one edge a class
    met = keyed.join(buckets, "key").groupBy("cls").agg(F.min("head").alias("b"), F.collect_set("head").alias("heads"))
    stars = met.select(F.col("cls").alias("a"), "b").union(met.select(F.explode("heads").alias("a"), "b"))
    comps = connected(stars, f"{folder}/candidates")
    tiles = comps.groupBy("label").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n_tiles"))
    tile = F.pmod(F.hash("cls"), F.col("n_tiles"))
    asked = classes.join(comps, classes["cls"] == comps["node"]).join(tiles, "label").select("first.part", "first.row", "cls", "n_copies", F.col("label").alias("comp"), tile.alias("tile"), "n_tiles")
    sets = asked.repartitionById(n_parts, "part").mapInArrow(lean(_send_sets(files, n_to)), "to int, task binary, payload binary")
    found = written(sets.repartitionById(n_to, "to").sortWithinPartitions("task").mapInArrow(lean(_verify), "cls binary, n_links long, root binary"), f"{folder}/links")
    groups = connected(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")), f"{folder}/groups")
    links = found.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    grouped = classes.select("cls", "n_copies", "first").join(links, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    grouped = grouped.withColumn("label", F.coalesce("label", "cls"))
    least = grouped.groupBy("label").agg(F.min("first").alias("least"))
    known = grouped.join(least, "label").select("cls", "first", "least", (F.coalesce("n_links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    return _Groups(files, signed, known)


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Groups and link counts of all documents (``RESULT``)."""
    g = _grouped(docs, recall)
    known = g.known.select("cls", F.col("least.doc_id").alias("class_id"), F.col("first.doc_id").alias("copy_id"), "n_links")

    def own(column: str, default: Column) -> Column:
        return F.when(F.col("cls").isNull(), default).otherwise(F.col(column)).alias(column)

    # texts without words have no class
    return g.signed.select("doc_id", "cls").join(known, "cls", "left").select("doc_id", own("class_id", F.col("doc_id")), own("copy_id", F.col("doc_id")), own("n_links", F.lit(0).cast("long")))


def representatives(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row of each group, with the columns of ``docs``; rows without words all stay."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    g = _grouped(docs, recall, others)
    # the row of a group's least document is that of the class which holds it
    heads = g.known.where(F.col("first") == F.col("least")).select("first.part", "first.row")
    stay = heads.unionByName(g.signed.where("cls is null").select("part", "row")).repartitionById(max(1, len(g.files)), "part")
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    if others:
        schema.add("carried", docs.select(F.struct(*others).alias("carried")).schema["carried"].dataType)
    rows = stay.mapInArrow(lean(_kept_rows(g.files, bool(others))), schema)
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("carried")[c].alias(c) for c in docs.columns))


def _kept_rows(files: list[str], carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay: dict[int, list[np.ndarray]] = defaultdict(list)
        for batch in batches:
            part, row = (batch.column(k).to_numpy() for k in range(2))
            for p in np.unique(part).tolist():
                stay[p].append(row[part == p])
        for part, rows in stay.items():
            wanted, at = np.sort(np.concatenate(rows)), 0
            for batch in pq.ParquetFile(open_random(files[part])).iter_batches(batch_size=ROWS, columns=["doc_id", "text", *["carried"] * carried]):
                a, b = np.searchsorted(wanted, [at, at + len(batch)])
                yield batch.take(pa.array(wanted[a:b] - at))
                at += len(batch)

    return run
