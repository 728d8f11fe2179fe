"""Toxicity: a cumulative-link ordinal regression over sparse word features.

P(grade <= k) = sigmoid(threshold_k - score), with one weight for each word shared by all
thresholds, which rise with k.  ``score_documents`` outputs each text's expected severity
(the mean grade), its likeliest grade and whether it is toxic (P(grade >= 1) of one half).

Grades come from labels: 0 without the toxic mark; 1 with it in a text marked as of low
quality, of which readers see little; 2 with it in any other.  (The other way round the grades
wouldn't rise with the words: junk that is marked as toxic has few of them.)  ``fit`` reads a bounded sample of labelled rows: ``sample`` rows of each
class (toxic or not), those whose hashed ids are least, weighted so that both classes count
as they do among all labelled rows.  A feature is that a word occurs in the text, or one that
begins with the same ``PREFIX`` characters, which inflected and compounded forms share.  Those
are kept whose shares in the two classes differ most, by the signed root of the likelihood
ratio (in standard errors; words that one class never has rank as high as they are frequent):
``least_z`` or more, at most ``most_words``.  Scoring reads every whole text; the model (the kept words' hashes and
weights, bounded by ``most_words``) goes to the tasks with the function.

Words are runs of ASCII letters and of bytes beyond ASCII, ASCII letters in lower case.

Defined cases: a null or empty text has no features and gets the grade of no words; null
labels and labels without a document are left out of the sample; of documents that share a
labelled id one, that of least hash, is in the sample; without a toxic or
without an untoxic example the fit knows one grade, that of its rows; rows with equal ids
are scored each; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import lean, work_dir, written
from ._tokens import text_blocks
from .ngram_join import _BYTE, _mix, _powers

GRADES = 3
#: Characters of a word's beginning that are a feature of their own.
PREFIX = 4
_PREFIX_SALT = np.uint64(0x9E3779B97F4A7C15)
SCORED = "doc_id long, expected_severity double, grade int, toxic boolean"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


@dataclass
class Model:
    """Sorted word hashes, their weights, and rising thresholds between grades."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Of each grade, by row."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        return np.diff(np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))]), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def feature_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block's texts, then of the beginnings of longer words, and the text that each is in."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, word = _LOWER[data], _WORD[data]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    chars = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    beyond = np.append(chars, np.full(PREFIX, n))[np.searchsorted(chars, a) + PREFIX]
    long = np.flatnonzero(beyond < b)
    # hashes of whole words, as differences of prefix sums
    up, down = _powers(n + 1)
    total = np.append(np.uint64(0), np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64))
    doc = np.searchsorted(starts, a, "right") - 1
    whole, short = ((total[e] - total[s]) * down[s] for s, e in ((a, b), (a[long], beyond[long])))
    return np.append(_mix(whole), _mix(short ^ _PREFIX_SALT)), np.append(doc, doc[long])


def _distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, end to end, and bounds."""
    hashes, doc = feature_hashes(data, starts)
    by = np.lexsort((hashes, doc))
    hashes, doc = hashes[by], doc[by]
    new = np.append(True, (np.diff(hashes) != 0) | (np.diff(doc) != 0))[: len(hashes)]
    return hashes[new], np.searchsorted(doc[new], np.arange(len(starts)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, starts in text_blocks(batch.column(2)):
            hashes, bounds = _distinct(data, starts)
            packed = [hashes[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.record_batch([*(batch.column(k).slice(i, j - i) for k in range(2)), pa.array(packed, pa.binary())], names=["row", "grade", "words"])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, float]]:
    """(row, grade, text) of at most ``sample`` label rows of each class, and the rows that each stands for."""
    toxic = (F.col("toxic") > 0).cast("int")
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.select(F.col("doc_id").alias("_id"), toxic.alias("_toxic"), (toxic * F.when(F.col("quality") <= 0, 1).otherwise(2)).alias("grade"))
    classes = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id", "grade").limit(sample) for c in (0, 1)]
    bounded = picked[0].union(picked[1]).withColumn("row", F.monotonically_increasing_id())  # 2 * sample rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded), F.col("doc_id") == F.col("_id")).select("row", "grade", "text")
    return rows, {c: n / min(n, sample) for c, n in classes.items()}


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a batch have each word: (word, toxic texts, others)."""
    for batch in batches:
        lists = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        bad = np.repeat(batch.column(0).to_numpy() > 0, [len(x) for x in lists])
        words, index = np.unique(np.concatenate([*lists, np.zeros(0, np.uint64)]), return_inverse=True)
        counts = [np.bincount(index, x, len(words)).astype(np.int64) for x in (bad, ~bad)]
        yield pa.record_batch([pa.array(words.view(np.int64)), *map(pa.array, counts)], names=["word", "n_bad", "n_good"])


def _kept_words(words: np.ndarray):
    """Which of these (sorted) words each text has, as packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for x in batch.column(1).to_pylist():
                own = np.zeros(len(words), bool)
                own[np.searchsorted(words, np.intersect1d(words, np.frombuffer(x, np.uint64)))] = True
                bits.append(np.packbits(own).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(bits, pa.binary())], names=["grade", "bits"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, most_words: int = 1000, least_z: float = 2.5, ridge: float = 0.02, steps: int = 400) -> Model:
    """The model of a bounded sample of labelled documents.

    Words are counted on the executors; the driver gets the ``most_words`` best of them and
    one bit for each of these and each row of the sample.
    """
    rows, stands_for = labelled_sample(docs, labels, sample)
    found = written(rows.mapInArrow(lean(_features), "row long, grade int, words binary"), work_dir(docs.sparkSession, "toxicity"))
    # of documents that share a labelled id, one stands for the label
    one = found.groupBy("row").agg(F.first("grade").alias("grade"), F.min(F.struct(F.xxhash64("words"), "words")).alias("of")).select("grade", F.col("of.words").alias("words"))
    size = {r["bad"]: r["n"] for r in one.groupBy((F.col("grade") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    none = np.zeros(0, np.uint64)
    if len(size) < 2:
        only = {r["grade"]: r["n"] for r in one.groupBy("grade").agg(F.count("*").alias("n")).collect()}
        most = max(sorted(only), key=only.get, default=0)
        return Model(none, np.zeros(0), np.where(np.arange(GRADES - 1) < most, -40.0, 40.0))
    counts = one.mapInArrow(_word_counts, "word long, n_bad long, n_good long").groupBy("word").agg(F.sum("n_bad").alias("n_bad"), F.sum("n_good").alias("n_good"))
    share = (F.col("n_bad") + F.col("n_good")) / F.lit(size[True] + size[False])

    def surprise(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

    def of_class(n: str, rows: int) -> Column:
        return surprise(F.col(n), share * rows) + surprise(rows - F.col(n), (1 - share) * rows)

    ratio = of_class("n_bad", size[True]) + of_class("n_good", size[False])
    rated = counts.select("word", F.round(F.sqrt(2 * F.greatest(ratio, F.lit(0.0))), 9).alias("z"))
    best = rated.orderBy(F.desc("z"), "word").limit(most_words).collect()
    words = np.sort(np.array([r["word"] for r in best if r["z"] >= least_z], np.int64).view(np.uint64))
    got = one.mapInArrow(_kept_words(words), "grade int, bits binary").collect()  # a row a label, most_words bits each
    got.sort(key=lambda r: (r["grade"], bytes(r["bits"])))  # whatever the order of partitions
    grade = np.array([r["grade"] for r in got], np.int64)
    weight = np.array([stands_for[int(g > 0)] for g in grade])
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(words)].astype(np.float32)
    return Model(words, *_fit(x, grade, weight / weight.sum(), ridge, steps))


def _fit(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam on all rows."""
    share = np.clip([weight[grade <= k].sum() for k in range(GRADES - 1)], 1e-3, 1 - 1e-3)
    logit = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(x.shape[1]), logit[:1], np.log(np.maximum(np.diff(logit), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    f = x.shape[1]
    for step in range(1, steps + 1):
        w, rises = p[:f], np.exp(p[f + 1 :])
        theta = p[f] + np.append(0, np.cumsum(rises))
        below = _sigmoid(theta[None, :] - (x @ w.astype(np.float32))[:, None])
        edge = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
        slope = edge * (1 - edge)
        rows = np.arange(len(x))
        prob = np.maximum(edge[rows, grade + 1] - edge[rows, grade], 1e-9)
        up, down = slope[rows, grade + 1] / prob * weight, slope[rows, grade] / prob * weight
        by_score = up - down  # of minus the likelihood, by the score
        g = np.zeros_like(p)
        g[:f] = x.T @ by_score.astype(np.float32) + ridge / max(f, 1) * w
        by_theta = np.array([-up[grade == k].sum() + down[grade == k + 1].sum() for k in range(GRADES - 1)])
        g[f] = by_theta.sum()
        g[f + 1 :] = np.cumsum(by_theta[::-1])[::-1][1:] * rises
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:f], p[f] + np.append(0, np.cumsum(np.exp(p[f + 1 :])))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Expected severity, grade and verdict of every document (``SCORED``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts in text_blocks(batch.column(1)):
                hashes, doc = feature_hashes(data, starts)
                score = np.zeros(j - i)
                if len(model.words):
                    at = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
                    hit = np.flatnonzero(model.words[at] == hashes)
                    seen = np.unique(doc[hit] * len(model.words) + at[hit])  # a word counts once in a text
                    score += np.bincount(seen // len(model.words), model.weights[seen % len(model.words)], minlength=j - i)
                p = model.probabilities(score)
                columns = [batch.column(0).slice(i, j - i), pa.array(p @ np.arange(GRADES)), pa.array(p.argmax(axis=1), pa.int32()), pa.array(p[:, 0] < 0.5)]
                yield pa.record_batch(columns, names=["doc_id", "expected_severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lean(run), SCORED)
