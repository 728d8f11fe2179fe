import hashlib
import random

import numpy as np
import pytest

from sectionlens.llm import suffix_dedup as S
from tests.conftest import SMALL

from . import odd


def brute(rows, length):
    """rows: (doc_id, text) in order; what is left of each, and its removed runs."""
    seen, out = {}, []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            else:
                seen[w] = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])) == 1)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((doc_id, len(data), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ordered(df):
    """In the order in which the operator counts them: ids, then files' order."""
    rows = df.select("doc_id", "text").collect()
    return sorted(((r.doc_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0))


@pytest.mark.parametrize("hot", [0, 0.05, 1.0, 1e9])
@pytest.mark.parametrize(("length", "gram"), [(12, 5), (20, 8), (100, 32)])
def test_equals_brute_force(spark, length, gram, hot):
    rng = random.Random(length)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(length // 2, 3 * length))) for _ in range(12)]
    texts = []
    for _ in range(220):
        parts = [rng.choice(passages)[rng.randint(0, 4) :] if rng.random() < 0.5 else "".join(rng.choice("ab ") for _ in range(rng.randint(0, length))) for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    texts += [texts[5], texts[7], "aaaa" * length, "ab" * (3 * length), None, "", "x" * (length - 1), "x" * length, "x" * (length + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in S.dedup(df, length, gram, hot_share=hot).collect()), key=str)
    assert got == brute(ordered(df), length)


def test_documents_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    rows = S.dedup(docs, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == brute(ordered(docs), 100)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in rows:
        left, at = [], 0
        for s, e in zip(r.spans[::2], r.spans[1::2]):
            left.append(texts[r.doc_id][at:s])
            at = e
        assert b"".join([*left, texts[r.doc_id][at:]]) == bytes(r.kept)
    strange = odd.documents(spark).coalesce(1)
    got = S.dedup(strange).collect()
    assert sum(r.n_bytes for r in got) == sum(len((r.text or "").encode()) for r in strange.collect()) and len(got) == strange.count()
    assert sum(r.doc_id is None for r in got) == 3
    far = [2**63 - 1, -(2**63), None, 9007199254740993, 2**63 - 1]
    ends = spark.createDataFrame([(d, f"{k % 3} " * 80) for k, d in enumerate(far)], "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in S.dedup(ends).collect()), key=str) == brute(ordered(ends), 100)
    assert S.dedup(odd.empty(spark)).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(0)
    for n, top in ((0, 2), (1, 2), (2, 1), (50, 2), (400, 3), (300, 1 << 60), (5000, 2), (3000, 1)):
        words = rng.integers(0, top, (n, 5), dtype=np.uint64)
        order, depth = S.multikey_order(words)
        rows = [tuple(x) for x in words[order].tolist()]
        assert rows == sorted(map(tuple, words.tolist()))
        for i in range(1, n):
            assert depth[i] == next((k for k in range(5) if rows[i][k] != rows[i - 1][k]), 5)


def test_window_portions_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    length, gram, n = 12, 5, 500
    left = length - gram
    rows = rng.integers(97, 99, (n, left + length)).astype(np.uint8)
    rows[:, left : left + gram] = np.frombuffer(b"abcde", np.uint8)
    rows[:, left] = rng.integers(65, 75, n)  # ten anchors
    low, high = rng.integers(0, 3, n), rng.integers(3, left + 1, n)
    rank = rng.permutation(n)
    whole = S.first_and_repeats(rows, low, high, rank, length, gram)
    expected = []
    for i in range(n):
        own = [r for r in range(low[i], high[i] + 1) if any(rank[j] < rank[i] and low[j] <= r <= high[j] and (rows[i, left - r : left - r + length] == rows[j, left - r : left - r + length]).all() and (rows[i, left : left + gram] == rows[j, left : left + gram]).all() for j in range(n))]
        expected.append((min(own, default=1 << 30), max(own, default=-1)))
    assert list(zip(*(x.tolist() for x in whole))) == expected
    for size in (1, 7, 100):
        monkeypatch.setattr(S, "WINDOW_ROWS", size)
        assert all((a == b).all() for a, b in zip(whole, S.first_and_repeats(rows, low, high, rank, length, gram)))


def test_anchors_are_of_the_windows_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000, dtype=np.uint8)
    data[2000:2400] = data[100:500]
    starts = np.array([0, 40, 1500, 3000])
    place, value, first, last = S.anchors(data, starts, 60, 20)
    of = {x: p for p, a, b in zip(place, first, last) for x in range(a, b + 1)}
    assert sorted(of) == [x for a, b in zip(starts, starts[1:]) for x in range(a, b - 59)]
    seen = {}
    for x, p in of.items():
        assert x <= p <= x + 40
        assert seen.setdefault(data[x : x + 60].tobytes(), p - x) == p - x
