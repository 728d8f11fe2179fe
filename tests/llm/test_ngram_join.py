import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from sectionlens.llm import ngram_join as J
from tests.conftest import SMALL

from . import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(doc_id, class_id, copy_id, n_links) of each row."""
    n = len(rows)
    sets = [grams(t) for _, t in rows]
    of_gram = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            of_gram[g].add(i)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in {p for m in of_gram.values() for p in combinations(sorted(m), 2)}:
        a, b = sets[i], sets[j]
        if 5 * len(a & b) >= 4 * len(a | b):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    groups, copies = defaultdict(list), defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
        copies[sets[i] or i].append(doc_id)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted(((d, least(groups[find(i)]), least(copies[sets[i] or i]), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def check(df):
    got = sorted((tuple(r) for r in J.join(df).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("tile", [7, 1024])
def test_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE", tile)
    rng = random.Random(4)
    texts = []
    for _ in range(14):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = [*base]
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9)}"
            texts.append(" ".join(copy))
    check(odd.documents(spark, odd.TEXTS + texts))


def test_documents_and_empty(spark):
    check(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert J.join(odd.empty(spark)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = J.bands_for(0.8)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert J.bands_for(0.8, 0.9)[1] > rows


def test_bands_find_pairs_at_the_threshold():
    """Measured: of 4,000 pairs of sets at Jaccard 0.8 exactly, those that share a bucket."""
    rng = np.random.default_rng(12)
    bands, rows = J.bands_for(0.8)
    sets = []
    for _ in range(4000):
        grams = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        sets += [np.sort(grams[:54]), np.sort(grams[6:])]  # 48 in common, 60 in all
    bounds = np.append(0, np.cumsum([len(x) for x in sets]))
    _, keys = J.signatures(np.concatenate(sets), bounds, bands, rows)
    found = (keys[::2] == keys[1::2]).any(axis=1)
    assert found.mean() >= 0.999
    selective = (keys[::2][:-1] == keys[1::2][1:]).any(axis=1)
    assert not selective.any()


def test_links_of_near_copies_equal_brute_force(spark):
    """One group in which every two differ a little, many of them just over or under the threshold."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(160):
        copy = [*base]
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(copy))
    check(odd.documents(spark, odd.TEXTS + texts))


def test_components_of_paths_and_stars(spark, tmp_path):
    rng = random.Random(1)
    n = 300
    shuffled = rng.sample(range(n), n)
    for k, edges in enumerate([list(zip(range(n), range(1, n))), list(zip(shuffled, shuffled[1:])), [(rng.randrange(n), rng.randrange(n)) for _ in range(250)], [(0, i) for i in range(1, 99)] + [(5, 5)]]):
        root = list(range(n + 1))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        got = {r.node: r.label for r in J.connected(spark.createDataFrame(edges, "a int, b int"), f"{tmp_path}/{k}").collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_ngrams_tell_documents_apart():
    texts = [b"a b c d e f", b"", b"a b", b"  a\tb\nc d e ", b"a b c d e a b c d e"]
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    sets, bounds = J.ngrams(np.frombuffer(b"".join(texts), np.uint8), starts)
    assert np.diff(bounds).tolist() == [2, 0, 1, 1, 5]
    parts = [set(sets[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    assert parts[3] <= parts[0] and parts[3] <= parts[4] and not parts[2] & parts[0]


def test_common_counts():
    rng = np.random.default_rng(3)
    for n, top in ((3, 5), (60, 40), (40, 4000)):
        sets = [np.unique(rng.integers(0, top, rng.integers(0, 60))).astype(np.uint64) for _ in range(n)]
        got = J.common_counts(np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets), n)
        for i in range(n):
            for j in range(n):
                assert i == j or got[i, j] == len(np.intersect1d(sets[i], sets[j]))
