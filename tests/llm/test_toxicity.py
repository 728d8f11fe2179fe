import math
import re

import numpy as np
import pytest

from sectionlens.llm import toxicity as T

from . import odd

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels.where("doc_id % 4 <> 0"))
    held = T.score_documents(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    scored = [(r[0], r[1], r[3]) for r in held]
    wrong = [d for d, _, t in scored if t != bool(truth[d])]
    assert len(scored) > 60 and len(wrong) <= 0.03 * len(scored)
    bad = [s for d, s, _ in scored if truth[d]]
    good = [s for d, s, _ in scored if not truth[d]]
    assert np.mean(bad) > 0.8 > 0.2 > np.mean(good)
    assert (np.diff(model.thresholds) > 0).all()


def test_fit_finds_grades():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 6)) < 0.4).astype(np.float32)
    score = x @ np.array([2.0, 1.5, 0, 0, -1, 0])
    noise = np.log(1 / rng.random(3000) - 1)
    grade = (score + noise > 1).astype(int) + (score + noise > 2.5)
    w, theta = T._fit(x, grade, np.full(3000, 1 / 3000), 1e-6, 800)
    assert np.allclose(w, [2, 1.5, 0, 0, -1, 0], atol=0.35) and np.allclose(theta, [1, 2.5], atol=0.35)


@pytest.mark.parametrize("toxic", [0, 1, None])
def test_odd_rows_and_one_class(spark, toxic):
    df = odd.documents(spark)
    labels = spark.createDataFrame([(i, 1, toxic) for i in range(6)] + [(None, 1, 1), (999, 0, None)], "doc_id long, quality int, toxic int")
    rows = T.score_documents(df, T.fit(df, labels)).collect()
    assert len(rows) == df.count() and all(r.toxic == bool(toxic) and abs(r.expected_severity - 2 * (toxic or 0)) < 1e-6 for r in rows)
    assert T.score_documents(odd.empty(spark), T.fit(odd.empty(spark), labels)).count() == 0


def test_long_words_are_told_apart():
    same = "日" * 40
    data = f"{same}a {same}b {same}a".encode()
    hashes, _ = T.feature_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert hashes[0] == hashes[2] != hashes[1] and hashes[3] == hashes[4] == hashes[5]  # their beginnings


def test_scores_equal_a_plain_computation(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels)
    weight = dict(zip(model.words.tolist(), model.weights))

    def known(word):
        low = "".join(c.lower() if c < "\x80" else c for c in word).encode()
        return T.feature_hashes(np.frombuffer(low, np.uint8), np.array([0, len(low)]))[0].tolist()

    rows = docs.where("doc_id % 9 = 0").collect()
    got = {r.doc_id: r for r in T.score_documents(docs.where("doc_id % 9 = 0"), model).collect()}
    for r in rows:
        found = {h for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", r.text or "") for h in known(w)}
        score = sum(weight.get(h, 0.0) for h in found)
        below = [0.0, *(1 / (1 + math.exp(score - t)) for t in model.thresholds), 1.0]
        p = [b - a for a, b in zip(below, below[1:])]
        assert abs(got[r.doc_id].expected_severity - (p[1] + 2 * p[2])) < 1e-6 and got[r.doc_id].toxic == (p[0] < 0.5)


def test_words_are_those_of_greatest_odds(spark):
    rows = [(i, f"common w{i % 7} " + ("vile " if i % 2 else "kind ") + ("rare" if i == 1 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows + [(3, "another text of id three")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = T.fit(docs, labels)
    hashes = {w: int(T.feature_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for w in ("vile", "kind", "common", "rare")}
    kept = dict(zip(model.words.tolist(), model.weights))
    assert kept[hashes["vile"]] > 0 > kept[hashes["kind"]] and hashes["common"] not in kept and hashes["rare"] not in kept
    scored = {r.doc_id: r.toxic for r in T.score_documents(docs.limit(60), model).collect()}
    assert all(scored[i] == bool(i % 2) for i in range(60) if i != 3)


def test_beginnings_are_of_characters():
    words = ["schön", "schöner", "schö", "scho", "schonen"]
    got = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        got.append(T.feature_hashes(data, np.array([0, len(data)]))[0].tolist())
    assert [len(g) for g in got] == [2, 2, 1, 1, 2] and got[0][1] == got[1][1] != got[4][1] and got[0][1] != got[2][0]


def test_words():
    text = "Ab, aB cd\n\nÉt ab".encode()
    hashes, doc = T.feature_hashes(np.frombuffer(text + b"ab", np.uint8), np.array([0, len(text), len(text) + 2]))
    assert doc.tolist() == [0, 0, 0, 0, 0, 1] and len(set(hashes.tolist())) == 3
