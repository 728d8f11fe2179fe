import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sectionlens.llm import merkle
from tests.conftest import SMALL

from . import odd

#: Ids, texts and what follows each in descending order are worked out here on the driver.


def brute(df):
    hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    rows = sorted(((r.doc_id, r.h, r.text) for r in hashed), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (doc_id, _, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), text, edit, following))
    return out


@pytest.mark.parametrize(("ranges", "samples"), [(1, 24), (8, 24), (30, 1)])
def test_fingerprints(spark, monkeypatch, ranges, samples):
    monkeypatch.setattr(merkle, "RANGES", ranges)
    monkeypatch.setattr(merkle, "SAMPLES", samples)
    far = [(d, f"text {k}. It says {k % 4}.") for k, d in enumerate([2**63 - 1, -(2**63), 5, None, None, -(2**63) + 1, 2**63 - 1, 9007199254740993])]
    far = spark.createDataFrame(far, "doc_id long, text string")
    for df in (odd.documents(spark), spark.read.parquet(f"{SMALL}/documents.parquet"), odd.documents(spark, odd.TEXTS[4:5]).limit(1), far):
        got = merkle.fingerprints(df).collect()
        expected = brute(df)
        assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted((d or -1, n, s) for d, n, s, *_ in expected)
        of_text = {}
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            for doc_id, n, s, text, edit, _ in expected:
                if (doc_id, n, s) == (r.doc_id, r.n_chars, r.edited_sha256):
                    assert of_text.setdefault(text, r.fingerprint) == r.fingerprint
                    assert of_text.setdefault(edit, r.edited_fingerprint) == r.edited_fingerprint
                    break
        assert len(set(of_text.values())) == len(of_text)
    assert merkle.fingerprints(odd.empty(spark)).count() == 0


def test_likeness_tells_halves(spark):
    rows = merkle.fingerprints(spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars > 2000"))
    both = rows.withColumn("again", merkle.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).collect()
    assert all(abs(r.again - r.near_edited) < 1e-12 for r in both)
    halves = [r for r in both if r.near_next < 0.2]
    assert len(halves) > 10 and all(0.3 < r.near_edited < 0.75 for r in halves)


def test_likeness_counts_leaves_and_stays_below_one(spark):
    line = "the same line again."
    other = [f"prose number {i} is here." for i in range(100)]
    pairs = [
        ("\n".join([line] * 200), "\n".join([line] * 100 + other)), ("\n".join(other), "\n".join(other[::-1])), ("", "\n"), ("a. b.", "a. b."),
        ("\n".join([line] * 200), "\n".join([line] * 150)),
    ]
    df = spark.createDataFrame(pairs, "a string, b string").select(*(merkle.tree(F.col(c))["fingerprint"].alias(c) for c in "ab"))
    half, turned, blank, same, fewer = (r.n for r in df.select(merkle.likeness(F.col("a"), F.col("b")).alias("n")).collect())
    assert 0.4 < half < 0.55 and 0.99 < turned < 1 and blank == 0 and same == 1 and abs(fewer - 300 / 350) < 1e-9


def test_rows_without_ids_are_split(spark):
    df = spark.createDataFrame([(None, "one text. For all.")] * 3000 + [(2**62, "far")], "doc_id long, text string").repartition(4)
    plan = merkle.with_next(df)
    assert sorted(r.next_text for r in plan.select("next_text").collect()) == ["far"] + ["one text. For all."] * 3000
    keys = [(0, 5, -3, 1), (0, 5, 4, 2), (0, 5, 4, 9), (1, 0, 0, 0)]
    rows = spark.createDataFrame([(0, 4, 0, 0), (0, 5, -3, 1), (0, 5, 4, 8), (0, 5, 4, 9), (0, 6, 0, 0), (1, 0, 0, 0), (1, 0, 7, 0)], "a long, b long, c long, d long")
    assert [r.n for r in rows.select(merkle._range_of([F.col(x) for x in "abcd"], keys).alias("n")).collect()] == [0, 1, 2, 3, 3, 4, 4]


def test_differing_tells_edits_with_their_places(spark):
    lines = [f"line {i} stands here. It says {i * i}!?" for i in range(60)]
    changed, before = [*lines], sum(len(x) + 1 for x in lines[:30])
    changed[30] = "another line é altogether. And more"
    df = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string").select(*(merkle.tree(F.col(c))["fingerprint"].alias(c) for c in "ab"))
    got = df.select(merkle.differing(F.col("a"), F.col("b")).alias("a"), merkle.differing(F.col("b"), F.col("a")).alias("b"), merkle.differing(F.col("a"), F.col("a")).alias("same")).first()
    assert [tuple(x)[1:] for x in got.a] == [(30, before, before + len(lines[30]))] and got.same == []
    assert [tuple(x)[1:] for x in got.b] == [(30, before, before + len(changed[30]))]


def test_branches_locate_edits(spark):
    lines = [f"line {i} stands here. It says {i * i}." for i in range(60)]
    changed = [*lines]
    changed[30] = "another line altogether."
    df = spark.createDataFrame([("\n".join(lines),), ("\n".join(changed),)], "text string")
    a, b = [r.f for r in df.select(merkle.tree(F.col("text"))["fingerprint"].alias("f")).collect()]
    sections = [set(x.split(":")[1].split(";")) for x in (a, b)]
    differing = sections[0] - sections[1]
    assert a.split(":")[0] != b.split(":")[0] and 1 <= len(differing) <= 2 < len(sections[0])
    leaves = [re.findall("=([0-9a-f]*)", x) for x in (a, b)]
    assert [i for i, (x, y) in enumerate(zip(*leaves)) if x != y] == [30]


def test_plan_is_native(spark):
    plan = merkle.fingerprints(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
