import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sectionlens.llm import quality_rules
from tests.conftest import SMALL

from . import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def check(df):
    got = quality_rules.quality(df).collect()
    rows = df.select("doc_id", "text").collect()
    expected = Counter((r.doc_id, *(b := base(r.text)), b[0] < 50 or 100 * b[4] > 50 * b[0]) for r in rows)
    assert Counter(tuple(r)[:7] for r in got) == expected
    assert not any(r.kept and (r.base_failed or r.failed_rules) for r in got)
    return {r.doc_id: r for r in got}


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = odd.TEXTS + [" ".join(rng.choice("a b c d e f".split()) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    check(odd.documents(spark, texts))
    check(spark.read.parquet(f"{SMALL}/documents.parquet"))
    check(odd.empty(spark))


def test_windows_of_one_hash_are_told_apart(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(n)) for n in (3, 4, 40, 300, 700)]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    for bits in (0, 1, 5):
        got = df.select("doc_id", quality_rules.n_repeat_words(quality_rules.words(F.col("text")), bits).alias("n")).collect()
        assert {r.doc_id: r.n for r in got} == {i: base(t)[4] for i, t in enumerate(texts)}


def test_rules_reject_junk_and_keep_prose(spark):
    prose = " ".join(f"the {a}{b} of and {b}{a} in it" for a in "kelm toru".split() for b in "ab cd ef gh ij kl".split())
    junk = {
        "symbols": " ".join(f"the w{i}###" for i in range(80)),
        "shouts": " ".join(f"W{i}!!" for i in range(80)),
        "no stop words": " ".join(f"kel{i}" for i in range(80)),
        "lines": "\n".join(["the line that one sees again"] * 2 + [f"of {i} and the" for i in range(12)] + ["x of the"] * 20),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([prose, *junk.values()])], "doc_id long, text string")
    got = check(df)
    assert got[0].kept and not any(got[i].kept for i in range(1, len(junk) + 1))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality_rules.quality(spark.read.parquet(f"{SMALL}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept == (r.quality == 1) for r in rows)


def test_plan_is_one_projection(spark):
    plan = quality_rules.quality(odd.empty(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
