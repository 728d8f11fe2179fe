"""Paired bootstrap tests and Holm's correction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TESTED = "observed_diff double, p_value double, ci_lower double, ci_upper double"


def paired_bootstrap(a: Sequence[float], b: Sequence[float], n_bootstrap: int = 10_000, seed: int = 42) -> tuple[float, float, float, float]:
    """Observed difference of means (a - b), its two-sided p value, and 2.5 and 97.5 percentiles.

    Replicates draw the same places of both, by the seeded Mersenne twister; the p value is
    the share of replicates that lie as far from their own mean as the observed difference
    does from 0.  The replicates are drawn in blocks, which leaves the sequence as it is.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, rng = len(a), np.random.RandomState(seed)
    observed = a.mean() - b.mean()
    diffs, done = np.empty(n_bootstrap), 0
    while done < n_bootstrap:
        block = max(1, min(n_bootstrap - done, 2_000_000 // max(n, 1)))
        at = rng.randint(0, n, size=(block, n))
        diffs[done : done + block] = a[at].mean(axis=1) - b[at].mean(axis=1)
        done += block
    p = np.mean(np.abs(diffs - diffs.mean()) >= abs(observed))
    low, high = np.percentile(diffs, [2.5, 97.5])
    return float(observed), float(p), float(low), float(high)


def holm_values(ps: Sequence[float]) -> list[float]:
    order, out, high = sorted(range(len(ps)), key=lambda i: ps[i]), [0.0] * len(ps), 0.0
    for k, i in enumerate(order):
        high = max(high, min(1.0, ps[i] * (len(ps) - k)))
        out[i] = high
    return out


def bootstrap(pairs: DataFrame, *keys: str, n_bootstrap: int = 10_000, seed: int = 42) -> DataFrame:
    """Tests each group of (keys, seq, a, b), its rows in the order of ``seq``."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pd.DataFrame([[*pdf[list(keys)].iloc[0], *paired_bootstrap(pdf.a, pdf.b, n_bootstrap, seed)]], columns=[*keys, *(x.split()[0] for x in TESTED.split(", "))])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)
    return pairs.groupBy(*keys).applyInPandas(test, f"{types}, {TESTED}")


def holm(tests: DataFrame, *keys: str, order: str = "competitor") -> DataFrame:
    """Adds adjusted_p_value, corrected within each group of keys."""
    rows = Window.partitionBy(*keys)
    ranked = tests.withColumn("_k", F.row_number().over(rows.orderBy("p_value", order))).withColumn("_n", F.count("*").over(rows))
    step = F.least(F.col("p_value") * (F.col("_n") - F.col("_k") + 1), F.lit(1.0))
    running = rows.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("adjusted_p_value", F.max(step).over(running)).drop("_k", "_n")


def significance(per_query_rr: DataFrame, baseline: str, n_bootstrap: int = 10_000, seed: int = 42) -> DataFrame:
    """Tests the baseline strategy against each other one by condition, on queries of both;
    pairs of unequal length are skipped.  Input: (condition, strategy, query_id, rr)."""
    base = per_query_rr.where(F.col("strategy") == baseline).select("condition", "query_id", F.col("rr").alias("a"))
    rest = per_query_rr.where(F.col("strategy") != baseline).select("condition", F.col("strategy").alias("competitor"), "query_id", F.col("rr").alias("b"))
    whole = base.groupBy("condition").agg(F.count("*").alias("_n"))
    joined = rest.join(base, ["condition", "query_id"]).withColumn("_have", F.count("*").over(Window.partitionBy("condition", "competitor")))
    pairs = joined.join(whole, "condition").where("_have = _n").withColumnRenamed("query_id", "seq").drop("_have", "_n")
    return holm(bootstrap(pairs, "condition", "competitor", n_bootstrap=n_bootstrap, seed=seed), "condition")


def rounded(tests: DataFrame, digits: int = 6) -> DataFrame:
    """The report's digits; corrections are worked out before."""
    return tests.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in tests.dtypes))
