"""Sinks: partitioned tables, resumable results, JSON exports, and report texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .articles import exists


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrites only the partitions that the rows have."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_index(chunks: DataFrame, path: str, dim: int | None = None) -> None:
    """A chunk table as an index, its vectors of length 1; one without vectors, or with some of
    another width than ``dim`` (that of the first, if not given), is refused."""
    if "embedding" not in chunks.columns:
        raise ValueError("the index has not been built")
    rows = chunks.where("embedding is not null")
    widths = rows.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if widths.low is None:
        raise ValueError("the index has not been built")
    if (widths.low, widths.high) != (dim or widths.low,) * 2:
        raise ValueError(f"vectors of {widths.low} to {widths.high} numbers in an index of {dim or widths.low}")
    rows.withColumn("embedding", V.l2_normalise(F.col("embedding")).cast("array<float>")).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pending(work: DataFrame, done: DataFrame | None, *keys: str) -> DataFrame:
    """Work whose keys have no result yet."""
    return work if done is None else work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def read_results(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Rows of the first of several results (JSON or Parquet folders or files) that exists; none if none does."""
    for p in paths:
        if exists(spark, p):
            found = spark.read.schema(schema)
            return found.parquet(p) if p.rstrip("/").endswith(".parquet") else found.json(p, multiLine=p.endswith(".json"))
    return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def chunk_entity_map(chunk_names: DataFrame, key: str = "chunk_idx") -> DataFrame:
    """(key, names): the entities of each chunk, one entry a mention, by name; for ``write_json``."""
    return chunk_names.groupBy(F.col(key).cast("string").alias(key)).agg(F.sort_array(F.collect_list("name")).alias("names"))


def summary(results: DataFrame, condition: str | None = None) -> DataFrame:
    """Results without their per-query values, which are too large for a summary."""
    rows = results.drop("per_query_rr")
    return rows if condition is None else rows.withColumn("condition", F.lit(condition))


def significance_map(tests: DataFrame) -> DataFrame:
    """(condition, tests): each condition's tests as a map by competitor, rounded; for ``write_json``."""
    values = [c for c, t in tests.dtypes if t == "double"]
    one = F.struct("competitor", F.struct(*(F.round(c, 6).alias(c) for c in values)).alias("test"))
    return tests.groupBy("condition").agg(F.map_from_entries(F.sort_array(F.collect_list(one))).alias("tests"))


def figure_frames(metrics: DataFrame, base: str, conditions: list[str]) -> dict[str, DataFrame]:
    """The frames behind the report's figures, from rows (condition, strategy, MRR, section_coverage_20, ...):
    bars of a metric by strategy, steps from a base strategy, MRR over conditions, and a heat map."""
    of_base = metrics.where(F.col("strategy") == base).select("condition", F.col("MRR").alias("_base"))
    return {
        "bars": metrics.unpivot(["condition", "strategy"], [c for c, t in metrics.dtypes if t == "double"], "metric", "value"),
        "waterfall": metrics.join(of_base, "condition").select("condition", "strategy", (F.col("MRR") - F.col("_base")).alias("delta")),
        "crossover": metrics.select("condition", "strategy", "MRR"),
        "heat": metrics.groupBy("strategy").pivot("condition", conditions).agg(F.first("MRR")),
        "coverage": metrics.select("condition", "strategy", *(c for c in metrics.columns if c.startswith("section_coverage_"))),
    }


def console_table(metrics: DataFrame, columns: list[str], rows: int = 100) -> str:
    """A report-sized frame as lines of text."""
    found = metrics.select("strategy", *columns).orderBy("strategy").limit(rows).collect()
    shown = [["strategy", *columns], *([r.strategy, *("--" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns)] for r in found)]
    width = [max(len(r[k]) for r in shown) for k in range(len(columns) + 1)]
    return "\n".join("  ".join(x.ljust(w) if k == 0 else x.rjust(w) for k, (x, w) in enumerate(zip(r, width))) for r in shown)


def latex_table(metrics: DataFrame, columns: list[str], caption: str, label: str) -> str:
    """A LaTeX table of a report-sized frame (strategy, columns...), greatest values in bold."""
    rows = metrics.select("strategy", *columns).orderBy("strategy").limit(100).collect()
    top = {c: max((r[c] for r in rows if r[c] is not None), default=None) for c in columns}

    def cell(r, c: str) -> str:
        if r[c] is None:
            return "--"
        shown = f"{r[c]:.3f}"
        return rf"\textbf{{{shown}}}" if r[c] == top[c] else shown

    body = [" & ".join([r.strategy.replace("_", r"\_"), *(cell(r, c) for c in columns)]) + r" \\" for r in rows]
    head = " & ".join(["Strategy", *(c.replace("_", r"\_") for c in columns)]) + r" \\"
    lines = [r"\begin{table}[t]", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{l{'r' * len(columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"]
    return "\n".join(lines)


def replace_table(document: str, label: str, table: str) -> str:
    """A LaTeX document with the table of that label replaced; unchanged if it has none."""
    pattern = re.compile(r"\\begin\{table\}(?:(?!\\end\{table\}).)*?\\label\{" + re.escape(label) + r"\}.*?\\end\{table\}", re.S)
    return pattern.sub(lambda _: table, document, count=1)


def crossover(summary: DataFrame, fallback: DataFrame | None, expected: DataFrame) -> DataFrame:
    """Expected (condition, strategy) rows with MRR from the summary, else from the fallback; gaps stay null."""
    rows = expected.join(summary.select("condition", "strategy", F.col("MRR").alias("_a")), ["condition", "strategy"], "left")
    if fallback is None:
        return rows.withColumnRenamed("_a", "MRR")
    rows = rows.join(fallback.select("condition", "strategy", F.col("MRR").alias("_b")), ["condition", "strategy"], "left")
    return rows.select("condition", "strategy", F.coalesce("_a", "_b").alias("MRR"))
