"""Retrieval and answer metrics.

Input: ``hits`` (query_id, rank, doc_id, section_title, ...) and ``questions`` (query_id,
gold, required), where gold is an array of document ids and required one of sections.
Every metric is built from one row a query (``per_query``), so a run needs one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def per_query(hits: DataFrame, questions: DataFrame, *keys: str) -> DataFrame:
    """One row for each question (those without hits too): ranked ids and sections, first rank."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.coalesce("section_title", F.lit("")).alias("section"))))
    lists = hits.groupBy(*keys, "query_id").agg(ranked.alias("_hits"))
    rows = questions.join(lists, [*keys, "query_id"], "left") if all(k in questions.columns for k in keys) else questions.join(lists, "query_id", "left")
    none = F.array().cast("array<string>")
    ids = F.transform("_hits", lambda x: x["doc_id"].cast("string"))
    rows = rows.withColumn("ids", F.coalesce(ids, none)).withColumn("sections", F.coalesce(F.transform("_hits", lambda x: x["section"]), none)).drop("_hits")
    gold = F.col("gold").cast("array<string>")
    places = F.filter(F.transform("ids", lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull())
    return rows.withColumn("first_rank", F.array_min(places))


def reciprocal_rank(first_rank: Column) -> Column:
    return F.when(first_rank > 0, 1.0 / first_rank).otherwise(0.0)


def hit_at(k: int) -> Column:
    return (F.coalesce("first_rank", F.lit(1 << 30)) <= k).cast("double")


def ndcg_at(k: int) -> Column:
    """Binary gains against min(gold, k) ones; no gold gives 0.  Repeated hits of one gold can exceed 1."""
    gold = F.col("gold").cast("array<string>")
    gains = F.transform(F.slice("ids", 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    total = F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size("gold"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return F.when(F.coalesce(F.size("gold"), F.lit(0)) < 1, 0.0).otherwise(total / ideal)


def coverage_at(k: int) -> Column:
    return F.size(F.array_distinct(F.slice("sections", 1, k))).cast("double")


def all_required_at(k: int | None) -> Column:
    """1 if every required section is among the first k hits; none required is a miss."""
    seen = F.slice("sections", 1, k) if k else F.col("sections")
    met = (F.size(F.array_except("required", seen)) == 0) & (F.size("required") > 0)
    return F.coalesce(met.cast("double"), F.lit(0.0))


def evaluate(rows: DataFrame, *keys: str, ks: tuple[int, ...] = (1, 3, 5, 10), section_ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """All ranking and structure metrics of ``per_query`` rows; empty input gives 0s where ungrouped."""

    def mean(c: Column, name: str) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0)).alias(name)

    sections = [x for k in section_ks for x in (mean(all_required_at(k), f"cross_section_recall_{k}"), mean(coverage_at(k), f"section_coverage_{k}"))]
    return rows.groupBy(*keys).agg(
        mean(reciprocal_rank(F.col("first_rank")), "MRR"), *(mean(hit_at(k), f"recall_{k}") for k in ks), mean(ndcg_at(10), "ndcg_10"),
        F.count("*").alias("n_questions"), F.count("first_rank").alias("n_found"), *sections,
    )


def _first_relevant(hits: DataFrame, questions: DataFrame, relevant: Column) -> DataFrame:
    """(query_id, first_rank) of every question, null where no hit is relevant."""
    first = hits.join(questions, "query_id").where(relevant).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return questions.select("query_id").join(first, "query_id", "left")


def jaccard_relevance(hits: DataFrame, questions: DataFrame, threshold: float = 0.3, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row (mrr, recall_k): a hit is relevant if its text is alike enough to the question's own context.

    ``hits``: (query_id, rank, text); ``questions``: (query_id, context).  Recall is the share of
    questions with a relevant hit among the first k.
    """
    rows = _first_relevant(hits, questions, T.jaccard(F.col("text"), F.col("context")) >= threshold)
    return rows.agg(F.coalesce(F.avg(reciprocal_rank(F.col("first_rank"))), F.lit(0.0)).alias("mrr"), *(F.coalesce(F.avg(hit_at(k)), F.lit(0.0)).alias(f"recall_{k}") for k in ks))


def hybrid_relevance(hits: DataFrame, questions: DataFrame, strategy: str, of_context: float = 0.15, of_question: float = 0.12, score: float = 0.55, faithful: bool = True) -> DataFrame:
    """One row (strategy, MRR, recall_1, recall_3, recall_5, n_questions, n_found): a hit is relevant
    by likeness to the context or to the question, or by its score.

    ``hits``: (query_id, rank, text, score); ``questions``: (query_id, question, context).  The
    ``faithful`` recall is 0 always, as the published computation's gold id is one that no chunk
    has; otherwise it is the share of questions with a relevant hit among the first k.
    """
    relevant = (T.jaccard(F.col("text"), F.col("context")) >= of_context) | (T.jaccard(F.col("text"), F.col("question")) >= of_question) | (F.col("score") >= score)
    rows = _first_relevant(hits, questions, relevant)
    recalls = [F.lit(0.0) if faithful else F.round(F.coalesce(F.avg(hit_at(k)), F.lit(0.0)), 4) for k in (1, 3, 5)]
    return rows.agg(
        F.round(F.coalesce(F.avg(reciprocal_rank(F.col("first_rank"))), F.lit(0.0)), 4).alias("MRR"), *(c.alias(f"recall_{k}") for c, k in zip(recalls, (1, 3, 5))),
        F.count("*").alias("n_questions"), F.count("first_rank").alias("n_found"),
    ).select(F.lit(strategy).alias("strategy"), "*")


def accuracy(predicted: Column, gold: Column) -> Column:
    """Mean of equal answers, ends and case aside."""
    return F.coalesce(F.avg((F.lower(F.trim(predicted)) == F.lower(F.trim(gold))).cast("double")), F.lit(0.0))


def ablation(metrics: DataFrame, base: str, metric: str = "MRR", *keys: str) -> DataFrame:
    """Each strategy's difference from the base strategy."""
    of_base = metrics.where(F.col("strategy") == base).select(*keys, F.col(metric).alias("base"))
    joined = metrics.join(of_base, list(keys)) if keys else metrics.join(F.broadcast(of_base))
    return joined.select(*keys, "strategy", metric, (F.col(metric) - F.col("base")).alias("delta"))


def best(metrics: DataFrame, order: str, *keys: str) -> DataFrame:
    """For long-form metrics (metric, strategy, value): the greatest of each metric, the first of equals."""
    rank = Window.partitionBy(*keys, "metric").orderBy(F.desc("value"), order)
    return metrics.withColumn("_n", F.row_number().over(rank)).where("_n = 1").select(*keys, "metric", "strategy", "value")


def long_form(metrics: DataFrame, *keys: str) -> DataFrame:
    names = [c for c in metrics.columns if c not in keys]
    return metrics.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in names], "metric", "value")


def pivoted(long: DataFrame, conditions: list[str]) -> DataFrame:
    return long.groupBy("strategy", "metric").pivot("condition", conditions).agg(F.first("value"))
