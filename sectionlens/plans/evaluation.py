"""Evaluation plans: strategies over chunks, questions and entity tables, to metrics."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, entities, metrics, qa, retrieval
from ..operators.embedding import Embedder, EntityEncoder, TokenEncoder, embed
from ..sources import sinks
from ..sources.work import dropped, work_dir, written

TOP_K = 20


@dataclass(frozen=True)
class Strategy:
    """A chunker, whether entity vectors are blended in, and whether hits are re-ranked."""

    name: str
    chunker: str
    infused: bool = False
    reranked: bool = False


STRATEGIES = (
    Strategy("naive", "naive"), Strategy("semantic", "semantic"), Strategy("late_chunking", "late"), Strategy("structure_aware", "structure"),
    Strategy("kg_infused", "structure", True), Strategy("kg_infused_graph", "structure", True, True),
)
#: Chunkers that name no sections.
UNTITLED = ("naive", "semantic", "late")


def texts_of(paragraphs: DataFrame, separator: str = " ") -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("position", "text")))
    return paragraphs.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda x: x["text"]), separator).alias("text"))


def chunks_of(paragraphs: DataFrame, chunker: str, embedder: Embedder, tokens: TokenEncoder, mentions: DataFrame | None = None) -> DataFrame:
    """Embedded chunks (doc_id, position, text, section_title, embedding, chunk_idx) of one chunker."""
    if chunker == "naive":
        rows = chunking.naive(texts_of(paragraphs), 256, 32)
    elif chunker == "semantic":
        rows = chunking.semantic(texts_of(paragraphs), embedder, 0.75, 256)
    elif chunker == "late":
        rows = chunking.late(texts_of(paragraphs), tokens)
    elif chunker == "structure":
        rows = chunking.structure_aware(paragraphs, tokens, mentions, 64, 256, 0.3)
    else:
        raise ValueError(chunker)
    if "section_title" not in rows.columns:
        rows = rows.withColumn("section_title", F.lit(None).cast("string"))
    columns = ["doc_id", "position", "text", "section_title"]
    # late and section-aware chunks have their vectors: no other Python worker has to hold them
    rows = rows.select(*columns, "embedding") if "embedding" in rows.columns else embed(rows.select(*columns), embedder)
    return rows.withColumn("chunk_idx", F.struct("doc_id", "position"))


def hits_of(questions: DataFrame, chunks: DataFrame, k: int = TOP_K, texts: bool = True, folder: str | None = None, gold_only: bool = False) -> DataFrame:
    """Ranked hits with the chunks' documents and sections, which the search itself reads, and their
    ``texts``, which are joined.  ``questions``: (query_id, embedding), and gold if ``gold_only``:
    questions none of whose gold chunks is among the k then get one hit, of another document."""
    carry = [c for c in ("doc_id", "section_title") if c in chunks.columns]
    asked, stop = questions.select("query_id", "embedding"), None
    if gold_only:
        asked, stop = asked.join(retrieval.gold_cosines(questions, chunks), "query_id", "left"), "best"
    found = retrieval.top_k(asked, chunks, k, carry=carry, folder=folder, stop=stop)
    return found.join(chunks.select("chunk_idx", "text"), "chunk_idx") if texts and "text" in chunks.columns else found


def hits_of_both(questions: DataFrame, chunks: DataFrame, k: int, folder: str) -> DataFrame:
    """Hits, without texts, of chunks of which some are to be moved (chunk_idx, doc_id, section_title,
    plain, embedding, which is null for those that stay): ``more`` marks those, and the k best of the
    chunks that stay are all there, whatever their rank."""
    stay, move = (chunks.where(F.col("embedding").isNull() == alone).withColumn("embedding", F.col("plain")) for alone in (True, False))
    return retrieval.top_k(questions.select("query_id", "embedding"), stay, k, carry=["doc_id", "section_title"], folder=folder, more=move)


def hits_of_moved(questions: DataFrame, chunks: DataFrame, both: DataFrame, k: int, folder: str) -> DataFrame:
    """Hits of the same chunks with moved ones in their new places: only these are searched, and only
    as far as they may be among the k; the chunks that stay have been found by ``hits_of_both``."""
    stay = both.where("not more").drop("more", "rank")
    last = stay.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "floor")
    asked = questions.select("query_id", "embedding").join(last, "query_id", "left")
    found = retrieval.top_k(asked, chunks, k, carry=["doc_id", "section_title"], folder=folder, floor="floor").drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_idx")
    return found.unionByName(stay).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def article_of(doc_id: Column) -> Column:
    """The part of a document's id before ``__``: conditions of one article share it."""
    return F.substring_index(doc_id.cast("string"), "__", 1)


def known_questions(questions: DataFrame, paragraphs: DataFrame, gold: str = "gold", short: bool = False) -> DataFrame:
    """Questions one of whose gold documents is in the corpus; ``short`` compares ids up to ``__``."""
    cut = article_of if short else (lambda c: c.cast("string"))
    questions = written(questions, work_dir(questions.sparkSession, "questions"))  # read twice
    known = paragraphs.select(cut(F.col("doc_id")).alias("_doc")).distinct()
    asked = questions.select("query_id", F.explode(F.col(gold).cast("array<string>")).alias("_gold")).withColumn("_gold", cut(F.col("_gold")))
    return questions.join(asked.join(known, F.col("_gold") == F.col("_doc"), "left_semi").select("query_id").distinct(), "query_id", "left_semi")


@dataclass
class Searched:
    """What a strategy finds: its embedded chunks, the questions asked, and their ranked hits."""

    chunks: DataFrame
    questions: DataFrame
    hits: DataFrame


def search(paragraphs: DataFrame, questions: DataFrame, strategy: Strategy, embedder: Embedder, tokens: TokenEncoder, terms: DataFrame | None = None, k: int = TOP_K, pool: int | None = None, entity_encoder: EntityEncoder | None = None, texts: bool = True, made: dict | None = None, gold_only: bool = False, twice: bool = False) -> Searched:
    """Chunks the articles, embeds chunks and questions, and ranks the best ``k`` chunks of each
    question; re-ranking strategies draw from a pool of ``pool`` hits (``k`` if not given).
    Entities are encoded by an encoder of their own, projected to the chunks' width, if one is given.

    Chunks are a written table: they are read by the search, by the entity joins and by the
    join that gives hits their documents.  ``made`` holds the tables of earlier strategies over the
    same inputs: what two strategies have in common is made once.  ``gold_only``: see ``hits_of``.  ``twice`` says that the same chunks are searched with
    and without entities (and without texts): those that mention none are searched once for both.
    """
    spark = paragraphs.sparkSession
    made = {} if made is None else made

    def once(name: str, make: Callable[[], DataFrame], *key: object) -> DataFrame:
        if (name, *key) not in made:
            folder = work_dir(spark, name)
            made[name, *key] = written(make(), folder), folder
        return made[name, *key][0]

    chunker, vectors = strategy.chunker, None
    # read by the search and by the metrics
    questions = once("asked", lambda: embed(known_questions(questions, paragraphs), embedder, "question"))
    mentions = once("mentions", lambda: entities.mentions(texts_of(paragraphs, "\n\n"), terms)) if terms is not None and chunker == "structure" else None
    chunks = once("chunks", lambda: chunks_of(paragraphs, chunker, embedder, tokens, mentions), chunker)
    infused = strategy.infused and terms is not None
    twice = twice and terms is not None and not gold_only and not texts
    if infused or twice:
        plain = chunks
        named = once("chunk-names", lambda: entities.mentions(plain, terms, "chunk_idx").select("chunk_idx", F.col("text").alias("name")), chunker)
        encoded = once("entity-vectors", lambda: entities.encode_entities(named, entity_encoder or embedder), chunker)
        vectors = encoded if entity_encoder is None else once("projected", lambda: entities.project_table(encoded, embedder.dim), chunker)
        lean = plain if texts else plain.drop("text")
        moved = once("infused", lambda: entities.infuse_chunks(lean.withColumn("plain", F.col("embedding")) if twice else lean, named, vectors, moved_only=twice), chunker, texts, twice)
        chunks = moved if infused else plain
    reranked = infused and strategy.reranked and vectors is not None
    most = max(k, pool or k) if reranked else k
    if ("hits", chunker, infused, most, gold_only) not in made:
        index = work_dir(spark, "search-index")
        if twice:
            both = once("hits-both", lambda: hits_of_both(questions, moved, most, f"{index}/both"), chunker, most)
        if twice and infused:
            once("hits", lambda: hits_of_moved(questions, moved, both, most, f"{index}/moved"), chunker, infused, most, gold_only)
        elif twice:
            made["hits", chunker, infused, most, gold_only] = both.where(F.col("rank") <= most).drop("more"), made["hits-both", chunker, most][1]
        else:
            once("hits", lambda: hits_of(questions, chunks, most, False, index, gold_only), chunker, infused, most, gold_only)
        dropped(spark, index)
    hits = made["hits", chunker, infused, most, gold_only][0]
    if reranked:
        asked_names = once("asked-names", lambda: entities.mentions(questions.select("query_id", F.col("question").alias("text")), terms, "query_id").select("query_id", F.col("text").alias("name")))
        ranked = retrieval.rerank(hits, asked_names, named, vectors, k, 0.7, "script")
        hits = ranked.join(hits.select("query_id", "chunk_idx", "doc_id", "section_title"), ["query_id", "chunk_idx"])
    if texts:
        hits = hits.join(chunks.select("chunk_idx", "text"), "chunk_idx")
    return Searched(chunks, questions, hits)


def evaluate(paragraphs: DataFrame, questions: DataFrame, strategy: Strategy, embedder: Embedder, tokens: TokenEncoder, terms: DataFrame | None = None, k: int = TOP_K, made: dict | None = None, twice: bool = False) -> DataFrame:
    """One row of metrics of a strategy.  ``questions``: (query_id, question, gold, required);
    those whose gold documents are all absent are left out.

    Chunks without sections count by the ranks of gold ones alone, so a search ends where these are known.
    """
    found = search(paragraphs, questions, strategy, embedder, tokens, terms, k, texts=False, made=made, gold_only=strategy.chunker in UNTITLED, twice=twice)
    rows = metrics.per_query(found.hits, found.questions.select("query_id", "gold", "required"))
    return metrics.evaluate(rows).select(F.lit(strategy.name).alias("strategy"), "*")


def evaluate_all(paragraphs: DataFrame, questions: DataFrame, embedder: Embedder, tokens: TokenEncoder, terms: DataFrame | None = None, strategies: tuple[Strategy, ...] = STRATEGIES) -> DataFrame:
    """A row of metrics for each strategy; tables that strategies have in common are made once, and
    those of a chunker go with the last strategy that has it."""
    spark, rows = paragraphs.sparkSession, []
    made: dict = {}
    for i, s in enumerate(strategies):
        twice = len({x.infused for x in strategies if x.chunker == s.chunker}) > 1
        rows.append(written(evaluate(paragraphs, questions, s, embedder, tokens, terms, made=made, twice=twice), work_dir(spark, "metrics")))
        later = {x.chunker for x in strategies[i + 1 :]}
        for key in [key for key in made if len(key) > 1 and key[1] not in later]:
            dropped(spark, made.pop(key)[1])
    return reduce(DataFrame.unionByName, rows)


def generation(paragraphs: DataFrame, questions: DataFrame, strategy: Strategy, embedder: Embedder, tokens: TokenEncoder, answer: Callable[[str], str] = qa.extractive_answer, terms: DataFrame | None = None, condition: str = "fulltext", model: str = "extractive") -> DataFrame:
    """One row: mean F1 of answers (against the questions, as the published figures are), mean
    number of different sections among the five contexts, and tokens used, of a strategy."""
    found = search(paragraphs, questions, strategy, embedder, tokens, terms, 5, TOP_K)
    own = F.array_sort(F.collect_list(F.struct("rank", "text", F.coalesce("section_title", F.lit("")).alias("section"))))
    contexts = found.hits.where("rank <= 5").groupBy("query_id").agg(own.alias("_own"))
    rows = found.questions.select("query_id", "question").join(contexts, "query_id", "left").withColumn("_own", F.coalesce("_own", F.array()))
    prompts = rows.select("question", F.size(F.array_distinct(F.transform("_own", lambda x: x["section"]))).alias("n_sections"), T.user_prompt(F.col("question"), F.transform("_own", lambda x: x["text"])).alias("prompt"))
    answered = qa.generate(prompts, answer)
    return qa.generation_summary(answered).select(F.lit(strategy.name).alias("strategy"), F.lit(condition).alias("condition"), "*", F.lit(model).alias("model"))


def build_indexes(paragraphs: DataFrame, folder: str, embedder: Embedder, tokens: TokenEncoder, strategies: tuple[Strategy, ...] = STRATEGIES[:4]) -> DataFrame:
    """Writes an index for each strategy; (strategy, n_chunks, seconds), a row each."""
    spark, out = paragraphs.sparkSession, []
    for s in strategies:
        began = time.time()
        sinks.write_index(chunks_of(paragraphs, s.chunker, embedder, tokens), f"{folder}/{s.name}", embedder.dim)
        out.append((s.name, sinks.read_index(spark, f"{folder}/{s.name}").count(), time.time() - began))
    return spark.createDataFrame(out, "strategy string, n_chunks long, seconds double")
