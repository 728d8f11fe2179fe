"""Sections: labels of titles, admission of articles, and document-length conditions.

Input is a paragraphs table (doc_id, position, section_title, text, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Labels in order of precedence, and patterns of their titles.
LABELS = [
    ("other", r"supplementary|acknowledg|reference|funding|competing|conflict|author\s+contrib|abbreviation|data\s+availab|ethics|appendix|supporting\s+info"),
    ("results_discussion", r"results?\s*(?:and|&)\s*discussion"),
    ("introduction", r"intro|background|overview|objectives?\b"),
    ("methods", r"method|material|experimental|procedure|design|participant|setting"),
    ("results", r"result|finding|outcome"),
    ("discussion", r"discussion|interpretation|implication|limitation"),
]
NUMBER = r"^\s*\d+[.\):]?\s*"
#: Labels that each condition keeps; None keeps all paragraphs of long enough articles.
CONDITIONS = {"intro": ["introduction"], "partial": ["introduction", "methods", "results", "results_discussion"], "fulltext": None}
MIN_WORDS = 1000


def label(title: Column) -> Column:
    """The label of a section title; titles of no pattern, and null, are ``other``."""
    cleaned = T.strip(F.regexp_replace(title, NUMBER, ""))
    out = F
    for name, pattern in LABELS:
        out = out.when(cleaned.rlike(f"(?i){pattern}"), F.lit(name))
    return out.otherwise(F.lit("other"))


def labelled(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.withColumn("label", label(F.col("section_title")))


def imrad_documents(sections: DataFrame, least: int = 4) -> DataFrame:
    """doc_id of documents with ``least`` different labels, ``other`` aside, among their titles."""
    name = label(F.col("section_title"))
    return sections.groupBy("doc_id").agg(F.countDistinct(F.when(name != "other", name)).alias("n")).where(F.col("n") >= least).select("doc_id")


def admitted(paragraphs: DataFrame, least_labels: int = 4, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_labels, n_words) of documents with enough labels and words; one aggregation."""
    name = label(F.col("section_title"))
    facts = paragraphs.groupBy("doc_id").agg(F.countDistinct(F.when(name != "other", name)).alias("n_labels"), F.sum(T.word_count(F.col("text"))).alias("n_words"))
    return facts.where((F.col("n_labels") >= least_labels) & (F.col("n_words") >= min_words))


def conditions(paragraphs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Paragraphs of each condition, positions counted anew; a condition that keeps none is absent.

    One pass: each paragraph is dealt to its conditions, so the input is read once.
    """
    rows = labelled(paragraphs).withColumn("_words", F.sum(T.word_count(F.col("text"))).over(Window.partitionBy("doc_id")))
    dealt = [F.when(F.col("label").isin(keep) if keep else F.col("_words") >= min_words, F.lit(name)) for name, keep in CONDITIONS.items()]
    rows = rows.withColumn("condition", F.explode(F.array_compact(F.array(*dealt)))).drop("_words", "label")
    order = Window.partitionBy("condition", "doc_id").orderBy("position")
    return rows.withColumn("position", F.row_number().over(order) - 1)


def sections(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """Sections in the order of their titles' first paragraphs, at the level of the first: texts
    joined by an empty line."""
    by = [*keys, "doc_id"]
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    level = [F.min_by("section_level", "position").alias("level")] if "section_level" in paragraphs.columns else []
    rows = paragraphs.groupBy(*by, "section_title").agg(F.min("position").alias("_first"), *level, F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))
    order = Window.partitionBy(*by).orderBy("_first")
    return rows.withColumn("ord", F.row_number().over(order) - 1).drop("_first")


def condition_articles(articles: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(condition, doc_id, title, abstract, references, sections) of the conditions' paragraphs:
    titles and abstracts are the articles', references are none."""
    own = F.array_sort(F.collect_list(F.struct("ord", "section_title", "level", "text")))
    built = sections(paragraphs, "condition").groupBy("condition", "doc_id").agg(own.alias("sections"))
    return built.join(articles.select("doc_id", "title", "abstract"), "doc_id", "left").select("condition", "doc_id", "title", "abstract", F.array().cast("array<string>").alias("references"), "sections")


def offsets(paragraphs: DataFrame, separator: int = 2) -> DataFrame:
    """Adds char_start and char_end of each paragraph in the text that joins a document's paragraphs."""
    before = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("text") + separator).over(before), F.lit(0))
    return paragraphs.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.char_length("text"))


def structural_scores(paragraphs: DataFrame) -> DataFrame:
    """Score of the gap before each paragraph but the first: 1.0 at a new top-level section, 0.7
    at a new subsection, 0.4 within a section."""
    order = Window.partitionBy("doc_id").orderBy("position")
    before = F.lag("section_title").over(order)
    new = ~before.eqNullSafe(F.col("section_title"))
    score = F.when(new & (F.col("section_level") == 0), 1.0).when(new, 0.7).otherwise(0.4)
    return paragraphs.withColumn("_at", F.row_number().over(order)).withColumn("structural", score).where("_at > 1").drop("_at")


def dominant_sections(chunks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Each chunk's (doc_id, position, char_start, char_end) section: that of most common characters,
    the first of equals, empty if none.  An interval join within each document."""
    p = paragraphs.select(F.col("doc_id").alias("_doc"), F.col("section_title"), F.col("char_start").alias("_from"), F.col("char_end").alias("_to"), F.col("position").alias("_pos"))
    meets = (chunks["doc_id"] == p["_doc"]) & (chunks["char_start"] < p["_to"]) & (p["_from"] < chunks["char_end"])
    width = F.least("char_end", "_to") - F.greatest("char_start", "_from")
    found = chunks.join(p, meets, "left").groupBy("doc_id", "position", "section_title").agg(F.sum(width).alias("_width"), F.min("_pos").alias("_first"))
    best = F.max_by(F.coalesce("section_title", F.lit("")), F.struct(F.coalesce("_width", F.lit(0)), -F.coalesce("_first", F.lit(0))))
    return found.groupBy("doc_id", "position").agg(best.alias("section_title"))


def corpus_stats(downloaded: DataFrame, paragraphs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row: documents had, parsed, admitted by labels, kept in each condition, and the rates left out."""
    n = downloaded.agg(F.countDistinct("doc_id").alias("total_downloaded"))
    parsed = paragraphs.agg(F.countDistinct("doc_id").alias("parsed"))
    imrad = imrad_documents(paragraphs).agg(F.count("*").alias("imrad_filtered"))
    kept = conditions(paragraphs, min_words).groupBy().pivot("condition", list(CONDITIONS)).agg(F.countDistinct("doc_id"))
    rows = n.join(parsed).join(imrad).join(kept)  # four frames of one row each
    base = F.greatest(F.col("parsed") - F.col("imrad_filtered"), F.lit(1))
    return rows.select("total_downloaded", "parsed", "imrad_filtered", *(F.coalesce(c, F.lit(0)).alias(c) for c in CONDITIONS), *((1 - F.coalesce(c, F.lit(0)) / base).alias(f"{c}_excluded") for c in CONDITIONS))


def summary(paragraphs: DataFrame) -> DataFrame:
    """One row: articles, mean number of different section titles (empty ones aside) and of paragraphs."""
    n = F.countDistinct("doc_id")
    titled = F.countDistinct(F.when(F.col("section_title") != "", F.struct("doc_id", "section_title")))
    return paragraphs.agg(n.alias("n_articles"), (titled / n).alias("mean_sections"), (F.count("*") / n).alias("mean_paragraphs"))


def full_text(articles: DataFrame, separator: str = "\n\n", least: int = 50) -> DataFrame:
    """(doc_id, text): title, abstract and paragraphs (an array) joined, empty parts left out;
    texts of fewer than ``least`` characters are skipped."""
    parts = F.concat(F.array("title", "abstract"), F.coalesce("paragraphs", F.array().cast("array<string>")))
    joined = F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), separator)
    return articles.select("doc_id", joined.alias("text")).where(F.char_length(T.strip(F.col("text"))) >= least)
