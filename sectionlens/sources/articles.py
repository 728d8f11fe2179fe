"""Article and question sources: XML full texts, web pages, JSON files, and tables."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ARTICLE = (
    "doc_id string, title string, abstract string, references array<string>, "
    "sections array<struct<path:array<int>,level:int,title:string,text:string>>, "
    "paragraphs array<struct<position:int,text:string,section_title:string,section_level:int,citations:array<string>>>, error string"
)
#: Titles that the driver's plain documents get by a line's place, a convention of tests.
PLACED_TITLES = ["1. Introduction", "2. Methods", "3. Results", "4. Discussion"]


def _tag(el: ET.Element) -> str:
    return el.tag.rsplit("}", 1)[-1] if isinstance(el.tag, str) else ""


def _text(el: ET.Element | None, collapse: bool = True) -> str:
    whole = "".join(el.itertext()) if el is not None else ""
    return " ".join(whole.split()) if collapse else whole.strip()


def _children(el: ET.Element, tag: str) -> list[ET.Element]:
    return [c for c in el if _tag(c) == tag]


def _first(el: ET.Element | None, tag: str) -> ET.Element | None:
    return next((c for c in el.iter() if _tag(c) == tag), None) if el is not None else None


def _citations(p: ET.Element) -> list[str]:
    found = (x.get("rid") or _text(x).strip() for x in p.iter() if _tag(x) == "xref" and x.get("ref-type") == "bibr")
    return [x for x in found if x]


class ArticleParser:
    """Parses one XML article.  ``nested`` keeps levels of sections; ``flat`` puts all at level 0,
    takes the file's name as the id and only trims texts."""

    def __init__(self, mode: str = "nested"):
        if mode not in ("nested", "flat"):
            raise ValueError(mode)
        self.nested = mode == "nested"

    def __call__(self, content: bytes, stem: str) -> dict:
        root = ET.fromstring(content)
        article = root if _tag(root) == "article" else _first(root, "article")
        article = root if article is None else article
        self.sections: list[dict] = []
        self.paragraphs: list[dict] = []
        body = _first(article, "body")
        if body is not None:
            if self.nested:
                for k, sec in enumerate(_children(body, "sec")):
                    self._section(sec, 0, [k])
                loose = [] if self.sections else _children(body, "p")
            else:
                for k, sec in enumerate(x for x in body.iter() if _tag(x) == "sec"):
                    self._flat_section(sec, k)
                loose = _children(body, "p")
            for p in loose:
                self._paragraph(p, "", 0)
        if not self.nested and not self.paragraphs:
            for p in (x for x in article.iter() if _tag(x) == "p"):
                self._paragraph(p, "", 0)
        return {
            "doc_id": self._id(article, stem), "title": _text(_first(article, "article-title"), self.nested), "abstract": self._abstract(article),
            "references": self._references(article), "sections": self.sections, "paragraphs": self.paragraphs, "error": None,
        }

    def _id(self, article: ET.Element, stem: str) -> str:
        ids = (x for x in article.iter() if _tag(x) == "article-id" and x.get("pub-id-type") in ("pmid", "pmc"))
        first = next(ids, None) if self.nested else None
        return (_text(first) if first is not None else "") or stem

    def _abstract(self, article: ET.Element) -> str:
        el = _first(article, "abstract")
        if el is None:
            return ""
        parts = [t for p in el.iter() if _tag(p) == "p" and (t := _text(p, self.nested))]
        return "\n".join(parts) if parts else _text(el, self.nested)

    def _references(self, article: ET.Element) -> list[str]:
        listed = article
        if self.nested:
            listed = _first(_first(article, "back"), "ref-list")
            listed = _first(article, "ref-list") if listed is None else listed
        return [t for r in (listed.iter() if listed is not None else ()) if _tag(r) == "ref" and (t := _text(r, self.nested))]

    def _paragraph(self, p: ET.Element, title: str, level: int) -> str:
        if text := _text(p, self.nested):
            self.paragraphs.append({"position": len(self.paragraphs), "text": text, "section_title": title, "section_level": level, "citations": _citations(p)})
        return text

    def _section(self, sec: ET.Element, level: int, path: list[int]) -> None:
        title = _text(next(iter(_children(sec, "title")), None))
        row = {"path": path, "level": level, "title": title, "text": ""}
        self.sections.append(row)
        row["text"] = "\n".join(t for p in _children(sec, "p") if (t := self._paragraph(p, title, level)))
        for k, inner in enumerate(_children(sec, "sec")):
            self._section(inner, level + 1, [*path, k])

    def _flat_section(self, sec: ET.Element, k: int) -> None:
        title = _text(next(iter(_children(sec, "title")), None), False)
        texts = [t for p in _children(sec, "p") if (t := self._paragraph(p, title, 0))]
        self.sections.append({"path": [k], "level": 0, "title": title, "text": "\n".join(texts)})


def parse_articles(files: DataFrame, mode: str = "nested") -> DataFrame:
    """One row (``ARTICLE``) for each row (path, content) of XML bytes; those that don't parse have
    an error and nothing else."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = ArticleParser(mode)
        names = ["doc_id", "title", "abstract", "references", "sections", "paragraphs", "error"]
        for pdf in frames:
            rows = []
            for name, content in zip(pdf.path, pdf.content):
                stem = os.path.splitext(os.path.basename(name))[0]
                try:
                    rows.append(parse(bytes(content), stem))
                except ET.ParseError as e:
                    rows.append(dict.fromkeys(names) | {"doc_id": stem, "error": str(e)})
            yield pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})

    return files.select("path", "content").mapInPandas(run, ARTICLE)


def read_articles(spark: SparkSession, path: str, mode: str = "nested") -> DataFrame:
    """The articles (``ARTICLE``) of a folder's XML files.  A folder that isn't there has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], ARTICLE)
    return parse_articles(spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path), mode)


def paragraphs_of(articles: DataFrame) -> DataFrame:
    return articles.where("error is null").select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.*")


def sections_of(articles: DataFrame) -> DataFrame:
    return articles.where("error is null").select("doc_id", F.explode("sections").alias("s")).select("doc_id", F.col("s.path").alias("sec_path"), "s.level", "s.title", "s.text")


def document_paragraphs(docs: DataFrame) -> DataFrame:
    """Plain documents as articles: a line is a paragraph, its place gives the section title."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select("doc_id", F.size(lines).alias("_n"), F.posexplode(lines).alias("position", "text"))
    titles = F.array(*(F.lit(t) for t in PLACED_TITLES))
    title = F.get(titles, F.floor(len(PLACED_TITLES) * F.col("position") / F.col("_n")).cast("int"))
    return rows.select("doc_id", "position", "text", title.alias("section_title"), F.lit(0).alias("section_level"))


#: Entities of web pages that stand in texts.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, position, text) of pages' <p> elements, tags and entities resolved, by expressions alone."""
    inner = F.regexp_extract_all("html", F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(inner).alias("position", "_html"))
    text = F.regexp_replace("_html", r"(?s)<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return rows.select("page_id", "position", T.squeeze(text).alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: ``context`` is read as a string: JSON that isn't a string stays JSON text there.
QA_RAW = "question string, context string, long_answer string, final_decision string, pubid string, id string, label string, pmid string"


def read_questions(spark: SparkSession, *paths: str) -> DataFrame:
    """Questions of the first of several JSON lists that exists; none if none does.

    A context that is an object of ``contexts`` is these, joined by lines; a string is itself;
    anything else is its JSON text; a missing one is empty.  Labels are in lower case; ids of
    lists that were processed before (``id``, ``label``, ``pmid``) are kept.
    """
    rows = read_first_of(spark, QA_RAW, *paths)
    listed = F.from_json("context", "contexts array<string>")["contexts"]
    context = F.when(F.col("context").rlike(r"^\s*\{") & F.get_json_object("context", "$.contexts").isNotNull(), F.array_join(listed, "\n")).when(F.col("context").rlike(r"^\s*\{\s*\}\s*$"), F.lit("")).otherwise(F.coalesce("context", F.lit("")))
    number = F.coalesce("pubid", "id", F.lit(""))
    return rows.select(number.alias("id"), "question", context.alias("context"), F.coalesce("long_answer", F.lit("")).alias("long_answer"), F.lower(F.coalesce("final_decision", "label", F.lit(""))).alias("label"), F.coalesce("pmid", number).alias("pmid"))


def read_first_of(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """The first of several JSON files that exists; an empty frame if none does."""
    for p in paths:
        if exists(spark, p):
            return spark.read.schema(schema).json(p, multiLine=True)
    return spark.createDataFrame([], schema)


_STORED = "text string, section_title string, section_level int, position int, citations array<string>"
STORED_ARTICLE = f"pmid string, title string, abstract string, references array<string>, is_pubmedqa boolean, paragraphs array<struct<{', '.join(x.replace(' ', ':', 1) for x in _STORED.split(', '))}>>"


def stored_articles(rows: DataFrame) -> DataFrame:
    """Articles of ``STORED_ARTICLE`` rows with their defaults: empty strings and lists, level 0, and
    for a paragraph without a position its place in the list."""
    none = F.array().cast("array<string>")

    def whole(p: Column, i: Column) -> Column:
        return F.struct(
            F.coalesce(p["position"], i).alias("position"), F.coalesce(p["text"], F.lit("")).alias("text"), F.coalesce(p["section_title"], F.lit("")).alias("section_title"),
            F.coalesce(p["section_level"], F.lit(0)).alias("section_level"), F.coalesce(p["citations"], none).alias("citations"),
        )

    return rows.select(
        *(F.coalesce(c, F.lit("")).alias(n) for c, n in (("pmid", "doc_id"), ("title", "title"), ("abstract", "abstract"))), F.coalesce("references", none).alias("references"),
        F.coalesce("is_pubmedqa", F.lit(False)).alias("is_pubmedqa"), F.transform(F.coalesce("paragraphs", F.array().cast(rows.schema["paragraphs"].dataType)), whole).alias("paragraphs"),
    )


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Parsed articles of a JSON list, or of a folder of JSON files; none if the path isn't there."""
    if not exists(spark, path):
        return stored_articles(spark.createDataFrame([], STORED_ARTICLE))
    return stored_articles(spark.read.schema(STORED_ARTICLE).json(path, multiLine=True, pathGlobFilter="*.json"))


def read_condition(spark: SparkSession, root: str, condition: str, without_tagged: bool = False, short_ids: bool = False) -> DataFrame:
    """Paragraphs of one condition, from what ``write_partitioned`` (by ``condition``) wrote under
    ``root`` or from a folder of JSON files named after it; none if neither is there.

    ``without_tagged`` leaves out articles that questions were made for; ``short_ids`` cuts ids
    at ``__``.
    """
    columns = ["doc_id", "position", "text", "section_title", "section_level"]
    if exists(spark, f"{root.rstrip('/')}/condition={condition}"):
        rows = spark.read.parquet(root).where(F.col("condition") == condition)  # one partition is read
        if without_tagged and "is_pubmedqa" in rows.columns:
            rows = rows.where(~F.coalesce("is_pubmedqa", F.lit(False)))
    else:
        found = read_stored(spark, f"{root.rstrip('/')}/{condition}")
        found = found.where(~F.col("is_pubmedqa")) if without_tagged else found
        rows = found.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.*")
    rows = rows.withColumn("doc_id", F.substring_index(F.col("doc_id").cast("string"), "__", 1)) if short_ids else rows
    return rows.select(*(c for c in columns if c in rows.columns))


def descriptor_id(uid: str) -> str:
    """``D`` and a number filled up to six digits."""
    return "D" + re.sub(r"\D", "", str(uid)).zfill(6)
