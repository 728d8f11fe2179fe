"""Queries of the library's operators over the driver's tables, and their SQL.

Documents stand for articles (a line is a paragraph, its place gives the section title);
embeddings for chunk vectors, their label for the document a chunk is of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, embedding, entities, metrics, qa, retrieval, sections, significance
from ..sources import articles, sinks
from ..sources.work import work_dir, written
from . import evaluation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Frame = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Frame], Frame]:
    """Registers a query under its function's name, with its SQL; whole numbers become longs."""

    def add(f: Frame) -> Frame:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.document_paragraphs(docs(spark, sf_dir))


#: White space in SQL's dialect of patterns.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PARAS = """p0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
para AS (SELECT doc_id, position, text, ['1. Introduction', '2. Methods', '3. Results', '4. Discussion'][1 + (4 * position // n)] AS section_title FROM (
  SELECT doc_id, len(ls) AS n, unnest(ls) AS text, (generate_subscripts(ls, 1) - 1)::BIGINT AS position FROM p0))"""


def sql_words(t: str) -> str:
    return f"regexp_extract_all({t}, '[^{WS}]+')"


def sql_strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_label(t: str) -> str:
    cleaned = sql_strip(f"regexp_replace({t}, '{sections.NUMBER}', '')")
    return "CASE " + " ".join(f"WHEN regexp_matches({cleaned}, '(?i){p}') THEN '{n}'" for n, p in sections.LABELS) + " ELSE 'other' END"


def sql_windows(words: str, most: int, overlap: int) -> str:
    """A list of texts from a list of words."""
    step = most - overlap
    return f"CASE WHEN len({words}) = 0 THEN [] ELSE list_transform(range(0, CAST(ceil(greatest(len({words}) - {most}, 0) / {step}.0) AS BIGINT) + 1), lambda i: array_to_string({words}[i * {step} + 1 : i * {step} + {most}], ' ')) END"


WORDS = f"w AS (SELECT doc_id, {sql_words('text')} AS ws FROM documents)"


# ---- text and chunks -------------------------------------------------------------------


@query(f"WITH {WORDS} SELECT doc_id, len(ws)::BIGINT AS n_words FROM w")
def words_per_doc(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


SENTENCES = rf"""s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[{WS}]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ss FROM documents),
sent AS (SELECT doc_id, (unnest(range(len(ss))))::BIGINT AS position, unnest(ss) AS text FROM s0)"""


@query(f"WITH {SENTENCES} SELECT * FROM sent")
def sentences(spark, sf_dir):
    return chunking.sentence_rows(docs(spark, sf_dir))


@query(f"WITH {WORDS}, c AS (SELECT doc_id, {sql_windows('ws', 100, 0)} AS cs FROM w) SELECT doc_id, unnest(range(len(cs)))::BIGINT AS position, unnest(cs) AS text FROM c")
def hard_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.hard_split(F.col("text"), 100)).alias("position", "text"))


@query(f"WITH {WORDS}, c AS (SELECT doc_id, {sql_windows('ws', 256, 32)} AS cs FROM w) SELECT doc_id, unnest(range(len(cs)))::BIGINT AS position, unnest(cs) AS text FROM c")
def naive_chunks(spark, sf_dir):
    return chunking.naive(docs(spark, sf_dir), 256, 32)


@query(f"WITH {PARAS} SELECT doc_id, position, text, section_title FROM para")
def paragraph_rows(spark, sf_dir):
    return paragraphs(spark, sf_dir).drop("section_level")


TITLES = [
    "Introduction", "1. Introduction", "BACKGROUND", "1 Background and Objectives", "Methods", "Materials and Methods", "2. Experimental Design", "Study Design and Procedures",
    "Results", "3. Findings", "Results and Discussion", "Results & Discussion", "Discussion", "4. Discussion", "Interpretation", "Acknowledgments", "References", "Supplementary Materials",
    "Patient preferences", "Experimental Results", "", "  2)  Overview ", "Data availability", "Limitations", "Conclusions",
]


@query(f"SELECT t AS title, {sql_label('t')} AS label FROM (SELECT unnest([{', '.join(repr(t) for t in TITLES)}]) AS t)")
def section_label(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in TITLES], "title string").select("title", sections.label(F.col("title")).alias("label"))


@query(f"WITH {PARAS} SELECT {sql_label('section_title')} AS label, count(*) AS n FROM para GROUP BY 1")
def section_label_counts(spark, sf_dir):
    return sections.labelled(paragraphs(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


LABELLED = f"{PARAS}, lab AS (SELECT *, {sql_label('section_title')} AS label, len({sql_words('text')}) AS nw, sum(len({sql_words('text')})) OVER (PARTITION BY doc_id) AS total FROM para)"


@query(f"WITH {LABELLED} SELECT doc_id FROM lab GROUP BY doc_id HAVING count(DISTINCT CASE WHEN label <> 'other' THEN label END) >= 4")
def imrad_filter(spark, sf_dir):
    return sections.imrad_documents(paragraphs(spark, sf_dir))


@query(f"WITH {LABELLED} SELECT doc_id, count(DISTINCT CASE WHEN label <> 'other' THEN label END) AS n_labels, sum(nw)::BIGINT AS n_words FROM lab GROUP BY doc_id HAVING n_labels >= 4 AND n_words >= 1000")
def corpus_admission(spark, sf_dir):
    return sections.admitted(paragraphs(spark, sf_dir))


COND = f"""{LABELLED}, cond AS (SELECT condition, doc_id, (row_number() OVER (PARTITION BY condition, doc_id ORDER BY position) - 1)::BIGINT AS position, text, section_title FROM (
  SELECT 'intro' AS condition, * FROM lab WHERE label = 'introduction' UNION ALL
  SELECT 'partial', * FROM lab WHERE label IN ('introduction', 'methods', 'results', 'results_discussion') UNION ALL
  SELECT 'fulltext', * FROM lab WHERE total >= 1000))"""


@query(f"WITH {COND} SELECT * FROM cond")
def condition_paragraphs(spark, sf_dir):
    return sections.conditions(paragraphs(spark, sf_dir)).drop("section_level")


@query(f"WITH {COND}, g AS (SELECT condition, doc_id, section_title, min(position) AS f, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text FROM cond GROUP BY 1, 2, 3) SELECT condition, doc_id, section_title, 0::BIGINT AS level, text, (row_number() OVER (PARTITION BY condition, doc_id ORDER BY f) - 1)::BIGINT AS ord FROM g")
def condition_sections(spark, sf_dir):
    return sections.sections(sections.conditions(paragraphs(spark, sf_dir)), "condition")


@query(f"""WITH {COND}, n AS (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS total_downloaded, (SELECT count(DISTINCT doc_id) FROM para) AS parsed,
  (SELECT count(*) FROM (SELECT doc_id FROM lab GROUP BY doc_id HAVING count(DISTINCT CASE WHEN label <> 'other' THEN label END) >= 4)) AS imrad_filtered,
  {", ".join(f"(SELECT count(DISTINCT doc_id) FROM cond WHERE condition = '{c}') AS {c}" for c in sections.CONDITIONS)})
SELECT *, {", ".join(f"1 - {c} / greatest(parsed - imrad_filtered, 1)::DOUBLE AS {c}_excluded" for c in sections.CONDITIONS)} FROM n""")
def corpus_stats(spark, sf_dir):
    return sections.corpus_stats(docs(spark, sf_dir), paragraphs(spark, sf_dir))


@query(f"WITH {PARAS} SELECT count(DISTINCT doc_id) AS n_articles, count(DISTINCT (doc_id, section_title)) / count(DISTINCT doc_id)::DOUBLE AS mean_sections, count(*) / count(DISTINCT doc_id)::DOUBLE AS mean_paragraphs FROM para")
def corpus_summary(spark, sf_dir):
    return sections.summary(paragraphs(spark, sf_dir))


@query(f"""WITH a AS (SELECT doc_id, array_to_string(list_filter([source, NULL] || string_split(text, chr(10)), lambda x: coalesce(x, '') <> ''), chr(10) || chr(10)) AS t FROM documents)
SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM a WHERE length({sql_strip('t')}) >= 50""")
def full_text_assembly(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.col("source").alias("title"), F.lit(None).cast("string").alias("abstract"), F.split("text", "\n").alias("paragraphs"))
    return sections.full_text(rows).select("doc_id", F.char_length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT source, row_number() OVER (ORDER BY f) AS ord FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)")
def ordered_dedup(spark, sf_dir):
    firsts = docs(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("f"))
    return firsts.select("source", F.row_number().over(Window.orderBy("f")).alias("ord"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def question_semi(spark, sf_dir):
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(english, "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_anti(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS tagged FROM documents")
def tag_exists(spark, sf_dir):
    tags = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("tagged")).distinct()
    return docs(spark, sf_dir).select("doc_id").join(tags, "doc_id", "left").select("doc_id", F.coalesce("tagged", F.lit(False)).alias("tagged"))


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 20")
def first_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", "text").orderBy("item_id").limit(20)


# ---- vectors ---------------------------------------------------------------------------


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), "embedding", F.col("label").alias("doc_id"), F.concat(F.lit("S"), F.col("vec_id") % 4).alias("section_title"))


@query("SELECT vec_id, unnest(range(len(embedding)))::BIGINT AS i, round(unnest(list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-10))), 9) AS x FROM embeddings")
def l2_normalise(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalise(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.posexplode("u").alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(before, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 9).alias("sim"))


HASHED = "(('0x' || left(md5(w), 8))::BIGINT % {0})"


@query(f"SELECT item_id, {HASHED.format(64)} AS bucket, count(*) AS n FROM (SELECT item_id, unnest({sql_words('lower(text)')}) AS w FROM benchmark) GROUP BY 1, 2")
def hash_embed(spark, sf_dir):
    return embedding.hashed_counts(table(spark, sf_dir, "benchmark"), "item_id", "text", 64)


GROUPS = f"""{SENTENCES}, c AS (SELECT doc_id, position, {HASHED.format(16)} AS b, count(*)::DOUBLE AS n FROM (SELECT doc_id, position, unnest({sql_words('lower(text)')}) AS w FROM sent) GROUP BY 1, 2, 3),
n AS (SELECT doc_id, position, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1, 2),
d AS (SELECT a.doc_id, a.position, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.position = a.position - 1 AND a.b = b.b GROUP BY 1, 2),
s AS (SELECT n.doc_id, n.position, CASE WHEN n.position > 0 THEN coalesce(d.dot, 0) / (p.norm * n.norm) END AS sim FROM n LEFT JOIN n p ON p.doc_id = n.doc_id AND p.position = n.position - 1 LEFT JOIN d ON d.doc_id = n.doc_id AND d.position = n.position),
g AS (SELECT doc_id, position, (sum(CASE WHEN coalesce(sim, 1) < 0.6 - 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position))::BIGINT AS group_id FROM s)"""


@query(f"WITH {GROUPS} SELECT * FROM g")
def semantic_groups(spark, sf_dir):
    rows = embedding.embed(chunking.sentence_rows(docs(spark, sf_dir)), embedding.HashingEmbedder(16, normalise=False))
    return chunking.grouped(rows, 0.6 - 1e-9).select("doc_id", "position", "group_id")


#: Groups merged from left to right by a recursion over their numbers, all documents at once.
MERGED = f"""{GROUPS},
gi AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY group_id) AS k FROM (SELECT doc_id, group_id, sum(len({sql_words('text')})) AS n FROM g JOIN sent USING (doc_id, position) GROUP BY 1, 2)),
r AS (SELECT doc_id, k, n AS acc, 0 AS m FROM gi WHERE k = 1 UNION ALL
  SELECT gi.doc_id, gi.k, CASE WHEN r.acc < 50 THEN r.acc + gi.n ELSE gi.n END, CASE WHEN r.acc < 50 THEN r.m ELSE r.m + 1 END FROM r JOIN gi ON gi.doc_id = r.doc_id AND gi.k = r.k + 1),
l AS (SELECT doc_id, max(m) AS mm, arg_max(acc, k) AS acc FROM r GROUP BY 1),
mg AS (SELECT r.doc_id, r.k, CASE WHEN l.mm > 0 AND l.acc < 50 AND r.m = l.mm THEN r.m - 1 ELSE r.m END AS m FROM r JOIN l USING (doc_id)),
tx AS (SELECT doc_id, m, string_agg(text, ' ' ORDER BY position) AS t FROM mg JOIN gi USING (doc_id, k) JOIN g USING (doc_id, group_id) JOIN sent USING (doc_id, position) GROUP BY 1, 2),
tw AS (SELECT doc_id, m, t, {sql_words('t')} AS ws FROM tx),
sp AS (SELECT doc_id, m, unnest(range(len(ps))) AS i, unnest(ps) AS text FROM (SELECT doc_id, m, CASE WHEN len(ws) > 256 THEN {sql_windows('ws', 256, 0)} ELSE [t] END AS ps FROM tw)),
semantic AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY m, i) - 1)::BIGINT AS position, text FROM sp)"""


@query(f"WITH RECURSIVE {MERGED} SELECT * FROM semantic")
def semantic_chunks(spark, sf_dir):
    return chunking.semantic(docs(spark, sf_dir), embedding.HashingEmbedder(16, normalise=False), 0.6 - 1e-9, 256)


@query("SELECT n, unnest(range(n))::BIGINT AS i, round(unnest(list_transform(range(n), lambda i: CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE 1 - abs(i - n / 2.0::DOUBLE + 0.5::DOUBLE) / (n / 2.0::DOUBLE) END)), 12) AS weight FROM (SELECT unnest(range(1, 65)) AS n)")
def triangular_weights(spark, sf_dir):
    rows = spark.range(1, 65).select(F.col("id").cast("int").alias("n"))
    return rows.select("n", F.posexplode(V.triangular_weights(F.col("n"))).alias("i", "weight")).select("n", "i", F.round("weight", 12).alias("weight"))


@query(f"""WITH {WORDS}, b AS (SELECT doc_id, ws, unnest(range(0, CAST(ceil(greatest(len(ws) - 512, 0) / 384.0) AS BIGINT) + 1)) * 384 AS start FROM w WHERE len(ws) > 0) SELECT doc_id, start, least(start + 512, len(ws))::BIGINT AS stop FROM b""")
def window_starts(spark, sf_dir):
    n = docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n")).where("n > 0")
    start = F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("n") - 512, F.lit(0)) / 384).cast("int")), lambda i: i * 384))
    return n.select("doc_id", "n", start.alias("start")).select("doc_id", "start", F.least(F.col("start") + 512, F.col("n")).alias("stop"))


#: Tokens with the white space before them make up a text; marks of sentences move no cut (the
#: published computation compares them with places that no token begins at).
TOKENS = rf"regexp_extract_all(text, '[{WS}]*(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}])')"


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS ts FROM documents), k AS (SELECT doc_id, ts, unnest(range(0, CAST(ceil(len(ts) / 256.0) AS BIGINT)))::BIGINT AS position FROM t)
SELECT doc_id, position, position * 256 AS token_start, least((position + 1) * 256, len(ts))::BIGINT AS token_end, {sql_strip("array_to_string(ts[position * 256 + 1 : (position + 1) * 256], '')")} AS text FROM k""")
def late_chunks(spark, sf_dir):
    return chunking.late(docs(spark, sf_dir), embedding.HashingTokenEncoder(32)).select("doc_id", "position", "token_start", "token_end", "text")


@query()
def structure_chunks(spark, sf_dir):
    return chunking.structure_aware(paragraphs(spark, sf_dir), embedding.HashingTokenEncoder(32), None, 64, 256, 0.3).select("doc_id", "position", "section_title", "token_start", "token_end", "text")


@query(f"WITH {PARAS}, o AS (SELECT *, lag(section_title) OVER (PARTITION BY doc_id ORDER BY position) AS b FROM para) SELECT doc_id, position, CASE WHEN b <> section_title THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS structural FROM o WHERE position > 0")
def structural_score(spark, sf_dir):
    return sections.structural_scores(paragraphs(spark, sf_dir)).select("doc_id", "position", "structural")


OFFSETS = f"{PARAS}, off AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM para)"


@query(f"WITH {OFFSETS} SELECT doc_id, position, char_start, char_start + length(text) AS char_end FROM off")
def paragraph_offsets(spark, sf_dir):
    return sections.offsets(paragraphs(spark, sf_dir)).select("doc_id", "position", "char_start", "char_end")


@query(f"""WITH {OFFSETS}, n AS (SELECT doc_id, max(char_start + length(text)) AS n FROM off GROUP BY 1),
c AS (SELECT doc_id, k AS position, k * 700 AS s, (k + 1) * 700 AS e FROM (SELECT doc_id, unnest(range(0, n // 700 + 1)) AS k FROM n)),
j AS (SELECT c.doc_id, c.position, coalesce(o.section_title, '') AS section_title, sum(least(c.e, o.char_start + length(o.text)) - greatest(c.s, o.char_start)) AS width, min(o.position) AS first
  FROM c LEFT JOIN off o ON o.doc_id = c.doc_id AND c.s < o.char_start + length(o.text) AND o.char_start < c.e GROUP BY 1, 2, 3)
SELECT doc_id, position, section_title FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, position ORDER BY coalesce(width, 0) DESC, coalesce(first, 0)) = 1""")
def dominant_section(spark, sf_dir):
    p = sections.offsets(paragraphs(spark, sf_dir))
    n = p.groupBy("doc_id").agg(F.max("char_end").alias("n"))
    chunks = n.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 700).cast("int"))).alias("position"))
    chunks = chunks.select("doc_id", "position", (F.col("position") * 700).alias("char_start"), ((F.col("position") + 1) * 700).alias("char_end"))
    return sections.dominant_sections(chunks, p)


# ---- retrieval -------------------------------------------------------------------------

HITS = """hits AS (SELECT q.vec_id AS query_id, x.vec_id AS chunk_idx, round(list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 12) AS score, x.label AS doc_id, 'S' || (x.vec_id % 4) AS section,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 12) DESC, x.vec_id) AS rank
  FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0 QUALIFY rank <= 20)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100, as a question."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    required = F.array(F.concat(F.lit("S"), F.col("vec_id") % 4), F.lit("S1"))
    return rows.select(F.col("vec_id").alias("query_id"), "embedding", F.array("label").alias("gold"), F.array_distinct(required).alias("required"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_vectors(spark, sf_dir)
    return evaluation.hits_of(questions(spark, sf_dir), chunks)


@query(f"WITH {HITS} SELECT query_id, chunk_idx, rank, round(score, 9) AS score FROM hits")
def topk_dense(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "chunk_idx", "rank", F.round("score", 9).alias("score"))


@query("SELECT count(*) AS n, max(len(embedding))::BIGINT AS dim FROM embeddings")
def index_size(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))


PERQ = f"""{HITS}, q AS (SELECT vec_id AS query_id, label AS gold, list_distinct(['S' || (vec_id % 4), 'S1']) AS required FROM embeddings WHERE vec_id % 100 = 0),
perq AS (SELECT q.query_id, q.required, min(CASE WHEN h.doc_id = q.gold THEN h.rank END) AS first_rank,
  coalesce(sum(CASE WHEN h.doc_id = q.gold AND h.rank <= 10 THEN 1 / log2(h.rank + 1) END), 0) AS ndcg,
  {", ".join(f"list(DISTINCT h.section) FILTER (WHERE h.rank <= {k}) AS s{k}" for k in (5, 10, 20))}
  FROM q LEFT JOIN hits h USING (query_id) GROUP BY ALL)"""


@query(f"WITH {PERQ} SELECT query_id, first_rank, CASE WHEN first_rank > 0 THEN 1.0::DOUBLE / first_rank ELSE 0 END AS rr FROM perq")
def per_query_rr(spark, sf_dir):
    rows = metrics.per_query(hits(spark, sf_dir), questions(spark, sf_dir))
    return rows.select("query_id", "first_rank", metrics.reciprocal_rank(F.col("first_rank")).alias("rr"))


EVAL = f"""WITH {PERQ} SELECT round(avg(CASE WHEN first_rank > 0 THEN 1.0::DOUBLE / first_rank ELSE 0 END), 9) AS MRR,
  {", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1 ELSE 0 END), 9) AS recall_{k}" for k in (1, 3, 5, 10))}, round(avg(ndcg), 9) AS ndcg_10, count(*) AS n_questions, count(first_rank) AS n_found,
  {", ".join(f"round(avg(CASE WHEN len(list_filter(required, lambda x: NOT list_contains(s{k}, x))) = 0 THEN 1 ELSE 0 END), 9) AS cross_section_recall_{k}, round(avg(len(s{k})), 9) AS section_coverage_{k}" for k in (5, 10, 20))} FROM perq"""


@query(EVAL)
def eval_all(spark, sf_dir):
    df = metrics.evaluate(metrics.per_query(hits(spark, sf_dir), questions(spark, sf_dir)))
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _one(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return eval_all(spark, sf_dir).select(name)

    run.__name__ = {"MRR": "mrr", "recall_5": "hit_at_5", "ndcg_10": "ndcg", "section_coverage_10": "section_coverage", "cross_section_recall_10": "cross_section_recall"}[name]
    query(f"SELECT {name} FROM ({EVAL})")(run)


for _name in ("MRR", "recall_5", "ndcg_10", "section_coverage_10", "cross_section_recall_10"):
    _one(_name)


# Entities of the vector tables: a name for each label, its vector the mean of the label's vectors.
# Chunks and questions of the lowest labels mention none.
NAMES = """nv AS (SELECT 'L' || label AS name, list(m ORDER BY i) AS vec FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
cn AS (SELECT vec_id AS chunk_idx, unnest(['L' || label, 'L' || (vec_id % 10)]) AS name FROM embeddings WHERE label > 2),
qn AS (SELECT vec_id AS query_id, unnest(['L' || label, 'L' || label, 'L' || (vec_id // 100 % 10), 'unknown']) AS name FROM embeddings WHERE vec_id % 100 = 0 AND label > 4)"""


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")

    def name(c):
        return F.concat(F.lit("L"), c)

    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"])
    vectors = means.groupBy(name(F.col("label")).alias("name")).agg(vec.alias("vec"))
    of_chunk = e.where("label > 2").select(F.col("vec_id").alias("chunk_idx"), F.explode(F.array(name(F.col("label")), name(F.col("vec_id") % 10))).alias("name"))
    tens = F.floor(F.col("vec_id") / 100) % 10
    of_query = e.where("vec_id % 100 = 0 and label > 4").select(F.col("vec_id").alias("query_id"), F.explode(F.array(name(F.col("label")), name(F.col("label")), name(tens), F.lit("unknown"))).alias("name"))
    return of_query, of_chunk, vectors


@query(f"""WITH {NAMES}, e AS (SELECT vec_id AS chunk_idx, unnest(range(len(embedding)))::BIGINT AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
m AS (SELECT chunk_idx, i, avg(y) AS m FROM (SELECT chunk_idx, unnest(range(len(vec)))::BIGINT AS i, unnest(vec) AS y FROM cn JOIN nv USING (name)) GROUP BY 1, 2),
j AS (SELECT e.*, m, x + 0.1::DOUBLE * m AS v FROM e LEFT JOIN m USING (chunk_idx, i))
SELECT chunk_idx, i, round(CASE WHEN m IS NULL THEN x ELSE v / (sqrt(sum(v * v) OVER (PARTITION BY chunk_idx)) + 1e-8) END, 6) AS x FROM j""")
def kg_infusion(spark, sf_dir):
    _, of_chunk, vectors = names(spark, sf_dir)
    rows = entities.infuse_chunks(chunk_vectors(spark, sf_dir), of_chunk, vectors)
    return rows.select("chunk_idx", F.posexplode("embedding").alias("i", "x")).select("chunk_idx", "i", F.round("x", 6).alias("x"))


KG = f"""{HITS}, {NAMES}, pairs AS (SELECT h.query_id, h.chunk_idx, q.name, q.times, max(list_cosine_similarity(a.vec, b.vec)) AS best, max(greatest(0, list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec)) + 1e-8))) AS best0
  FROM hits h JOIN (SELECT query_id, name, count(*) AS times FROM qn GROUP BY 1, 2) q USING (query_id) JOIN nv a ON a.name = q.name JOIN cn c USING (chunk_idx) JOIN nv b ON b.name = c.name GROUP BY 1, 2, 3, 4),
kg AS (SELECT query_id, chunk_idx, greatest(0, least(1, avg(best))) AS kg, sum(best0 * times) / sum(times) AS kg0 FROM pairs GROUP BY 1, 2)"""


@query(f"WITH {KG} SELECT query_id, chunk_idx, round(kg, 9) AS kg FROM kg")
def kg_proximity(spark, sf_dir):
    rows = retrieval.proximity(hits(spark, sf_dir), *names(spark, sf_dir))
    return rows.select("query_id", "chunk_idx", F.round("kg", 9).alias("kg"))


def _rerank_sql(score: str, k: int) -> str:
    return f"""WITH {KG}, r AS (SELECT h.query_id, h.chunk_idx, h.rank AS old, round({score}, 12) AS score FROM hits h LEFT JOIN kg USING (query_id, chunk_idx))
SELECT query_id, chunk_idx, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM r) WHERE rank <= {k}"""


@query(_rerank_sql("CASE WHEN h.query_id IN (SELECT query_id FROM qn) THEN 0.7 * h.score + 0.3 * coalesce(kg, 0) ELSE h.score END", 5))
def rerank_library(spark, sf_dir):
    rows = retrieval.rerank(hits(spark, sf_dir), *names(spark, sf_dir), k=5)
    return rows.select("query_id", "chunk_idx", F.round("score", 9).alias("score"), "rank")


@query(_rerank_sql("0.7 * h.score + 0.3 * coalesce(kg0, 0)", 20))
def rerank_script(spark, sf_dir):
    rows = retrieval.rerank(hits(spark, sf_dir), *names(spark, sf_dir), k=20, variant="script")
    return rows.select("query_id", "chunk_idx", F.round("score", 9).alias("score"), "rank")


# ---- entities in texts -----------------------------------------------------------------

TERMS = r"terms AS (SELECT DISTINCT t AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM benchmark) WHERE regexp_full_match(t, '[a-z]{7,}'))"


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long plain words of the benchmark's items; their ids are digests."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[a-z]{7,}\b"), F.lit(0)))
    rows = table(spark, sf_dir, "benchmark").select(found.alias("term")).distinct()
    return rows.select("term", F.concat(F.lit("D"), F.left(F.md5(F.col("term").cast("binary")), F.lit(6))).alias("concept_id"))


#: A word of a text is a run of letters, digits and the underscore; terms are single such words.
SQL_RUNS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"


@query(f"WITH {TERMS}, r AS (SELECT doc_id, unnest({SQL_RUNS.format('text')}) AS w FROM documents) SELECT doc_id, w AS text, 'D' || left(md5(lower(w)), 6) AS concept_id, count(*) AS n FROM r WHERE lower(w) IN (SELECT term FROM terms) GROUP BY 1, 2, 3")
def entity_mentions(spark, sf_dir):
    rows = entities.mentions(docs(spark, sf_dir), terms(spark, sf_dir))
    return rows.groupBy("doc_id", "text", "concept_id").agg(F.count("*").alias("n"))


@query(f"WITH {TERMS}, r AS (SELECT unnest({SQL_RUNS.format('text')}) AS w FROM documents) SELECT DISTINCT w AS name FROM r WHERE lower(w) IN (SELECT term FROM terms)")
def entity_vocab(spark, sf_dir):
    return entities.vocabulary(entities.mentions(docs(spark, sf_dir), terms(spark, sf_dir)))


CHUNKS = f"{WORDS}, c0 AS (SELECT doc_id, {sql_windows('ws', 256, 32)} AS cs FROM w), ch AS (SELECT doc_id, unnest(range(len(cs)))::BIGINT AS position, unnest(cs) AS text FROM c0)"


@query(f"WITH {TERMS}, {CHUNKS}, r AS (SELECT doc_id, position, unnest({SQL_RUNS.format('text')}) AS x FROM ch) SELECT doc_id, position, x AS name, count(*) AS n FROM r WHERE lower(x) IN (SELECT term FROM terms) GROUP BY 1, 2, 3")
def chunk_mentions(spark, sf_dir):
    chunks = chunking.naive(docs(spark, sf_dir), 256, 32).withColumn("chunk_idx", F.struct("doc_id", "position"))
    rows = entities.mentions(chunks, terms(spark, sf_dir), "chunk_idx")
    return rows.groupBy("chunk_idx.doc_id", "chunk_idx.position", F.col("text").alias("name")).agg(F.count("*").alias("n"))


@query(f"WITH {TERMS}, r AS (SELECT doc_id, unnest({SQL_RUNS.format('text')}) AS w FROM documents) SELECT doc_id, w AS text, count(*) AS n FROM r WHERE lower(w) IN (SELECT term FROM terms) GROUP BY 1, 2")
def entity_mentions_joined(spark, sf_dir):
    """As for a dictionary too large to broadcast."""
    return entities.mentions(docs(spark, sf_dir), terms(spark, sf_dir), most=0).groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@query()
def entity_projection(spark, sf_dir):
    _, _, vectors = names(spark, sf_dir)
    return entities.project_table(vectors, 4).select("name", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


# ---- answers and questions -------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn with the next turn of its conversation, as question and answer."""
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", following.alias("answer")).where("answer is not null")


TURNS = "t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations QUALIFY answer IS NOT NULL)"
SET = "list_distinct({0})"


@query(f"WITH {TURNS}, s AS (SELECT conv_id, turn, {SET.format(sql_words('lower(text)'))} AS a, {SET.format(sql_words('lower(answer)'))} AS b FROM t) SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE, 9) END AS jaccard FROM s")
def jaccard_relevance(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(T.jaccard(F.col("text"), F.col("answer")), 9).alias("jaccard"))


@query(f"""WITH {TURNS}, n AS (SELECT conv_id, turn, {sql_words('lower(text)')} AS a, {sql_words('lower(answer)')} AS b FROM t),
x AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS w FROM n) GROUP BY 1, 2, 3), y AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS w FROM n) GROUP BY 1, 2, 3),
c AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS c FROM x JOIN y USING (conv_id, turn, w) GROUP BY 1, 2)
SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(2.0::DOUBLE * coalesce(c, 0) / (len(a) + len(b)), 9) END AS f1 FROM n LEFT JOIN c USING (conv_id, turn)""")
def token_f1(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(T.token_f1(F.col("text"), F.col("answer")), 9).alias("f1"))


@query("SELECT round(avg(CASE WHEN (quality = 0) = (toxic = 1) THEN 1 ELSE 0 END), 9) AS accuracy FROM labels")
def accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 0, "Yes ").otherwise("no").alias("p"), F.when(F.col("toxic") == 1, "yes").otherwise("NO").alias("g"))
    return rows.agg(F.round(metrics.accuracy(F.col("p"), F.col("g")), 9).alias("accuracy"))


@query(f"SELECT conv_id, turn, CASE WHEN d IN ('yes', 'no', 'maybe') THEN d ELSE 'unknown' END AS decision FROM (SELECT conv_id, turn, regexp_replace(lower({sql_words('text')}[1]), '[.,;:!]+$', '') AS d FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Yes, ' || text WHEN 1 THEN 'NO. ' || text ELSE text END AS text FROM conversations))")
def decision_extract(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Yes, "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("NO. "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.decision(text).alias("decision"))


@query("SELECT conv_id, 'Context:' || chr(10) || string_agg('[' || i || '] ' || text, chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Question: ' || first(text ORDER BY turn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id")
def prompt_build(spark, sf_dir):
    own = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(own.alias("texts"))
    return rows.select("conv_id", T.user_prompt(F.get("texts", F.lit(0)), F.col("texts")).alias("prompt"))


_TEMPLATE_ROWS = ", ".join(f"({i}, '{t}', '{s}', {r!r}, '{q}')" for i, (t, s, r, q) in enumerate(qa.TEMPLATES))


TEMPLATED = f"""{LABELLED}, tp(ord, template_type, source, required, template) AS (VALUES {_TEMPLATE_ROWS}),
d AS (SELECT doc_id, list(DISTINCT label) AS ls FROM lab GROUP BY 1), f AS (SELECT doc_id, label, text FROM lab QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY position) = 1),
ph AS (SELECT doc_id, label, array_to_string({sql_words("string_split(text, '.')[1]")}[1:15], ' ') AS p FROM f),
m AS (SELECT d.doc_id, tp.*, lower(left(p, 1)) || p[2:] AS p FROM d, tp JOIN ph ON ph.label = tp.source WHERE ph.doc_id = d.doc_id AND len(list_intersect(tp.required, d.ls)) = 2 AND p <> ''),
g AS (SELECT m.doc_id, m.ord, list(lab.position ORDER BY lab.position) AS gold FROM m JOIN lab ON lab.doc_id = m.doc_id AND list_contains(m.required, lab.label) GROUP BY 1, 2),
tq AS (SELECT m.doc_id AS article_id, replace(template, '{{phrase}}', p) AS question, required, gold, template_type FROM m JOIN g USING (doc_id, ord) QUALIFY row_number() OVER (PARTITION BY m.doc_id ORDER BY m.ord) <= 5)"""


@query(f"WITH {TEMPLATED} SELECT article_id, question, array_to_string(required, ',') AS required_sections, array_to_string(gold, ',') AS gold_paragraph_ids, template_type FROM tq")
def template_qa(spark, sf_dir):
    rows = qa.template_questions(paragraphs(spark, sf_dir))
    return rows.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("required_sections", "gold_paragraph_ids")})


def sql_f1(a: str, b: str) -> str:
    """Token F1 of two texts, from counts of words by map."""
    x, y = (f"coalesce({sql_words(f'lower({t})')}, [])" for t in (a, b))
    common = f"coalesce(list_sum(list_transform(list_distinct({x}), lambda w: least(len(list_filter({x}, lambda v: v = w)), len(list_filter({y}, lambda v: v = w))))), 0)"
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {common} / (len({x}) + len({y})) END"


def sql_decision(t: str) -> str:
    first = f"regexp_replace(lower({sql_words(t)}[1]), '[.,;:!]+$', '')"
    return f"CASE WHEN {first} IN ('yes', 'no', 'maybe') THEN {first} ELSE 'unknown' END"


PROMPTS = "pr AS (SELECT conv_id, first(text ORDER BY turn) AS f, string_agg('[' || i || '] ' || text, chr(10) ORDER BY turn) AS body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id)"


@query(f"""WITH {PROMPTS}, q AS (SELECT conv_id, string_split(f, chr(10))[1] AS answer, string_split('Context:' || chr(10) || body || chr(10) || chr(10) || 'Question: ' || f, 'Question: ')[-1] AS question FROM pr)
SELECT conv_id, {sql_decision('answer')} AS decision, round({sql_f1('answer', 'question')}, 9) AS f1 FROM q""")
def generation_eval(spark, sf_dir):
    """Prompts of conversations, extractive answers, and their token F1 against the question."""
    answered = qa.generate(prompt_build(spark, sf_dir))
    question = F.substring_index("prompt", "Question: ", -1)
    return answered.select("conv_id", "decision", F.round(T.token_f1(F.col("full_answer"), question), 9).alias("f1"))


@query(f"""WITH {TURNS}, a AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'Unknown ' ELSE 'yes' END AS label, answer, string_split(answer, chr(10))[1] AS full_answer FROM t)
SELECT round(avg(CASE WHEN {sql_decision('full_answer')} = lower(trim(label)) THEN 1 ELSE 0 END), 9) AS accuracy, round(avg({sql_f1('full_answer', 'answer')}), 9) AS avg_f1, count(*) AS n_questions FROM a""")
def generation_scores(spark, sf_dir):
    """Accuracy of decisions and mean F1 of extractive answers of conversations' turns."""
    label = F.when(F.col("conv_id") % 2 == 0, "Unknown ").otherwise("yes").alias("label")
    prompts = turns(spark, sf_dir).select(label, F.col("answer").alias("long_answer"), T.user_prompt(F.col("text"), F.array("answer")).alias("prompt"))
    scores = qa.answer_scores(qa.generate(prompts))
    return scores.select(F.round("accuracy", 9).alias("accuracy"), F.round("avg_f1", 9).alias("avg_f1"), "n_questions")


# ---- significance and reports ----------------------------------------------------------


def strategy_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condition, strategy, query_id, rr): dense hits, hits re-ranked by entities, and a reversed list."""
    h = written(hits(spark, sf_dir).select("query_id", "chunk_idx", "rank", "score", "doc_id", "section_title"), work_dir(spark, "hits"))
    ranked = retrieval.rerank(h, *names(spark, sf_dir), k=20, variant="script").join(h.select("query_id", "chunk_idx", "doc_id", "section_title"), ["query_id", "chunk_idx"])
    back = h.withColumn("rank", 21 - F.col("rank"))
    out = None
    for name, rows in (("graph", ranked), ("dense", h), ("reversed", back)):
        per = metrics.per_query(rows.select("query_id", "rank", "doc_id", "section_title"), questions(spark, sf_dir))
        per = per.select(F.lit("full").alias("condition"), F.lit(name).alias("strategy"), "query_id", metrics.reciprocal_rank(F.col("first_rank")).alias("rr"))
        out = per if out is None else out.unionByName(per)
    return out


@query()
def bootstrap_significance(spark, sf_dir):
    return significance.rounded(significance.significance(strategy_rr(spark, sf_dir), "graph"))


@query("""SELECT source AS competitor, p AS p_value, round(max(least(p * (n - k + 1), 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 9) AS adjusted_p_value FROM (
  SELECT source, p, row_number() OVER (ORDER BY p, source) AS k, count(*) OVER () AS n FROM (SELECT source, round(count(*) FILTER (WHERE lang = 'de') / count(*)::DOUBLE / 10, 9) AS p FROM documents GROUP BY source))""")
def holm(spark, sf_dir):
    share = F.round(F.count(F.when(F.col("lang") == "de", 1)) / F.count("*") / 10, 9)
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("competitor")).agg(share.alias("p_value"))
    out = significance.holm(rows.withColumn("condition", F.lit("all")), "condition")
    return out.select("competitor", "p_value", F.round("adjusted_p_value", 9).alias("adjusted_p_value"))


#: Metrics by language and source stand for metrics by condition and strategy.
MET = "met AS (SELECT lang AS condition, source AS strategy, avg(n_chars)::DOUBLE AS MRR, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2)"


def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("condition"), F.col("source").alias("strategy"))
    return rows.agg(F.avg("n_chars").alias("MRR"), F.count("*").cast("double").alias("n"))


@query(f"WITH {MET} SELECT condition, m.strategy, round(m.MRR, 6) AS MRR, round(m.MRR - b.MRR, 6) AS delta FROM met m JOIN (SELECT condition, MRR FROM met WHERE strategy = 'src0') b USING (condition)")
def ablation_delta(spark, sf_dir):
    rows = metrics.ablation(report_metrics(spark, sf_dir), "src0", "MRR", "condition")
    return rows.select("condition", "strategy", F.round("MRR", 6).alias("MRR"), F.round("delta", 6).alias("delta"))


@query(f"WITH {MET}, l AS (UNPIVOT met ON MRR, n INTO NAME metric VALUE value) SELECT condition, metric, strategy, round(value, 6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY condition, metric ORDER BY value DESC, strategy) = 1")
def best_per_metric(spark, sf_dir):
    rows = metrics.best(metrics.long_form(report_metrics(spark, sf_dir), "condition", "strategy"), "strategy", "condition")
    return rows.select("condition", "metric", "strategy", F.round("value", 6).alias("value"))


@query(f"WITH {MET}, l AS (UNPIVOT met ON MRR, n INTO NAME metric VALUE value) SELECT strategy, metric, {', '.join(f'round(max(value) FILTER (WHERE condition = {c!r}), 6) AS {c}' for c in ('en', 'fr', 'de', 'es'))} FROM l GROUP BY 1, 2")
def metrics_pivot(spark, sf_dir):
    rows = metrics.pivoted(metrics.long_form(report_metrics(spark, sf_dir), "condition", "strategy"), ["en", "fr", "de", "es"])
    return rows.select("strategy", "metric", *(F.round(c, 6).alias(c) for c in ("en", "fr", "de", "es")))


@query(f"WITH {HITS} SELECT round(avg(n), 9) AS section_diversity FROM (SELECT query_id, count(DISTINCT section) AS n FROM hits WHERE rank <= 5 GROUP BY 1)")
def section_diversity(spark, sf_dir):
    rows = metrics.per_query(hits(spark, sf_dir), questions(spark, sf_dir))
    return rows.agg(F.round(F.avg(metrics.coverage_at(5)), 9).alias("section_diversity"))


# ---- sources ---------------------------------------------------------------------------

_PAGE = "regexp_replace(h, '<[^>]*>', '', 'g')"
for _a, _b in articles.ENTITIES:
    _PAGE = "replace({}, '{}', '{}')".format(_PAGE, _a, _b.replace("'", "''"))


@query(f"WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1) AS ps FROM pages), r AS (SELECT page_id, unnest(range(len(ps)))::BIGINT AS position, unnest(ps) AS h FROM p) SELECT page_id, position, trim(regexp_replace({_PAGE}, '[{WS}]+', ' ', 'g')) AS text FROM r")
def pages_paragraphs(spark, sf_dir):
    return articles.page_paragraphs(table(spark, sf_dir, "pages"))


@query("SELECT event_id, round(value, 9) AS value, event_type FROM events")
def json_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "value", "event_type")).alias("j"))
    back = F.from_json("j", "event_id long, value double, event_type string")
    return rows.select("event_id", back["event_type"].alias("event_type"), F.round(back["value"], 9).alias("value"))


@query(f"WITH {PARAS} SELECT doc_id AS article_id, 'How? ' || doc_id AS question, 'introduction,results' AS required_sections, array_to_string(list(position ORDER BY position), ',') AS gold_paragraph_ids FROM para WHERE section_title IN ('1. Introduction', '3. Results') AND doc_id % 2 = 0 GROUP BY doc_id")
def llm_json_parse(spark, sf_dir):
    """Answers that a model could give: fenced JSON for even ids, text that doesn't parse for odd ones."""
    body = F.format_string('```json\n[{"question": "How? %d", "required_sections": ["Introduction", "other", "results"]}]\n```', F.col("doc_id"))
    answers = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, body).otherwise(F.lit("no json")).alias("answer"))
    rows = qa.llm_questions(answers, paragraphs(spark, sf_dir))
    return rows.select("article_id", "question", F.array_join("required_sections", ",").alias("required_sections"), F.array_join(F.col("gold_paragraph_ids").cast("array<string>"), ",").alias("gold_paragraph_ids"))


@query(f"""WITH {PARAS} SELECT doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1)::BIGINT AS position, t AS text, section_title FROM (SELECT doc_id, position, section_title, trim(regexp_replace(text, '[{WS}]+', ' ', 'g')) AS t FROM para) WHERE t <> ''""")
def xml_articles(spark, sf_dir):
    """Documents written as XML articles, a section for each placed title, and parsed again."""
    clean = F.regexp_replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", " ")
    p = paragraphs(spark, sf_dir).select("doc_id", "position", "section_title", F.concat(F.lit("<p>"), clean, F.lit("</p>")).alias("p"))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "p"))), lambda x: x["p"]), "")
    secs = p.groupBy("doc_id", "section_title").agg(F.min("position").alias("first"), F.concat(F.lit("<sec><title>"), "section_title", F.lit("</title>"), own, F.lit("</sec>")).alias("sec"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "sec"))), lambda x: x["sec"]), "")
    xml = F.concat(F.lit('<article><front><article-id pub-id-type="pmc">'), F.col("doc_id").cast("string"), F.lit("</article-id></front><body>"), body, F.lit("</body></article>"))
    files = secs.groupBy("doc_id").agg(F.encode(xml, "UTF-8").alias("content")).select(F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("path"), "content")
    return articles.paragraphs_of(articles.parse_articles(files)).select("doc_id", "position", "text", "section_title")


@query(f"WITH {COND} SELECT doc_id, position, text, section_title FROM cond WHERE condition = 'partial'")
def condition_roundtrip(spark, sf_dir):
    """Conditions as the sink writes them, one of them read by the loader."""
    folder = work_dir(spark, "conditions")
    sinks.write_partitioned(sections.conditions(paragraphs(spark, sf_dir)), folder, "condition")
    return articles.read_condition(spark, folder, "partial").drop("section_level")


@query("SELECT item_id::VARCHAR AS id, text AS question, CASE item_id % 3 WHEN 0 THEN text || chr(10) || 'more' WHEN 1 THEN text ELSE '' END AS context, '' AS long_answer, 'yes' AS label, item_id::VARCHAR AS pmid FROM benchmark")
def question_source(spark, sf_dir):
    """Benchmark items as a JSON list of questions, contexts of every kind, read by the source."""
    context = F.when(F.col("item_id") % 3 == 0, F.to_json(F.struct(F.array("text", F.lit("more")).alias("contexts")))).when(F.col("item_id") % 3 == 1, F.to_json(F.struct(F.col("text").alias("c")))).otherwise(F.lit(""))
    inner = F.when(F.col("item_id") % 3 == 1, F.regexp_replace(F.regexp_replace(context, r'^\{"c":', ""), r"\}$", "")).otherwise(context)
    named = F.concat(F.lit('{"pubid":'), F.col("item_id").cast("string"), F.lit(',"final_decision":"YES","question":'), F.regexp_extract(F.to_json(F.struct(F.col("text").alias("q"))), r'(?s)^\{"q":(.*)\}$', 1))
    one = F.concat(named, F.when(F.col("item_id") % 3 < 2, F.concat(F.lit(',"context":'), inner)).otherwise(F.lit("")), F.lit("}"))
    folder = work_dir(spark, "questions")
    rows = table(spark, sf_dir, "benchmark").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))  # a list is one value
    rows.write.mode("overwrite").text(f"{folder}/list")
    return articles.read_questions(spark, f"{folder}/none.json", f"{folder}/list")


# ---- flagship --------------------------------------------------------------------------

#: Vectors of the searches below: counts of words in 64 buckets, whole numbers in SQL as in Spark.
COUNTS = embedding.HashingEmbedder(64, normalise=False)


def sql_hits(k: int) -> str:
    """Ranked hits of ``qs`` (query_id, question) among the chunks ``ch``, as CTEs."""

    def counted(key: str, text: str, rows: str) -> str:
        return f"SELECT {key}, {HASHED.format(64)} AS b, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({sql_words(f'lower({text})')}) AS w FROM {rows}) GROUP BY ALL"

    score = "round(dot / (qn.norm * cn.norm), 12)"
    return f"""cv AS ({counted('doc_id, position', 'text', 'ch')}), qv AS ({counted('query_id', 'question', 'qs')}),
cn AS (SELECT doc_id, position, sqrt(sum(n * n)) AS norm FROM cv GROUP BY 1, 2), qn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM qv GROUP BY 1),
dots AS (SELECT query_id, doc_id, position, sum(qv.n * cv.n) AS dot FROM qv JOIN cv USING (b) GROUP BY 1, 2, 3),
hits AS (SELECT query_id, doc_id, position, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, doc_id, position) AS rank FROM dots JOIN qn USING (query_id) JOIN cn USING (doc_id, position) QUALIFY rank <= {k})"""


def search_chunks(spark: SparkSession, sf_dir: str, questions: DataFrame, k: int) -> DataFrame:
    """Hits of (query_id, question) among all documents' fixed windows."""
    chunks = chunking.naive(docs(spark, sf_dir), 256, 32)
    chunks = written(embedding.embed(chunks, COUNTS).withColumn("chunk_idx", F.struct("doc_id", "position")), work_dir(spark, "chunks"))
    return evaluation.hits_of(embedding.embed(questions, COUNTS, "question"), chunks, k)


def passages(spark: SparkSession, sf_dir: str, words: int | None = None) -> DataFrame:
    """Benchmark items as questions (their first words, if a number is given) with their text as context."""
    text = F.array_join(F.slice(T.words(F.col("text")), 1, words), " ") if words else F.col("text")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("question"), F.col("text").alias("context"))


PASSAGES = f"qs AS (SELECT item_id AS query_id, array_to_string({sql_words('text')}[1:12], ' ') AS question, text AS context FROM benchmark)"


@query(f"WITH {CHUNKS}, qs AS (SELECT item_id AS query_id, text AS question FROM benchmark), {sql_hits(5)} SELECT query_id, doc_id, position, round(score, 9) AS score, rank FROM hits")
def passage_search(spark, sf_dir):
    """Benchmark passages against all chunks: fixed windows, hashed vectors, exact top k."""
    found = search_chunks(spark, sf_dir, passages(spark, sf_dir), 5)
    return found.select("query_id", "doc_id", "chunk_idx.position", F.round("score", 9).alias("score"), "rank")


def sql_jaccard(a: str, b: str) -> str:
    x, y = (f"list_distinct({sql_words(f'lower({t})')})" for t in (a, b))
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y})) / len(list_distinct({x} || {y}))::DOUBLE END"


def sql_relevant(condition: str) -> str:
    return f"{CHUNKS}, {PASSAGES}, {sql_hits(5)}, f AS (SELECT query_id, min(rank) AS first_rank FROM hits JOIN ch USING (doc_id, position) JOIN qs USING (query_id) WHERE {condition} GROUP BY 1), q AS (SELECT query_id, first_rank FROM qs LEFT JOIN f USING (query_id))"


RR = "coalesce(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 0)"


@query(f"WITH {sql_relevant(sql_jaccard('text', 'context') + ' >= 0.3')} SELECT round({RR}, 9) AS mrr, {', '.join(f'round(avg(CASE WHEN first_rank <= {k} THEN 1 ELSE 0 END), 9) AS recall_{k}' for k in (1, 3, 5))} FROM q")
def jaccard_retrieval(spark, sf_dir):
    asked = passages(spark, sf_dir, 12)
    rows = metrics.jaccard_relevance(search_chunks(spark, sf_dir, asked, 5), asked)
    return rows.select(*(F.round(c, 9).alias(c) for c in rows.columns))


@query(f"WITH {sql_relevant(' OR '.join([sql_jaccard('text', 'context') + ' >= 0.15', sql_jaccard('text', 'question') + ' >= 0.12', 'score >= 0.55']))} SELECT 'naive' AS strategy, round({RR}, 4) AS MRR, 0.0::DOUBLE AS recall_1, 0.0::DOUBLE AS recall_3, 0.0::DOUBLE AS recall_5, count(*) AS n_questions, count(first_rank) AS n_found FROM q")
def hybrid_retrieval(spark, sf_dir):
    asked = passages(spark, sf_dir, 12)
    return metrics.hybrid_relevance(search_chunks(spark, sf_dir, asked, 5), asked, "naive")


def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template questions (query_id, question, gold, required), their article being the gold one."""
    rows = qa.template_questions(paragraphs(spark, sf_dir))
    return rows.select(F.concat_ws(":", F.col("article_id").cast("string"), "template_type").alias("query_id"), "question", F.array("article_id").alias("gold"), F.col("required_sections").alias("required"))


ASKED = f"{TEMPLATED}, qs AS (SELECT article_id::VARCHAR || ':' || template_type AS query_id, question, article_id AS gold, required FROM tq)"
FULL_EVAL = f"""WITH {ASKED}, {CHUNKS}, {sql_hits(20)}, q1 AS (SELECT qs.query_id, min(CASE WHEN doc_id = gold THEN rank END) AS first_rank, coalesce(sum(CASE WHEN doc_id = gold AND rank <= 10 THEN 1 / log2(rank + 1) END), 0) AS ndcg, count(rank) AS n
  FROM qs LEFT JOIN hits USING (query_id) GROUP BY 1)
SELECT 'naive' AS strategy, round({RR}, 9) AS MRR, {', '.join(f'round(avg(CASE WHEN first_rank <= {k} THEN 1 ELSE 0 END), 9) AS recall_{k}' for k in (1, 3, 5, 10))}, round(avg(ndcg), 9) AS ndcg_10, count(*) AS n_questions, count(first_rank) AS n_found,
  {', '.join(f'0.0::DOUBLE AS cross_section_recall_{k}, round(avg(least(n, 1)), 9) AS section_coverage_{k}' for k in (5, 10, 20))} FROM q1"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(FULL_EVAL)
def eval_naive(spark, sf_dir):
    """The whole evaluation of one strategy, from articles and template questions to metrics."""
    return _rounded(evaluation.evaluate(paragraphs(spark, sf_dir), template_rows(spark, sf_dir), evaluation.STRATEGIES[0], COUNTS, embedding.HashingTokenEncoder(64)))


@query()
def eval_strategies(spark, sf_dir):
    """All six strategies."""
    return _rounded(evaluation.evaluate_all(paragraphs(spark, sf_dir), template_rows(spark, sf_dir), embedding.HashingEmbedder(64), embedding.HashingTokenEncoder(64), terms(spark, sf_dir)))


@query(f"""WITH {ASKED}, {CHUNKS}, {sql_hits(5)}, x AS (SELECT qs.query_id, any_value(question) AS question, count(rank) AS n, sum(len({sql_words('text')})) AS nw, coalesce(max(CASE WHEN rank = 1 THEN text END), '') AS answer FROM qs LEFT JOIN hits USING (query_id) LEFT JOIN ch USING (doc_id, position) GROUP BY 1)
SELECT 'naive' AS strategy, 'fulltext' AS condition, round(avg({sql_f1('answer', 'question')}), 4) AS avg_f1, round(avg(least(n, 1)), 2) AS avg_section_diversity, count(*) AS n_questions,
  sum(2 + n + coalesce(nw, 0) + len({sql_words('question')}) + len({sql_words('answer')}))::BIGINT AS total_tokens, 'extractive' AS model FROM x""")
def generation_summary(spark, sf_dir):
    return evaluation.generation(paragraphs(spark, sf_dir), template_rows(spark, sf_dir), evaluation.STRATEGIES[0], COUNTS, embedding.HashingTokenEncoder(64))


@query(f"WITH {CHUNKS} SELECT 'naive' AS strategy, count(*) AS n_chunks FROM ch UNION ALL SELECT 'late_chunking', sum(ceil(len({TOKENS}) / 256.0))::BIGINT FROM documents")
def index_build(spark, sf_dir):
    """Indexes of two strategies, written, and their sizes."""
    chosen = tuple(s for s in evaluation.STRATEGIES if s.name in ("naive", "late_chunking"))
    built = evaluation.build_indexes(paragraphs(spark, sf_dir), work_dir(spark, "indexes"), embedding.HashingEmbedder(16), embedding.HashingTokenEncoder(16), chosen)
    return built.select("strategy", "n_chunks")
