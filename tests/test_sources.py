import os

import pytest
from pyspark.sql import functions as F

from sectionlens.sources import articles, connectors, sinks
from sectionlens.streaming import ingest

NESTED = """<pmc-articleset><article><front><article-meta><article-id pub-id-type="doi">x</article-id><article-id pub-id-type="pmc">77</article-id>
<title-group><article-title>A  <i>big</i>\n title</article-title></title-group><abstract><p>First.</p><p>Second &amp; last.</p></abstract></article-meta></front>
<body><sec><title>Methods</title><p>We cite <xref ref-type="bibr" rid="r1">1</xref> and <xref ref-type="bibr">2</xref>.</p>
<sec><title>Study population</title><p>Inner.</p></sec><p>After.</p></sec><sec><title>Results</title><p>  </p></sec></body>
<back><ref-list><ref>Ref one</ref><ref>Ref two</ref></ref-list></back></article></pmc-articleset>"""
LOOSE = "<article><body><p>Only  text.</p></body></article>"


@pytest.fixture
def folder(tmp_path):
    for name, content in {"a.xml": NESTED, "b.xml": LOOSE, "c.xml": "<article>", "d.txt": "no"}.items():
        (tmp_path / name).write_text(content)
    return str(tmp_path)


def test_nested_articles(spark, folder):
    rows = articles.read_articles(spark, folder)
    got = {r.doc_id: r for r in rows.collect()}
    assert set(got) == {"77", "b", "c"} and got["c"].error and not got["77"].error
    a = got["77"]
    assert (a.title, a.abstract, a.references) == ("A big title", "First.\nSecond & last.", ["Ref one", "Ref two"])
    assert [(s.path, s.level, s.title, s.text) for s in a.sections] == [([0], 0, "Methods", "We cite 1 and 2.\nAfter."), ([0, 0], 1, "Study population", "Inner."), ([1], 0, "Results", "")]
    paras = articles.paragraphs_of(rows).where("doc_id = '77'").orderBy("position").collect()
    assert [(p.text, p.section_title, p.section_level) for p in paras] == [("We cite 1 and 2.", "Methods", 0), ("After.", "Methods", 0), ("Inner.", "Study population", 1)]
    assert list(paras[0].citations) == ["r1", "2"]
    assert [(p.text, p.section_title) for p in got["b"].paragraphs] == [("Only text.", "")]
    assert articles.sections_of(rows).count() == 3


def test_flat_articles(spark, folder):
    got = {r.doc_id: r for r in articles.read_articles(spark, folder, "flat").where("error is null").collect()}
    assert set(got) == {"a", "b"} and {p.section_level for p in got["a"].paragraphs} == {0}
    assert [p.text for p in got["a"].paragraphs] == ["We cite 1 and 2.", "After.", "Inner."] and [p.text for p in got["b"].paragraphs] == ["Only  text."]
    with pytest.raises(ValueError):
        articles.ArticleParser("other")


def test_questions(spark, tmp_path):
    kinds = ['{"contexts": ["a", "b"], "labels": ["x"]}', '"plain text"', "5", "{}", '["p", "q"]', '{"contexts": []}']
    rows = [f'{{"question": "Q?", "context": {c}, "long_answer": "L", "final_decision": "Yes", "pubid": {i}}}' for i, c in enumerate(kinds)]
    (tmp_path / "q.json").write_text(f"[{', '.join([*rows, '{"question": "Q?"}'])}]")
    got = {r.id: r for r in articles.read_questions(spark, str(tmp_path / "none.json"), str(tmp_path / "q.json")).collect()}
    assert [got[str(i)].context for i in range(6)] == ["a\nb", "plain text", "5", "", '["p", "q"]', ""]
    assert (got["0"].label, got["0"].pmid, got["0"].long_answer) == ("yes", "0", "L") and (got[""].context, got[""].label) == ("", "")
    (tmp_path / "p.json").write_text('[{"id": "7", "question": "Q?", "context": "c", "label": "no", "pmid": "8"}]')
    row = articles.read_questions(spark, str(tmp_path / "p.json")).first()
    assert (row.id, row.label, row.pmid) == ("7", "no", "8") and articles.read_questions(spark, str(tmp_path / "no.json")).count() == 0
    assert articles.read_first_of(spark, articles.QA_RAW, str(tmp_path / "no.json"), str(tmp_path / "q.json")).count() == 7
    assert articles.read_first_of(spark, articles.QA_RAW, str(tmp_path / "no.json")).count() == 0


def test_stored_articles_and_conditions(spark, tmp_path):
    root = tmp_path / "conditions"
    (root / "fulltext").mkdir(parents=True)
    (root / "fulltext" / "a.json").write_text('{"pmid": "1__fulltext", "title": "T", "is_pubmedqa": true, "paragraphs": [{"text": "x", "section_title": "A", "section_level": 1, "position": 4}, {"text": "y"}]}')
    (root / "fulltext" / "b.json").write_text('{"pmid": "2", "paragraphs": []}')
    (root / "fulltext" / "notes.txt").write_text("no")
    got = {r.doc_id: r for r in articles.read_stored(spark, str(root / "fulltext")).collect()}
    assert [(p.position, p.text, p.section_title, p.section_level, p.citations) for p in got["1__fulltext"].paragraphs] == [(4, "x", "A", 1, []), (1, "y", "", 0, [])]
    assert got["1__fulltext"].is_pubmedqa and got["2"].abstract == "" and got["2"].references == [] and not got["2"].is_pubmedqa
    rows = articles.read_condition(spark, str(root), "fulltext", short_ids=True).orderBy("position").collect()
    assert [(r.doc_id, r.text) for r in rows] == [("1", "y"), ("1", "x")]
    assert articles.read_condition(spark, str(root), "fulltext", without_tagged=True).count() == 0
    assert articles.read_condition(spark, str(root), "intro").count() == 0 and articles.read_stored(spark, str(root / "none")).count() == 0
    table = spark.createDataFrame([("intro", 5, 0, "t", True), ("partial", 6, 0, "u", False)], "condition string, doc_id long, position int, text string, is_pubmedqa boolean")
    sinks.write_partitioned(table, str(tmp_path / "written"), "condition")
    assert [r.doc_id for r in articles.read_condition(spark, str(tmp_path / "written"), "partial").collect()] == [6]
    assert articles.read_condition(spark, str(tmp_path / "written"), "intro", without_tagged=True).count() == 0
    assert articles.read_articles(spark, str(tmp_path / "nowhere")).count() == 0


def test_articles_go_all_the_way(spark, folder):
    """From XML files to conditions, chunks and metrics, ids as the files have them."""
    from sectionlens.operators import embedding, sections
    from sectionlens.plans import evaluation

    parsed = articles.read_articles(spark, folder)
    paras = articles.paragraphs_of(parsed).drop("citations")
    conditions = sections.conditions(paras, 1)
    assert {(r.condition, r.doc_id) for r in conditions.collect()} == {("partial", "77"), ("fulltext", "77"), ("fulltext", "b")}
    built = {(r.condition, r.doc_id): r for r in sections.condition_articles(parsed, conditions).collect()}
    full = built["fulltext", "77"]
    assert full.title == "A big title" and full.references == [] and [(s.section_title, s.level, s.text) for s in full.sections] == [("Methods", 0, "We cite 1 and 2.\n\nAfter."), ("Study population", 1, "Inner.")]
    asked = spark.createDataFrame([(1, "We cite after", ["77"], ["Methods"]), (2, "Only text", ["b"], [])], "query_id long, question string, gold array<string>, required array<string>")
    for strategy in evaluation.STRATEGIES[:4]:
        row = evaluation.evaluate(paras, asked, strategy, embedding.HashingEmbedder(64), embedding.HashingTokenEncoder(64)).first()
        assert (row.n_questions, row.n_found, row.MRR) == (2, 2, 1.0)


def test_search_and_land(tmp_path):
    pages = {0: ["1", "2", "3"], 3: ["4"]}
    asked = []

    def page(query, start, size):
        asked.append(query)
        return pages[start]

    assert connectors.search(page, "x", 10, exclude=["2"], page_size=3) == ["1", "3", "4"] and "open access" in asked[0]
    assert connectors.search(page, "x", 2, page_size=3) == ["1", "2"]
    (tmp_path / "1.xml").write_text("old")

    def fetch(i):
        if i == "3":
            raise OSError
        return f"<a>{i}</a>".encode()

    got = connectors.land(fetch, ["1", "2", "3"], str(tmp_path))
    assert [os.path.basename(p) for p in got] == ["1.xml", "2.xml"] and (tmp_path / "1.xml").read_text() == "old"
    assert connectors.related(lambda ids: [i + "x" for i in ids], ["b", "a"], 3) == ["a", "ax", "b"]
    assert connectors.related(lambda ids: ["never"], ["b", "a"], 2) == ["a", "b"]


def test_rate_limit_and_tickets():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = connectors.RateLimiter(20, lambda: now[0], sleep)
    for _ in range(3):
        limiter.wait()
    assert slept == pytest.approx([0.05, 0.05])
    posts = []

    def post(url, data):
        posts.append(url)
        return '<form action="https://h/tgt" method="post">' if "api-key" in url else "ticket"

    def get(url, params):
        assert params["ticket"] == "ticket"
        return {"result": {"results": [{"ui": "C1", "name": "n", "rootSource": "s"}, {"ui": "NONE"}]}} if "search" in url else {"result": [{"relatedIdName": "a", "relationLabel": "b", "relatedId": "c"}]}

    client = connectors.ConceptClient(post, get, "key", "https://h", rate=1e9)
    assert client.concepts("heart") == [{"ui": "C1", "name": "n", "rootSource": "s"}] and client.relations("C1")[0]["relatedId"] == "c"
    assert sum("api-key" in p for p in posts) == 1
    client.forget()
    client.ticket()
    assert sum("api-key" in p for p in posts) == 2


def test_terms(spark):
    rows = connectors.terms_table(spark, [("42", ["Heart", "ab"]), ("1234567", ["LUNG"])]).collect()
    assert {(r.term, r.concept_id) for r in rows} == {("heart", "D000042"), ("lung", "D1234567")} and connectors.descriptor_id("42") == "D000042"
    asked = []

    def page(ids):
        asked.append(len(ids))
        if len(asked) == 2:
            raise OSError
        return {"1": ["Heart", "ab", ""], "2": "xy", "3": []}

    assert connectors.term_records(page, [str(i) for i in range(1, 251)]) == [("1", ["Heart"]), ("2", ["xy"])] and asked == [100, 100, 50]
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    assert [r.id for r in connectors.not_landed(ids, ids.where("id = '1'")).collect()] == ["2"]


def test_terms_come_from_cache_fetch_or_seed(spark, tmp_path):
    def gone():
        raise OSError

    fetched = connectors.load_terms(spark, str(tmp_path / "a"), lambda: [("42", ["Heart"])])
    assert [(r.term, r.concept_id) for r in fetched.collect()] == [("heart", "D000042")]
    assert connectors.load_terms(spark, str(tmp_path / "a"), gone).count() == 1
    assert connectors.load_terms(spark, str(tmp_path / "b"), gone).count() > 100
    assert connectors.load_terms(spark, str(tmp_path / "c"), lambda: []).count() > 100


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "condition string, n int")
    sinks.write_partitioned(df, path, "condition")
    sinks.write_partitioned(df.where("condition = 'a'").withColumn("n", F.col("n") + 9), path, "condition")
    assert {(r.condition, r.n) for r in spark.read.parquet(path).collect()} == {("a", 10), ("b", 2)}
    assert [r.condition for r in sinks.pending(df, df.where("n = 1"), "condition").collect()] == ["b"] and sinks.pending(df, None, "condition").count() == 2
    with pytest.raises(ValueError):
        sinks.write_index(df, path)
    chunks = df.withColumn("embedding", F.array(F.lit(3.0), F.lit(4.0)))
    with pytest.raises(ValueError):
        sinks.write_index(chunks, path, 3)
    with pytest.raises(ValueError):
        sinks.write_index(chunks.union(df.withColumn("embedding", F.array(F.lit(1.0)))), path)
    with pytest.raises(ValueError):
        sinks.write_index(df.withColumn("embedding", F.lit(None).cast("array<double>")), path)
    sinks.write_index(chunks, str(tmp_path / "i"), 2)
    assert [r.embedding for r in sinks.read_index(spark, str(tmp_path / "i")).collect()] == [pytest.approx([0.6, 0.8])] * 2
    names = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c")], "chunk_idx long, name string")
    assert {r.chunk_idx: r.names for r in sinks.chunk_entity_map(names).collect()} == {"1": ["a", "a", "b"], "2": ["c"]}
    tests = spark.createDataFrame([("f", "a", 0.1234567), ("f", "b", 0.5)], "condition string, competitor string, p_value double")
    assert sinks.significance_map(tests).first().tests["a"].p_value == 0.123457
    results = spark.createDataFrame([("f", "a", 0.5, 1.0, [1.0]), ("f", "b", 0.75, 2.0, [0.5])], "condition string, strategy string, MRR double, section_coverage_20 double, per_query_rr array<double>")
    assert sinks.summary(results, "g").columns == ["condition", "strategy", "MRR", "section_coverage_20"]
    sinks.write_json(results.drop("per_query_rr"), str(tmp_path / "r"))
    (tmp_path / "one.json").write_text('{"condition": "f",\n "MRR": 0.5}')
    kind = "condition string, MRR double"
    assert sinks.read_results(spark, kind, str(tmp_path / "no"), str(tmp_path / "r")).count() == 2 and sinks.read_results(spark, kind, str(tmp_path / "no")).count() == 0
    assert sinks.read_results(spark, kind, str(tmp_path / "one.json")).first().MRR == 0.5
    frames = sinks.figure_frames(results.drop("per_query_rr"), "a", ["f"])
    assert {r.strategy: r.delta for r in frames["waterfall"].collect()} == {"a": 0, "b": 0.25} and frames["bars"].count() == 4 and frames["heat"].count() == 2
    assert sinks.console_table(results, ["MRR"]).split("\n")[1].split() == ["a", "0.5000"]


def test_reports(spark):
    df = spark.createDataFrame([("a_b", 0.5, None), ("c", 0.25, 1.0)], "strategy string, MRR double, f1 double")
    table = sinks.latex_table(df, ["MRR", "f1"], "Cap", "tab:x")
    assert r"a\_b & \textbf{0.500} & -- \\" in table and r"c & 0.250 & \textbf{1.000} \\" in table
    old = r"pre \begin{table}\label{tab:y}\end{table} \begin{table}old\label{tab:x}\end{table} post"
    assert sinks.replace_table(old, "tab:x", table).count("old") == 0 and "tab:y" in sinks.replace_table(old, "tab:x", table)
    assert sinks.replace_table(old, "tab:z", table) == old
    want = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c")], "condition string, strategy string")
    one = spark.createDataFrame([("f", "a", 0.1)], "condition string, strategy string, MRR double")
    two = spark.createDataFrame([("f", "a", 0.9), ("f", "b", 0.2)], "condition string, strategy string, MRR double")
    assert {r.strategy: r.MRR for r in sinks.crossover(one, two, want).collect()} == {"a": 0.1, "b": 0.2, "c": None}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string")
    for k in range(2):  # the second time document 1 arrives again
        rows.union(spark.createDataFrame([(3 + k, "d e")], rows.schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        chunks = ingest.chunk_stream(ingest.landed(spark, str(tmp_path / "in")), 2, 0)
        ingest.append(chunks, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(120)
    got = sorted((r.doc_id, r.position, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, "a b"), (1, 1, "c"), (3, 0, "d e"), (4, 0, "d e")]
