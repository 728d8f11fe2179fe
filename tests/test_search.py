"""Exact search at size: what a task reads, keeps and hands on."""

import numpy as np
from pyspark.sql import functions as F

from sectionlens.operators import embedding, retrieval
from sectionlens.plans import evaluation


def counts(n: int, width: int, seed: int) -> np.ndarray:
    """Whole numbers, so that equal cosines are frequent; a fifth are copies of one vector."""
    x = np.random.default_rng(seed).integers(0, 3, (n, width)).astype(float)
    x[::5] = x[0]
    x[7] = 0
    return x


def test_search_keeps_k_rows_a_query_whatever_the_blocks(spark, monkeypatch):
    for name, value in (("INDEX_BLOCK", 16), ("QUERY_BLOCK", 8), ("TASK_SCORES", 1000)):
        monkeypatch.setattr(retrieval, name, value)
    x, y = counts(300, 6, 1), counts(40, 6, 2)
    index = spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in enumerate(x)], "chunk_idx long, title string, embedding array<double>").repartition(7)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "query_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, so that the index is dealt out too
    try:
        found = retrieval.top_k(queries, index, 9, carry=["title"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()  # blocks went through the JVM once a pair
    norms = [np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-10) for v in (y, x)]
    score = np.round((y @ x.T) / (norms[0][:, None] * norms[1]), 12)
    expected = [(q, int(i), f"t{i}", r + 1, score[q, i]) for q in range(40) for r, i in enumerate(np.argsort(-score[q], kind="stable")[:9])]
    assert [(r.query_id, r.chunk_idx, r.title, r.rank, r.score) for r in found.orderBy("query_id", "rank").collect()] == expected


def test_nearest_of_many_blocks():
    rng = np.random.default_rng(3)
    x, q = counts(5000, 20, 4), rng.normal(size=(300, 20))
    score, place = retrieval._nearest(q, (x[i : i + 700] for i in range(0, 5000, 700)), 20)
    norms = [np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-10) for v in (q, x)]
    whole = np.round(np.einsum("id,jd->ij", q, x) / (norms[0][:, None] * norms[1]), 12)
    assert (np.take_along_axis(whole, place, 1) == score).mean() > 0.99 and np.abs(np.sort(-whole, axis=1)[:, :20] + score).max() < 1e-11
    few, at = retrieval._nearest(q, iter([x[:3]]), 5)
    assert (at[:, 3:] == -1).all() and np.isinf(few[:, 3:]).all()


def test_embed_completes_missing_vectors(spark):
    encoder = embedding.HashingEmbedder(4, normalise=False)
    rows = [(1, "a b", None), (2, None, None), (3, "c", [9.0, 9.0, 9.0, 9.0])]
    for own in (rows, rows[:2], rows[2:]):
        df = spark.createDataFrame(own, "id int, text string, embedding array<float>").coalesce(1)
        got = {r.id: r.embedding for r in embedding.embed(df, encoder).collect()}
        assert got == {i: v or encoder.encode([t])[0].tolist() for i, t, v in own}
    plain = spark.createDataFrame([(1, "a b")], "id int, text string")
    assert embedding.embed(plain, encoder).first().embedding == encoder.encode(["a b"])[0].tolist()
    assert embedding.embed(plain.where(F.lit(False)), encoder).count() == 0


def test_strategies_share_what_they_have_in_common(spark, monkeypatch):
    titles = ["Introduction", "Methods", "Results", "Discussion"]
    paras = spark.createDataFrame([(d, p, f"topic{d} is a word of part{p} and word{(d * p) % 5} .", t, 0) for d in range(4) for p, t in enumerate(titles)], "doc_id long, position int, text string, section_title string, section_level int")
    questions = spark.createDataFrame([(d, f"what of topic{d}", [d], ["Methods"]) for d in range(4)], "query_id long, question string, gold array<long>, required array<string>")
    terms = spark.createDataFrame([(f"topic{d}", f"D{d}") for d in range(4)], "term string, concept_id string")
    models = embedding.HashingEmbedder(32), embedding.HashingTokenEncoder(32)
    chosen = evaluation.STRATEGIES[3:]
    alone = evaluation.evaluate(paras, questions, chosen[2], *models, terms).first()
    chunked, searched, real = [], [], (evaluation.chunks_of, evaluation.retrieval.top_k)
    monkeypatch.setattr(evaluation, "chunks_of", lambda *a: chunked.append(a) or real[0](*a))
    monkeypatch.setattr(evaluation.retrieval, "top_k", lambda *a, **b: searched.append(a) or real[1](*a, **b))
    rows = {r.strategy: r for r in evaluation.evaluate_all(paras, questions, *models, terms, chosen).collect()}
    assert len(chunked) == 1 and len(searched) == 2  # once a strategy before
    assert rows["kg_infused_graph"] == alone and set(rows) == {s.name for s in chosen} and alone.n_found == 4


def test_generation_joins_five_texts_a_question(spark, monkeypatch):
    paras = spark.createDataFrame([(d, 0, f"topic{d} is here .", "Results", 0) for d in range(9)], "doc_id long, position int, text string, section_title string, section_level int")
    questions = spark.createDataFrame([(d, f"what of topic{d}", [d], ["Results"]) for d in range(9)], "query_id long, question string, gold array<long>, required array<string>")
    made, real = [], evaluation.written
    monkeypatch.setattr(evaluation, "written", lambda df, folder: made.append(real(df, folder)) or made[-1])
    row = evaluation.generation(paras, questions, evaluation.STRATEGIES[0], embedding.HashingEmbedder(32), embedding.HashingTokenEncoder(32)).first()
    hits = made[-1]  # the search runs once, before texts come in
    assert {"query_id", "rank", "doc_id", "section_title"} <= set(hits.columns) and "text" not in hits.columns and hits.count() == 45
    assert row.n_questions == 9 and row.avg_section_diversity == 1 and row.avg_f1 > 0


def test_tiles_that_nothing_reaches_are_not_looked_through(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.random((700, 8), np.float32), rng.random((3000, 8), np.float32)
    product = a @ b.T
    least = np.sort(product, axis=1)[:, -3] - np.float32(1e-5)
    least[50:] = 9
    looked = []

    class Numpy:
        def __getattr__(self, name):
            return getattr(np, name)

        def flatnonzero(self, x):
            looked.append(np.size(x))
            return np.flatnonzero(x)

    monkeypatch.setattr(retrieval, "np", Numpy())
    rows, columns = retrieval._over(a, b, least)
    expected = np.nonzero(product >= least[:, None] - np.float32(1e-5))
    assert set(zip(rows.tolist(), columns.tolist())) <= set(zip(*(x.tolist() for x in expected))) and len(rows) >= 150
    assert sum(looked) < product.size / 10  # an eighth before, as words of eight marks
    assert [len(x) for x in retrieval._over(a, b, np.full(700, 9, np.float32))] == [0, 0]


def test_search_for_gold_ends_where_its_rank_is_known(spark, monkeypatch):
    for name, value in (("INDEX_BLOCK", 64), ("QUERY_BLOCK", 8), ("TASK_SCORES", 1000)):
        monkeypatch.setattr(retrieval, name, value)
    x, y, k = counts(900, 6, 1), counts(40, 6, 2), 5
    index = spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in enumerate(x)], "chunk_idx long, title string, embedding array<double>").repartition(7)
    norms = [np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-10) for v in (y, x)]
    score = np.round((y @ x.T) / (norms[0][:, None] * norms[1]), 12)
    of_gold = score[np.arange(40), np.arange(40) * 7 % 900]
    stops = [None if i == 3 else float(s) for i, s in enumerate(of_gold)]
    queries = spark.createDataFrame([(i, v.tolist(), s) for i, (v, s) in enumerate(zip(y, stops))], "query_id long, embedding array<double>, best double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, so that the index is dealt out too
    try:
        found = retrieval.top_k(queries, index, k, carry=["title"], stop="best")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = {}
    for r in found.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.chunk_idx, r.title, r.rank, r.score))
    ended = 0
    for q in range(40):
        best = [(int(i), f"t{i}", n + 1, score[q, i]) for n, i in enumerate(np.argsort(-score[q], kind="stable")[:k])]
        if len(rows[q]) == 1:
            (i, title, rank, none), *_ = rows[q]
            ended += 1
            assert best[-1][3] > (of_gold[q] if q != 3 else -1) and (q == 3 or score[q, i] > of_gold[q]) and (title, rank, none) == (f"t{i}", 1, None)
        else:
            assert rows[q] == best
    assert 3 in rows and len(rows[3]) == 1 and 10 < ended < 40  # 40 x 5 rows before


def test_rows_of_queries_that_are_done_are_not_multiplied(monkeypatch):
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(20_000, 8)), rng.normal(size=(400, 8))
    multiplied, real = [], retrieval._over
    monkeypatch.setattr(retrieval, "_over", lambda a, b, least: multiplied.append(len(a) * len(b)) or real(a, b, least))
    stop = np.full(400, 0.0)  # half of the index is above
    stop[:10] = 2
    score, place = retrieval._nearest(q, iter([x]), 20, stop)
    whole = retrieval._nearest(q, iter([x]), 20)
    assert (score[:10] == whole[0][:10]).all() and (place[:10] == whole[1][:10]).all()
    assert np.isinf(score[10:]).all() and (place[10:, 0] >= 0).all() and (place[10:, 1:] == -1).all()
    assert sum(multiplied) < 1.2 * len(x) * len(q)  # twice as many before


def test_metrics_of_a_search_for_gold_are_those_of_all_hits(spark, monkeypatch):
    paras = spark.createDataFrame([(d, 0, f"topic{d % 40} has word{d % 7} and part{d % 11} . " * (1 + d % 3), "Results", 0) for d in range(240)], "doc_id long, position int, text string, section_title string, section_level int")
    rows = [(d, f"what of topic{d % 40} and word{d % 5}", [d, d + 1] if d % 2 else [d], ["Results"]) for d in range(200)] + [(900, None, [3], []), (901, "word1 ?", [1000, 4], [""])]
    questions = spark.createDataFrame(rows, "query_id long, question string, gold array<long>, required array<string>")
    models, seen, real = (embedding.HashingEmbedder(32), embedding.HashingTokenEncoder(32)), [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda *a, **b: seen.append(b.get("stop")) or real(*a, **b))
    for strategy in evaluation.STRATEGIES[:3]:
        row = evaluation.evaluate(paras, questions, strategy, *models).first()
        with monkeypatch.context() as m:
            m.setattr(evaluation, "UNTITLED", ())
            assert evaluation.evaluate(paras, questions, strategy, *models).first() == row
        assert 0 < row.n_found < row.n_questions == 202 and row.section_coverage_20 == 1
    assert seen == ["best", None] * 3


def test_chunks_that_stay_are_searched_once_for_both_tables(spark, monkeypatch):
    for name, value in (("INDEX_BLOCK", 64), ("QUERY_BLOCK", 8), ("TASK_SCORES", 2000)):
        monkeypatch.setattr(retrieval, name, value)
    x, z, y, k = counts(400, 6, 1), counts(400, 6, 5), counts(40, 6, 2), 9
    moved = np.arange(400) % 3 == 0
    rows = [(i, i % 50, f"s{i % 4}", v.tolist(), w.tolist() if m else None) for i, (v, w, m) in enumerate(zip(x, z, moved))]
    chunks = spark.createDataFrame(rows, "chunk_idx long, doc_id long, section_title string, plain array<double>, embedding array<double>").repartition(5)
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "query_id long, embedding array<double>")
    searched, real = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, folder: searched.append(real(df, folder)) or searched[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        both = evaluation.hits_of_both(questions, chunks, k, evaluation.work_dir(spark, "both")).cache()
        got = both.where(F.col("rank") <= k), evaluation.hits_of_moved(questions, chunks, both, k, evaluation.work_dir(spark, "moved"))
        for found, index in zip(got, (x, np.where(moved[:, None], z, x))):
            norms = [np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-10) for v in (y, index)]
            score = np.round((y @ index.T) / (norms[0][:, None] * norms[1]), 12)
            expected = [(q, int(i), int(i) % 50, r + 1, score[q, i]) for q in range(40) for r, i in enumerate(np.argsort(-score[q], kind="stable")[:k])]
            assert [(r.query_id, r.chunk_idx, r.doc_id, r.rank, r.score) for r in found.orderBy("query_id", "rank").collect()] == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(t.count() for t in searched) <= 400 + moved.sum()  # 800 where each table is searched whole


def test_peaks_of_level_tops():
    from sectionlens.operators import chunking

    assert chunking.peaks(np.array([0, 2, 2, 2, 1, 3, 0, 1, 1]), 1, 1).tolist() == [2, 5] and chunking.peaks(np.array([0, 2, 2, 2, 1, 3, 0]), 1, 4).tolist() == [5]
    assert [chunking.peaks(np.zeros(n), 0, 1).tolist() for n in range(4)] == [[]] * 4


def test_chunkers_hold_few_documents_at_a_time(spark, monkeypatch):
    from sectionlens.operators import chunking

    sizes, real = [], chunking._batches
    monkeypatch.setattr(chunking, "_batches", lambda ids, *a: sizes.append(len(ids)) or real(ids, *a))

    class Rows:  # a frame whose Arrow function runs here
        def __init__(self, df):
            self.df = df

        def __getattr__(self, name):
            return getattr(self.df, name)

        def select(self, *columns):
            return Rows(self.df.select(*columns))

        def mapInArrow(self, run, schema):
            return [r for b in run(iter(self.df.toArrow().combine_chunks().to_batches())) for r in b.to_pylist()]

    docs = spark.createDataFrame([(i, f"word{i} is here .") for i in range(600)], "doc_id long, text string").coalesce(1)
    assert len(chunking.late(Rows(docs), embedding.HashingTokenEncoder(8))) == 600
    assert len(sizes) == 3 and max(sizes) == chunking.DOCUMENTS  # all 600 before
