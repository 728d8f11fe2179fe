"""Behaviour of the library's operators against hand-worked cases and plain-Python versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectionlens.functions import text as T
from sectionlens.functions import vectors as V
from sectionlens.operators import chunking, embedding, entities, metrics, qa, retrieval, sections, significance
from sectionlens.plans import evaluation

I, M, R, D = "introduction", "methods", "results", "discussion"
TITLES = {
    I: ["Introduction", "1. Introduction", "BACKGROUND", "1 Background and Objectives"],
    M: ["Methods", "Materials and Methods", "2. Experimental Design", "Study Design and Procedures", "Experimental Results"],
    R: ["Results", "3. Findings"],
    "results_discussion": ["Results and Discussion", "Results & Discussion"],
    D: ["Discussion", "4. Discussion", "Interpretation"],
    "other": ["Acknowledgments", "References", "Supplementary Materials", "Patient preferences", "", None],
}


def value(spark, column, **row):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first().v


def paragraphs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, position int, section_title string, section_level int, text string")


def article(spark, n=1):
    return paragraphs(spark, [(d, p, t, 0, f"{t} text number {p} stands here. More of it.") for d in range(n) for p, t in enumerate(["Introduction", "Methods", "Results", "Discussion"])])


def test_titles(spark):
    rows = [(t, name) for name, ts in TITLES.items() for t in ts]
    got = spark.createDataFrame(rows, "t string, name string").select("name", sections.label(F.col("t")).alias("label")).collect()
    assert all(r.name == r.label for r in got)


def test_conditions(spark):
    counts = {r.condition: r["count"] for r in sections.conditions(article(spark), 1).groupBy("condition").count().collect()}
    assert counts == {"intro": 1, "partial": 3, "fulltext": 4}
    two = paragraphs(spark, [(1, 0, "Methods", 0, "a"), (1, 1, "Results", 0, "b")])
    rows = sections.conditions(two).collect()
    assert {r.condition for r in rows} == {"partial"} and sorted(r.position for r in rows) == [0, 1]


def test_windows(spark):
    for text, most, overlap, expected in [("", 4, 1, []), ("  \n ", 4, 1, []), ("a b c d e f g", 4, 1, ["a b c d", "d e f g"]), ("a b c d e", 4, 9, ["a b c d", "d e"]), ("a b", 4, 0, ["a b"])]:
        assert value(spark, T.windows(T.words(F.col("t")), most, overlap), t=text) == expected
    assert value(spark, T.words(F.col("t")), t=None) == []
    assert value(spark, T.words(F.col("t")), t="a\xa0b c\x1cd") == ["a", "b", "c", "d"]


def test_sentences(spark):
    assert value(spark, T.sentences(F.col("t")), t="One here. Two! three? Four.\n\n Éa. b") == ["One here.", "Two! three?", "Four.\n\n Éa. b"]
    assert value(spark, T.sentences(F.col("t")), t=None) == []


def test_phrases_and_answers(spark):
    assert value(spark, T.key_phrase(F.col("t"), 3), t="  The Big cat sat. No") == "the Big cat"
    assert value(spark, T.key_phrase(F.col("t")), t=". x") == ""
    for answer, expected in [("Yes, it is", "yes"), ("no.", "no"), ("MAYBE; so", "maybe"), ("nothing", "unknown"), ("", "unknown")]:
        assert value(spark, T.decision(F.col("t")), t=answer) == expected
    assert value(spark, T.user_prompt(F.lit("Q?"), F.col("c")), c=["a", "b"]) == "Context:\n[1] a\n[2] b\n\nQuestion: Q?"
    for a, b, expected in [("the cat the", "the the dog", 2 / 3), ("", "x", 0.0), ("a", "b", 0.0), ("A b", "a B", 1.0)]:
        assert math.isclose(value(spark, T.token_f1(F.col("a"), F.col("b")), a=a, b=b), expected)
    assert value(spark, T.jaccard(F.lit("a b b"), F.lit("b c"))  , t="") == pytest.approx(1 / 3)


def merged(groups, least):
    acc = []
    for g in groups:
        if acc and len(acc[-1].split()) < least:
            acc[-1] += " " + g
        else:
            acc.append(g)
    if len(acc) >= 2 and len(acc[-1].split()) < least:
        acc[-2:] = [acc[-2] + " " + acc[-1]]
    return acc


def test_merged_groups():
    rng = random.Random(1)
    cases = [[10, 20, 30, 60, 5, 70, 8], [], [1]] + [[rng.randint(1, 60) for _ in range(rng.randint(1, 9))] for _ in range(200)]
    for case in cases:
        begin = chunking.merged_groups(case, 50)
        got = [" ".join(" ".join(["w"] * n) for n in case[a:b]) for a, b in zip(begin, [*begin[1:], len(case)])]
        assert got == merged([" ".join(["w"] * n) for n in case], 50)


def test_semantic_covers_the_text(spark):
    docs = spark.createDataFrame([(1, "One sentence here. Two more words there. " * 40), (2, "single"), (3, "")], "doc_id long, text string")
    rows = chunking.semantic(docs, embedding.HashingEmbedder(32), 0.75, 64).orderBy("doc_id", "position").collect()
    words = {d: " ".join(r.text for r in rows if r.doc_id == d).split() for d in (1, 2, 3)}
    assert words[1] == docs.first().text.split() and words[2] == ["single"] and words[3] == []
    assert all(len(r.text.split()) <= 64 for r in rows)


def slow_token_vectors(text, encoder, most, overlap):
    """Window by window and token by token."""
    tokens = [text[a:b] for a, b in encoder.tokenize(text)]
    step = most - overlap if most > overlap else max(1, most // 2)
    sums, weights, start = [np.zeros(encoder.dim) for _ in tokens], [0.0] * len(tokens), 0
    while start < len(tokens):
        own = tokens[start : start + most]
        for i, v in enumerate(encoder.encode_window(own)):
            w = 1.0 if len(own) <= 1 else 1 - abs(i - len(own) / 2 + 0.5) / (len(own) / 2)
            sums[start + i] += w * v
            weights[start + i] += w
        if start + most >= len(tokens):
            break
        start += step
    return np.array([x / max(w, 1e-12) for x, w in zip(sums, weights)])


def test_token_vectors_blend_windows():
    e = embedding.HashingTokenEncoder(16)
    text = " ".join(f"w{i}" for i in range(50))
    for most, overlap in ((64, 16), (20, 8), (7, 7), (5, 9), (1, 0)):
        got, starts = chunking.token_vectors(text, e, most, overlap)
        assert np.allclose(got, slow_token_vectors(text, e, most, overlap), atol=1e-6) and starts[1] == 3
    assert chunking.window_bounds(10, 4, 9) == [(0, 4), (2, 6), (4, 8), (6, 10)]
    assert np.allclose(chunking.triangular(4), [0.25, 0.75, 0.75, 0.25]) and chunking.triangular(1) == 1


def test_late_spans():
    e = embedding.HashingTokenEncoder(8)
    text = " ".join(f"w{i}" for i in range(600))
    spans = [(a, b) for a, b, _, _ in chunking.late_chunks(text, e)]
    assert spans == [(0, 256), (256, 512), (512, 600)]
    assert [(a, b, t) for a, b, t, _ in chunking.late_chunks("a b c d", e, [9, 2, 0])] == [(0, 2, "a b"), (2, 4, "c d")]
    assert chunking.late_chunks("  ", e) == []


def slow_scores(paras, vectors, starts, entities, window):
    n, half = len(starts), max(1, window // 2)
    out = []
    for g in range(n - 1):
        a, b = vectors[max(0, g - half + 1) : g + 1].mean(axis=0), vectors[g + 1 : min(n, g + 1 + half)].mean(axis=0)
        x, y = np.linalg.norm(a), np.linalg.norm(b)
        out.append(0.3 * (1 - (a @ b / (x * y) if x > 1e-12 and y > 1e-12 else 0)))
    at = 0
    level = [0.0] * (n - 1)
    for i, (t, title, depth) in enumerate(paras):
        if i:
            tok = max(k for k, s in enumerate(starts) if s <= at)
            g = min(max(0, tok - 1), n - 2)
            level[g] = max(level[g], 0.4 if title == paras[i - 1][1] else 1.0 if depth == 0 else 0.7)
        at += len(t) + 2
    for g, x in enumerate(level):
        out[g] += 0.5 * x
    penalised = {g for s, e in entities for g in range(max(k for k, v in enumerate(starts) if v <= s), min(max(k for k, v in enumerate(starts) if v <= e), n - 1))}
    return np.array([x - 0.5 * (g in penalised) for g, x in enumerate(out)])


def test_boundary_scores():
    rng = np.random.default_rng(2)
    paras = [("one two three four", "A", 0), ("five six", "A", 0), ("seven eight nine", "B", 0), ("ten", "B.1", 1)]
    starts = embedding.HashingTokenEncoder().tokenize("\n\n".join(p[0] for p in paras))
    starts = [s for s, _ in starts]
    vectors = rng.normal(size=(len(starts), 5))
    for window in (64, 4, 1):
        got = chunking.boundary_scores(paras, vectors, starts, [(4, 13)], window=window)
        assert np.allclose(got, slow_scores(paras, vectors, starts, [(4, 13)], window))


def test_peaks_and_cuts():
    x = np.array([0, 1, 0, 2, 2, 0, 3, 0, 0.5, 0.4, 9])
    assert chunking.peaks(x, 0.6, 1).tolist() == [1, 3, 6]
    assert chunking.peaks(x, 0.6, 3).tolist() == [3, 6] and chunking.peaks(x, 0.6, 4).tolist() == [1, 6]
    assert chunking.peaks(np.array([3.0, 1.0]), 0, 1).tolist() == []
    assert chunking.selected_boundaries(np.zeros(9), 0.3, 2, 4, 10) == [4, 8]
    assert chunking.selected_boundaries(x, 0.6, 1, 4, 11) == [1, 3, 6, 10]


def test_structure_chunks(spark):
    df = paragraphs(spark, [(1, p, "A" if p < 6 else "B", 0, f"p{p} " * 30) for p in range(12)] + [(2, 0, "A", 0, " ")])
    rows = chunking.structure_aware(df, embedding.HashingTokenEncoder(16), None, 40, 120, 0.3).orderBy("position").collect()
    assert {r.doc_id for r in rows} == {1} and [r.token_start for r in rows][0] == 0 and rows[-1].token_end == 360
    assert all(a.token_end == b.token_start for a, b in zip(rows, rows[1:])) and all(r.token_end - r.token_start <= 120 for r in rows)
    assert {r.section_title for r in rows} == {"A", "B"}


def slow_structure(paras, encoder, least, most, threshold):
    """Spans, sections and texts, with means and overlaps worked out one by one."""
    text = "\n\n".join(p[0] for p in paras)
    if not text.strip():
        return []
    starts = [a for a, _ in encoder.tokenize(text)]
    vectors = slow_token_vectors(text, encoder, most, least)
    scores = slow_scores(paras, vectors, starts, [], 64)
    cuts = chunking.selected_boundaries(np.round(scores, 6), threshold, least, most, len(starts))
    bounds, out = [0, *(c for c in cuts if 0 < c < len(starts)), len(starts)], []
    owner, at = {}, 0
    for body, title, _ in paras:
        owner |= dict.fromkeys(range(at, at + len(body)), title)
        at += len(body) + 2
    for a, b in zip(bounds, bounds[1:]):
        end = starts[b] if b < len(starts) else len(text)
        titles = [owner[i] for i in range(starts[a], end) if i in owner]
        first = list(dict.fromkeys(titles))
        out.append((a, b, max(first, key=titles.count) if first else "", text[starts[a] : end].strip()))
    return out


def test_structure_query_equals_slow_version(spark, monkeypatch):
    from sectionlens.plans import queries

    rounded = chunking.boundary_scores
    monkeypatch.setattr(chunking, "boundary_scores", lambda *a, **k: np.round(rounded(*a, **k), 6))
    small = "/root/testdata/sf0.001"
    rows = queries.paragraphs(spark, small).where("doc_id % 4 = 0").collect()
    encoder = embedding.HashingTokenEncoder(32)
    got = {}
    of_doc = {d: sorted((r for r in rows if r.doc_id == d), key=lambda r: r.position) for d in {r.doc_id for r in rows}}
    for d, own in of_doc.items():
        paras = [(r.text, r.section_title, 0) for r in own]
        if sum(len(p[0]) for p in paras) < 12_000:
            got[d] = [(a, b, title, t) for a, b, t, title, _ in chunking.structure_aware_chunks(paras, encoder, (), 64, 256, 0.3)]
            assert got[d] == slow_structure(paras, encoder, 64, 256, 0.3)
    monkeypatch.undo()
    found = chunking.structure_aware(queries.paragraphs(spark, small), encoder, None, 64, 256, 0.3).where("doc_id % 4 = 0").collect()
    for d, own in got.items():
        mine = sorted((r.position, r.token_start, r.token_end, r.section_title, r.text) for r in found if r.doc_id == d)
        assert len(mine) > 0 or not own
        assert mine[0][1] == 0 and mine[-1][2] == own[-1][1] if own else True


EXTREME = [2**63 - 1, -(2**63), None, 9007199254740993, 9007199254740993, 5, 5]


def test_chunkers_keep_ids_of_any_kind(spark):
    encoder, embedder = embedding.HashingTokenEncoder(8), embedding.HashingEmbedder(8)
    text = "One sentence is here. Another one follows it! " * 60
    tables = [
        spark.createDataFrame([(i, text, "clash") for i in EXTREME], "doc_id long, text string, position string"),
        spark.createDataFrame([("PMC77", text, "x"), (None, text, "y"), ("é日", None, "z")], "doc_id string, text string, position string"),
    ]
    for docs in tables:
        ids = sorted(str(r.doc_id) for r in docs.where("text is not null").collect())
        for rows in (chunking.naive(docs), chunking.semantic(docs, embedder), chunking.late(docs, encoder)):
            assert rows.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
            assert sorted(str(r.doc_id) for r in rows.where("position = 0").collect()) == ids
        paras = docs.select("doc_id", F.lit(0).alias("position"), "text", F.lit("A").alias("section_title"), F.lit(0).alias("section_level"))
        found = {str(r.doc_id) for r in chunking.structure_aware(paras, encoder, None, 64, 256).collect()}
        assert found == {str(r.doc_id) for r in docs.where("doc_id is not null and text is not null").collect()}
        terms = spark.createDataFrame([("sentence is", "D1"), ("another", "D2"), ("sentence", "D3")], "term string, concept_id string")
        for most in (100, 0):
            linked = entities.mentions(docs, terms, most=most).collect()
            assert sorted(str(r.doc_id) for r in linked if r.concept_id == "D1") == sorted(ids * 60) and not any(r.concept_id == "D3" for r in linked)
        empty = docs.limit(0)
        assert chunking.late(empty, encoder).count() == chunking.semantic(empty, embedder).count() == entities.mentions(empty, terms).count() == 0


def test_joined_mentions_equal_the_linker(spark):
    rng = random.Random(3)
    words = ["heart", "Heart", "failure", "T", "cells", "x", "covid-19", "ab", "l'été", "naïve"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ", ", "-", ""]) for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], "doc_id long, text string")
    terms = spark.createDataFrame([("heart failure", "1"), ("heart", "2"), ("t cells", "3"), ("covid-19", "4"), ("failure t", "5"), ("ab", "6"), ("naïve", "7"), ("cells x", "8")], "term string, concept_id string")
    a, b = (sorted(tuple(r) for r in entities.mentions(docs, terms, most=m).collect()) for m in (100, 0))
    assert a == b and len(a) > 100
    with pytest.raises(ValueError):
        entities.mentions_by_join(docs, spark.createDataFrame([("-x-y", "9")], "term string, concept_id string"))


def test_linker():
    linker = entities.Linker({"heart failure": "1", "heart": "2", "t cells": "3", "covid-19": "4", "ab": "5", "-x-y": "6"})
    text = "Heart failure, heart; t cellsx T Cells COVID-19 ab heart failures a-x-y"
    got = linker.find(text)
    assert [(t, i) for t, _, _, i in got] == [("Heart failure", "1"), ("heart", "2"), ("T Cells", "3"), ("COVID-19", "4"), ("heart", "2"), ("-x-y", "6")]
    assert all(text[a:b] == t for t, a, b, _ in got) and linker.find(None) == []


def test_projection():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, 6))
    out = entities.project(x, 4)
    gram = lambda m: (m - m.mean(0)) @ (m - m.mean(0)).T
    assert np.allclose(gram(entities.project(x, 5)) .trace(), gram(x).trace(), rtol=0.2) and out.shape == (9, 4)
    assert entities.project(x[:2], 4).shape == (2, 4) and np.allclose(entities.project(x[:2], 4)[:, 2:], 0)
    assert np.array_equal(entities.project(x, 8), x)
    tokens = np.zeros((4, 3))
    moved = chunking.infuse_tokens(tokens, [(1, 9, "a"), (0, 1, "wide"), (0, 1, "none")], {"a": np.ones(3), "wide": np.ones(5)})
    assert np.allclose(moved, [[0] * 3, [0.1] * 3, [0.1] * 3, [0.1] * 3])


def test_projection_of_a_table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12)) * np.arange(1, 13)
    df = spark.createDataFrame([(f"n{i:03d}", v.tolist()) for i, v in enumerate(x)], "name string, vec array<double>").repartition(5)
    got = np.array([r.vec for r in entities.project_table(df, 5).orderBy("name").collect()])
    assert np.allclose(got, entities.project(x, 5), atol=1e-8)
    few = np.array([r.vec for r in entities.project_table(df.where("name < 'n002'"), 5).orderBy("name").collect()])
    assert few.shape == (2, 5) and np.allclose(few[:, 2:], 0) and np.allclose(np.abs(few[:, 0]), np.abs(entities.project(x[:2], 5)[:, 0]))
    assert entities.project_table(df, 12).count() == 300 and entities.project_table(df.limit(0), 3).count() == 0


def test_entity_encoder_and_its_cache(spark):
    class Counting:
        dim = 4

        def encode(self, texts):
            assert "b" not in texts
            return np.full((len(texts), 4), 0.5)

    names = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "name string")
    cached = spark.createDataFrame([("b", [9.0] * 4), ("z", [1.0] * 4)], "name string, vec array<double>")
    assert {r.name: r.vec for r in entities.encode_entities(names, Counting(), cached).collect()} == {"a": [0.5] * 4, "b": [9.0] * 4}
    v = embedding.HashingEntityEncoder(64).encode(["Diabetes", "diabetes type", "lung", ""])
    assert v[0] @ v[1] > 0.5 > v[0] @ v[2] and np.allclose(np.linalg.norm(v[:3], axis=1), 1)


def test_embedding_keeps_what_is_there(spark):
    class Counting:
        dim = 2

        def encode(self, texts):
            assert None not in texts and "old" not in texts
            return np.ones((len(texts), 2))

    df = spark.createDataFrame([("old", [5.0, 6.0], 1), ("new", None, 2)], "text string, embedding array<float>, n int")
    rows = embedding.embed(df, Counting()).orderBy("n").collect()
    assert [r.embedding for r in rows] == [[5.0, 6.0], [1.0, 1.0]] and [r.text for r in rows] == ["old", "new"]


def test_auto_boundaries_move_to_marks():
    text = "".join(c for c in "a" * 500)
    starts = list(range(500))
    plain = chunking.auto_boundaries(starts, text, 100, 20)
    assert plain == [100, 200, 300, 400]
    marked = text[:89] + ". " + text[91:209] + "!\n" + text[211:330] + ". " + text[332:]
    # a token that starts right after a mark, at its white space, draws the cut; the nearest, then the earliest
    assert chunking.auto_boundaries(starts, marked, 100, 20) == [90, 190, 290, 390, 490]
    assert chunking.auto_boundaries(starts, marked, 100, 21) == [90, 210, 310, 410]  # 331 is the first place out of reach
    twice = text[:94] + ". " + text[96:104] + ". " + text[106:]
    assert chunking.auto_boundaries(starts, twice, 100, 20)[0] == 95


def test_token_infusion(spark):
    paras = paragraphs(spark, [(1, 0, "A", 0, "heart failure is here"), (2, 0, "A", 0, "nothing")])
    found = entities.mentions(paras.select("doc_id", "text"), spark.createDataFrame([("heart failure", "D1")], "term string, concept_id string"))
    encoder = embedding.HashingTokenEncoder(4)
    plain, moved = (chunking.structure_aware(paras, encoder, found, infused=v).orderBy("doc_id").collect() for v in (None, {"heart failure": [10.0, 0, 0, 0], "wide": [1.0]}))
    assert np.allclose(np.array(moved[0].embedding) - plain[0].embedding, [0.5, 0, 0, 0], atol=1e-6) and moved[1].embedding == plain[1].embedding


def test_cache_tables(spark):
    old = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "name string, vec array<double>")
    new = spark.createDataFrame([("b", [3.0]), ("c", [4.0])], "name string, vec array<double>")
    assert {r.name: r.vec[0] for r in entities.upsert(old, new).collect()} == {"a": 1, "b": 3, "c": 4}
    assert [r.name for r in entities.missing(new, old).collect()] == ["c"]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "INDEX_BLOCK", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(70, 6)), np.zeros((1, 6))])
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "chunk_idx long, embedding array<double>")
    queries = index.where("chunk_idx % 10 = 0").withColumnRenamed("chunk_idx", "query_id")
    got = retrieval.top_k(queries, index, 5).orderBy("query_id", "rank").collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    for q in range(0, 71, 10):
        expected = sorted(range(71), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:5]
        assert [r.chunk_idx for r in got if r.query_id == q] == expected
    keyed = index.select(F.struct(F.concat(F.lit("d"), (F.col("chunk_idx") % 3).cast("string")).alias("doc"), F.col("chunk_idx").alias("at")).alias("chunk_idx"), "embedding")
    named = retrieval.top_k(queries.withColumn("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string"))), keyed, 5).orderBy("query_id", "rank").collect()
    assert [r.chunk_idx.at for r in named if r.query_id == "q10"] == [r.chunk_idx for r in got if r.query_id == 10]
    plan = retrieval.top_k(queries, index, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan
    assert retrieval.top_k(queries.limit(0), index, 5).count() == 0 and retrieval.top_k(queries, index.limit(0), 5).count() == 0


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 10, 0.5, 1)], "query_id long, chunk_idx long, score double, rank int")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])], "name string, vec array<double>")
    of_query = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z"), (1, "?")], "query_id long, name string")
    of_chunk = spark.createDataFrame([(11, "a"), (11, "b"), (10, "b")], "chunk_idx long, name string")
    lib = {(r.query_id, r.chunk_idx): (r.score, r["rank"]) for r in retrieval.rerank(hits, of_query, of_chunk, vec, 5).collect()}
    assert lib == {(1, 10): (pytest.approx(0.63), 2), (1, 11): (pytest.approx(0.71), 1), (2, 10): (0.5, 1)}
    script = {(r.query_id, r.chunk_idx): r.score for r in retrieval.rerank(hits, of_query, of_chunk, vec, 5, variant="script").collect()}
    assert script == {(1, 10): pytest.approx(0.63), (1, 11): pytest.approx(0.56 + 0.3 * 2 / 3), (2, 10): pytest.approx(0.35)}
    same = retrieval.rerank(hits, of_query, of_chunk, vec, 5, beta=1.0).collect()
    assert {(r.query_id, r.chunk_idx): r["rank"] for r in same} == {(1, 10): 1, (1, 11): 2, (2, 10): 1}


def test_structure_metrics(spark):
    def mean(column, rows):
        return spark.createDataFrame(rows, "sections array<string>, required array<string>").agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("v")).first().v

    assert mean(metrics.all_required_at(None), [([M, R, M], [M, R])]) == 1.0
    assert mean(metrics.all_required_at(None), [([M, M, M], [M, R])]) == 0.0
    assert mean(metrics.all_required_at(None), [([M, R], [M, R]), ([M, M], [M, D])]) == 0.5
    assert mean(metrics.all_required_at(None), [([M, R], [])]) == 0.0
    assert mean(metrics.coverage_at(3), [([M, M, R, I, D], [])]) == 2.0 and mean(metrics.coverage_at(5), [([M, M, R, I, D], [])]) == 4.0
    assert mean(metrics.coverage_at(5), []) == 0.0


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 7, "a"), (1, 2, 8, "b"), (1, 3, 8, None), (2, 1, 5, "a")], "query_id long, rank int, doc_id long, section_title string")
    questions = spark.createDataFrame([(1, [8], ["a"]), (2, [6], []), (3, [], ["a"])], "query_id long, gold array<long>, required array<string>")
    row = metrics.evaluate(metrics.per_query(hits, questions)).first()
    assert (row.n_questions, row.n_found) == (3, 1) and row.MRR == pytest.approx(0.5 / 3) and row.recall_1 == 0 and row.recall_3 == pytest.approx(1 / 3)
    assert row.ndcg_10 == pytest.approx((1 / math.log2(3) + 0.5) / 3)  # over 1 for the first: two hits of one gold
    assert row.section_coverage_5 == pytest.approx((3 + 1 + 0) / 3) and row.cross_section_recall_5 == pytest.approx(1 / 3)
    empty = metrics.evaluate(metrics.per_query(hits.limit(0), questions.limit(0))).first()
    assert empty.MRR == 0 and empty.n_questions == 0


def test_bootstrap():
    same = [0.5, 1, 0, 0.25, 1]
    assert significance.paired_bootstrap(same, same, 1000)[1] > 0.3
    rng = np.random.RandomState(42)
    a, b = rng.normal(0.5, 0.05, 200), rng.normal(0.8, 0.05, 200)
    got = significance.paired_bootstrap(a, b, 5000)
    assert got[1] < 0.05 and got[2] < got[0] < got[3]
    rng, diffs = np.random.RandomState(42), []
    for _ in range(5000):
        at = rng.randint(0, 200, size=200)
        diffs.append(a[at].mean() - b[at].mean())
    low, high = np.percentile(diffs, [2.5, 97.5])
    assert got[2:] == (pytest.approx(low), pytest.approx(high))


def test_holm(spark):
    ps = [0.01, 0.04, 0.03, 0.20]
    assert significance.holm_values(ps) == pytest.approx([0.04, 0.09, 0.09, 0.20])
    rows = spark.createDataFrame([("x", f"c{i}", p) for i, p in enumerate(ps)], "condition string, competitor string, p_value double")
    got = {r.competitor: r.adjusted_p_value for r in significance.holm(rows, "condition").collect()}
    assert [got[f"c{i}"] for i in range(4)] == pytest.approx([0.04, 0.09, 0.09, 0.20])


def test_significance_skips_unequal(spark):
    rows = [("full", s, q, float((q + k) % 3)) for k, s in enumerate(["graph", "b", "c"]) for q in range(12) if not (s == "c" and q == 3)]
    got = significance.significance(spark.createDataFrame(rows, "condition string, strategy string, query_id long, rr double"), "graph", 200).collect()
    assert [r.competitor for r in got] == ["b"] and got[0].adjusted_p_value == got[0].p_value


def test_template_questions(spark):
    rows = qa.template_questions(article(spark)).collect()
    assert len(rows) == 5 and all(len(r.required_sections) >= 2 for r in rows)
    first = next(r for r in rows if r.template_type == "method_result")
    assert first.question == "What was the outcome when methods text number 1 stands here was applied, as reported in the results?" and first.gold_paragraph_ids == [1, 2]
    assert qa.template_questions(article(spark, 2), 2).groupBy("article_id").count().collect()[0]["count"] == 2


def test_llm_questions(spark):
    answers = spark.createDataFrame(
        [(0, '```json\n[{"question": "A?", "required_sections": ["Methods", "methods", "other"]}, {"question": "B?", "required_sections": ["other", "results"]}]\n```'), (1, "not json"), (2, '{"question": 1}')],
        "doc_id long, answer string",
    )
    rows = qa.llm_questions(answers, article(spark, 3)).collect()
    assert [(r.question, r.required_sections, r.gold_paragraph_ids, r.source) for r in rows] == [("A?", [M, M], [1, 1], "llm")]
    rows = paragraphs(spark, [(1, 0, "A", 0, "x" * 600), (1, 1, "A", 0, "y"), (1, 2, "B", 0, "z" * 500)])
    assert qa.article_prompt(rows).first().prompt == "Title: \nAbstract: \n\nSections:\n\n## A\n" + "x" * 497 + "...\ny\n\n## B\n" + "z" * 500
    about = spark.createDataFrame([(1, "On x", "It is short.")], "doc_id long, title string, abstract string")
    assert qa.article_prompt(rows, about).first().prompt.startswith("Title: On x\nAbstract: It is short.\n\nSections:\n\n## A\n")


def test_retries():
    calls = []

    def flaky(_):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert qa.with_retries(flaky, wait=0)("p") == "ok"
    with pytest.raises(RuntimeError):
        qa.with_retries(lambda _: (_ for _ in ()).throw(ConnectionError()), wait=0)("p")


def test_generation(spark):
    row = qa.generate(spark.createDataFrame([("Context:\n[1] Yes, so it is\n[2] b\n\nQuestion: q",)], "prompt string")).first()
    assert (row.full_answer, row.decision, row.usage_tokens) == ("Yes, so it is", "yes", 14)

    def fails(prompt):
        if "bad" in prompt:
            raise ValueError(prompt)
        return "yes, it is so"

    rows = spark.createDataFrame([("good", "yes", "yes it is"), ("bad", "yes", "x"), ("good too", None, None)], "prompt string, label string, long_answer string")
    scores = qa.answer_scores(qa.generate(rows, fails)).first()
    assert scores.accuracy == pytest.approx(1 / 3) and scores.avg_f1 == pytest.approx(4 / 7 / 3) and scores.n_questions == 3  # "yes," is a word of its own


def test_relevance_by_likeness(spark):
    hits = spark.createDataFrame([(1, 1, "x y z", 0.1), (1, 2, "a b c d", 0.2), (2, 1, "q r", 0.6)], "query_id long, rank int, text string, score double")
    asked = spark.createDataFrame([(1, "a", "a b c e"), (2, "nothing", "else"), (3, "no hits", "")], "query_id long, question string, context string")
    row = metrics.jaccard_relevance(hits, asked).first()
    assert (row.mrr, row.recall_1, row.recall_3) == (pytest.approx(0.5 / 3), 0, pytest.approx(1 / 3))
    row = metrics.hybrid_relevance(hits, asked, "s").first()
    assert (row.strategy, row.MRR, row.recall_5, row.n_questions, row.n_found) == ("s", 0.5, 0, 3, 2)
    assert metrics.hybrid_relevance(hits, asked, "s", faithful=False).first().recall_1 == pytest.approx(1 / 3, abs=1e-4)


def test_question_filters(spark):
    paras = spark.createDataFrame([("77__intro", 0)], "doc_id string, position int")
    asked = spark.createDataFrame([(1, ["77"]), (2, ["8"]), (3, ["77__fulltext", "8"])], "query_id long, gold array<string>")
    assert evaluation.known_questions(asked, paras).count() == 0
    assert sorted(r.query_id for r in evaluation.known_questions(asked, paras, short=True).collect()) == [1, 3]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.l2_normalise(F.col("a")).alias("u"), V.cosine(F.col("a"), F.col("b")).alias("z"), V.l2_normalise(F.col("b")).alias("w")).first()
    assert r.u == [0.6, 0.8] and r.z == 0 and r.w == [0, 0]


@pytest.mark.parametrize("strategy", evaluation.STRATEGIES, ids=lambda s: s.name)
def test_strategies_end_to_end(spark, strategy):
    words = [f"k{i}" for i in range(40)]
    paras = paragraphs(spark, [(d, p, t, 0, " ".join(words[(7 * d + 3 * p + i) % 40] for i in range(30)) + f" topic{d} .") for d in range(6) for p, t in enumerate(["Introduction", "Methods", "Results", "Discussion"])])
    questions = spark.createDataFrame([(d, f"topic{d} {words[7 * d % 40]} topic{d}", [str(d)], [I]) for d in range(6)] + [(9, "gone", ["77"], [])], "query_id long, question string, gold array<string>, required array<string>")
    terms = spark.createDataFrame([(f"topic{d}", f"D{d}") for d in range(6)], "term string, concept_id string")
    row = evaluation.evaluate(paras, questions, strategy, embedding.HashingEmbedder(256), embedding.HashingTokenEncoder(256), terms).first()
    assert row.strategy == strategy.name and row.n_questions == 6 and row.n_found == 6 and row.MRR > 0.2
    named = paras.withColumn("doc_id", F.concat(F.lit("PMC"), "doc_id"))
    gold = questions.withColumn("gold", F.transform("gold", lambda x: F.concat(F.lit("PMC"), x)))
    again = evaluation.evaluate(named, gold, strategy, embedding.HashingEmbedder(256), embedding.HashingTokenEncoder(256), terms).first()
    assert again == row
    made = evaluation.generation(named, gold, strategy, embedding.HashingEmbedder(256), embedding.HashingTokenEncoder(256), terms=terms).first()
    assert made.n_questions == 6 and 0 < made.avg_f1 <= 1 and made.avg_section_diversity >= 1 and made.total_tokens > 0


def test_bootstrap_query_draws_as_many_as_the_reference(monkeypatch):
    from inspect import signature

    from sectionlens.plans import queries

    seen = []
    form = signature(significance.significance)

    def record(*args, **named):
        bound = form.bind(*args, **named)
        bound.apply_defaults()
        seen.append(bound.arguments["n_bootstrap"])

    monkeypatch.setattr(queries.significance, "significance", record)
    monkeypatch.setattr(queries.significance, "rounded", lambda tests: tests)
    monkeypatch.setattr(queries, "strategy_rr", lambda spark, sf_dir: None)
    queries.bootstrap_significance(None, "")
    assert seen == [10_000]


def test_white_space_is_that_of_python(spark):
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}" for c in every)
    row = spark.createDataFrame([(text,)], "t string").select(T.words(F.col("t")).alias("w"), T.word_count(F.col("t")).alias("n")).first()
    assert row.w == text.split() and row.n == len(text.split())
    ends = spark.createDataFrame([(f"{c}b{c}",) for c in every if c.isspace()], "t string")
    assert {r.s for r in ends.select(T.strip(F.col("t")).alias("s")).collect()} == {"b"}


def test_words_of_prompts_are_counted_where_they_are_answered(spark):
    spaces = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    texts = [f"a{c}b{c}{c}" for c in [*spaces, "\u200b", "\u180e", "\ufeff"]] + ["", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, prompt string")
    answered = qa.generate(rows, lambda x: None if x == "" else "yes it is")
    assert "regexp_count" not in answered._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: r.usage_tokens for r in answered.collect()}
    count = {r.i: r.n for r in rows.select("i", T.word_count(F.col("prompt")).alias("n")).collect()}
    assert got == {i: 0 if t == "" else count[i] + 3 for i, t in enumerate(texts)}
