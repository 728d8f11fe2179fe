from sectionlens.operators import entities
from sectionlens.sources.seed_terms import SEED_TERMS, seed_terms


def test_seed_terms_link(spark):
    docs = spark.createDataFrame([(1, "Heart failure and heart; the p53 of T cells.")], "doc_id long, text string")
    got = entities.mentions(docs, seed_terms(spark)).orderBy("start").collect()
    assert [(r.text, r.concept_id) for r in got] == [(t, SEED_TERMS[t.lower()]) for t in ("Heart failure", "heart", "p53", "T cells")]
