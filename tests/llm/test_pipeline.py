import re
from collections import defaultdict

import corpus_pipeline
from tests.conftest import SMALL

from . import odd
from .test_ngram_join import brute as groups
from .test_quality_rules import base
from .test_secret_scan import BASE
from .test_suffix_dedup import brute as cut
from .test_tokens import check_pieces, encode


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SMALL).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == 4 or frames[-1].columns == columns, name
    rows = [{r.doc_id: r for r in f.collect()} for f in frames[:5]]
    for before, after in zip(rows, rows[1:]):
        assert set(after) <= set(before)
        assert all((r.lang, r.source) == (before[d].lang, before[d].source) and r.n_chars == len(r.text) for d, r in after.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for d, r in rows[0].items():
        b = base(r.text)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        assert not (failed and d in rows[1]) and (failed or d not in labels or (d in rows[1]) == (labels[d] == 1))
    assert set(rows[2]) == {c for _, c, _, _ in groups([(d, r.text) for d, r in rows[1].items()])}
    left = {d: n - gone for d, n, gone, _, _ in cut(sorted((d, r.text) for d, r in rows[2].items()), 100)}
    for d, n in left.items():
        kept = len(rows[3][d].text.encode()) if d in rows[3] else 0
        assert n - 3 * 8 <= kept <= n or not rows[2][d].text.strip() or n < 20
    for d, r in rows[4].items():
        assert not any(ok(m) and "[SECRET]" not in m[0] for _, p, ok in BASE for m in re.finditer(p, r.text))
        if not any(ok(m) for _, p, ok in BASE for m in re.finditer(p, rows[3][d].text)) and "[SECRET]" not in r.text:
            assert r.text == rows[3][d].text
    ids = dict(zip(rows[4], encode(corpus_pipeline.BYTE_BPE, [r.text for r in rows[4].values()])))
    pieces = [(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in frames[5].collect()]
    assert check_pieces(pieces, {d: len(x) for d, x in ids.items()}, 2048) == 0
    whole = [(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SMALL).collect()]
    per_doc = defaultdict(int)
    for d, _, n in whole:
        per_doc[d] += n
    assert per_doc == {d: len(x) for d, x in ids.items()}


def test_stages_take_odd_rows_and_empty_tables(spark):
    long_text = " ".join(f"the w{i} a{i} of x{i * 7}" for i in range(60))
    for docs in (odd.documents(spark, [*odd.TEXTS, long_text, long_text]), odd.empty(spark)):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, SMALL)
            assert done.columns == docs.columns or name == "packing"
            done.collect()
            rows = stage(spark, rows, SMALL)
        assert len({r.doc_id for r in rows.collect()}) == (1 if docs.count() else 0)
