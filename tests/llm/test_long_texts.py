"""Every operator over a text of some MB."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sectionlens.llm import merge_dropout, merkle, ngram_join, packing, quality_rules, secret_scan, suffix_dedup, token_counts, token_files, toxicity
from sectionlens.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE

from . import odd
from .test_quality_rules import base
from .test_secret_scan import brute as spans
from .test_tokens import crc, encode

TEXT = odd.long_text()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, TEXT + " more"), (None, "short text")], "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_tokens(docs):
    texts = [TEXT, TEXT + " more"]
    words, pieces = encode(WORD_BPE, texts), encode(BYTE_BPE, texts)
    got = by_id(token_files.read_documents(token_files.write_token_files(docs, WORD_BPE)))
    assert [(got[k].n_tokens, got[k].ids_crc32) for k in (1, 2)] == [(len(x), crc(x)) for x in words]
    packed = packing.pack_documents(docs, BYTE_BPE, with_ids=True).collect()
    for k, own in zip((1, 2), pieces):
        assert [i for r in sorted((r for r in packed if r.doc_id == k), key=lambda r: r.start) for i in r.input_ids] == own
    assert {r.length for r in token_counts.length_histogram(docs, BYTE_BPE, 1).collect()} >= set(map(len, pieces))
    assert all(r.lossless for r in merge_dropout.encode_and_decode(docs, PIECE_BPE, 1, 0.1).collect())


def test_texts(docs):
    got = by_id(quality_rules.quality(docs))
    assert tuple(got[1])[1:6] == base(TEXT)
    joined = by_id(ngram_join.join(docs))
    assert (joined[1].class_id, joined[2].class_id, joined[1].n_links, joined[None].class_id) == (1, 1, 1, None)
    cut = by_id(suffix_dedup.dedup(docs))
    assert cut[2].n_removed == len(TEXT) and cut[2].kept_sha256 == hashlib.sha256(b" more").hexdigest()
    found = by_id(secret_scan.scan(docs))
    assert [found[1].n_assign, found[1].n_access, found[1].n_hex, found[1].base_sha256, found[1].spans] == spans(TEXT)
    prints = by_id(merkle.fingerprints(docs))
    half = len(TEXT) // 2
    edit = TEXT[: len(TEXT) - half] + "short text"[:half]
    assert prints[1].n_chars == len(TEXT) and prints[1].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
    assert 0.99 < prints[2].near_next < 1 and 0.5 < prints[1].near_edited < 0.8
    labels = docs.sparkSession.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels)).where(F.col("expected_severity").between(0, 2)).count() == 3


def test_sections_of_long_text(docs):
    tree = docs.where("doc_id = 1").select(merkle.tree(F.col("text"))["fingerprint"].alias("f")).first().f
    lengths = [sum(int(x) for x in re.findall("[0-9a-f]{8}([0-9]{3})", p)) for p in re.findall("=([0-9a-f]*)", tree)]
    assert lengths == [len(x) for x in TEXT.split("\n")]
