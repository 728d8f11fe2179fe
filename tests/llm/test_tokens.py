import json
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sectionlens.llm import packing, token_counts, token_files
from sectionlens.llm._tokens import BlockEncoder, text_blocks
from sectionlens.llm.queries import BYTE_BPE, WORD_BPE
from tests.conftest import SMALL

from . import odd


def encode(name, texts):
    t = Tokenizer.from_file(name)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_blocks_equal_the_library(name):
    rng = random.Random(3)
    letters = list("ab1.,('s \n\t éÀ÷日　\x85 ̈TK≮")
    texts = odd.TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    parts = [*letters, "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "<|", "hello"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    coder, at = BlockEncoder(path(name)), 0
    expected = encode(path(name), texts)
    for i, j, data, starts in text_blocks(pa.array(texts), 2000):
        assert i == at
        at = j
        ids, lens = coder.encode(data, starts)
        assert lens.tolist() == [len(x) - 1 for x in expected[i:j]]
        assert ids.tolist() == [k for x in expected[i:j] for k in x[:-1]]
    assert at == len(texts)


def test_unknown_vocabularies_are_refused(tmp_path):
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        spec = json.loads(open(BYTE_BPE, encoding="utf-8").read()) | change
        (tmp_path / "other.json").write_text(json.dumps(spec))
        with pytest.raises(ValueError, match="aren't known"):
            BlockEncoder(str(tmp_path / "other.json"))


def test_token_files_read_back(spark, tmp_path):
    df = odd.documents(spark)
    manifest = token_files.write_token_files(df, WORD_BPE, f"file://{tmp_path}/out", seq_len=64)
    got = sorted(token_files.read_documents(manifest).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.h, r.text) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (doc_id, ids) in zip(got, zip([x[0] for x in rows], encode(WORD_BPE, [x[2] for x in rows])), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)
    for row in manifest.collect():
        file = token_files.TokenFile(row.file)
        real = 0
        for k in range(row.n_sequences):
            ids, mask = file.sequence(k)
            assert len(ids) == len(mask) == 64 and ids.dtype == np.uint16
            real += mask.true_count
        assert real == row.n_ids
    assert token_files.read_documents(token_files.write_token_files(odd.empty(spark), WORD_BPE)).count() == 0


def test_rows_without_ids_are_split(spark):
    df = spark.createDataFrame([(None, "one text for all")] * 2000, "doc_id long, text string").repartition(4)
    manifest = token_files.write_token_files(df, WORD_BPE).collect()
    assert sum(r.n_docs for r in manifest) == 2000 and max(r.n_docs for r in manifest) < 1000


def check_pieces(pieces, docs, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, n, seq, offset in pieces:
        assert n > 0
        by_doc[doc].append((start, n))
        by_seq[seq].append((offset, n))
    for doc, n in docs.items():
        at = 0
        for start, k in sorted(by_doc[doc]):
            assert start == at
            at += k
        assert at == n
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_pack_fills_sequences_and_balances():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.choice([rng.randint(1, 40), rng.randint(1, 3000)]) for _ in range(rng.randint(1, 120))]
        pieces = packing.pack(lengths, 256)
        assert check_pieces(pieces, dict(enumerate(lengths)), 256) == 0
    lengths = [rng.randint(20, 200) for _ in range(3000)]
    cost = defaultdict(float)
    for _, _, n, seq, _ in packing.pack(lengths, 2048):
        cost[seq] += n + n * n / 2048
    whole = sorted(cost.values())[12:]
    assert max(whole) / (sum(whole) / len(whole)) < 1.1
    assert packing.pack([]) == []


def test_pack_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = packing.pack_documents(docs, BYTE_BPE, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, encode(BYTE_BPE, texts.values())))
    assert check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], {k: len(v) for k, v in ids.items()}, 2048) == 0
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == crc(own[r.start : r.start + r.length])
        assert list(r.input_ids) == own[r.start : r.start + r.length]
    strange = odd.documents(spark).collect()
    of_id = defaultdict(list)
    for r, own in zip(strange, encode(BYTE_BPE, [r.text for r in strange])):
        of_id[r.doc_id].append(own)
    pieces = defaultdict(list)
    for r in packing.pack_documents(odd.documents(spark), BYTE_BPE, with_ids=True).collect():
        assert len(r.input_ids) == r.length and crc(r.input_ids) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.doc_tokens, list(r.input_ids)))
    assert set(pieces) == set(of_id)
    for doc_id, own in of_id.items():
        assert sorted(n for s, n, _ in pieces[doc_id] if s == 0) == sorted(map(len, own)) and sorted(k for _, _, x in pieces[doc_id] for k in x) == sorted(k for x in own for k in x)
        if len(own) == 1:
            assert [k for _, _, x in sorted(pieces[doc_id]) for k in x] == own[0]
    assert packing.pack_documents(odd.empty(spark), BYTE_BPE).count() == 0


def test_token_counts(spark):
    df = odd.documents(spark)
    lengths = sorted(map(len, encode(BYTE_BPE, [r.text for r in df.collect()])))
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(df, BYTE_BPE, end_tokens=1)).cache()
    rows = {r.length: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n) and r.total_docs == len(lengths) and r.total_tokens == sum(lengths)
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.docs_up_to == sum(x <= n for x in lengths) and abs(r.share_up_to - r.docs_up_to / len(lengths)) < 1e-12
    for limit in (1, 5, 100, 10**9):
        assert token_counts.truncated_total(sums, limit).first().tokens == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(sums, 0.5).first().length == lengths[(len(lengths) - 1) // 2]
    assert token_counts.with_suffix_sums(token_counts.length_histogram(odd.empty(spark), BYTE_BPE)).count() == 0


def test_pack_cuts_only_what_no_sequence_holds():
    rng = np.random.default_rng(4)
    for draw in (lambda: rng.lognormal(6, 1), lambda: rng.lognormal(6.5, 0.8), lambda: rng.uniform(1, 2047)):
        lengths = []
        while sum(lengths) < 500_000:
            lengths.append(max(1, int(draw())))
        left, cost = packing.room_for(sum(lengths), 2048), defaultdict(float)
        for doc, start, n, s, _ in packing.pack(lengths, 2048):
            want = lengths[doc] - start  # what was left of the document
            if n < 2048:
                fits = [k for k, x in enumerate(left) if x >= want]
                assert n == want if fits else n == max(left)
                assert not fits or s == min(fits, key=lambda k: (cost[k], k))
            left[s] -= n
            cost[s] += n + n * n / 2048
        assert not any(left)


def test_encoder_keeps_pieces_without_an_object_each(monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefgh", k=9)) for _ in range(20_000)})
    text = " ".join(words).encode()
    coder, sizes = BlockEncoder(BYTE_BPE), []
    real = coder.tokenizer

    class Library:
        def encode_batch(self, texts, **named):
            sizes.append(len(texts))
            return real.encode_batch(texts, **named)

    coder.tokenizer = Library()
    tracemalloc.start()
    try:
        coder.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert sum(sizes) >= len(words) and max(sizes) <= 4096  # all at once before
    assert held / sum(sizes) < 80  # ids and places alone; a dictionary of bytes took more
