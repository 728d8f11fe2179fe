import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor

from sectionlens.llm import merge_dropout as M
from sectionlens.llm._tokens import text_blocks
from tests.conftest import SMALL

from . import odd

MODEL = path("piece_bpe_32k.model")


def encode(coder, texts):
    out = []
    for _, _, data, starts in text_blocks(pa.array(texts), 5000):
        ids, counts = coder.encode(data, starts)
        at = np.append(0, np.cumsum(counts))
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


def texts():
    rng = random.Random(8)
    letters = list("theinon aer   \n\té日ﬁ😀.1")
    real = [r[0] for r in __import__("duckdb").sql(f"select text from '{SMALL}/documents.parquet' limit 60").fetchall()]
    return [x or "" for x in odd.TEXTS] + real + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(1500)]


def test_rate_0_equals_the_library():
    sp = SentencePieceProcessor(model_file=MODEL)
    ts = texts()
    assert encode(M.DropoutEncoder(MODEL, 0, 0.0, 0), ts) == sp.encode(ts)


def test_lockstep_equals_the_heap(monkeypatch):
    ts = texts()
    rows = encode(M.DropoutEncoder(MODEL, 5, 0.2, 1), ts)
    monkeypatch.setattr(M, "MOST_LOCKSTEP", 0)
    coder = M.DropoutEncoder(MODEL, 5, 0.2, 1)
    assert encode(coder, ts) == rows


def test_dropout_varies_and_decodes(spark):
    df = odd.documents(spark, [*odd.TEXTS, "a▁b ▁ c", *texts()[-200:]])
    source = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
    encoded = M.encode_documents(df, MODEL, seed=3, rate=0.3).cache()
    assert sorted(((r.doc_id, r.text) for r in M.decode_documents(encoded, MODEL).collect()), key=str) == source
    digest = M.encode_and_decode(df, MODEL, seed=3, rate=0.3).collect()
    assert all(r.lossless for r in digest) and len(digest) == len(source)
    ts = texts()[-300:]
    a, b, c = (encode(M.DropoutEncoder(MODEL, s, 0.3, v), ts) for s, v in ((1, 0), (1, 1), (1, 0)))
    assert a == c and sum(x != y for x, y in zip(a, b)) > 200
    plain = encode(M.DropoutEncoder(MODEL, 1, 0.0, 0), ts)
    assert sum(map(len, a)) > 1.05 * sum(map(len, plain))
    assert M.encode_and_decode(odd.empty(spark), MODEL).count() == 0


def test_all_dropped_leaves_single_characters():
    got = encode(M.DropoutEncoder(MODEL, 1, 1.0, 0), ["hello the"])[0]
    assert len(got) == len(" hello the")


def test_every_occurrence_draws_its_own(spark):
    text = " ".join(["reasonable"] * 40)
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    rows = {r.doc_id: r.ids for r in M.encode_documents(docs, MODEL, seed=3, rate=0.3).collect()}
    table, cuts = M.PieceTable.of(MODEL), {}
    for i, ids in rows.items():
        words, at = [[] for _ in range(40)], -1
        for x, n, start in zip(ids, table.lens[ids], table.starts[ids]):
            at += table.bytes[start : start + n].tobytes().startswith(b" ")
            words[at].append(x)
        cuts[i] = [tuple(w) for w in words]
    assert all(len(set(c)) > 8 for c in cuts.values())  # by occurrence
    assert len({tuple(c) for c in cuts.values()}) == 40 and len({c[0] for c in cuts.values()}) > 8  # by document


def test_kept_merges_change_no_draw(monkeypatch):
    ts = texts()
    for rate in (0.1, 0.5):
        rows = encode(M.DropoutEncoder(MODEL, 5, rate), ts)
        coder = M.DropoutEncoder(MODEL, 5, rate)
        skipped = coder._skipped
        # every word with a merge runs an agenda of its own
        with monkeypatch.context() as m:
            run = coder._run
            m.setattr(coder, "_run", lambda t, w, made=None: (m.setattr(coder, "_skipped", skipped), run(t, w, made), m.setattr(coder, "_skipped", lambda a, b: np.ones(len(a), bool)))[1])
            m.setattr(coder, "_skipped", lambda a, b: np.ones(len(a), bool))
            assert encode(coder, ts) == rows


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def plain_dropout(model, text, doc_id, seed, rate):
    """An encoder of its own: pieces from the library, one merge at a time, every pair looked at anew."""
    piece = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    key = int.from_bytes(hashlib.blake2b(f"{seed}:0".encode(), digest_size=8).digest(), "little")
    doc = 0 if doc_id is None else mixed((doc_id % 2**64) ^ ((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
    out = []
    for place, word in enumerate(re.findall(r" +[^ ]*", " " + text) if text else []):
        own = mixed(doc ^ mixed((place + key) % 2**64))
        symbols = [(("\u2581" if c == " " else None if c == "\u2581" else c), k, k + 1, c) for k, c in enumerate(word)]
        while True:
            best = None
            for k, (a, b) in enumerate(zip(symbols, symbols[1:])):
                if a[0] is None or b[0] is None or a[0] not in piece or b[0] not in piece or a[0] + b[0] not in piece:
                    continue
                if mixed(own ^ mixed(((a[1] << 42 ^ b[1] << 21 ^ b[2]) + key) % 2**64)) < int(rate * 2**64):
                    continue
                score = model.get_score(piece[a[0] + b[0]])
                if best is None or score > best[0]:
                    best = score, k
            if best is None:
                break
            k = best[1]
            symbols[k : k + 2] = [(symbols[k][0] + symbols[k + 1][0], symbols[k][1], symbols[k + 1][2], "")]
        for s, _, _, c in symbols:
            out += [piece[s]] if s in piece else [model.piece_to_id(f"<0x{x:02X}>") for x in c.encode()]
    return out


def test_dropout_equals_an_encoder_of_its_own(spark):
    model = SentencePieceProcessor(model_file=MODEL)
    rows = [*texts()[-120:], *(t[:400] for t in texts()[20:40]), "a▁b ▁ c", "x" * 100, "reasonable" * 30, "  two  spaces "]
    ids = [None, 2**63 - 1, -(2**63), *range(len(rows))]
    docs = spark.createDataFrame([(ids[k], t) for k, t in enumerate(rows)], "doc_id long, text string")
    for rate in (0.1, 0.5):
        got = [(r.doc_id, r.ids) for r in M.encode_documents(docs.coalesce(1), MODEL, seed=11, rate=rate).collect()]
        assert got == [(ids[k], plain_dropout(model, t, ids[k], 11, rate)) for k, t in enumerate(rows)]


def test_a_very_long_word_takes_little_time():
    rng = random.Random(1)
    word = "".join(rng.choice("etaoinshr") for _ in range(300_000))
    began = time.time()
    ids = encode(M.DropoutEncoder(MODEL, 1, 0.1), [word])[0]
    assert time.time() - began < 30 and 30_000 < len(ids) < 300_000
