"""The registered queries: contract columns of whole tables against plain reckoning."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from beatfold.llm import bpe, catalogue, language, media, toxicity

DATA = "/root/testdata/sf0.001"
LIBRARY = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
KINDS = ("assign", "access", "hex")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], (x or "" for x in t["text"]), strict=True))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def naive_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        found += [("assign", *m.span())] * (len(m[2]) >= 12)
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def test_op1(spark, texts):
    got = by_id(catalogue.QUERIES["op1_secrets"](spark, DATA))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base, r = naive_spans(t), got[i]
        n = Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(n[k] for k in KINDS)
        assert r.base_sha256 == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        assert [x for x in r.spans.split(",") if x and not x.startswith("grammar")] == [f"{k}:{s}:{e}" for k, s, e in base]


def naive_pairs(payload):
    """Peak pairs of a payload, peak by peak."""
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    power = [np.abs(np.fft.rfft(x[a : a + 576] * np.hanning(577)[:576])) ** 2 for a in range(0, len(x) - 575, 288)]
    best = [[(p[a:z].max(), a + int(p[a:z].argmax())) for a, z in itertools.pairwise(media.EDGES)] for p in power]
    peaks = [(t, f[b][1]) for t, f in enumerate(best) for b in range(len(f)) if (t == 0 or f[b][0] >= best[t - 1][b][0]) and (t + 1 == len(best) or f[b][0] > best[t + 1][b][0])]
    return sorted((t, (f << 20) | (g << 8) | (u - t)) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH)


def test_op3(spark, texts):
    got = by_id(catalogue.QUERIES["op3_media"](spark, DATA))
    assert got.keys() == texts.keys()
    for n, (i, t) in enumerate(texts.items()):
        data, r = t.encode(), got[i]
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        wav = media.to_wav(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), sha(wav)) and int(r.feature.split(":")[0]) == len(r.fingerprint)
        if n < 40:
            assert [tuple(x) for x in r.fingerprint] == naive_pairs(payload)


def test_op4(spark, texts):
    pieces: dict = {}
    sequences: dict = {}
    for r in catalogue.QUERIES["op4_packing"](spark, DATA).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids, at = [*library_ids(t), 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_op5(spark, texts):
    got = by_id(catalogue.QUERIES["op5_bpe"](spark, DATA))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library_ids(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert got[i].decoded_sha256 == sha(LIBRARY.decode(ids, skip_special_tokens=False))


def test_op7(spark, texts):
    got = by_id(catalogue.QUERIES["op7_language"](spark, DATA))
    truth = dict(zip(*pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "lang"]).to_pydict().values(), strict=True))
    assert got.keys() == texts.keys() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all((r.lang_pred == "und") == (not language.words_of(texts[i])) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out and truth[i] and language.words_of(texts[i])]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)


def test_op8(spark):
    t = pq.read_table(f"{DATA}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    v = {i: np.floor(256 * np.array(x, float)).astype(int) for i, x in zip(t["vec_id"], t["embedding"], strict=True)}
    want = {(q, rank + 1, i, s) for q in v if q % 50 == 0 for rank, (s, i) in enumerate(sorted(((int(v[q] @ x), i) for i, x in v.items() if i != q), key=lambda x: (-x[0], x[1]))[:5])}
    assert {tuple(r) for r in catalogue.QUERIES["op8_topk"](spark, DATA).select("query_id", "rank", "vec_id", "score").collect()} == want


def naive_logit(net, text):
    """A text's highest window logit, window by window and step by step."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    words, best = toxicity.words_of(text), -np.inf
    h = toxicity.HIDDEN
    for at in range(0, max(len(words) - toxicity.STRIDE, 1), toxicity.STRIDE):
        part = words[at : at + toxicity.WINDOW]
        x = net.embed(part)[0] if part else np.zeros((0, 1))
        states = {}
        for side, order in (("f", range(len(part))), ("b", reversed(range(len(part))))):
            s = np.zeros(h)
            for t in order:
                g, u = x[t] @ net.w[f"{side}W"] + net.w[f"{side}c"], s @ net.w[f"{side}U"]
                z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
                states[side, t] = s
        both = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(part))]).reshape(len(part), 2 * h)
        a = np.exp(both @ net.w["attend"])
        best = max(best, float((a / a.sum()) @ both @ net.w["out"] + net.w["bias"][0]) if part else float(net.w["bias"][0]))
    return best


def test_op9(spark, texts):
    got = by_id(catalogue.QUERIES["op9_toxicity"](spark, DATA))
    assert got.keys() == texts.keys() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_op9_score_by_steps():
    net = toxicity.Network(3)
    some = ["", "one", " ".join(f"word{i % 37}" for i in range(90)), "ein Satz mit wenigen Worten"]
    found = toxicity.Scorer(net).logits([toxicity.words_of(t) for t in some])
    assert found[1:] == pytest.approx([naive_logit(net, t) for t in some[1:]], abs=1e-4)


def test_op10_and_op2_columns(spark, texts):
    got = by_id(catalogue.QUERIES["op10_near_dedup"](spark, DATA))
    assert got.keys() == texts.keys() and all(r.class_id <= i and got[r.class_id].class_id == r.class_id for i, r in got.items())
    cut = by_id(catalogue.QUERIES["op2_substring_dedup"](spark, DATA))
    assert cut.keys() == texts.keys() and all(r.n_words == len(texts[i].encode().split()) for i, r in cut.items())


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
