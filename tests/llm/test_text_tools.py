"""Media, BPE, packing, URL filters and top-k."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beatfold.llm import bpe, common, components, language, media, packing, topk, url_filter
from tests.llm.conftest import ODD

LIBRARY = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
CODEC = bpe.Codec()


@given(st.binary(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(data):
    wav = media.to_wav(data)
    back = media.from_wav(wav)
    assert back.startswith(data) and set(back[len(data) :]) <= {255} and len(back) % 576 == 0 and len(back) > 0
    assert len(back) - len(data) < 576 or not data
    t, c = media.fingerprint(back)
    assert (np.diff(t) >= 0).all() and len(t) == len(c)


def test_fingerprints_by_brute_force():
    r = np.random.default_rng(0)
    x = r.integers(0, 256, 576 * 4, dtype=np.uint8)
    bins, power = media.band_peaks(x)
    frames = [x[i : i + 576] for i in range(0, len(x) - 575, 288)]
    assert len(frames) == len(bins)
    for f, b, p in zip(frames, bins, power, strict=True):
        spectrum = np.abs(np.fft.rfft((f.astype(float) - 128) * np.hanning(577)[:576])) ** 2
        assert [a + int(spectrum[a:z].argmax()) for a, z in itertools.pairwise(media.EDGES)] == list(b)
        assert spectrum[b] == pytest.approx(p)


def test_media_table(docs):
    got = {(r.doc_id, r.n_bytes): r for r in media.media_columns(docs(ODD, True)).collect()}
    assert len(got) == len(ODD) - 1
    assert got[1, 0].payload == got[2, 0].payload == b"\xff" * 576
    long = got[6, 200_000]
    assert long.payload[:200_000] == b"x" * 200_000 and media.media_columns(docs([])).count() == 0


@given(st.text(alphabet="ab c'std\n\t 　.,!ſ日é1２<|endoftext|>'ll", max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_bpe_table(docs):
    for r in bpe.encode_decode(docs(ODD, True)).join(docs(ODD).select("doc_id", "text"), "doc_id").collect():
        assert r.decoded == (r.text or "")
        assert list(r.ids) == LIBRARY.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.encode_decode(docs([])).count() == 0


def check_packed(found, texts):
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
    for i, text in texts:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        copies = sum(j == i for j, _ in texts)
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in parts) == copies * len(ids)
        for r in parts:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_packing_table(docs):
    check_packed(packing.pack_documents(docs(ODD, True)).collect(), ODD)
    assert packing.pack_documents(docs([])).count() == 0


def test_packing_wastes_little(docs):
    r = random.Random(4)
    texts = [(i, " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randint(1, 1500)))) for i in range(150)]
    found = packing.pack_documents(docs(texts)).collect()
    check_packed(found, texts)
    used = sum(x.length for x in found)
    assert used / (packing.SIZE * len({x.sequence_id for x in found})) > 0.97


def test_sequences_hold_their_ids(docs):
    pieces = common.written(packing.token_pieces(docs([(1, "one two"), (2, "three")]), keep_ids=True), "p")
    got = packing.sequences(packing.pack(pieces)).collect()
    assert len(got) == 1 and got[0].n_pad == packing.SIZE - 5 and list(got[0].ids).count(1) == 2


def test_generated_patterns_against_all_patterns():
    units, demand, room = np.array([3, 4, 5]), np.array([7.0, 5.0, 9.0]), 10
    basis, used, gap = packing.generate(units, demand, room, 0)
    assert gap == pytest.approx(0)
    assert (basis @ units <= room).all() and (used @ basis) == pytest.approx(demand)
    best, count = packing.knapsack(np.array([2.0, 3.0, 4.1]), units, room)
    brute = max(np.dot(c, [2.0, 3.0, 4.1]) for c in itertools.product(range(4), repeat=3) if np.dot(c, units) <= room)
    assert best == pytest.approx(brute) and count @ units <= room


def naive_verdict(url, edges):
    rules = [(v, h, p) for v, h, p in url_filter.RULES]

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:n], rest[n:]
        return "".join(c.lower() if c.isascii() else c for c in host), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]

    def own(u):
        h, p = split(u)
        fit = [(len(x[1] + x[2]), x) for x in rules if (h == x[1] or h.endswith("." + x[1])) and p.startswith(x[2])]
        return max(fit)[1] if fit else None

    mine = own(url)
    if mine:
        return mine[0]
    group, grown = {url}, True
    while grown:
        more = {b for a, b in edges if a in group} | {a for a, b in edges if b in group}
        grown = not more <= group
        group |= more
    verdicts = {o[0] for u in group if (o := own(u))}
    return "allow" if "allow" in verdicts or not verdicts else "block"


def test_aliases(spark):
    urls = ["http://a.org/1", "http://b.org/2", "http://c.net/es/x", "http://d.org/4", "http://e.org/5", "http://www.example.com/en/q", "http://f.net/fr/z", "http://A.Example.COM/en/q?x#y", "nothing", None, "http://g.org"]
    edges = [(0, 1), (1, 2), (3, 2), (4, 5), (4, 6)]
    html = dict.fromkeys(range(len(urls)), "<p>")
    html[0] = f'<LINK href="{urls[1]}" rel=canonical>'
    html[1] = f'<meta http-equiv="refresh" content="0; URL={urls[2]}">'
    html[3] = f"<link rel='canonical' href='//c.net/es/x'>"
    redirects = spark.createDataFrame([(urls[4], urls[5]), (urls[4], urls[6]), (None, "x"), ("http://z.org", None)], "from_url string, to_url string")
    pages = spark.createDataFrame([(i, u, html[i]) for i, u in enumerate(urls)] + [(99, "http://h.net/es/", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(pages, redirects=redirects).collect()}
    pairs = [(urls[a], urls[b]) for a, b in edges]
    for i, u in enumerate(urls):
        assert got[i].verdict == naive_verdict(u, pairs), u
    assert (got[0].verdict, got[4].verdict, got[7].rule, got[8].host, got[99].verdict) == ("block", "allow", "example.com/en/", "", "block")
    assert got[10].path == "" and url_filter.judge(pages.limit(0)).count() == 0


def test_url_filter_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://www.example.com/en/x", None), (2, None, None), (3, "ftp://a.NET/fr/", "<html>")], "page_id long, url string, html string")
    for c in ("host", "path", "rule", "verdict", "key", "own", "node", "comp", "a", "b", "alias_verdict"):
        pages = pages.withColumn(c, F.lit("x"))
    got = rows(url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict"))
    assert got == [(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "", "", None, "allow"), (3, "a.net", "/fr/", "net/fr/", "block")]


def test_column_generation_ends_at_the_best_solution():
    r = np.random.default_rng(6)
    for _ in range(30):
        room = int(r.integers(8, 24))
        units = np.sort(r.choice(np.arange(1, room + 1), int(r.integers(1, min(8, room))), replace=False))
        demand = r.integers(1, 50, len(units)).astype(float)
        start, often = packing.first_fit(units, demand, room)
        assert (start @ units <= room).all() and often @ start == pytest.approx(demand) and (often >= 0).all()
        basis, used, gap = packing.generate(units, demand, room, 0)
        worth, _ = packing.knapsack(np.linalg.inv(basis.T).sum(0), units, room)
        assert used @ basis == pytest.approx(demand) and used.sum() <= often.sum() + 1e-9 and (worth <= 1 + 1e-6 or gap == pytest.approx(0, abs=1e-9))
        near, few, reached = packing.generate(units, demand, room, 0.05)
        assert reached <= 0.05 and few.sum() <= 1.05 * used.sum() + 1e-9


def test_language_of_few_ids_that_repeat(spark):
    """200 English ids once each, 3 German ids 2,000 rows each: both are learnt."""
    english, german = "the house and the garden with that old tree", "das haus und der garten mit dem alten baum"
    rows = [(i, english, "en") for i in range(300)] + [(1000 + i, german, "de") for i in range(5) for _ in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, sample=50)
    assert sorted(model.languages) == ["de", "en"]
    asked = spark.createDataFrame([(1, german), (2, english)], "doc_id long, text string")
    assert rows_of(language.predict(asked, model)) == [(1, "de"), (2, "en")]


def rows_of(df):
    return sorted((r.doc_id, r.lang_pred) for r in df.collect())


def test_top_k_with_columns_that_differ_in_case(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "x", "y") for i in range(6)], "vec_id long, embedding array<float>, z string, w string").toDF("vec_id", "embedding", "VEC_ID", "v")
    assert rows(topk.top_k(df, F.col("vec_id") == 2, 1).select("query_id", "rank", "vec_id")) == [(2, 1, 5)]


def test_url_filter_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "")], "page_id long, url string, html string")
    assert "Python" not in url_filter.judge(pages)._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (100, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 50)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 3)], "a long, b long")
    got = dict(rows(components.components(df)))
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100 and all(got[200 + i] == 200 for i in range(50))
    assert components.components(df.limit(0)).count() == 0


def test_topk_by_brute_force(spark):
    r = np.random.default_rng(2)
    data = [(int(i), np.round(r.normal(size=6), 2).tolist()) for i in range(120)]
    data += [(200 + i, data[50][1]) for i in range(30)] + [(300, None), (301, [None] * 6), (350, [float("nan")] * 6), (400, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, data[0][1]), (450, [1.0, 2.0]), (500, [3.0, 4.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    good = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    got = rows(topk.top_k(df, F.col("vec_id") % 50 == 0))
    assert got == sorted(want)
    assert rows(topk.top_k(df, F.col("vec_id") % 50 == 0, block=2)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_digest_columns(docs):
    text = "héllo world"
    assert hashlib.sha256(",".join(map(str, LIBRARY.encode(text, add_special_tokens=False).ids)).encode()).hexdigest() == bpe.encode_decode(docs([(1, text)])).select(F.sha2(F.array_join("ids", ","), 256)).first()[0]
