"""Hard negatives, line quality and cross-tokenizer alignment against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beatfold.llm import alignment, bpe, catalogue, hard_negatives, quality
from tests.llm.conftest import ODD

DATA = "/root/testdata/sf0.001"


# ---- hard negatives


def naive_negatives(rows, k=5, positives=5, share=80, scale=256):
    """rows: (id, vector, label). Sorted (anchor, positive, rank, negative, positive score, negative score)."""
    v = [(i, [int(np.floor(scale * float(x))) for x in e], y) for i, e, y in rows if i is not None and y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    anchors = {}
    for i, e, y in v:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (e, y)), (e, y))
    out = []
    for a, (q, label) in anchors.items():
        scored = [(-sum(x * z for x, z in zip(q, e, strict=True)), i, y) for i, e, y in v if i != a and len(e) == len(q)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and share * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i, _) in enumerate(fit)]
    return sorted(out)


def found_negatives(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit("x"), F.lit(1), F.lit("y")).toDF("vec_id", "embedding", "label", "LABEL", "v", "ids")
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 100 == 0, **kw).collect())


def test_op11(spark):
    t = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in t]
    got = catalogue.QUERIES["op11_hard_negatives"](spark, DATA).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in got.collect()) == naive_negatives(rows)


@pytest.mark.parametrize("width", [1, 2, 5, 32])
def test_negatives_of_close_vectors(spark, width, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(width)
    centre = rng.normal(size=(4, width))
    rows = [(int(i), [float(x) for x in np.float32(centre[i % 4] + 0.2 * rng.normal(size=width))], int(rng.integers(0, 3))) for i in range(700)]
    rows += [rows[100], rows[3], (200, rows[7][1], 1)]  # repeated rows, and an anchor's id with another vector
    assert found_negatives(spark, rows) == naive_negatives(rows)


def test_negatives_of_odd_rows(spark):
    one = [1.0, 0.5]
    rows = [(0, one, 1), (1, one, 1), (2, one, 2), (3, [0.9, 0.5], 2), (None, one, 1), (4, None, 2), (5, one, None), (6, [None, 1.0], 2), (7, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 1)]
    rows += [(9, [1.0], 2), (10, [], 2), (100, [], 1), (200, [-1.0, -1.0], 1), (300, [0.0, 0.0], 5)]
    assert found_negatives(spark, rows) == naive_negatives(rows) and naive_negatives(rows)
    assert found_negatives(spark, rows[:0]) == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for width in (1, 3, 8, 64, 65):
        a, b = rng.integers(-300, 300, (20, width)), rng.integers(-300, 300, (30, width))
        x, y = (hard_negatives.Block(None, None, v, *hard_negatives.summaries(v)) for v in (a, b))
        i, j = np.divmod(np.arange(600), 30)
        true, before = (a @ b.T)[i, j], np.inf
        for depth in range(len(x.depth)):
            for pick in (slice(None), slice(0, 5)):  # dense and sparse
                low, high = hard_negatives.bounds(x, y, depth, i[pick], j[pick], 1e-6)
                assert (low <= true[pick]).all() and (true[pick] <= high).all()
            low, high = hard_negatives.bounds(x, y, depth, i, j, 1e-6)
            assert (high - low).mean() <= before + 1e-6
            before = (high - low).mean()


# ---- line quality


def naive_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    held = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held), n < 50 or 100 * len(held) > 50 * n


def naive_states(field, x):
    """The likeliest of all state sequences of one text, tried one by one; of equals that of fewer boilerplate lines from the end on."""
    own = field.scores(x)
    value = lambda s: sum(own[i, k] for i, k in enumerate(s)) + sum(field.step[a, b] for a, b in itertools.pairwise(s))
    return max(itertools.product((0, 1), repeat=len(x)), key=value)


def test_op12(spark):
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    field = quality.fit(docs, labels)
    got = {r.doc_id: r for r in catalogue.QUERIES["op12_quality"](spark, DATA).collect()}
    assert got.keys() == {r["doc_id"] for r in t}
    for r in t:
        one, text = got[r["doc_id"]], r["text"] or ""
        assert (one.n_words, one.word_chars, one.n_symbols, one.n_dup_lines, one.n_repeat_words, one.base_failed) == naive_counts(text)
        lines = quality.Lines(pa.array([text]))
        if len(lines.of) <= 8:
            states, words = naive_states(field, lines.measures()), [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in text.split("\n")]
            share = sum(n for n, s in zip(words, states, strict=True) if not s) / max(1, sum(words))
            assert one.content_share == pytest.approx(share) and one.kept == (not one.base_failed and share >= 0.5)


def test_quality_of_documents_left_out():
    """Every fifth labelled id is not learnt from."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = {r.doc_id: r for r in catalogue.QUERIES["op12_quality"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    good = [i for i, q in truth.items() if q == 1 and i in got and not got[i].base_failed]
    bad = [i for i, q in truth.items() if q == 0 and i in got]
    assert len(good) > 20 and sum(got[i].kept for i in good) >= 0.98 * len(good)
    assert len(bad) > 3 and sum(not got[i].kept for i in bad) >= 0.8 * len(bad)


def test_quality_of_odd_texts(spark, docs):
    rows = [*ODD, (8, "\n\n\n"), (9, "a b c a b c\na b c\na b c\n"), (10, "a\x85b\x1cc d e " * 20), (11, "\n".join(["same line here"] * 30))]
    for field in (None, quality.Field(np.linspace(-1, 1, quality.MEASURES), np.array([[1.0, -1], [-1, 1]]))):
        got = sorted((r[:7] for r in quality.judge(docs(rows, extra=True), field).collect()), key=str)
        assert got == sorted(((i, *naive_counts(t or "")) for i, t in rows), key=str)
    assert quality.judge(docs([]), None).count() == 0
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 0, 0), (None, 1, 1), (3, 7, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs(rows), labels) is None


def test_viterbi_is_the_likeliest_sequence():
    rng = np.random.default_rng(5)
    for _ in range(20):
        field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
        sizes = rng.integers(1, 8, 6)
        x = rng.normal(size=(sizes.sum(), 3))
        state, (chance, pairs), at, want_pairs = field.viterbi(x, sizes), field.marginals(x, sizes), 0, np.zeros((2, 2))
        for n in sizes:
            part, own = x[at : at + n], field.scores(x[at : at + n])
            assert tuple(state[at : at + n]) == naive_states(field, part)
            every = list(itertools.product((0, 1), repeat=int(n)))
            p = np.exp([sum(own[i, k] for i, k in enumerate(s)) + sum(field.step[a, b] for a, b in itertools.pairwise(s)) for s in every])
            p /= p.sum()
            assert chance[at : at + n] == pytest.approx(np.array(every).T @ p)
            for s, w in zip(every, p, strict=True):
                for a, b in itertools.pairwise(s):
                    want_pairs[a, b] += w
            at += n
        assert pairs == pytest.approx(want_pairs)


# ---- alignment


def naive_alignment(texts):
    """What align() gives for each text, token by token, with the libraries themselves."""
    a_lib, b_lib = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))
    a_lib.encode_special_tokens = True
    value = {c: n for n, c in enumerate(bpe.byte_letters())}
    bytes_b = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    held, count = [], Counter()
    for t in texts:
        a, b = a_lib.encode(f" {t}", add_special_tokens=False).ids if t else [], b_lib.encode(t) if t else []
        xa, xb = [bytes(value[c] for c in a_lib.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
        if not t or not b"".join(xa) == b"".join(xb) == f" {t}".encode():
            held.append(None)
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in (xa, xb)]
        links, groups, j, part = [], [], 0, ([], [])
        common = set(ends[0]) & set(ends[1])
        for i, end in enumerate(ends[0]):
            k = j
            while k < len(b) and ends[1][k] - len(xb[k]) < end:
                if ends[1][k] > end - len(xa[i]):
                    links.append((a[i], b[k]))
                k += 1
            part[0].append(a[i])
            while j < len(b) and ends[1][j] <= end:
                part[1].append(b[j])
                j += 1
            if end in common:
                groups.append("|".join(",".join(map(str, x)) for x in part))
                part = ([], [])
        count.update(links)
        held.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if h is None else (*h[:3], len(h[3]), sum(count[x] == best[x[1]] for x in h[3]), sum(count[x] for x in h[3]), h[4]) for h in held]


def test_op13(spark):
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = dict(zip((r["doc_id"] for r in t), naive_alignment([r["text"] for r in t]), strict=True))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert {r.doc_id: tuple(r[n] for n in names) for r in catalogue.QUERIES["op13_alignment"](spark, DATA).collect()} == want


def test_alignment_joins_few_texts_at_a_time(monkeypatch):
    texts = [w * 40 for w in ("one more line, ", "zwei  Zeilen\n", "три ", "")] * 300 + [None, "x" * 9000]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    seen = []

    class Watched(alignment.Joined):
        def __init__(self, tables, own, *ids):
            seen.append(sum(map(len, own.to_pylist())) if len(own) > 1 else 0)
            super().__init__(tables, own, *ids)

    def run(joined):
        monkeypatch.setattr(alignment, "JOINED", joined)
        monkeypatch.setattr(alignment, "Joined", Watched)
        return [(i, *map(int, x), g) for t, b, j in alignment._batches([rows], (None, None), "text") for i, *x, g in zip(b.column(0).to_pylist(), j.na, j.nb, j.n_groups, j.n_links, j.digests(t), strict=True)]

    whole = run(1 << 30)
    seen.clear()
    assert run(5000) == whole and len(whole) == len(texts)
    assert max(seen) <= 5000 and len(seen) > 20


@pytest.mark.parametrize("few", [False, True])
def test_alignment_of_odd_texts(spark, docs, monkeypatch, few):
    """few: many parts of the lookup table, small trees and flushed tasks."""
    if few:
        monkeypatch.setattr(alignment, "FAN", 2)
    odd = [*ODD, (8, "  two  spaces  "), (8, "  two  spaces  "), (9, "\ttab\nnew\n\nline "), (10, "▁ mark"), (11, "<s> <unk> <0x41>"), (12, " "), (13, "\x00 \U0001f600 é")]
    got = sorted(map(str, map(tuple, alignment.align(docs(odd, extra=True).repartition(5), lookup_bytes=2000 if few else 1 << 20).collect())))
    assert got == sorted(str((i, *n)) for (i, _), n in zip(odd, naive_alignment([t for _, t in odd]), strict=True))
    assert alignment.align(docs([])).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    groups = [rng.choice(1 << 31, n, replace=False).astype(np.uint32) for n in (0, 1, 2, 70, 5000)]
    built = [alignment.PerfectHash.build(g) for g in groups]
    one = alignment.PerfectHash([s for s, _ in built], np.concatenate([w for _, w in built]))
    keys, bucket = np.concatenate(groups), np.repeat(np.arange(5), [*map(len, groups)])
    at = one.places(keys, bucket)
    assert sorted(at) == list(range(len(keys))) and (np.sort(at[bucket == 4]) == np.arange(73, 5073)).all()
    assert one.places(np.array([5], np.uint32), np.array([0]))[0] == -1
