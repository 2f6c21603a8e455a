"""Secrets, substring and near-duplicate removal, language, toxicity and the pipeline."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

import corpus_pipeline
from beatfold.llm import common, language, near_dedup, packing, secret_scan, substring_dedup, toxicity
from tests.llm.conftest import ODD

WORDS = ["".join(random.Random(i).choices("abcdefghij", k=random.Random(i + 1).randint(2, 8))) for i in range(400)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def naive_base(text):
    found = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def secret_texts():
    r = random.Random(1)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    texts = [f"{prose(r, 30)} token = \"{hexes(40)}\" {prose(r, 20)}" for _ in range(40)]
    texts += [f"é{prose(r, 9)} API_key:'{hexes(12)}' and PassWord=short passwd = x{hexes(30)} AKIA{hexes(14).upper()} tokeN: {hexes(20)}" for _ in range(20)]
    key = lambda: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=28))
    texts += [f"{prose(r, 5)} secret: {key()} {prose(r, 9).replace(' ', 'x', 4)} {'z' * 500}" for _ in range(40)]
    texts += [f"{prose(r, 5)} {prose(r, 9).replace(' ', r.choice('._'), 5)}" for _ in range(60)]
    return texts


def test_base_spans_by_other_patterns():
    for t in [*secret_texts(), "toKen ſecret=abcdefabcdef12 toKKen=abcdefabcdef12", "secret = secret=AAAABBBBCCCCDDDD", "token==" + "a" * 20]:
        assert [x[:3] for x in secret_scan.base_spans(t)] == naive_base(t), t


def test_grammar_tells_credentials_from_words(docs):
    texts = list(enumerate(secret_texts(), 100))
    grammar = secret_scan.fit(docs(texts))
    r = random.Random(9)
    secret = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=28))
    assert grammar.ratio(secret) > grammar.threshold > grammar.ratio("somewhat.longer.words")
    for row in secret_scan.find_secrets(docs(texts + ODD[1:], True), grammar, redact="[X]").collect():
        text = dict(texts + ODD)[row.doc_id] or ""
        assert [(s.kind, s.start, s.end) for s in row.spans if s.kind != "grammar"] == naive_base(text)
        if row.text:
            assert not naive_base(row.text)
    assert [x[:3] for x in grammar.spans(f"see {secret} here")] == [("grammar", 4, 32)]  # no base pattern knows it


def test_credentials_joined_to_base_spans(docs):
    grammar = secret_scan.fit(docs(list(enumerate(secret_texts(), 100))))
    r = random.Random(4)
    secret = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=28))
    access, name = "AKIA" + "".join(r.choices("0123456789ABCDEF", k=16)), "0123456789abcdef"
    assert [x[:3] for x in grammar.spans(f"see {access}/{secret} here")] == [("access", 4, 24), ("grammar", 25, 53)]
    assert [x[:3] for x in grammar.spans(f"{secret}.{name}.{secret}")] == [("grammar", 0, 28), ("hex", 29, 45), ("grammar", 46, 74)]
    row = secret_scan.find_secrets(docs([(1, f"get a/{name}/{secret} now")]), grammar, redact="[X]").first()
    assert row.text == "get a/[X]/[X] now"
    base = secret_scan.base_spans(f"{name}/{'z' * 11} {name}//{'z' * 9}+ {'z' * 20}")
    assert [x[2] for x in secret_scan.other_runs(f"{name}/{'z' * 11} {name}//{'z' * 9}+ {'z' * 20}", base)] == [f"/{'z' * 11}", f"//{'z' * 9}+", "z" * 20]


def test_merged_states_keep_probabilities():
    a = secret_scan.Automaton(["ab12", "ac34", "12ab"] * 20)
    assert len({n for x in a.next for n in x.values()}) < 12
    assert a.score("hhdd") > a.score("llll")


def test_all_values_are_learnt(docs, monkeypatch):
    """1,000 values of a kind and 4,000 runs were learnt from, none over 1,024 letters. A tree that is cut is counted to its ends."""
    r = random.Random(3)
    runs = ["".join(r.choices("abcxyz", k=14)) for _ in range(4500)] + ["q" * 3000]
    values = ["".join(r.choices("0123456789abcdef", k=20)) for _ in range(1300)]
    texts = [(i, " ".join(runs[i::60]) + " ".join(f" {v} ." for v in values[i::60])) for i in range(60)]
    for nodes in (secret_scan.NODES, 300):
        monkeypatch.setattr(secret_scan, "NODES", nodes)
        g = secret_scan.fit(docs(texts))
        assert g.ordinary.total[0] >= len({*runs}) and g.kinds[0].total[0] >= len({*values})
        if nodes == 300:
            assert sum(g.ordinary.ends) == len({*runs}) and sum(g.kinds[0].ends) == len({*values})
            assert sum(n for u in g.ordinary.uses for n in u.values()) == sum(map(len, {*runs}))
    assert g.threshold >= secret_scan.MARGIN


def test_place_in_order(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "FEW", 3)
    values = sorted([float(x * x % 37) for x in range(200)])
    df = spark.createDataFrame([(x, 1) for x in values], "s double, n long")
    for share in (0.0, 0.4, 0.9995, 1.0):
        assert secret_scan._kth(df, share) == values[int(share * 199)]


def test_no_credentials_no_grammar(docs):
    g = secret_scan.fit(docs([(1, "plain words only"), (2, None)]))
    assert g.spans("token = abcdefabcdef12345") and not g.kinds
    assert secret_scan.find_secrets(docs([]), g).count() == 0


def naive_windows(texts):
    docs = sorted(((i if i is not None else -(2**63)), (t or "")) for i, t in texts)
    split = lambda t: [w for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    seen, out = set(), {}
    for i, t in docs:
        w = split(t)
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone |= set(range(k, k + 20))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def repeated_texts():
    r = random.Random(5)
    passage, texts = prose(r, 60), []
    for i in range(60):
        t = prose(r, r.randint(0, 120))
        if i % 3 == 0:
            t = f"{t}\n{passage}\t{prose(r, 10)}"
        if i % 7 == 0:
            t += "  \x1c " + " ".join(passage.split()[5 : 5 + r.randint(18, 24)])
        if i % 11 == 0:
            t += " echo" * 50
        texts.append((i, t))
    return texts + [(100, texts[3][1]), (101, None), (102, ""), (103, " "), (None, texts[6][1])]


@pytest.mark.parametrize("flush", [10**6, 50])
def test_substrings_by_brute_force(docs, monkeypatch, flush):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", flush)
    texts = repeated_texts()
    want = naive_windows(texts)
    got = substring_dedup.dedup_substrings(docs(texts, True).repartition(5)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[-(2**63) if r.doc_id is None else r.doc_id], r.doc_id


def test_substrings_odd(docs):
    got = substring_dedup.dedup_substrings(docs(ODD)).collect()
    assert len(got) == len(ODD) and substring_dedup.dedup_substrings(docs([])).count() == 0
    long = next(r for r in got if r.doc_id == 5)
    assert (long.n_words, long.n_removed, long.kept) == (30_000, 29_980 + 19 - 19, " ".join(["wörd"] * 20)) or long.n_words - long.n_removed <= 20


def test_substrings_with_a_full_sketch(docs, monkeypatch):
    """One cell for many windows: more is grouped, nothing else is removed."""
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 400)
    monkeypatch.setattr(substring_dedup, "SPREAD", (np.uint64(1), np.uint64(3)))
    texts = repeated_texts()
    want = naive_windows(texts)
    got = substring_dedup.dedup_substrings(docs(texts, True)).collect()
    assert all((r.n_words, r.n_removed, r.kept) == want[-(2**63) if r.doc_id is None else r.doc_id] for r in got) and len(got) == len(texts)


def test_sketches_never_estimate_too_low():
    r = np.random.default_rng(3)
    chunks = [r.integers(0, 60, 50).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(6)]
    ranges, bits = 3, 5
    rows = []
    for i, h in enumerate(chunks):
        at = [np.sort(substring_dedup.cells_of(h, row, ranges, bits)) for row in range(2)]
        for p in np.unique(substring_dedup.part_of(h, ranges)):
            cells = [c[c >> np.uint64(32) == p].astype(np.uint32) for c in at]
            rows.append((int(p), i, *[substring_dedup.packed(np.sort(np.concatenate([np.unique(c), np.unique(c[1:][c[1:] == c[:-1]])]))) for c in cells]))
    t = pa.table({n: [x[i] for x in rows] for i, n in enumerate(("part", "chunk", "row0", "row1"))})
    answers = pa.concat_tables([substring_dedup._merged(bits)(t.filter(pa.compute.equal(t["part"], p))) for p in range(ranges)])
    values, counts = np.unique(np.concatenate(chunks), return_counts=True)
    for i, h in enumerate(chunks):
        got = set(substring_dedup._repeated(h, answers.filter(pa.compute.equal(answers["chunk"], i)), ranges, bits).tolist())
        assert {k for k, v in enumerate(h) if counts[np.searchsorted(values, v)] > 1} <= got


def test_packing_of_numbers_and_rolling():
    r = np.random.default_rng(0)
    for x in (r.integers(-(2**62), 2**62, 99), np.sort(r.integers(0, 2**32, 99).astype(np.uint32)), np.zeros(0, np.int64)):
        assert (substring_dedup.unpacked(substring_dedup.packed(x), x.dtype) == x).all()
    x = r.integers(0, 2**63, 50).astype(np.uint64)
    for k in (1, 2, 5, 13, 20):
        b = int(substring_dedup.B1)
        want = [sum(int(v) * pow(b, k - 1 - j, 2**64) for j, v in enumerate(x[i : i + k])) % 2**64 for i in range(51 - k)]
        assert [int(v) for v in substring_dedup.rolling(x, k, substring_dedup.B1)] == want


def near_texts():
    r = random.Random(8)
    texts = [(i, prose(r, r.randint(5, 150))) for i in range(60)]
    base = prose(r, 200).split()
    for i in range(60, 90):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(1000))
        texts.append((i, " ".join(w)))
    texts += [(90, texts[4][1]), (91, texts[4][1].replace(" ", "\n")), (92, "one two"), (93, "one two"), (94, "one three"), (95, "la " * 40 + "x"), (96, "la " * 44 + "x"), (97, "la " * 90)]
    return texts


def naive_classes(texts):
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in texts if (w := (t or "").split())}
    parent = {i: i for i, _ in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for x in ids:
        for y in ids:
            if x < y and 5 * (bags[x] & bags[y]).total() >= 4 * (bags[x] | bags[y]).total():
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates_by_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = near_texts()
    assert dict(rows(near_dedup.near_duplicates(docs(texts, True).repartition(3)))) == naive_classes(texts)


def test_near_duplicates_odd(docs):
    got = near_dedup.near_duplicates(docs(ODD)).collect()
    assert len(got) == len(ODD) and near_dedup.near_duplicates(docs([])).count() == 0
    assert all(r.doc_id == r.class_id for r in got)


def test_rows_that_share_an_id_keep_their_links(docs):
    r = random.Random(12)
    a, b = prose(r, 100), prose(r, 100)
    got = near_dedup.classified(docs([(5, a), (5, b), (7, b + " more"), (8, a + " more"), (None, a + " again"), (None, prose(r, 60))])).collect()
    assert sorted((r.id or 0, r.class_id or 0, r.is_kept) for r in got) == [(0, 0, True), (0, 0, True), (5, 0, False), (5, 5, True), (7, 5, False), (8, 0, False)]
    assert sorted(Counter(r.class_key for r in got).values()) == [1, 2, 3]  # three classes, though two first rows have no id


def test_blocks_are_bounded_by_words_too(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_WORDS", 300)
    texts = near_texts()
    assert dict(rows(near_dedup.near_duplicates(docs(texts)))) == naive_classes(texts)


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    seen, true = [], []
    for k in range(80):
        a = Counter(r.integers(0, 30, 100).tolist())
        b = a + Counter(r.integers(0, 30, 60).tolist())
        h = lambda c: np.sort(np.concatenate([np.full(n, near_dedup.mixed(np.array([v + 1000 * k + 1], np.uint64))[0]) for v, n in c.items()]))  # noqa: B023, E731
        x, y = h(a), h(b)
        s = near_dedup.signatures(np.r_[np.zeros(len(x), int), np.ones(len(y), int)], np.r_[x, y], 2)
        seen.append((s[0] == s[1]).mean())
        true.append((a & b).total() / (a | b).total())
    assert np.mean(seen) == pytest.approx(np.mean(true), abs=0.02)


def languages(spark, n=120):
    r = random.Random(2)
    parts = {"en": ["the", "tion", "ing", "er", "and"], "fr": ["eau", "oi", "é", "ment", "le"], "de": ["sch", "ung", "ß", "ein", "lich"]}
    data = []
    for i in range(n):
        lang = r.choice([*parts])
        data.append((i, " ".join("".join(r.choices(parts[lang], k=r.randint(1, 3))) for _ in range(40)), lang if i % 10 else None, lang))
    return spark.createDataFrame(data, "doc_id long, text string, lang string, truth string")


def test_language_held_out(spark):
    d = languages(spark)
    got = language.predict(d, language.fit(d)).join(d, "doc_id").collect()
    assert sum(r.lang_pred == r.truth for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_odd(spark, docs):
    model = language.fit(languages(spark))
    got = {r.doc_id: r for r in language.predict(docs([*ODD, (50, "123 !?"), (51, "日本語")], True), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[50].lang_pred == "und" and got[50].score == 0.0
    assert got[51].lang_pred in model.languages and language.predict(docs([]), model).count() == 0
    assert language.fit(docs([])) is None and {r.lang_pred for r in language.predict(docs(ODD), None).collect()} == {"und"}


def test_large_languages_leave_room_for_a_small_one(spark):
    ids = [i for i in range(1000, 1020) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    few = spark.createDataFrame([(i, " ".join(f"{w}{w}" for w in ("ozu", "ikwa", "umbo", "yazi")), "zu", "zu") for i in ids], "doc_id long, text string, lang string, truth string")
    d = languages(spark).union(few)
    model = language.fit(d)
    assert model.languages == ["de", "en", "fr", "zu"]
    assert {r.lang_pred for r in language.predict(few, model).collect()} == {"zu"}


PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "abab"]


def total(word, prob):
    """Sum over all segmentations, letter by letter; prob: of each piece, the last for other letters."""
    sums = [1.0]
    for j in range(1, len(word) + 1):
        sums.append(sum(sums[j - len(x)] * prob[i] for i, x in enumerate(PIECES) if word[:j].endswith(x)) + (0 if word[j - 1] in PIECES else sums[j - 1] * prob[-1]))
    return sums[-1]


def naive_uses(word, prob, found=None, share=1.0):
    if not word:
        return [(share, found or [])]
    out = []
    for i, x in enumerate(PIECES):
        if word.startswith(x):
            out += naive_uses(word[len(x) :], prob, [*(found or []), i], share * prob[i])
    return out or naive_uses(word[1:], prob, [*(found or []), len(PIECES)], share * prob[-1])


def test_forward_sums_all_segmentations():
    p = np.array([0.1, 0.2, 0.15, 0.25, 0.2, 0.1, 0.05, 1e-7])
    table = language.Pieces(PIECES)
    for word in ("▁aba", "▁ababxab", "▁" + "ab" * 40 + "xa"):
        want = total(word, p)
        assert np.exp(language.forward(table.arcs([word]), p[:, None]))[0, 0] == pytest.approx(want)
        assert np.exp(language.long_forward(language.long_arcs(table, word), np.log(p)[:, None])[-1][0]) == pytest.approx(want)


def test_expected_uses_against_all_segmentations():
    p = np.array([0.1, 0.2, 0.15, 0.25, 0.2, 0.1, 0.05, 1e-7])
    table, size = language.Pieces(PIECES), np.array([*map(len, PIECES), 1])
    word = "▁abaxabab"
    every = naive_uses(word, p)
    whole = sum(s for s, _ in every)
    want = np.zeros(len(p))
    for share, used in every:
        for i in used:
            want[i] += 3 * share / whole
    assert language.expected(table.arcs([word]), size, p, np.array([3.0])) == pytest.approx(want)
    assert language.long_expected(language.long_arcs(table, word), np.log(p), 3.0) == pytest.approx(want)


def test_a_text_is_scored_over_its_whole_words():
    p = np.array([[0.1, 0.2], [0.2, 0.1], [0.15, 0.25], [0.25, 0.15], [0.2, 0.05], [0.05, 0.2], [0.05, 0.05], [1e-7, 1e-7]])
    model = language.Model(PIECES, ["x", "y"], np.log([0.3, 0.7]), np.log(p))
    text = "Abab, ba " + "ab" * 30 + " aaba"
    words = ["▁" + w for w in ("abab", "ba", "ab" * 30, "aaba")]
    want = [np.log(share) + sum(np.log(total(w, p[:, k])) for w in words) for k, share in enumerate((0.3, 0.7))]
    names, probs = language.Scorer(model).predict([language.words_of(text)])
    assert names == [["x", "y"][int(np.argmax(want))]] and probs[0] == pytest.approx(1 / (1 + np.exp(-abs(want[0] - want[1]))))


def toxic_rows(spark, n=240):
    r = random.Random(3)
    data, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        w = prose(r, r.randint(20, 120)).split()
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(["vilescum", "vilefool"]))
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return data, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark, docs):
    data, labels = toxic_rows(spark)
    net = toxicity.fit(docs(data), labels)
    got = dict(rows(toxicity.score(docs(data), net), "doc_id", "score"))
    held = [i for i, _ in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    odd = toxicity.score(docs(ODD, True), net).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd) and toxicity.score(docs([]), net).count() == 0
    assert toxicity.fit(docs(data), labels.filter("toxic = 0")) == 0.0 and toxicity.fit(docs([]), labels.limit(0)) == 0.0


def test_toxicity_learns_from_every_row(spark, docs, monkeypatch):
    data, labels = toxic_rows(spark)
    data = [(i, f"{t} {'grimblot ' * (2 * (i % 3 == 0))}") for i, t in data]
    monkeypatch.setattr(toxicity, "GROUP", 20)
    known = {r.id: r.h for r in toxicity.learnable(labels, "toxic", "doc_id").withColumn("h", F.xxhash64("id")).collect()}
    start = {i for y in (True, False) for i in sorted((i for i in known if (i % 3 == 0) == y), key=known.get)[:20]}
    other = [(i, t if i in start or i not in known else t.replace("grimblot", "")) for i, t in data]
    found = []
    for rows_, fan in ((data, 64), (data, 2), (other, 64)):
        monkeypatch.setattr(toxicity, "FAN", fan)
        found.append(toxicity.fit(docs(rows_), labels, sample=20))
    assert all(np.allclose(v, found[1].w[k], atol=1e-5) for k, v in found[0].w.items())  # sums in a tree
    assert any(not np.allclose(v, found[2].w[k], atol=1e-4) for k, v in found[0].w.items())  # rows beyond the start count


def test_gradients_against_differences():
    net = toxicity.Network(1)
    words = ["aa", "bb", "cc", "dd"]
    rows_, count = toxicity.window_rows([np.array([1, 2, 3]), np.array([4, 1])])
    label = np.array([1.0, 0.0])
    _, g, sparse = net.gradients(words, rows_, count, label)
    for name in ("fU", "bW", "attend", "out", "bias"):
        w, at = net.w[name], (0,) * net.w[name].ndim
        keep = w[at]
        loss = []
        for e in (1e-2, -1e-2):
            w[at] = keep + e
            loss.append(net.gradients(words, rows_, count, label)[0])
        w[at] = keep
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-2, abs=2e-3)


def test_table_gradients_against_differences():
    net = toxicity.Network(2)
    words = ["a", "bb", "c" * 32, "über", "anna"]
    rows_, count = toxicity.window_rows([np.array([1, 2, 3, 2]), np.array([4, 1]), np.array([5])])
    label = np.array([1.0, 0.0, 1.0])
    _, g, sparse = net.gradients(words, rows_, count, label)
    _, g_least, sparse_least = net.gradients(words, rows_, count, label, least=1e-12)
    assert all(np.allclose(v, g_least[k], atol=1e-5) for k, v in g.items())
    for name, (touched, values) in sparse.items():
        assert np.array_equal(touched, sparse_least[name][0]) and np.allclose(values, sparse_least[name][1], atol=1e-5)
        assert len(values) == len(touched) == len({*touched}) and values.shape[1] == net.w[name].shape[1]
        at = np.unravel_index(np.abs(values).argmax(), values.shape)
        cell, loss = (touched[at[0]], at[1]), []
        keep = net.w[name][cell]
        for e in (1e-2, -1e-2):
            net.w[name][cell] = keep + e
            loss.append(net.gradients(words, rows_, count, label)[0])
        net.w[name][cell] = keep
        assert values[at] == pytest.approx((loss[0] - loss[1]) / 2e-2, abs=2e-3, rel=0.05)


def test_embedding_of_new_words_costs_little():
    """In CPU seconds, against those of taking as many rows of the n-gram table."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 12))) for _ in range(8192)]
    net, at = toxicity.Network(1), np.random.default_rng(1).integers(0, 1 << toxicity.GRAM_BITS, 25 * len(words))

    def spent(f):
        times = []
        for _ in range(5):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        return min(times)

    assert spent(lambda: net.embed(words)) < 15 * spent(lambda: net.w["grams"].take(at, 0))


def test_windows_hold_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        r, count = toxicity.window_rows([np.arange(1, n + 1)])
        assert set(r.ravel()) - {0} == set(range(1, n + 1)) and count[0] == len(r) >= 1


def test_pipeline_stage_by_stage(spark, docs, tmp_path):
    data, labels = toxic_rows(spark)
    r = random.Random(1)
    passage = prose(r, 70)
    texts = data + [(1000 + i, f"{prose(r, 80)} {passage} token = \"{''.join(r.choices('0123456789abcdef', k=40))}\"") for i in range(30)] + [(2000, data[1][1]), (2001, None), (2002, "")]
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d = docs(texts, True)
    want = dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, d, str(tmp_path)), name)
        assert out.columns == d.columns
        got = dict(rows(out.select("doc_id", "text").fillna("~", ["text"])))
        before, want = want, {i: ("~" if t is None else t) for i, t in want.items()}
        if name == "toxicity":
            assert sum(i % 3 == 0 and i < 240 for i in got) <= 8 and sum(i in got for i in want if i >= 1000) >= 30
            want = {i: want[i] for i in got}
        elif name == "near_dedup":
            classes = naive_classes([(i, t) for i, t in before.items() if t != "~"])
            want = {i: t for i, t in want.items() if classes.get(i, i) == i}
        elif name == "substring_dedup":
            naive = naive_windows([(i, "" if t == "~" else t) for i, t in before.items()])
            want = {i: (naive[i][2] if naive[i][1] else t) for i, t in want.items()}
        else:
            assert not any(naive_base(t) for t in got.values()) and got.keys() == want.keys()
            want = got
        assert got == want, name
        d = out
    packed = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in d.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_repeated_rows_leave_one(spark, docs):
    out = corpus_pipeline.drop_near_copies(spark, docs([(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (3, None)]), "")
    assert rows(out, "doc_id") == [(1,), (3,)]


def test_rows_without_ids_of_their_own(docs):
    """Several null ids, and one id with a text of its own and a copied one: no text vanishes, and one row of each class stays."""
    base, other = ([f"{c}{i}" for i in range(40)] for c in "vw")
    near = " ".join([*base[:-1], "edit"])
    one, two, own = " ".join(base), " ".join(other), "a text of its own here"
    texts = [(None, one), (None, two), (None, "third null text"), (5, two), (7, own), (7, near), (8, near), (9, None), (9, "")]
    found = near_dedup.classified(docs(texts, True).repartition(3)).collect()
    assert sorted((r.id or 0, r.class_id or 0, r.is_kept) for r in found) == [(0, 0, True)] * 3 + [(5, 0, False), (7, 0, False), (7, 7, True), (8, 0, False), (9, 9, True), (9, 9, True)]
    out = corpus_pipeline.drop_near_copies(docs([]).sparkSession, docs(texts), "")
    assert sorted(out.select("doc_id", "text").fillna("~", ["text"]).fillna(0).collect()) == sorted([(0, one), (0, "third null text"), (0, two), (7, own), (9, ""), (9, "~")])


def test_numbers_of_names_are_unique(spark):
    names = spark.range(2000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("name"))
    assert near_dedup.numbered(names).select("node").distinct().count() == 2000


def test_digest_of_kept_words(docs):
    row = substring_dedup.dedup_substrings(docs([(1, "a  b\nc")])).select("kept", F.sha2("kept", 256).alias("h")).first()
    assert row.kept == "a b c" and row.h == hashlib.sha256(b"a b c").hexdigest()
    assert packing.SIZE % packing.PIECE == 0


def test_scratch_tables_are_deleted(spark):
    with common.scratch(spark):
        gone, kept = (common.written(spark.range(3), n, stays=n == "kept") for n in ("gone", "kept"))
        paths = [x.inputFiles()[0] for x in (gone, kept)]
    there = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    assert [p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in there] == [False, True] and kept.count() == 3
