"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (a sentencepiece model file; its path is a parameter). Every language has a
probability for each piece, learnt by expectation maximisation over all segmentations of a sample of its words; a word's
probability is the sum over all its segmentations (a forward algorithm in log space), a text's the product over its words, and
the languages are weighed by Bayes' rule with their shares of the sample as priors. Letters that no piece covers have a small
probability of their own, so any text has a score.

Learning: at most SAMPLE documents of each language (one row of an id), every word of them; expectations are summed up in Spark.
Scoring covers every word of every text. Words and pieces have any length.

Nulls: a null text, or one without letters, is `und` with score 0.0; null ids stay, are not held out and are never learnt from;
null languages are not learnt from. Without learnable rows every text is `und`. Ties go to the language that sorts first.
Repeated rows get equal predictions. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatfold.llm import common

PIECES = "piece_bpe_32k.model"
SAMPLE, ROUNDS = 1000, 4
KNOWN_WORDS, TASK_WORDS = 250_000, 50_000
UNKNOWN, FLOOR = 1e-7, 1e-8
LONG, RESCALE, SCALE = 48, 16, 20.0  # letters; longer words are taken one by one
_LETTERS = regex.compile(r"\p{L}+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased, with a mark before the first letter."""
    return ["▁" + w for w in _LETTERS.findall((text or "").lower())]


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of letters (with the mark at the start at most), lower-cased, and all single letters among them."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    pieces |= {c for p in pieces for c in p}
    return sorted(p for p in pieces if p and "▁" not in p[1:] and all(c.isalpha() for c in p.lstrip("▁")))


def letters(words: list[str]) -> np.ndarray:
    """A row of letters for each of the words, which have one length."""
    n = len(words[0])
    return np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)


def longer(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Keys of strings with one more letter."""
    h = (h ^ c) * _MIX
    return h ^ (h >> np.uint64(31))


class Pieces:
    """The vocabulary by key, with all beginnings of pieces; the number after the last piece stands for an unknown letter."""

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        number: dict[int, int] = {}
        for n, p in enumerate(pieces):
            h = np.uint64(0)
            for i, c in enumerate(p):
                with np.errstate(over="ignore"):
                    h = longer(h, np.uint64(ord(c)))
                number.setdefault(int(h), -1)
                if i == len(p) - 1:
                    number[int(h)] = n
        self.keys = np.array(sorted(number), np.uint64)
        self.number = np.array([number[int(k)] for k in self.keys], np.int32)

    def arcs(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length: by piece length - 1, the piece that begins at each letter of each word (-1: none); every single
        letter has one. Lengths that no piece has there are left out at the end."""
        x = letters(words)
        rows, n = x.shape
        at, h = np.arange(rows * n), np.zeros(rows * n, np.uint64)
        flat, found = x.reshape(-1), []
        for size in range(1, min(self.longest, n) + 1):
            h = longer(h, flat[at + size - 1])
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = self.keys[k] == h
            piece = np.full(rows * n, -1, np.int32)
            piece[at[known]] = self.number[k[known]]
            if size == 1:
                piece[piece < 0] = self.size
            found.append(piece.reshape(rows, n))
            on = known & (at % n + size < n)
            at, h = at[on], h[on]
            if not len(at):
                break
        return found


def ends_at(arcs: list[np.ndarray], j: int):
    """(letters, rows, pieces) of the pieces that end before letter j; of single letters, all rows."""
    for size, piece in enumerate(arcs[:j], 1):
        p = piece[:, j - size]
        if size == 1:
            yield size, slice(None), p
        elif len(hit := np.nonzero(p >= 0)[0]):
            yield size, hit, p[hit]


def forward(arcs: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """prob: (pieces + 1, languages). Log sums over all segmentations of each word; in the window of latest letters sums are kept on a scale of their own, so that
    words may have any length."""
    rows, n = arcs[0].shape
    window, scale = [np.ones((rows, prob.shape[1]))], np.zeros((rows, prob.shape[1]))  # latest first
    for j in range(1, n + 1):
        now = np.zeros_like(scale)
        for size, hit, piece in ends_at(arcs, j):
            now[hit] += window[size - 1][hit] * prob[piece]
        window = [now, *window[: len(arcs) - 1]]
        if j % RESCALE == 0:
            scale += np.log(now)
            window = [w / now for w in window]
    return np.log(window[0]) + scale


def expected(arcs: list[np.ndarray], size: np.ndarray, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the segmentations of words of one length, `count` times each; size: letters of the pieces.

    Probabilities are scaled by SCALE a letter, which cancels out, so that words of LONG letters stay within doubles.
    """
    rows, n = arcs[0].shape
    p = prob * SCALE**size
    a, b = np.zeros((n + 1, rows)), np.zeros((n + 1, rows))
    a[0], b[n] = 1, 1
    for j in range(1, n + 1):
        for k, hit, piece in ends_at(arcs, j):
            a[j][hit] += a[j - k][hit] * p[piece]
    got = np.zeros(len(prob))
    weight = count / a[n]
    for j in range(n, 0, -1):
        for k, hit, piece in ends_at(arcs, j):
            use = b[j][hit] * p[piece]
            b[j - k][hit] += use
            got += np.bincount(piece, use * a[j - k][hit] * weight[hit], minlength=len(prob))
    return got


def long_arcs(table: Pieces, word: str) -> list[list[tuple[int, int]]]:
    """By end: (letters, piece) of the pieces that end there."""
    ends: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
    for size, piece in enumerate(table.arcs([word]), 1):
        for i in np.nonzero(piece[0] >= 0)[0].tolist():
            ends[i + size].append((size, int(piece[0, i])))
    return ends


def long_forward(ends: list, logp: np.ndarray) -> list[np.ndarray]:
    """Log sums over the segmentations of the first j letters of one word, for each j and language."""
    a = [np.zeros(logp.shape[1])]
    for here in ends[1:]:
        a.append(np.logaddexp.reduce([a[len(a) - k] + logp[piece] for k, piece in here]))
    return a


def long_expected(ends: list, logp: np.ndarray, count: float) -> np.ndarray:
    """expected() of one long word, in logarithms."""
    a, n = long_forward(ends, logp[:, None]), len(ends) - 1
    b, got = np.full(n + 1, -np.inf), np.zeros(len(logp))
    b[n] = 0.0
    for j in range(n, 0, -1):
        for k, piece in ends[j]:
            use = b[j] + logp[piece]
            b[j - k] = np.logaddexp(b[j - k], use)
            got[piece] += count * np.exp(use + a[j - k][0] - a[n][0])
    return got


def by_length(words: list[str], most: int = 20_000):
    order: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        order.setdefault(len(w), []).append(k)
    for at in order.values():
        for i in range(0, len(at), most):
            yield np.array(at[i : i + most])


class Model:
    """Languages, their log priors, and log probabilities of the pieces."""

    def __init__(self, pieces: list[str], languages: list[str], priors: np.ndarray, logp: np.ndarray):
        self.pieces, self.languages, self.priors, self.logp = pieces, languages, priors, logp


def uses(table: Pieces, size: np.ndarray, prob: np.ndarray, words: list[str], count: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of one language."""
    got, logp = np.zeros(len(prob)), np.log(prob)
    for at in by_length(words):
        if len(words[at[0]]) > LONG:
            for k in at:
                got += long_expected(long_arcs(table, words[k]), logp, count[k])
        else:
            got += expected(table.arcs([words[k] for k in at]), size, prob, count[at])
    return got


def train(pieces: list[str], counts: DataFrame, shares: dict[str, float], rounds: int = ROUNDS) -> Model:
    """counts: (lang, word, count). Expected uses of pieces over all segmentations, then normalised with a floor; again and again.

    Words stay in Spark; a round gathers a number for each piece and language.
    """
    languages, size = sorted(shares), np.array([len(p) for p in pieces] + [1])
    p = 0.02 ** (size - 1.0) + 1e-12
    probs = np.repeat(p[:, None] / p.sum(), len(languages), 1)
    for _ in range(rounds):

        def expect(batches, probs=probs):
            table = common.kept(("pieces", len(pieces)), lambda: Pieces(pieces))
            for b in common.gathered(batches):
                lang, words, n = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist(), b.column(2).to_numpy().astype(float)
                for k, name in enumerate(languages):
                    mine = np.nonzero(lang == name)[0]
                    if len(mine):
                        got = uses(table, size, probs[:, k], [words[i] for i in mine], n[mine])
                        at = np.nonzero(got)[0]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(got[at])], ["lang", "piece", "n"])

        found = counts.select("lang", "word", "count").mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        got = np.zeros_like(probs)
        got[found.column("piece").to_numpy(), found.column("lang").to_numpy()] = found.column("n").to_numpy()
        probs = got / np.maximum(got.sum(0), 1e-9) + FLOOR
        probs[-1] = UNKNOWN
        probs /= probs.sum(0)
    return Model(pieces, languages, np.log(np.array([shares[x] for x in languages])), np.log(probs))


class Scorer:
    """A model with the scores of the words met so far (a bounded number)."""

    def __init__(self, model: Model):
        self.model, self.table, self.prob = model, Pieces(model.pieces), np.exp(model.logp)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, summed over all segmentations."""
        found = np.empty((len(words), len(self.model.languages)))
        for at in by_length(words, 8192):
            if len(words[at[0]]) > LONG and len(at) < 8:
                for k in at:
                    found[k] = long_forward(long_arcs(self.table, words[k]), self.model.logp)[-1]
            else:
                found[at] = forward(self.table.arcs([words[k] for k in at]), self.prob)
        return found

    def predict(self, texts: list[list[str]]) -> tuple[list[str], np.ndarray]:
        if len(self.known) > KNOWN_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        new = [*{w: None for t in texts for w in t if w not in self.known}]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.scores = np.vstack([self.scores, self.word_scores(new)])
        names, probs = [], np.zeros(len(texts))
        for k, t in enumerate(texts):
            if not t:
                names.append("und")
                continue
            z = self.scores[np.array([*map(self.known.__getitem__, t)])].sum(0) + self.model.priors
            best = int(z.argmax())
            names.append(self.model.languages[best])
            probs[k] = 1 / np.exp(z - z[best]).sum()
        return names, probs


def fit(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of the languages among the rows that may be learnt from; None if there are none."""
    rows = common.pick(docs, id_col, text_col, lang_col).toDF("id", "text", "lang").filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.filter(F.crc32(F.col("id").cast("string")) % 4 != 2)
    ids = common.written(rows.select("id", "lang").distinct().withColumn("h", F.xxhash64("id")), "learnable-ids")  # an id counts once for a language
    totals = {r.lang: r["count"] for r in ids.groupBy("lang").count().collect()}  # a row for each language
    if not totals:
        return None
    # twice the sample by hash, so that no language's rows all meet in one task to be ranked
    shares = docs.sparkSession.createDataFrame([*totals.items()], "lang string, count long")
    near = ids.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 40)) < F.lit(float(2 << 40) * sample) / F.col("count"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = near.withColumn("n", rank).filter(F.col("n") <= sample).select("id", "lang")

    def some(batches):
        for b in batches:
            langs, words = [], []
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words_of(text)
                langs += [lang] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], ["lang", "word"])

    picked = rows.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))  # `sample` ids of each language at most
    counts = common.written(picked.select("text", "lang").mapInArrow(some, "lang string, word string").groupBy("lang", "word").count(), "words")
    words = {r.lang: r["count"] for r in counts.groupBy("lang").count().collect()}  # a row for each language
    learnt, counts = {*words}, counts.repartition(max(1, sum(words.values()) // TASK_WORDS))
    total = sum(totals[x] for x in learnt)
    return train(vocabulary(path), counts, {x: totals[x] / total for x in learnt}) if learnt else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, lang_pred, score) of every text."""
    common.small_batches(docs.sparkSession)
    docs = common.pick(docs, id_col, text_col)
    if model is None:
        return docs.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    key = str(zlib.crc32(model.logp.tobytes()))

    def run(batches):
        s = common.kept(("language", key), lambda: Scorer(model))
        for b in common.slices(batches, text_col, 4 << 20):
            names, probs = s.predict([words_of(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(probs)], [id_col, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
