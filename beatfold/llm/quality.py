"""Quality rules: counts of words and lines, and a linear-chain conditional random field that tells content from boilerplate lines.

A text is a sequence of lines. The field has two states (content, boilerplate), a weight for each measure of a line and one for each
pair of neighbouring states; its likeliest state sequence (Viterbi) marks every line, and the share of words on content lines decides
whether the text is kept. It is learnt in numpy from document labels: lines of good documents are content; lines of bad ones start as
boilerplate, and are marked anew by the field learnt so far (at least the likeliest line stays boilerplate), ROUNDS times. Learning
takes SAMPLE documents of each label at most, of those with at most LEARN_LINES lines; every text is judged whole.

Nulls: a null text has no words and fails; a null id stays and is not learnt from, nor are null labels, labels other than 0 and 1, or
ids whose labels disagree. Texts of blanks alone have no words. Repeated rows are judged alike. Without rows of both labels every line
counts as content. Empty tables give empty results; extra columns are ignored. Ties of two state sequences go to content.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.llm import common

SAMPLE, LEARN_LINES, ROUNDS = 1000, 200, 3
STEPS, RATE, RIDGE = 100, 0.1, 1e-3
LEAST_WORDS, MOST_REPEATED, CONTENT = 50, 50, 0.5
SYMBOLS = r"[#*$%&|<>]"


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each row, as many as its size."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of as many neighbouring values as each size."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(size)
    return total[ends] - total[ends - size]


class Lines:
    """The lines of a batch of texts: distinct lines with their words, and which of them each text has.

    `of` holds a distinct line for each line, `n_lines` how many lines a text has; `word` the words of the distinct lines as
    numbers, `n_words` how many each has.
    """

    def __init__(self, texts: pa.Array):
        parts = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), "\n")
        coded = parts.flatten().dictionary_encode()
        self.text, self.of = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.n_lines = np.diff(parts.offsets.to_numpy())
        self.doc = np.repeat(np.arange(len(texts)), self.n_lines)
        words = pc.ascii_split_whitespace(self.text)
        flat, bounds = words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()
        some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        before = np.append(0, np.cumsum(some))
        self.n_words = before[bounds[1:]] - before[bounds[:-1]]
        coded = flat.filter(pa.array(some)).dictionary_encode()
        self.word, self.vocabulary = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
        self.start = np.cumsum(self.n_words) - self.n_words
        self.word_chars = sums(pc.utf8_length(coded.dictionary).to_numpy()[self.word] if len(self.word) else self.word, self.n_words)

    def by_doc(self, of_line: np.ndarray) -> np.ndarray:
        """Sums over each text's lines of a number of each distinct line."""
        return sums(of_line[self.of], self.n_lines)

    def earlier(self) -> np.ndarray:
        """Is each line with a word equal to an earlier line of its text?"""
        key = pd.Series(self.doc * max(1, len(self.text)) + self.of)
        return key.duplicated().to_numpy() & (self.n_words[self.of] > 0)

    def repeated_words(self) -> np.ndarray:
        """Of each text, the words in windows of three words that it holds twice or more."""
        size = self.n_words[self.of]
        words, doc = self.word[spread(self.start[self.of], size)], np.repeat(self.doc, size)
        held = np.zeros(len(words), bool)
        if len(words) > 2:
            at = np.nonzero(doc[:-2] == doc[2:])[0]
            pair, _ = pd.factorize(words[at] * self.vocabulary + words[at + 1])
            three, kinds = pd.factorize(pair * self.vocabulary + words[at + 2])
            window, _ = pd.factorize(doc[at] * max(1, len(kinds)) + three)
            again = at[np.bincount(window, minlength=1)[window] > 1] if len(at) else at
            for k in range(3):
                held[again + k] = True
        return np.bincount(doc[held], minlength=len(self.n_lines))

    def measures(self) -> np.ndarray:
        """A row of measures for each line."""
        text = self.text
        count = lambda p: pc.count_substring_regex(text, p).to_numpy().astype(float)
        size, letters, n = np.maximum(pc.utf8_length(text).to_numpy(), 1), count(r"\p{L}"), self.n_words
        some = np.maximum(n, 1)
        row = np.repeat(np.arange(len(text)), n)
        twice = pd.Series(row * self.vocabulary + self.word).duplicated().to_numpy()
        follow = np.append(False, (row[1:] == row[:-1]) & (self.word[1:] == self.word[:-1])) if len(row) else np.zeros(0, bool)
        end, first = (pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False) for p in (r"[.?!:;,\"')]\s*$", r"^\s*\p{Lu}"))
        of_line = [
            np.minimum(1, 4 * count(SYMBOLS) / size),
            np.where(letters >= 10, count(r"\p{Lu}") / np.maximum(letters, 1), 0),
            np.minimum(1, count(r"[!?]") / some),
            np.where(n >= 8, sums(twice, n) / some, 0),
            np.where(n >= 4, sums(follow, n) / some, 0),
            letters / size,
            count(r"\p{Nd}") / size,
            np.minimum(1, count(r"[@/\\=_{}\[\]]") / some),
            n == 0,
            (n > 0) & (n < 4),
            n > 100,
            np.minimum(self.word_chars / some, 20) / 10,
            end,
            first,
        ]
        place = np.arange(len(self.of)) - np.repeat(np.cumsum(self.n_lines) - self.n_lines, self.n_lines)
        of_place = [self.earlier(), place == 0, np.ones(len(self.of))]
        return np.column_stack([*(np.asarray(x, np.float32)[self.of] for x in of_line), *(np.asarray(x, np.float32) for x in of_place)])


MEASURES = 17


class Field:
    """Weights of the measures for the state boilerplate (content has 0), and of pairs of neighbouring states."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step

    def _places(self, n_lines: np.ndarray):
        """Lines of all texts by their place: longest texts first, so that those that have a place come first."""
        order = np.argsort(-n_lines, kind="stable")
        start, n = (np.cumsum(n_lines) - n_lines)[order], n_lines[order]
        alive = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")
        return start, alive

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.zeros(len(x)), x @ self.emit])

    def viterbi(self, x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """The likeliest state of every line, in its text's likeliest sequence."""
        own, (start, alive) = self.scores(x), self._places(n_lines)
        back, best = np.zeros((len(x), 2), np.int8), own.copy()
        for t in range(1, len(alive)):
            at = start[: alive[t]] + t
            way = best[at - 1][:, :, None] + self.step
            back[at] = way[:, 1] > way[:, 0]
            best[at] += way.max(1)
        state = (best[:, 1] > best[:, 0]).astype(np.int8)  # right for each text's last line
        for t in range(len(alive) - 1, 0, -1):
            at = start[: alive[t]] + t
            state[at - 1] = back[at, state[at]]
        return state

    def marginals(self, x: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of boilerplate of every line, and the expected number of each pair of neighbouring states."""
        own, (start, alive) = self.scores(x), self._places(n_lines)
        fore, aft = own.copy(), np.zeros_like(own)
        for t in range(1, len(alive)):
            at = start[: alive[t]] + t
            fore[at] += np.logaddexp(*np.moveaxis(fore[at - 1][:, :, None] + self.step, 1, 0))
        for t in range(len(alive) - 1, 0, -1):
            at = start[: alive[t]] + t
            aft[at - 1] = np.logaddexp(*np.moveaxis(self.step + (own[at] + aft[at])[:, None, :], 2, 0))
        pairs = np.zeros((2, 2))
        for t in range(1, len(alive)):
            at = start[: alive[t]] + t
            z = fore[at - 1][:, :, None] + self.step + (own[at] + aft[at])[:, None, :]
            z = np.exp(z - z.max((1, 2), keepdims=True))
            pairs += (z / z.sum((1, 2), keepdims=True)).sum(0)
        both = fore + aft
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs


def learn(x: np.ndarray, n_lines: np.ndarray, bad: np.ndarray) -> Field:
    """A field from lines of texts and their labels, by gradient ascent (Adam) of the conditional likelihood."""
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    state, field = bad[doc].astype(np.int8), Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    inner = np.nonzero(doc[1:] == doc[:-1])[0]
    for round_ in range(ROUNDS):
        if round_:
            z = x @ field.emit
            state = np.where(bad[doc], field.viterbi(x, n_lines), 0).astype(np.int8)
            best = pd.Series(z).groupby(doc).idxmax().to_numpy()
            state[best[bad]] = 1
        seen = np.zeros((2, 2))
        np.add.at(seen, (state[inner], state[inner + 1]), 1)
        p, m, v = np.concatenate([field.emit, field.step.ravel()]), 0.0, 0.0
        for n in range(1, STEPS + 1):
            field = Field(p[:-4], p[-4:].reshape(2, 2))
            chance, pairs = field.marginals(x, n_lines)
            g = np.concatenate([x.T @ (state - chance), (seen - pairs).ravel()]) / len(x) - RIDGE * p
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p + RATE * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
        field = Field(p[:-4], p[-4:].reshape(2, 2))
    return field


def learnable(labels: DataFrame, target: str, id_col: str) -> DataFrame:
    """(id, y) of labelled rows, one for each id; every fifth id by hash is left for measuring."""
    rows = common.pick(labels, id_col, target).toDF("id", "y").filter("id IS NOT NULL AND y IN (0, 1)")
    rows = rows.filter(F.crc32(F.col("id").cast("string")) % 5 != 0)
    return rows.groupBy("id").agg(F.min("y").cast("int").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", sample: int = SAMPLE) -> Field | None:
    """A field from at most `sample` rows of each label; None if a label has no row."""
    known = learnable(labels, target, id_col)
    order = F.xxhash64("id")
    chosen = known.filter("y = 1").orderBy(order).limit(sample).union(known.filter("y = 0").orderBy(order).limit(sample))
    rows = common.pick(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(chosen), "id")  # 2 * sample ids at most
    rows = rows.filter("text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def run(batches):
        for b in common.slices(batches, "text"):
            lines = Lines(b.column(1))
            x, ends = lines.measures(), np.cumsum(lines.n_lines)
            few = lines.n_lines <= LEARN_LINES
            data = [x[e - n : e].astype("<f4").tobytes() if ok else None for e, n, ok in zip(ends, lines.n_lines, few, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(data, pa.binary())], ["id", "y", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, y int, x binary").filter("x IS NOT NULL").collect()  # 2 * sample rows of LEARN_LINES lines at most
    got.sort(key=lambda r: r.id)
    if len({r.y for r in got}) < 2:
        return None
    parts = [np.frombuffer(r.x, "<f4").reshape(-1, MEASURES) for r in got]
    return learn(np.concatenate(parts).astype(float), np.array([*map(len, parts)]), np.array([r.y == 0 for r in got]))


def judge(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", content: float = CONTENT) -> DataFrame:
    """(<id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share) of every text.

    content_share: of its words, those on content lines (0.0 without words); kept: base rules hold and the share is `content` or more.
    """
    docs = common.pick(docs, id_col, text_col)
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def run(batches):
        for b in common.slices(common.gathered(batches, 4 << 20), text_col):
            lines = Lines(b.column(1))
            size = lines.n_words[lines.of]
            n = sums(size, lines.n_lines)
            marked = field.viterbi(lines.measures(), lines.n_lines) if field else np.zeros(len(lines.of), np.int8)
            share = sums(np.where(marked == 0, size, 0), lines.n_lines) / np.maximum(n, 1)
            again = lines.repeated_words()
            failed = (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)
            symbols = pc.count_substring_regex(lines.text, SYMBOLS).to_numpy().astype(np.int64)
            found = (n, lines.by_doc(lines.word_chars), lines.by_doc(symbols), sums(lines.earlier(), lines.n_lines), again)
            columns = [b.column(0), *(pa.array(x.astype(np.int64)) for x in found), *map(pa.array, (failed, ~failed & (share >= content), share))]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{n} long" for n in names[1:6]) + ", base_failed boolean, kept boolean, content_share double")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, common.table(spark, sf_dir, "labels")))
