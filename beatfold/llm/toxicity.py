"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is lower-cased and cut into words; a step of the network sees a word as a hashed word embedding and the mean of the
embeddings of its hashed character n-grams (sizes 3 to 6, with marks for both ends). All windows of 32 words that overlap by half
are scored; a text's logit is that of its most toxic window, put on the scale of probabilities by a logistic fit and the shares of the classes. The network
learns from document labels alone (many windows, one label), from every learnable row (one of an id) with all its windows: a start is
learnt from SAMPLE rows of each class; where there are more, all rows are dealt into groups of about GROUP, each group takes the start
once over its own rows, and the changes are averaged, row by row of the tables over the groups that met it. A tenth of all rows sets the
scale of the probabilities. Scoring covers every word of every text.

Nulls: a null or empty text is scored as one empty window; null ids stay, are not held out, and are never learnt from; null
labels are not learnt from, nor documents whose labels disagree. Repeated rows get equal scores. Words over 32 letters are taken
in parts of 32. Without learnable rows of both classes every score is the share of label 1 (0.0 without any). Empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.llm import common

WINDOW, STRIDE = 32, 16
SAMPLE = 1000
GROUP, GROUP_BYTES, FAN = 4000, 64 << 20, 64
WORD_BITS, GRAM_BITS, WORD_DIM, GRAM_DIM, HIDDEN = 13, 16, 8, 16, 8
GRAMS, LETTERS = (3, 4, 5, 6), 32
EPOCHS, BATCH, RATE, SEED, DECAY = 8, 32, 0.01, 7, 0.01
LEAST_STEPS, DROPPED = 225, 0.3
LATER_BATCH, LATER_RATE = 128, 0.002
KNOWN_WORDS = 250_000
AT_ONCE, KEPT_WINDOWS = 1024, 8192
BROADCAST_KEYS = 1_000_000
PART = 4096
CUTOFF = 0.7
_WORD = re.compile(r"\w{1,32}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Numbers(dict):
    """Numbers of words from 1, given as they are met; `new` lists those met since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = len(self) + 1
        return len(self)

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        flat = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int32)
        return np.split(flat, np.cumsum([len(t) for t in texts])[:-1])


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The order of the words by length, longest first, and in this order: rows of the word table; rows of the n-gram table, an array for
    each place of an n-gram, which the first so many words have; and how many n-grams each word has."""
    chars = np.array(words, dtype=f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS)
    size = (chars > 0).sum(1)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    x = np.zeros((LETTERS + 2, len(words)), np.uint64)
    x[1:-1] = chars[order].T
    x[0] = 2
    x[size + 1, np.arange(len(words))] = 3
    mix = np.uint64(0x9E3779B97F4A7C15)
    whole = np.zeros(len(words), np.uint64)
    for c in x:
        whole = (whole ^ c) * mix
    grams = []
    for n in GRAMS:
        for at in range(size[0] + 3 - n if len(size) else 0):
            h = np.full(np.searchsorted(-size, 2 - n - at, "right"), n, np.uint64)
            for c in x[at : at + n]:
                h = (h ^ c[: len(h)]) * mix
                h ^= h >> np.uint64(29)
            grams.append((h >> np.uint64(64 - GRAM_BITS)).astype(np.intp))
    return order, (whole >> np.uint64(64 - WORD_BITS)).astype(np.intp), grams, sum(np.maximum(size + 3 - n, 0) for n in GRAMS)


def windows_of(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n words; the last one holds the last word."""
    return np.arange(0, max(n - STRIDE, 1), STRIDE)


def window_rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) word numbers, 0 where a text has ended; and how many windows each text has."""
    flat = np.concatenate([*docs, np.zeros(1, np.int32)]).astype(np.int32)
    size = np.array([len(d) for d in docs])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = np.array([len(windows_of(n)) for n in size])
    owner = np.repeat(np.arange(len(docs)), count)
    begin = STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    at = begin[:, None] + np.arange(WINDOW)
    return np.where(at < size[owner][:, None], flat[np.minimum(first[owner][:, None] + at, len(flat) - 1)], 0), count


def row_sums(rows: np.ndarray, size: int, columns) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, of a table of this size, and the sum of the values of each; the values come column by column."""
    touched = np.nonzero(np.bincount(rows, minlength=size))[0]
    return touched, np.stack([np.bincount(rows, c, size)[touched] for c in columns], 1)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights by name; both directions have their own GRU."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        w = lambda *s, by=0.3: (r.standard_normal(s) * by).astype(np.float32)
        self.w = {"words": w(1 << WORD_BITS, WORD_DIM), "grams": w(1 << GRAM_BITS, GRAM_DIM, by=0.6), "attend": w(2 * h), "out": w(2 * h), "bias": np.full(1, -1.0, np.float32)}
        for side in "fb":
            self.w |= {f"{side}W": w(d, 3 * h), f"{side}U": w(h, 3 * h), f"{side}c": np.zeros(3 * h, np.float32)}
        self.scale = (1.0, 0.0)

    def embed(self, words: list[str]):
        order, word, grams, count = inputs = word_inputs(words)
        chars = np.zeros((len(words), GRAM_DIM), np.float32)
        for rows in grams:
            chars[: len(rows)] += self.w["grams"].take(rows, 0)
        x = np.empty((len(words), WORD_DIM + GRAM_DIM), np.float32)
        x[order] = np.hstack([self.w["words"][word], chars / np.sqrt(count)[:, None].astype(np.float32)])
        return x, inputs

    def projected(self, x: np.ndarray) -> np.ndarray:
        """(3 gates, 2 directions, words + 1, HIDDEN) inputs of each word to the update and reset gates (with the sign that exp takes
        in a sigmoid) and to the candidate; row 0 is the end of a text, where the update gate keeps the state."""
        out = np.zeros((3, 2, len(x) + 1, HIDDEN), np.float32)
        out[0, :, 0] = 30
        for i, side in enumerate("fb"):
            out[:, i, 1:] = (x @ self.w[f"{side}W"] + self.w[f"{side}c"]).reshape(len(x), 3, HIDDEN).swapaxes(0, 1)
        out[:2] *= -1
        return out

    def inner(self) -> np.ndarray:
        """(3 gates, 2 directions, HIDDEN, HIDDEN) weights between states."""
        return np.ascontiguousarray(np.stack([self.w[f"{side}U"].reshape(HIDDEN, 3, HIDDEN).swapaxes(0, 1) for side in "fb"], 1))

    @np.errstate(over="ignore")  # where exp is infinite the gate is 0
    def states(self, table: np.ndarray, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(WINDOW + 1, 2, windows, HIDDEN) states before the first step and after each one; the second direction begins at the last word.
        keep gets what the way back needs."""
        n, size = len(rows), table.shape[2]
        at = np.stack([rows.T, rows.T[::-1] + size], 1).astype(np.intp)
        gates, flat = 2 * size * np.arange(3)[:, None, None], table.reshape(-1, HIDDEN)
        u = self.inner()
        u[:2] *= -1
        out = np.zeros((WINDOW + 1, 2, n, HIDDEN), np.float32)
        g, hu, zr, c = (np.empty((*k, 2, n, HIDDEN), np.float32) for k in ((3,), (3,), (2,), ()))
        for t in range(WINDOW):
            h = out[t]
            flat.take(at[t] + gates, 0, g, "clip")
            np.matmul(h, u, hu)
            np.add(g[:2], hu[:2], zr)
            np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            np.multiply(zr[1], hu[2], c)
            c += g[2]
            np.tanh(c, c)
            if keep is not None:
                keep.append((zr.copy(), c.copy(), hu[2].copy()))
            np.subtract(h, c, out[t + 1])
            out[t + 1] *= zr[0]
            out[t + 1] += c
        return out

    def pooled(self, rows: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(WINDOW, windows) attention to each word, and what its states add to the logit; and the windows' logits."""
        both = np.stack([self.w["attend"].reshape(2, HIDDEN), self.w["out"].reshape(2, HIDDEN)], 2)
        e, o = np.moveaxis(states[1:, 0] @ both[0] + (states[1:, 1] @ both[1])[::-1], 2, 0)
        e = np.where((rows == 0).T, np.float32(-1e4), e)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        return a, o, (a * o).sum(0) + self.w["bias"][0]

    def logits(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of every window; so many at once that the arrays of a step stay in a processor's cache."""
        parts = (rows[i : i + AT_ONCE] for i in range(0, len(rows), AT_ONCE))
        return np.concatenate([self.pooled(part, self.states(table, part))[2] for part in parts])

    def pass_over(self, table: np.ndarray, rows: np.ndarray) -> tuple:
        """States, what the way back needs of each step, attention, what states add, and the windows' logits."""
        keep: list = []
        h = self.states(table, rows, keep)
        return (h, keep, *self.pooled(rows, h))

    def taken_back(self, rows: np.ndarray, dwin: np.ndarray, passed: tuple, g: dict, du: np.ndarray, per: np.ndarray) -> None:
        """Adds to g, du and per (gate inputs of each word) what the windows add to the gradient."""
        h, keep, a, o, _ = passed
        part = a * dwin
        de = part * o
        de -= a * de.sum(0)
        ways = [(part, de), (part[::-1], de[::-1])]
        for k, name in enumerate(("out", "attend")):
            g[name] += np.concatenate([h[1:, i].reshape(-1, HIDDEN).T @ way[k].reshape(-1) for i, way in enumerate(ways)])
        both = np.stack([self.w["out"].reshape(2, HIDDEN), self.w["attend"].reshape(2, HIDDEN)], 1)
        dh = np.stack([np.stack(way, 2) @ both[i] for i, way in enumerate(ways)], 1)
        back, ut = np.zeros((2, len(rows), HIDDEN), np.float32), np.ascontiguousarray(self.inner().swapaxes(2, 3))
        gates = np.empty((WINDOW, 3, 2, len(rows), HIDDEN), np.float32)
        inner = np.empty((3, 2, len(rows), HIDDEN), np.float32)
        for t in reversed(range(WINDOW)):
            (z, r), c, un = keep.pop()
            d = dh[t]
            d += back
            to = gates[t]
            to[2] = d * (1 - z) * (1 - c * c)
            to[0] = d * (h[t] - c) * z * (1 - z)
            to[1] = to[2] * un * r * (1 - r)
            inner[:2] = to[:2]
            np.multiply(to[2], r, inner[2])
            du += h[t].swapaxes(1, 2) @ inner
            back = d * z + (inner @ ut).sum(0)
        for i in range(2):
            at = (rows.T[::-1] if i else rows.T).reshape(-1)
            for k, v in enumerate(gates[:, :, i].transpose(1, 3, 0, 2).reshape(3 * HIDDEN, -1)):
                per[i, k] += np.bincount(at, v, per.shape[2])

    def gradients(self, words, rows, count, label, weight=1.0, least: float = 0.0):
        """Loss and gradients of a batch of texts; a text's logit is a smooth maximum over its windows. least: of the windows' parts in
        the gradient, the smallest, which make up this share of their sum, are not taken back through the network."""
        x, (order, word, grams, n_grams) = self.embed(words)
        table, held = self.projected(x), {}
        if least or len(rows) > KEPT_WINDOWS:
            win = self.logits(table, rows)
        else:
            held = {i: self.pass_over(table, rows[i : i + AT_ONCE]) for i in range(0, len(rows), AT_ONCE)}
            win = np.concatenate([p[4] for p in held.values()])
        owner = np.repeat(np.arange(len(count)), count)
        top = np.maximum.reduceat(win, np.cumsum(count) - count)
        share = np.exp(2 * (win - top[owner]))
        share /= np.bincount(owner, share)[owner]
        logit = np.bincount(owner, share * win)
        prob = sigmoid(logit)
        dwin = (share * ((prob - label) * weight / len(label))[owner]).astype(np.float32)
        used = np.ones(len(words), bool)
        if least:
            small = np.argsort(np.abs(dwin))
            at = np.sort(small[np.cumsum(np.abs(dwin[small]), dtype=float) > least * np.abs(dwin).sum(dtype=float)])
            rows, dwin = rows[at], dwin[at]
            used[:] = False
            used[rows[rows > 0] - 1] = True
        h = HIDDEN
        g = {"bias": dwin.sum(keepdims=True), "out": np.zeros(2 * h, np.float32), "attend": np.zeros(2 * h, np.float32)}
        du, per = np.zeros((3, 2, h, h), np.float32), np.zeros((2, 3 * h, len(x) + 1))
        for i in range(0, len(rows), AT_ONCE):  # so many windows at once as stay in a cache
            part = rows[i : i + AT_ONCE]
            self.taken_back(part, dwin[i : i + AT_ONCE], held.pop(i, None) or self.pass_over(table, part), g, du, per)
        dx = np.zeros_like(x)
        for i, side in enumerate("fb"):
            own = np.ascontiguousarray(per[i, :, 1:].T, dtype=np.float32)
            g[f"{side}U"] = du[:, i].swapaxes(0, 1).reshape(h, 3 * h)
            g[f"{side}W"], g[f"{side}c"] = x.T @ own, own.sum(0)
            dx += own @ self.w[f"{side}W"].T
        dx, used, sparse = dx[order], used[order], {}
        if used.any():
            sparse["words"] = row_sums(word[used], 1 << WORD_BITS, dx[used, :WORD_DIM].T)
            gram, owner = np.concatenate(grams), np.concatenate([np.arange(len(v)) for v in grams])
            gram, owner = gram[used[owner]], owner[used[owner]]
            sparse["grams"] = row_sums(gram, 1 << GRAM_BITS, (v[owner] for v in (dx[:, WORD_DIM:] / np.sqrt(n_grams)[:, None]).T.copy()))
        return float(-np.log(np.maximum(np.where(label == 1, prob, 1 - prob), 1e-7)).mean()), g, sparse


class Adam:
    """Steps of a network's weights."""

    def __init__(self, net: Network):
        self.net, self.n = net, 0
        self.one, self.two = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))

    def step(self, grads: dict, sparse: dict, rate: float, decay: float) -> None:
        self.n += 1
        rate *= np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, (touched, v) in [*((k, (..., v)) for k, v in grads.items()), *sparse.items()]:
            m, q = self.one[k][touched], self.two[k][touched]
            m += 0.1 * (v - m)
            q += 0.001 * (v * v - q)
            self.one[k][touched], self.two[k][touched] = m, q
            self.net.w[k][touched] -= (rate * m / (np.sqrt(q) + 1e-8) + decay * self.net.w[k][touched]).astype(np.float32)


def batch_rows(texts: list[list[str]], r: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, rows of windows, windows of each text); words are left out at random, so that rare ones are not learnt by heart."""
    number = Numbers()
    rows, count = window_rows(number.of(texts))
    return number.new, np.where(r.random(rows.shape) < DROPPED, 0, rows), count


def train(texts: list[list[str]], label: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, apart: np.ndarray | None = None) -> Network:
    """texts: words of each. A tenth (or the rows named by `apart`) is kept apart for the logistic scale."""
    net, r = Network(seed), np.random.default_rng(seed)
    apart = np.arange(len(texts)) % 10 == 9 if apart is None else apart
    learn = np.nonzero(~apart)[0]
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(learn)))
    adam = Adam(net)
    for epoch in range(epochs):
        for at in np.array_split(r.permutation(learn), max(1, len(learn) // BATCH)):
            if not any(texts[i] for i in at):
                continue
            words, rows, count = batch_rows([texts[i] for i in at], r)
            _, grads, sparse = net.gradients(words, rows, count, label[at])
            adam.step(grads, sparse, RATE * min(1, 2 * (1 - epoch / epochs)), DECAY * RATE)
    held = np.nonzero(apart)[0] if len({*label[apart]}) == 2 else np.arange(len(texts))
    z, y = Scorer(net).logits([texts[i] for i in held]), label[held]

    def sums(a: float, b: float) -> tuple:
        q = sigmoid(a * z + b)
        v = q * (1 - q) + 1e-6
        return ((q - y) * z).sum(), (q - y).sum(), (v * z * z).sum(), (v * z).sum(), v.sum()

    net.scale = logistic(sums)
    return net


def trained_further(net: Network, texts: list[list[str]], label: np.ndarray, weight: np.ndarray, seed: int = SEED) -> Network:
    """The network, taken once over the texts in their order, at a rate that falls to nothing."""
    own, r = Network(seed), np.random.default_rng(seed)
    own.w = {k: v.copy() for k, v in net.w.items()}
    adam, steps = Adam(own), max(1, len(texts) // LATER_BATCH)
    for i, at in enumerate(np.array_split(np.arange(len(texts)), steps)):
        if any(texts[j] for j in at):
            words, rows, count = batch_rows([texts[j] for j in at], r)
            _, grads, sparse = own.gradients(words, rows, count, label[at], weight[at])
            adam.step(grads, sparse, LATER_RATE * (1 - i / steps), 0.0)
    return own


def logistic(sums, most: int = 200) -> tuple[float, float]:
    """Logistic fit of the scale (a, b), by Newton steps with a prior at a = 1. sums(a, b): of the gradient by a and b, and of the second
    derivatives by aa, ab and bb."""
    a, b = 1.0, 0.0
    for _ in range(most):
        ga, gb, haa, hab, hbb = sums(a, b)
        da, db = np.linalg.solve(np.array([[haa + 0.5, hab], [hab, hbb + 0.05]]), np.array([ga + 0.5 * (a - 1), gb + 0.05 * b]))
        before = a, b
        a, b = float(np.clip(a - np.clip(da, -0.5, 0.5), 0.1, 5)), b - float(np.clip(db, -0.5, 0.5))
        if abs(a - before[0]) + abs(b - before[1]) < 1e-9:
            break
    return a, b


class Scorer:
    """A network with the gate inputs of the words met so far (a bounded number)."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self):
        self.number = Numbers()
        self.table = self.net.projected(np.zeros((0, WORD_DIM + GRAM_DIM), np.float32))

    def learn(self, words: list[str]) -> None:
        if words:
            x = np.vstack([self.net.embed(words[i : i + 8192])[0] for i in range(0, len(words), 8192)])
            self.table = np.concatenate([self.table, self.net.projected(x)[:, :, 1:]], 2)

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """Each text's highest window logit."""
        if len(self.number) > KNOWN_WORDS:
            self.reset()
        rows, count = window_rows(self.number.of(texts))
        self.learn(self.number.new)
        self.number.new = []
        return np.maximum.reduceat(self.net.logits(self.table, rows), np.cumsum(count) - count)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        a, b = self.net.scale
        return sigmoid(a * self.logits(texts).astype(np.float64) + b)


def learnable(labels: DataFrame, target: str, id_col: str) -> DataFrame:
    """(id, y) of labelled rows outside the held-out third, one for each id; ids with labels that disagree are left out."""
    rows = common.pick(labels, id_col, target).toDF("id", "y").filter("id IS NOT NULL AND y IN (0, 1)")
    rows = rows.filter(F.crc32(F.col("id").cast("string")) % 3 != 1)
    return rows.groupBy("id").agg(F.min("y").cast("int").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")


def from_all(net: Network, rows: DataFrame, weight: dict[int, float]) -> None:
    """Takes the network over all rows (id, text, y, h), one text of an id. Groups of rows are trained apart from the same start; of a row
    of the word and n-gram tables, the changes by those groups are averaged that met it, of the other weights those by all."""
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-n // GROUP), -(-(size or 0) // GROUP_BYTES))
    tables = {k: net.w[k].shape for k in ("words", "grams")}
    parts = [(k, at) for k, v in net.w.items() for at in range(0, len(v) if k in tables else 1, PART)]
    schema = "part int, grp long, change binary, met binary"
    kinds = pa.schema([("part", pa.int32()), ("grp", pa.int64()), ("change", pa.binary()), ("met", pa.binary())])

    def learn(key: tuple, t: pa.Table) -> pa.Table:
        texts: dict = {}
        for i, text, y, h in zip(*(t.column(c).to_pylist() for c in ("id", "text", "y", "h")), strict=True):
            texts[h, i] = (min((t for t in (text, texts.get((h, i), (None,))[0]) if t is not None), default=None), y)
        got = [texts[k] for k in sorted(texts)]
        own = trained_further(net, [words_of(x) for x, _ in got], np.array([y for _, y in got], float), np.array([weight[y] for _, y in got]))
        out = []
        for number, (k, at) in enumerate(parts):
            d = own.w[k] - net.w[k]
            d = d[at : at + PART] if k in tables else d
            seen = (d != 0).any(1) if k in tables else np.ones(1)
            out.append((number, key[0].as_py(), d.tobytes(), seen.astype(np.float32).tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    def add(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("before")
        total = [pa.array([sum(np.frombuffer(v.as_buffer(), np.float32).astype(float) for v in t.column(c)).astype(np.float32).tobytes()], pa.binary()) for c in ("change", "met")]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *total], schema=kinds)

    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)))
    found = common.written(dealt.repartition(4 * groups, "grp").groupBy("grp").applyInArrow(learn, schema), "learnt")  # a group is bounded
    while groups > 1:
        groups = -(-groups // FAN)
        found = found.withColumnRenamed("grp", "before").withColumn("grp", F.floor(F.col("before") / FAN)).groupBy("part", "grp").applyInArrow(add, schema)  # FAN groups
    for r in found.collect():  # the weights of one network
        k, at = parts[r.part]
        d, seen = np.frombuffer(r.change, np.float32), np.maximum(np.frombuffer(r.met, np.float32), 1)
        if k in tables:
            net.w[k][at : at + PART] += d.reshape(-1, tables[k][1]) / seen[:, None]
        else:
            net.w[k] += (d / seen).reshape(net.w[k].shape)


def scaled(net: Network, rows: DataFrame) -> None:
    """Sets the scale of the network by all rows (id, text, y) that were kept apart."""
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    net.scale = 1.0, 0.0
    z, p = F.col("z"), F.col("p")
    known = common.written(score(rows, net, "id", carry=("y",), raw=True).select("y", F.col("score").cast("double").alias("z")), "apart")
    if known.select("y").distinct().count() < 2:
        return

    def sums(a: float, b: float) -> tuple:
        q = known.select("y", "z", (0.5 * F.tanh(0.5 * (a * z + b)) + 0.5).alias("p"))
        v = p * (1 - p) + 1e-6
        return tuple(q.agg(F.sum((p - F.col("y")) * z), F.sum(p - F.col("y")), F.sum(v * z * z), F.sum(v * z), F.sum(v)).first())

    net.scale = logistic(sums, 50)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", sample: int = SAMPLE) -> Network | float:
    """A network, learnt from all learnable rows, from a start of at most `sample` rows of each class; or the share of label 1 if a class
    has no row."""
    known = learnable(labels, target, id_col)
    share = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    known = known.withColumn("h", F.xxhash64("id"))
    rows = common.pick(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(known) if sum(share.values()) <= BROADCAST_KEYS else known, "id")
    rows = common.written(rows, "learnable")
    ids = rows.select("id", "y", "h").distinct()
    sizes = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return float(max(sizes)) if sizes else 0.0
    chosen = ids.filter("y = 1").orderBy("h", "id").limit(sample).union(ids.filter("y = 0").orderBy("h", "id").limit(sample))
    found = rows.join(F.broadcast(chosen.select("id")), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"), F.min("h").alias("h"))
    got = sorted((r.id, r.text or "", r.y, r.h) for r in found.collect())  # 2 * sample rows at most
    label = np.array([y for _, _, y, _ in got], np.float64)
    order = np.random.default_rng(SEED).permutation(len(got))
    words = [words_of(got[i][1]) for i in order]
    if max(sizes.values()) <= sample:
        net = train(words, label[order])
        a, b = net.scale
        net.scale = a, b + float(np.log(share[1] / share[0]) - np.log(sizes[1] / sizes[0]))  # labelled ids without a document count in the shares
        return net
    apart = F.pmod("h", F.lit(10)) == 9
    net = train(words, label[order], apart=np.array([got[i][3] % 10 == 9 for i in order]))
    from_all(net, rows.filter(~apart), {y: sum(sizes.values()) / (2 * n) for y, n in sizes.items()})
    scaled(net, rows.filter(apart))
    a, b = net.scale
    net.scale = a, b + float(np.log(share[1] / share[0]) - np.log(sizes[1] / sizes[0]))
    return net


def score(docs: DataFrame, net: Network | float, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), raw: bool = False) -> DataFrame:
    """(<id_col>, *carry, score double) of every text; carry may hold the text column. raw: logits without scale."""
    common.small_batches(docs.sparkSession)
    again = text_col in carry
    docs = common.pick(docs, text_col, id_col, *(c for c in carry if c != text_col))
    if isinstance(net, float):
        return docs.select(id_col, *carry, F.lit(net).alias("score"))
    key = str((zlib.crc32(b"".join(v.tobytes() for v in net.w.values())), net.scale))

    def run(batches):
        s = common.kept(("toxicity", key), lambda: Scorer(net))
        for b in common.slices(batches, text_col, 2 << 20):
            found = (s.logits if raw else s.scores)([words_of(t) for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[1 - again :], pa.array(found, pa.float64())], [*b.schema.names[1 - again :], "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1 - again :])
    return docs.mapInArrow(run, f"{kinds}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    with common.scratch(spark):
        net = fit(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs, net)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
