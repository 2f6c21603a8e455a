"""Secrets in texts: fixed patterns, and formats learnt by grammar inference.

The base patterns label credentials in the corpus. All distinct values of each kind, and all other long runs, are counted in prefix
trees over character classes; the driver takes of each tree the NODES prefixes that most values share, with the counts of what follows,
and states whose counts are statistically compatible (Hoeffding bounds, tested down the tree) are merged into probabilistic automata: one
for each kind and one for ordinary runs. Where a tree has more prefixes, all its values are then counted along the states to their ends.
Every run of CANDIDATE letters, and every part of LEAST letters and more that base spans leave of one, is scored by
its log likelihood under the best credential automaton against the ordinary one (learnt from runs that no base span touches); those above a threshold set from all ordinary runs are added as `grammar` spans.
Base spans always stay. Spans count code points; ends are exclusive.

Nulls: a null text counts as empty (no spans); a null id stays. Repeated rows get equal spans. Very long runs are learnt from and scored whole. Equal starts are ordered by kind. A corpus without credentials or without
other runs adds no spans. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.llm import common

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more among those of [0-9a-f]+
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
LEAST, JOINTS = 12, "+/_.=-"
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "grammar")
ALPHA, MARGIN, RARE = 0.05, 20.0, 0.9995
NODES, HELD = 50_000, 200_000
BINS, FEW = 1024, 10_000
KNOWN = 200_000
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_CLASS = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "H" for c in "ABCDEF"}, **{c: "L" for c in "GHIJKLMNOPQRSTUVWXYZ"}})
SYMBOLS = "dhlHL+/_.=-"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def other_runs(text: str, base: list, whole: bool = False) -> list[tuple[int, int, str]]:
    """What base spans leave of candidate runs, where that is long enough; whole: only runs that touch no base span.

    Signs that join a part to a base span do not belong to it, unless it is too short without them.
    """
    found, taken, k, reach = [], sorted((s, e) for _, s, e, _ in base), 0, -1
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        at, parts = max(s, reach), []
        while k < len(taken) and taken[k][0] < e:
            parts.append((at, taken[k][0]))
            reach = max(reach, taken[k][1])
            at, k = max(at, reach), k + 1
        for a, z in [*parts, (at, e)]:
            if z - a < LEAST or (whole and (a, z) != (s, e)):
                continue
            b, y = a, z
            while a > s and b < y and text[b] in JOINTS:
                b += 1
            while z < e and b < y and text[y - 1] in JOINTS:
                y -= 1
            a, z = (b, y) if y - b >= LEAST else (a, z)
            found.append((a, z, text[a:z]))
    return found


class Automaton:
    """Probabilistic automaton by state merging: a prefix tree with counts, whose compatible states become one."""

    def __init__(self, values: list[str] = (), alpha: float = ALPHA, tree: list[tuple] = ()):
        """values: strings, each counted once; or tree: (total, ends, counts of the classes that follow, parent's place, class) of the nodes,
        the root first, each after its parent (what follows need not be a node)."""
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        self.total, self.ends, self.next, self.uses = [0], [0], [{}], [{}]
        for v in values:
            at = 0
            for c in v.translate(_CLASS):
                self.total[at] += 1
                self.uses[at][c] = self.uses[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.total)
                    self.total.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.uses.append({})
                at = self.next[at][c]
            self.total[at] += 1
            self.ends[at] += 1
        if tree:
            self.total, self.ends, self.uses = ([x[k] for x in tree] for k in range(3))
            self.next = [{} for _ in tree]
            for place, (*_, parent, c) in enumerate(tree[1:], 1):
                self.next[parent][c] = place
        self._merge()
        self._weigh()

    def _weigh(self) -> None:
        k = len(SYMBOLS) + 1
        self.cost = [{c: math.log((n + 0.1) / (t + 0.1 * k)) for c, n in u.items()} for u, t in zip(self.uses, self.total, strict=True)]
        self.stop = [math.log((e + 0.1) / (t + 0.1 * k)) for e, t in zip(self.ends, self.total, strict=True)]
        self.miss = [math.log(0.1 / (t + 0.1 * k)) for t in self.total]

    def counted(self, classes: str, n: int, found: dict) -> None:
        """Adds a string's n ways along the states to found: (state, class), or (state, "") for its end. What no state leads on to
        begins again at the first one, as in score."""
        at = 0
        for c in classes:
            found[at, c] = found.get((at, c), 0) + n
            at = self.next[at].get(c, 0)
        found[at, ""] = found.get((at, ""), 0) + n

    def recounted(self, found: dict) -> None:
        """Sets the counts of the states to those of `counted`."""
        self.total, self.ends, self.uses = [0] * len(self.total), [0] * len(self.ends), [{} for _ in self.uses]
        for (at, c), n in sorted(found.items()):
            self.total[at] += n
            if c:
                self.uses[at][c] = n
                self.next[at].setdefault(c, 0)
            else:
                self.ends[at] = n
        self._weigh()

    def _near(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) < self.slack * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.total[a], self.total[b]
            if not n1 or not n2:
                continue
            if not self._near(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.uses[a].keys() | self.uses[b].keys():
                if not self._near(self.uses[a].get(c, 0), n1, self.uses[b].get(c, 0), n2):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, n in self.uses[b].items():
                self.uses[a][c] = self.uses[a].get(c, 0) + n
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
                elif c in self.next[b]:
                    self.next[a][c] = self.next[b][c]

    def _merge(self) -> None:
        kept = [0]
        while True:
            known = set(kept)
            edge = [(-self.total[to], at, c, to) for at in kept for c, to in self.next[at].items() if to not in known]
            if not edge:
                return
            _, at, c, to = min(edge)
            into = next((r for r in kept if self._compatible(r, to)), None)
            if into is None:
                kept.append(to)
            else:
                self.next[at][c] = into
                self._fold(into, to)

    def score(self, classes: str) -> float:
        """Log likelihood of a string of classes."""
        at, total = 0, 0.0
        for c in classes:
            to = self.next[at].get(c)
            if to is None:
                total, at = total + self.miss[at], 0
            else:
                total, at = total + self.cost[at][c], to
        return total + self.stop[at]


class Grammar:
    """Automata of the credential kinds and of ordinary runs, and the threshold."""

    def __init__(self, kinds: list[Automaton], ordinary: Automaton | None):
        self.kinds, self.ordinary = kinds, ordinary
        self.known: dict[str, float] = {}
        self.threshold = math.inf

    def ratio(self, value: str) -> float:
        """Log likelihood ratio of the best credential format against ordinary runs."""
        classes = value.translate(_CLASS)
        got = self.known.get(classes)
        if got is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            got = self.known[classes] = max(a.score(classes) for a in self.kinds) - self.ordinary.score(classes)
        return got

    def spans(self, text: str) -> list[tuple[str, int, int, float | None]]:
        base = base_spans(text)
        ready = self.kinds and self.ordinary
        found = [(k, s, e, self.ratio(v) if ready else None) for k, s, e, v in base]
        if ready:
            found += [("grammar", s, e, r) for s, e, v in other_runs(text, base) if (r := self.ratio(v)) >= self.threshold]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _values(batches):
    """(kind, value) of the credentials, and as kind grammar of the runs that no base span touches; repeats within a task are few."""
    rows = lambda held: pa.RecordBatch.from_arrays([pa.array([x[c] for x in held], pa.string()) for c in (0, 1)], ["kind", "value"])
    held: set = set()
    for b in common.slices(batches, "text"):
        for text in b.column(0).to_pylist():
            if text:
                base = base_spans(text)
                held.update((x[0], x[3]) for x in base)
                held.update(("grammar", x[2]) for x in other_runs(text, base, whole=True))
            if len(held) > HELD:
                yield rows(held)
                held = set()
    if held:
        yield rows(held)


def _prefixes(batches):
    """(kind, node, parent, class, depth, total, ends) of strings (kind, classes, n): their prefixes, named by 63 bits of a polynomial."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    rows = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, *v) for k, v in held.items()), strict=True), types, strict=True)], ["kind", "node", "parent", "class", "depth", "total", "ends"])
    held: dict = {}
    for b in batches:
        for kind, classes, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            key = (kind, 0, 0, "", 0)
            for depth, c in enumerate(classes, 1):
                held.setdefault(key, [0, 0])[0] += n
                key = (kind, ((key[1] + ord(c)) * 0x5851F42D4C957F2D + 0x14057B7EF767814F) & ((1 << 63) - 1), key[1], c, depth)
                if len(held) > HELD:
                    yield rows(held)
                    held = {}
            at = held.setdefault(key, [0, 0])
            at[0], at[1] = at[0] + n, at[1] + n
    if held:
        yield rows(held)


def _tree(nodes: DataFrame, kind: str, most: int) -> list[tuple]:
    """The tree of at most `most` nodes that most values share, as Automaton takes it: a node's parent has no less, and comes before it."""
    nodes = nodes.filter(F.col("kind") == kind)
    follow = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("class", "total"))).alias("uses"))  # a few classes
    top = nodes.orderBy(F.desc("total"), "depth", "node").limit(most).join(follow, "node", "left").orderBy(F.desc("total"), "depth", "node")
    place, out = {}, []
    for r in top.collect():
        place[r.node] = len(out)
        out.append((r.total, r.ends, dict(r.uses or {}), place.get(r.parent, 0), r["class"]))
    return out


def _counts(strings: DataFrame, automata: dict[str, Automaton]) -> dict[str, dict]:
    """By kind, what Automaton.recounted takes: of all strings (kind, classes, n)."""

    def run(batches):
        found: dict = {k: {} for k in automata}
        for b in batches:
            for kind, classes, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                automata[kind].counted(classes, n, found[kind])
        rows = [(k, at, c, n) for k, f in found.items() for (at, c), n in f.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["kind", "state", "class", "n"])

    got: dict = {k: {} for k in automata}
    rows = strings.filter(F.col("kind").isin([*automata])).mapInArrow(run, "kind string, state int, class string, n long")
    for r in rows.groupBy("kind", "state", "class").agg(F.sum("n").alias("n")).collect():  # a row for each state and class
        got[r.kind][r.state, r["class"]] = r.n
    return got


def _kth(scores: DataFrame, share: float) -> float:
    """The value at place int(share * (n - 1)) of rows (s, n), in order of s; bins are cut again until few rows are left in one."""
    low, high, total = scores.agg(F.min("s"), F.max("s"), F.sum("n")).first()
    place = int(share * (total - 1))
    while low < high and scores.count() > FEW:
        bins = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in scores.groupBy(bins.alias("bin")).agg(F.sum("n").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect():
            if place < r.n:
                break
            place -= r.n
        low, high = r.low, r.high
        scores = scores.filter((F.col("s") >= low) & (F.col("s") <= high))
    if low == high:
        return low
    for r in scores.orderBy("s").collect():  # FEW rows
        if place < r.n:
            return r.s
        place -= r.n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Grammar of all the corpus's distinct credentials and ordinary runs."""
    common.small_batches(docs.sparkSession)
    docs = common.pick(docs, text_col).toDF("text")
    values = docs.mapInArrow(_values, "kind string, value string").distinct()
    source, target = "".join(map(chr, _CLASS)), "".join(_CLASS.values())
    strings = common.written(values.groupBy("kind", F.translate("value", source, target).alias("classes")).agg(F.count("*").alias("n")), "strings")
    prefixes = strings.mapInArrow(_prefixes, "kind string, node long, parent long, class string, depth long, total long, ends long")
    nodes = common.written(prefixes.groupBy("kind", "node", "parent", "class", "depth").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends")), "prefixes")
    size = {r.kind: r["count"] for r in nodes.groupBy("kind").count().collect()}
    automata = {k: Automaton(tree=_tree(nodes, k, NODES)) for k in sorted(size)}
    cut = {k: a for k, a in automata.items() if size[k] > NODES}
    for k, found in (_counts(strings, cut) if cut else {}).items():
        cut[k].recounted(found)
    grammar = Grammar([a for k, a in automata.items() if k != "grammar"], automata.get("grammar"))
    if not grammar.kinds or not grammar.ordinary:
        return grammar

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar.ratio(c) for c in b.column(0).to_pylist()], pa.float64()), b.column(1)], ["s", "n"])

    scores = common.written(strings.filter("kind = 'grammar'").select("classes", "n").mapInArrow(score, "s double, n long"), "scores")
    grammar.threshold = max(MARGIN, _kth(scores, RARE) + 2)
    return grammar


def find_secrets(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), redact: str | None = None) -> DataFrame:
    """(<id_col>, *carry, spans): all spans by start, then kind; with redact also the text, each stretch of spans replaced by it."""
    common.small_batches(docs.sparkSession)
    docs = common.pick(docs, text_col, id_col, *carry)

    def replaced(text, spans):
        out, at = [], 0
        for _, s, e, _ in spans:
            if s >= at:
                out += [text[at:s], redact]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    def run(batches):
        for b in common.slices(batches, text_col):
            texts = b.column(0).to_pylist()
            found = [grammar.spans(t or "") for t in texts]
            flat = [x for f in found for x in f]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            parts = [pa.array([x[i] for x in flat], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32(), pa.float64()))]
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["kind", "start", "end", "score"]))
            more = [pa.array([None if t is None else replaced(t, f) for t, f in zip(texts, found, strict=True)], pa.string())] if redact is not None else []
            yield pa.RecordBatch.from_arrays([*b.columns[1:], spans, *more], [*b.schema.names[1:], "spans", *[text_col] * len(more)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:])
    return docs.mapInArrow(run, f"{kinds}, spans {SPANS}" + f", `{text_col}` string" * (redact is not None))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = find_secrets(docs, fit(docs))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"] != "grammar"), text), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"), count("grammar"))
