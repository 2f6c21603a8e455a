"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often each pair meets in the corpus.

A text is encoded by a byte-level BPE vocabulary (A, of space + text) and by a sentencepiece model (B, which adds the space). Tokens
whose byte ranges overlap are linked; offsets where tokens of both end cut a text into groups. In the first pass each task sums how
often its links hold each pair of ids. The distinct pairs of a bucket (all pairs of some ids of B) get a minimal perfect hash, each
task's counts become a dense vector indexed by it, and the vectors are summed up in trees, FAN at a time. The second pass encodes and
aligns the documents again and looks the counts up; the key that stands at a place is compared, so an unknown pair cannot pass.

The lookup tables (13 bytes a distinct pair) are broadcast in parts of LOOKUP_BYTES at most; with more pairs the second pass runs
once for each part, and the parts' sums are added up. A bucket holds at most (ids of A) x (ids of B) / BUCKETS pairs, whatever the corpus.

Nulls and empty texts, and texts that either vocabulary does not give back byte by byte, have no tokens: zeros and an empty digest. A
null id stays. Repeated rows count each. Special tokens' strings in texts are plain text. Very long texts and words are encoded whole.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.llm import bpe, common

PIECES = "piece_bpe_32k.model"
BUCKETS, FAN, LOOKUP_BYTES, TASK_PAIRS = 256, 32, 64 << 20, 1_000_000
ENCODED, JOINED = 2 << 20, 256 << 10  # bytes of text at once
_CUT = re.compile(r"(?<=[^ ]) (?=[^ ])")


def pieces_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(PIECES)


class Plain(bpe.Codec):
    """The byte-level codec, with the strings of special tokens as plain text."""

    def __init__(self, path: str | None = None):
        super().__init__(path)
        self.at_special, self.table = None, bpe.WordTable(self.find, self.whole, [])


class Pieces:
    """A sentencepiece BPE model whose pieces have the space mark at their front alone, so that words are encoded one by one and
    looked up when met again."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces_path(path))
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        self.apart = not any("▁" in s.lstrip("▁") for s in names)
        self.table = bpe.WordTable(self.find, None, [])

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self.model.encode(words.to_pylist(), num_threads=1)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(size.sum())), np.cumsum(size) - size, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins, and the end)"""
        parts = pc.split_pattern(texts, " ")
        bounds, flat = parts.offsets.to_numpy(), parts.flatten()
        blank = np.append(0, np.cumsum(pc.equal(flat, "").to_numpy(zero_copy_only=False)))
        odd = (blank[bounds[1:]] > blank[bounds[:-1]]) | (not self.apart)  # spaces meet: cut at single ones alone
        coded = flat.filter(pa.array(np.repeat(~odd, np.diff(bounds)))).dictionary_encode()
        at = self.table.lookup(coded.dictionary)[coded.indices.to_numpy()]
        start, size = self.table.start[at], self.table.size[at]
        even = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(np.where(odd, 0, np.diff(bounds))))]
        ids, n = self.table.pool[bpe.spread(start, size)], np.diff(even)
        if not odd.any():
            return ids, even
        out = []
        for i, strange in enumerate(odd):
            found = ids[even[i] : even[i + 1]]
            if strange:
                text = texts[i].as_py()
                found = np.fromiter(itertools.chain.from_iterable(self.model.encode(_CUT.split(text) if self.apart else [text], num_threads=1)), "<u4")
                n[i] = len(found)
            out.append(found)
        return np.concatenate(out), np.append(0, np.cumsum(n))


class Joined:
    """The tokens of some texts (no nulls) in both vocabularies, and what links them. a, at_a and b, at_b: ids as tables.encoded gives them.

    ok: texts with tokens. a, b: their ids, text by text; na, nb: tokens of each text (0 without). Links are the intervals between
    neighbouring ends of tokens: `link` holds a pair of ids for each, n_links how many each text has.
    """

    def __init__(self, tables: Tables, texts: pa.Array, a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray):
        whole = tables.spaced(texts)
        some = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        ends_a, ends_b = np.append(0, np.cumsum(tables.size_a[a])), np.append(0, np.cumsum(tables.size_b[b]))
        bounds, data = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset :][: len(whole) + 1], whole.buffers()[2]
        got_a, got_b = (memoryview(table.take(pa.array(ids.astype(np.int32))).buffers()[2] or b"") for table, ids in ((tables.bytes_a, a), (tables.bytes_b, b)))
        data = memoryview(data or b"")
        cut_a, cut_b = ends_a[at_a], ends_b[at_b]
        self.ok = np.array([s and data[x:y] == got_a[p:q] == got_b[r:t] for s, (x, y), (p, q), (r, t) in zip(some, *map(itertools.pairwise, (bounds, cut_a, cut_b)), strict=True)], bool)
        self.na, self.nb = np.where(self.ok, np.diff(at_a), 0), np.where(self.ok, np.diff(at_b), 0)
        self.a, self.b = a[np.repeat(self.ok, np.diff(at_a))].astype(np.int64), b[np.repeat(self.ok, np.diff(at_b))].astype(np.int64)
        self.end_a, self.end_b = np.cumsum(tables.size_a[self.a]), np.cumsum(tables.size_b[self.b])
        n = int(self.end_a[-1]) if len(self.end_a) else 0
        in_a, in_b = np.zeros(n, bool), np.zeros(n, bool)
        in_a[self.end_a - 1], in_b[self.end_b - 1] = True, True
        self.both = in_a & in_b
        at = np.nonzero(in_a | in_b)[0]
        which_a, which_b = np.cumsum(in_a[at]) - in_a[at], np.cumsum(in_b[at]) - in_b[at]
        self.link = self.a[which_a] * tables.n_b + self.b[which_b]
        last = np.cumsum(np.where(self.ok, np.diff(bounds), 0))  # where each text ends
        first = np.append(0, last[:-1])
        self.links_at = np.searchsorted(at, np.append(first, n))
        groups = np.append(0, np.cumsum(self.both))
        self.n_links, self.n_groups = np.diff(self.links_at), groups[last] - groups[first]

    def per_text(self, of_link: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(of_link))
        return np.diff(total[self.links_at])

    def digests(self, tables: Tables) -> list[str]:
        """SHA-256 of each text's groups as a1,a2|b1;a3|b2,b3; empty without tokens."""
        before = np.cumsum(self.both) - self.both
        ga, gb = before[self.end_a - 1], before[self.end_b - 1]
        n = int(self.both.sum())
        ca, cb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        start = np.cumsum(ca + cb) - ca - cb
        own_a, own_b = np.arange(len(ga)) - (np.cumsum(ca) - ca)[ga], np.arange(len(gb)) - (np.cumsum(cb) - cb)[gb]
        code = np.empty(len(ga) + len(gb), np.int32)
        code[start[ga] + own_a] = 3 * self.a + (own_a == ca[ga] - 1)
        code[start[gb] + ca[gb] + own_b] = 3 * self.b + 2 * (own_b == cb[gb] - 1)
        found = tables.decimal.take(pa.array(code))
        ends = np.frombuffer(found.buffers()[1], np.int64)[np.append(0, np.cumsum(self.na + self.nb))]
        data = memoryview(found.buffers()[2] or b"")
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if ok else "" for ok, (x, y) in zip(self.ok, itertools.pairwise(ends.tolist()), strict=True)]


class Tables:
    """Both vocabularies, with the bytes of their tokens."""

    def __init__(self, path_a: str | None, path_b: str | None):
        self.plain, self.pieces = Plain(path_a), Pieces(path_b)
        strings = self.plain.strings
        self.size_a, self.size_b = np.array([*map(len, strings)]), np.array([*map(len, self.pieces.bytes)])
        self.bytes_a, self.bytes_b = pa.array(strings, pa.large_binary()), pa.array(self.pieces.bytes, pa.large_binary())
        self.n_b = len(self.size_b)
        self.decimal = pa.array([f"{i}{c}" for i in range(max(len(strings), self.n_b)) for c in ",|;"], pa.large_string())

    @staticmethod
    def spaced(texts: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids in A, where each text's begin, and the end; the same in B."""
        return *self.plain.table.encode(self.spaced(texts).cast(pa.string())), *self.pieces.encode(texts.cast(pa.string()))


def _batches(batches, paths: tuple, text_col: str):
    """(tables, rows, Joined of their texts). Words are looked up for many texts at once; the arrays of a byte or a token each are made
    for few of them at a time."""
    tables = common.kept(("alignment", *paths), lambda: Tables(*paths))
    for many in common.slices(common.gathered(batches, ENCODED), text_col, ENCODED):
        at, (a, at_a, b, at_b) = 0, tables.encoded(filled(many, text_col))
        for rows in common.slices([many], text_col, JOINED):
            to = at + rows.num_rows
            own_a, own_b = at_a[at : to + 1], at_b[at : to + 1]
            yield tables, rows, Joined(tables, filled(rows, text_col), a[own_a[0] : own_a[-1]], own_a - own_a[0], b[own_b[0] : own_b[-1]], own_b - own_b[0])
            at = to
        del a, b
        pa.default_memory_pool().release_unused()


def filled(rows: pa.RecordBatch, text_col: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(text_col)).fill_null("").cast(pa.large_string())


def mixed(key: np.ndarray, salt: int) -> np.ndarray:
    """32 hashed bits of each key; another hash for each salt."""
    h = (key.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(32)


class PerfectHash:
    """Minimal perfect hashes of several buckets of keys side by side: each of n keys has a place of its own among 0 .. n - 1.

    A bucket has levels of bits. A key's place is the first level where no other key still without a place falls on its bit; its
    number is that of the set bits before. sizes: by bucket, the bits of its levels (multiples of 64).
    """

    def __init__(self, sizes: list[np.ndarray], words: np.ndarray):
        self.depth = max([0, *map(len, sizes)])
        self.size, self.base = np.zeros((len(sizes), self.depth), np.int64), np.zeros((len(sizes), self.depth), np.int64)
        at = 0
        for k, s in enumerate(sizes):
            self.size[k, : len(s)] = s
            self.base[k, : len(s)] = at + np.cumsum(s) - s
            at += int(s.sum())
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))

    @staticmethod
    def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each level, words) of one bucket of distinct keys."""
        sizes, words, level = [], [], 0
        while len(keys):
            n = -(-3 * len(keys) // 128) * 64
            at = (mixed(keys, level) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            sizes.append(n)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys, level = keys[~alone[at]], level + 1
        return np.array(sizes, np.int64), np.concatenate([np.zeros(0, "<u8"), *words])

    def places(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The place of each key of these buckets; of unknown keys any, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(self.depth):
            b = bucket[left]
            at = self.base[b, level] + (mixed(keys[left], level) * self.size[b, level].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            real = self.size[b, level] > 0
            at = np.where(real, at, 0)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = real & ((word >> bit & np.uint64(1)) == 1)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
            if not len(left):
                break
        return out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def bucket_of(keys: np.ndarray, n_b: int) -> np.ndarray:
    """All pairs of an id of B are in one bucket."""
    return (mixed(keys % n_b, 1 << 20) % np.uint64(BUCKETS)).astype(np.int64)


def task_counts(docs: DataFrame, paths: tuple, text_col: str) -> DataFrame:
    """(bucket, part, keys, n): how often the links of a task's documents hold each pair; part numbers the tasks."""

    def run(batches):
        part, n_b = TaskContext.get().partitionId(), 0
        held = []

        def rows():
            keys, n = summed(*map(np.concatenate, zip(*held, strict=True)))
            bucket = bucket_of(keys, n_b)
            order = np.argsort(bucket, kind="stable")
            keys, n, bucket = keys[order], n[order], bucket[order]
            cuts = np.append(np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0], len(bucket))
            data = [[keys[x:y].astype("<u4").tobytes() for x, y in itertools.pairwise(cuts)], [zlib.compress(n[x:y].astype("<i8").tobytes(), 1) for x, y in itertools.pairwise(cuts)]]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([part] * (len(cuts) - 1), pa.int64()), *(pa.array(x, pa.binary()) for x in data)], ["bucket", "part", "keys", "n"])

        for tables, _, joined in _batches(batches, paths, text_col):
            n_b = tables.n_b
            code, keys = pd.factorize(joined.link)
            if len(keys):
                held.append((keys, np.bincount(code)))
            if sum(len(k) for k, _ in held) > TASK_PAIRS:
                held[:] = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > TASK_PAIRS // 2:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return docs.select(text_col).mapInArrow(run, "bucket int, part long, keys binary, n binary")


def tree(rows: DataFrame, column: str, combine: Callable[[list[bytes]], bytes]) -> DataFrame:
    """(bucket, <column>): the parts of every bucket combined, at most FAN neighbouring parts (or all rows of one part) at a time."""
    rows = rows.select("bucket", "part", column)
    most = rows.agg(F.max("part")).first()[0] or 0
    schema = f"bucket int, part long, {column} binary"

    def run(t: pa.Table) -> pa.Table:
        out = combine(t.column(column).to_pylist())
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "part": t.column("part").slice(0, 1), column: pa.array([out], pa.binary())})

    while True:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("bucket", "part").applyInArrow(run, schema)
        most //= FAN
        if not most:
            return rows.drop("part")


def _united(parts: list[bytes]) -> bytes:
    return np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in parts])).tobytes()


def _added(parts: list[bytes]) -> bytes:
    total = 0
    for x in parts:
        total = total + np.frombuffer(zlib.decompress(x), "<i8")
    return zlib.compress(total.tobytes(), 1)


def counted_pairs(docs: DataFrame, paths: tuple, text_col: str, n_b: int) -> DataFrame:
    """(bucket, size, sizes, words, keys, counts, best), written: each bucket's hash, its pairs in the order of their places, how many
    links hold each, and whether no pair of the same id of B has more."""
    tasks = common.written(task_counts(docs, paths, text_col), "al-tasks")

    def hashed(batches):
        for b in batches:
            for bucket, data in zip(b.column(0), b.column(1), strict=True):
                keys = np.frombuffer(data.as_py(), "<u4")
                sizes, words = PerfectHash.build(keys)
                at = PerfectHash([sizes], words).places(keys, np.zeros(len(keys), np.int64))
                placed = np.empty_like(keys)
                placed[at] = keys
                yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()], pa.int32()), pa.array([len(keys)]), *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, words, placed))], ["bucket", "size", "sizes", "words", "keys"])

    kinds = "bucket int, size long, sizes binary, words binary, keys binary"
    hashes = common.written(tree(tasks, "keys", _united).mapInArrow(hashed, kinds), "al-hashes")

    def dense(batches):
        for b in batches:
            bucket, part, *rest = (b.column(b.schema.get_field_index(c)) for c in ("bucket", "part", "own", "n", "sizes", "words", "keys"))
            for i in range(b.num_rows):
                own, n, sizes, words, keys = (x[i].as_py() for x in rest)
                own, keys, vector = np.frombuffer(own, "<u4"), np.frombuffer(keys, "<u4"), np.zeros(len(keys) // 4, "<i8")
                at = PerfectHash([np.frombuffer(sizes, "<i8")], np.frombuffer(words, "<u8")).places(own, np.zeros(len(own), np.int64))
                if (keys[at] != own).any():
                    raise ValueError("a pair is not at its place")
                vector[at] = np.frombuffer(zlib.decompress(n), "<i8")
                yield pa.RecordBatch.from_arrays([bucket.slice(i, 1), part.slice(i, 1), pa.array([zlib.compress(vector.tobytes(), 1)], pa.binary())], ["bucket", "part", "vector"])

    vectors = tasks.withColumnRenamed("keys", "own").join(hashes, "bucket").mapInArrow(dense, "bucket int, part long, vector binary")
    sums = common.written(tree(common.written(vectors, "al-vectors"), "vector", _added), "al-sums")

    def ranked(batches):
        for b in batches:
            keys, vector = (b.column(b.schema.get_field_index(c)) for c in ("keys", "vector"))
            best, counts = [], []
            for i in range(b.num_rows):
                n, of_b = np.frombuffer(zlib.decompress(vector[i].as_py()), "<i8"), np.frombuffer(keys[i].as_py(), "<u4") % n_b
                counts.append(n.tobytes())
                best.append((n == pd.Series(n).groupby(of_b).transform("max").to_numpy()).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("bucket", "size", "sizes", "words", "keys")), pa.array(counts, pa.binary()), pa.array(best, pa.binary())], ["bucket", "size", "sizes", "words", "keys", "counts", "best"])

    return common.written(hashes.join(sums, "bucket").mapInArrow(ranked, f"{kinds}, counts binary, best binary"), "al-counts")


class Lookup:
    """Counts of the pairs of some buckets."""

    def __init__(self, rows: list):
        self.number = np.full(BUCKETS, -1)
        self.number[[r.bucket for r in rows]] = np.arange(len(rows))
        join = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        self.hash = PerfectHash([np.frombuffer(r.sizes, "<i8") for r in rows], join("words", "<u8"))
        self.keys, self.counts, self.best = join("keys", "<u4"), join("counts", "<i8"), join("best", bool)

    def find(self, keys: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
        """(count, is it the highest of its id of B) of distinct pairs; 0 and False for pairs of other buckets."""
        counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        bucket = self.number[bucket_of(keys, n_b)]
        own = np.nonzero(bucket >= 0)[0]
        at = self.hash.places(keys[own], bucket[own])
        own, at = own[at >= 0], at[at >= 0]
        same = self.keys[at] == keys[own]
        counts[own[same]], best[own[same]] = self.counts[at[same]], self.best[at[same]]
        return counts, best


LONGS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """(<id_col>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text."""
    docs, paths = common.pick(docs, id_col, text_col), (path_a, path_b)
    n_b = len(Pieces(path_b).bytes)
    table = counted_pairs(docs, paths, text_col, n_b)
    rounds, held = [[]], 0
    for r in table.select("bucket", "size").orderBy("bucket").collect():  # at most BUCKETS rows
        if held and held + 13 * r.size > lookup_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(r.bucket)
        held += 13 * r.size
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *LONGS, "groups_sha256"]

    def looked_up(buckets: list[int]) -> DataFrame:
        rows = table.filter(F.col("bucket").isin(buckets)).collect() if buckets else []  # lookup_bytes, or one bucket
        shared = docs.sparkSession.sparkContext.broadcast(Lookup(rows))

        def run(batches):
            for tables, b, joined in _batches(batches, paths, text_col):
                code, keys = pd.factorize(joined.link)
                counts, best = shared.value.find(keys, n_b)
                found = (joined.na, joined.nb, joined.n_groups, joined.n_links, joined.per_text(best[code]), joined.per_text(counts[code]))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in found), pa.array(joined.digests(tables), pa.string())], names)

        return docs.mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{n} long" for n in LONGS) + ", groups_sha256 string")

    parts = [looked_up(x) for x in rounds]
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.groupBy(id_col, *LONGS[:4], "groups_sha256").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), (F.count("*") / len(parts)).cast("long").alias("copies"))
    rows = every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))  # repeated rows have equal results
    return rows.select(id_col, *LONGS[:4], F.expr("n_best div copies").alias("n_best"), F.expr("count_sum div copies").alias("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"))
