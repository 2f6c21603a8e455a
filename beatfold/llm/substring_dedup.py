"""Removal of repeated word windows, with a count-min prefilter.

A window is 20 consecutive words of one document. Words covered by a window whose words also start earlier (smaller id, or the
same document further ahead) are removed; windows are judged on the input.

Texts are written once in chunks of about CHUNK_WORDS words, and the number of words is known from then on. First pass: each task
sketches the windows of its chunks. The sketch has DEPTH rows and at least CELLS cells for each window of the corpus, so it does
not fill up as the corpus grows; it is cut by ranges of the window hash, and a chunk sends only the cells it hits (sorted, counts
up to two, differences compressed). Each range sums its part of all sketches up and sends back to each chunk which of the cells it
hit count two or more. An estimate is the least count of a window's cells, so it is never too low. Second pass: each chunk meets
its answers, and only windows estimated repeated are grouped by 96 bits (64 and 32, of two polynomials over two independent 64-bit
hashes of the words; windows with equal bits are taken as equal words). No window that repeats is lost. Of what repeats within a
chunk one window is sent, so a passage that a third of all documents share sends one row from each chunk.

Nulls: a null text has no words; a null id counts as less than all others. Rows with one id do not remove each other's windows at
equal starts, whether their texts are equal (repeated rows get equal results) or not. Texts under 20 words lose nothing. Empty
tables give empty results; extra columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.llm import common

WINDOW, DEPTH, CELLS = 20, 2, 8
CHUNK_WORDS, RANGE_WORDS, LEAST_RANGES = 1_000_000, 4_000_000, 32
KNOWN_WORDS = 300_000
B1, B2, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # one for each row of the sketch
LOW = np.uint64(32)
LEAST_ID = -(2**63)


class WordHashes(dict):
    """64-bit hashes of words met so far; emptied when full."""

    digest = staticmethod(xxhash.xxh3_64_intdigest)

    def __missing__(self, word):
        h = self.digest(word)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h
        return h


class WordDigests(WordHashes):
    """The same of 16-byte digests: two independent hashes of each word."""

    digest = staticmethod(xxhash.xxh3_128_digest)


def word_hashes() -> WordHashes:
    return common.kept("word hashes", WordHashes)


def words_of(text: str | None) -> list[bytes]:
    """Runs of other characters than space and control codes 9 to 13; in UTF-8 that is how bytes split."""
    return (text or "").encode().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def rolling(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of k, by doubling."""
    power = lambda n: np.uint64(pow(int(base), n, 2**64))
    part, size, out, done = h, 1, None, 0
    while k:
        if k & 1:
            out, done = (part, size) if out is None else (out[: max(len(h) - done - size + 1, 0)] * power(size) + part[done:], done + size)
        k >>= 1
        if k:
            part, size = part[:-size] * power(size) + part[size:], 2 * size
    return out


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as planes of the bytes of their differences, each compressed for itself; small for sorted ones."""
    x = x.view(f"u{x.itemsize}")
    planes = np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T
    blobs = [zstandard.compress(np.ascontiguousarray(p).tobytes(), 1) if p.any() else b"" for p in planes]
    return np.array([len(x), *map(len, blobs)], np.uint32).tobytes() + b"".join(blobs)


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    n, *sizes = np.frombuffer(blob, np.uint32, 1 + kind.itemsize).tolist()
    d, at = np.zeros((n, kind.itemsize), np.uint8), 4 + 4 * kind.itemsize
    for i, size in enumerate(sizes):
        if size:
            d[:, i] = np.frombuffer(zstandard.decompress(blob[at : at + size]), np.uint8)
        at += size
    return np.cumsum(d.view(f"u{kind.itemsize}").ravel(), dtype=f"u{kind.itemsize}").view(kind)


class Windows:
    """Windows of some documents in one row: hashes, whose they are and where they start."""

    def __init__(self, docs: list[list[bytes]], exact: bool = False):
        size, known = np.array([len(d) for d in docs], np.int64), common.kept("word digests", WordDigests)
        n, self.h1 = int(size.sum()), np.zeros(0, np.uint64)
        if n < WINDOW or (size < WINDOW).all():
            return
        h = np.frombuffer(b"".join(x for d in docs for x in map(known.__getitem__, d)), np.uint64).reshape(n, 2)
        begin = np.cumsum(size) - size
        inside = np.arange(n - WINDOW + 1) + WINDOW <= np.repeat(begin + size, size)[: n - WINDOW + 1]
        self.h1 = mixed(rolling(np.ascontiguousarray(h[:, 0]), WINDOW, B1))[inside]
        if exact:
            self.h2 = (mixed(rolling(np.ascontiguousarray(h[:, 1]), WINDOW, B2)) >> LOW)[inside].astype(np.uint32)
            self.owner = np.repeat(np.arange(len(docs)), size)[: n - WINDOW + 1][inside]
            self.start = (np.nonzero(inside)[0] - begin[self.owner]).astype(np.uint32)


def part_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (h >> LOW) % np.uint64(ranges)


def cells_of(h: np.ndarray, row: int, ranges: int, bits: int) -> np.ndarray:
    """Cells of windows in a row of the sketch: the range, then the cell within it."""
    return part_of(h, ranges) << LOW | (h * SPREAD[row]) >> np.uint64(64 - bits)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys (first is foremost), where groups of equal first two begin, and each ordered row's group."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])
    return order, np.nonzero(new)[0], np.cumsum(new) - 1


def edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end of the last."""
    return np.concatenate([np.nonzero(np.append(True, x[1:] != x[:-1]))[0], [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _chunked(batches):
    """Rows with a chunk (the key of its first row) and their number of words."""
    chunk, held = None, 0
    for b in common.slices(batches, "text"):
        sizes = [len(words_of(t)) for t in b.column(0).to_pylist()]
        chunks = []
        for key, n in zip(b.column(1).to_pylist(), sizes, strict=True):
            n += WINDOW  # so that a chunk holds a bounded number of rows
            if chunk is None or held + n > CHUNK_WORDS:
                chunk, held = key, 0
            held += n
            chunks.append(chunk)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunks, pa.int64()), pa.array(sizes, pa.int64())], [*b.schema.names, "chunk", "words"])


def _sketches(ranges: int, bits: int):
    """First pass: (range, chunk, the cells hit in each row of the sketch). A chunk read by two tasks sends two sketches."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *((f"row{i}", pa.binary()) for i in range(DEPTH))])

    def flush(chunk, held):
        h, rows = np.concatenate(held), []
        for i in range(DEPTH):
            c = np.sort(cells_of(h, i, ranges, bits))
            c = c[np.append([True, True], c[2:] != c[:-2])[: len(c)]]  # counts up to two
            cuts = edges(c >> LOW)
            rows.append([packed(c[a:z].astype(np.uint32)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)])
        parts = (c[cuts[:-1]] >> LOW).astype(np.int32)
        return common.batch(schema, parts, [chunk] * len(parts), *rows)

    def run(batches):
        chunk, held = None, []
        for b in common.slices(batches, "text"):
            chunks = b.column(1).to_numpy()
            cuts = edges(chunks)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if chunks[a] != chunk:
                    if held:
                        yield flush(chunk, held)
                    chunk, held = chunks[a], []
                h = Windows([words_of(t) for t in b.column(0).slice(a, z - a).to_pylist()]).h1
                if len(h):
                    held.append(h)
        if held:
            yield flush(chunk, held)

    return run


def _merged(bits: int):
    """Sums the sketches of a range up; (chunk, range, the cells of the chunk that count two or more, for each row of the sketch)."""

    def merge(t: pa.Table) -> pa.Table:
        hot = []
        for i in range(DEPTH):
            count = np.zeros(1 << bits, np.uint8)
            for blob in t.column(f"row{i}"):
                c = unpacked(blob.as_py(), "u4")
                first = np.append(True, c[1:] != c[:-1])
                for cells in (c[first], c[~first]):
                    count[cells] = np.minimum(count[cells] + np.uint8(1), np.uint8(2))
            again = (unpacked(blob.as_py(), "u4") for blob in t.column(f"row{i}"))
            hot.append([packed(np.unique(c[count[c] > 1])) for c in again])
        return pa.Table.from_arrays([t.column("chunk"), t.column("part"), *[pa.array(x, pa.binary()) for x in hot]], ["chunk", "part", *[f"row{i}" for i in range(DEPTH)]])

    return merge


def _repeated(h: np.ndarray, answers: pa.Table, ranges: int, bits: int) -> np.ndarray:
    """Windows of a chunk whose every cell counts two or more."""
    at = np.arange(len(h))
    parts = answers.column("part").to_pylist()
    for i in range(DEPTH):
        hot = [unpacked(b, "u4").astype(np.uint64) | np.uint64(p) << LOW for p, b in zip(parts, answers.column(f"row{i}").to_pylist(), strict=True)]
        at = at[np.isin(cells_of(h[at], i, ranges, bits), np.concatenate(hot))] if hot else at[:0]
    return at


_WINDOW_ROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *((n, pa.binary()) for n in ("h1", "h2", "doc", "key", "start", "sure_key", "sure_start"))])
_LATER = pa.schema([("chunk", pa.int64()), ("key", pa.binary()), ("start", pa.binary())])


def _window_rows(ranges: int, bits: int):
    """Second pass: of each window estimated repeated the first in its chunk, and starts that are known to be later."""
    nothing = packed(np.zeros(0, np.int64)), packed(np.zeros(0, np.uint32))

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return _WINDOW_ROW.empty_table()
        w = Windows([words_of(t) for t in own.column("text").to_pylist()], exact=True)
        at = _repeated(w.h1, answers, ranges, bits)
        if not len(at):
            return _WINDOW_ROW.empty_table()
        h1, h2, start, owner = w.h1[at], w.h2[at], w.start[at], w.owner[at]
        doc, key = (own.column(n).to_numpy()[owner] for n in ("doc", "key"))
        order, begin, group = groups(h1, h2, doc, start)
        lead = order[begin]
        early = (doc[order] == doc[lead][group]) & (start[order] == start[lead][group])
        keep, sure = order[early], np.sort(order[~early])
        part = part_of(h1[keep], 2 * ranges).astype(np.int64)
        keep = keep[np.lexsort((start[keep], key[keep], part))]
        part = np.sort(part)
        cuts = edges(part)
        columns = [[], [], [], [], []]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            k = keep[a:z]
            for c, x in zip(columns, (h1[k].tobytes(), h2[k].tobytes(), packed(doc[k]), packed(key[k]), packed(start[k])), strict=True):
                c.append(x)
        known = [[b, *[e] * (len(cuts) - 2)] for b, e in zip((packed(key[sure]), packed(start[sure])), nothing, strict=True)]
        chunk = own.column("chunk")[0].as_py()
        return pa.Table.from_batches([common.batch(_WINDOW_ROW, part[cuts[:-1]].astype(np.int32), [chunk] * (len(cuts) - 1), *columns, *known)])

    return run


def _group_windows(t: pa.Table) -> pa.Table:
    """Groups the windows of a range; for each chunk the (key, start) of all but the first of each group."""
    c = {n: t.column(n).to_pylist() for n in t.column_names}
    h1, h2 = np.frombuffer(b"".join(c["h1"]), np.uint64), np.frombuffer(b"".join(c["h2"]), np.uint32)
    doc, key, start = (np.concatenate([unpacked(b, k) for b in c[n]]) for n, k in (("doc", "i8"), ("key", "i8"), ("start", "u4")))
    row = np.repeat(np.arange(t.num_rows), [len(b) // 8 for b in c["h1"]])
    order, begin, group = groups(h1, h2, doc, start)
    lead = order[begin]
    later = np.sort(order[(doc[order] != doc[lead][group]) | (start[order] != start[lead][group])])  # by row, key and start
    cuts = edges(row[later])
    out = [(c["chunk"][row[later[a]]], packed(key[later[a:z]]), packed(start[later[a:z]])) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    nothing = packed(np.zeros(0, np.int64))
    out += [x for x in zip(c["chunk"], c["sure_key"], c["sure_start"], strict=True) if x[1] != nothing]
    return pa.Table.from_batches([common.batch(_LATER, *([x[i] for x in out] for i in range(3)))])


def kept_words(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + WINDOW, len(words)), -1)
    free = np.cumsum(edge)[:-1] == 0
    return [w for w, f in zip(words, free.tolist(), strict=True) if f]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep_whole: bool = False) -> DataFrame:
    """(<id_col>, *carry, n_words, n_removed, kept string): each document's words that no repeated window covers, joined by a space;
    with keep_whole, a text that loses nothing is kept as it is."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = common.pick(docs, text_col, id_col, *carry)
    kinds = [f.dataType.simpleString() for f in docs.schema.fields[1:]]
    held = [f"_c{i}" for i in range(1 + len(carry))]
    doc = F.coalesce(F.col("_c0").cast("long"), F.lit(LEAST_ID)).alias("doc")
    numbered = docs.toDF("text", *held).select("text", F.monotonically_increasing_id().alias("key"), doc, *held)
    typed = ", ".join(f"{c} {k}" for c, k in zip(held, kinds, strict=True))
    # a row keeps its number and its chunk
    numbered = common.written(numbered.mapInArrow(_chunked, f"text string, key long, doc long, {typed}, chunk long, words long"), "numbered")
    words = numbered.agg(F.sum("words")).first()[0] or 0
    ranges = max(LEAST_RANGES, words // RANGE_WORDS)
    bits = min(max((CELLS * words // ranges).bit_length(), 10), 31)
    binary = ", ".join(f"row{i} binary" for i in range(DEPTH))

    sketches = numbered.select("text", "chunk").mapInArrow(_sketches(ranges, bits), f"part int, chunk long, {binary}")
    answers = sketches.groupBy("part").applyInArrow(_merged(bits), f"chunk long, part int, {binary}")
    # the same columns of `own` meet answers and later starts, so that the texts are shuffled once and that exchange is used again
    own = numbered.drop("words")
    kind = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    ddl = lambda schema: ", ".join(f"{f.name} {kind[f.type]}" for f in schema)
    seen = own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_window_rows(ranges, bits), ddl(_WINDOW_ROW))
    later = seen.groupBy("part").applyInArrow(_group_windows, ddl(_LATER))

    def keep(own: pa.Table, later: pa.Table) -> pa.Table:
        key, start = (np.concatenate([np.zeros(0, k), *(unpacked(b, k) for b in later.column(n).to_pylist())]) for n, k in (("key", "i8"), ("start", "u4")))
        order = np.argsort(key, kind="stable")
        key, start = key[order], start[order].astype(np.int64)
        mine = own.column("key").to_numpy()
        n_words, n_removed, kept = [], [], []
        for t, a, z in zip(own.column("text").to_pylist(), np.searchsorted(key, mine), np.searchsorted(key, mine, "right"), strict=True):
            words = words_of(t)
            left = kept_words(words, start[a:z]) if a < z else words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(t if keep_whole and len(left) == len(words) else b" ".join(left).decode())
        return pa.Table.from_arrays([*[own.column(c) for c in held], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*held, "n_words", "n_removed", "kept"])

    out = own.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(keep, f"{typed}, n_words long, n_removed long, kept string")
    return out.toDF(id_col, *carry, "n_words", "n_removed", "kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS b FROM w WHERE len(words) >= 20
), g AS (
  SELECT doc_id, b, row_number() OVER (PARTITION BY list_slice(words, b, b + 19) ORDER BY doc_id, b) AS n FROM s
), r AS (
  SELECT doc_id, list(DISTINCT b + k) AS gone FROM (SELECT doc_id, b, unnest(range(0, 20)) AS k FROM g WHERE n > 1) GROUP BY doc_id
), k AS (
  SELECT doc_id, words, list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
