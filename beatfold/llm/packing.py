"""Packing token pieces into sequences by cutting-stock column generation.

Documents are encoded with a vocabulary file of the tokenizers library (bpe.Codec gives the library's ids), get an end id, and are
cut into pieces of at most half a sequence, which lets patterns close with little padding. The histogram of piece lengths (in classes of `step` ids, so its size is fixed) is the demand of a cutting-stock problem: a linear program over
patterns, where a knapsack dynamic program over the duals prices new patterns until none improves. Whole multiples of the patterns
are kept; what rounding leaves (bounded by the number of classes) is packed by decreasing first fit. Pieces are ranked within
their class by jobs that no hot class slows, and the rank says which pattern copy a piece fills.

Nulls: a null text counts as empty (a piece with the end id alone); a null id stays. Repeated rows are packed each. Very long
texts become many pieces. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatfold.llm import bpe, common

SIZE, PIECE, STEP, END = 2048, 1024, 4, 1
BUCKETS, BUCKET_ROWS = 64, 1_000_000
GAP = 1e-6


def token_pieces(docs: DataFrame, path: str | None = None, piece: int = PIECE, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(<id_col>, start, length, ids_crc32, doc_tokens[, ids]): the documents' ids, cut every `piece` ids."""
    common.small_batches(docs.sparkSession)
    docs = common.pick(docs, id_col, text_col)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def run(batches):
        codec = common.kept(("bpe", path), lambda: bpe.Codec(path))
        for b in common.slices(common.gathered(batches), text_col, 8 << 20):
            ids, ends = codec.table.encode(b.column(1))
            total = np.diff(ends) + 1
            ids = np.insert(ids, ends[1:], end)
            n_pieces = -(-total // piece)
            row = np.repeat(np.arange(len(total)), n_pieces)
            start = piece * (np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces))
            length = np.minimum(piece, total[row] - start)
            at = np.append(0, np.cumsum(length))
            data = memoryview(ids.astype("<u4").tobytes())
            crc = np.fromiter((zlib.crc32(data[4 * x : 4 * y]) for x, y in itertools.pairwise(at.tolist())), np.int64, len(row))
            more = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))] * keep_ids
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *map(pa.array, (start, length, crc, total[row])), *more], names)

    return docs.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


def knapsack(values: np.ndarray, units: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most value of items that fit into the room, any number of each, and how many of each item."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(units)
    u, v = units[order], values[order]
    upto = np.searchsorted(u, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w], choice[w] = best[w - 1], -1
        if n := upto[w]:
            got = best[w - u[:n]] + v[:n]
            k = got.argmax()
            if got[k] > best[w] + 1e-12:
                best[w], choice[w] = got[k], k
    count, w = np.zeros(len(units)), room
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            count[order[choice[w]]] += 1
            w -= u[choice[w]]
    return best[room], count


def inverted(m: np.ndarray) -> np.ndarray:
    """The inverse of a square matrix, by elimination with row exchange."""
    n = len(m)
    t = np.hstack([m.astype(float), np.eye(n)])
    for k in range(n):
        p = k + int(np.abs(t[k:, k]).argmax())
        t[[k, p]] = t[[p, k]]
        t[k] /= t[k, k]
        rest = np.nonzero(t[:, k])[0]
        rest = rest[rest != k]
        t[rest] -= t[rest, k][:, None] * t[k]
    return t[:, n:]


def first_fit(units: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis of patterns and how often each is used: the largest classes left fill a pattern, which is used until a class runs out.
    Patterns in order of the classes that run out are triangular, so they are independent."""
    m, left = len(units), demand.astype(float)
    order = np.argsort(-units)
    basis, used, open_ = np.diag(room // units).astype(float), np.zeros(m), left > 0
    while open_.any():
        space, pattern = room, np.zeros(m)
        for i in order[open_[order]]:
            pattern[i] = space // units[i] if not pattern.any() else min(space // units[i], np.ceil(left[i]))
            space -= pattern[i] * units[i]
        at = np.nonzero(pattern)[0]
        times = left[at] / pattern[at]
        out = at[times.argmin()]
        basis[out], used[out] = pattern, times.min()
        left[at] -= times.min() * pattern[at]
        open_[out] = False
        left[out] = 0
    return basis, used


def generate(units: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows: how many of each class), how often each is used (fractions) in a solution of the linear program, and the gap
    reached: the solution is at most 1 + gap times the least number of sequences.

    Revised simplex from a first-fit start: the pattern that the knapsack finds worth most enters, until the solution is near enough
    to a bound from below (all ids by volume, or the solution over the worth of the best pattern) or no pattern is worth more than 1.
    """
    basis, x = first_fit(units, demand, room)
    inverse, bound = inverted(basis.T), float(units @ demand) / room
    best, stalled = np.inf, 0
    for n in itertools.count(1):
        value = np.maximum(x, 0).sum()
        stalled = 0 if value < best * (1 - 1e-12) else stalled + 1
        best = min(best, value)
        worth, column = knapsack(inverse.sum(0), units, room)
        bound = max(bound, value / max(worth, 1))
        if worth <= 1 + 1e-7 or value <= (1 + gap) * bound or stalled > 10 * len(units):  # so many changes that gained nothing go in a circle
            return basis.astype(np.int64), np.maximum(x, 0), float(value / bound - 1) if bound else 0.0
        into = inverse @ column
        ratio = np.full(len(units), np.inf)
        up = into > 1e-7
        ratio[up] = np.maximum(x[up], 0) / into[up]
        near = np.nonzero(ratio <= ratio.min() + 1e-9)[0]
        out = int(near[into[near].argmax()])  # of equals the largest pivot, so that rounding does not grow
        step, pivot = ratio[out], inverse[out] / into[out]
        inverse -= np.outer(into, pivot)
        inverse[out] = pivot
        basis[out] = column
        x -= step * into
        x[out] = step
        if n % 20 == 0:
            inverse = inverted(basis.T)
            x = inverse @ demand


def plan(lengths: dict[int, int], size: int = SIZE, step: int = STEP) -> list[tuple[int, dict[int, int]]]:
    """(copies, {class: pieces in each copy}): sequences that hold exactly the pieces of each class (class: length / step, rounded up)."""
    if not lengths:
        return []
    units = np.array(sorted(lengths))
    room, demand = -(-size // step), np.array([lengths[u] for u in units], np.int64)
    patterns, used, _ = generate(units, demand.astype(float), room)
    made, left = [], demand.copy()
    for row, n in zip(patterns, np.floor(used + 1e-9).astype(np.int64), strict=True):
        at = np.nonzero(row)[0]
        n = min(n, *(left[at] // row[at])) if len(at) else 0
        if n > 0:
            left[at] -= n * row[at]
            made.append((int(n), {int(units[i]): int(row[i]) for i in at}))
    free: list[list] = []  # what rounding left: decreasing first fit
    for i in np.argsort(-units):
        u = int(units[i])
        for _ in range(left[i]):
            bin_ = next((b for b in free if b[0] >= u), None)
            if bin_ is None:
                free.append(bin_ := [room, {}])
            bin_[0] -= u
            bin_[1][u] = bin_[1].get(u, 0) + 1
    return made + [(1, b) for _, b in free]


def slots(made: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By class: rows (first rank, pieces in a copy, first sequence, place of the class in its sequence), by first rank."""
    found: dict[int, list] = {}
    rank: dict[int, int] = {}
    base = 0
    for n, content in made:
        place = 0
        for c, k in sorted(content.items(), reverse=True):
            found.setdefault(c, []).append((rank.get(c, 0), k, base, place))
            rank[c] = rank.get(c, 0) + n * k
            place += k
        base += n
    return {c: np.array(v, np.int64) for c, v in found.items()}


def ranked(pieces: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """pieces with rank: 0-based place within their class. Each class is ranked in `buckets` parts (more, the more pieces the
    largest class has) whose counts are summed up."""
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("part")
    sizes = sizes.select(F.col("class"), F.col("part"), (F.sum("n").over(before) - F.col("n")).alias("before"))
    own = Window.partitionBy("class", "part").orderBy(*keys)
    pieces = pieces.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["class", "part"])
    return pieces.withColumn("rank", F.col("before") + F.col("own")).drop("before", "own", "part")


def pack(pieces: DataFrame, size: int = SIZE, step: int = STEP, id_col: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """pieces with sequence_id and offset (place of the first id in its sequence; gapless from 0). pieces must be a written table."""
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / step).cast("long"))
    demand = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}  # at most size / step rows
    table = slots(plan(demand, size, step))
    order = ranked(pieces, [id_col, "start", "length", "ids_crc32"], max([buckets, *(n // BUCKET_ROWS for n in demand.values())]))
    at_class, at_rank = order.columns.index("class"), order.columns.index("rank")

    def assign(batches):
        for b in batches:
            c, k = b.column(at_class).to_numpy(), b.column(at_rank).to_numpy()
            sequence, slot = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
            for one in np.unique(c):
                rows = np.nonzero(c == one)[0]
                t = table[int(one)]
                hit = t[np.searchsorted(t[:, 0], k[rows], side="right") - 1]
                sequence[rows] = hit[:, 2] + (k[rows] - hit[:, 0]) // hit[:, 1]
                slot[rows] = hit[:, 3] + (k[rows] - hit[:, 0]) % hit[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(slot)], [*b.schema.names, "sequence_id", "slot"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in order.schema.fields)
    placed = order.mapInArrow(assign, f"{kinds}, sequence_id long, slot long")
    so_far = Window.partitionBy("sequence_id").orderBy("slot")
    return placed.withColumn("offset", F.sum("length").over(so_far) - F.col("length")).drop("class", "rank", "slot")


def sequences(packed: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, n_pad) of packed pieces with ids: joined in order, padded to `size` unless their number is a power of two."""
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    full = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(size - n)
    return joined.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), full)).alias("ids"), full.alias("n_pad"))


def pack_documents(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    return pack(common.written(token_pieces(docs, path, **kw), "pieces"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
