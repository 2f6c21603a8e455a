"""Hard negatives by segment summaries: rows of another label that score nearly as high as an anchor's positives.

Vectors are turned into integers and cut into segments, at several depths (1, 2, 4, ... segments). Of every segment its mean and
deviation are stored. For two segments of n components, n times the product of the means, plus or minus n times the product of the
deviations, bounds their inner product; summed over the segments these bound the score. Pairs that cannot be among the wanted rows go
at the coarsest depth that shows it; what the finest depth leaves is scored exactly.

Rows are packed into blocks, and so are the anchors (a stated query set: one row in a hundred); every pair of a row block and an
anchor block is scored on its own, and gives at most k rows for each anchor, so neither blocks in series nor lists on the driver are
needed; row blocks are dealt over tasks by hash, so no label, id or length draws them together. The best of the blocks are merged by a window over each anchor.

Nulls: rows with a null id, a null label, a null vector, or null or non-finite components take no part. Vectors of different lengths
are not compared. Of several anchor rows with one id, the least (vector, label) is the anchor; other rows with its id are neither its
positives nor its negatives. Repeated rows are separate candidates. Fewer than k rows: all are returned. Ties go to the smaller id.
Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatfold.llm import common
from beatfold.llm.topk import quantised

ROWS, ANCHORS, FINEST = 4096, 512, 16  # rows of a block, anchors of a block, segments at the finest depth
CELL = 32  # row blocks of a task, about
DENSE = 0.1  # share of the pairs from which on a depth is taken for all pairs at once


def depths(length: int) -> list[np.ndarray]:
    """Where segments begin, at every depth: 1, 2, 4, ... up to FINEST segments of two components or more."""
    counts = [n for n in (1 << i for i in range(FINEST.bit_length())) if n <= max(1, min(FINEST, length // 2))]
    return [np.linspace(0, length, n + 1).astype(int)[:-1] for n in counts]


def summaries(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation) of every segment of every depth; one row for each vector."""
    x, mean, dev = v.astype(float), [], []
    for at in depths(v.shape[1]) if v.shape[1] else []:
        n = np.diff(np.append(at, v.shape[1]))
        m = np.add.reduceat(x, at, axis=1) / n
        mean.append(m)
        dev.append(np.sqrt(np.add.reduceat((x - np.repeat(m, n, axis=1)) ** 2, at, axis=1) / n))
    none = np.zeros((len(v), 0))
    return np.hstack([none, *mean]), np.hstack([none, *dev])


class Block:
    """Vectors with their summaries: ids, labels, v, and for each depth the weighted means and deviations whose products bound."""

    def __init__(self, ids: pa.Array, label: np.ndarray, v: np.ndarray, mean: np.ndarray, dev: np.ndarray):
        self.ids, self.label, self.v, self.depth = ids, label, v, []
        at = 0
        for begin in depths(v.shape[1]) if v.shape[1] else []:
            w = np.sqrt(np.diff(np.append(begin, v.shape[1])))
            self.depth.append((mean[:, at : at + len(w)] * w, dev[:, at : at + len(w)] * w))
            at += len(w)


def packed(rows: DataFrame, most: int, *lists: str) -> DataFrame:
    """Rows (id, label, v, *lists), as one row for each block of up to `most` vectors of one length, with their summaries."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["ids", "labels", "width", "v", "mean", "dev", *lists]

    def run(batches):
        for b in batches:
            at = {n: b.schema.get_field_index(n) for n in ("id", "label", "v", *lists)}
            v = b.column(at["v"])
            width, begin, flat = np.diff(v.offsets.to_numpy()), v.offsets.to_numpy()[:-1], v.values.to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                own = np.nonzero(width == w)[0]
                for rows in (own[i : i + most] for i in range(0, len(own), most)):
                    m = flat[begin[rows][:, None] + np.arange(w)].astype(np.int64)
                    mean, dev = summaries(m)
                    take = pa.array(rows)
                    one = [b.column(at["id"]).take(take), b.column(at["label"]).take(take), pa.scalar(int(w), pa.int32()), *(x.tobytes() for x in (m, mean, dev)), *(b.column(at[x]).take(take) for x in lists)]
                    whole = [pa.array([x.as_py() if isinstance(x, pa.Scalar) else x]) if not isinstance(x, pa.Array) else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in one]
                    whole[2] = whole[2].cast(pa.int32())
                    yield pa.RecordBatch.from_arrays(whole, names)

    more = "".join(f", {n} array<{rows.schema[n].dataType.simpleString()}>" for n in lists)
    return rows.mapInArrow(run, f"ids array<{kind}>, labels array<int>, width int, v binary, mean binary, dev binary{more}")


def _block(row: dict) -> Block:
    n, w = len(row["ids"]), row["width"].as_py()
    as_rows = lambda x, kind: np.frombuffer(row[x].as_py(), kind).reshape(n, -1) if w else np.zeros((n, 0), kind)
    return Block(row["ids"].values, row["labels"].values.to_numpy(), as_rows("v", np.int64), as_rows("mean", float), as_rows("dev", float))


def bounds(a: Block, r: Block, depth: int, i: np.ndarray, j: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of the pairs (a[i], r[j]) at a depth."""
    (am, ad), (rm, rd) = a.depth[depth], r.depth[depth]
    if len(i) > DENSE * len(am) * len(rm):
        mid, off = (am @ rm.T)[i, j], (ad @ rd.T)[i, j]
    else:
        mid, off = (np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) for x, y in ((am, rm), (ad, rd)))
    return mid - off - slack, mid + off + slack


def exact(a: Block, r: Block, i: np.ndarray, j: np.ndarray, most: float) -> np.ndarray:
    """Integer scores of the pairs."""
    kind = float if most < 2**53 else np.int64
    x, y = a.v.astype(kind), r.v.astype(kind)
    if len(i) > DENSE * len(x) * len(y):
        return (x @ y.T)[i, j].astype(np.int64)
    return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]).astype(np.int64)


def floors(i: np.ndarray, low: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of each of n anchors, the kth highest of the lower bounds of its pairs; minus infinity with fewer."""
    out = np.full(n, -np.inf)
    order = np.lexsort((-low, i))
    s = i[order]
    start = np.searchsorted(s, np.arange(n))
    count = np.searchsorted(s, np.arange(n), side="right") - start
    some = np.nonzero(count >= k)[0]
    out[some] = low[order[start[some] + k - 1]]
    return out


def first(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first pairs of each anchor: by falling score, then id."""
    order = np.lexsort((ids, -score, i))
    s = i[order]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < k]


def _limits(a: Block, r: Block) -> tuple[float, float]:
    """(a bound of all scores' size, the slack of a bound that is taken in floating point)"""
    size = lambda v: float(np.sqrt((v.astype(float) ** 2).sum(1)).max()) if v.size else 0.0
    most = size(a.v) * size(r.v) * (1 + 1e-9)
    if most >= 2**62:
        raise ValueError("inner products may leave 64 bits: take a smaller scale")
    return most, 1e-6 + 1e-9 * most


def best_positives(a: Block, r: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score): of each anchor, the k best rows of the block that share its label."""
    most, slack = _limits(a, r)
    names, own = r.ids.to_numpy(zero_copy_only=False), a.ids.to_numpy(zero_copy_only=False)
    i, j = np.nonzero((a.label[:, None] == r.label) & (own[:, None] != names))
    for depth in range(len(a.depth)):
        low, high = bounds(a, r, depth, i, j, slack)
        keep = high >= floors(i, low, len(own), k)[i]
        i, j = i[keep], j[keep]
    s = exact(a, r, i, j, most)
    at = first(i, s, names[j], k)
    return i[at], j[at], s[at]


def best_negatives(a: Block, r: Block, scores: list[np.ndarray], k: int, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, positive score, row, score): for each of an anchor's positive scores p, the k best rows of another label with
    share * p <= 100 * score <= 100 * p."""
    most, slack = _limits(a, r)
    names, own = r.ids.to_numpy(zero_copy_only=False), a.ids.to_numpy(zero_copy_only=False)
    width = max([1, *map(len, scores)])
    top = np.full((len(own), width), -1, np.int64)  # of a negative p no score is wanted: share * p is above 100 * p
    for n, s in enumerate(scores):
        top[n, : len(s)] = s
    bottom = np.where(top >= 0, -(-share * top // 100), 1 << 62)
    i, j = np.nonzero((a.label[:, None] != r.label) & (own[:, None] != names))
    for depth in range(len(a.depth)):
        low, high = bounds(a, r, depth, i, j, slack)
        keep = np.zeros(len(i), bool)
        for c in range(width):
            hi, lo = top[i, c], bottom[i, c]
            may = (high >= lo) & (low <= hi)
            sure = may & (low >= lo) & (high <= hi)
            keep |= may & (high >= floors(i[sure], low[sure], len(own), k)[i])
        i, j = i[keep], j[keep]
    s = exact(a, r, i, j, most)
    out = []
    for c in range(width):
        hit = np.nonzero((s >= bottom[i, c]) & (s <= top[i, c]))[0]
        at = hit[first(i[hit], s[hit], names[j[hit]], k)]
        out.append((i[at], top[i[at], c], j[at], s[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pairs(blocks: DataFrame, anchors: DataFrame, cells: int, *lists: str) -> DataFrame:
    """Every row block beside every anchor block of the same vector length: the query set against all rows, in blocks. Row blocks are
    dealt over cells, a task each, and the anchors go to every cell; what a task holds is its row blocks, anchors stream by."""
    asked = anchors.select(*[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "width", "v", "mean", "dev", *lists)])
    asked = asked.withColumn("a_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).repartition(cells, "a_cell")
    own = blocks.withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int")).repartition(cells, "cell")
    return asked.join(own.hint("merge"), (F.col("a_cell") == F.col("cell")) & (F.col("a_width") == F.col("width"))).drop("a_cell", "cell")


def _rows(batches):
    for b in batches:
        for n in range(b.num_rows):
            row = {name: b.column(c)[n] for c, name in enumerate(b.schema.names)}
            yield row, _block({x[2:]: row[x] for x in row if x.startswith("a_")}), _block(row)


def hard_negatives(df: DataFrame, is_anchor: Column, k: int = 5, positives: int = 5, share: int = 80, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score): for each anchor row and each of its best
    `positives` of the same label, the k best rows of another label that score from `share` hundredths of the positive's score to all
    of it. is_anchor: a condition of the columns id and label."""
    spark = df.sparkSession
    rows = quantised(df, id_col, vec_col, scale, label_col).select("id", F.col(label_col).cast("int").alias("label"), "v")
    rows = common.written(rows.filter("label IS NOT NULL"), "hn-vectors")
    n = rows.count()
    parts = min(max(spark.sparkContext.defaultParallelism, n // (16 * ROWS)), -(-n // ROWS) or 1)
    blocks = common.written(packed(rows.repartition(parts), ROWS), "hn-blocks")
    anchors = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("v", "label")).alias("a")).select("id", "a.label", "a.v")
    anchors = common.written(anchors, "hn-anchors")
    asked = common.written(packed(anchors, ANCHORS), "hn-asked")
    kind = rows.schema["id"].dataType.simpleString()

    def near(batches):
        for _, a, r in _rows(batches):
            i, j, s = best_positives(a, r, positives)
            yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(i)), r.ids.take(pa.array(j)), pa.array(s)], ["anchor_id", "positive_id", "positive_score"])

    cells = max(1, min(parts, -(-n // ROWS)), n // (CELL * ROWS))
    found = _pairs(blocks, asked, cells).mapInArrow(near, f"anchor_id {kind}, positive_id {kind}, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    good = common.written(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives), "hn-positives")

    wanted = good.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    asked = common.written(packed(anchors.join(wanted, "id"), ANCHORS, "scores"), "hn-wanted")

    def between(batches):
        for row, a, r in _rows(batches):
            scores = [np.array(x, np.int64) for x in row["a_scores"].as_py()]
            i, p, j, s = best_negatives(a, r, scores, k, share)
            yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(i)), pa.array(p), r.ids.take(pa.array(j)), pa.array(s)], ["anchor_id", "positive_score", "negative_id", "negative_score"])

    found = _pairs(blocks, asked, cells, "scores").mapInArrow(between, f"anchor_id {kind}, positive_score long, negative_id {kind}, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return good.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.pick(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.e) = len(r.e)
), p AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.row_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.row_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
