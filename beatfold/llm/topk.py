"""Exact top-k inner products by distributed histogram selection.

Vectors are turned into integers and written once; queries are taken in blocks of bounded size, and each block is scored against all
rows (a block's work is BLOCK products a row, far more than reading the row). Every task histograms its scores, the histograms are
summed over all tasks, and the bin that holds each query's kth value is refined until it is a single score. A last pass keeps what reaches that score; ties go to the smaller id. A task reports only bins and
rows from its own kth score up: a score below any task's kth cannot be among the k best of all.

Nulls: rows with a null id, a null vector, or null or non-finite components take no part. Vectors of different lengths are not
compared. A query's own row is every row with its id; of several query rows with one id the least vector is the query. Repeated
rows are separate candidates. Fewer than k candidates: all are returned. Empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatfold.llm import common

BINS, BLOCK, ROWS = 512, 4096, 512
ASKED = "_asked"


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 256, *more: str) -> DataFrame:
    """Rows that take part, as (id, v array<bigint>, *more)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    df = common.pick(df, id_col, vec_col, *more).select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("x"), *more)
    df = df.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
    return df.select("id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"), *more)


def products(rows: np.ndarray, queries: np.ndarray, most: float) -> np.ndarray:
    """Exact integer inner products; most: a bound of their size."""
    if most < 2**53:
        return (rows.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return rows @ queries.T
    return (rows.astype(object) @ queries.T.astype(object)).astype(np.int64)


def _scored(batches, ids, vecs, most):
    """For each batch and vector length: row ids, positions of the block's queries, the score matrix and which pairs count."""
    by_len = {}
    for n, v in enumerate(vecs):
        by_len.setdefault(len(v), []).append(n)
    groups = {d: (np.array(at), np.array([ids[n] for n in at]), np.array([vecs[n] for n in at], np.int64).reshape(len(at), d)) for d, at in by_len.items()}
    for b in batches:
        lists, row_ids = b.column(1), b.column(0).to_numpy()
        lens = np.diff(lists.offsets.to_numpy())
        flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
        for d, (at, qid, q) in groups.items():
            rows = np.nonzero(lens == d)[0]
            for lo in range(0, len(rows), ROWS):
                r = rows[lo : lo + ROWS]
                v = flat[starts[r][:, None] + np.arange(d)] if d else np.zeros((len(r), 0), np.int64)
                yield row_ids[r], at, products(v, q, most), row_ids[r][:, None] != qid[None]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Each column's k best values so far, worst first."""
    return np.sort(scores, axis=0)[-k:]


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank int, <id_col>, score long): the k rows of the highest integer inner product for each query row. is_query: a
    condition of the columns id_col and vec_col."""
    spark = df.sparkSession
    df = common.pick(df, id_col, vec_col).withColumn(ASKED, is_query)
    cands = common.written(quantised(df, id_col, vec_col, scale, ASKED), "topk-vectors")
    chosen = cands.filter(ASKED).groupBy("id").agg(F.min("v").alias("v"))
    chosen = common.written(chosen.withColumn("n", F.xxhash64("id")), "topk-queries")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    cands = cands.select("id", "v")
    longest = cands.agg(F.max(size)).first()[0] or 0.0
    blocks = max(1, math.ceil(chosen.count() / block))
    path = common.new_path(spark, "topk")
    empty = spark.createDataFrame([], f"query_id {cands.schema['id'].dataType.simpleString()}, {id_col} {cands.schema['id'].dataType.simpleString()}, score long")
    empty.write.parquet(path)
    for n in range(blocks):
        rows = chosen.filter(F.pmod("n", F.lit(blocks)) == n).select("id", "v").collect()  # a block of bounded size
        if rows:
            _select(cands, [r.id for r in rows], [r.v for r in rows], k, longest, id_col).write.mode("append").parquet(path)
    found = spark.read.schema(empty.schema).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def _select(cands: DataFrame, ids: list, vecs: list, k: int, longest: float, id_col: str) -> DataFrame:
    n = len(ids)
    bound = np.array([math.floor(math.sqrt(float(sum(float(x) * x for x in v))) * longest * (1 + 1e-9)) + 1 for v in vecs], dtype=object)
    most = float(max(bound))
    if most >= 2**62:
        raise ValueError("inner products may leave 64 bits: take a smaller scale")
    low, high = (-bound).astype(np.int64), bound.astype(np.int64)
    need = np.full(n, k, np.int64)  # how many of the bin [low, high] are among the k best

    while (high > low).any():
        width = (high - low) // BINS + 1

        def histogram(batches, low=low, high=high, width=width):
            held = np.zeros((n, BINS), np.int64)
            best = {}
            for _, at, s, ok in _scored(batches, ids, vecs, most):
                bins = (s - low[at]) // width[at]
                inside = ok & (s >= low[at]) & (s <= high[at])
                flat = (np.arange(len(at)) * BINS + bins)[inside]
                held[at] += np.bincount(flat, minlength=len(at) * BINS).reshape(len(at), BINS)
                own = np.where(inside, bins, -1)
                key = len(at), int(at[0])
                best[key] = (at, _best(np.vstack([best[key][1], own]) if key in best else own, k))
            for at, top in best.values():
                if len(top) == k:
                    held[at] *= np.arange(BINS) >= np.maximum(top[0], 0)[:, None]
            q, bins = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(held[q, bins])], ["q", "bin", "n"])

        sums = cands.mapInArrow(histogram, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        sums = sums.withColumn("above", F.sum("n").over(down) - F.col("n"))
        wanted = cands.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(need)], "q int, need long")
        sums = sums.join(F.broadcast(wanted), "q").filter(F.col("above") < F.col("need"))
        held = {r.q: r for r in sums.groupBy("q").agg(F.min("bin").alias("bin"), F.max("above").alias("above"), F.sum("n").alias("n")).collect()}  # a row for each query of the block
        for i in range(n):
            r = held.get(i)
            if r is None or r.n < need[i]:  # fewer than k candidates: all are wanted
                high[i] = low[i]
                continue
            need[i] -= r.above
            low[i] += r.bin * width[i]
            high[i] = min(high[i], low[i] + width[i] - 1)

    def reach(batches):
        held = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n
        kind = np.asarray(ids).dtype
        for rid, at, s, ok in _scored(batches, ids, vecs, most):
            hit = ok & (s >= low[at])
            for j in np.nonzero(hit.any(0))[0]:
                r, q = hit[:, j], at[j]
                i, v = np.concatenate([held[q][0].astype(kind), rid[r]]), np.concatenate([held[q][1], s[r, j]])
                keep = np.lexsort((i, -v))[:k]
                held[q] = i[keep], v[keep]
        for q, (i, v) in enumerate(held):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(i)), pa.array(i), pa.array(v)], ["query_id", id_col, "score"])

    kind = cands.schema["id"].dataType.simpleString()
    return cands.mapInArrow(reach, f"query_id {kind}, {id_col} {kind}, score long")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
