"""Nearest-neighbour phenotype prediction. A model is its table of training rows (train_id, label, profile)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatfold.functions.linkage import between
from beatfold.functions.scalars import phenotype_name
from beatfold.operators.blocks import matrix, met, packed
from beatfold.sources.shared import settled

BLOCK, QUERIES, PIVOTS = 4096, 1024, 256
MEETING = 512
ASKED_BYTES = 4 << 20


def knn_fit(profiles: DataFrame, labels: DataFrame, row_id: str = "patient_id", label: str = "cluster") -> DataFrame:
    """(train_id, label, profile); raises if a profile has no label or a label no profile."""
    a, b = profiles.count(), labels.count()
    model = profiles.join(labels.select(row_id, label), row_id).select(F.col(row_id).alias("train_id"), F.col(label).alias("label"), "profile")
    if a != b or model.count() != a:
        raise ValueError(f"{a} profiles and {b} labels do not match")
    return model


def _to_pivots(df: DataFrame, x: str, pivots: np.ndarray, schema: str, rows) -> DataFrame:
    """mapInArrow over df: `rows` makes batches from QUERIES rows at most and their distances to the pivots."""
    at = df.columns.index(x)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, QUERIES):
                b = whole.slice(i, QUERIES)
                yield from rows(b, between(matrix(b.column(at)), pivots))

    return df.mapInArrow(run, schema)


def _celled(model: DataFrame, n: int) -> tuple[np.ndarray, DataFrame, list]:
    """(pivots, model rows with the cell of their nearest pivot, (cell, n, radius) of each cell)."""
    few = min(PIVOTS, int(n**0.5)) if n > BLOCK else 1  # a single block needs no cells
    chosen = model.select("profile", F.xxhash64("train_id").alias("h")).orderBy("h").limit(few)
    pivots = np.unique(np.array([r.profile for r in chosen.collect()], float), axis=0)  # PIVOTS rows at most
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in model.schema.fields)

    def near(b, d):
        cell = d.argmin(1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "away"])

    rows = settled(_to_pivots(model, "profile", pivots, f"{kinds}, cell int, away double", near))
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("cell").collect()  # a row for each pivot
    return pivots, rows, cells


def asked_blocks(queries: DataFrame, pivots: np.ndarray, cells: list, k: int, known: bool = False) -> DataFrame:
    """(q, x, cell): the cells that a query (q, x) must meet. At first: its nearest ones that hold k rows. known (queries with `least`,
    their kth distance so far): those others that may hold a nearer row, as no row of a cell is nearer than the distance to its pivot
    less the cell's radius."""
    at, size, radius = np.array([c.cell for c in cells]), np.array([c.n for c in cells]), np.array([c.radius for c in cells])

    def rows(b, d):
        d = d[:, at]
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(size[order], axis=1)
        first = np.zeros(d.shape, bool)
        np.put_along_axis(first, order, held - size[order] < k, axis=1)
        if known:
            least = b.column(2).to_numpy()[:, None]
            first = ~first & (d - radius <= least * (1 + 1e-9) + 1e-12)
        q, c = np.nonzero(first)
        some = max(1, ASKED_BYTES // (8 * pivots.shape[1]))  # a query's profile goes to up to PIVOTS cells
        for i in range(0, len(q), some):
            take = pa.array(q[i : i + some])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at[c[i : i + some]].astype(np.int32))], ["q", "x", "cell"])

    return _to_pivots(queries, "x", pivots, f"q {queries.schema['q'].dataType.simpleString()}, x array<double>, cell int", rows)


def knn_neighbors(queries: DataFrame, model: DataFrame, k: int = 5, query_id: str = "query_id", profile: str = "profile", leave_own: bool = False) -> DataFrame:
    """(query_id, rank, train_id, label, distance): k nearest by Euclidean distance, ties by train_id; leave_own: training rows with
    the query's id do not count (ids are distinct).

    Training rows are dealt into the cells of a bounded number of pivots (rows with the least hashes). A query meets its nearest cells
    first; by the triangle inequality its kth distance then proves most other cells empty, and a second round meets the rest. Large
    cells are several blocks, so blocks of rows and lists of queries are of bounded size, whatever their number.
    """
    most, k = k, k + leave_own
    n = model.count()
    if n < k:
        raise ValueError(f"{n} training rows, fewer than k = {k}")
    pivots, rows, cells = _celled(model.select("train_id", "label", F.col("profile").cast("array<double>").alias("profile")), n)
    split = F.ceil(F.col("n") / BLOCK).cast("int")
    sizes = model.sparkSession.createDataFrame([(c.cell, c.n) for c in cells], "cell int, n long").select("cell", split.alias("blocks"))
    rows = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("train_id"), F.col("blocks")))
    train = settled(rows.groupBy("cell", "block").agg(F.collect_list(F.struct("train_id", "label", "profile")).alias("t")))  # about BLOCK rows
    ask = queries.select(F.col(query_id).alias("q"), F.col(profile).cast("array<double>").alias("x"))
    q_kind, t_kind, l_kind = queries.schema[query_id].dataType.simpleString(), model.schema["train_id"].dataType.simpleString(), model.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, t = batch.column(0)[i].values, batch.column(1)[i].values
                x, y = matrix(a.field("x")), matrix(t.field("profile"))
                names = t.field("train_id").to_numpy(zero_copy_only=False)
                found = []
                for j, v in enumerate(x):
                    d = np.sqrt(((y - v) ** 2).sum(1))
                    near = np.nonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])[0]
                    near = near[np.lexsort((names[near], d[near]))][:k]
                    found += [(j, m, d[m]) for m in near]
                js, ms = pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([a.field("q").take(js), t.field("train_id").take(ms), t.field("label").take(ms), pa.array([f[2] for f in found], pa.float64())], ["query_id", "train_id", "label", "distance"])

    def met(asked: DataFrame) -> DataFrame:
        asked = asked.join(F.broadcast(sizes), "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        lists = F.pmod(F.xxhash64("q"), F.ceil(F.count("*").over(Window.partitionBy("cell", "block")) / QUERIES))
        asked = asked.withColumn("part", lists).groupBy("cell", "block", "part").agg(F.collect_list(F.struct("q", "x")).alias("a"))
        return asked.join(train, ["cell", "block"]).select("a", "t").mapInArrow(run, f"query_id {q_kind}, train_id {t_kind}, label {l_kind}, distance double")

    w = Window.partitionBy("query_id").orderBy("distance", "train_id")
    best = lambda df, most: df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    part = met(asked_blocks(ask, pivots, cells, k))
    if len(cells) > 1:
        part = settled(best(part, k).drop("rank"))
        least = part.groupBy(F.col("query_id").alias("q")).agg(F.max("distance").alias("least"))
        part = part.unionByName(met(asked_blocks(ask.join(least, "q").select("q", "x", "least"), pivots, cells, k, True)))
    if leave_own:
        part = part.filter(~F.col("query_id").eqNullSafe(F.col("train_id")))
    return best(part, most).select("query_id", "rank", "train_id", "label", "distance")


class _Nearest:
    """A block's rows and the k nearest others that each has met so far."""

    def __init__(self, rows: pa.Array):
        self.ids, self.labels, self.x = rows.field("p"), rows.field("l"), matrix(rows.field("x"))
        self.names = self.ids.to_numpy(zero_copy_only=False)
        self.bound = np.full(len(self.x), np.inf)
        self.found: list = []  # of each row, at most k: (row, distance, other's name), and where the other stands

    def meet(self, other: _Nearest, rough: np.ndarray, k: int) -> None:
        """rough: squared distances, with rounding; those that may be among the k least are taken again from the differences."""
        most = self.bound**2
        if np.isinf(most).any() and len(other.x) > k:
            most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1])
        row, at = np.nonzero((rough <= (most * (1 + 1e-6) + 1e-12)[:, None]) & (rough < np.inf))
        if not len(row):
            return
        d = np.sqrt(((self.x[row] - other.x[at]) ** 2).sum(1))
        self.found.append((row, d, other.names[at], other.ids.take(pa.array(at)), other.labels.take(pa.array(at))))
        row, d, name = (np.concatenate([f[c] for f in self.found]) for c in range(3))
        ids, labels = (pa.concat_arrays([f[c] for f in self.found]) for c in (3, 4))
        order = np.lexsort((name, d, row))
        first = np.searchsorted(row[order], np.arange(len(self.x)))
        order = order[np.arange(len(row)) - first[row[order]] < k]
        self.found = [(row[order], d[order], name[order], ids.take(pa.array(order)), labels.take(pa.array(order)))]
        count = np.bincount(row[order], minlength=len(self.x))
        full = count == k
        self.bound[full] = d[order][np.cumsum(count)[full] - 1]


def knn_among(model: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, train_id, label, distance): of every row (train_id, label, profile), its k nearest others by Euclidean distance,
    ties by train_id; ids are distinct.

    All rows ask all rows, so blocks of them meet in a grid of tasks, each pair of blocks as one numpy product for both sides; a task
    keeps k rows for each of its own.
    """
    n = model.count()
    if n <= k:
        raise ValueError(f"{n} rows, so that none has k = {k} others")
    kind = {c: model.schema[c].dataType.simpleString() for c in ("train_id", "label")}
    count = -(-n // MEETING)
    rows = model.select(F.lit(0).alias("g"), F.col("train_id").alias("p"), F.col("label").alias("l"), F.col("profile").cast("array<double>").alias("x"))
    blocks = settled(packed(rows, F.pmod(F.xxhash64("p"), F.lit(count)), "p", "l", "x"))

    def run(pairs):
        held: dict = {}
        for _, i, j, a, b in pairs:
            held |= {i: a, j: b}
            d = between(a.x, b.x, squared=True)
            if i == j:
                np.fill_diagonal(d, np.inf)
            a.meet(b, d, k)
            if i != j:
                b.meet(a, np.ascontiguousarray(d.T), k)
        for a in held.values():
            for row, d, _, ids, labels in a.found:
                yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(row)), ids, labels, pa.array(d)], ["query_id", "train_id", "label", "distance"])

    near = met(blocks, _Nearest, run, f"query_id {kind['train_id']}, train_id {kind['train_id']}, label {kind['label']}, distance double", count)
    w = Window.partitionBy("query_id").orderBy("distance", "train_id")
    near = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return near.select("query_id", "rank", "train_id", "label", "distance")


def knn_proba(neighbors: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, label, proba) for every class (rows `label`, few): its share of the k votes."""
    votes = neighbors.groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    grid = neighbors.select("query_id").distinct().crossJoin(F.broadcast(labels.select("label").distinct()))  # a row for each class
    return grid.join(votes, ["query_id", "label"], "left").select("query_id", "label", (F.coalesce("votes", F.lit(0)) / F.lit(float(k))).alias("proba"))


def knn_with_confidence(neighbors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, chronophenotype, confidence): the label of most votes (the least on ties) and its share."""
    votes = neighbors.groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("query_id").orderBy(F.desc("votes"), F.asc("label"))
    best = votes.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return best.select("query_id", F.col("label").alias("chronophenotype"), (F.col("votes") / F.lit(float(k))).alias("confidence"))


def knn_predict(neighbors: DataFrame, k: int = 5) -> DataFrame:
    return knn_with_confidence(neighbors, k).select("query_id", "chronophenotype")


def prediction_summary(pred: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """(chronophenotype, name, n, mean_confidence)"""
    rows = pred.groupBy("chronophenotype").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))
    return rows.withColumn("name", phenotype_name(F.col("chronophenotype"), names))


def training_summary(model: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """(label, name, n_rows, n_subjects)"""
    rows = model.groupBy("label").agg(F.count("*").alias("n_rows"), F.countDistinct("train_id").alias("n_subjects"))
    return rows.withColumn("name", phenotype_name(F.col("label"), names))


def phenotype_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("chronophenotype").agg(F.count("*").alias("n")).orderBy("chronophenotype")
