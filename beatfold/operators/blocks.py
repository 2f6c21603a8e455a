"""Pairs of rows without rows of pairs: rows are packed into blocks, and tasks meet blocks in a grid."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 128


def packed(rows: DataFrame, block: Column, *columns: str, group: str = "g") -> DataFrame:
    """(g, i, rows): one row for each block i of a group, with the named columns of its rows."""
    return rows.withColumn("i", block).groupBy(group, "i").agg(F.collect_list(F.struct(*columns)).alias("rows"))  # a block is bounded


def met(blocks: DataFrame, make: Callable, run: Callable, schema: str, count: int, groups: int = 1, tasks: int | None = None, group: str = "g") -> DataFrame:
    """What `run` gives for the pairs i <= j of a group's blocks (each pair once): it gets (group's id, i, j, left, right) of a task's pairs,
    and yields record batches of `schema`. A block is what `make` gives for its rows, and one object within a task.

    Blocks are dealt over a grid of S x S cells for each group, so each is copied 2 * S times, and a cell gets its blocks (not its pairs)
    as rows. S follows the cluster's cores, and beyond CELL blocks to a line of the grid (count: of all groups' blocks) their number,
    so that what a task holds is bounded.
    """
    cores = tasks or 4 * blocks.sparkSession.sparkContext.defaultParallelism
    side = max(1, math.ceil(math.sqrt(cores / max(1, groups))), math.ceil(count / max(1, groups) / CELL))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    line = F.pmod(F.xxhash64("i"), F.lit(side)).cast("int")
    left = blocks.select(group, "i", "rows", line.alias("down")).withColumn("across", every)
    right = blocks.select(F.col(group).alias("_g"), F.col("i").alias("j"), F.col("rows").alias("r"), line.alias("_across")).withColumn("_down", every)
    keys = [[group, "down", "across"], ["_g", "_down", "_across"]]
    parts = 2 * side * side * groups  # a set number, so that few bytes of much work are not gathered into one task
    kinds = blocks.sparkSession.createDataFrame([], schema).toArrow().schema

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        made: dict = {}

        def sides(t: pa.Table) -> list:
            names, rows = t.column(1).to_pylist(), t.column(2)
            for n, i in enumerate(names):
                if i not in made:
                    made[i] = make(rows[n].values)
            return sorted(names)

        down, across = sides(left), sides(right)
        return pa.Table.from_batches([*run((key[0].as_py(), i, j, made[i], made[j]) for i in down for j in across if i <= j)], kinds)

    left, right = (df.repartition(parts, *k).groupBy(*k) for df, k in zip((left, right), keys, strict=True))
    return left.cogroup(right).applyInArrow(cell, schema)


def matrix(x: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as a matrix."""
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1) if len(x) else np.zeros((0, 0))
