"""Scoring of windows by a model of the user's: a function from a batch of arrays to probabilities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[..., np.ndarray]


def score_windows(df: DataFrame, scorer: Scorer, values: str = "rr", extra: tuple[str, ...] = ("prec_window",), threshold: float = 0.5, batch: int = 512) -> DataFrame:
    """df without its arrays, with proba and pred. The scorer gets a 2-D array of the values and one array for each extra column.

    Arrays stay in their task (no shuffle); batches are bounded, so that long windows fit.
    """
    keep = [c for c in df.columns if c != values]
    rows = df.select(values, *keep)

    def run(batches):
        for b in (whole.slice(at, batch) for whole in batches for at in range(0, whole.num_rows, batch)):
            if b.num_rows:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float)
                more = [b.column(b.schema.get_field_index(c)).to_numpy() for c in extra]
                proba = np.asarray(scorer(x, *more), float).reshape(-1)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(proba)], [*keep, "proba"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, proba double").withColumn("pred", F.col("proba") > threshold)


def score_sequences(df: DataFrame, scorer: Scorer, context: str = "context", extra: tuple[str, ...] = ("prec_window",), threshold: float = 0.5) -> DataFrame:
    """The same over windows with their preceding ones: the scorer gets (n, windows, values), zeros where a record has not begun."""
    width = F.aggregate(context, F.lit(0), lambda a, x: F.greatest(a, F.coalesce(F.size(x), F.lit(0))))
    flat = F.flatten(F.transform(context, lambda x: F.when(x.isNull(), F.array_repeat(F.lit(0.0), F.col("_w"))).otherwise(x)))
    rows = df.withColumn("_w", width).withColumn("_flat", flat).withColumn("_n", F.size(context)).drop(context)

    def run(x, n, *more):
        return scorer(x.reshape(len(x), int(n[0]), -1), *more)

    return score_windows(rows.drop("_w"), run, "_flat", ("_n", *extra), threshold).drop("_n")
