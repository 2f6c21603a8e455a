"""Connected components of an edge table, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatfold.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): every node that has an edge, with the least node it is connected to.

    Each round takes the least label among a node and its neighbours, then the label of that label (pointer jumping), so labels
    travel twice as far each round. Every round is a written table; only counts reach the driver. Edges with a null end are
    dropped, self-loops and repeated edges do no harm; an empty table gives an empty result.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = common.written(ends.union(ends.select("v", "u")).distinct(), "cc-edges")
    labels = common.written(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("comp")), "cc-labels")
    if labels.isEmpty():
        return labels
    while True:
        near = both.filter("u <> v").join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("comp").alias("low"))
        hooked = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        hooked = common.written(hooked, "cc-hooked")
        roots = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        jumped = common.written(hooked.join(roots, "comp").select("node", "old", F.col("root").alias("comp")), "cc-labels")
        labels = jumped.select("node", "comp")
        if jumped.filter("old <> comp").isEmpty():
            return labels
