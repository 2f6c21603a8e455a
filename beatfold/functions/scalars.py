"""Column functions of rhythm analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatfold.sources.shared import ranged

#: Fixed value: double precision epsilon, which stands for undefined precision, recall and F-beta.
EPSILON = 2.220446049250313e-16


def positive(df: DataFrame, label: str = "pred") -> DataFrame:
    """Rows whose label is true (or 1); without the label column all rows count as positive."""
    return df.filter(F.col(label).cast("boolean")) if label in df.columns else df


def record_id(c: Column) -> Column:
    """Record id as text, zero-filled to three places; longer ids stay whole. Ids read as floats lose their fraction first."""
    whole = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.when(F.length(whole) < 3, F.lpad(whole, 3, "0")).otherwise(whole)


def clock_seconds(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "HH:mm:ss", "HH:mm", "dd/MM/yyyy HH:mm:ss")) -> Column:
    """Seconds since midnight of a clock or date text; null if no format fits."""
    t = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("double")


def hour_bin(seconds: Column, n_bins: int = 24) -> Column:
    """Hour since midnight in a cycle of n_bins hours; fractions are cut off toward zero."""
    return F.pmod((seconds / 3600).cast("long"), F.lit(n_bins)).cast("int")


def over_threshold(proba: Column, threshold: float | None, own: Column | None = None) -> Column:
    """1 where the probability is above (not at) the threshold; without a threshold the model's own label."""
    return own.cast("int") if threshold is None else (proba > F.lit(float(threshold))).cast("int")


def oriented(score: Column, sign: int) -> Column:
    return score * F.lit(float(sign))


def phenotype_name(cluster: Column, names: dict[int, str] | None = None) -> Column:
    """The cluster's name; `Cluster {id}` for those without."""
    default = F.concat(F.lit("Cluster "), cluster.cast("string"))
    if not names:
        return default
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(known, cluster), default)


def silhouette_band(c: Column) -> Column:
    return F.when(c > 0.7, "strong").when(c > 0.5, "reasonable").when(c > 0.25, "weak").otherwise("none")


def davies_bouldin_band(c: Column) -> Column:
    return F.when(c < 0.5, "excellent").when(c < 1.0, "good").when(c < 2.0, "moderate").otherwise("poor")


def over(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def encoded_ids(df: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """df with id_code: 0-based rank of its id among the sorted distinct ids, ranked by ranges of ids."""
    ids = ranged(df.select(id_col).filter(F.col(id_col).isNotNull()).distinct(), F.asc(id_col))
    before, total = [], 0
    for part, n in sorted((r.part, r["count"]) for r in ids.groupBy("part").count().collect()):  # a row for each range
        before.append((part, total))
        total += n
    before = df.sparkSession.createDataFrame(before, "part int, before long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(id_col)).cast("long") - 1
    codes = ids.join(F.broadcast(before), "part").select(id_col, (F.col("before") + own).alias("id_code"))
    return df.join(codes, id_col, "left")


def profile_columns(columns: list[str], id_col: str = "patient_id") -> list[str]:
    """Columns that hold a profile: all but the id, the cluster and the mean."""
    return [c for c in columns if c not in (id_col, "cluster", "mean_burden")]


def to_long(wide: DataFrame, id_col: str = "patient_id", prefix: str = "h") -> DataFrame:
    """(id, time_bin, burden) of wide profile columns."""
    cols = profile_columns(wide.columns, id_col)
    long = wide.unpivot(id_col, cols, "name", "burden")
    return long.select(id_col, F.regexp_replace("name", f"^{prefix}0*(?=\\d)", "").cast("int").alias("time_bin"), F.col("burden").cast("double"))


def to_array(long: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """(id, profile): burdens in order of their bins."""
    packed = F.array_sort(F.collect_list(F.struct("time_bin", "burden")))
    return long.groupBy(id_col).agg(F.transform(packed, lambda x: x["burden"]).alias("profile"))


def from_array(df: DataFrame, id_col: str = "patient_id", profile: str = "profile") -> DataFrame:
    """(id, time_bin, burden) of profile arrays."""
    return df.select(id_col, F.posexplode(profile).alias("time_bin", "burden"))
