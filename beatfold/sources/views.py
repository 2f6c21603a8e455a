"""Heart-rhythm tables derived from the star-schema tables: what the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WINDOWS = """
SELECT user_id AS patient_id, event_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS prec_window,
       CAST((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE) AS start_time,
       CAST((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) + 30 AS DOUBLE) AS end_time,
       CAST(20 + event_id % 41 AS DOUBLE) AS dur_sec,
       CAST(least(value / CAST(200 AS DOUBLE), CAST(1 AS DOUBLE)) AS DOUBLE) AS proba,
       CAST(CASE WHEN value > 50 THEN 1 ELSE 0 END AS INT) AS pred,
       CAST(CASE WHEN value + 40 * (event_id % 3) > 80 THEN 1 ELSE 0 END AS INT) AS true_label,
       CAST(CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS INT) AS is_af
FROM events"""
ROW_ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate"
BEATS = f"""
SELECT l_suppkey AS patient_id, seq, ticks,
       CAST(sample AS BIGINT) AS sample,
       ticks / CAST(200 AS DOUBLE) AS rr_data,
       sample / CAST(200 AS DOUBLE) AS rr_time, rhythm
FROM (SELECT l_suppkey, ticks, rhythm,
             row_number() OVER (PARTITION BY l_suppkey ORDER BY {ROW_ORDER}) AS seq,
             sum(ticks) OVER (PARTITION BY l_suppkey ORDER BY {ROW_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sample
      FROM (SELECT *, CAST(80 + 4 * l_quantity AS BIGINT) AS ticks,
                   CASE l_returnflag WHEN 'R' THEN '(AFIB' WHEN 'N' THEN '(N' ELSE '' END AS rhythm
            FROM lineitem) q) w"""
PROFILES = "SELECT vec_id, label, CAST(embedding AS {array}) AS profile FROM embeddings"
META = "SELECT CAST(c_custkey AS STRING) AS data_id, c_custkey % 24 AS start_hour, c_custkey % 60 AS start_minute FROM customer"


def _view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """The SQL over one table, read for this call alone (no temporary view is left behind)."""
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window predictions: an event is a 30 s window of a patient."""
    return _view(spark, sf_dir, "events", WINDOWS)


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats and peaks at 200 Hz: a line item is a beat of a patient."""
    return _view(spark, sf_dir, "lineitem", BEATS)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled profile vectors."""
    return _view(spark, sf_dir, "embeddings", PROFILES.format(array="ARRAY<DOUBLE>"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording metadata: when each recording began."""
    return _view(spark, sf_dir, "customer", META)


#: The same views for DuckDB, as common table expressions.
CTES = {"v_windows": WINDOWS, "v_beats": BEATS, "v_profiles": PROFILES.format(array="DOUBLE[]"), "v_meta": META}


def duck(sql: str, *views: str) -> str:
    """DuckDB SQL with the named views in front; sql may start with further common table expressions (WITH ...)."""
    head = ", ".join(f"{v} AS ({CTES[v]})" for v in views)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE" if recursive else "WITH") :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body}"
    return f"WITH {head} {body}"
