"""The general training-data query of the core: continuous periods and gaps (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.common import clean_id, table
from chronoweave.operators.intervals import merged_and_gaps, periods_and_gaps


def _args(spark: SparkSession, d: str):
    return table(spark, d, "admissions"), clean_id("subject_id"), F.col("admittime"), F.col("dischtime"), clean_id("hadm_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return merged_and_gaps(*_args(spark, d))


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(*_args(spark, d)).select(F.col("entity").alias("subject_id"), "start_s", "end_s", "n_intervals", "gap_from_s")


_ID = r"nullif(regexp_replace(regexp_replace({c}, '\s+', '', 'g'), '\.0$', ''), '')"
_ISLANDS = f"""
WITH r AS (SELECT {_ID.format(c="subject_id")} AS e, CAST(floor(epoch(admittime)) AS BIGINT) AS s, CAST(floor(epoch(dischtime)) AS BIGINT) AS t, {_ID.format(c="hadm_id")} AS h FROM admissions),
v AS (SELECT * FROM r WHERE e IS NOT NULL AND s IS NOT NULL AND t >= s),
m AS (SELECT *, max(t) OVER (PARTITION BY e ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY e ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT e, k, min(s) AS a, max(t) AS b, count(DISTINCT h) AS n, count(*) AS rows FROM g GROUP BY ALL),
q AS (SELECT *, lag(b) OVER (PARTITION BY e ORDER BY a) AS before FROM p)
"""
QUERIES = {"p4_found": p4_found, "p4_periods": p4_periods}
ORACLES = {
    "p4_found": _ISLANDS + "SELECT e AS subject_id, 'merged' AS kind, a AS start_s, b AS end_s FROM q WHERE n >= 2 UNION ALL SELECT e, 'gap', before, a FROM q WHERE before IS NOT NULL",
    "p4_periods": _ISLANDS + "SELECT e AS subject_id, a AS start_s, b AS end_s, rows AS n_intervals, before AS gap_from_s FROM q",
}
