"""The time rules as temporary SQL functions; Catalyst inlines their bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .times import FULL_DAY, HALF_DAY, LEAD_BANDS


def register(spark: SparkSession) -> None:
    """Create `tk_clock`, `tk_fold`, `tk_delay` and `tk_lead_band` in the session."""
    bands = " ".join(f"WHEN s >= {lo} AND s < {hi} THEN '{name}'" for lo, hi, name in LEAD_BANDS)
    for name, args, returns, body in (
        ("tk_clock", "t STRING", "INT",
         "CASE WHEN t NOT IN ('', '00:00', '00:00:00') THEN try_cast(split(trim(t), ':')[0] AS INT) * 3600"
         " + try_cast(try_element_at(split(trim(t), ':'), 2) AS INT) * 60"
         " + CASE WHEN size(split(trim(t), ':')) > 2 THEN try_cast(try_element_at(split(trim(t), ':'), 3) AS INT) ELSE 0 END END"),
        ("tk_fold", "d INT", "INT",
         f"CASE WHEN d > {HALF_DAY} THEN d - {FULL_DAY} WHEN d < -{HALF_DAY} THEN d + {FULL_DAY} ELSE d END"),
        ("tk_delay", "a INT, b INT", "INT",
         f"CASE WHEN a - b > {HALF_DAY} THEN a - b - {FULL_DAY} WHEN a - b < -{HALF_DAY} THEN a - b + {FULL_DAY} ELSE a - b END"),
        ("tk_lead_band", "s INT", "STRING", f"CASE WHEN s < 0 THEN NULL {bands} END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
