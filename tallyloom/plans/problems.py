"""Queries of the general problems: minute grid (p5) and continuous periods with their gaps (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import grid, spans
from tallyloom.session import load


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.minute_grid(load(spark, d, "power_log")).where("missing").select("device", "tag", "minute_epoch")


def p5_minute_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.minute_grid(load(spark, d, "power_log"))


def p5_grid_checked(spark: SparkSession, d: str) -> DataFrame:
    """The grid with what SQL can say of it: counts and means as they are, the filled values as whether they can be right."""
    g = p5_minute_grid(spark, d)
    sane = F.col("smooth_watts").isNotNull() & (F.col("smooth_watts") >= 0) & (F.col("smooth_sd") >= 0) & ~F.isnan("smooth_watts") & ~F.isnan("smooth_sd")
    return g.select("device", "tag", "minute_epoch", "n_readings", F.round("mean_watts", 4).alias("mean_watts"), "missing", F.coalesce(sane, F.lit(False)).alias("filled"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.clear_runs(load(spark, d, "intervals")).selectExpr("label", "start_us AS gap_start_us", "end_us AS gap_end_us")


def p7_periods(spark: SparkSession, d: str) -> DataFrame:
    return spans.set_runs(load(spark, d, "intervals")).selectExpr("label", "start_us AS period_start_us", "end_us AS period_end_us")


QUERIES = {f.__name__: f for f in (p5_found, p5_minute_grid, p5_grid_checked, p7_found, p7_periods)}

#: Usable readings of power_log, for SQL: at_us, watts, device, tag.
READINGS = r"""
    readings AS (
        SELECT DISTINCT device, tag, watts,
               CASE WHEN regexp_matches(trim(iso_ts), '(Z|[+-]\d{2}:\d{2})$') THEN epoch_us(try_cast(trim(iso_ts) AS TIMESTAMPTZ)) ELSE epoch_us(try_cast(trim(iso_ts) AS TIMESTAMP)) END AS at_us
        FROM power_log
        WHERE watts >= 0 AND isfinite(watts) AND regexp_matches(trim(iso_ts), '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$')),
    usable AS (SELECT * FROM readings WHERE at_us IS NOT NULL)"""

_MERGED = """
    WITH v AS (SELECT label, epoch_us(start_at) AS lo, epoch_us(end_at) AS hi FROM intervals WHERE label IS NOT NULL AND start_at < end_at),
    r AS (SELECT *, max(hi) OVER (PARTITION BY label ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r)"""

SQL = {
    "p5_found": f"""
        WITH {READINGS},
        m AS (SELECT DISTINCT device, tag, at_us // 60000000 AS minute FROM usable),
        s AS (SELECT *, lead(minute) OVER (PARTITION BY device, tag ORDER BY minute) AS following FROM m)
        SELECT device, tag, unnest(range(minute + 1, following)) * 60 AS minute_epoch FROM s WHERE following > minute + 1""",
    "p5_grid_checked": f"""
        WITH {READINGS}, m AS (SELECT device, tag, at_us // 60000000 AS minute, count(*) AS n, avg(watts) AS w FROM usable GROUP BY 1, 2, 3),
        g AS (SELECT device, tag, unnest(range(min(minute), max(minute) + 1)) AS minute FROM m GROUP BY 1, 2)
        SELECT g.device, g.tag, g.minute * 60 AS minute_epoch, coalesce(n, 0) AS n_readings, round(w, 4) AS mean_watts, n IS NULL AS missing, true AS filled
        FROM g LEFT JOIN m ON g.minute = m.minute AND g.device IS NOT DISTINCT FROM m.device AND g.tag IS NOT DISTINCT FROM m.tag""",
    "p7_found": f"{_MERGED} SELECT label, reach AS gap_start_us, lo AS gap_end_us FROM r WHERE lo > reach",
    "p7_periods": f"{_MERGED} SELECT label, min(lo) AS period_start_us, max(hi) AS period_end_us FROM g GROUP BY label, run",
}
