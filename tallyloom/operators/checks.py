"""Checks of a finished report as predicates over its long tables; each gives (check_name, cell, metric, status, got, expected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, name: str, ok: Column, got: Column, expected: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), F.col("cell"), F.col("metric"), F.when(ok, "pass").otherwise("fail").alias("status"), got.cast("string").alias("got"), expected.cast("string").alias("expected"))


def verify_deltas(deltas: DataFrame, contrasts: int) -> DataFrame:
    """Order of the ends, delta within them, significance as the ends say, Bonferroni identity, p within bounds."""
    lo, hi, d = F.col("ci_low"), F.col("ci_high"), F.col("delta")
    whole = deltas.where("ci_low is not null")
    parts = [
        _rows(whole, "ends_in_order", lo <= hi, lo, hi),
        _rows(whole, "delta_within_ends", (d >= lo - 1e-9) & (d <= hi + 1e-9), d, lo),
        _rows(whole, "flag_matches_ends", F.col("significant") == ((lo > 0) | (hi < 0)), F.col("significant"), (lo > 0) | (hi < 0)),
        _rows(deltas.where("perm_p is not null"), "p_within_bounds", (F.col("perm_p") > 0) & (F.col("perm_p") <= 1), F.col("perm_p"), F.lit(1.0)),
        _rows(deltas.where("perm_p is not null"), "bonferroni", F.abs(F.col("perm_p_bonferroni") - F.least(F.lit(1.0), F.col("perm_p") * contrasts)) < 1e-9, F.col("perm_p_bonferroni"), F.least(F.lit(1.0), F.col("perm_p") * contrasts)),
        _rows(deltas, "method_known", F.col("method").isin("BCa", "degenerate", "none", "unbounded"), F.col("method"), F.lit("BCa")),
    ]
    return reduce(DataFrame.unionByName, parts)


def verify_report(cells: DataFrame, deltas: DataFrame, *, reference: str, grid: list[str], offgrid: list[str] = ()) -> DataFrame:
    """Every check of a whole report: its levels, its blocks of deltas, and how they fit together.

    cells(cell, metric, n, mean, ci_low, ci_high); deltas(cell, metric, block grid or offgrid, n, delta, ci_low, ci_high,
    significant, method, perm_p, perm_p_bonferroni). Grid deltas are corrected for len(grid) - 1 contrasts, off-grid ones
    for none. A flag that is missing is skipped, not failed.
    """
    contrasts = max(1, len(grid) - 1)
    parts = [_rows(cells.where("ci_low is not null and ci_high is not null"), "level_within_ends", (F.col("mean") >= F.col("ci_low") - 1e-9) & (F.col("mean") <= F.col("ci_high") + 1e-9), F.col("mean"), F.col("ci_low"))]
    for block, k in (("grid", contrasts), ("offgrid", 1)):
        parts.append(verify_deltas(deltas.where(F.col("block") == block), k))
    # Pairs can't be more than either cell's questions; each cell stands in its own block, and the blocks are whole.
    sizes = cells.select("cell", "metric", F.col("n").alias("cell_n"))
    ref = cells.where(F.col("cell") == reference).select("metric", F.col("n").alias("ref_n"))
    paired = deltas.join(sizes, ["cell", "metric"], "left").join(ref, "metric", "left")
    parts.append(_rows(paired, "paired_within_cells", F.col("n") <= F.least("cell_n", "ref_n"), F.col("n"), F.least("cell_n", "ref_n")))
    home = F.when(F.col("cell").isin(*grid), "grid").when(F.col("cell").isin(*offgrid), "offgrid")
    parts.append(_rows(deltas, "block_of_cell", (F.col("block") == home) & (F.col("cell") != reference), F.col("block"), home))
    family = cells.select("metric").distinct().join(deltas.where("block = 'grid'").groupBy("metric").agg(F.countDistinct("cell").alias("got")), "metric", "left").withColumns({"cell": F.lit("all"), "got": F.coalesce("got", F.lit(0))})
    parts.append(_rows(family, "family_size", F.col("got") == len(grid) - 1, F.col("got"), F.lit(len(grid) - 1)))
    held = cells.groupBy("metric").agg(F.count_if(F.col("cell") == reference).alias("got")).withColumn("cell", F.lit(reference))
    parts.append(_rows(held, "reference_present", F.col("got") == 1, F.col("got"), F.lit(1)))
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.when((F.col("check_name") == "flag_matches_ends") & F.col("got").isNull(), "skip").otherwise(F.col("status")))


def verify_ratios(cells: DataFrame, slack: float = 5e-9) -> DataFrame:
    """The ratio identity numerator / denominator = ratio within the rounding slack of its inputs, and rates within [0, 1]."""
    base = cells.withColumn("metric", F.lit("ratio"))
    known = base.where("ratio is not null")
    want = F.col("num_mean") / F.col("den_mean")
    return _rows(known, "ratio_identity", F.abs(F.col("ratio") - want) <= slack / F.col("den_mean") + 1e-9 * F.abs(want), F.round("ratio", 6), F.round(want, 6)).unionByName(
        _rows(base, "rate_within_bounds", (F.col("den_mean") >= 0) & (F.col("den_mean") <= 1), F.round("den_mean", 6), F.lit(1.0))
    )


def verify_pools(pools: DataFrame, k: int) -> DataFrame:
    """Every cell served at least k, has one width and misses none."""
    base = pools.withColumn("metric", F.lit("pool"))
    return reduce(DataFrame.unionByName, [
        _rows(base, "serves_k", F.col("top_n_min") >= k, F.col("top_n_min"), F.lit(k)),
        _rows(base, "one_width", F.col("top_n_min") == F.col("top_n_max"), F.col("top_n_max"), F.col("top_n_min")),
        _rows(base, "none_missing", F.col("n_missing_top_n") == 0, F.col("n_missing_top_n"), F.lit(0)),
    ])


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check_name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"))
