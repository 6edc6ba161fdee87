"""A whole experiment from scores to checked blocks, and the small tables around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import checks, inference
from tallyloom.session import materialise


def experiment(scores: DataFrame, *, reference: str, grid: list[str], offgrid: list[str] = (), stat: str = "mean", least_runs: int = 1) -> dict[str, DataFrame]:
    """cells, deltas and checks of scores(cell, run_id, query_id, metric, value).

    Grid cells form one family of contrasts with the reference, corrected for len(grid) - 1 of them; off-grid cells are
    compared uncorrected. A reference without scores leaves the deltas empty. Cells outside both lists only get levels.
    """
    if reference in offgrid:
        raise ValueError(f"the reference {reference} is off the grid")
    pooled = materialise(inference.pool_runs(scores, stat, least_runs))
    cells = inference.bca_means(pooled, ["cell", "metric"])
    m = max(1, len(grid) - 1)
    blocks = []
    for name, members, contrasts in (("grid", grid, m), ("offgrid", list(offgrid), 1)):
        pairs = inference.paired(pooled.where(F.col("cell").isin(reference, *members)), reference)
        blocks.append(inference.deltas(pairs, contrasts).withColumn("block", F.lit(name)))
    deltas = materialise(reduce(DataFrame.unionByName, blocks))
    found = [checks.verify_deltas(deltas.where(F.col("block") == name), c).withColumn("block", F.lit(name)) for name, c in (("grid", m), ("offgrid", 1))]
    return {"cells": cells, "deltas": deltas, "checks": reduce(DataFrame.unionByName, found)}


def level_differences(levels: DataFrame, reference: str) -> DataFrame:
    """levels(cell, metric, value) against the reference's, without intervals; missing values stay missing."""
    ref = levels.where(F.col("cell") == reference).select("metric", F.col("value").alias("ref"))
    return levels.where(F.col("cell") != reference).join(ref, "metric", "left").select("cell", "metric", F.round(F.col("value") - F.col("ref"), 8).alias("delta"))


def pool_blocks(leaves: DataFrame, by: list[str], summed: list[str] = ()) -> DataFrame:
    """Numbers of nested blocks, one row per (run, path): the mean over runs, the sum of named paths, any() of flags.

    leaves(by..., path, number, flag): either number or flag is set.
    """
    number = F.when(F.col("path").isin(*summed), F.sum("number")).otherwise(F.avg("number")) if summed else F.avg("number")
    return leaves.groupBy(*by, "path").agg(number.alias("number"), F.max("flag").alias("flag"))


def gold_gate(summary: DataFrame, most_unmatched: int = 0) -> DataFrame:
    """The one-row match summary with a verdict."""
    verdict = F.when(F.col("quotes") == 0, "no gold").when(F.col("unmatched") > most_unmatched, "unmatched gold").otherwise("ok")
    return summary.withColumn("verdict", verdict)


def resolve_devices(asked: DataFrame, registry: DataFrame, overridable: list[str]) -> DataFrame:
    """asked(cell, device, overrides...) joined to its profile; an override wins over the profile, an unknown device has known = false."""
    profile = registry.select("device", *(F.col(c).alias(f"_{c}") for c in overridable), F.lit(True).alias("known"))
    joined = asked.join(profile, "device", "left")
    return joined.select("cell", "device", *(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in overridable), F.coalesce("known", F.lit(False)).alias("known"))


def format_bound(us: Column) -> Column:
    """A moment in microseconds as ISO 8601 in UTC, whole seconds."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")
