"""Percentiles of large numeric columns from mergeable sketches with a rank-error bound.

A sketch is a hierarchy of compactors: a full level is sorted and a random half of its alternate values moves
up with double weight; two sketches merge level by level. Spark's KLL aggregates do this inside the JVM, with
partial aggregation before the shuffle, so a group of any size arrives as one sketch per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_K = 800


def rank_error_bound(k: int) -> float:
    """Normalised rank error of a single answer that holds with 99 % confidence, from the published KLL fit."""
    return 2.296 / k**0.9723


def sketch_columns(df: DataFrame, by: Sequence[str], measures: dict[str, int], k: int = DEFAULT_K) -> DataFrame:
    """One row per group and measure: by..., measure, n, sketch.

    measures: column and its least possible value; nulls and smaller values are missing or impossible timings
    and don't count. A null in a group column is a group of its own. An empty table gives no rows.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("measure"), F.when(F.col(c) >= least, F.col(c).cast("bigint")).alias("value")) for c, least in measures.items()))
    long = df.select(*by, F.inline(pairs)).where("value is not null")
    return long.groupBy(*by, "measure").agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("value", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of partitions or days combined into one per group and measure."""
    return sketches.groupBy(*by, "measure").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def percentiles(sketches: DataFrame, fractions: dict[str, float], k: int = DEFAULT_K) -> DataFrame:
    """Adds a column per fraction (the least value whose rank reaches it) and the bound; drops the sketch."""
    answers = {name: F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)) for name, q in fractions.items()}
    return sketches.withColumns(answers).withColumn("rank_error_bound", F.lit(rank_error_bound(k))).drop("sketch")
