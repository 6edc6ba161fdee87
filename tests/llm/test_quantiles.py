import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import quantiles as Q


def test_rank_error_and_merging(spark):
    df = spark.range(0, 200_000, numPartitions=8).select(F.lit("c").alias("cell"), (F.col("id") % 7).alias("day"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("v"), F.lit(1).alias("value"))
    days = Q.sketch_columns(df, ["cell", "day"], {"v": 0})
    assert days.count() == 7
    got = Q.percentiles(Q.merge_sketches(days, ["cell"]), {"p50": 0.5, "p90": 0.9, "p99": 0.99}).first()
    values = np.sort(df.toPandas()["v"].to_numpy())
    assert got.n == len(values) and got.measure == "v"
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        rank = np.searchsorted(values, got[name], "right") / len(values)
        assert abs(rank - q) <= got.rank_error_bound


def test_the_bound_holds_over_many_draws(spark):
    """Groups far larger than k, each a draw of its own: nearly all answers keep the bound, which holds at 99 %."""
    df = spark.range(0, 20 * 30_000, numPartitions=8).select((F.col("id") % 20).alias("draw"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("v"))
    fractions = {f"p{i}": i / 100 for i in (10, 50, 90, 99)}
    got = {r.draw: r for r in Q.percentiles(Q.sketch_columns(df, ["draw"], {"v": 0}), fractions).collect()}
    kept = []
    for draw, group in df.toPandas().groupby("draw"):
        values = np.sort(group["v"].to_numpy())
        kept += [abs(np.searchsorted(values, got[draw][name], "right") / len(values) - q) <= got[draw].rank_error_bound for name, q in fractions.items()]
    assert len(kept) == 80 and sum(kept) >= 78


def test_small_groups_are_exact_and_bad_values_do_not_count(spark):
    df = spark.createDataFrame([("a", None, v) for v in (5, 1, None, -1, 9, 0)] + [(None, "m", 3)], "cell string, model string, latency bigint")
    got = {(r.cell, r.model): (r.n, r.p50) for r in Q.percentiles(Q.sketch_columns(df, ["cell", "model"], {"latency": 1}), {"p50": 0.5}).collect()}
    assert got == {("a", None): (3, 5), (None, "m"): (1, 3)}
    assert Q.sketch_columns(df.limit(0), ["cell", "model"], {"latency": 1}).count() == 0
