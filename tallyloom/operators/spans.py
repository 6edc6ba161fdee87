"""Continuous periods and gaps of time intervals, by union of run-length bitmaps.

Time is cut into shards of 2**31 microseconds. The exact microseconds a label covers are a bitmap of runs per
(label, shard): an interval sets a run in the shard where it begins and in the one where it ends, and the whole
shards between are one run of the coarser bitmap whose bits are shards. Union keeps, per start, the farthest end
(so partial aggregation shrinks hot labels before the shuffle) and then merges runs that touch. The merged runs are
written once; everything after reads them. Only one summary per non-empty shard of a label meets in the last step: its
size is bounded by the time covered, not by the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.sequences import next_rows
from tallyloom.session import materialise

#: A shard is 2**31 microseconds, about 36 minutes.
SHARD_BITS = 31
SHARD = 1 << SHARD_BITS


#: The shard that stands for the coarser bitmap of a label.
COARSE = -(1 << 62)


def interval_runs(intervals: DataFrame) -> DataFrame:
    """(label, shard, lo, hi) in microseconds, half-open, the farthest end per start: runs inside one shard each, and under
    the shard COARSE the runs of whole shards. Intervals with a null or without positive length set nothing."""
    rows = intervals.select("label", F.unix_micros("start_at").alias("a"), F.unix_micros("end_at").alias("b")).where("label is not null and a < b")
    cut = rows.withColumns({"sa": F.shiftright("a", SHARD_BITS), "sb": F.shiftright(F.col("b") - 1, SHARD_BITS)})
    run = lambda shard, lo, hi: F.struct(shard.cast("bigint").alias("shard"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    a, b, sa, sb = (F.col(c) for c in ("a", "b", "sa", "sb"))
    ends = F.array(run(sa, a, (sa + 1) * SHARD), run(sb, sb * SHARD, b))
    pieces = F.when(sa == sb, F.array(run(sa, a, b))).when(sb - sa == 1, ends).otherwise(F.concat(ends, F.array(run(F.lit(COARSE), (sa + 1) * SHARD, sb * SHARD))))
    return cut.select("label", F.inline(pieces)).groupBy("label", "shard", "lo").agg(F.max("hi").alias("hi"))


def union_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs of each key merged where they overlap or touch: keys..., lo, hi."""
    order = Window.partitionBy(*keys).orderBy("lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = runs.select(*keys, "lo", "hi", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0).alias("_new"))
    numbered = numbered.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def _merged(intervals: DataFrame) -> DataFrame:
    """The merged runs, each with the start of the next one of its shard; a shard's first run holds the shard's last end."""
    shard = Window.partitionBy("label", "shard")
    runs = union_runs(interval_runs(intervals), "label", "shard")
    next_lo, first = F.lead("lo").over(shard.orderBy("lo")), F.row_number().over(shard.orderBy("lo")) == 1
    return materialise(runs.select("label", "shard", "lo", "hi", next_lo.alias("next_lo"), F.when(first, F.max("hi").over(shard)).alias("shard_hi")))


def _gaps(merged: DataFrame) -> DataFrame:
    """(label, lo, hi) of every stretch between a label's first start and last end that no run covers."""
    # Per label, in time order: one summary per non-empty shard, and the whole stretches of shards.
    coarse = F.col("shard") == COARSE
    units = merged.where(coarse | F.col("shard_hi").isNotNull()).select("label", F.when(~coarse, F.col("shard")).alias("shard"), "lo", F.when(coarse, F.col("hi")).otherwise(F.col("shard_hi")).alias("hi"))
    # A stretch of just one shard ties with that shard's summary and must be seen before it.
    by_time = Window.partitionBy("label").orderBy("lo", F.col("hi").desc(), F.col("shard").asc_nulls_first())
    so_far = by_time.rowsBetween(Window.unboundedPreceding, -1)
    ordered = units.select(
        "label", "shard", "lo", "hi", F.max("hi").over(so_far).alias("reach"),
        F.max(F.when(F.col("shard").isNull(), F.col("hi"))).over(so_far).alias("whole_reach"),
    )
    between = ordered.where("lo > reach").select("label", F.col("reach").alias("lo"), F.col("lo").alias("hi"))
    # A shard inside a whole stretch has no gaps of its own.
    bare = ordered.where("shard is not null and (whole_reach is null or hi > whole_reach)").select("label", "shard")
    inner = merged.where(~coarse & F.col("next_lo").isNotNull()).join(bare, ["label", "shard"], "left_semi")
    return between.unionByName(inner.select("label", F.col("hi").alias("lo"), F.col("next_lo").alias("hi")))


def clear_runs(intervals: DataFrame) -> DataFrame:
    """(label, start_us, end_us): each stretch longer than zero between a label's earliest start and latest end that no
    interval covers. Repeated rows change nothing; an empty table gives no rows."""
    return _gaps(_merged(intervals)).selectExpr("label", "lo AS start_us", "hi AS end_us")


def set_runs(intervals: DataFrame) -> DataFrame:
    """(label, start_us, end_us): each maximal covered stretch. Periods lie between gaps, so each begins where a gap ends and
    ends where the next one begins; a label's first start and last end stand as gaps without length."""
    merged = _merged(intervals)
    outer = merged.groupBy("label").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    bounds = outer.select("label", F.explode(F.array("first", "last")).alias("lo")).withColumn("hi", F.col("lo"))
    gaps = materialise(_gaps(merged).unionByName(bounds))
    return next_rows(gaps, ["label"], "lo", ["hi"], SHARD).where("next_lo is not null").selectExpr("label", "hi AS start_us", "next_lo AS end_us")


def set_and_clear_runs(intervals: DataFrame) -> DataFrame:
    """(label, kind, start_us, end_us): kind period for each maximal covered stretch, gap for each uncovered one."""
    kinds = [runs(intervals).select("label", F.lit(kind).alias("kind"), "start_us", "end_us") for kind, runs in (("period", set_runs), ("gap", clear_runs))]
    return kinds[0].unionByName(kinds[1])
