"""Neighbours in time without gathering a key into one task.

Rows of a key are cut into buckets of time. Neighbours inside a bucket come from a window over (key, bucket); only
the first and last row of each non-empty bucket meet in the window over the key, so its size is bounded by the time
the key spans, whatever its share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def next_rows(df: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str], bucket: float) -> DataFrame:
    """Adds next_<column> for `at` and each payload column: the row after it in (at, payload) order, null at the end.

    `at` is a number; rows with a null `at` are left out.
    """
    cols = [at, *payload]
    placed = df.where(F.col(at).isNotNull()).withColumn("_bucket", F.floor(F.col(at) / bucket))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*cols)
    me = F.struct(*cols)
    led = placed.withColumn("_next", F.lead(me).over(inside))
    heads = placed.groupBy(*keys, "_bucket").agg(F.min(me).alias("_head"))
    over = Window.partitionBy(*keys).orderBy("_bucket")
    bridge = heads.select(*keys, "_bucket", F.lead("_head").over(over).alias("_bridge"))
    left, right = led.alias("l"), bridge.alias("r")
    same = F.col("l._bucket") == F.col("r._bucket")
    for k in keys:
        same &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.join(right, same).select("l.*", "r._bridge").withColumn("_next", F.coalesce("_next", "_bridge"))
    return joined.select(*df.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in cols))


def nearest_with_key(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, tolerance: float, right_order: Sequence[Column] = ()) -> DataFrame:
    """For each left row, the right row of the same keys nearest in time within the tolerance; rows without one are left out.

    Needs left columns `left_id` and right columns `right_id`. Right rows sit in buckets as long as the tolerance and
    each left row looks into three, so the join is an equi-join that never meets more than the rows near it.
    """
    l3 = left.where(F.col(left_at).isNotNull()).withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col(left_at) / tolerance) + i)))
    r1 = right.where(F.col(right_at).isNotNull()).withColumn("_b", F.floor(F.col(right_at) / tolerance))
    met = l3.join(r1, [*keys, "_b"]).withColumn("skew", F.abs(F.col(left_at) - F.col(right_at))).where(F.col("skew") <= tolerance)
    best = met.groupBy("left_id").agg(F.min_by(F.struct("right_id", F.col(right_at).alias("right_at"), "skew"), F.struct("skew", -F.col(right_at), "right_id")).alias("best"))
    return best.select("left_id", "best.*")


def nearest_in_time(left: DataFrame, right: DataFrame, left_at: str, right_at: str, tolerance: float) -> DataFrame:
    """As nearest_with_key, for tables that share no key: left_id, right_id, right_at, skew.

    Without a key a join would pair all rows of a stretch of time. Both sides are laid in one line instead: inside a bucket
    as long as the tolerance each left row sees the right row before and after it, and where it has none there, the last
    one of the bucket before or the first one of the bucket after. Of right rows at one moment the least id counts.
    """
    rights = right.where(F.col(right_at).isNotNull()).groupBy(F.col(right_at).alias("_at")).agg(F.min("right_id").alias("right_id"))
    mark = F.struct(F.col("_at").alias("right_at"), "right_id")
    lefts = left.where(F.col(left_at).isNotNull()).select(F.col("left_id"), F.col(left_at).alias("_at"), F.lit(True).alias("_left"))
    line = lefts.unionByName(rights.select("_at", mark.alias("_mark"), F.lit(False).alias("_left")), allowMissingColumns=True).withColumn("_b", F.floor(F.col("_at") / tolerance))
    order = Window.partitionBy("_b").orderBy("_at", "_left")
    seen = line.withColumns({
        "_before": F.last("_mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.first("_mark", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
    }).where("_left")
    ends = rights.select(F.floor(F.col("_at") / tolerance).alias("_b"), mark.alias("m")).groupBy("_b").agg(F.max("m").alias("_last"), F.min("m").alias("_first"))
    seen = seen.join(ends.select((F.col("_b") + 1).alias("_b"), "_last"), "_b", "left").join(ends.select((F.col("_b") - 1).alias("_b"), "_first"), "_b", "left")
    near = seen.select("left_id", "_at", F.explode(F.array(F.coalesce("_before", "_last"), F.coalesce("_after", "_first"))).alias("m")).where("m is not null")
    near = near.select("left_id", "m.right_id", "m.right_at", F.abs(F.col("_at") - F.col("m.right_at")).alias("skew")).where(F.col("skew") <= tolerance)
    best = near.groupBy("left_id").agg(F.min_by(F.struct("right_id", "right_at", "skew"), F.struct("skew", -F.col("right_at"), "right_id")).alias("best"))
    return best.select("left_id", "best.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """The first row of each key in the given ascending order, by partial aggregation."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))).alias("_row")).select(*keys, "_row.*")
