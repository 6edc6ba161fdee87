"""Small look-ups and gates around logs and reports: windows, blocks, columns, evidence, units, verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def outermost(spans: DataFrame, key: str, bucket: int = 1 << 31) -> DataFrame:
    """spans(key, lo, hi) without those that lie inside another one of the key; of equal spans one stays.

    In order of start (longer first), a span is inside where an earlier one reaches as far. Earlier ones of the same
    bucket of starts are seen in a window, those of earlier buckets by the farthest end of each bucket. Nulls are left out.
    """
    rows = spans.select(key, "lo", "hi").where(F.col(key).isNotNull() & (F.col("lo") <= F.col("hi"))).distinct().withColumn("_b", F.floor(F.col("lo") / bucket))
    earlier = Window.partitionBy(key, "_b").orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(key, "_b").agg(F.max("hi").alias("far")).withColumn("_far", F.max("far").over(before)).drop("far")
    seen = rows.withColumn("_near", F.max("hi").over(earlier)).join(reach, [key, "_b"])
    return seen.where("coalesce(greatest(_near, _far) < hi, true)").select(key, "lo", "hi")


def between(turns: DataFrame, at: str, since: int | None = None, until: int | None = None, both: bool = False) -> DataFrame:
    """Rows from `since` to `until`, ends included. With `both`, the window applies only where both bounds are given."""
    if both and (since is None or until is None):
        return turns
    out = turns if since is None else turns.where(F.col(at) >= since)
    return out if until is None else out.where(F.col(at) <= until)


def among(rows: DataFrame, key: str, only: DataFrame | None = None, skip: DataFrame | None = None, deleted: str | None = None) -> DataFrame:
    """Rows whose key is in `only` and not in `skip` (tables with that key), and that are not marked as deleted."""
    out = rows if deleted is None else rows.where(F.col(deleted).isNull())
    out = out if only is None else out.join(only.select(key).distinct(), key, "left_semi")
    return out if skip is None else out.join(skip.select(key).distinct(), key, "left_anti")


def listed(rows: DataFrame, order: Sequence[str | Column], most: int) -> DataFrame:
    """The first `most` rows in order: a bounded listing for the eye."""
    return rows.orderBy(*order).limit(most)


def cited(answers: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Adds cited: 1 where an answer has at least one row of evidence, else 0."""
    held = evidence.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_held", F.lit(1))
    return answers.join(held, key, "left").withColumn("cited", F.coalesce("_held", F.lit(0))).drop("_held")


def path_values(blocks: DataFrame, cell: str, payload: str, path: str) -> DataFrame:
    """(cell, value) at a dotted path of each cell's JSON; null where the path leads nowhere."""
    steps = "".join(f"['{step}']" for step in path.split("."))
    return blocks.select(F.col(cell).alias("cell"), F.get_json_object(payload, f"${steps}").alias("value"))


def first_block(blocks: DataFrame, report: str, name: str, payload: str, names: Sequence[str], prefix: str | None = None) -> DataFrame:
    """(report, name, payload) of the first named block a report has, in the order of `names`, else of the least name that
    begins with the prefix. Reports without any have no row."""
    place = F.coalesce(*(F.when(F.col(name) == n, F.lit(i)) for i, n in enumerate(names)), *([F.when(F.col(name).startswith(prefix), F.lit(len(names)))] if prefix else []))
    ranked = blocks.select(F.col(report).alias("report"), F.col(name).alias("name"), F.col(payload).alias("payload"), place.alias("_place")).where("_place is not null")
    return ranked.groupBy("report").agg(F.min_by(F.struct("name", "payload"), F.struct("_place", "name")).alias("b")).select("report", "b.*")


def numeric_columns(df: DataFrame, only: Sequence[str] | None = None, skip: Sequence[str] = ()) -> list[str]:
    """Names of the columns that hold numbers, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip and (only is None or f.name in only)]


def filled_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, n) of the columns with a value in at least one row, in one pass."""
    counts = df.agg(*(F.count(c).alias(c) for c in names))
    return counts.unpivot([], list(names), "column", "n").where("n > 0")


def warm_audit(spans: DataFrame, reported: DataFrame, by: Sequence[str], drop: int = 1, tolerance_s: float = 0.05) -> DataFrame:
    """Per group: seconds of all spans and of the warm ones (without the first `drop`), the cold share, the longest warm
    span, and whether the reported total is the sum of the spans within the tolerance; where it isn't, warm_s is null.

    spans(by..., span_id, start_us, end_us), reported(by..., reported_s).
    """
    order = Window.partitionBy(*by).orderBy("start_us", "end_us", "span_id")
    sized = spans.withColumns({"_n": F.row_number().over(order), "_s": (F.col("end_us") - F.col("start_us")) / 1e6})
    cold = F.col("_n") <= drop
    sums = sized.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_s").alias("all_s"), F.sum(F.when(cold, F.col("_s")).otherwise(0.0)).alias("cold_s"), F.max(F.when(~cold, F.col("_s"))).alias("longest_s"))
    fits = F.coalesce(F.abs(F.col("reported_s") - F.col("all_s")) <= tolerance_s, F.lit(False))
    out = sums.join(reported, list(by), "left").withColumn("agrees", fits)
    return out.select(*by, "n", "agrees", F.when(F.col("agrees"), F.round(F.col("reported_s") - F.col("cold_s"), 3)).alias("warm_s"), F.round(F.try_divide("cold_s", "all_s"), 4).alias("cold_share"), F.round("longest_s", 3).alias("longest_s"))


def power_verdict(cells: DataFrame, metered: Column, device: Column, power: Column, required: Column) -> DataFrame:
    """Adds verdict: ok where power is metered, not required or the device has a power block; no_device; no_power_block."""
    return cells.withColumn("verdict", F.when(metered | ~required, "ok").when(device.isNull(), "no_device").when(power.isNull(), "no_power_block").otherwise("ok"))


def record_gates(records: DataFrame, key: str, gates: dict[str, tuple[Column, Sequence[str]]], shown: Callable[[Column], Column] = lambda c: c.cast("string")) -> DataFrame:
    """(key, gate, passed, inputs): every decision on each record with what it read; an undecided gate did not pass."""
    rows = [F.struct(F.lit(name).alias("gate"), F.coalesce(rule, F.lit(False)).alias("passed"), F.concat_ws("; ", *(F.concat(F.lit(f"{c}="), F.coalesce(shown(F.col(c)), F.lit("null"))) for c in read)).alias("inputs")) for name, (rule, read) in gates.items()]
    return records.select(key, F.inline(F.array(*rows)))


def pooled_units(tokens: DataFrame, units: DataFrame, key: str, width: int = 64) -> DataFrame:
    """(key, unit, n, sum, mean, max) of the weights of the tokens that overlap each unit; units without a token have none.

    tokens(key, lo, hi, weight), units(key, unit, lo, hi), half-open. Both list the blocks of `width` they touch and meet by
    equality; a pair counts in the block where the later of the two begins.
    """
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    t = spread(tokens.where("lo < hi")).select(key, "_b", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "weight")
    met = spread(units.where("lo < hi")).join(t, [key, "_b"]).where((F.col("_lo") < F.col("hi")) & (F.col("lo") < F.col("_hi")) & (F.floor(F.greatest("lo", "_lo") / width) == F.col("_b")))
    return met.groupBy(key, "unit").agg(F.count("*").alias("n"), F.sum("weight").alias("sum"), F.avg("weight").alias("mean"), F.max("weight").alias("max"))
