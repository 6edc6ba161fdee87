"""Power samples integrated over spans of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.arrays import settled
from tallyloom.operators.sequences import next_rows


def series_energy(samples: DataFrame, keys: list[str], max_gap_s: float = 15.0, idle_w: float = 0.0) -> DataFrame:
    """Trapezoids between consecutive samples of each series: energy_wh, covered_s, mean_w, peak_w, gaps, gap_s, samples.

    samples(keys..., at, watts), at in microseconds. Two samples further apart than max_gap_s are a hole: its seconds
    count neither as energy nor as covered. Watts under idle_w count as none. A single sample covers nothing.
    """
    over = lambda w: F.greatest(w - F.lit(idle_w), F.lit(0.0))
    pairs = next_rows(samples, keys, "at", ["watts"], bucket=3_600_000_000)
    dt = (F.col("next_at") - F.col("at")) / 1e6
    near, hole = (dt > 0) & (dt <= max_gap_s), dt > max_gap_s
    sums = pairs.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.sum(F.when(near, 0.5 * (over(F.col("watts")) + over(F.col("next_watts"))) * dt)).alias("joules"),
        F.coalesce(F.sum(F.when(near, dt)), F.lit(0.0)).alias("covered_s"),
        F.max(over(F.col("watts"))).alias("peak_w"),
        F.count_if(hole).alias("gaps"),
        F.coalesce(F.sum(F.when(hole, dt)), F.lit(0.0)).alias("gap_s"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )
    span = (F.col("last_at") - F.col("first_at")) / 1e6
    return sums.select(
        *keys, "samples", settled(F.col("joules") / 3600, 6).alias("energy_wh"), settled(F.col("covered_s"), 3).alias("covered_s"), settled(F.col("joules") / F.col("covered_s"), 3).alias("mean_w"),
        settled(F.col("peak_w"), 3).alias("peak_w"), "gaps", settled(F.col("gap_s"), 3).alias("gap_s"), settled(F.try_divide("covered_s", span), 4).alias("coverage"),
    )


def window_energy(spans: DataFrame, samples: DataFrame, max_gap_s: float = 15.0, idle_w: float = 0.0) -> DataFrame:
    """Energy of each span from the samples of its meter, its edges held from neighbours no staler than max_gap_s.

    spans(span_id, meter, start_us, end_us), samples(meter, at, watts). A span shorter than the cadence is measured by
    its two held edges; with nothing inside, both are needed. Unmeasured spans keep their row with null energy.
    Spans list the buckets of time they touch (padded by the gap) and meet the samples by equality on (meter, bucket);
    each sample already knows the one after it, so a span is a sum over its samples and no list of them is ever built.
    """
    bucket = 60_000_000
    pad = int(max_gap_s * 1_000_000)
    lifted = lambda w: F.greatest(w - F.lit(idle_w), F.lit(0.0))
    clean = samples.where("at is not null and watts is not null and not isnan(watts)").select("meter", "at", lifted(F.col("watts")).alias("watts"))
    linked = next_rows(clean, ["meter"], "at", ["watts"], bucket=3_600_000_000).withColumn("_b", F.floor(F.col("at") / bucket))
    reach = spans.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start_us") - pad) / bucket), F.floor((F.col("end_us") + pad) / bucket))))
    met = reach.join(linked, ["meter", "_b"]).where((F.col("at") >= F.col("start_us") - pad) & (F.col("at") <= F.col("end_us") + pad))
    inside = (F.col("at") >= F.col("start_us")) & (F.col("at") <= F.col("end_us"))
    step = (F.col("next_at") - F.col("at")) / 1e6
    pair = inside & (F.col("next_at") <= F.col("end_us"))
    point = F.struct("at", "watts")
    per = met.groupBy("span_id").agg(
        F.count_if(inside).alias("n_inside"),
        F.sum(F.when(pair & (step > 0) & (step <= max_gap_s), 0.5 * (F.col("watts") + F.col("next_watts")) * step)).alias("j"),
        F.sum(F.when(pair & (step > 0) & (step <= max_gap_s), step)).alias("c"),
        F.count_if(pair & (step > max_gap_s)).alias("g"),
        F.max(F.when(inside, F.col("watts"))).alias("top"),
        F.min(F.when(inside, point)).alias("first"), F.max(F.when(inside, point)).alias("last"),
        F.max(F.when(F.col("at") < F.col("start_us"), point)).alias("before"), F.min(F.when(F.col("at") > F.col("end_us"), point)).alias("after"),
    )
    joined = spans.join(per, "span_id", "left").withColumns({"n_inside": F.coalesce("n_inside", F.lit(0)), "edges": F.col("before").isNotNull().cast("int") + F.col("after").isNotNull().cast("int")})
    # Up to two more trapezoids: from the held start to the first sample, and from the last one to the held end.
    alone = F.col("n_inside") == 0
    lead_t = F.when(alone & (F.col("edges") == 2), (F.col("end_us") - F.col("start_us")) / 1e6).when(~alone & F.col("before").isNotNull(), (F.col("first.at") - F.col("start_us")) / 1e6)
    lead_w = F.when(alone, F.col("before.watts") + F.col("after.watts")).otherwise(F.col("before.watts") + F.col("first.watts"))
    tail_t = F.when(~alone & F.col("after").isNotNull(), (F.col("end_us") - F.col("last.at")) / 1e6)
    ok = lambda t: (t > 0) & (t <= max_gap_s)
    zero = F.lit(0.0)
    joules = F.coalesce("j", zero) + F.when(ok(lead_t), 0.5 * lead_w * lead_t).otherwise(zero) + F.when(ok(tail_t), 0.5 * (F.col("last.watts") + F.col("after.watts")) * tail_t).otherwise(zero)
    covered = F.coalesce("c", zero) + F.when(ok(lead_t), lead_t).otherwise(zero) + F.when(ok(tail_t), tail_t).otherwise(zero)
    gaps = F.coalesce("g", F.lit(0)) + F.coalesce((lead_t > max_gap_s).cast("int"), F.lit(0)) + F.coalesce((tail_t > max_gap_s).cast("int"), F.lit(0))
    summed = joined.select(*spans.columns, F.col("n_inside").alias("samples"), "edges", joules.alias("_j"), covered.alias("_c"), gaps.alias("_g"), F.coalesce("top", F.greatest("before.watts", "after.watts")).alias("_top"))
    enough = (F.col("_c") > 0) & ((F.col("samples") > 0) | (F.col("edges") == 2))
    return summed.select(
        *spans.columns, "samples", "edges",
        F.when(enough, settled(F.col("_j") / 3600, 6)).alias("energy_wh"), F.when(enough, settled(F.col("_c"), 3)).otherwise(zero).alias("covered_s"),
        F.when(enough, F.round(F.col("_j") / F.col("_c"), 3)).alias("mean_w"), F.when(enough, F.round("_top", 3)).alias("peak_w"), F.when(enough, F.col("_g")).otherwise(F.lit(0)).alias("gaps"),
    )


def constant_series(spans: DataFrame, watts: float, step_s: int, pad_s: int = 0, least_rows: int = 2) -> DataFrame:
    """Evenly spaced samples of constant watts over each span: span_id, at, watts; at least two rows a span."""
    us = 1_000_000
    a, b = F.col("start_us") - pad_s * us, F.col("end_us") + pad_s * us
    step = F.least(F.lit(step_s * us), F.greatest(F.lit(1), F.floor((b - a) / (least_rows - 1)))).cast("bigint")
    return spans.where("end_us > start_us").select("span_id", F.explode(F.sequence(a, b, step)).alias("at"), F.lit(float(watts)).alias("watts"))


def answer_spans(records: DataFrame, latency_columns: list[str], floor_ms: int = 1, ceiling_ms: int | None = None) -> DataFrame:
    """Adds start_us and end_us of serving: the answer's stamp minus the summed latencies, missing ones as 0, within bounds."""
    total = sum((F.coalesce(F.when(F.col(c) >= 0, F.col(c)), F.lit(0)) for c in latency_columns[1:]), F.coalesce(F.when(F.col(latency_columns[0]) >= 0, F.col(latency_columns[0])), F.lit(0)))
    total = F.greatest(total, F.lit(floor_ms))
    total = F.least(total, F.lit(ceiling_ms)) if ceiling_ms else total
    end = F.unix_micros("answered_at")
    return records.where("answered_at is not null").withColumns({"start_us": end - total * 1000, "end_us": end})


def without_first(spans: DataFrame, by: list[str], drop: int = 1) -> DataFrame:
    """Per group: seconds of all spans, of the first `drop` by start, and of the rest. Top-n per group is limited before the shuffle."""
    order = Window.partitionBy(*by).orderBy("start_us", "end_us", "span_id")
    first = spans.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= drop)
    seconds = lambda name: F.coalesce(F.sum((F.col("end_us") - F.col("start_us")) / 1e6), F.lit(0.0)).alias(name)
    total = spans.groupBy(*by).agg(F.count("*").alias("n"), seconds("all_s"))
    cold = first.groupBy(*by).agg(seconds("cold_s"), F.count("*").alias("dropped"))
    return total.join(cold, by).select(*by, "n", "dropped", F.round("all_s", 6).alias("all_s"), F.round("cold_s", 6).alias("cold_s"), F.round(F.col("all_s") - F.col("cold_s"), 6).alias("warm_s"), F.round(F.try_divide("cold_s", "all_s"), 6).alias("cold_share"))
