from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import spans

SCHEMA = "interval_id bigint, label string, start_at timestamp, end_at timestamp, logged_at timestamp, shard string, lo int, kind string"
ZERO = datetime(2026, 1, 1)


def brute(rows):
    by = {}
    for label, a, b in rows:
        if label is not None and a is not None and b is not None and a < b:
            by.setdefault(label, []).append((a, b))
    out = set()
    for label, xs in by.items():
        xs.sort()
        a, b = xs[0]
        for s, e in xs[1:]:
            if s <= b:
                b = max(b, e)
            else:
                out |= {(label, "period", a, b), (label, "gap", b, s)}
                a, b = s, e
        out.add((label, "period", a, b))
    return out


def run(spark, rows):
    at = lambda us: None if us is None else ZERO + timedelta(microseconds=us)
    df = spark.createDataFrame([(i, label, at(a), at(b), None, "x", 1, "y") for i, (label, a, b) in enumerate(rows)], SCHEMA)
    zero = int((ZERO - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    return {(r.label, r.kind, r.start_us - zero, r.end_us - zero) for r in spans.set_and_clear_runs(df).collect()}


def test_merges_touching_nested_and_repeated(spark):
    rows = [("a", 0, 5), ("a", 3, 8), ("a", 8, 9), ("a", 8, 9), ("a", 20, 30), ("a", 22, 25), ("b", 1, 2)]
    assert run(spark, rows) == {("a", "period", 0, 9), ("a", "gap", 9, 20), ("a", "period", 20, 30), ("b", "period", 1, 2)}


def test_nulls_empty_and_negative_cover_nothing(spark):
    assert run(spark, [(None, 0, 5), ("a", None, 5), ("a", 1, None), ("a", 5, 5), ("a", 7, 3)]) == set()
    assert run(spark, []) == set()


def test_long_intervals_cross_shards(spark):
    w = spans.SHARD
    rows = [("a", 10, 5 * w + 7), ("a", 5 * w + 9, 5 * w + 12), ("a", 2 * w + 3, 2 * w + 4), ("a", 9 * w, 10 * w), ("a", 10 * w, 14 * w), ("a", 14 * w, 14 * w + 1), ("a", 40 * w + 1, 40 * w + 2)]
    assert run(spark, rows) == brute(rows)


def test_one_whole_shard_under_two_inner_runs(spark):
    w = spans.SHARD
    rows = [(f"l{i}", *x) for i in range(40) for x in ((10 + i, w + 5), (w + 9, 2 * w + 5), (3, 2 * w + 7 + i))]
    for turned in (rows, rows[::-1]):
        assert run(spark, turned) == brute(rows) == {(f"l{i}", "period", 3, 2 * w + 7 + i) for i in range(40)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40), st.integers(-1, 9), st.integers(0, 3)), max_size=30))
def test_equals_brute_force(spark, drawn):
    unit = spans.SHARD // 2 + 1
    rows = [(label, a * unit + j, (a + n) * unit + j) for label, a, n, j in drawn]
    assert run(spark, rows) == brute(rows)


def test_a_hot_label_is_spread(spark):
    rows = spark.range(20000).select(F.col("id").alias("interval_id"), F.lit("hot").alias("label"), F.timestamp_micros(F.col("id") * 7_000_000).alias("start_at"), F.timestamp_micros(F.col("id") * 7_000_000 + 5_000_000).alias("end_at"), F.lit(None).cast("timestamp").alias("logged_at"))
    got = {r.kind: r.n for r in spans.set_and_clear_runs(rows).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert got == {"period": 20000, "gap": 19999}
