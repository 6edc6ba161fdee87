"""Small look-ups: nulls, ties, repeated rows, empty tables, clashing names."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import checks, lookups


def test_outermost_equals_brute_force(spark):
    draw = random.Random(2)
    rows = [(draw.choice("ab"), lo, lo + draw.randrange(0, 40)) for lo in (draw.randrange(0, 120) for _ in range(120))] + [(None, 1, 2), ("a", None, 3), ("a", 9, 3)]
    valid = {r for r in rows if None not in r and r[1] <= r[2]}
    want = {r for r in valid if not any(o != r and o[0] == r[0] and o[1] <= r[1] and r[2] <= o[2] for o in valid)}
    df = spark.createDataFrame(rows + rows, "label string, lo bigint, hi bigint")
    for bucket in (7, 1 << 31):
        got = lookups.outermost(df, "label", bucket).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert lookups.outermost(df.limit(0), "label").count() == 0


def test_windows_and_lists(spark):
    t = spark.createDataFrame([(1, "a", None), (5, "b", None), (9, "a", 1), (None, "c", None)], "at bigint, chat string, gone int")
    assert [r.at for r in lookups.between(t, "at", 1, 5).orderBy("at").collect()] == [1, 5]
    assert lookups.between(t, "at", 1, None, both=True).count() == 4 and lookups.between(t, "at", 2).count() == 2
    only, skip = spark.createDataFrame([("a",), ("a",), (None,)], "chat string"), spark.createDataFrame([("b",)], "chat string")
    assert sorted(r.at for r in lookups.among(t, "chat", only=only).collect()) == [1, 9]
    assert [r.at for r in lookups.among(t, "chat", only=only, deleted="gone").collect()] == [1]
    assert sorted(r.chat for r in lookups.among(t, "chat", skip=skip).collect()) == ["a", "a", "c"]
    assert [r.at for r in lookups.listed(t, [F.desc_nulls_last("at")], 2).collect()] == [9, 5]


def test_cited_paths_and_blocks(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "key int")
    e = spark.createDataFrame([(1,), (1,), (None,)], "key int")
    assert {(r.key, r.cited) for r in lookups.cited(a, e, "key").collect()} == {(1, 1), (2, 0), (None, 0)}
    b = spark.createDataFrame([("x", '{"a": {"b c": 3}}'), ("y", "{}"), ("z", None), ("w", "no json")], "cell string, block string")
    assert {(r.cell, r.value) for r in lookups.path_values(b, "cell", "block", "a.b c").collect()} == {("x", "3"), ("y", None), ("z", None), ("w", None)}
    r = spark.createDataFrame([("r1", "old", 1), ("r1", "new", 2), ("r2", "off_b", 3), ("r2", "off_a", 4), ("r3", "else", 5), ("r4", None, 6)], "report string, name string, payload int")
    assert {tuple(x) for x in lookups.first_block(r, "report", "name", "payload", ["new", "old"], prefix="off_").collect()} == {("r1", "new", 2), ("r2", "off_a", 4)}
    assert lookups.numeric_columns(r) == ["payload"] and lookups.numeric_columns(r, skip=["payload"]) == []
    assert [tuple(x) for x in lookups.filled_columns(spark.createDataFrame([(1, None)], "a int, b int"), ["a", "b"]).collect()] == [("a", 1)]


def test_units_pool_what_overlaps(spark):
    draw = random.Random(4)
    tokens = [(draw.choice("kl"), lo, lo + draw.randrange(0, 9), float(draw.randrange(5))) for lo in (draw.randrange(0, 300) for _ in range(150))]
    units = [(k, i, i * 30, i * 30 + 45) for k in "kl" for i in range(9)]
    got = {(r.key, r.unit): (r.n, r.sum, r.max) for r in lookups.pooled_units(spark.createDataFrame(tokens, "key string, lo bigint, hi bigint, weight double"), spark.createDataFrame(units, "key string, unit int, lo bigint, hi bigint"), "key", width=16).collect()}
    want = {}
    for k, u, lo, hi in units:
        w = [t[3] for t in tokens if t[0] == k and t[1] < t[2] and t[1] < hi and lo < t[2]]
        if w:
            want[k, u] = (len(w), sum(w), max(w))
    assert got == want


def test_audit_and_verdicts(spark):
    s = spark.createDataFrame([("a", 1, 0, 2_000_000), ("a", 2, 5_000_000, 6_000_000), ("b", 3, 0, 1_000_000), ("c", 4, 0, 1_000_000)], "cell string, span_id int, start_us bigint, end_us bigint")
    told = spark.createDataFrame([("a", 3.0), ("b", 9.0)], "cell string, reported_s double")
    got = {r.cell: (r.agrees, r.warm_s, r.cold_share) for r in lookups.warm_audit(s, told, ["cell"]).collect()}
    assert got == {"a": (True, 1.0, 0.6667), "b": (False, None, 1.0), "c": (False, None, 1.0)}
    c = spark.createDataFrame([("m", True, None, None), ("n", False, None, "p"), ("d", False, "x", None), ("o", False, "x", "p")], "cell string, metered boolean, device string, power string")
    v = lookups.power_verdict(c, F.col("metered"), F.col("device"), F.col("power"), F.lit(True))
    assert {r.cell: r.verdict for r in v.collect()} == {"m": "ok", "n": "no_device", "d": "no_power_block", "o": "ok"}
    g = lookups.record_gates(c, "cell", {"has": (F.col("device").isNotNull(), ["device"]), "odd": (F.col("power") == "q", ["power", "metered"])})
    assert {(r.gate, r.passed, r.inputs) for r in g.where("cell = 'd'").collect()} == {("has", True, "device=x"), ("odd", False, "power=null; metered=false")}


def test_reports_with_planted_faults(spark):
    cells = spark.createDataFrame([("ref", "m", 9, 1.0, 0.5, 1.5), ("a", "m", 9, 2.0, 1.5, 2.5), ("b", "m", 4, 2.0, 2.5, 3.0), ("off", "m", 9, 1.0, None, None)], "cell string, metric string, n int, mean double, ci_low double, ci_high double")
    deltas = spark.createDataFrame(
        [("a", "m", "grid", 9, 1.0, 0.5, 1.5, True, "BCa", 0.01, 0.02), ("b", "m", "grid", 9, 1.0, 0.5, 1.5, None, "odd", 0.0, 0.0), ("off", "m", "grid", 9, 0.0, 1.0, -1.0, True, "none", None, None)],
        "cell string, metric string, block string, n int, delta double, ci_low double, ci_high double, significant boolean, method string, perm_p double, perm_p_bonferroni double",
    )
    got = {(r.check_name, r.cell): r.status for r in checks.verify_report(cells, deltas, reference="ref", grid=["ref", "a", "b"], offgrid=["off"]).collect()}
    failed = {k for k, v in got.items() if v == "fail"}
    assert failed == {("level_within_ends", "b"), ("method_known", "b"), ("p_within_bounds", "b"), ("ends_in_order", "off"), ("delta_within_ends", "off"), ("paired_within_cells", "b"), ("block_of_cell", "off"), ("family_size", "all")}
    assert got["flag_matches_ends", "b"] == "skip" and got["reference_present", "ref"] == "pass"
    assert {r.status for r in checks.verify_report(cells, deltas.limit(0), reference="gone", grid=["ref", "a"]).where("check_name in ('family_size', 'reference_present')").collect()} == {"fail"}
