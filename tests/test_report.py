import pytest
from pyspark.sql import functions as F

from tallyloom.functions.tables import pipe_table, pipe_table_column
from tallyloom.operators import report


def test_an_experiment_checks_itself(spark):
    rows = [(c, "r1", f"q{i}", "m", float(i % 3 + s)) for c, s in (("ref", 0), ("a", 1), ("b", 0), ("off", 2), ("other", 1)) for i in range(9)] + [("a", "r2", "q0", "m", 3.0)]
    scores = spark.createDataFrame(rows, "cell string, run_id string, query_id string, metric string, value double")
    out = report.experiment(scores, reference="ref", grid=["ref", "a", "b"], offgrid=["off"])
    got = {(r.block, r.cell): r for r in out["deltas"].collect()}
    assert set(got) == {("grid", "a"), ("grid", "b"), ("offgrid", "off")}
    assert got["offgrid", "off"].delta == 2.0 and got["offgrid", "off"].method == "degenerate"
    assert got["grid", "a"].perm_p_bonferroni == pytest.approx(min(1.0, 2 * got["grid", "a"].perm_p))
    assert out["cells"].count() == 5
    failed = {(r.check_name, r.cell) for r in out["checks"].where("status = 'fail'").collect()}
    assert failed <= {("flag_matches_ends", "off")}  # a constant difference is reported as not significant
    assert report.experiment(scores.where("cell <> 'ref'"), reference="ref", grid=["ref", "a"])["deltas"].count() == 0
    with pytest.raises(ValueError):
        report.experiment(scores, reference="off", grid=[], offgrid=["off"])


def test_small_tables(spark):
    leaves = spark.createDataFrame([("c", "a.b", 1.0, None), ("c", "a.b", 3.0, None), ("c", "n", 2.0, None), ("c", "n", 2.0, None), ("c", "f", None, False), ("c", "f", None, True)], "cell string, path string, number double, flag boolean")
    assert {r.path: (r.number, r.flag) for r in report.pool_blocks(leaves, ["cell"], ["n"]).collect()} == {"a.b": (2.0, None), "n": (4.0, None), "f": (None, True)}
    gate = report.gold_gate(spark.createDataFrame([(0, 0), (5, 0), (5, 2)], "quotes int, unmatched int"))
    assert [r.verdict for r in gate.orderBy("quotes", "unmatched").collect()] == ["no gold", "ok", "unmatched gold"]
    asked = spark.createDataFrame([("a", "laptop", None), ("b", "laptop", 9.0), ("c", "gone", None)], "cell string, device string, idle_w double")
    known = spark.createDataFrame([("laptop", 7.0)], "device string, idle_w double")
    assert [(r.cell, r.idle_w, r.known) for r in report.resolve_devices(asked, known, ["idle_w"]).orderBy("cell").collect()] == [("a", 7.0, True), ("b", 9.0, True), ("c", None, False)]
    assert spark.range(1).select(report.format_bound(F.lit(1_000_000)).alias("x")).first().x == "1970-01-01T00:00:01Z"
    levels = spark.createDataFrame([("r", "m", 1.0), ("a", "m", 1.5), ("a", "n", 2.0)], "cell string, metric string, value double")
    assert sorted((r.metric, r.delta) for r in report.level_differences(levels, "r").collect() if r.delta is not None) == [("m", 0.5)]


def test_pipe_tables(spark):
    html = "<table><tr><th>A</th><th>B &amp; C</th></tr><tr><td>1 | 2</td></tr></table>"
    assert pipe_table(None, html) == "| A | B & C |\n|---|---|\n| 1 \\| 2 |  |"
    assert pipe_table("one\n\ntwo") == "| one |\n|---|\n| two |" and pipe_table("| a |\n|---|") == "| a |\n|---|" and pipe_table(None) is None and pipe_table("") == ""
    df = spark.createDataFrame([("x", None), (None, html), (None, None)], "r string, h string")
    assert [r.t is None for r in df.select(pipe_table_column("r", "h").alias("t")).collect()] == [False, False, True]
