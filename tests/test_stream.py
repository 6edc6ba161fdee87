from tallyloom.streaming import power


def test_windows_and_holes(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("2026-01-01T00:00:05Z", 10.0, "d", "t"), ("2026-01-01T00:00:15Z", 20.0, "d", "t"), ("2026-01-01T00:01:05Z", 30.0, "d", "t"), ("bad", 1.0, "d", "t"), ("2026-01-01T00:01:06Z", -1.0, "d", "t")]
    spark.createDataFrame(rows, power.LOG_SCHEMA).coalesce(1).write.parquet(str(src))
    got = power.run_once(power.minute_windows(power.power_stream(spark, str(src))), "w1", str(tmp_path / "ck1"), "complete")
    assert sorted((r.n, r.mean_w) for r in got.collect()) == [(1, 30.0), (2, 15.0)]
    gaps = power.run_once(power.holes(power.power_stream(spark, str(src))), "w2", str(tmp_path / "ck2"))
    assert [(r.device, r.to_s - r.from_s) for r in gaps.collect()] == [("d", 50.0)]
    power.run_to_files(power.power_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck3"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
