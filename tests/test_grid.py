import numpy as np
import pytest

from tallyloom.operators import grid

SCHEMA = "iso_ts string, watts double, device string, tag string, minute bigint, n int"


def log(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def test_styles_of_stamps(spark):
    good = {
        "2026-08-30T05:34:12.367+01:00": 1788064452.367, "2026-07-08T16:52:48.783Z": 1783529568.783, "2026-08-04T04:11:35.956": 1785816695.956, "2026-06-19 11:14:28+00:00": 1781867668.0,
        "20260619T111428Z": 1781867668.0, "2026-06-19T11:14:28,5Z": 1781867668.5, "2026-06-19t13:14+0200": 1781867640.0, " 2026-06-19T11:14:28 ": 1781867668.0, "2026-06-19T06:14:28-05": 1781867668.0,
    }
    bad = ["clock not set", "2026-13-40T25:61:00Z", "", "n/a", None, "05:34:12", "2026", "now", "T05:34"]
    df = spark.createDataFrame([(s,) for s in [*good, *bad]], "s string")
    got = {r.s: r.us for r in df.selectExpr("s").withColumn("us", grid.F.unix_micros(grid.iso_instant(grid.F.col("s")))).collect()}
    assert {s: got[s] / 1e6 for s in good} == pytest.approx(good)
    assert all(got[s] is None for s in bad)


def test_missing_minutes_and_unusable_samples(spark):
    rows = [("2026-01-01T00:00:10Z", 5.0, "d", "t"), ("2026-01-01T00:00:10Z", 5.0, "d", "t"), ("2026-01-01T00:01:10Z", float("nan"), "d", "t"), ("2026-01-01T00:02:10Z", -1.0, "d", "t"),
            ("2026-01-01T00:03:10Z", float("inf"), "d", "t"), ("2026-01-01T00:03:20Z", None, "d", "t"), ("2026-01-01T00:04:00Z", 0.0, "d", "t"), ("2026-01-01T00:00:00Z", 1.0, None, None), ("bad", 1.0, "e", "t")]
    got = [(r.device, (r.minute_epoch - 1767225600) // 60, r.n_readings, r.mean_watts, r.missing) for r in grid.minute_grid(log(spark, rows)).orderBy("device", "minute_epoch").collect()]
    assert got == [(None, 0, 1, 1.0, False), ("d", 0, 1, 5.0, False), ("d", 1, 0, None, True), ("d", 2, 0, None, True), ("d", 3, 0, None, True), ("d", 4, 1, 0.0, False)]


def test_an_empty_log_gives_no_rows(spark):
    assert grid.minute_grid(log(spark, [])).count() == 0


def dense_smoother(t, y, r, s, q, at):
    """Exact conditional means and variances of the same model, from its covariance matrix."""
    times = np.concatenate([t, at])
    order = np.argsort(times, kind="stable")
    T = times[order]
    n = len(T)
    m0, P = np.array([0.0, 0.0]), np.diag(grid.PRIOR).astype(float)
    # levels as a linear map of the first state and the increments
    cov = np.zeros((n, n))
    states = []
    for i in range(n):
        if i == 0:
            states.append(P)
            cross = P[:, :1].copy() * 0
        dt = T[i] - T[i - 1] if i else 0.0
        F = np.array([[1.0, dt], [0.0, 1.0]])
        Q = np.array([[s * dt + q * dt**3 / 3, q * dt * dt / 2], [q * dt * dt / 2, q * dt]])
        if i:
            states.append(F @ states[-1] @ F.T + Q)
    for i in range(n):
        back = states[i]
        cov[i, i] = back[0, 0]
        c = back.copy()
        for j in range(i + 1, n):
            dt = T[j] - T[j - 1]
            c = np.array([[1.0, dt], [0.0, 1.0]]) @ c
            cov[i, j] = cov[j, i] = c[0, 0]
    del cross, m0
    place = np.empty(n, int)
    place[order] = np.arange(n)
    o, g = place[: len(t)], place[len(t) :]
    K = cov[np.ix_(o, o)] + np.diag(r)
    W = cov[np.ix_(g, o)] @ np.linalg.inv(K)
    return W @ y, np.diag(cov[np.ix_(g, g)] - W @ cov[np.ix_(o, g)])


def test_smoother_equals_the_dense_solution(monkeypatch):
    monkeypatch.setattr(grid, "PRIOR", (100.0, 0.01))  # a wide prior would drown the dense solution in rounding
    rng = np.random.default_rng(3)
    minutes = [0, 1, 2, 5, 6, 9]
    obs = [{"minute": m, "n": int(rng.integers(1, 5)), "mean_w": float(rng.normal()), "at_s": m * 60 + float(rng.uniform(1, 58))} for m in minutes]
    r, s = 2.0, 0.05
    got = grid.smooth_day(obs, r, s, (0.0, 0.0, grid.PRIOR[0], 0.0, grid.PRIOR[1]), obs[0]["at_s"], grid.NOTHING, None, None)
    at = np.array([m * 60 + 30.0 for m, *_ in got])
    inner = at >= obs[0]["at_s"]
    got = [(*g[:3], g[3], g[4]) for g in got]
    mean, var = dense_smoother(np.array([o["at_s"] for o in obs]), np.array([o["mean_w"] for o in obs]), np.array([r / o["n"] for o in obs]), s, s * grid.SLOPE_SHARE, at[inner])
    assert np.allclose(np.array([g[3] for g in got])[inner], np.maximum(0, mean), atol=1e-6)
    assert np.allclose(np.array([g[4] for g in got])[inner] ** 2, var, atol=1e-6)


def test_days_are_smoothed_as_if_they_were_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for m in range(0, 200):
        if m % 7 in (3, 4) or 90 <= m <= 110:
            continue
        for k in range(2):
            sec = m * 60 + 13 + 30 * k
            rows.append((f"2026-01-01T{sec // 3600:02d}:{sec % 3600 // 60:02d}:{sec % 60:02d}Z", float(50 + 5 * np.sin(m / 20) + rng.normal(0, 0.3)), "d", "t"))
    whole = grid.minute_grid(log(spark, rows)).orderBy("minute_epoch").toPandas()
    monkeypatch.setattr(grid, "DAY", 1800)  # cuts the same readings into seven stretches
    levels = grid.noise_levels
    monkeypatch.setattr(grid, "noise_levels", lambda m: levels(m).selectExpr("device", "tag", "0.1D AS r", "0.02D AS s"))
    cut = grid.minute_grid(log(spark, rows)).orderBy("minute_epoch").toPandas()
    monkeypatch.setattr(grid, "DAY", 86400)
    one = grid.minute_grid(log(spark, rows)).orderBy("minute_epoch").toPandas()
    assert len(whole) == len(cut) == len(one) == 199
    assert np.allclose(cut["smooth_watts"], one["smooth_watts"], atol=1e-5)
    assert np.allclose(cut["smooth_sd"], one["smooth_sd"], atol=1e-5)
