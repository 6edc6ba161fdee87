"""Irregular readings onto a regular minute grid, gaps filled by a Kalman smoother.

Readings are pooled to one observation per source and minute before anything else, so a source of any cadence
shrinks to its minutes. The model is a local trend in continuous time: a level that wanders and drifts with a
slope that wanders. One row holds the minutes of one source on one UTC day (at most 1,440); where a source spans
several days, each day's filter is summed up in a conditional-Gaussian element, elements are chained over the few
days of the source, and each day is then smoothed on its own from the state handed in at either end. The result is
that of one smoother over the whole source, with no source ever gathered into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.session import materialise, shuffle_width

MINUTE, DAY = 60, 86_400
#: Variance of the level and of the slope before the first observation.
PRIOR = (1e8, 1.0)
#: Diffusion of the slope as a share of that of the level, per square second.
SLOPE_SHARE = 1e-6

_PLAIN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$"
_ANY = r"^(\d{4})-?(\d{2})-?(\d{2})[Tt ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9})\d*)?)?\s*(Z|z|[+-]\d{2}(?::?\d{2})?)?$"


def iso_instant(text):
    """A timestamp from ISO 8601 in its usual styles; without offset it is UTC, unreadable text is null."""
    s = F.trim(text)
    part = lambda i: F.regexp_extract(s, _ANY, i)
    zone = F.regexp_replace(F.upper(part(8)), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    zone = F.when(zone.rlike(r":$"), F.concat(zone, F.lit("00"))).otherwise(zone)
    rebuilt = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), F.when(part(6) == "", "00").otherwise(part(6)), F.lit("."), F.when(part(7) == "", "0").otherwise(part(7)), zone)
    return F.when(s.rlike(_PLAIN), s.try_cast("timestamp")).when(s.rlike(_ANY), rebuilt.try_cast("timestamp"))


def usable_readings(log: DataFrame) -> DataFrame:
    """(device, tag, at, watts): readable stamp, finite watts of zero or more. at counts microseconds since 1970."""
    sampled = log.where("iso_ts is not null and watts is not null and not isnan(watts) and watts >= 0 and watts < double('Infinity')")
    # As the output of a generator the stamp is read once a row; a filter on a plain column would read it again.
    stamped = F.inline(F.array(F.struct(F.unix_micros(iso_instant(F.col("iso_ts"))).alias("at"), F.col("watts").cast("double").alias("watts"))))
    return sampled.select("device", "tag", stamped).where("at is not null")


def minute_means(readings: DataFrame) -> DataFrame:
    """One row per device, tag and minute with a reading: minute, n, mean_w, m2 (squared deviations), at_s (mean time).

    A repeated reading counts once. Partitioning by the minute serves both steps, so rows move once.
    """
    keyed = readings.withColumn("minute", F.floor(F.col("at") / 60_000_000)).repartition("device", "tag", "minute")
    once = keyed.groupBy("device", "tag", "minute", "at", "watts").agg(F.lit(1).alias("_one"))
    return once.groupBy("device", "tag", "minute").agg(
        F.count("*").alias("n"), F.avg("watts").alias("mean_w"), (F.var_pop("watts") * F.count("*")).alias("m2"), (F.avg(F.col("at") / 1e6)).alias("at_s")
    )


def noise_levels(minutes: DataFrame) -> DataFrame:
    """(device, tag, r, s): variance of a single reading and diffusion of the level per second, by moments."""
    day = Window.partitionBy("device", "tag", F.floor(F.col("minute") * MINUTE / DAY)).orderBy("minute")
    stepped = minutes.withColumns({"dw": F.col("mean_w") - F.lag("mean_w").over(day), "dt": F.col("at_s") - F.lag("at_s").over(day), "pn": F.lag("n").over(day)})
    near = F.col("dt") <= 180
    sums = stepped.groupBy("device", "tag").agg(
        F.sum("m2").alias("m2"), F.sum(F.col("n") - 1).alias("dof"),
        F.sum(F.when(near, F.col("dw") * F.col("dw"))).alias("d2"), F.sum(F.when(near, F.col("dt"))).alias("dt"),
        F.sum(F.when(near, 1 / F.col("n") + 1 / F.col("pn"))).alias("inv"), F.avg("mean_w").alias("level"),
    )
    floor = F.greatest(F.lit(1e-4), F.col("level") * F.col("level") * 1e-8)
    r = F.greatest(floor, F.when(F.col("dof") > 0, F.col("m2") / F.col("dof")).otherwise(floor))
    d2 = F.coalesce("d2", F.lit(0.0))
    s = F.greatest(d2 - r * F.coalesce("inv", F.lit(0.0)), 0.05 * d2, floor * 1e-2) / F.greatest(F.coalesce("dt", F.lit(0.0)), F.lit(60.0))
    return sums.select("device", "tag", r.alias("r"), s.alias("s"))


# ---- the model, on plain numbers: states are (m0, m1, p00, p01, p11), information is (h0, h1, j00, j01, j11) ----


def _advance(x: tuple, dt: float, s: float, q: float) -> tuple:
    m0, m1, a, b, c = x
    return (m0 + dt * m1, m1, a + 2 * dt * b + dt * dt * c + s * dt + q * dt**3 / 3, b + dt * c + q * dt * dt / 2, c + q * dt)


def _observe(x: tuple, y: float, r: float) -> tuple:
    m0, m1, a, b, c = x
    v = a + r
    k0, k1, e = a / v, b / v, y - m0
    return (m0 + k0 * e, m1 + k1 * e, a - k0 * a, b - k0 * b, c - k1 * b)


def _retreat(i: tuple, dt: float, s: float, q: float) -> tuple:
    """Information on the state dt earlier: F' (I + J Q)^-1 J F and F' (I + J Q)^-1 h."""
    h0, h1, j00, j01, j11 = i
    q00, q01, q11 = s * dt + q * dt**3 / 3, q * dt * dt / 2, q * dt
    a, b = 1 + j00 * q00 + j01 * q01, j00 * q01 + j01 * q11
    c, d = j01 * q00 + j11 * q01, 1 + j01 * q01 + j11 * q11
    det = a * d - b * c
    g0, g1 = (d * h0 - b * h1) / det, (a * h1 - c * h0) / det
    k00, k01, k11 = (d * j00 - b * j01) / det, (d * j01 - b * j11) / det, (a * j11 - c * j01) / det
    return (g0, g1 + dt * g0, k00, k01 + dt * k00, k11 + 2 * dt * k01 + dt * dt * k00)


def _fuse(x: tuple, i: tuple) -> tuple[float, float]:
    """Mean and variance of the level, from a state and independent information on it."""
    m0, m1, p, b, c = x
    h0, h1, j00, j01, j11 = i
    a00, a01 = 1 + p * j00 + b * j01, p * j01 + b * j11
    a10, a11 = b * j00 + c * j01, 1 + b * j01 + c * j11
    det = a00 * a11 - a01 * a10
    u0, u1 = m0 + p * h0 + b * h1, m1 + b * h0 + c * h1
    return (a11 * u0 - a01 * u1) / det, max(0.0, (a11 * p - a01 * b) / det)


NOTHING = (0.0, 0.0, 0.0, 0.0, 0.0)


def _element(t: list, y: list, r: list, s: float, q: float) -> list[float]:
    """A (4), b (2), C (3), h (2), J (3) of a stretch, from before its first observation to after its last."""
    eye = np.eye(2)
    A, b, C, h, J = eye, np.zeros(2), np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2))
    for k in range(len(t)):
        dt = t[k] - t[k - 1] if k else 0.0
        Fm = np.array([[1.0, dt], [0.0, 1.0]])
        Q = np.array([[s * dt + q * dt**3 / 3, q * dt * dt / 2], [q * dt * dt / 2, q * dt]])
        v = Q[0, 0] + r[k]
        gain = Q[:, 0] / v
        keep = eye - np.outer(gain, [1.0, 0.0])
        A2, b2, C2 = keep @ Fm, gain * y[k], keep @ Q
        h2, J2 = Fm[0] * (y[k] / v), np.outer(Fm[0], Fm[0]) / v
        D = np.linalg.inv(eye + C @ J2)
        E = np.linalg.inv(eye + J2 @ C)
        h, J = A.T @ E @ (h2 - J2 @ b) + h, A.T @ E @ J2 @ A + J
        A, b, C = A2 @ D @ A, A2 @ D @ (b + C @ h2) + b2, A2 @ D @ C @ A2.T + C2
    return [*A.ravel(), *b, C[0, 0], C[0, 1], C[1, 1], *h, J[0, 0], J[0, 1], J[1, 1]]


_DAY_SCHEMA = "device string, tag string, day bigint, first_s double, last_s double, first_minute bigint, last_minute bigint, r double, s double, element array<double>"
_STATE_SCHEMA = "device string, tag string, day bigint, before array<double>, before_s double, ahead array<double>, ahead_s double, next_minute bigint"


def _day_elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for row in pdf.itertuples(index=False):
            obs = row.minutes
            t, y = [o["at_s"] for o in obs], [o["mean_w"] for o in obs]
            e = _element([x - t[0] for x in t], y, [row.r / o["n"] for o in obs], row.s, row.s * SLOPE_SHARE)
            rows.append((row.device, row.tag, row.day, t[0], t[-1], obs[0]["minute"], obs[-1]["minute"], row.r, row.s, e))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _DAY_SCHEMA.split(", ")])


def _chain_days(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hands each day the state before it and the information after it; one row per day of one source."""
    pdf = pdf.sort_values("day", ignore_index=True)
    n = len(pdf)
    s = float(pdf["s"].iloc[0])
    q = s * SLOPE_SHARE
    eye = np.eye(2)
    parts = []
    for e in pdf["element"]:
        e = np.asarray(e, float)
        parts.append((e[:4].reshape(2, 2), e[4:6], np.array([[e[6], e[7]], [e[7], e[8]]]), e[9:11], np.array([[e[11], e[12]], [e[12], e[13]]])))
    before: list = [None] * n
    state = None
    for k in range(n):
        if k:
            before[k] = list(state)
            state = _advance(state, pdf["first_s"][k] - pdf["last_s"][k - 1], s, q)
        else:
            state = (0.0, 0.0, PRIOR[0], 0.0, PRIOR[1])
        A, b, C, h, J = parts[k]
        m, P = np.array(state[:2]), np.array([[state[2], state[3]], [state[3], state[4]]])
        D = np.linalg.inv(eye + P @ J)
        m2, P2 = A @ D @ (m + P @ h) + b, A @ D @ P @ A.T + C
        state = (m2[0], m2[1], P2[0, 0], P2[0, 1], P2[1, 1])
    ahead: list = [None] * n
    info = NOTHING
    for k in range(n - 1, -1, -1):
        ahead[k] = list(info)  # on the first observed time of the next day, that day's observations included
        last = _retreat(info, pdf["first_s"][k + 1] - pdf["last_s"][k], s, q) if k + 1 < n else NOTHING
        A, b, C, h, J = parts[k]
        h2, J2 = np.array(last[:2]), np.array([[last[2], last[3]], [last[3], last[4]]])
        E = np.linalg.inv(eye + J2 @ C)
        h1, J1 = A.T @ E @ (h2 - J2 @ b) + h, A.T @ E @ J2 @ A + J
        info = (h1[0], h1[1], J1[0, 0], J1[0, 1], J1[1, 1])
    return pd.DataFrame({
        "device": pdf["device"], "tag": pdf["tag"], "day": pdf["day"], "before": before, "before_s": pdf["last_s"].shift(1),
        "ahead": ahead, "ahead_s": pdf["first_s"].shift(-1), "next_minute": pdf["first_minute"].shift(-1).astype("Int64"),
    })


_GRID_SCHEMA = "device string, tag string, minute_epoch bigint, n_readings bigint, mean_watts double, smooth_watts double, smooth_sd double, missing boolean"


def smooth_day(obs: list, r: float, s: float, before: tuple | None, before_s: float | None, ahead: tuple, ahead_s: float | None, next_minute: int | None) -> list[tuple]:
    """(minute, n, mean, smoothed, sd) from the day's first minute to its last, or to the one before the next day's first."""
    q = s * SLOPE_SHARE
    base = obs[0]["at_s"]
    t, y, n = [o["at_s"] - base for o in obs], [o["mean_w"] for o in obs], [o["n"] for o in obs]
    filtered = []
    x = (y[0], 0.0, PRIOR[0], 0.0, PRIOR[1]) if before is None else before
    at = 0.0 if before is None else before_s - base
    start, start_at = x, at
    for k in range(len(t)):
        x = _observe(_advance(x, t[k] - at, s, q), y[k], r / n[k])
        at = t[k]
        filtered.append(x)
    backward = [NOTHING] * (len(t) + 1)  # information at each observed time, that observation included
    info, info_at = (ahead, ahead_s - base) if ahead_s is not None else (NOTHING, None)
    backward[len(t)], last_at = info, info_at
    for k in range(len(t) - 1, -1, -1):
        if info_at is not None:
            info = _retreat(info, info_at - t[k], s, q)
        w = n[k] / r
        info = (info[0] + y[k] * w, info[1], info[2] + w, info[3], info[4])
        backward[k], info_at = info, t[k]
    t.append(last_at if last_at is not None else float("inf"))

    by_minute = {o["minute"]: o for o in obs}
    out, k = [], -1
    for minute in range(obs[0]["minute"], (next_minute if next_minute is not None else obs[-1]["minute"] + 1)):
        g = minute * MINUTE + MINUTE / 2 - base
        while t[k + 1] <= g and k + 1 < len(filtered):
            k += 1
        if k >= 0:
            x = _advance(filtered[k], g - t[k], s, q)
        else:
            x = _advance(start, g - start_at, s, q) if before is not None and g > start_at else start
        nxt = k + 1
        info = _retreat(backward[nxt], t[nxt] - g, s, q) if t[nxt] != float("inf") and t[nxt] > g else NOTHING
        mean, var = _fuse(x, info)
        seen = by_minute.get(minute)
        out.append((minute, seen["n"] if seen else 0, seen["mean_w"] if seen else None, max(0.0, mean), var**0.5))
    return out


def _smooth_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _GRID_SCHEMA.split(", ")]
    none = lambda v: v is None or v is pd.NA or v != v
    for pdf in batches:
        rows = []
        for row in pdf.itertuples(index=False):
            chained = row.ahead is not None
            grid = smooth_day(
                list(row.minutes), row.r, row.s,
                tuple(row.before) if chained and row.before is not None else None, None if none(row.before_s) else row.before_s,
                tuple(row.ahead) if chained else NOTHING, None if none(row.ahead_s) else row.ahead_s, None if none(row.next_minute) else int(row.next_minute),
            )
            rows += [(row.device, row.tag, m * MINUTE, k, w, v, sd, k == 0) for m, k, w, v, sd in grid]
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def minute_grid(log: DataFrame) -> DataFrame:
    """One row per device, tag and UTC minute from the first to the last minute with a usable reading.

    minute_epoch is the minute's start in seconds; mean_watts is null in a missing minute, smooth_watts and smooth_sd
    are the smoother's value at the middle of the minute and its standard deviation, present for every minute. A null
    device or tag is a source of its own; a source without a usable reading has no row; an empty log gives none.
    """
    minutes = materialise(minute_means(usable_readings(log)))
    levels = noise_levels(minutes)
    days = minutes.groupBy("device", "tag", F.floor(F.col("minute") * MINUTE / DAY).alias("day")).agg(F.sort_array(F.collect_list(F.struct("minute", "n", "mean_w", "at_s"))).alias("minutes"))
    many = days.groupBy("device", "tag").agg(F.count("*").alias("n_days"))
    series = levels.join(many, levels["device"].eqNullSafe(many["device"]) & levels["tag"].eqNullSafe(many["tag"])).select(levels["device"], levels["tag"], "r", "s", "n_days")
    known = days.join(series, days["device"].eqNullSafe(series["device"]) & days["tag"].eqNullSafe(series["tag"])).select(days["device"], days["tag"], "day", "minutes", "r", "s", "n_days")
    known = materialise(known)
    elements = known.where("n_days > 1").drop("n_days").mapInPandas(_day_elements, _DAY_SCHEMA)
    # A row is small but dear, so tasks are counted by rows and not merged by size.
    width = shuffle_width(log.sparkSession)
    states = elements.repartition(width, "device", "tag").groupBy("device", "tag").applyInPandas(_chain_days, _STATE_SCHEMA)
    joint = known["device"].eqNullSafe(states["device"]) & known["tag"].eqNullSafe(states["tag"]) & (known["day"] == states["day"])
    ready = known.join(states, joint, "left").select(known["device"], known["tag"], "minutes", "r", "s", "before", "before_s", "ahead", "ahead_s", "next_minute")
    return ready.repartition(width).mapInPandas(_smooth_rows, _GRID_SCHEMA)
