"""Cells compared: pooled repeats, paired deltas, resampling in SQL and on numpy, grid and off-grid families.

Everything after scoring works on one long table scores(cell, run_id, query_id, metric, value). The statistics run on
one value per (cell, metric, question): a group is as large as the question set, not as the log.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import resampling
from tallyloom.functions.arrays import bonferroni, settled

#: The most questions whose sign patterns are enumerated in SQL.
EXACT_QUESTIONS = 14


def pool_runs(scores: DataFrame, stat: str = "mean", least_runs: int = 1) -> DataFrame:
    """One value per cell, metric and question over its runs; questions with fewer runs are left out."""
    how = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[stat]
    pooled = scores.where("value is not null").groupBy("cell", "metric", "query_id").agg(how("value").alias("value"), F.countDistinct("run_id").alias("runs"))
    return pooled.where(F.col("runs") >= least_runs).withColumn("value", settled(F.col("value"), 6))


def paired(scores: DataFrame, reference: str) -> DataFrame:
    """(cell, metric, query_id, a, b): each other cell's value next to the reference's, questions both have."""
    ref = scores.where(F.col("cell") == reference).select("metric", "query_id", F.col("value").alias("b"))
    mine = scores.where(F.col("cell") != reference).select("cell", "metric", "query_id", F.col("value").alias("a"))
    return mine.join(ref, ["metric", "query_id"]).where("a is not null and b is not null")


def delta_summary(pairs: DataFrame) -> DataFrame:
    """n, delta of means and spread of the differences per (cell, metric)."""
    return pairs.groupBy("cell", "metric").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("delta"), F.round(F.stddev_samp(F.col("a") - F.col("b")), 6).alias("diff_sd"))


def exact_sign_flips(pairs: DataFrame) -> DataFrame:
    """Two-sided permutation p per (cell, metric), with its method; null for n < 2 or no difference at all.

    exact: all 2**n sign patterns are enumerated. sampled: groups of more than EXACT_QUESTIONS questions take the p of
    the numpy kernel, which draws patterns.
    """
    size = F.count("*").over(Window.partitionBy("cell", "metric"))
    sized = pairs.select("cell", "metric", "query_id", "a", "b", size.alias("_size"))
    per = sized.where(F.col("_size") <= EXACT_QUESTIONS).groupBy("cell", "metric").agg(F.array_sort(F.collect_list(F.struct("query_id", (F.col("a") - F.col("b")).alias("d")))).alias("ds"))
    per = per.select("cell", "metric", F.transform("ds", lambda x: x["d"]).alias("d"))

    def sampled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        return pd.DataFrame([[*key, len(pdf), resampling.sign_flip_p((pdf["a"] - pdf["b"]).to_numpy(float)), "sampled"]], columns=["cell", "metric", "n", "perm_p", "method"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    large = sized.where(F.col("_size") > EXACT_QUESTIONS).groupBy("cell", "metric").applyInPandas(sampled, f"cell {kinds['cell']}, metric {kinds['metric']}, n int, perm_p double, method string")
    n = F.size("d")
    masks = per.withColumn("mask", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), n) - 1).cast("int"))))
    flipped = F.aggregate(F.arrays_zip(F.col("d"), F.sequence(F.lit(0), n - 1).alias("i")), F.lit(0.0), lambda acc, x: acc + F.when(F.call_function("shiftright", F.col("mask"), x["i"]).bitwiseAND(1) == 1, -x["d"]).otherwise(x["d"]))
    plain = F.aggregate("d", F.lit(0.0), lambda acc, x: acc + x)
    draws = masks.select("cell", "metric", n.alias("n"), flipped.alias("t"), plain.alias("obs"), F.exists("d", lambda x: x != 0).alias("any"))
    tails = draws.groupBy("cell", "metric", "n", "any").agg(F.avg((F.col("t") <= F.col("obs") + 1e-9).cast("double")).alias("less"), F.avg((F.col("t") >= F.col("obs") - 1e-9).cast("double")).alias("more"))
    p = F.when((F.col("n") >= 2) & F.col("any"), F.least(F.lit(1.0), 2 * F.least("less", "more")))
    return tails.select("cell", "metric", "n", F.round(p, 9).alias("perm_p"), F.lit("exact").alias("method")).unionByName(large)


def seeded_bootstrap(values: DataFrame, keys: list[str], draws: int = 999, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean from draws that any SQL engine repeats: index = md5('draw:place') mod n.

    values(keys..., query_id, value) with one row per question; a group is a question set and small by nature.
    """
    per = values.where("value is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("query_id", "value"))).alias("v")).select(*keys, F.transform("v", lambda x: x["value"]).alias("v"))
    drawn = per.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    n = F.size("v")
    at = lambda j: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("b").cast("string"), j.cast("string"))), 1, 8), 16, 10).cast("bigint") % n
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, j: acc + F.element_at("v", (at(j) + 1).cast("int")))
    means = drawn.select(*keys, n.alias("n"), F.round(total / n, 9).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy(*keys, "n").agg(F.round(F.percentile("m", F.lit(tail)), 6).alias("ci_low"), F.round(F.percentile("m", F.lit(1 - tail)), 6).alias("ci_high"))


def bca_means(values: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, ci_low, ci_high, method per group, by the numpy kernel."""
    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}

    def of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = resampling.mean_interval(pdf.sort_values("query_id")["value"].to_numpy(float))
        return pd.DataFrame([[*key, found["n"], found["mean"], found["ci_low"], found["ci_high"], found["method"]]], columns=[*keys, "n", "mean", "ci_low", "ci_high", "method"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n int, mean double, ci_low double, ci_high double, method string"
    return values.where("value is not null").select(*keys, "query_id", "value").groupBy(*keys).applyInPandas(of_group, schema)


def deltas(pairs: DataFrame, contrasts: int = 1) -> DataFrame:
    """Delta block per (cell, metric): n, delta, interval, significance, method, permutation p and its Bonferroni value."""

    def of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        a, b = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        d = resampling.paired_delta(a, b)
        return pd.DataFrame([[*key, d["n"], d["delta"], d["ci_low"], d["ci_high"], d["significant"], d["method"], resampling.sign_flip_p(a - b)]], columns=["cell", "metric", "n", "delta", "ci_low", "ci_high", "significant", "method", "perm_p"])

    out = pairs.select("cell", "metric", "query_id", "a", "b").groupBy("cell", "metric").applyInPandas(of_group, "cell string, metric string, n int, delta double, ci_low double, ci_high double, significant boolean, method string, perm_p double")
    return out.withColumn("perm_p_bonferroni", bonferroni(F.col("perm_p"), contrasts))


def ratio_deltas(num: DataFrame, den: DataFrame, reference: str) -> DataFrame:
    """Delta of mean(num) / mean(den) per cell against the reference, over the questions with all four values."""
    wide = num.select("cell", "query_id", F.col("value").alias("num")).join(den.select("cell", "query_id", F.col("value").alias("den")), ["cell", "query_id"]).where("num is not null and den is not null")
    ref = wide.where(F.col("cell") == reference).select("query_id", F.col("num").alias("num_b"), F.col("den").alias("den_b"))
    four = wide.where(F.col("cell") != reference).join(ref, "query_id")

    def of_cell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        v = [pdf[c].to_numpy(float) for c in ("num", "den", "num_b", "den_b")]
        d, p = resampling.ratio_delta(*v), resampling.ratio_swap_p(*v)
        return pd.DataFrame([[key[0], d["n"], d["delta"], d["ci_low"], d["ci_high"], d["significant"], d["method"], p]], columns=["cell", "n", "delta", "ci_low", "ci_high", "significant", "method", "perm_p"])

    return four.groupBy("cell").applyInPandas(of_cell, "cell string, n int, delta double, ci_low double, ci_high double, significant boolean, method string, perm_p double")


def exact_ratio_swaps(num: DataFrame, den: DataFrame, reference: str) -> DataFrame:
    """Permutation p of the ratio delta, with its method: each question's pair swaps cells, in all 2**n ways (exact) or, over
    EXACT_QUESTIONS questions, in ways drawn by the numpy kernel (sampled)."""
    wide = num.select("cell", "query_id", F.col("value").alias("num")).join(den.select("cell", "query_id", F.col("value").alias("den")), ["cell", "query_id"])
    ref = wide.where(F.col("cell") == reference).select("query_id", F.col("num").alias("nb"), F.col("den").alias("db"))
    four = wide.where(F.col("cell") != reference).join(ref, "query_id").withColumn("_size", F.count("*").over(Window.partitionBy("cell")))
    rows = four.where(F.col("_size") <= EXACT_QUESTIONS).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("query_id", F.col("num").alias("na"), F.col("den").alias("da"), "nb", "db"))).alias("v"))

    def sampled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = [pdf.sort_values("query_id")[c].to_numpy(float) for c in ("num", "den", "nb", "db")]
        return pd.DataFrame([[key[0], len(pdf), resampling.ratio_delta(*v)["delta"], resampling.ratio_swap_p(*v), "sampled"]], columns=["cell", "n", "delta", "perm_p", "method"])

    large = four.where(F.col("_size") > EXACT_QUESTIONS).groupBy("cell").applyInPandas(sampled, f"cell {wide.schema['cell'].dataType.simpleString()}, n int, delta double, perm_p double, method string")
    masks = rows.withColumn("mask", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), F.size("v")) - 1).cast("int"))))
    swapped = lambda x: F.call_function("shiftright", F.col("mask"), x["i"]).bitwiseAND(1) == 1
    zipped = F.transform("v", lambda x, i: F.struct(i.alias("i"), x["na"].alias("na"), x["da"].alias("da"), x["nb"].alias("nb"), x["db"].alias("db")))
    add = lambda kept, other: F.aggregate(zipped, F.lit(0.0), lambda acc, x: acc + F.when(swapped(x), x[other].cast("double")).otherwise(x[kept].cast("double")))
    draws = masks.select("cell", F.size("v").alias("n"), "mask", (add("na", "nb") / F.nullif(add("da", "db"), F.lit(0.0)) - add("nb", "na") / F.nullif(add("db", "da"), F.lit(0.0))).alias("t"))
    obs = draws.where("mask = 0").select("cell", F.col("t").alias("obs"))
    extreme = F.col("t").isNull() | (F.abs("t") >= F.abs("obs") - 1e-9)
    return draws.join(F.broadcast(obs), "cell").groupBy("cell", "n").agg(F.round(F.max("obs"), 6).alias("delta"), F.round(F.avg(extreme.cast("double")), 9).alias("perm_p"), F.lit("exact").alias("method")).unionByName(large)


def split_families(cells: DataFrame, grid: list[str], offgrid: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """cells(cell) -> cell, family: grid, offgrid or unknown, after old names are replaced."""
    name = F.col("cell")
    for old, new in (aliases or {}).items():
        name = F.when(name == old, new).otherwise(name)
    return cells.select(name.alias("cell")).distinct().withColumn("family", F.when(F.col("cell").isin(*grid), "grid").when(F.col("cell").isin(*offgrid), "offgrid").otherwise("unknown"))


def melt(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide rows to (keys..., metric, value), missing values left out."""
    return wide.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value").where("value is not null")
