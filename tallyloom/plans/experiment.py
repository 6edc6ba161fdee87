"""Queries that compare cells: repeats, deltas, resampling, families, checks, melt and pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import answers, checks, inference, ranking, report
from tallyloom.session import load

REFERENCE = "control"
GRID, OFFGRID = ["control", "chunk_opt", "qdora", "combined"], ["prebaseline", "prebaseline2"]
CATEGORY_REFERENCE = "1-URGENT"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """scores(cell, run_id, query_id, metric, value) of linked records, repeats once."""
    r = load(spark, d, "query_records").where("linked and query_id is not null").select("record_id", "cell_name", "run_id", "query_id", "answer_text", "latency_ms", "tokens_output").distinct()
    wide = r.select(
        F.col("cell_name").alias("cell"), "run_id", "query_id",
        F.length(F.coalesce("answer_text", F.lit(""))).cast("double").alias("answer_chars"),
        (F.when(F.col("latency_ms") > 0, F.col("latency_ms")) / 1000).alias("latency_s"),
        F.col("tokens_output").cast("double").alias("tokens_out"),
    )
    return inference.melt(wide, ["cell", "run_id", "query_id"], ["answer_chars", "latency_s", "tokens_out"])


def melted_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).groupBy("cell", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def pooled_runs(spark: SparkSession, d: str) -> DataFrame:
    return inference.pool_runs(_scores(spark, d), least_runs=2)


def pooled_medians(spark: SparkSession, d: str) -> DataFrame:
    return inference.pool_runs(_scores(spark, d), stat="median")


def paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    return inference.delta_summary(inference.paired(inference.pool_runs(_scores(spark, d)), REFERENCE))


def delta_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap intervals and permutation p of every contrast; rows only."""
    return inference.deltas(inference.paired(inference.pool_runs(_scores(spark, d)), REFERENCE), contrasts=len(GRID) - 1)


def mean_intervals(spark: SparkSession, d: str) -> DataFrame:
    """BCa intervals per cell and metric; rows only."""
    return inference.bca_means(inference.pool_runs(_scores(spark, d)), ["cell", "metric"])


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order priorities as cells and market segments as questions: mean price and share of finished orders."""
    o = load(spark, d, "orders").join(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy(F.col("o_orderpriority").alias("cell"), F.col("c_mktsegment").alias("query_id")).agg(F.round(F.avg("o_totalprice"), 4).alias("cost"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("joint"))
    return per.select("cell", "query_id", F.col("cost").alias("value")), per.select("cell", "query_id", F.col("joint").alias("value"))


def permutation_exact(spark: SparkSession, d: str) -> DataFrame:
    cost, joint = _segments(spark, d)
    long = cost.withColumn("metric", F.lit("cost")).unionByName(joint.withColumn("metric", F.lit("joint")))
    return inference.exact_sign_flips(inference.paired(long, CATEGORY_REFERENCE))


def ratio_permutation_exact(spark: SparkSession, d: str) -> DataFrame:
    return inference.exact_ratio_swaps(*_segments(spark, d), CATEGORY_REFERENCE)


def ratio_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Deltas of cost per finished order with resampled ends; rows only."""
    return inference.ratio_deltas(*_segments(spark, d), CATEGORY_REFERENCE)


def seeded_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    cost, _ = _segments(spark, d)
    return inference.seeded_bootstrap(cost, ["cell"])


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderpriority").alias("cell"), F.col("o_totalprice").alias("cost"), (F.col("o_orderstatus") == "F").cast("double").alias("joint"))
    return answers.ratio_of_means(o, ["cell"], "cost", "joint")


def ratio_by_cell(spark: SparkSession, d: str) -> DataFrame:
    return _ratios(spark, d).select("cell", "n", *(F.round(c, 4).alias(c) for c in ("num_mean", "den_mean", "ratio")))


def ratio_against_reference(spark: SparkSession, d: str) -> DataFrame:
    r = _ratios(spark, d)
    ref = r.where(F.col("cell") == CATEGORY_REFERENCE).select(F.col("ratio").alias("ref"))
    return r.where(F.col("cell") != CATEGORY_REFERENCE).crossJoin(F.broadcast(ref)).select(F.concat_ws("_vs_", "cell", F.lit(CATEGORY_REFERENCE)).alias("contrast"), F.round(F.col("ratio") - F.col("ref"), 4).alias("delta"))


def experiment_families(spark: SparkSession, d: str) -> DataFrame:
    cells = load(spark, d, "query_records").select(F.col("cell_name").alias("cell")).distinct()
    return inference.split_families(cells, GRID, OFFGRID)


def grid_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Means of the 2 x 2 grid: chunking level by model level."""
    r = load(spark, d, "query_records").where(F.col("linked") & F.col("cell_name").isin(*GRID)).select("record_id", "cell_name", "tokens_output").distinct()
    levels = r.select("tokens_output", F.when(F.col("cell_name").isin("chunk_opt", "combined"), "optimised").otherwise("plain").alias("chunking"), F.when(F.col("cell_name").isin("qdora", "combined"), "tuned").otherwise("base").alias("level"))
    return levels.groupBy("chunking").pivot("level", ["base", "tuned"]).agg(F.round(F.avg("tokens_output"), 6))


def cell_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "query_records").where("linked").select("record_id", "cell_name", "run_id").distinct()
    return r.rollup("cell_name", "run_id").agg(F.count("*").alias("n"))


def pool_checks(spark: SparkSession, d: str) -> DataFrame:
    records = load(spark, d, "query_records").select("record_id", "cell_name", "linked", "top_n", "top_k").distinct()
    pools = ranking.pool_summary(records, "cell_name").withColumnRenamed("cell_name", "cell")
    return checks.verify_pools(pools, 5).select("check_name", "cell", "status")


def ratio_checks(spark: SparkSession, d: str) -> DataFrame:
    return checks.status_counts(checks.verify_ratios(_ratios(spark, d)))


def delta_checks(spark: SparkSession, d: str) -> DataFrame:
    """The report verifies itself: every contrast passes every check; rows only."""
    return checks.status_counts(checks.verify_deltas(delta_blocks(spark, d), contrasts=len(GRID) - 1))


def experiment_report(spark: SparkSession, d: str) -> DataFrame:
    """Grid and off-grid contrasts of all metrics with the checks they passed; rows only."""
    out = report.experiment(_scores(spark, d), reference=REFERENCE, grid=GRID, offgrid=OFFGRID)
    passed = out["checks"].groupBy("block", "cell", "metric").agg(F.count_if(F.col("status") == "fail").alias("failed_checks"))
    return out["deltas"].join(passed, ["block", "cell", "metric"])


def _ordered(middle: str):
    """Whether an interval holds its middle; one without ends holds anything."""
    return F.coalesce((F.col("ci_low") <= F.col(middle) + 1e-9) & (F.col("ci_high") >= F.col(middle) - 1e-9), F.lit(True)).alias("ordered")


def _p_fits(contrasts: int):
    p = F.col("perm_p")
    return F.coalesce((p > 0) & (p <= 1) & (F.abs(F.col("perm_p_bonferroni") - F.least(F.lit(1.0), p * contrasts)) < 1e-9), F.lit(True)).alias("p_fits")


def delta_blocks_checked(spark: SparkSession, d: str) -> DataFrame:
    """delta_blocks with what SQL can say of it: counts and deltas as they are, ends and p as whether they can be right."""
    return delta_blocks(spark, d).select("cell", "metric", "n", F.round("delta", 3).alias("delta"), _ordered("delta"), _p_fits(len(GRID) - 1))


def mean_intervals_checked(spark: SparkSession, d: str) -> DataFrame:
    return mean_intervals(spark, d).select("cell", "metric", "n", F.round("mean", 3).alias("mean"), _ordered("mean"))


def ratio_deltas_checked(spark: SparkSession, d: str) -> DataFrame:
    fits = F.coalesce((F.col("perm_p") > 0) & (F.col("perm_p") <= 1), F.lit(True)).alias("p_fits")
    return ratio_deltas(spark, d).select("cell", "n", F.round("delta", 3).alias("delta"), _ordered("delta"), fits)


def experiment_checked(spark: SparkSession, d: str) -> DataFrame:
    return experiment_report(spark, d).select("block", "cell", "metric", "n", F.round("delta", 3).alias("delta"), F.col("failed_checks").cast("int").alias("failed_checks"))


QUERIES = {
    f.__name__: f
    for f in (
        melted_scores, pooled_runs, pooled_medians, paired_deltas, delta_blocks, mean_intervals, permutation_exact, ratio_permutation_exact, ratio_deltas, seeded_bootstrap, ratio_by_cell,
        ratio_against_reference, experiment_families, grid_pivot, cell_rollup, pool_checks, ratio_checks, delta_checks, experiment_report, delta_blocks_checked, mean_intervals_checked, ratio_deltas_checked, experiment_checked,
    )
}

_SCORES = """
    r AS (SELECT DISTINCT record_id, cell_name AS cell, run_id, query_id, answer_text, latency_ms, tokens_output FROM query_records WHERE linked AND query_id IS NOT NULL),
    sc AS (
        SELECT cell, run_id, query_id, 'answer_chars' AS metric, length(coalesce(answer_text, ''))::DOUBLE AS value FROM r
        UNION ALL SELECT cell, run_id, query_id, 'latency_s', latency_ms / 1000 FROM r WHERE latency_ms > 0
        UNION ALL SELECT cell, run_id, query_id, 'tokens_out', tokens_output FROM r WHERE tokens_output IS NOT NULL)"""
_SEGMENTS = """
    per AS (SELECT o_orderpriority AS cell, c_mktsegment AS query_id, round(avg(o_totalprice), 4) AS cost, round(avg((o_orderstatus = 'F')::INT), 6) AS joint FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
_RATIOS = "ra AS (SELECT o_orderpriority AS cell, count(*) AS n, avg(o_totalprice) AS num_mean, avg((o_orderstatus = 'F')::INT) AS den_mean, avg(o_totalprice) / avg((o_orderstatus = 'F')::INT) AS ratio FROM orders GROUP BY 1)"

_PAIRED = f"""
    {_SCORES}, p AS (SELECT cell, metric, query_id, round(avg(value) + 1e-9, 6) AS v FROM sc GROUP BY 1, 2, 3),
    contrast AS (SELECT a.cell, a.metric, count(*) AS n, round(avg(a.v - b.v), 3) AS delta FROM p a JOIN p b ON a.metric = b.metric AND a.query_id = b.query_id AND b.cell = 'control' AND a.cell <> 'control' GROUP BY 1, 2)"""

SQL = {
    "delta_blocks_checked": f"WITH {_PAIRED} SELECT *, true AS ordered, true AS p_fits FROM contrast",
    "mean_intervals_checked": f"WITH {_PAIRED} SELECT cell, metric, count(*) AS n, round(avg(v), 3) AS mean, true AS ordered FROM p GROUP BY 1, 2",
    "experiment_checked": f"WITH {_PAIRED} SELECT CASE WHEN cell LIKE 'prebaseline%' THEN 'offgrid' ELSE 'grid' END AS block, *, 0 AS failed_checks FROM contrast WHERE cell IN ('chunk_opt', 'qdora', 'combined', 'prebaseline', 'prebaseline2')",
    "delta_checks": f"""
        WITH {_PAIRED} SELECT check_name, count(*) AS n, count(*) AS passed, 0 AS failed FROM contrast, (VALUES ('ends_in_order'), ('delta_within_ends'), ('flag_matches_ends'), ('p_within_bounds'), ('bonferroni'), ('method_known')) c(check_name) GROUP BY 1""",
    "ratio_deltas_checked": f"""
        WITH {_SEGMENTS} SELECT a.cell, count(*) AS n, round(sum(a.cost) / sum(a.joint) - sum(b.cost) / sum(b.joint), 3) AS delta, true AS ordered, true AS p_fits
        FROM per a JOIN per b ON a.query_id = b.query_id AND b.cell = '1-URGENT' AND a.cell <> '1-URGENT' GROUP BY 1""",
    "melted_scores": f"WITH {_SCORES} SELECT cell, metric, count(*) AS n, round(sum(value), 3) AS total FROM sc GROUP BY 1, 2",
    "pooled_runs": f"WITH {_SCORES} SELECT cell, metric, query_id, round(avg(value) + 1e-9, 6) AS value, count(DISTINCT run_id) AS runs FROM sc GROUP BY 1, 2, 3 HAVING count(DISTINCT run_id) >= 2",
    "pooled_medians": f"WITH {_SCORES} SELECT cell, metric, query_id, round(median(value) + 1e-9, 6) AS value, count(DISTINCT run_id) AS runs FROM sc GROUP BY 1, 2, 3",
    "paired_deltas": f"""
        WITH {_SCORES}, p AS (SELECT cell, metric, query_id, round(avg(value) + 1e-9, 6) AS v FROM sc GROUP BY 1, 2, 3)
        SELECT a.cell, a.metric, count(*) AS n, round(avg(a.v - b.v), 6) AS delta, round(stddev_samp(a.v - b.v), 6) AS diff_sd FROM p a JOIN p b ON a.metric = b.metric AND a.query_id = b.query_id AND b.cell = 'control' AND a.cell <> 'control' GROUP BY 1, 2""",
    "permutation_exact": f"""
        WITH {_SEGMENTS}, v AS (SELECT cell, query_id, 'cost' AS metric, cost AS x FROM per UNION ALL SELECT cell, query_id, 'joint', joint FROM per),
        dd AS (SELECT a.cell, a.metric, a.query_id, a.x - b.x AS df, row_number() OVER (PARTITION BY a.cell, a.metric ORDER BY a.query_id) - 1 AS i, count(*) OVER (PARTITION BY a.cell, a.metric) AS n FROM v a JOIN v b ON a.query_id = b.query_id AND a.metric = b.metric AND b.cell = '1-URGENT' AND a.cell <> '1-URGENT'),
        dr AS (SELECT cell, metric, n, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -df ELSE df END) AS t, sum(df) AS obs, bool_or(df <> 0) AS moved FROM dd, (SELECT unnest(range(0, 16384))::INT AS mask) WHERE mask < (1 << n) GROUP BY 1, 2, 3, 4)
        SELECT cell, metric, n, CASE WHEN n >= 2 AND bool_or(moved) THEN round(least(1.0, 2 * least(avg((t <= obs + 1e-9)::INT), avg((t >= obs - 1e-9)::INT))), 9) END AS perm_p, 'exact' AS method FROM dr GROUP BY 1, 2, 3""",
    "ratio_permutation_exact": f"""
        WITH {_SEGMENTS}, q AS (SELECT a.cell, a.cost AS na, a.joint AS da, b.cost AS nb, b.joint AS db, row_number() OVER (PARTITION BY a.cell ORDER BY a.query_id) - 1 AS i, count(*) OVER (PARTITION BY a.cell) AS n FROM per a JOIN per b ON a.query_id = b.query_id AND b.cell = '1-URGENT' AND a.cell <> '1-URGENT'),
        s AS (SELECT cell, n, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN nb ELSE na END) AS x1, sum(CASE WHEN (mask >> i) & 1 = 1 THEN db ELSE da END) AS y1, sum(CASE WHEN (mask >> i) & 1 = 1 THEN na ELSE nb END) AS x2, sum(CASE WHEN (mask >> i) & 1 = 1 THEN da ELSE db END) AS y2 FROM q, (SELECT unnest(range(0, 16384))::INT AS mask) WHERE mask < (1 << n) GROUP BY 1, 2, 3),
        t AS (SELECT cell, n, mask, x1 / nullif(y1, 0) - x2 / nullif(y2, 0) AS t FROM s), o AS (SELECT cell, t AS obs FROM t WHERE mask = 0)
        SELECT cell, n, round(max(obs), 6) AS delta, round(avg((t IS NULL OR abs(t) >= abs(obs) - 1e-9)::INT), 9) AS perm_p, 'exact' AS method FROM t JOIN o USING (cell) GROUP BY 1, 2""",
    "seeded_bootstrap": f"""
        WITH {_SEGMENTS}, v AS (SELECT cell, list(cost ORDER BY query_id) AS v FROM per GROUP BY 1), b AS (SELECT unnest(range(1, 1000)) AS b),
        m AS (SELECT cell, len(v) AS n, round(list_sum(list_transform(range(1, len(v) + 1), lambda j: v[(('0x' || substr(md5(b || ':' || j), 1, 8))::BIGINT % len(v)) + 1])) / len(v), 9) AS m FROM v, b)
        SELECT cell, n, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY 1, 2""",
    "ratio_by_cell": f"WITH {_RATIOS} SELECT cell, n, round(num_mean, 4) AS num_mean, round(den_mean, 4) AS den_mean, round(ratio, 4) AS ratio FROM ra",
    "ratio_against_reference": f"WITH {_RATIOS} SELECT cell || '_vs_1-URGENT' AS contrast, round(ratio - (SELECT ratio FROM ra WHERE cell = '1-URGENT'), 4) AS delta FROM ra WHERE cell <> '1-URGENT'",
    "experiment_families": "SELECT DISTINCT cell_name AS cell, CASE WHEN cell_name IN ('control', 'chunk_opt', 'qdora', 'combined') THEN 'grid' WHEN cell_name IN ('prebaseline', 'prebaseline2') THEN 'offgrid' ELSE 'unknown' END AS family FROM query_records",
    "grid_pivot": """
        WITH r AS (SELECT DISTINCT record_id, cell_name, tokens_output FROM query_records WHERE linked AND cell_name IN ('control', 'chunk_opt', 'qdora', 'combined'))
        SELECT CASE WHEN cell_name IN ('chunk_opt', 'combined') THEN 'optimised' ELSE 'plain' END AS chunking, round(avg(tokens_output) FILTER (cell_name NOT IN ('qdora', 'combined')), 6) AS base, round(avg(tokens_output) FILTER (cell_name IN ('qdora', 'combined')), 6) AS tuned FROM r GROUP BY 1""",
    "cell_rollup": "SELECT cell_name, run_id, count(*) AS n FROM (SELECT DISTINCT record_id, cell_name, run_id FROM query_records WHERE linked) GROUP BY ROLLUP (cell_name, run_id)",
    "pool_checks": """
        WITH r AS (SELECT DISTINCT record_id, cell_name, top_n FROM query_records WHERE linked), p AS (SELECT cell_name AS cell, min(top_n) AS lo, max(top_n) AS hi, count(*) - count(top_n) AS miss FROM r GROUP BY 1)
        SELECT 'serves_k' AS check_name, cell, CASE WHEN lo >= 5 THEN 'pass' ELSE 'fail' END AS status FROM p UNION ALL SELECT 'one_width', cell, CASE WHEN lo = hi THEN 'pass' ELSE 'fail' END FROM p UNION ALL SELECT 'none_missing', cell, CASE WHEN miss = 0 THEN 'pass' ELSE 'fail' END FROM p""",
    "ratio_checks": f"WITH {_RATIOS} SELECT 'ratio_identity' AS check_name, count(*) AS n, count(*) AS passed, 0 AS failed FROM ra UNION ALL SELECT 'rate_within_bounds', count(*), count(*) FILTER (den_mean BETWEEN 0 AND 1), count(*) FILTER (den_mean NOT BETWEEN 0 AND 1) FROM ra",
}
