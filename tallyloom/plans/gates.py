"""Queries on look-ups, gates and the verification of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import answers, checks, linkage, lookups
from tallyloom.plans.logs import _ROLE, key_sql
from tallyloom.session import load

SINCE_US, UNTIL_US = 1_782_000_000_000_000, 1_788_000_000_000_000


def outermost_intervals(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "intervals").where("start_at < end_at").select("label", F.unix_micros("start_at").alias("lo"), F.unix_micros("end_at").alias("hi"))
    return lookups.outermost(i, "label")


def turns_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Asking turns of a window of time, without the chats that hold a row of an unknown speaker (as if deleted)."""
    messages = load(spark, d, "messages")
    turns = lookups.between(linkage.asked_turns(messages), "at", SINCE_US, UNTIL_US, both=True)
    odd = messages.where(linkage.speaker_role(F.col("speaker")).isNull()).select("conversation_id")
    return lookups.among(turns.where("conversation_id is not null"), "conversation_id", skip=odd).select("message_id", "conversation_id", F.col("at").alias("at_us"))


def first_turns_listed(spark: SparkSession, d: str) -> DataFrame:
    """A bounded listing: the first 5,000 asking turns."""
    return lookups.listed(linkage.asked_turns(load(spark, d, "messages")), ["at", "message_id", "conversation_id"], 5000).select("message_id", F.col("at").alias("at_us"))


def cited_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers and their returned lines as evidence: the share that has any."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    e = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return lookups.cited(o, e, "key").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("cited").alias("n_cited"), F.round(F.avg("cited"), 6).alias("share"))


def path_probe(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", F.concat(F.lit('{"metrics": '), F.col("props"), F.lit("}")).alias("block"))
    return lookups.path_values(e, "event_id", "block", "metrics.k")


def first_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Users as reports and their events as blocks: purchases first, then views, else whatever begins with c."""
    e = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return lookups.first_block(e, "user_id", "event_type", "n", ["purchase", "view"], prefix="c")


def filled_numbers(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "query_records")
    return lookups.filled_columns(r, lookups.numeric_columns(r, skip=["record_id"]))


def warm_audit(spark: SparkSession, d: str) -> DataFrame:
    """Latencies as spans; what is reported is their sum, but for cells beginning with p, which report a second too much."""
    r = load(spark, d, "query_records").where("linked and answered_at is not null and latency_ms > 0").select(F.col("record_id").alias("span_id"), "cell_name", "run_id", F.unix_micros("answered_at").alias("end_us"), "latency_ms").distinct()
    s = r.withColumn("start_us", F.col("end_us") - F.col("latency_ms") * 1000)
    told = s.groupBy("cell_name", "run_id").agg((F.sum("latency_ms") / 1000 + F.max(F.col("cell_name").startswith("p").cast("int"))).alias("reported_s"))
    return lookups.warm_audit(s, told, ["cell_name", "run_id"])


def power_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Cells that are metered where they have a model, name a device where their run is known, and hold a power block for one provider."""
    c = load(spark, d, "query_records").groupBy("cell_name", "run_id").agg(F.count("model").alias("models"), F.max(F.when(F.col("cell_name") != "control", F.col("run_id"))).alias("device"), F.max(F.when(F.col("cell_name").startswith("c"), F.col("provider"))).alias("power"))
    return lookups.power_verdict(c, F.col("models") % 7 == 0, F.col("device"), F.col("power"), F.col("cell_name") != "qdora").select("cell_name", "run_id", "verdict")


def record_gates(spark: SparkSession, d: str) -> DataFrame:
    r = answers.refusal_signals(load(spark, d, "query_records").select("record_id", "answer_text", "answerable", "latency_ms", "linked").distinct())
    gates = {
        "timed": (F.col("latency_ms") > 0, ["latency_ms"]),
        "answers": (~F.col("is_refusal") | ~F.col("answerable"), ["is_refusal", "answerable"]),
    }
    out = lookups.record_gates(r, "record_id", gates)
    return out.groupBy("gate", "passed", F.when(F.col("gate") == "answers", F.col("inputs")).alias("inputs")).agg(F.count("*").alias("n"))


def unit_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as tokens on a line of positions, their orders as units; the weight is the discount."""
    l = load(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("key"), ((F.floor(F.col("l_orderkey") / 50)) * 10 + F.col("l_linenumber")).alias("lo"), F.col("l_discount").alias("weight")).distinct().withColumn("hi", F.col("lo") + 1)
    u = load(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("key"), F.col("o_orderkey").alias("unit"), (F.floor(F.col("o_orderkey") / 50) * 10).alias("lo")).withColumn("hi", F.col("lo") + 10)
    return lookups.pooled_units(l, u, "key").select("unit", "n", F.round("sum", 6).alias("sum"), F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


def report_checks(spark: SparkSession, d: str) -> DataFrame:
    """A report of prices per priority against the urgent ones, with a fault planted in each priority, verified."""
    o = load(spark, d, "orders")
    cells = o.groupBy(F.col("o_orderpriority").alias("cell")).agg(F.lit("price").alias("metric"), F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    cells = cells.select("cell", "metric", "n", "mean", (F.col("mean") - half).alias("ci_low"), F.when(F.col("cell") == "5-LOW", F.col("mean") - 2 * half).otherwise(F.col("mean") + half).alias("ci_high"))
    ref = cells.where("cell = '1-URGENT'").select("metric", F.col("mean").alias("ref"), F.col("n").alias("ref_n"))
    delta = F.col("mean") - F.col("ref")
    wide = F.lit(1000.0)
    deltas = cells.where("cell <> '1-URGENT'").join(ref, "metric").select(
        "cell", "metric", F.when(F.col("cell") == "4-NOT SPECIFIED", F.lit("offgrid")).otherwise("grid").alias("block"), F.least("n", "ref_n").alias("n"), delta.alias("delta"),
        F.when(F.col("cell") == "2-HIGH", delta + wide).otherwise(delta - wide).alias("ci_low"), (delta + wide / 2).alias("ci_high"),
        F.when(F.col("cell") == "3-MEDIUM", F.lit(None).cast("boolean")).otherwise((delta - wide > 0) | (delta + wide / 2 < 0)).alias("significant"),
        F.lit("BCa").alias("method"), F.lit(0.2).alias("perm_p"), F.when(F.col("cell") == "5-LOW", 0.2).otherwise(0.6).alias("perm_p_bonferroni"),
    )
    found = checks.verify_report(cells, deltas, reference="1-URGENT", grid=["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], offgrid=["4-NOT SPECIFIED"])
    return found.select("check_name", "cell", "metric", "status")


QUERIES = {
    f.__name__: f
    for f in (
        outermost_intervals, turns_in_window, first_turns_listed, cited_orders, path_probe, first_blocks, filled_numbers, warm_audit, power_verdicts, record_gates, unit_pooling, report_checks,
    )
}

_NUMBERS = "tokens_total tokens_input tokens_output latency_ms top_k top_n retrieval_latency_ms rerank_latency_ms".split()
_ASKED = f"t AS (SELECT DISTINCT {key_sql('content')} AS key, message_id, conversation_id, epoch_us(created_at) AS at_us FROM messages WHERE content IS NOT NULL AND message_id IS NOT NULL AND created_at IS NOT NULL AND {_ROLE} = 'ask'), turns AS (SELECT * FROM t WHERE key <> '')"

SQL = {
    "outermost_intervals": """
        WITH v AS (SELECT DISTINCT label, epoch_us(start_at) AS lo, epoch_us(end_at) AS hi FROM intervals WHERE label IS NOT NULL AND start_at < end_at),
        w AS (SELECT *, max(hi) OVER (PARTITION BY label ORDER BY lo, hi DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v)
        SELECT label, lo, hi FROM w WHERE reach IS NULL OR reach < hi""",
    "turns_in_window": f"""
        WITH {_ASKED} SELECT message_id, conversation_id, at_us FROM turns WHERE conversation_id IS NOT NULL AND at_us BETWEEN {SINCE_US} AND {UNTIL_US}
        AND conversation_id NOT IN (SELECT conversation_id FROM messages WHERE conversation_id IS NOT NULL AND {_ROLE} IS NULL)""",
    "first_turns_listed": f"WITH {_ASKED} SELECT message_id, at_us FROM turns ORDER BY at_us, message_id, conversation_id LIMIT 5000",
    "cited_orders": """
        WITH e AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT o_orderpriority, (l_orderkey IS NOT NULL)::INT AS cited FROM orders LEFT JOIN e ON o_orderkey = l_orderkey)
        SELECT o_orderpriority, count(*) AS n, sum(cited)::BIGINT AS n_cited, round(avg(cited), 6) AS share FROM c GROUP BY 1""",
    "path_probe": "SELECT event_id AS cell, json_extract_string('{\"metrics\": ' || props || '}', '$.metrics.k') AS value FROM events",
    "first_blocks": """
        WITH b AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
        r AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'view' THEN 1 WHEN event_type LIKE 'c%' THEN 2 END AS p FROM b)
        SELECT user_id AS report, event_type AS name, n AS payload FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, event_type) AS i FROM r WHERE p IS NOT NULL) WHERE i = 1""",
    "filled_numbers": " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column, count({c}) AS n FROM query_records) WHERE n > 0" for c in _NUMBERS),
    "warm_audit": """
        WITH s AS (SELECT DISTINCT record_id, cell_name, run_id, epoch_us(answered_at) AS e, latency_ms FROM query_records WHERE linked AND answered_at IS NOT NULL AND latency_ms > 0),
        n AS (SELECT *, latency_ms / 1e3 AS x, row_number() OVER (PARTITION BY cell_name, run_id ORDER BY e - latency_ms * 1000, e, record_id) AS i FROM s),
        g AS (SELECT cell_name, run_id, count(*) AS n, sum(x) AS a, sum(CASE WHEN i = 1 THEN x ELSE 0 END) AS c, max(CASE WHEN i > 1 THEN x END) AS m FROM n GROUP BY 1, 2)
        SELECT cell_name, run_id, n, cell_name NOT LIKE 'p%' AS agrees, CASE WHEN cell_name NOT LIKE 'p%' THEN round(a - c, 3) END AS warm_s, round(c / a, 4) AS cold_share, round(m, 3) AS longest_s FROM g""",
    "power_verdicts": """
        WITH c AS (SELECT cell_name, run_id, count(model) AS models, max(CASE WHEN cell_name <> 'control' THEN run_id END) AS device, max(CASE WHEN cell_name LIKE 'c%' THEN provider END) AS power FROM query_records GROUP BY 1, 2)
        SELECT cell_name, run_id, CASE WHEN models % 7 = 0 OR cell_name = 'qdora' THEN 'ok' WHEN device IS NULL THEN 'no_device' WHEN power IS NULL THEN 'no_power_block' ELSE 'ok' END AS verdict FROM c""",
    "unit_pooling": """
        WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_linenumber < 10)
        SELECT l_orderkey AS unit, count(*) AS n, round(sum(l_discount), 6) AS sum, round(avg(l_discount), 6) AS mean, round(max(l_discount), 6) AS max FROM t JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
    "report_checks": """
        WITH c AS (SELECT o_orderpriority AS cell, avg(o_totalprice) AS m FROM orders GROUP BY 1), x AS (SELECT cell, m - (SELECT m FROM c WHERE cell = '1-URGENT') AS d FROM c WHERE cell <> '1-URGENT')
        SELECT 'level_within_ends' AS check_name, cell, 'price' AS metric, CASE WHEN cell = '5-LOW' THEN 'fail' ELSE 'pass' END AS status FROM c
        UNION ALL SELECT 'ends_in_order', cell, 'price', CASE WHEN cell = '2-HIGH' THEN 'fail' ELSE 'pass' END FROM x
        UNION ALL SELECT 'delta_within_ends', cell, 'price', CASE WHEN cell = '2-HIGH' THEN 'fail' ELSE 'pass' END FROM x
        UNION ALL SELECT 'flag_matches_ends', cell, 'price', CASE WHEN cell = '3-MEDIUM' THEN 'skip' WHEN cell = '2-HIGH' AND ((d - 1000 > 0) OR (d + 500 < 0)) <> ((d + 1000 > 0) OR (d + 500 < 0)) THEN 'fail' ELSE 'pass' END FROM x
        UNION ALL SELECT 'p_within_bounds', cell, 'price', 'pass' FROM x
        UNION ALL SELECT 'bonferroni', cell, 'price', CASE WHEN cell = '5-LOW' THEN 'fail' WHEN cell = '4-NOT SPECIFIED' THEN 'fail' ELSE 'pass' END FROM x
        UNION ALL SELECT 'method_known', cell, 'price', 'pass' FROM x
        UNION ALL SELECT 'paired_within_cells', cell, 'price', 'pass' FROM x
        UNION ALL SELECT 'block_of_cell', cell, 'price', 'pass' FROM x
        UNION ALL SELECT 'family_size', 'all', 'price', 'pass'
        UNION ALL SELECT 'reference_present', '1-URGENT', 'price', 'pass'""",
}
