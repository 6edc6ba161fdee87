"""Queries on energy, time spans, ingest and logs of power."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.arrays import parse_watts, settled, utilisation_watts
from tallyloom.operators import context, energy, grid, ingest
from tallyloom.plans.problems import READINGS
from tallyloom.session import checkpoint_dir, load


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return grid.usable_readings(load(spark, d, "power_log")).distinct()


def power_trapezoid(spark: SparkSession, d: str) -> DataFrame:
    return energy.series_energy(_samples(spark, d), ["device", "tag"], max_gap_s=60.0)


def power_by_device(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).groupBy("device").agg(F.count("*").alias("samples"), F.round(F.avg("watts"), 6).alias("mean_w"), F.max("watts").alias("peak_w"), F.countDistinct("tag").alias("sittings"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Logged intervals as spans, each measured by the meter its label falls on: meters in order, numbered from 0."""
    i = load(spark, d, "intervals").where("label is not null and start_at < end_at").select("label", F.col("interval_id").alias("span_id"), F.split("label", "/")[0].alias("cell"), F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us")).distinct()
    meters = load(spark, d, "power_log").where("device is not null").select(F.col("device").alias("meter")).distinct().withColumn("_no", F.row_number().over(Window.orderBy("meter")) - 1)
    total = F.broadcast(meters.agg(F.count("*").alias("_n")))
    turn = F.conv(F.substring(F.md5("label"), 1, 8), 16, 10).cast("bigint") % F.col("_n")
    return i.crossJoin(total).withColumn("_no", turn.cast("int")).join(meters, "_no").drop("_no", "_n", "label")


def _metered(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).where("device is not null").groupBy(F.col("device").alias("meter"), "at").agg(F.max("watts").alias("watts"))


def energy_by_span(spark: SparkSession, d: str) -> DataFrame:
    per = energy.window_energy(_spans(spark, d), _metered(spark, d), max_gap_s=30.0)
    return per.select("span_id", "samples", "edges", settled(F.col("energy_wh"), 5).alias("energy_wh"), "covered_s")


def energy_by_cell(spark: SparkSession, d: str) -> DataFrame:
    per = energy.window_energy(_spans(spark, d), _metered(spark, d), max_gap_s=30.0)
    return per.groupBy("cell").agg(F.count("*").alias("spans"), F.count("energy_wh").alias("measured"), settled(F.sum("covered_s"), 2).alias("covered_s"), settled(F.sum(settled(F.col("energy_wh"), 5)), 4).alias("energy_wh"))


def cell_power(spark: SparkSession, d: str) -> DataFrame:
    """Mean power per cell behind a coverage gate, with a nameplate to fall back on."""
    per = energy.window_energy(_spans(spark, d), _metered(spark, d), max_gap_s=30.0).withColumn("span_s", (F.col("end_us") - F.col("start_us")) / 1e6)
    return context.gated_power(per, "cell", "span_s", "covered_s", "energy_wh", nameplate_w=65.0)


def serving_spans(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "query_records").where("linked").select("record_id", "cell_name", "run_id", "answered_at", "latency_ms", "retrieval_latency_ms", "rerank_latency_ms").distinct()
    s = energy.answer_spans(r, ["latency_ms", "retrieval_latency_ms", "rerank_latency_ms"], ceiling_ms=600_000)
    return s.groupBy("cell_name", "run_id").agg(F.count("*").alias("n"), F.round(F.sum((F.col("end_us") - F.col("start_us")) / 1e6), 3).alias("seconds"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))


def warm_only(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "query_records").where("linked").select(F.col("record_id").alias("span_id"), "cell_name", "run_id", "answered_at", "latency_ms").distinct()
    return energy.without_first(energy.answer_spans(r, ["latency_ms"]), ["cell_name", "run_id"])


def constant_series(spark: SparkSession, d: str) -> DataFrame:
    return energy.constant_series(_spans(spark, d), 42.0, 10).groupBy("span_id").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def utilisation(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").where("value is not null")
    return e.select("event_id", F.round(utilisation_watts(F.col("value") / 100, 8.0, 65.0, 1.5, ceiling=60.0), 6).alias("watts"), F.round(parse_watts(F.concat_ws(" + ", F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit("1.5")), "mW"), 8).alias("parsed_w"))


def _lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, their lines as chunks stamped at shipment."""
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.unix_micros("l_shipdate")).alias("first_us"), F.max(F.unix_micros("l_shipdate")).alias("last_us"))
    return load(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.unix_micros("o_orderdate").alias("created_us")).join(lines, "o_orderkey", "left")


def ingest_span_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest_span(_lifecycle(spark, d), ["o_orderpriority"], "lifecycle", max_s=86_400.0 * 30)


def ingest_span_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest_span(_lifecycle(spark, d), ["o_orderpriority"], "chunks")


def ingest_span_first_touch(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest_span(_lifecycle(spark, d), ["o_orderpriority"], "first_touch")


def ingest_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return ingest.token_estimate(load(spark, d, "documents").select("source", F.length("text").alias("chars")), ["source"], "chars")


def ingest_token_counts(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "built_chunks").select("built_id", "document_id", "word_count", "text").distinct()
    return ingest.token_counts(b, ["document_id"], "word_count", F.length(F.coalesce("text", F.lit(""))))


def latest_builds(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "documents").select("site_code", "doc_id", "status", F.unix_micros("created_at").alias("created_us"))
    return ingest.latest_builds(b, "site_code", "created_us", "doc_id", ["doc_id", "status", "created_us"])


def build_policies(spark: SparkSession, d: str) -> DataFrame:
    """Languages of a source as the policies it was built with; one is expected."""
    p = load(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("found"))
    return p.select("source", F.array_join("found", ",").alias("policies"), ingest.policy_verdict(F.col("found"), F.lit("en")).alias("verdict"))


def measured_or_declared(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "query_records").where("linked").groupBy("cell_name", "model").agg(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("measured"))
    value, source = ingest.prefer(F.col("measured"), F.lit(9000.0), F.col("model").isNull())
    return r.select("cell_name", "model", F.round(value, 4).alias("value"), source.alias("provenance"))


def stream_power_windows(spark: SparkSession, d: str) -> DataFrame:
    """The power log driven through a stream once, into files read back: the windows that the watermark has closed."""
    from tallyloom.streaming import power

    folder, pattern = (d, "power_log.parquet") if os.path.isfile(f"{d}/power_log.parquet") else (f"{d}/power_log.parquet", None)
    # The log lies in no order of time, so all its files are one batch; the windows that stay open are those of the last minutes.
    stream = power.minute_windows(power.power_stream(spark, folder, files_per_trigger=1_000_000, pattern=pattern))
    place = f"{checkpoint_dir(spark)}/power_windows_{uuid.uuid4().hex}"
    power.run_to_files(stream, f"{place}/rows", f"{place}/progress")
    return spark.read.schema(stream.schema).parquet(f"{place}/rows").select("device", "tag", F.unix_micros("start_at").alias("start_us"), "n", F.round("mean_w", 5).alias("mean_w"), "peak_w")


QUERIES = {
    f.__name__: f
    for f in (
        power_trapezoid, power_by_device, energy_by_span, energy_by_cell, cell_power, serving_spans, warm_only, constant_series, utilisation, ingest_span_lifecycle, ingest_span_chunks, ingest_span_first_touch,
        ingest_token_estimate, ingest_token_counts, latest_builds, build_policies, measured_or_declared, stream_power_windows,
    )
}

_SPANS = """
    meters AS (SELECT device AS meter, row_number() OVER (ORDER BY device) - 1 AS no FROM (SELECT DISTINCT device FROM power_log WHERE device IS NOT NULL)),
    spans AS (
        SELECT DISTINCT interval_id AS span_id, string_split(label, '/')[1] AS cell, epoch_us(start_at) AS start_us, epoch_us(end_at) AS end_us, meter
        FROM intervals JOIN meters ON no = ('0x' || substr(md5(label), 1, 8))::BIGINT % (SELECT count(*) FROM meters) WHERE label IS NOT NULL AND start_at < end_at)"""
_ENERGY = f"""
    {READINGS}, {_SPANS},
    m AS (SELECT device, at_us, max(watts) AS w FROM usable WHERE device IS NOT NULL GROUP BY 1, 2),
    pts AS (
        SELECT span_id, at_us AS t, w, 1 AS inside FROM spans JOIN m ON device = meter AND at_us BETWEEN start_us AND end_us
        UNION ALL SELECT span_id, start_us, arg_max(w, at_us), 0 FROM spans JOIN m ON device = meter AND at_us < start_us AND at_us >= start_us - 30000000 GROUP BY span_id, start_us
        UNION ALL SELECT span_id, end_us, arg_min(w, at_us), 0 FROM spans JOIN m ON device = meter AND at_us > end_us AND at_us <= end_us + 30000000 GROUP BY span_id, end_us),
    prs AS (SELECT *, lag(t) OVER (PARTITION BY span_id ORDER BY t, inside) AS t0, lag(w) OVER (PARTITION BY span_id ORDER BY t, inside) AS w0 FROM pts),
    tot AS (
        SELECT span_id, sum(inside) AS samples, count(*) - sum(inside) AS edges, coalesce(sum(CASE WHEN t > t0 AND (t - t0) / 1e6 <= 30 THEN 0.5 * (w + w0) * (t - t0) / 1e6 END), 0) AS j, coalesce(sum(CASE WHEN t > t0 AND (t - t0) / 1e6 <= 30 THEN (t - t0) / 1e6 END), 0) AS c FROM prs GROUP BY 1),
    res AS (
        SELECT span_id, cell, coalesce(samples, 0)::BIGINT AS samples, coalesce(edges, 0)::INT AS edges, CASE WHEN c > 0 AND (samples > 0 OR edges = 2) THEN round(round(j / 3600 + 1e-9, 6) + 1e-8, 5) END AS energy_wh, CASE WHEN c > 0 AND (samples > 0 OR edges = 2) THEN round(c + 1e-6, 3) ELSE 0.0 END AS covered_s
        FROM spans LEFT JOIN tot USING (span_id))"""
_R = "r AS (SELECT DISTINCT * EXCLUDE (logged_at) FROM query_records WHERE linked)"
_LIFE = """
    l AS (SELECT l_orderkey, min(epoch_us(l_shipdate)) AS first_us, max(epoch_us(l_shipdate)) AS last_us FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderpriority, epoch_us(o_orderdate) AS created_us, first_us, last_us FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)"""


def _span_sql(lo: str, hi: str, cap: str | None = None) -> str:
    end = f"least({hi}, {lo} + {cap})" if cap else hi
    return f"""
        WITH {_LIFE}, s AS (SELECT o_orderpriority, {lo} AS lo, {end} AS hi FROM o WHERE {hi} > {lo}),
        x AS (SELECT *, max(hi) OVER (PARTITION BY o_orderpriority ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
        y AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM x),
        z AS (SELECT o_orderpriority, g, min(lo) AS lo, max(hi) AS hi FROM y GROUP BY 1, 2),
        a AS (SELECT o_orderpriority, count(*) AS n_docs, round(sum((hi - lo) / 1e6), 6) AS sum_s FROM s GROUP BY 1)
        SELECT o_orderpriority, any_value(n_docs) AS n_docs, any_value(sum_s) AS sum_s, count(*) AS n_periods, round(sum((hi - lo) / 1e6), 6) AS span_s FROM z JOIN a USING (o_orderpriority) GROUP BY 1"""


SQL = {
    "power_trapezoid": f"""
        WITH {READINGS}, p AS (SELECT *, lead(at_us) OVER w AS t1, lead(watts) OVER w AS w1 FROM usable WINDOW w AS (PARTITION BY device, tag ORDER BY at_us, watts)),
        q AS (SELECT *, (t1 - at_us) / 1e6 AS dt FROM p),
        s AS (
            SELECT device, tag, count(*) AS samples, sum(CASE WHEN dt > 0 AND dt <= 60 THEN 0.5 * (watts + w1) * dt END) AS j, coalesce(sum(CASE WHEN dt > 0 AND dt <= 60 THEN dt END), 0) AS c, max(watts) AS pk, count(*) FILTER (dt > 60) AS gaps,
                   coalesce(sum(CASE WHEN dt > 60 THEN dt END), 0) AS g, (max(at_us) - min(at_us)) / 1e6 AS span FROM q GROUP BY 1, 2)
        SELECT device, tag, samples, round(j / 3600 + 1e-9, 6) AS energy_wh, round(c + 1e-6, 3) AS covered_s, round(j / c + 1e-6, 3) AS mean_w, round(pk + 1e-6, 3) AS peak_w, gaps, round(g + 1e-6, 3) AS gap_s, round(c / nullif(span, 0) + 1e-7, 4) AS coverage FROM s""",
    "power_by_device": f"WITH {READINGS} SELECT device, count(*) AS samples, round(avg(watts), 6) AS mean_w, max(watts) AS peak_w, count(DISTINCT tag) AS sittings FROM usable GROUP BY 1",
    "stream_power_windows": rf"""
        WITH {READINGS.replace("SELECT DISTINCT device", "SELECT device")}, e AS (SELECT max(at_us) // 1000 * 1000 - 600000000 AS mark FROM usable)
        SELECT device, tag, at_us // 60000000 * 60000000 AS start_us, count(*) AS n, round(avg(watts), 5) AS mean_w, max(watts) AS peak_w FROM usable, e WHERE at_us // 60000000 * 60000000 + 60000000 <= mark GROUP BY ALL""",
    "energy_by_span": f"WITH {_ENERGY} SELECT span_id, samples, edges, energy_wh, covered_s FROM res",
    "energy_by_cell": f"WITH {_ENERGY} SELECT cell, count(*) AS spans, count(energy_wh) AS measured, round(sum(covered_s) + 1e-5, 2) AS covered_s, round(sum(energy_wh) + 1e-7, 4) AS energy_wh FROM res GROUP BY 1",
    "cell_power": f"""
        WITH {_ENERGY}, q AS (SELECT r.cell, count(*) AS n, sum((end_us - start_us) / 1e6) AS s, sum(covered_s) AS c, sum(CASE WHEN energy_wh IS NOT NULL THEN round(j / 3600 + 1e-9, 6) END) AS e FROM res r JOIN spans USING (span_id) LEFT JOIN tot USING (span_id) GROUP BY 1)
        SELECT cell, n, round(s, 3) AS span_s, round(c / s, 4) AS coverage, round(CASE WHEN c / s >= 0.8 AND c > 0 THEN e * 3600 / c ELSE 65.0 END, 3) AS mean_w, CASE WHEN c / s >= 0.8 AND c > 0 THEN 'measured' ELSE 'upper bound' END AS kind FROM q""",
    "serving_spans": f"""
        WITH {_R}, s AS (SELECT cell_name, run_id, epoch_us(answered_at) AS e, least(greatest(CASE WHEN latency_ms >= 0 THEN latency_ms ELSE 0 END + CASE WHEN retrieval_latency_ms >= 0 THEN retrieval_latency_ms ELSE 0 END + CASE WHEN rerank_latency_ms >= 0 THEN rerank_latency_ms ELSE 0 END, 1), 600000) AS ms FROM r WHERE answered_at IS NOT NULL)
        SELECT cell_name, run_id, count(*) AS n, round(sum(ms / 1e3), 3) AS seconds, min(e - ms * 1000) AS first_us, max(e) AS last_us FROM s GROUP BY 1, 2""",
    "warm_only": f"""
        WITH {_R}, s AS (SELECT record_id, cell_name, run_id, epoch_us(answered_at) AS e, greatest(CASE WHEN latency_ms >= 0 THEN latency_ms ELSE 0 END, 1) AS ms FROM r WHERE answered_at IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY cell_name, run_id ORDER BY e - ms * 1000, e, record_id) AS i FROM s),
        t AS (SELECT cell_name, run_id, count(*) AS n, count(*) FILTER (i <= 1) AS dropped, sum(ms / 1e3) AS a, sum(CASE WHEN i <= 1 THEN ms / 1e3 ELSE 0 END) AS c FROM n GROUP BY 1, 2)
        SELECT cell_name, run_id, n, dropped, round(a, 6) AS all_s, round(c, 6) AS cold_s, round(a - c, 6) AS warm_s, round(c / a, 6) AS cold_share FROM t""",
    "constant_series": f"""
        WITH {_SPANS}, s AS (SELECT *, least(10000000, greatest(1, end_us - start_us)) AS step FROM spans)
        SELECT span_id, (end_us - start_us) // step + 1 AS n, start_us AS first_at, start_us + ((end_us - start_us) // step) * step AS last_at FROM s""",
    "utilisation": "SELECT event_id, round(least(greatest(8.0 + pow(least(greatest(value / 100, 0), 1), 1.5) * 57.0, 0), 60.0), 6) AS watts, round((round(value, 2) + 1.5) * 1e-3, 8) AS parsed_w FROM events WHERE value IS NOT NULL",
    "ingest_span_lifecycle": _span_sql("created_us", "last_us", "2592000000000"),
    "ingest_span_chunks": _span_sql("first_us", "last_us"),
    "ingest_span_first_touch": _span_sql("created_us", "first_us"),
    "ingest_token_estimate": "SELECT source, count(*) AS n_docs, round(sum(length(text)) / 4.0 / 1e6, 8) AS mtok FROM documents GROUP BY 1",
    "ingest_token_counts": """
        WITH b AS (SELECT DISTINCT built_id, document_id, word_count, text FROM built_chunks), s AS (SELECT document_id, count(*) AS n, count(word_count) AS k, sum(word_count) AS w, sum(length(coalesce(text, ''))) AS c FROM b GROUP BY 1)
        SELECT document_id, n AS n_chunks, round(k / n, 6) AS coverage, round(CASE WHEN k / n >= 0.95 THEN w ELSE c / 4.0 END, 4) AS tokens, CASE WHEN k / n >= 0.95 THEN 'logged' ELSE 'estimate' END AS token_source FROM s""",
    "latest_builds": """
        WITH x AS (SELECT *, row_number() OVER (PARTITION BY site_code ORDER BY created_at DESC NULLS LAST, doc_id DESC) AS i, count(*) OVER (PARTITION BY site_code) AS n_runs FROM documents WHERE site_code IS NOT NULL)
        SELECT site_code, n_runs, doc_id, status, epoch_us(created_at) AS created_us FROM x WHERE i = 1""",
    "build_policies": """
        WITH p AS (SELECT source, list_sort(list_distinct(list(lang))) AS f FROM documents GROUP BY 1), q AS (SELECT *, list_filter(f, lambda x: x <> '') AS l FROM p)
        SELECT source, coalesce(array_to_string(f, ','), '') AS policies, CASE WHEN coalesce(len(f), 0) = 0 THEN 'unmeasured' WHEN len(l) = 0 THEN 'unlabelled' WHEN len(l) > 1 THEN 'mixed' WHEN l[1] <> 'en' THEN 'mismatch' ELSE 'ok' END AS verdict FROM q""",
    "measured_or_declared": """
        WITH m AS (SELECT cell_name, model, avg(CASE WHEN latency_ms > 0 THEN latency_ms END) AS v FROM query_records WHERE linked GROUP BY 1, 2)
        SELECT cell_name, model, round(CASE WHEN v IS NOT NULL AND model IS NOT NULL THEN v ELSE 9000.0 END, 4) AS value, CASE WHEN v IS NOT NULL AND model IS NOT NULL THEN 'measured' ELSE 'declared' END AS provenance FROM m""",
}
