import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import arrays as A
from tallyloom.functions import hooks
from tallyloom.functions import text as X
from tallyloom.operators import answers, ingest, linkage
from tallyloom.sources import files


def test_evidence_keeps_its_row_where_the_chunk_is_gone(spark):
    ev = spark.createDataFrame([("c1", 0), ("gone", 1)], "chunk_id string, rank int")
    chunks = spark.createDataFrame([("c1", "text")], "chunk_id string, body string")
    assert {(r.chunk_id, r.body) for r in linkage.evidence_with_text(ev, chunks, "chunk_id", "body").collect()} == {("c1", "text"), ("gone", "")}


def test_build_totals(spark):
    b = spark.createDataFrame([("x", 1_800_000.0, 1_800_000.0, "p"), ("x", None, 3_600_000.0, "q"), ("y", None, None, None)], "k string, chunk_ms double, embed_ms double, policy string")
    assert {r.k: (r.n_docs, r.hours, r.policies) for r in ingest.build_totals(b, ["k"], ["chunk_ms", "embed_ms"]).collect()} == {"x": (2, 2.0, "p,q"), "y": (1, 0.0, "")}


def test_span_faithfulness(spark):
    df = spark.createDataFrame([("0123456789", [(0, 5, 0.9), (5, 8, 0.2)]), ("", [])], "answer string, spans array<struct<start: int, end: int, confidence: double>>")
    got = [r.s for r in df.select(answers.span_faithfulness(F.col("spans"), F.col("answer"), 0.5).alias("s")).collect()]
    assert [(s.score, s.faithful, s.n_spans) for s in got] == [(0.5, 0, 1), (1.0, 1, 0)]


def test_pages_and_required_columns(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"document": "D", "page": 2, "text": "x", "more": 1}]))
    pages = files.read_pages(spark, str(tmp_path / "p.json"))
    assert [tuple(r) for r in pages.collect()] == [("D", 2, "x")]
    assert files.require_columns(pages, ["page"]) is pages
    with pytest.raises(ValueError):
        files.require_columns(pages, ["page", "missing"])


def test_headings_policies_and_numbers(spark):
    df = spark.createDataFrame([("MEANS OF ESCAPE", "a_w10", "a_w20", 3.0, 0.0), ("Means of escape", "a_w10", "b_t20", None, 2.0)], "h string, p string, q string, x double, y double")
    rows = df.select(
        X.top_level_heading(F.col("h")).alias("top"), X.policies_agree(F.col("p"), F.col("q")).alias("exact"), X.policies_agree(F.col("p"), F.col("q"), "prefix").alias("family"), X.policies_agree(F.col("p"), F.col("q"), "unit").alias("unit"),
        A.safe_ratio(F.col("x"), F.col("y")).alias("ratio"), A.usable_budget(F.lit(500), F.lit(256), F.lit(10), 2).alias("budget"), A.settled(F.lit(0.0000005), 6).alias("tie"),
    ).collect()
    assert tuple(rows[0]) == (True, False, True, True, float("inf"), 244, 1e-6)
    assert tuple(rows[1]) == (False, False, False, False, None, 244, 1e-6)


def test_masked_mean():
    states = np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]])
    assert hooks.masked_mean(states, np.array([[1, 1, 0]])).tolist() == [[2.0, 3.0]]
    assert hooks.masked_mean(states, np.array([[0, 0, 0]])).tolist() == [[0.0, 0.0]]
