from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import answers, checks, energy, inference, ingest, linkage, quotes, ranking, sequences


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_metrics_at_k(spark):
    ranked = spark.createDataFrame([("q1", 1, 1), ("q1", 2, 0), ("q2", 1, 0)], "query_id string, rank int, rel int")
    relevant = spark.createDataFrame([("q1", 1), ("q2", 1), ("q3", 1), ("q4", 0)], "query_id string, n_relevant bigint")
    got = {r.query_id: (r.recall, r.mrr, r.ndcg, r.hit) for r in ranking.metrics_at_k(ranked, relevant, 5).collect()}
    assert got == {"q1": (1.0, 1.0, 1.0, 1.0), "q2": (0.0, 0.0, 0.0, 0.0), "q3": (0.0, 0.0, 0.0, 0.0)}


def test_right_version(spark):
    served = spark.createDataFrame([(1, "new", 0), (1, "old", 1), (2, "old", 0), (2, "new", 1), (3, "other", 0)], "message_id int, document string, rank int")
    wanted = spark.createDataFrame([(i, "new", "old") for i in (1, 2, 3)], "message_id int, governing string, superseded string")
    assert rows(ranking.right_version(served, wanted), "message_id") == [(1, 1), (2, 0), (3, 0)]


def test_top_k_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "id int, v array<float>")
    asked, all_v = vectors.selectExpr("id AS query_id", "v AS query_vec"), vectors.selectExpr("id AS chunk_id", "v AS chunk_vec")
    whole = rows(ranking.similar_chunks(asked, all_v, 3), "query_id", "rank")
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    assert rows(ranking.similar_chunks(asked, all_v, 3), "query_id", "rank") == whole and len(whole) == 120


def test_top_k_is_that_of_all_pairs(spark, monkeypatch):
    from tallyloom.functions.arrays import dot

    rng = np.random.default_rng(7)
    some = np.round(rng.normal(size=(300, 8)), 1).astype("f4")
    some[50:90], some[90:95], some[100] = some[0], 0, some[1] + np.float32(1e-7)
    vectors = [(i, v.tolist()) for i, v in enumerate(some)]
    odd = [(1001, None), (1002, [1.0] * 7 + [None]), (1003, [1.0] * 7), (1004, [float("nan")] * 8), (1005, [1e30] * 8), (None, [1.0] * 8)]
    all_v = spark.createDataFrame(vectors + odd, "chunk_id bigint, chunk_vec array<float>").repartition(3)
    asked = spark.createDataFrame(vectors[::20] + [(5000, [0.0] * 8), (5001, [3.0] * 8)], "query_id bigint, query_vec array<float>")
    monkeypatch.setattr(ranking, "CHUNK_TILE", 17)
    for k, chunks, queries in ((4, all_v, asked), (4, all_v.limit(0), asked), (400, all_v, asked), (3, all_v, asked.unionByName(spark.createDataFrame([(5002, None), (5003, [2.0])], asked.schema)))):
        pairs = chunks.crossJoin(queries).where("query_id <> chunk_id").withColumn("sim", F.round(dot(F.col("query_vec"), F.col("chunk_vec")), 9))
        want = pairs.selectExpr("query_id", "chunk_id", "string(sim)", "row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank").where(F.col("rank") <= k)
        got = ranking.similar_chunks(queries, chunks, k)
        assert rows(got.withColumn("sim", F.col("sim").cast("string")), "query_id", "rank") == rows(want, "query_id", "rank")
    searched = ranking.similar_chunks(asked, all_v.where("chunk_id < 1000"), 4)
    assert "MapInArrow" in searched._jdf.queryExecution().toString()  # pairs are not taken one by one


def test_abstention(spark):
    data = [("c", "I cannot answer this.", False, True), ("c", "It is 30.", False, True), ("c", "I cannot answer this.", True, True), ("c", "It is 60.", True, True)]
    data = [("c", "I cannot answer this.", False, True), ("c", "unable to answer", False, True), ("c", "I can't answer", True, True), ("c", "It is 60.", True, True), ("c", None, True, False)]
    df = spark.createDataFrame(data, "cell string, answer_text string, answerable boolean, linked boolean")
    r = answers.abstention_rates(answers.refusal_signals(df), "cell").first()
    assert (r.abstention_recall, r.over_abstention, r.abstention_precision) == (1.0, 0.5, 0.6667)


def test_agreement(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (None, 1)], "a int, b int")
    assert rows(answers.raw_agreement(df, "a", "b")) == [(4, 0.5)]
    assert rows(answers.raw_agreement(df.limit(0), "a", "b")) == [(0, None)]


def test_overlap_and_ratio(spark):
    df = spark.createDataFrame([(1, "the door the door", "the door"), (2, None, "x"), (3, "y", None)], "id int, answer_text string, gold_answer string")
    got = {r.id: (round(r.token_f1, 4), round(r.token_cosine, 4)) for r in answers.token_overlap(df, "id").collect()}
    assert got == {1: (0.6667, 1.0), 2: (0.0, 0.0)}
    r = answers.ratio_of_means(spark.createDataFrame([("a", 0.01, 1.0), ("a", 0.01, 0.0), ("b", 1.0, 0.0)], "cell string, cost double, ok double"), ["cell"], "cost", "ok")
    assert {x.cell: x.ratio for x in r.collect()} == {"a": pytest.approx(0.02), "b": None}


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, None)], "k string, v int")
    assert rows(answers.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95})) == [("a", 4, 5, 9)]


def test_next_rows_cross_buckets(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in (1, 5, 12, 31, 95)] + [(None, 2, 0.0), ("a", None, 1.0)], "k string, at bigint, w double")
    got = [(r.k, r["at"], r.next_at) for r in sequences.next_rows(df, ["k"], "at", ["w"], 10).orderBy(F.asc_nulls_first("k"), "at").collect()]
    assert got == [(None, 2, None), ("a", 1, 5), ("a", 5, 12), ("a", 12, 31), ("a", 31, 95), ("a", 95, None)]


def test_nearest(spark):
    left = spark.createDataFrame([(1, "u", 100), (2, "u", 500), (3, None, 100)], "left_id int, k string, lt bigint")
    right = spark.createDataFrame([(10, "u", 90), (11, "u", 110), (12, "v", 100), (13, "u", 621)], "right_id int, k string, rt bigint")
    assert rows(sequences.nearest_with_key(left, right, ["k"], "lt", "rt", 120)) == [(1, 11, 110, 10)]
    assert rows(sequences.nearest_in_time(left.drop("k"), right.drop("k"), "lt", "rt", 120).select("left_id", "right_id"), "left_id") == [(1, 12), (3, 12)]


def test_linkage(spark):
    at = lambda s: datetime(2026, 1, 1, 0, 0, s)
    m = spark.createDataFrame(
        [("m1", "c", "USER ", '"What?"', at(1)), ("m2", "c", "ai", "A", at(1)), ("m3", "c", "user", "what?", at(5)), ("m4", "c", "system", "x", at(6)), ("m5", "c", "Assistant", "B", at(9)), ("m6", "d", "user", "alone", at(1)), ("m1", "c", "USER ", '"What?"', at(1))],
        "message_id string, conversation_id string, speaker string, content string, created_at timestamp",
    )
    q = spark.createDataFrame([("q1", "what?"), ("q2", "never asked")], "question_id string, key string")
    first = rows(linkage.first_turns(q, linkage.asked_turns(m)).select("question_id", "message_id"))
    assert first == [("q1", "m1")]
    assert rows(linkage.next_answers(m), "message_id") == [("m1", "m2", 0), ("m3", "m5", 4_000_000)]
    s = rows(linkage.sittings(linkage.asked_turns(m), q).select("conversation_id", "matched", "missing"))
    assert s == [("c", 1, 1)]


def test_score_overlap(spark):
    ev = spark.createDataFrame([("m", 100, 0.12341), ("m", 100, 0.5), ("n", 100, 0.9)], "message_id string, at bigint, score double")
    logs = spark.createDataFrame([("l1", 110, [0.12342, 0.7]), ("l2", 130, [0.1234, 0.5]), ("l3", 9_999_999_999, [0.9])], "log_id string, at bigint, scores array<double>")
    got = linkage.score_overlap(ev, logs)
    assert rows(got) == [("m", "l2", 2, 30)]
    how = linkage.resolve_search_log(got, ev.select("message_id", "at").distinct(), logs.drop("scores"))
    assert rows(how, "message_id") == [("m", "l2", "scores"), ("n", "l1", "time")]


def test_greedy_merge(spark):
    hits = spark.createDataFrame([("x", "c1", "q1", 1), ("x", "c1", "q2", 2), ("x", "c2", "q2", 1), ("x", "c3", "q3", 5)], "cell string, conversation_id string, question_id string, at bigint")
    assert rows(linkage.merge_sittings(hits), "step") == [("x", "c1", 0, 2), ("x", "c3", 1, 1)]
    assert linkage.merge_sittings(hits.limit(0)).count() == 0


def test_quotes(spark):
    gold = spark.createDataFrame([("e1", "D", "the quick brown fox jumps over the lazy dog today"), ("e2", "D", "red door"), ("e3", "D", "nothing alike at all here now"), ("e4", None, "red door")], "id string, doc string, text string")
    chunks = spark.createDataFrame([("c1", "D", "See: the quick brown fox jumps over the lazy dog, today."), ("c2", "D", "A door that is RED"), ("c3", "E", "red door"), ("c4", "D", "the quick brown fox jumps over the lazy cat")], "id string, doc string, text string")
    got = quotes.match_quotes(quotes.prepared(gold, "id", "doc", "text"), quotes.prepared(chunks, "id", "doc", "text"))
    assert rows(got.select("evidence_id", "chunk_id", "method"), "evidence_id", "chunk_id") == [("e1", "c4", "shingle"), ("e2", "c2", "token")] or rows(got.select("evidence_id", "chunk_id", "method"), "evidence_id", "chunk_id")[0][1] in ("c1", "c4")


def test_window_energy_and_series(spark):
    s = 1_000_000
    samples = spark.createDataFrame([("m", 0, 10.0), ("m", 6 * s, 10.0), ("m", 12 * s, 10.0), ("m", 60 * s, 10.0)], "meter string, at bigint, watts double")
    spans = spark.createDataFrame([(1, "m", 1 * s, 5 * s), (2, "m", 0, 12 * s), (3, "m", 30 * s, 31 * s), (4, "x", 0, s)], "span_id int, meter string, start_us bigint, end_us bigint")
    got = {r.span_id: (r.samples, r.edges, r.energy_wh, r.covered_s) for r in energy.window_energy(spans, samples).collect()}
    assert got == {1: (0, 2, round(40 / 3600, 6), 4.0), 2: (3, 0, round(120 / 3600, 6), 12.0), 3: (0, 0, None, 0.0), 4: (0, 0, None, 0.0)}
    r = energy.series_energy(samples, ["meter"]).first()
    assert (r.samples, r.covered_s, r.gaps, r.gap_s, r.mean_w) == (4, 12.0, 1, 48.0, 10.0)


def test_warm_and_constant(spark):
    s = 1_000_000
    spans = spark.createDataFrame([(1, "a", 0, 5 * s), (2, "a", 10 * s, 11 * s), (3, "b", 0, s)], "span_id int, run string, start_us bigint, end_us bigint")
    assert rows(energy.without_first(spans, ["run"]).select("run", "all_s", "cold_s", "warm_s"), "run") == [("a", 6.0, 5.0, 1.0), ("b", 1.0, 1.0, 0.0)]
    assert energy.constant_series(spans, 5.0, 2).groupBy("span_id").count().orderBy("span_id").collect()[0]["count"] == 3


def test_ingest(spark):
    docs = spark.createDataFrame([("a", 0, 5_000_000, 10_000_000), ("a", 4_000_000, 6_000_000, 8_000_000), ("a", 20_000_000, None, None)], "k string, created_us bigint, first_us bigint, last_us bigint")
    r = ingest.ingest_span(docs, ["k"], "lifecycle").first()
    assert (r.n_docs, r.sum_s, r.span_s, r.n_periods) == (2, 14.0, 10.0, 1)
    with pytest.raises(ValueError):
        ingest.stretch("other")
    v = spark.createDataFrame([(None,), ([],), ([""],), (["x", "y"],), (["y"],), (["x"],)], "f array<string>").select(ingest.policy_verdict(F.col("f"), F.lit("x")).alias("v"))
    assert [r.v for r in v.collect()] == ["unmeasured", "unmeasured", "unlabelled", "mixed", "mismatch", "ok"]
    runs = spark.createDataFrame([("d", 1, 5, "p"), ("d", 2, None, "q"), ("d", 3, 4, "r")], "doc string, run int, at bigint, policy string")
    assert rows(ingest.latest_builds(runs, "doc", "at", "run", ["policy"])) == [("d", 3, "p")]
    assert rows(ingest.latest_builds(runs, "doc", "at", "run", ["policy"], "first")) == [("d", 3, "r")]


def test_inference_in_sql_matches_the_kernel(spark):
    from tallyloom.functions.resampling import ratio_swap_p, sign_flip_p

    a, b = [3.0, 1.0, 4.0, 1.0, 5.0], [2.0, 2.0, 1.0, 0.5, 3.0]
    long = spark.createDataFrame([("x", "m", f"q{i}", v) for i, v in enumerate(a)] + [("ref", "m", f"q{i}", v) for i, v in enumerate(b)], "cell string, metric string, query_id string, value double")
    got = inference.exact_sign_flips(inference.paired(long, "ref")).first()
    assert got.perm_p == pytest.approx(sign_flip_p([x - y for x, y in zip(a, b)]), abs=1e-9)
    num, den = long.drop("metric"), long.drop("metric").withColumn("value", F.lit(1.0) + F.col("value") / 10)
    r = inference.exact_ratio_swaps(num, den, "ref").first()
    assert r.perm_p == pytest.approx(ratio_swap_p(a, [1 + v / 10 for v in a], b, [1 + v / 10 for v in b]), abs=1e-9)


def test_pooling_and_families(spark):
    s = spark.createDataFrame([("c", "r1", "q", "m", 1.0), ("c", "r2", "q", "m", 3.0), ("c", "r1", "p", "m", 1.0)], "cell string, run_id string, query_id string, metric string, value double")
    assert rows(inference.pool_runs(s, least_runs=2)) == [("c", "m", "q", 2.0, 2)]
    f = inference.split_families(spark.createDataFrame([("old",), ("b",), ("z",)], "cell string"), ["a"], ["b"], {"old": "a"})
    assert rows(f, "cell") == [("a", "grid"), ("b", "offgrid"), ("z", "unknown")]


GOOD = ("x", "m", 10, 0.2, 0.05, 0.35, True, "BCa", 0.01, 0.03)
DELTA = "cell string, metric string, n int, delta double, ci_low double, ci_high double, significant boolean, method string, perm_p double, perm_p_bonferroni double"


@pytest.mark.parametrize(
    ("change", "failing"),
    [({}, set()), ({4: 0.4}, {"ends_in_order", "delta_within_ends"}), ({3: 0.9}, {"delta_within_ends"}), ({6: False}, {"flag_matches_ends"}), ({9: 0.02}, {"bonferroni"}), ({8: 1.5, 9: 1.0}, {"p_within_bounds"}), ({7: "guess"}, {"method_known"})],
)
def test_checks_find_one_broken_field(spark, change, failing):
    row = tuple(change.get(i, v) for i, v in enumerate(GOOD))
    got = checks.verify_deltas(spark.createDataFrame([row], DELTA), contrasts=3)
    assert {r.check_name for r in got.where("status = 'fail'").collect()} == failing


def test_pool_and_ratio_checks(spark):
    pools = spark.createDataFrame([("a", 5, 5, 0), ("b", 3, 8, 2)], "cell string, top_n_min int, top_n_max int, n_missing_top_n bigint")
    assert {(r.check_name, r.cell) for r in checks.verify_pools(pools, 5).where("status = 'fail'").collect()} == {("serves_k", "b"), ("one_width", "b"), ("none_missing", "b")}
    cells = spark.createDataFrame([("a", 0.004, 0.8, 0.005), ("b", 0.006, 0.6, 0.02)], "cell string, num_mean double, den_mean double, ratio double")
    assert [r.cell for r in checks.verify_ratios(cells).where("status = 'fail'").collect()] == ["b"]


def test_quotes_meet_through_character_references(spark):
    from tallyloom.operators import quotes

    texts = lambda rows: quotes.prepared(spark.createDataFrame(rows, "id int, doc string, text string"), "id", "doc", "text")
    chunks = texts([(1, "d", "The caf&amp;#233; door &lt;b&gt;must&lt;/b&gt; close by itself at all times."), (2, "d", "Another text without any reference."), (3, "d", "R&D rooms"), (4, "d", None)])
    evidence = texts([(7, "d", "café door must close by itself"), (8, "d", "Another text &#119;ithout any")])
    assert {(r.evidence_id, r.chunk_id, r.method) for r in quotes.match_quotes(evidence, chunks).collect()} == {(7, 1, "containment"), (8, 2, "containment")}
    assert {r.key: r.norm for r in chunks.collect()}[3] == "r d rooms"
