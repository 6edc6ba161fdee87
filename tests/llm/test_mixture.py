import numpy as np
import pytest

from tallyloom.llm import mixture as M


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 400))
        pi, t = rng.random(n), rng.integers(1, 500, n)
        p = M.fly(pi, t, int(rng.integers(1e9)))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert p.sum() == pytest.approx(pi.sum(), abs=1e-6) and (p * t).sum() == pytest.approx((pi * t).sum(), abs=1e-4)
        assert set(np.unique(M.land(p, t))) <= {0.0, 1.0}


def test_flight_keeps_probabilities():
    t = np.array([1, 2, 3, 4, 5, 6])
    mean = np.mean([M.fly(np.full(6, 0.5), t, s) for s in range(4000)], axis=0)
    assert np.allclose(mean, 0.5, atol=0.03)


def counted(spark, n=3000):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, "big" if i % 3 else "small", int(rng.integers(5, 300)), 1.0) for i in range(n)] + [(None, "big", 5, 1.0), (n, None, 5, 1.0), (n + 1, "other", 7, 1.0), (n + 2, "big", 0, 1.0), (0, "small", 9, 1.0)], "doc_id bigint, source string, tokens bigint, copies double")


def test_mixture_meets_the_targets(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, shares = M.mix(counted(spark), targets)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"big", "small", "absent"} and got["absent"].tokens_out == 0
    assert got["big"].actual_share == pytest.approx(0.5 / 0.9, abs=0.003) and got["small"].most_copies <= 3 and got["big"].most_copies <= 1
    rows = drawn.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and sum(r.copies * r.tokens for r in rows) == got["big"].tokens_out + got["small"].tokens_out
    assert rows and {r.source for r in rows} == {"big", "small"}
    again, _ = M.mix(counted(spark).repartition(7), targets)
    small = lambda df: sorted((r.doc_id, r.copies) for r in df.where("doc_id > 0").collect())
    assert small(again) == small(drawn)


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    drawn, shares = M.mix(counted(spark).limit(0), targets)
    assert drawn.count() == 0 and shares.first().actual_share == 0.0
    drawn, shares = M.mix(counted(spark), targets.limit(0))
    assert drawn.count() == 0 and shares.count() == 0


def test_tokens(spark, tmp_path):
    import base64

    vocab = tmp_path / "v.tiktoken"
    vocab.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + f" {i}".encode() for i in range(256)))
    df = spark.createDataFrame([(1, "ab c", "s"), (2, None, "s"), (3, "é", None)], "doc_id bigint, text string, source string")
    assert {r.doc_id: r.tokens for r in M.count_tokens(df, tokenizer=str(vocab)).collect()} == {1: 4, 2: 0, 3: 2}
