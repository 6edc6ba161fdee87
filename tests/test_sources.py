import json

import pytest

from tallyloom.sources import files, sinks


def test_benchmark(spark, tmp_path):
    p = tmp_path / "b.yaml"
    p.write_text("queries:\n  - id: q1\n    text: Which door?\n    gold_evidence:\n      - {document: D, page: 3, text: the door}\n    unknown: 1\n  - id: q2\n    text: Why?\n    answerable: false\n")
    df = files.read_benchmark(spark, str(p))
    assert [(r.id, r.category, r.answerable) for r in df.orderBy("id").collect()] == [("q1", "uncategorised", True), ("q2", "uncategorised", False)]
    assert [(r.evidence_id, r.page_number) for r in files.inline_evidence(df).collect()] == [("q1:e00", 3)]
    p.write_text("- id: q1\n  text: x\n  gold_chunk_ids: [a]\n")
    with pytest.raises(ValueError):
        files.read_benchmark(spark, str(p))


CELLS = {"reference": "control", "grid": ["control", "b"], "offgrid": ["z"], "conditions": {"control": {"start": "2026-07-01T00:00:00Z", "end": "2026-07-02T00:00:00Z"}, "b": {"runs": [{"conversation_ids": ["c1"]}, {"start": "2026-07-03", "run_id": "x"}]}, "z": {}}}


def test_conditions(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps(CELLS))
    head, cells = files.read_conditions(spark, str(p))
    assert head["reference"] == "control"
    assert [(r.cell, r.run_id, r.bounded, r.family) for r in cells.orderBy("cell", "run_id").collect()] == [("b", "r1", True, "grid"), ("b", "x", True, "grid"), ("control", "r1", True, "grid"), ("z", "r1", False, "offgrid")]


@pytest.mark.parametrize("change", [{"offgrid": ["b"]}, {"reference": "z"}, {"conditions": {"a": {"typo": 1}}}, {"conditions": {"a": {"runs": []}}}, {"conditions": {"a": {"runs": [{}]}}}, {"conditions": {"a": {"start": "2026-02-01", "end": "2026-01-01"}}}])
def test_conditions_that_are_refused(spark, tmp_path, change):
    p = tmp_path / "c.json"
    p.write_text(json.dumps(CELLS | change))
    with pytest.raises(ValueError):
        files.read_conditions(spark, str(p))


def test_stamps():
    assert files.parse_stamp("None") is None and files.parse_stamp("2026-01-01T00:00:00Z").tzinfo is not None


def test_snapshots(spark, tmp_path):
    def put(name, cell):
        (tmp_path / name).write_text(json.dumps({"schema": "s/1", "cell": cell, "n_records": 1, "n_linked": 1, "extra": 1, "records": [{"query_id": "q1", "answer_text": "A", "linked": True, "new_key": 2, "served_evidence": [{"chunk_id": "c", "served_rank": 0}]}]}))
        return str(tmp_path / name)

    a, b = put("a.json", "a"), put("b.json", "b")
    got = files.read_snapshots(spark, [a, b], "s/1")
    assert sorted((r.cell, r.query_id, r.served_evidence[0].chunk_id, r.latency_ms) for r in got.collect()) == [("a", "q1", "c", None), ("b", "q1", "c", None)]
    assert files.snapshot_counts(spark, [a]).first().n_linked == 1
    with pytest.raises(ValueError):
        files.read_snapshots(spark, [a, put("c.json", "a")])
    sinks.write_records(got, str(tmp_path / "out"), with_chunk_text=False)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_label_lines_power_and_results(spark, tmp_path):
    (tmp_path / "Label.txt").write_text('img/p_12.png\t[{"transcription": "A quote", "key_cls": "answer"}, {"transcription": "", "difficult": false}, {"transcription": "hard", "difficult": true}]\nbroken\n')
    assert [(r.page_number, r.text) for r in files.read_label_lines(spark, str(tmp_path / "Label.txt"), "D", 1).collect()] == [(13, "A quote")]
    (tmp_path / "p.csv").write_text("iso_ts,watts,device,tag\n2026-01-01T00:00:00Z,5.5,d,t\n2026-01-01T00:00:01Z,,d,t\n2026-01-01T00:00:02Z,oops,d,t\n")
    assert [r.watts for r in files.read_power_csv(spark, str(tmp_path / "p.csv")).orderBy("iso_ts").collect()] == [5.5, None, None]
    (tmp_path / "r.json").write_text(json.dumps({"results": {"results": [{"vars": {"query_id": "q"}, "gradingResult": {"componentResults": [{"pass": False, "assertion": {"type": "regex"}}, {"pass": True, "assertion": {"type": "is-refusal"}}]}}]}}))
    assert [tuple(r) for r in files.read_refusal_results(spark, str(tmp_path / "r.json")).collect()] == [("q", False, True)]
    (tmp_path / "l.csv").write_text("x,y\n1,0\n")
    assert files.read_label_columns(spark, str(tmp_path / "l.csv"), "x", "y").first() == ("1", "0")
    with pytest.raises(ValueError):
        files.read_label_columns(spark, str(tmp_path / "l.csv"), "x", "z")


def test_report(spark, tmp_path):
    sinks.write_report({"n": 1}, str(tmp_path), {"cells": spark.createDataFrame([("a", 0.5), ("b", None)], "cell string, v double")})
    assert "| a | 0.5 |" in (tmp_path / "report.md").read_text() and json.loads((tmp_path / "report.json").read_text())["cells"][1]["v"] is None
    with pytest.raises(ValueError):
        sinks.write_report({}, str(tmp_path), {"big": spark.range(5)}, most_rows=3)
    v = sinks.snapshot_verdicts(spark.createDataFrame([("a", 0, 0), ("b", 2, 0), ("c", 2, 2)], "cell string, n_records int, n_linked int"))
    assert [r.verdict for r in v.orderBy("cell").collect()] == ["reject", "reject", "keep"]
