"""Readers of the file formats of an evaluation: benchmark, conditions, snapshots, labels, power logs, pages, results."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_SCHEMA = (
    "id string, text string, category string, answerable boolean, gold_answer string, governing_doc string, superseded_doc string, "
    "gold_evidence array<struct<document: string, page: int, text: string>>, message_ids map<string, string>"
)
RECORD_SCHEMA = (
    "query_id string, condition string, run_id string, question string, answerable boolean, category string, judged_chunk_ids array<string>, gold_answer string, governing_doc string, "
    "superseded_doc string, message_id string, answer_text string, served_evidence array<struct<chunk_id: string, document_name: string, page: int, retrieval_score: double, rerank_score: double, "
    "served_rank: int, chunk_text: string>>, provider string, model string, tokens_total int, tokens_input int, tokens_output int, latency_ms bigint, completion_link string, answered_at string, "
    "top_k int, top_n int, retrieval_latency_ms bigint, rerank_latency_ms bigint, linked boolean"
)
SNAPSHOT_SCHEMA = f"schema string, cell string, written_at string, include_chunk_text boolean, n_records int, n_linked int, n_judged int, meta map<string, string>, records array<struct<{re.sub(r'(?:(?<=, )|^)(\w+) ', r'\1: ', RECORD_SCHEMA)}>>"
LABEL_ITEM = "array<struct<transcription: string, difficult: boolean, key_cls: string, section_id: int, section_title: string>>"
# Words that stand for a missing stamp.
NO_STAMP = ("", "none", "null", "nan", "nat", "~")
QUERY_KEYS = {c.split()[0] for c in re.split(r", (?=\w+ )", QUERY_SCHEMA)}


def _document(path: str):
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix.lower() in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a YAML or JSON benchmark: a list, or a mapping with `queries`. Unknown keys are dropped."""
    data = _document(path)
    listed = data.get("queries") if isinstance(data, dict) else data
    if not isinstance(listed, list):
        raise ValueError(f"{path}: a list of queries is expected")
    rows = []
    for q in listed:
        refused = {"gold_chunk_ids", "gold_anchors"} & set(q)
        if refused:
            raise ValueError(f"{path}: {sorted(refused)} aren't accepted; give gold_evidence as quotes")
        if not q.get("id") or not q.get("text"):
            raise ValueError(f"{path}: every query needs an id and a text")
        rows.append({"category": "uncategorised", "answerable": True} | {k: v for k, v in q.items() if k in QUERY_KEYS and v is not None})
    if len({r["id"] for r in rows}) < len(rows):
        raise ValueError(f"{path}: an id occurs twice")
    return spark.createDataFrame(rows, QUERY_SCHEMA) if rows else spark.createDataFrame([], QUERY_SCHEMA)


def parse_stamp(value, assume_utc: bool = True) -> datetime | None:
    """A moment from ISO 8601 text or a datetime; the words for nothing give None."""
    if value is None or isinstance(value, str) and value.strip().lower() in NO_STAMP:
        return None
    at = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).strip().replace("Z", "+00:00").replace("z", "+00:00"))
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None and assume_utc else at


CELL_KEYS = {"start", "end", "conversation_ids", "query_ids", "runs", "cost", "per_answer_cost", "note", "snapshot", "expect_policy"}


def read_conditions(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(settings, cells) of a conditions file; one row per cell and run: cell, run_id, start_at, end_at, conversation_ids, bounded, family."""
    data = _document(path)
    cells = data.get("conditions") or {}
    grid, off = list(data.get("grid") or []), list(data.get("offgrid") or [])
    if set(grid) & set(off):
        raise ValueError(f"{path}: in grid and offgrid at once: {sorted(set(grid) & set(off))}")
    reference = data.get("reference") or data.get("baseline")
    if reference in off:
        raise ValueError(f"{path}: the reference {reference} is off the grid")
    rows = []
    for name, spec in cells.items():
        spec = spec or {}
        unknown = set(spec) - CELL_KEYS
        if unknown:
            raise ValueError(f"{path}: {name} has unknown keys {sorted(unknown)}")
        runs = spec.get("runs")
        if runs is not None and (not runs or {"start", "end", "conversation_ids"} & set(spec)):
            raise ValueError(f"{path}: {name} needs either a window of its own or a list of runs")
        seen = set()
        for i, run in enumerate(runs or [spec], 1):
            run_id = str(run.get("run_id") or f"r{i}")
            if run_id in seen:
                raise ValueError(f"{path}: {name} declares run {run_id} twice")
            seen.add(run_id)
            start, end, ids = parse_stamp(run.get("start")), parse_stamp(run.get("end")), list(run.get("conversation_ids") or [])
            if start and end and start > end:
                raise ValueError(f"{path}: {name}/{run_id} ends before it starts")
            if runs is not None and not (start or end or ids):
                raise ValueError(f"{path}: {name}/{run_id} is unbounded")
            rows.append((name, run_id, start, end, ids, bool(start or end or ids), "grid" if name in grid or not grid and name not in off else "offgrid"))
    schema = "cell string, run_id string, start_at timestamp, end_at timestamp, conversation_ids array<string>, bounded boolean, family string"
    return {k: v for k, v in data.items() if k != "conditions"}, spark.createDataFrame(rows, schema)


def read_snapshots(spark: SparkSession, paths: list[str], schema_id: str | None = None) -> DataFrame:
    """Records of snapshot files, missing keys null, unknown ones dropped; two files for one cell or another schema raise."""
    files = spark.read.schema(SNAPSHOT_SCHEMA).json(paths, multiLine=True)
    heads = files.select("cell", "schema").collect()  # one row per file
    cells = [h["cell"] for h in heads]
    if len(set(cells)) < len(cells):
        raise ValueError(f"two files hold one cell: {sorted(c for c in set(cells) if cells.count(c) > 1)}")
    if schema_id and any(h["schema"] != schema_id for h in heads):
        raise ValueError(f"a file has another schema than {schema_id}")
    return files.select("cell", F.explode("records").alias("r")).select("cell", "r.*")


def snapshot_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The header counts alone; the records aren't parsed."""
    return spark.read.schema("cell string, n_records int, n_linked int, n_judged int").json(paths, multiLine=True)


def read_power_csv(spark: SparkSession, path: str) -> DataFrame:
    """iso_ts, watts, device, tag of a power log with header; unreadable watts are null. Works for batch and, by schema, for streams."""
    raw = spark.read.schema("iso_ts string, watts string, device string, tag string").option("header", True).csv(path)
    return raw.withColumn("watts", F.col("watts").try_cast("double"))


def read_label_lines(spark: SparkSession, path: str, document: str, page_offset: int = 0) -> DataFrame:
    """Gold quotes of a label file: one image and a JSON list per line; the page is the last number of the image's name."""
    line = F.split("value", "\t", 2)
    image = F.regexp_replace(F.get(line, 0), r"^.*[/\\]", "")
    items = spark.read.text(path).select(F.try_element_at(F.regexp_extract_all(image, F.lit(r"\d+"), F.lit(0)), F.lit(-1)).cast("int").alias("n"), F.posexplode(F.from_json(F.get(line, 1), LABEL_ITEM)).alias("position", "item"))
    kept = items.where("not coalesce(item.difficult, false) and trim(coalesce(item.transcription, '')) <> ''")
    return kept.select(F.lit(document).alias("document_name"), (F.col("n") + page_offset).alias("page_number"), "position", F.col("item.transcription").alias("text"), "item.key_cls", "item.section_id", "item.section_title")


def inline_evidence(benchmark: DataFrame) -> DataFrame:
    """Quotes inside a benchmark as rows, ids {query}:e{place}."""
    rows = benchmark.select(F.col("id").alias("query_id"), F.posexplode("gold_evidence").alias("place", "e"))
    return rows.select("query_id", F.format_string("%s:e%02d", "query_id", "place").alias("evidence_id"), F.col("e.document").alias("document_name"), F.col("e.page").alias("page_number"), F.col("e.text").alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("document string, page int, text string").json(path, multiLine=True)


def read_label_columns(spark: SparkSession, path: str, a: str, b: str) -> DataFrame:
    """Two named columns of a CSV with header; an absent one raises."""
    df = spark.read.option("header", True).csv(path)
    missing = {a, b} - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return df.select(F.col(a).alias("label_a"), F.col(b).alias("label_b"))


def read_refusal_results(spark: SparkSession, path: str) -> DataFrame:
    """Per test of a grader's result file: query_id, marker_match (the pattern passed), is_refusal (either passed)."""
    component = "struct<pass: boolean, assertion: struct<type: string>>"
    schema = f"results struct<results: array<struct<vars: struct<query_id: string>, gradingResult: struct<componentResults: array<{component}>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results.results").alias("r"))
    parts = rows.select(F.col("r.vars.query_id").alias("query_id"), F.explode_outer("r.gradingResult.componentResults").alias("c"))
    marker = F.coalesce(F.col("c.pass") & (F.col("c.assertion.type") == "regex"), F.lit(False))
    refusal = F.coalesce(F.col("c.pass") & (F.col("c.assertion.type") == "is-refusal"), F.lit(False))
    return parts.groupBy("query_id").agg(F.max(marker).alias("marker_match"), F.max(marker | refusal).alias("is_refusal"))


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """The table itself; raises with the names that are missing."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
