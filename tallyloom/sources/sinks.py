"""Writers: snapshots of cells, reports, and Markdown tables."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, *, with_chunk_text: bool = True, overwrite: bool = False) -> None:
    """Records as one folder per cell and run; chunk texts can be blanked. Only the cells at hand are replaced."""
    df = records
    if not with_chunk_text and "served_evidence" in df.columns:
        df = df.withColumn("served_evidence", F.transform("served_evidence", lambda e: e.withField("chunk_text", F.lit(""))))
    writer = df.write.mode("overwrite" if overwrite else "error").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*[c for c in ("cell", "run_id") if c in df.columns]).parquet(path)


def snapshot_verdicts(counts: DataFrame, least_records: int = 1, least_linked: int = 1) -> DataFrame:
    """Per cell (cell, n_records, n_linked): keep, or the first reason not to."""
    reason = F.when(F.col("n_records") < least_records, "no records").when(F.col("n_linked") < least_linked, "too few linked")
    return counts.withColumns({"verdict": F.when(reason.isNull(), "keep").otherwise("reject"), "reason": reason})


def write_report(report: dict, folder: str, tables: dict[str, DataFrame] | None = None, most_rows: int = 10_000) -> None:
    """report.json and report.md; tables are summaries by nature, and one over most_rows raises instead of being cut."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    parts = []
    for title, df in (tables or {}).items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{title} has over {most_rows} rows and is no report table")
        parts.append(f"## {title}\n\n{markdown(df.columns, [list(r) for r in rows])}")
        report = report | {title: [r.asDict(recursive=True) for r in rows]}
    for name, text in (("report.json", json.dumps(report, indent=2, default=str)), ("report.md", "\n\n".join(parts) + "\n")):
        staged = target / f".{name}.new"
        staged.write_text(text, encoding="utf-8")
        os.replace(staged, target / name)


def markdown(columns: list[str], rows: list[list]) -> str:
    """A pipe table; nulls read n/a and numbers keep up to six places."""
    show = lambda v: "n/a" if v is None else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(map(show, r)) + " |" for r in rows])
