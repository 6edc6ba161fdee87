"""All queries of the core by name, and their SQL."""

from tallyloom.plans import chunkers, experiment, gates, logs, measures, problems, retrieval, scores

FLAGSHIP = "ir_metrics_by_cell"
FAMILIES = (retrieval, logs, scores, measures, experiment, chunkers, gates, problems)
QUERIES: dict = {name: f for family in FAMILIES for name, f in family.QUERIES.items()}
SQL: dict[str, str] = {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
