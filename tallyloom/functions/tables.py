"""HTML tables as pipe tables."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Rows(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []
            if not self.rows:
                self.rows.append([])

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def pipe_table(raw: str | None, html: str | None = None) -> str | None:
    """The first row as header; short rows are filled up. Without cells the raw text is a table of one column, or itself
    where it has pipes already."""
    rows: list[list[str]] = []
    if html:
        parser = _Rows()
        parser.feed(html)
        rows = [r for r in parser.rows if r]
    if not rows:
        if raw is None:
            return None
        lines = [" ".join(x.split()) for x in raw.splitlines() if x.strip()]
        if not lines or any("|" in x for x in lines):
            return "\n".join(lines)
        rows = [[x] for x in lines]
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * width, *map(line, rows[1:])])


@F.pandas_udf(T.StringType())
def pipe_table_column(raw: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([pipe_table(r, h) for r, h in zip(raw, html)], dtype=object)
