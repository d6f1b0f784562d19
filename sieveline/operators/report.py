"""Report tables as Markdown, from small result frames."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame

#: Rows a table of a report may have; reports are for reading.
MOST_ROWS = 1_000


def markdown_table(df: DataFrame, digits: int = 4) -> str:
    """A Markdown table of all rows; more than MOST_ROWS is an error, since nothing is left out silently."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report's table has at most {MOST_ROWS} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    numeric = [t in ("double", "float", "int", "bigint") for _, t in df.dtypes]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "|".join("---:" if n else "---" for n in numeric) + "|"]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def write_report(path: str, title: str, sections: Mapping[str, DataFrame | str]) -> None:
    """Write a Markdown report; the file is replaced as a whole."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    with open(path + ".new", "w", encoding="utf-8") as f:
        f.write("\n\n".join(parts) + "\n")
    os.replace(path + ".new", path)
