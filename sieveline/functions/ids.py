"""Identifiers written loosely: blanks, a folder or a file extension around the id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nine digits of the last path element, as a pattern both Spark and the SQL check understand.
LOOSE_ID = r"(?:^|/)\s*([0-9]{9})(?:\.[A-Za-z0-9]+)?\s*$"


def loose_id(col: Column | str) -> Column:
    """The nine-digit id of a loosely written one; null when there is none."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_extract(col, LOOSE_ID, 1), F.lit(""))
