"""Small result tables as Markdown and HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from turnloom.functions.formats import fixed


def _cells(rows: DataFrame, digits: int, most: int) -> tuple[list[str], list[list[str]]]:
    texts = [fixed(F.col(f.name), digits) if isinstance(f.dataType, DoubleType | FloatType) else F.coalesce(F.col(f.name).cast("string"), F.lit("—")) for f in rows.schema]
    found = rows.select(*[t.alias(f"c{i}") for i, t in enumerate(texts)]).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return rows.columns, [list(r) for r in found]


def markdown_table(rows: DataFrame, digits: int = 3, most: int = 1_000) -> str:
    """The rows in their order as a Markdown table; an error for more than ``most``, as a report is read by people."""
    names, cells = _cells(rows, digits, most)
    bar = lambda xs: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    return "\n".join([bar(names), "|" + "---|" * len(names), *map(bar, cells)])


def html_table(rows: DataFrame, digits: int = 3, most: int = 1_000) -> str:
    """As :func:`markdown_table`, as an HTML table."""
    names, cells = _cells(rows, digits, most)
    line = lambda xs, tag: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in xs) + "</tr>"
    return "\n".join(["<table>", line(names, "th"), *[line(c, "td") for c in cells], "</table>"])
