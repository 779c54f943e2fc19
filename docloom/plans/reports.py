"""Reports of evaluations for reading: HTML of a bounded number of cases."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame


def _cell(value: object) -> str:
    if isinstance(value, list):
        return "<ul>" + "".join(f"<li>{escape(str(v))}</li>" for v in value) + "</ul>"
    return escape("" if value is None else str(value))


def html(cases: DataFrame, title: str, most: int = 20) -> str:
    """A page with a table of at most `most` rows."""
    rows = cases.limit(most).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in cases.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table border='1'><tr>{head}</tr>{body}</table></body></html>"


def text(statistics: DataFrame, title: str) -> str:
    """One line a row, name: value."""
    lines = [title, "-" * len(title)]
    for r in statistics.collect():
        lines.append(", ".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in r.asDict().items()))
    return "\n".join(lines) + "\n"
