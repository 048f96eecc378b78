"""Small summaries as Markdown and as plain SVG charts.  Tables here are summaries: a row a condition, group or stage."""

from __future__ import annotations

from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A summary of more rows than this is refused, as it is no summary.
MOST = 1000


def rows_of(df: DataFrame, order: list[str]) -> list[dict]:
    found = [r.asDict() for r in df.orderBy(*order).limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError("too many rows for a report")
    return found


def _cell(v) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, order: list[str]) -> str:
    rows = rows_of(df, order)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(r[c]) for c in df.columns) + " |" for r in rows]) + "\n"


def write_report(path: str | Path, title: str, sections: list[tuple[str, DataFrame, list[str]]]) -> str:
    """A Markdown file with a table for each (heading, summary, order); gives its text."""
    text = f"# {title}\n\n" + "\n".join(f"## {h}\n\n{markdown_table(df, order)}" for h, df, order in sections)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return text


def bars(df: DataFrame, label: str, value: str, error: str | None = None, width: int = 640, height: int = 320) -> str:
    """An SVG bar chart of a summary, with error bars if a column has them."""
    rows = rows_of(df, [label])
    top = max([abs(r[value] or 0) + (r[error] or 0 if error else 0) for r in rows] or [1]) or 1
    step, base = width / max(len(rows), 1), height - 40
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" role="img">', f'<line x1="0" y1="{base}" x2="{width}" y2="{base}" stroke="#888"/>']
    for i, r in enumerate(rows):
        h = (r[value] or 0) / top * (base - 20)
        x = i * step + step * 0.2
        parts.append(f'<rect x="{x:.1f}" y="{base - max(h, 0):.1f}" width="{step * 0.6:.1f}" height="{abs(h):.1f}" fill="#4a78b5"><title>{escape(str(r[label]))}: {_cell(r[value])}</title></rect>')
        if error and r[error]:
            e, mid = r[error] / top * (base - 20), x + step * 0.3
            parts.append(f'<line x1="{mid:.1f}" y1="{base - h - e:.1f}" x2="{mid:.1f}" y2="{base - h + e:.1f}" stroke="#222"/>')
        parts.append(f'<text x="{x + step * 0.3:.1f}" y="{height - 22}" font-size="11" text-anchor="middle">{escape(str(r[label]))}</text>')
    return "\n".join([*parts, "</svg>"]) + "\n"


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, low, n): counts over equal widths between the smallest and the largest value, for violins and scatters."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / F.lit(bins), F.lit(1e-12))
    rows = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin"), (F.col("lo") + at * width).alias("low")).agg(F.count("*").alias("n"))
