"""Outputs of an audit: the frames of a workbook as tables, and a page for people."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_frames(frames: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each frame under its name, as Parquet or CSV (with a header, nulls as N/A)."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        if form == "csv":
            flat = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("N/A")).alias(c) if kind == "string" else F.col(f"`{c}`").cast("string").alias(c) for c, kind in df.dtypes])
            flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            writer.parquet(f"{folder}/{name}")


def write_failures(status: DataFrame, folder: str) -> bool:
    """The failed rows of a status table as CSV, only if there are any."""
    failed = status.where("status = 'failed'")
    if failed.isEmpty():
        return False
    failed.write.mode("overwrite").option("header", True).csv(folder)
    return True


def page(title: str, summary: DataFrame, limit: int = 1000) -> str:
    """A page of a summary frame's first `limit` rows, saying so where there are more; long tables belong in files."""
    head = "".join(f"<th>{escape(c)}</th>" for c in summary.columns)
    rows = summary.limit(limit + 1).collect()
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in row) + "</tr>" for row in rows[:limit])
    body += f'<tr><td colspan="{len(summary.columns)}">The first {limit} rows only.</td></tr>' if len(rows) > limit else ""
    return f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
