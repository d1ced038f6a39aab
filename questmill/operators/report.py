"""Reports of flagged rows: a table with totals, and an HTML page of the worst."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_total(df: DataFrame, by: str, *counts: str) -> DataFrame:
    """Sums by one column and a row TOTAL, in one pass."""
    out = df.rollup(by).agg(*(F.sum(c).cast("long").alias(c) for c in counts), F.grouping(by).alias("__all"))
    return out.withColumn(by, F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col(by))).orderBy("__all", by).drop("__all")


def html_report(flagged: DataFrame, title: str, order: list, most: int = 200) -> str:
    """A page of at most ``most`` rows, the first in ``order``, with the full count above."""
    n = flagged.count()
    rows = flagged.orderBy(*order).limit(most).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in flagged.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><p>{n} rows, {len(rows)} shown</p><table><tr>{head}</tr>{body}</table>"
