"""Small column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(condition: Column, of: Column | None = None) -> Column:
    """Aggregate: the share of rows (of those where ``of`` holds) where the condition holds; null without such rows."""
    return F.avg(F.when(of, condition.cast("double")) if of is not None else condition.cast("double"))


def count_where(condition: Column) -> Column:
    """Aggregate: the number of rows where the condition holds, as a double."""
    return F.count_if(condition).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def timestamp_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS.mmm."""
    p = F.split(text, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def pitch_x(x: Column) -> Column:
    """From a length of 120 to 100."""
    return x / 120.0 * 100.0


def pitch_y(y: Column) -> Column:
    """From a width of 80, counted from the other side, to 100."""
    return (F.lit(80.0) - y) / 80.0 * 100.0


def snake(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def file_size(n: Column) -> Column:
    """Bytes as B, KB or MB with one decimal from KB on."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
