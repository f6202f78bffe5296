"""Captured output: noise out, errors kept; causes of failures (P10, O3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import first_line, is_blank, split_lines, strip_ansi

# Line noise of a terminal client.
TERMINAL_NOISE = ["org.jline", "dumb terminal", "WARNING:"]


def clean_lines(text: Column, noise: list[str]) -> Column:
    """Drop colour codes, blank lines and lines holding a noise word.

    By pattern only: whatever is not known noise stays, errors first of all.
    """
    lines = split_lines(strip_ansi(text))

    def keep(line: Column) -> Column:
        kept = ~is_blank(line)
        for word in noise:
            kept = kept & ~F.contains(line, F.lit(word))
        return kept

    return F.array_join(F.filter(lines, keep), "\n")


def failure_causes(failures: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """The first failures by name, or by the first line of their trace (O3).

    Needs `exception_name` and `stacktrace`. The limit is the report's length.
    """
    named = F.when(F.col("exception_name") != "", F.col("exception_name"))
    return failures.orderBy(order).limit(limit).select(
        F.col(order), F.coalesce(named, first_line(F.col("stacktrace"))).alias("cause")
    )
