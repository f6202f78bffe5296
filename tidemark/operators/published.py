"""Published lines as templates: which columns, in which form, and what stands for NULL.

A template is text with fields, `{column}` or `{column:form|absent}`. Forms: none (as it
is), `,` (thousands), `.2f` (decimals), `word` (small numbers in words), `yes/no` (either
word for a boolean). `absent` is what a NULL prints as; without it a NULL field makes the
whole line NULL, and a line that is NULL is refused rather than printed with a gap.
"""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.functions import number_word, thousands
from tidemark.operators.evidence import facts


def cell(column: Column, form: str = "") -> Column:
    """One value in its published form; NULL stays NULL."""
    if form == "":
        return column.cast("string")
    if form == ",":
        return thousands(column)
    if form == "word":
        return number_word(column)
    if re.fullmatch(r"\.\d+f", form):
        return F.when(column.isNotNull(), F.format_string(f"%{form}", column.cast("double")))
    if "/" in form:
        yes, no = form.split("/", 1)
        return F.when(column, yes).when(~column, no)
    raise Refused(f"unknown form {form!r}")


def rendered(template: str) -> Column:
    """A template as one string column."""
    parts = []
    for text, name, spec, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            form, bar, absent = (spec or "").partition("|")
            value = cell(F.col(name), form)
            parts.append(F.coalesce(value, F.lit(absent)) if bar else value)
    return F.concat(*parts) if parts else F.lit("")


def lines(results: DataFrame, tag: str, template: str) -> DataFrame:
    """One fact (tag, text) per result row, both from templates."""
    gap = F.raise_error(F.concat(F.lit(f"a field of {tag!r} has no value and no word for that: "), F.to_json(F.struct("*"))))
    return facts(results, rendered(tag), F.coalesce(rendered(template), gap.cast("string")))


def ratio(results: DataFrame, key: str, column: str, of: str, to: str) -> DataFrame:
    """One row: how many times the figure of one result is that of another."""
    def figure(which):
        return F.max(F.when(F.col(key) == which, F.col(column)))

    return results.agg((figure(of) / figure(to)).alias("times"))
