"""Number helpers: durations, guarded averages, published formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number words used in published sentences.
NUMBER_WORDS = {0: "zero", 1: "one", 2: "two", 3: "three", 4: "four", 5: "five"}

UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000}


def duration_ms(text: Column) -> Column:
    """'5s', '300ms', '2m', '1h' as BIGINT milliseconds; NULL if unreadable."""
    amount = F.regexp_extract(text, "^\\s*([0-9]+)\\s*(ms|s|m|min|h)\\s*$", 1)
    unit = F.regexp_extract(text, "^\\s*([0-9]+)\\s*(ms|s|m|min|h)\\s*$", 2)
    factor = F.create_map(*[F.lit(x) for kv in UNIT_MS.items() for x in kv])
    return F.when(amount != "", amount.cast("long") * F.element_at(factor, unit))


def floor_average(total: Column, count: Column) -> Column:
    """Whole-number average, 0 where there is nothing to average."""
    return F.when(count == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("div", total, count)
    )


def clamp_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0).cast("long"))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def number_word(value: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, value.cast("int")), thousands(value))


def zero_event_bound(trials: Column, confidence: float = 0.95) -> Column:
    """One-sided bound on a probability after zero events in `trials` trials."""
    return F.lit(1.0) - F.pow(F.lit(1.0 - confidence), F.lit(1.0) / trials)
