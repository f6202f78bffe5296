"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
SPAN = 8
SAMPLE_ROWS = 2000  # most rows that costs and selectivities are estimated on; they decide the order only
REPEATS = 2


@dataclass(frozen=True)
class Rule:
    """A reason to reject a text: an expression over `text` and its base measures that is never null."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    text, lines = F.col("text"), F.col("lines")
    letters = F.regexp_count(text, F.lit(r"\p{L}"))

    def share(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda line: line.rlike(pattern)))

    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("same_lines", 2 * F.col("n_dup_lines") > F.size(lines)),
        Rule("few_letters", 4 * letters < F.col("word_chars")),
        Rule("capitals", 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) > letters),
        Rule("bullets", 10 * share(r"^[\x20\x09-\x0D]*[-*•]") > 9 * F.size(lines)),
        Rule("ellipses", 10 * share(r"(\.\.\.|…)[\x20\x09-\x0D]*$") > 3 * F.size(lines)),
        Rule("few_words", (F.col("n_words") >= 100) & (20 * F.size(F.array_distinct("words")) < F.col("n_words"))),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base measures of every whole text, beside `id`, `text`, its `words` and its `lines` with a word.

    Words repeat where 8-word windows are found twice: windows are hashed, and only where a
    hash is not unique are they sorted beside their place; covered words then follow from
    the gaps between the places. Each step is a column of its own that the next one uses
    more than once, so that the optimizer does not make it again for every element.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", "text", F.array_remove(F.split("text", BLANK + "+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    counted = base.select(
        "*", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    spans = counted.withColumn("spans", F.when(
        F.size("codes") > SPAN,
        F.transform(F.sequence(F.lit(1), F.size("codes") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("codes", i, SPAN)))))
    again = spans.withColumn("again", F.coalesce(F.size(F.array_distinct("spans")) < F.size("spans"), F.lit(False)))
    by_code = again.withColumn("by_code", F.when(F.col("again"), F.sort_array(
        F.transform("spans", lambda code, at: F.struct(code.alias("code"), at.alias("at"))))))

    def twice(x: Column, i: Column) -> Column:
        other = F.col("by_code")
        same = F.coalesce(x["code"] == F.get(other, i - 1)["code"], F.lit(False)) | F.coalesce(x["code"] == F.get(other, i + 1)["code"], F.lit(False))
        return F.when(same, x["at"])

    placed = by_code.withColumn("places", F.when(F.col("again"), F.sort_array(F.array_compact(F.transform("by_code", twice)))))
    repeated = F.aggregate(
        F.transform("places", lambda at, i: F.least(F.lit(SPAN), F.get(F.col("places"), i + 1) - at)),
        F.lit(0).cast("long"), lambda total, n: total + n)
    # the row number is never below zero; as it is not deterministic, no filter is moved below this step
    # and no expression above is written into it, either of which would make the arrays again and again
    counted_once = F.col("again") & (F.monotonically_increasing_id() >= 0)
    return placed.select(
        "id", "text", "words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(counted_once, repeated).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def failed_base() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def in_order(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per second on a sample of measured texts, the best first.

    The cost of a rule is the time of a pass that evaluates it less that of a pass that
    does not; a rule that rejects nothing on the sample comes last, the cheapest of them first.
    """
    def seconds(column: Column) -> tuple[float, int]:
        best, value = float("inf"), 0
        for _ in range(REPEATS):
            started = time.perf_counter()
            value = sample.agg(F.count_if(column)).first()[0]
            best = min(best, time.perf_counter() - started)
        return best, value

    plain, _ = seconds(F.col("n_words") < 0)
    ranked = []
    for rule in rules:
        taken, rejected = seconds(rule.rejects)
        cost = max(taken - plain, 1e-4)
        ranked.append((-rejected / cost, cost, rule.name, rule))
    return [r[-1] for r in sorted(ranked, key=lambda r: r[:3])]


def cascade(rules: list[Rule]) -> Column:
    """True where no rule rejects; a rule is evaluated only where those before it did not reject."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(False)).otherwise(verdict)
    return verdict


def judge(
    docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Base measures, `base_failed` and `kept` of every whole text, one row per row of `docs`.

    A text fails the base below 20 words, or with over 30 % of its words in repeated
    8-word windows. The others are kept unless a rule rejects them. Rules are put in order
    of rejections per cost, estimated on at most `sample_rows` rows; the order changes the
    work, never the verdict. Null text has no words. Null ids and repeated rows stay; an
    empty table gives an empty result; other columns are not read.
    """
    rules = default_rules() if rules is None else rules
    if len(rules) > 1:
        rows = docs.count()
        few = docs.select(id_col, text_col).sample(min(1.0, 2 * sample_rows / max(rows, 1)), seed=3).limit(sample_rows)
        sample = cut(measured(few, id_col, text_col), "quality").where(~failed_base())
        rules = in_order(sample, rules)
    whole = measured(docs, id_col, text_col).withColumn("base_failed", failed_base())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(rules))
    return whole.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
placed AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM split),
spans AS (
  SELECT r, pos, array_to_string([word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w,
                                 lead(word, 5) OVER w, lead(word, 6) OVER w, lead(word, 7) OVER w], ' ') AS span,
         lead(word, 7) OVER w IS NOT NULL AS whole
  FROM placed WINDOW w AS (PARTITION BY r ORDER BY pos)),
twice AS (
  SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, span) AS n FROM spans WHERE whole) WHERE n > 1),
repeated AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, least(8, coalesce(lead(pos) OVER (PARTITION BY r ORDER BY pos) - pos, 8)) AS n FROM twice) GROUP BY r),
measured AS (
  SELECT doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(regexp_extract_all(text, '\p{L}')) AS letters
  FROM split LEFT JOIN repeated USING (r)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 2 * n_dup_lines > len(lines) OR 4 * letters < word_chars
         OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > letters
         OR 10 * len(list_filter(lines, lambda line: regexp_matches(line, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) > 9 * len(lines)
         OR 10 * len(list_filter(lines, lambda line: regexp_matches(line, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) > 3 * len(lines)
         OR (n_words >= 100 AND 20 * len(list_distinct(words)) < n_words) AS rejected
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged
"""
