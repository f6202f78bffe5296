"""Judging runs and checking claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import duration_ms, number_word, squash_whitespace, thousands, zero_event_bound
from tidemark.operators import audit, compare, evidence, isolation, lines, published, samples
from tidemark.plans.commit_plans import INTERVAL_SQL, interval_runs
from tidemark.plans.registry import Registry
from tidemark.plans.tables import SAMPLES_SQL, feed, read, samples_by_hour
from tidemark.plans.txn_plans import TIMEOUT_SQL, timed_transactions
from tidemark.sources.results import read_results, write_results
from tidemark.workspace import new_dir

REGISTRY = Registry()
GB = 1 << 30

# Event types as the runs of one experiment.
RUNS_SQL = """typed AS (SELECT event_type AS run_key, epoch_us(ts) // 3600000000 AS h, user_id % 4 AS w,
    CAST(sum(length(props)) AS BIGINT) AS b, max(epoch_us(ts)) AS newest, count(*) AS n FROM events GROUP BY ALL),
  hourly AS (SELECT run_key, h, count(*) AS f, sum(b) AS b, max(newest) AS newest, sum(n) AS n FROM typed GROUP BY ALL),
  runs AS (SELECT run_key, count(*) AS commits, CAST(sum(f) AS BIGINT) AS data_files, CAST(sum(b) AS BIGINT) AS data_bytes,
    CAST(sum(b) // sum(f) AS BIGINT) AS avg_data_file_bytes, max(f) AS max_files_in_one_commit, CAST(sum(n) AS BIGINT) AS rows,
    round(max_by((h + 1) * 3600 - newest / 1000000.0, h), 1) AS seconds_to_visible FROM hourly GROUP BY 1)"""


def typed_runs(spark, sf_dir):
    from tidemark.functions import floor_average
    from tidemark.plans.tables import hour, micros

    events = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_key"), hour().alias("h"), (F.col("user_id") % 4).alias("w"),
        F.length("props").alias("b"), micros("ts").alias("us"),
    )
    files = events.groupBy("run_key", "h", "w").agg(
        F.sum("b").alias("b"), F.max("us").alias("us"), F.count(F.lit(1)).alias("n")
    )
    hourly = files.groupBy("run_key", "h").agg(
        F.count(F.lit(1)).alias("f"), F.sum("b").alias("b"), F.max("us").alias("us"), F.sum("n").alias("n")
    )
    wait = (F.col("h") + 1) * 3600 - F.col("us") / F.lit(1_000_000)
    runs = hourly.withColumn("wait", wait).groupBy("run_key").agg(
        F.count(F.lit(1)).alias("commits"), F.sum("f").alias("data_files"), F.sum("b").alias("data_bytes"),
        F.max("f").alias("max_files_in_one_commit"), F.sum("n").alias("rows"),
        F.round(F.max_by("wait", "h"), 1).alias("seconds_to_visible"),
    )
    return runs.withColumn("avg_data_file_bytes", floor_average(F.col("data_bytes"), F.col("data_files")))


MEASURES = ["data_files", "avg_data_file_bytes", "max_files_in_one_commit", "seconds_to_visible"]
CLAIMS = [
    compare.Claim("as many files", compare.WITHIN_NOISE, "data_files", "purchase", "view"),
    compare.Claim("files as large", compare.WITHIN_NOISE, "avg_data_file_bytes", "purchase", "view"),
    compare.Claim("fewer files", compare.BELOW, "data_files", "signup", "view"),
    compare.Claim("larger files", compare.ABOVE, "avg_data_file_bytes", "signup", "view"),
    compare.Claim("later to be seen", compare.ABOVE, "seconds_to_visible", "signup", "view"),
    compare.Claim("no commit of more files than writers", compare.AT_MOST, "max_files_in_one_commit", limit=4.0),
    compare.Claim("no file near a gigabyte", compare.AT_MOST, "avg_data_file_bytes", limit=GB / 1000),
]
REPEATS = [("view", "click"), ("purchase", "error")]


def _values(rows) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)


@REGISTRY.add(
    "run_findings",
    f"""WITH {RUNS_SQL}, m AS (UNPIVOT (SELECT run_key AS run, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in MEASURES)} FROM runs)
   ON {', '.join(MEASURES)} INTO NAME measure VALUE value),
  c(claim, kind, measure, run, against, most) AS (VALUES {_values((c.text, c.kind, c.measure, c.run, c.against, c.limit) for c in CLAIMS)}),
  n AS (SELECT x.measure, max(abs(x.value - y.value)) AS noise FROM (VALUES {_values(REPEATS)}) AS r(run, again)
    JOIN m x ON x.run = r.run JOIN m y ON y.run = r.again AND y.measure = x.measure GROUP BY 1),
  g AS (SELECT measure, max(value) AS greatest FROM m GROUP BY 1),
  f AS (SELECT c.*, n.noise, CASE WHEN kind <> 'at most' THEN x.value - y.value WHEN c.run IS NULL THEN greatest ELSE x.value END AS found
    FROM c LEFT JOIN m x ON x.run = c.run AND x.measure = c.measure LEFT JOIN m y ON y.run = c.against AND y.measure = c.measure
    LEFT JOIN n ON n.measure = c.measure LEFT JOIN g ON g.measure = c.measure)
SELECT claim, kind, measure, found, CASE kind WHEN 'within noise' THEN noise WHEN 'at most' THEN most END AS allowed,
  CASE kind WHEN 'within noise' THEN abs(found) <= noise WHEN 'below' THEN found < 0 WHEN 'above' THEN found > 0 ELSE found <= most END AS holds FROM f""",
)
def run_findings(spark, sf_dir):
    """Claims about the runs, over the noise that two pairs of like runs show."""
    measured = compare.long_form(typed_runs(spark, sf_dir), "run_key", MEASURES)
    return compare.judge_claims(measured, CLAIMS, REPEATS)


@REGISTRY.add(
    "monotonic_claims",
    f"""WITH {INTERVAL_SQL}, l AS (SELECT *, lag(data_files) OVER w AS f, lag(avg_data_file_bytes) OVER w AS b,
     lag(seconds_to_visible) OVER w AS s FROM layout WINDOW w AS (ORDER BY interval_seconds))
   SELECT 'data_files never rises along interval_seconds' AS claim, bool_and(coalesce(data_files <= f, true)) AS holds, count(*) AS runs FROM l
   UNION ALL SELECT 'avg_data_file_bytes never falls along interval_seconds', bool_and(coalesce(avg_data_file_bytes >= b, true)), count(*) FROM l
   UNION ALL SELECT 'seconds_to_visible never falls along interval_seconds', bool_and(coalesce(seconds_to_visible >= s, true)), count(*) FROM l""",
)
def monotonic_claims(spark, sf_dir):
    """A longer interval: never more files, never smaller ones, never fresher."""
    runs = interval_runs(spark, sf_dir)
    claims = [("data_files", False), ("avg_data_file_bytes", True), ("seconds_to_visible", True)]
    return evidence.union_facts([
        compare.monotone(runs, "interval_seconds", column, rising) for column, rising in claims
    ])


@REGISTRY.add(
    "ordered_runs",
    f"""WITH {INTERVAL_SQL} SELECT string_agg(interval_seconds || ' seconds gave ' || commits || ' commits', ', ' ORDER BY interval_seconds) AS listing FROM layout""",
)
def ordered_runs(spark, sf_dir):
    """The runs in order as one sentence."""
    text = F.concat(
        F.col("interval_seconds").cast("string"), F.lit(" seconds gave "),
        F.col("commits").cast("string"), F.lit(" commits"),
    )
    return compare.ordered_listing(interval_runs(spark, sf_dir), "interval_seconds", text)


@REGISTRY.add(
    "zero_event_bound",
    """WITH k AS (SELECT event_type, count(*) AS trials, CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS worst FROM events GROUP BY 1)
   SELECT event_type, trials, worst, round(1 - pow(0.05, 1.0 / trials), 9) AS bound FROM k""",
)
def zero_event_bound_plan(spark, sf_dir):
    """What no duplicate in so many trials says about the next one."""
    events = read(spark, sf_dir, "events")
    per_seq = events.groupBy("event_type", "event_id").agg(F.count(F.lit(1)).alias("n"))
    runs = per_seq.groupBy("event_type").agg(
        F.sum("n").alias("trials"), (F.sum("n") - F.count(F.lit(1))).alias("worst")
    )
    return runs.withColumn("bound", F.round(zero_event_bound(F.col("trials")), 9))


@REGISTRY.add(
    "published_runs",
    f"""WITH {RUNS_SQL}, r AS (SELECT 'run:' || run_key AS tag,
     '| `' || run_key || '` | ' || commits || ' | ' || format('{{:,}}', data_files) || ' | ' || format('{{:,}}', avg_data_file_bytes)
       || ' | ' || format('{{:.1f}}', seconds_to_visible) || ' s |' AS text FROM runs),
   p AS (SELECT 'total:rows' AS tag, 'a feed of ' || format('{{:,}}', CAST(sum(rows) AS BIGINT)) || ' events in '
       || CASE count(*) WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 5 THEN 'five'
          ELSE format('{{:,}}', count(*)) END || ' runs' AS text FROM runs),
   q AS (SELECT 'factor:data_bytes' AS tag, 'view wrote ' || format('{{:.1f}}', max(data_bytes) FILTER (run_key = 'view') / max(data_bytes) FILTER (run_key = 'click')) || ' times the bytes of click' AS text FROM runs)
   SELECT * FROM r UNION ALL SELECT * FROM p UNION ALL SELECT * FROM q""",
)
def published_runs(spark, sf_dir):
    """Table rows and sentences derived again from the runs."""
    runs = typed_runs(spark, sf_dir)
    rows = evidence.facts(
        runs, F.concat(F.lit("run:"), F.col("run_key")),
        evidence.table_row(
            F.concat(F.lit("`"), F.col("run_key"), F.lit("`")), F.col("commits"),
            thousands(F.col("data_files")), thousands(F.col("avg_data_file_bytes")),
            F.format_string("%.1f s", F.col("seconds_to_visible")),
        ),
    )
    totals = runs.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n"))
    total = evidence.facts(totals, F.lit("total:rows"), F.concat(
        F.lit("a feed of "), thousands(F.col("rows")), F.lit(" events in "),
        number_word(F.col("n")), F.lit(" runs"),
    ))
    factor = published.lines(
        published.ratio(runs, "run_key", "data_bytes", of="view", to="click"),
        "factor:data_bytes", "view wrote {times:.1f} times the bytes of click",
    )
    return evidence.union_facts([rows, total, factor])


@REGISTRY.add(
    "published_timeline",
    f"""WITH {SAMPLES_SQL}, b AS (SELECT run, max(seconds) FILTER (checkpoint_id <= 11) AS last_frozen,
     min(seconds) FILTER (checkpoint_id > 11) AS first_clear, min(rows_visible) FILTER (checkpoint_id <= 11) AS frozen_rows,
     max_by(rows_visible, seconds) - min(rows_visible) FILTER (checkpoint_id <= 11) AS lump FROM samples GROUP BY run)
   SELECT 'timeline:' || format('{{:.1f}}', seconds) AS tag, '| ' || format('{{:.1f}}', seconds) || ' | ' || checkpoint_id || ' | ' || job_state
     || ' | ' || coalesce(format('{{:,}}', consumer_lag), 'unknown') || ' | ' || format('{{:,}}', rows_visible) || ' |' AS text FROM samples
   UNION ALL SELECT 'freeze:' || run, 'no row beyond ' || format('{{:,}}', frozen_rows) || ' at ' || format('{{:.1f}}', last_frozen)
     || ' s, and ' || format('{{:,}}', lump) || ' more by ' || format('{{:.1f}}', first_clear) || ' s'
   FROM b WHERE last_frozen IS NOT NULL AND first_clear IS NOT NULL""",
)
def published_timeline(spark, sf_dir):
    """Every sample as a published row, every freeze as a sentence."""
    seen = samples_by_hour(spark, sf_dir)
    ends = samples.freeze_bounds(seen, ["run"]).join(samples.freeze_window(seen, ["run"]), "run").withColumn(
        "frozen_rows", F.col("rows_while_frozen")[0]
    )
    return evidence.union_facts([
        published.lines(
            seen, "timeline:{seconds:.1f}",
            "| {seconds:.1f} | {checkpoint_id} | {job_state} | {consumer_lag:,|unknown} | {rows_visible:,} |",
        ),
        published.lines(
            ends.where("last_frozen IS NOT NULL AND first_clear IS NOT NULL"), "freeze:{run}",
            "no row beyond {frozen_rows:,} at {last_frozen:.1f} s, and {rows_in_one_lump:,} more by {first_clear:.1f} s",
        ),
    ])


@REGISTRY.add(
    "published_intervals",
    f"""WITH {INTERVAL_SQL} SELECT 'interval:' || interval_seconds AS tag, '| ' || interval_seconds || ' s | ' || commits || ' | '
   || data_files || ' | ' || format('{{:.1f}}', files_per_commit) || ' | ' || format('{{:,}}', avg_data_file_bytes) || ' | '
   || format('{{:.1f}}', seconds_to_visible) || ' s |' AS text FROM layout""",
)
def published_intervals(spark, sf_dir):
    return published.lines(
        interval_runs(spark, sf_dir), "interval:{interval_seconds}",
        "| {interval_seconds} s | {commits} | {data_files} | {files_per_commit:.1f} | {avg_data_file_bytes:,} | {seconds_to_visible:.1f} s |",
    )


@REGISTRY.add(
    "published_transactions",
    f"""WITH {TIMEOUT_SQL}, r AS (SELECT run_key, timeout_ms, CAST(sum(n) AS BIGINT) AS written,
     CAST(coalesce(sum(n) FILTER (state = 'CompleteCommit'), 0) AS BIGINT) AS readable FROM timed GROUP BY ALL)
   SELECT 'transactions:' || run_key AS tag, '| ' || format('{{:,}}', timeout_ms) || ' ms | ' || format('{{:,}}', written)
     || ' | ' || format('{{:,}}', readable) || ' | ' || format('{{:,}}', written - readable) || ' |' AS text FROM r
   UNION ALL SELECT 'margin:' || run_key, (10368000000 // timeout_ms) || ' whole timeouts in 2880h' FROM r WHERE 10368000000 >= timeout_ms""",
)
def published_transactions(spark, sf_dir):
    """Written, readable and never visible under either timeout."""
    readable = F.sum(F.when(F.col("state") == isolation.COMMITTED, F.col("n")).otherwise(0))
    runs = timed_transactions(spark, sf_dir).groupBy("run_key", "timeout_ms").agg(
        F.sum("n").alias("written"), readable.alias("readable")
    ).withColumn("unseen", F.col("written") - F.col("readable"))
    times = F.call_function("div", duration_ms(F.lit("2880h")), F.col("timeout_ms"))
    return evidence.union_facts([
        published.lines(
            runs, "transactions:{run_key}", "| {timeout_ms:,} ms | {written:,} | {readable:,} | {unseen:,} |"
        ),
        published.lines(
            runs.withColumn("times", times).where("times >= 1"), "margin:{run_key}", "{times} whole timeouts in 2880h"
        ),
    ])


@REGISTRY.add(
    "published_restarts",
    """WITH replayed AS (SELECT event_id AS seq, user_id AS key FROM events
     UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'signup'),
   c AS (SELECT 'at-least-once' AS mode, 'append' AS w, count(*) AS rows, count(*) - count(DISTINCT seq) AS ds, count(*) - count(DISTINCT key) AS dk,
       'duplicate rows' AS prediction, count(*) > count(DISTINCT seq) AS held FROM replayed
     UNION ALL SELECT 'at-least-once', 'upsert on user_id', count(DISTINCT key), 0, 0, 'no duplicates, idempotent by key', true FROM replayed
     UNION ALL SELECT 'exactly-once', 'append', count(*), count(*) - count(DISTINCT event_id), count(*) - count(DISTINCT user_id), 'no duplicates', count(*) = count(DISTINCT event_id) FROM events
     UNION ALL SELECT 'exactly-once', 'upsert on user_id', count(DISTINCT user_id), 0, 0, 'no duplicates', true FROM events)
   SELECT 'restart:' || mode || ':' || w AS tag, '| ' || mode || ' | ' || w || ' | ' || format('{:,}', rows) || ' | ' || format('{:,}', ds) || ' | '
     || format('{:,}', dk) || ' | ' || prediction || ' | ' || CASE WHEN held THEN 'as predicted' ELSE 'not as predicted' END || ' |' AS text FROM c""",
)
def published_restarts(spark, sf_dir):
    """Four configurations of one feed, the unguarded ones with a replay in it."""
    rows = feed(spark, sf_dir).select("seq", "key", "source")
    twice = rows.unionByName(rows.where(F.col("source") == "signup"))

    def landed(table, mode, upsert, prediction):
        held = audit.latest_per_key(table, "key", "seq") if upsert else table
        counts = audit.side_by_side(audit.seq_counts(held), audit.key_counts(held, "key").drop("rows"))
        return counts.select(
            F.lit(mode).alias("mode"), F.lit(prediction).alias("prediction"),
            F.lit(upsert).alias("upsert"), F.lit("upsert on user_id" if upsert else "append").alias("write"),
            F.lit(prediction == "duplicate rows").alias("predicts_duplicates"),
            "rows", "duplicate_seq_rows", "duplicate_key_rows",
        )

    runs = evidence.union_facts([
        landed(twice, "at-least-once", False, "duplicate rows"),
        landed(twice, "at-least-once", True, "no duplicates, idempotent by key"),
        landed(rows, "exactly-once", False, "no duplicates"),
        landed(rows, "exactly-once", True, "no duplicates"),
    ])
    return published.lines(
        audit.prediction_verdict(runs), "restart:{mode}:{write}",
        "| {mode} | {write} | {rows:,} | {duplicate_seq_rows:,} | {duplicate_key_rows:,} | {prediction} | {prediction_held:as predicted/not as predicted} |",
    )


@REGISTRY.add(
    "results_merge",
    """WITH old AS (SELECT o_custkey AS part, count(*) AS rows, max(o_totalprice) AS worst FROM orders GROUP BY 1),
   new AS (SELECT o_custkey AS part, count(*) AS rows, CAST(NULL AS DOUBLE) AS worst FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
   SELECT * FROM new UNION ALL SELECT * FROM old WHERE part NOT IN (SELECT part FROM new)""",
)
def results_merge(spark, sf_dir):
    """Parts measured again replace, the others stay."""
    orders, path = read(spark, sf_dir, "orders"), new_dir(spark, "results")
    old = orders.groupBy(F.col("o_custkey").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("o_totalprice").alias("worst")
    )
    again = orders.where(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("worst")
    )
    write_results(old, path, ["part"])
    write_results(again, path, ["part"])
    return read_results(spark, path)


# White space as the library sees it, in RE2's words.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CLAIMS_SQL = f"""claims AS (SELECT item_id AS tag, trim(regexp_replace(text, '{BLANK}', ' ', 'g')) AS claim FROM benchmark),
texts AS (SELECT trim(regexp_replace(text, '{BLANK}', ' ', 'g')) AS body FROM documents),
checked AS (SELECT tag, EXISTS (SELECT 1 FROM texts WHERE contains(body, claim)) AS found FROM claims)"""


def checked_claims(spark, sf_dir):
    claims = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("tag"), "text")
    return evidence.find_claims(claims, read(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.add("claims_check", f"WITH {CLAIMS_SQL} SELECT tag, found FROM checked")
def claims_check(spark, sf_dir):
    """Does each benchmark text stand verbatim in some document?"""
    return checked_claims(spark, sf_dir)


@REGISTRY.add(
    "claims_report",
    f"""WITH {CLAIMS_SQL} SELECT count(*) AS derived, count(*) FILTER (found) AS found,
    count(*) FILTER (NOT found) AS missing FROM checked""",
)
def claims_report(spark, sf_dir):
    """Derived, found, missing."""
    return evidence.claims_report(checked_claims(spark, sf_dir))


NOISE = ["worthless", "|"]


@REGISTRY.add(
    "clean_lines",
    """SELECT doc_id, coalesce(array_to_string(list_filter(string_split_regex(regexp_replace(text, '\\x1b\\[[0-9;]*m', '', 'g'),
      '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'),
      lambda l: regexp_matches(l, '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')
        AND NOT contains(l, 'worthless') AND NOT contains(l, '|')), chr(10)), '') AS cleaned FROM documents""",
)
def clean_lines(spark, sf_dir):
    """Whole texts without blank lines, colour codes and lines with noise words."""
    return read(spark, sf_dir, "documents").select(
        "doc_id", lines.clean_lines(F.col("text"), NOISE).alias("cleaned")
    )


@REGISTRY.add(
    "failure_causes",
    """SELECT event_id, CASE WHEN value < 20 THEN 'timeout of ' || user_id ELSE 'error ' || event_id END AS cause
   FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 5""",
)
def failure_causes(spark, sf_dir):
    """The first five failures, by name or first line of the trace (O3)."""
    name = F.when(F.col("value") < 20, F.concat(F.lit("timeout of "), F.col("user_id"))).otherwise("")
    trace = F.concat(F.lit("error "), F.col("event_id"), F.lit("\n at "), F.col("props"))
    failures = read(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        "event_id", name.alias("exception_name"), trace.alias("stacktrace")
    )
    return lines.failure_causes(failures, "event_id")


@REGISTRY.add(
    "squashed_text",
    f"SELECT doc_id, trim(regexp_replace(text, '{BLANK}', ' ', 'g')) AS flat FROM documents",
)
def squashed_text(spark, sf_dir):
    """Whole texts with every run of white space as one blank."""
    return read(spark, sf_dir, "documents").select("doc_id", squash_whitespace(F.col("text")).alias("flat"))
