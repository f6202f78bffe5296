"""Compare registered queries with their SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(frame, db, sql: str) -> str | None:
    """None when equal, else what differs."""
    names, mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = db.execute(sql)
    theirs_names, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != theirs_names:
        return f"columns {names} against {theirs_names}"
    if mine != theirs:
        only_mine, only_theirs = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
        return (f"{sum(mine.values())} rows against {sum(theirs.values())}\n"
                f"   only Spark: {only_mine}\n   only SQL:   {only_theirs}")
    return None


def main(sf: str, wanted: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from conftest import make_session

    import __spark_entry__ as contract

    spark, sf_dir = make_session(), f"/root/testdata/{sf}"
    db, bad = connect(sf_dir), 0
    queries, sql = contract.queries(), contract.oracle_sql()
    for name in wanted or queries:
        started = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in sql:
                wrong = compare(frame, db, sql[name])
                size = ""
            else:
                wrong, size = None, f" ({len(frame.collect())} rows, no SQL)"
        except Exception as err:  # noqa: BLE001 - a report over all queries
            wrong, size = f"{type(err).__name__}: {str(err)[:1500]}", ""
        bad += wrong is not None
        print(f"{'ok  ' if wrong is None else 'BAD '} {name} {time.time() - started:.1f}s{size}"
              + (f"\n   {wrong}" if wrong else ""), flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
