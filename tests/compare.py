"""Run queries beside their SQL and compare the rows as multisets.

``python tests/compare.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, int):
        return value
    return round(float(value), 6) if type(value).__name__ == "Decimal" else str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def compare(spark, con, name: str, folder: str) -> tuple[int, str]:
    """Number of rows and the difference found, empty when there is none."""
    from citemill.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return sum(ours.values()), ""
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return sum(ours.values()), f"columns {sorted(df.columns)} <> {sorted(columns)}"
    if ours == theirs:
        return sum(ours.values()), ""
    extra, lacking = ours - theirs, theirs - ours
    return sum(ours.values()), (
        f"{sum(extra.values())} extra {list(extra)[:2]}, {sum(lacking.values())} lacking {list(lacking)[:2]}"
    )


def main() -> int:
    from citemill.catalog import ORACLES, QUERIES
    from citemill.session import build_session

    folder, *names = sys.argv[1:]
    spark = build_session(
        "compare", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(folder), 0
    for name in names or QUERIES:
        started = time.time()
        try:
            n, difference = compare(spark, con, name, folder)
        except Exception as error:
            n, difference = -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(difference)
        kind = "sql" if name in ORACLES else "rows only"
        print(f"{'BAD' if difference else 'ok '} {name} {n} {kind} {time.time() - started:.1f}s {difference[:900]}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
