"""Compare registered queries with their SQL: python tests/check_oracle.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(cell(row[i]) for i in order) for row in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    start = time.time()
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    names, mine = bag(df.columns, rows)
    if sql is None:
        return "rows only", f"{len(rows)} rows {took:.1f}s"
    got = con.execute(sql)
    theirs_names, theirs = bag([d[0] for d in got.description], got.fetchall())
    if names != theirs_names:
        return "COLUMNS", f"{names} vs {theirs_names}"
    if mine != theirs:
        only, other = mine - theirs, theirs - mine
        return "DIFF", f"{sum(only.values())} of {len(rows)} / {sum(theirs.values())}: {list(only)[:2]} vs {list(other)[:2]}"
    return "ok", f"{len(rows)} rows {took:.1f}s"


def main() -> int:
    import __spark_entry__ as entry
    from nestrank.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, note = compare(spark, con, sf_dir, query, oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            status, note = "ERROR", f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += status not in ("ok", "rows only")
        print(f"{status:9} {name}: {note}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
