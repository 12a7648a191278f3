"""Run registered queries against their SQL equivalents and report differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree on column names and all rows."""
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    columns = [item[0] for item in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if got == want:
        return None
    extra = [row for row in got if row not in set(want)][:2]
    missing = [row for row in want if row not in set(got)][:2]
    return f"rows {len(got)} vs {len(want)}; only ours {extra}; only theirs {missing}"


def main() -> None:
    from context_shaper.session import local_session
    from workload.oracles import ORACLES
    from workload.queries import QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    for name in names:
        start = time.time()
        if name not in ORACLES:
            print(f"{name:28s} no SQL", flush=True)
            continue
        try:
            found = difference(spark, con, QUERIES[name], ORACLES[name], sf_dir)
        except Exception as error:  # a report over all queries, so go on
            found = f"ERROR {str(error)[:700]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {'ok' if found is None else found[:900]}", flush=True)


if __name__ == "__main__":
    main()
