"""Runs registered queries against their SQL in DuckDB and reports differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, connection, name: str, sf_dir: str, query, sql: str) -> str | None:
    """None if both engines agree, else the first thing they disagree on."""
    frame = query(spark, sf_dir)
    mine = rows_of(frame.columns, frame.collect())
    cursor = connection.execute(sql)
    columns = [item[0] for item in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} / {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows / {len(theirs)} rows"
    for left, right in zip(mine, theirs):
        if left != right:
            return f"\n  spark {left}\n  duck  {right}"
    return None


if __name__ == "__main__":
    from comarca.session import local_session
    from workload.oracles import SQL
    from workload.queries import REGISTRY

    folder = sys.argv[1]
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else list(REGISTRY)
    session = local_session()
    database = duck(folder)
    for key in wanted:
        start = time.time()
        try:
            found = difference(session, database, key, folder, REGISTRY[key], SQL[key]) if key in SQL else "no SQL"
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{key:24s} {time.time() - start:6.2f}s  {'ok' if found is None else found}", flush=True)
