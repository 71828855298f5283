"""Run registered queries beside their SQL twins: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9) + 0.0
    return value


def normal_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir: str, name: str, function, sql: str | None) -> list[str]:
    """What differs between the Spark result and the SQL result; empty when they agree."""
    frame = function(spark, sf_dir)
    ours = [tuple(r) for r in frame.collect()]
    if sql is None:
        return [] if ours else ["no rows"]
    cursor = con.execute(sql)
    columns = [(c[0], str(c[1])) for c in cursor.description]
    theirs = cursor.fetchall()
    found = []
    if sorted(frame.columns) != sorted(c for c, _ in columns):
        return [f"columns {sorted(frame.columns)} and {sorted(c for c, _ in columns)}"]
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
             "INTEGER": "int"}
    types = dict(frame.dtypes)
    for column, kind in columns:
        if kinds.get(kind, kind) != types[column]:
            found.append(f"type of {column}: {types[column]} and {kind}")
    a = normal_rows(frame.columns, ours)
    b = normal_rows([c for c, _ in columns], theirs)
    if len(a) != len(b):
        found.append(f"rows {len(a)} and {len(b)}")
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), None)
        found.append(f"values, first {str(first)[:400]}")
    if not a:
        found.append("no rows")
    return found


def main(sf_dir: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from engram.session import local_session

    spark, con = local_session(), duck(sf_dir)
    known, twins = queries(), oracle_sql()
    bad = 0
    for name in names or known:
        start = time.time()
        try:
            found = differences(spark, con, sf_dir, name, known[name], twins.get(name))
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        mark = "ok  " if not found else "DIFF"
        kind = "" if name in twins else "(rows only)"
        print(mark, name, kind, f"{time.time() - start:.1f}s", *found, flush=True)
    print(f"{bad} of {len(names or known)} differ")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
