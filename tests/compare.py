"""Run registered queries against their SQL: ``python -m tests.compare [sf] [name prefix...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


# SQL type names and Spark's.
EQUAL_TYPES = {"VARCHAR": "string", "INTEGER": "int"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def difference(name: str, spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    mine = rows(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(columns)}"
    types = dict(spark_df.dtypes)
    for column, kind in [r[:2] for r in con.execute("DESCRIBE " + sql).fetchall()]:
        if EQUAL_TYPES.get(kind, kind.lower()) != types[column]:
            return f"type of {column}: {types[column]} / {kind}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, first {str(wrong[0])[:600]}"
    return None if mine else "(no rows)"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from packetloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, function in queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            problem = difference(name, df, con, sqls[name]) if name in sqls else f"(no SQL) {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        flag = "ok  " if problem is None or problem.startswith("(no ") else "BAD "
        bad += flag == "BAD "
        print(f"{flag}{name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
