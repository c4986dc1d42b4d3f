"""Run registered queries and their SQL side by side and report differences."""

from __future__ import annotations

import sys
import tempfile
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when both sides agree on columns, types by name, and rows."""
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ, first {sorted(names)}: {wrong[0][0]} != {wrong[0][1]}"
    kinds = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    sql_kinds = {r[0]: r[1] for r in connection.execute(f"describe {sql}").fetchall()}
    names_of = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    }
    odd = {n: (k, sql_kinds[n]) for n, k in kinds.items() if names_of.get(k) != sql_kinds[n]}
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tillsight.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("8", shared=tempfile.mkdtemp(prefix="compare-"))
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(sf_dir)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                result = difference(df, connection, oracles[name])
            else:
                result = f"no sql, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
            if wanted:
                traceback.print_exc()
        print(f"{name:32s} {time.time() - started:6.2f}s {result or 'same'}", flush=True)
