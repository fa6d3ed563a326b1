"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle_check.py sf [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(v):
    if v is None or v is pd.NaT:
        return ("null",)
    if isinstance(v, (float, np.floating)):
        if np.isnan(v):
            return ("nan",)
        return ("num", float(v), bool(np.signbit(v) and v == 0))
    if isinstance(v, (bool, np.bool_)):
        return ("bool", bool(v))
    if isinstance(v, (int, np.integer)):
        return ("num", float(v), False)
    if isinstance(v, (list, np.ndarray, tuple)):
        return ("list", tuple(_key(x) for x in v))
    return ("str", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_key(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def type_notes(df, cursor):
    want = {d[0]: str(d[1]) for d in cursor.description}
    return [f"{n}: {k} vs {want.get(n)}" for n, k in df.dtypes if KINDS.get(k, k) != want.get(n)]


def compare(df, con, sql, notes=None):
    got = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if notes is not None:
        notes.extend(type_notes(df, cursor))
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    return None


def main():
    import __spark_entry__ as entry
    from firn.session import session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = session(
        "oracle", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, queries = oracle(folder), entry.oracle_sql(), entry.queries()
    names = sys.argv[2:] or list(queries)
    failed = 0
    for name in names:
        start, notes = time.time(), []
        try:
            df = queries[name](spark, folder)
            problem = compare(df, con, sqls[name], notes) if name in sqls else f"(no sql) rows={df.count()}"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        ok = problem is None or problem.startswith("(no sql)")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {problem or ''} {'TYPES ' + '; '.join(notes) if notes else ''}", flush=True)
    print("failed", failed, "of", len(names))


if __name__ == "__main__":
    main()
