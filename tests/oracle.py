"""Run registered queries next to their SQL and compare the rows.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(spark_df, connection, sql: str) -> list[str]:
    cursor = connection.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    wanted = normal(expected_columns, cursor.fetchall())
    got = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if wanted[0] != got[0]:
        return [f"columns {got[0]} but the SQL gives {wanted[0]}"]
    problems = []
    if len(wanted[1]) != len(got[1]):
        problems.append(f"{len(got[1])} rows but the SQL gives {len(wanted[1])}")
    if wanted[1] != got[1]:
        only_got, only_wanted = set(got[1]) - set(wanted[1]), set(wanted[1]) - set(got[1])
        problems.append(f"{len(only_got)} rows differ; spark {sorted(only_got)[:2]} sql {sorted(only_wanted)[:2]}")
    return problems


def main(sf_dir: str, names: list[str]) -> int:
    from tests.conftest import make_session
    from __spark_entry__ import oracle_sql, queries

    spark, connection, failed = make_session(), connect(sf_dir), []
    chosen = {n: q for n, q in queries().items() if not names or n in names}
    for name, run in chosen.items():
        start = time.time()
        try:
            df = run(spark, sf_dir)
            sql = oracle_sql().get(name)
            problems = differences(df, connection, sql) if sql else ([] if df.count() else ["no rows"])
            kind = "sql" if sql else "rows"
        except Exception as error:
            kind, problems = "error", [str(error)[:600], traceback.format_exc()[-300:]]
        print(f"{'ok ' if not problems else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s {' '.join(problems)}", flush=True)
        failed += [name] if problems else []
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(directory, sys.argv[2:]))
