"""Side-by-side check of registered queries against their SQL on one data folder.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, canonical(v)) for k, v in sorted(value.items()))
    return value


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    data = table.select(names).to_pylist()
    return sorted((tuple(canonical(r[n]) for n in names) for r in data), key=repr)


def differences(spark_table, sql_table) -> list[str]:
    found = []
    a, b = sorted(spark_table.column_names), sorted(sql_table.column_names)
    if a != b:
        return [f"columns {a} != {b}"]
    for n in a:
        x, y = str(spark_table.schema.field(n).type), str(sql_table.schema.field(n).type)
        same = {x, y} <= {"timestamp[us, tz=UTC]", "timestamp[us]"} or x == y
        if not same and not {x, y} <= {"string", "large_string"}:
            found.append(f"type of {n}: {x} != {y}")
    left, right = rows_of(spark_table), rows_of(sql_table)
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    if left != right:
        only_spark = sorted(set(left) - set(right), key=repr)
        only_sql = sorted(set(right) - set(left), key=repr)
        found.append(
            f"{len(only_spark)} rows only in Spark, {len(only_sql)} only in SQL; columns {a}; "
            f"Spark {only_spark[:2]} SQL {only_sql[:2]}"
        )
    return found


def main() -> int:
    from catalog import oracle_sql, queries
    from knownat.session import local_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connection(sf_dir)
    sql, bad = oracle_sql(), 0
    for name, run in queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            made = run(spark, sf_dir).toArrow()
            took = time.time() - started
            if name in sql:
                found = differences(made, con.execute(sql[name]).to_arrow_table())
            else:
                found = []
        except Exception as error:  # report and go on with the next query
            took, found = time.time() - started, [f"{type(error).__name__}: {str(error)[:700]}"]
            made = None
        bad += bool(found)
        rows = made.num_rows if made is not None else 0
        nulls = {}
        if made is not None and rows:
            nulls = {
                c: made[c].null_count for c in made.column_names if made[c].null_count == rows
            }
        note = f" all-null: {list(nulls)}" if nulls else ""
        mark = "ok " if not found else "BAD"
        kind = "" if name in sql else " (rows only)"
        print(f"{mark} {name}: {rows} rows {took:.2f}s{kind}{note}", flush=True)
        for line in found:
            print("    ", line[:1500], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
