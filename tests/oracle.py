"""Compare registered queries with their SQL on the same parquet tables, as sorted rows of sorted columns.

Usage: python tests/oracle.py [--sf 0.01] [name ...]
"""

import argparse
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
ROOT = pathlib.Path("/root/testdata")
KINDS = {"bigint": "int", "int": "int", "string": "str", "boolean": "bool", "double": "float",
         "BIGINT": "int", "INTEGER": "int", "VARCHAR": "str", "BOOLEAN": "bool", "DOUBLE": "float"}


def connect(sf):
    import duckdb
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/sf{sf}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))


def compare(spark, con, name, query, sql, sf):
    """Return (ok, note). The note says what differs."""
    frame = query(spark, f"{ROOT}/sf{sf}")
    got_schema = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in frame.schema}
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return True, f"rows only: {len(got)}"
    relation = con.sql(sql)
    want_schema = {c: KINDS.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    want = rows_of(relation.columns, relation.fetchall())
    if got_schema != want_schema:
        return False, f"schema {got_schema} != {want_schema}"
    if got != want:
        missing = [r for r in want if r not in set(got)][:2] if len(want) < 300000 else []
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 300000 else []
        return False, f"{len(got)} rows vs {len(want)}; extra {extra}; missing {missing}"
    return True, f"{len(got)} rows"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from palimpsest.session import build_session
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(args.sf)
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, queries[name], oracles.get(name), args.sf)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
