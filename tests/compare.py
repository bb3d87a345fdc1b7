"""Run registered queries next to their check SQL: ``python tests/compare.py [sf_dir] [key or family ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
         "TIMESTAMP": "timestamp", "FLOAT": "float", "BLOB": "binary", "SMALLINT": "smallint", "TINYINT": "tinyint"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((norm(k), norm(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple) and len(a) == len(b):
        return all(close(x, y) for x, y in zip(a, b))
    return a == b


def compare(df, con, sql: str) -> tuple[bool, str]:
    rel = con.sql(sql)
    got = rows_of(df.collect(), df.columns)
    want = rows_of(rel.fetchall(), rel.columns)
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    notes = []
    kinds = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        have = f.dataType.simpleString().replace("timestamp_ntz", "timestamp")
        need = kinds[f.name]
        if TYPES.get(need, need.lower()) != have and not need.startswith(("DECIMAL", "STRUCT", "MAP")) and not need.endswith("[]"):
            notes.append(f"type {f.name}: {have} vs {need}")
    if len(got) != len(want):
        only = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
        return False, f"{len(got)} rows != {len(want)}; {only}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        if all(close(a, b) for a, b in diff):
            return False, f"float noise in {len(diff)} rows, e.g. {diff[0]}"
        return False, f"{len(diff)} of {len(got)} rows differ, e.g.\n   spark {diff[0][0]}\n   sql   {diff[0][1]}"
    return True, f"{len(got)} rows" + (" TYPES " + "; ".join(notes) if notes else "")


def main() -> int:
    from importlib import import_module

    from millrace import queries
    from millrace.runtime import session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    found, checks = queries.collect()
    wanted = []
    for a in args:
        wanted += list(import_module(f"millrace.queries.{a}").R.queries) if a in queries.FAMILIES else [a]
    spark = session("compare", "local[8]", spark__sql__shuffle__partitions=os.environ.get("SHUFFLE", "8"), spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for key in wanted or found:
        start = time.time()
        try:
            df = found[key](spark, sf_dir)
            if key in checks:
                ok, note = compare(df, con, checks[key])
            else:
                n = df.count()
                ok, note = n > 0, f"{n} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key:28s} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{bad} failed of {len(wanted or found)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
