"""Runs queries next to their SQL on the same Parquet files and compares the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import TABLES  # noqa: E402

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def duck(folder: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


KIND = {int: "int", bool: "bool", float: "float", str: "str"}


def compare(spark_cols, spark_rows, sql_cols, sql_rows) -> str:
    a_cols, a = canon(spark_cols, spark_rows)
    b_cols, b = canon(sql_cols, sql_rows)
    if a_cols != b_cols:
        return f"columns differ: {a_cols} vs {b_cols}"
    if len(a) != len(b):
        return f"rows differ: {len(a)} vs {len(b)}; e.g. {[r for r in a if r not in set(b)][:2]} | {[r for r in b if r not in set(a)][:2]}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ in {a_cols}: {bad[:2]}"
    for i, name in enumerate(a_cols):
        ka = {KIND.get(type(r[i]), type(r[i]).__name__) for r in a if r[i] is not None}
        kb = {KIND.get(type(r[i]), type(r[i]).__name__) for r in b if r[i] is not None}
        if ka != kb:
            return f"type of {name}: {ka} vs {kb}"
    return ""


def main(names):
    import __spark_entry__ as entry
    from millrace.session import local_session

    spark = local_session()
    con = duck()
    queries, oracles = entry.queries(), entry.oracle_sql()
    todo = [n for n in queries if not names or n in names or any(queries[n].__module__ == m for m in names)]
    if names and names[0].startswith("@"):
        import importlib

        from millrace.plans import registry

        module = names[0][1:]
        todo = [n for n in queries if registry.SOURCE.get(n, "").endswith(module)]
    bad, slow = 0, []
    for name in todo:
        start = time.time()
        try:
            df = queries[name](spark, SF)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if took > 4:
                slow.append((name, round(took, 1)))
            if name in oracles:
                cur = con.execute(oracles[name])
                cols = [d[0] for d in cur.description]
                msg = compare(df.columns, rows, cols, cur.fetchall())
            else:
                msg = ""
            if msg:
                bad += 1
                print(f"FAIL {name}: {msg[:900]}", flush=True)
            elif not rows:
                print(f"EMPTY {name}", flush=True)
            elif os.environ.get("VERBOSE"):
                print(f"ok {name} rows={len(rows)} {took:.1f}s {rows[0]}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:700]}", flush=True)
    print(f"{len(todo)} queries, {bad} bad, {sum(n in oracles for n in todo)} with SQL; slow: {slow}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
