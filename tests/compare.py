"""Run registered queries next to their SQL in DuckDB and compare every value."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import catalog  # noqa: E402

TESTDATA = Path("/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        # tables, not views: DuckDB fails on some plans over dictionary-encoded files
        name = f"{f}/*.parquet" if f.is_dir() else f
        con.execute(f"CREATE TABLE {f.stem} AS SELECT * FROM '{name}'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0) and v.tzinfo is None:
        return v.date()
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if hasattr(v, "item"):
        return v.item()
    return v


def fetch_duck(con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    types = {names[i]: str(rel.types[i]) for i in order}
    return sorted(names), types, [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]


def fetch_spark(df):
    names = sorted(df.columns)
    types = dict(df.dtypes)
    return names, types, [tuple(plain(v) for v in r) for r in df.select(*names).collect()]


def key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float", "bool")), round(v, 5) + 0.0 if isinstance(v, float) else v)
                 if not isinstance(v, (bytes,)) else v for v in row)


def same(x, y):
    """Equal, floats to nine significant digits."""
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    return x == y


def compare(spark, con, name, sf_dir):
    """Empty string when equal, else a description of the first differences."""
    t = time.time()
    cols, types, got = fetch_spark(catalog.queries()[name](spark, sf_dir))
    spent = time.time() - t
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return ("" if got else "no rows"), spent, len(got)
    ocols, otypes, want = fetch_duck(con, sql)
    if cols != ocols:
        return f"columns differ: only spark {set(cols) - set(ocols)}, only sql {set(ocols) - set(cols)}", spent, len(got)
    if len(got) != len(want):
        return f"rows: spark {len(got)}, sql {len(want)}", spent, len(got)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [f"{c}:{types[c]}/{otypes[c]}" for c in cols if kinds.get(types[c], types[c]) != otypes[c]]
    notes = [f"types {odd}"] if odd else []
    # line rows up on the non-float columns first, so that one float difference stays one difference
    floats = [i for i, c in enumerate(cols) if types[c] == "double"]
    fixed = [i for i in range(len(cols)) if i not in floats]

    def sort_key(row):
        return tuple((row[i] is None, str(row[i])) for i in fixed) + tuple(
            (row[i] is None, row[i] if isinstance(row[i], float) else 0.0) for i in floats
        )

    got.sort(key=sort_key)
    want.sort(key=sort_key)
    bad: dict[str, list] = {}
    for a, b in zip(got, want):
        for c, x, y in zip(cols, a, b):
            if not same(x, y):
                bad.setdefault(c, []).append((x, y))
    for c, pairs in bad.items():
        notes.append(f"{c}: {len(pairs)} differ, e.g. {pairs[0]}")
    return "; ".join(notes), spent, len(got)


def main(argv):
    from marketrisk.session import build_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    spark = build_session("compare")
    sf_dir = str(TESTDATA / f"sf{sf}")
    failed = 0
    for name in catalog.queries():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            problem, spent, rows = compare(spark, connect(sf_dir), name, sf_dir)
        except Exception as e:  # report and go on with the next query
            problem, spent, rows = f"{type(e).__name__}: {str(e)[:600]}", 0.0, 0
        failed += bool(problem)
        mark = "ok " if not problem else "BAD"
        kind = "" if name in catalog.oracle_sql() else " (rows only)"
        print(f"{mark} {name}{kind} rows={rows} {spent:.2f}s {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
