"""Compare registered queries with their SQL on DuckDB.

``python tests/oracle_check.py [--sf 0.01] [name ...]``
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("PANELFLOW_TESTDATA", "/root/testdata"))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"f{v:.9g}" if v != 0 else "f0"
    if isinstance(v, bool):
        return f"b{v}"
    if hasattr(v, "item"):
        return _cell(v.item())
    return f"{type(v).__name__}:{v}"


def canonical(pdf: pd.DataFrame) -> list[tuple[str, ...]]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: spark={bad[0][0]} duck={bad[0][1]}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--no-oracle", action="store_true", help="also run queries without SQL")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from panelflow.session import local_session

    spark = local_session()
    sf_dir = str(DATA / f"sf{args.sf}")
    con = duck(sf_dir)
    q, o = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in q.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        if name not in o and not (args.no_oracle or args.names):
            continue
        t = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            el = time.time() - t
            verdict = None
            if name in o:
                t = time.time()
                verdict = compare(got, con.execute(o[name]).df())
                el2 = time.time() - t
            else:
                verdict, el2 = None, 0
            empty = " EMPTY" if len(got) == 0 else ""
        except Exception as e:  # report and go on
            verdict, el, el2, got, empty = f"{type(e).__name__}: {str(e)[:600]}", time.time() - t, 0, [], ""
        failed += verdict is not None
        print(f"{'FAIL' if verdict else 'ok  '} {name:40s} {el:6.2f}s duck {el2:5.2f}s rows={len(got)}{empty} {verdict or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
