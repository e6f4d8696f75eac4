"""Run registered queries beside their SQL twins and compare the rows.

python -m checks.compare [--sf DIR] [names ...]
"""

from __future__ import annotations

import argparse
import math
import time
from decimal import Decimal
from pathlib import Path

import duckdb

from checks.oracles import all_oracles
from checks.queries import QUERIES
from checks.session import local_session

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, Decimal)):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return str(v)


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def kind(dtype: str) -> str:
    d = dtype.lower()
    if any(x in d for x in ("int", "long", "hugeint")):
        return "int"
    if any(x in d for x in ("double", "float", "decimal")):
        return "float"
    if any(x in d for x in ("varchar", "string")):
        return "string"
    return "bool" if "bool" in d else d


def compare(name: str, spark, con, folder: str, oracle: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, folder)
    got = _rows(df.columns, df.collect())
    rel = con.execute(oracle)
    cols = [(d[0], str(d[1])) for d in rel.description]
    want = _rows([c for c, _ in cols], rel.fetchall())
    if sorted(df.columns) != sorted(c for c, _ in cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(c for c, _ in cols)}"
    types = dict(df.dtypes)
    odd = [(c, types[c], t) for c, t in cols if kind(types[c]) != kind(t) and want]
    if odd:
        return False, f"types {odd}"
    if got != want:
        only_got, only_want = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
        return False, f"{len(got)} vs {len(want)} rows; {sorted(df.columns)}\n   spark  {only_got[:2]}\n   oracle {only_want[:2]}"
    return True, f"{len(got)} rows"


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark, con, oracles = local_session(), oracle_connection(args.sf), all_oracles()
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            if name in oracles:
                ok, note = compare(name, spark, con, args.sf, oracles[name])
            else:
                ok, note = True, f"{QUERIES[name](spark, args.sf).count()} rows, no oracle"
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.1f}s  {note}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
