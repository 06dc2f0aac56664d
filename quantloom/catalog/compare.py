"""Run registered queries against DuckDB and print differences.

    python -m quantloom.catalog.compare [folder] [name-pattern ...]
"""

from __future__ import annotations

import re
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    names = sorted(left.columns)

    def norm(df: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame()
        for n in names:
            s = df[n]
            if s.dtype.kind == "f":
                out[n] = s
            elif s.dtype.kind in "iu":
                out[n] = s.astype("int64")
            else:
                out[n] = s.map(lambda v: None if v is None or v is pd.NaT else str(v)[:10] if hasattr(v, "year") else str(v))
        floats = [n for n in names if out[n].dtype.kind == "f"]
        rest = [n for n in names if n not in floats]
        return out.sort_values(rest + floats, kind="stable").reset_index(drop=True)

    a, b = norm(left), norm(right)
    problems = []
    for n in names:
        if (a[n].dtype.kind == "f") != (b[n].dtype.kind == "f"):
            x, y = pd.to_numeric(a[n], errors="coerce"), pd.to_numeric(b[n], errors="coerce")
        else:
            x, y = a[n], b[n]
        if x.dtype.kind == "f":
            same = (x == y) | (x.isna() & y.isna())
            if not same.all():
                gap = np.nanmax(np.abs(x[~same] - y[~same])) if (~same).any() else 0
                problems.append(f"{n}: {int((~same).sum())} differ, max {gap:.3g}, e.g. {x[~same].iloc[0]} vs {y[~same].iloc[0]} row {a[~same].iloc[0].to_dict()}")
        else:
            same = (x == y) | (x.isna() & y.isna())
            if not same.all():
                problems.append(f"{n}: {int((~same).sum())} differ, e.g. {x[~same].iloc[0]!r} vs {y[~same].iloc[0]!r}")
    return "; ".join(problems)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    patterns = [re.compile(p) for p in sys.argv[2:]] or [re.compile(".")]
    from quantloom.catalog import load
    from quantloom.session import local_session

    spark = local_session()
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, q in load().items():
        if not any(p.search(name) for p in patterns):
            continue
        try:
            t0 = time.time()
            table = q.run(spark, folder).toArrow()
            left = table.to_pandas(date_as_object=True)
            t1 = time.time()
            note = ""
            nan = [n for n in left.columns if left[n].dtype.kind == "f" and table[n].null_count != left[n].isna().sum()]
            if nan:
                note += f" NaN values in {nan};"
            if q.sql is None:
                print(f"ROWS {name} {len(left)} rows {t1 - t0:.1f}s{note}", flush=True)
                continue
            right_t = db.sql(q.sql).to_arrow_table()
            right = right_t.to_pandas(date_as_object=True)
            t2 = time.time()
            ltypes = {f.name: str(f.type).replace("large_", "") for f in table.schema}
            rtypes = {f.name: str(f.type).replace("large_", "") for f in right_t.schema}
            if ltypes != rtypes:
                note += f" types { {k: (ltypes[k], rtypes.get(k)) for k in ltypes if ltypes[k] != rtypes.get(k)} };"
            diff = compare(left, right)
            nulls = {n: int(left[n].isna().sum()) for n in left.columns if left[n].isna().all() and len(left)}
            if nulls:
                note += f" all-null {list(nulls)};"
            state = "ok" if not diff else "DIFF"
            bad += bool(diff)
            print(f"{state} {name} {len(left)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s{note} {diff}", flush=True)
        except Exception as error:  # report and go on
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:900]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
