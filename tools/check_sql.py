"""Run queries and their SQL counterparts side by side and compare every value.

    python tools/check_sql.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from shockwatch.plans import catalog  # noqa: E402
from shockwatch.session import build_session  # noqa: E402


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple("" if pd.isna(v) else repr(v) if isinstance(v, float)
                               else str(v) for v in row)
                         for row in frame[cols].astype(object).itertuples(index=False)))


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("prefix", nargs="*")
    opt = args.parse_args()
    folder = f"/root/testdata/sf{opt.sf}"
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false",
                                            "spark.driver.memory": "8g",
                                            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    import logging
    logging.disable(logging.CRITICAL)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if opt.prefix and not any(name.startswith(p) for p in opt.prefix):
            continue
        try:
            t = time.time()
            left = fn(spark, folder).toPandas()
            t1 = time.time() - t
            if name not in catalog.ORACLE:
                print(f"rows  {name:36s} {len(left):7d} rows {t1:6.2f}s", flush=True)
                continue
            t = time.time()
            right = con.sql(catalog.ORACLE[name]).df()
            t2 = time.time() - t
            lc, lr = rows(left)
            rc, rr = rows(right)
            kinds = [(c, left[c].dtype, right[c].dtype) for c in lc if c in rc
                     and left[c].dtype != right[c].dtype
                     and not {str(left[c].dtype), str(right[c].dtype)} <= {"object", "str"}]
            good = lc == rc and lr == rr
            bad += not good
            print(f"{'ok   ' if good else 'DIFF '} {name:36s} {len(left):7d} rows {t1:6.2f}s "
                  f"sql {t2:5.2f}s {kinds if kinds else ''}", flush=True)
            if not good:
                print("   columns", lc, rc if lc != rc else "", len(lr), len(rr))
                for side, a, b in (("spark", lr, rr), ("sql", rr, lr)):
                    seen = set(b)
                    print("   only", side, [x for x in a if x not in seen][:4])
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:600]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
