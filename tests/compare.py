"""Run registered queries beside their SQL twins and report differences.

python tests/compare.py [name-prefix ...]   (SF_DIR picks the data folder)
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        col = pdf[c]
        if col.dtype == object or str(col.dtype) in ("str", "string"):
            pdf[c] = col.map(lambda v: "<null>" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v))
                             else repr([x for x in v]) if isinstance(v, (list, np.ndarray)) else str(v))
    if len(pdf):
        pdf = pdf.sort_values(list(pdf.columns), kind="mergesort")
    return pdf.reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    g, w = _canon(got), _canon(want)
    for c in g.columns:
        kg, kw = g[c].dtype.kind, w[c].dtype.kind
        if kg != kw:
            return f"column {c}: dtype {g[c].dtype} != {w[c].dtype}"
        if kg == "f":
            same = np.isclose(g[c], w[c], rtol=0, atol=1e-12, equal_nan=True)
        else:
            same = (g[c] == w[c]) | (g[c].isna() & w[c].isna())
        if not np.all(same):
            i = int(np.argmin(np.asarray(same)))
            return f"column {c}: {int((~np.asarray(same)).sum())} differ\n  got  {g.iloc[i].to_dict()}\n  want {w.iloc[i].to_dict()}"
    return None


def check(spark, name, sf_dir, con) -> tuple[str, str]:
    from clonara.plans.catalogue import ORACLES, QUERIES

    start = time.time()
    got = QUERIES[name](spark, sf_dir).toPandas()
    took = time.time() - start
    if name not in ORACLES:
        return "rows", f"{len(got)} rows {took:.2f}s"
    want = con.execute(ORACLES[name]).df()
    diff = differences(got, want)
    return ("ok" if diff is None else "DIFF"), f"{len(got)} rows {took:.2f}s" + (f" {diff}" if diff else "")


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from clonara.plans.catalogue import QUERIES
    from clonara.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    picked = [q for q in QUERIES if not sys.argv[1:] or any(q.startswith(p) for p in sys.argv[1:])]
    bad = []
    for q in picked:
        try:
            status, note = check(spark, q, sf, con)
        except Exception as e:  # report and go on with the next query
            status, note = "ERROR", f"{type(e).__name__}: {str(e)[:600]}"
        if status in ("DIFF", "ERROR"):
            bad.append(q)
        print(f"{status:5} {q}: {note}", flush=True)
    print(f"{len(picked)} checked, {len(bad)} bad: {bad}")
