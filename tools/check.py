"""Run registered queries on Spark and their SQL on DuckDB, compare rows. usage: check.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from embergrid.plans import queries as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if str(pdf[c].dtype).startswith(("float", "Float")):
            pdf[c] = pdf[c].astype(float) + 0.0
        elif str(pdf[c].dtype).startswith("datetime") or (len(pdf) and hasattr(pdf[c].dropna().iloc[0] if pdf[c].notna().any() else None, "isoformat")):
            pdf[c] = pdf[c].map(lambda v: None if pd.isna(v) else str(v)[:10])
    as_text = pdf.map(lambda v: "~" if v is None or (not isinstance(v, (list, str)) and pd.isna(v)) else f"{v:.12g}" if isinstance(v, float) else str(v))
    # numbers that arrive as float on one side only because of NULLs compare as floats
    for c in pdf.columns:
        if pdf[c].dtype.kind in "iu":
            as_text[c] = pdf[c].map(lambda v: "~" if pd.isna(v) else f"{float(v):.12g}")
    return as_text.sort_values(list(as_text.columns)).reset_index(drop=True)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(registry.QUERIES)
    base = f"/root/testdata/{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{base}/{t}.parquet'")
    bad = []
    for name in names:
        t0 = time.time()
        try:
            got_df = registry.QUERIES[name](spark, base)
            got_raw = got_df.toPandas()
        except Exception as e:
            bad.append(name)
            print(f"{name:24} ERROR {str(e)[:700]}", flush=True)
            continue
        took = time.time() - t0
        if name not in registry.SQL:
            print(f"{name:24} rows={len(got_raw)} {took:.1f}s (no SQL)", flush=True)
            continue
        t0 = time.time()
        try:
            want_raw = con.execute(registry.SQL[name]).df()
        except Exception as e:
            bad.append(name)
            print(f"{name:24} SQL ERROR {str(e)[:500]}", flush=True)
            continue
        sql_took = time.time() - t0
        got, want = norm(got_raw), norm(want_raw)
        ok = list(got.columns) == list(want.columns) and len(got) == len(want) and got.equals(want)
        print(f"{name:24} {'ok ' if ok else 'DIFF'} rows={len(got)}/{len(want)} {took:.1f}s sql {sql_took:.2f}s", flush=True)
        if not ok:
            bad.append(name)
            print("   cols", list(got.columns), list(want.columns))
            if list(got.columns) == list(want.columns):
                m = got.astype(str).merge(want.astype(str), how="outer", indicator=True)
                print(m[m._merge != "both"].head(8).to_string())
        types = {c: str(t) for c, t in zip(want_raw.columns, want_raw.dtypes)}
        mine = {c: str(t) for c, t in zip(got_raw.columns, got_raw.dtypes)}
        off = {c: (mine.get(c), t) for c, t in types.items() if mine.get(c) != t}
        if off and "-t" in os.environ.get("CHECK", ""):
            print("   types", off)
    print("BAD:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
