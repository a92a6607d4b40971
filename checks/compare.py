"""Run each query and its SQL text side by side: `python -m checks.compare <folder> [names]`."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(bool)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64")
        df[c] = df[c].astype(object).where(df[c].notna(), None).map(repr)
    return df.sort_values(list(df.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        bad = a.index[a[c] != b[c]]
        if len(bad):
            return f"{len(bad)} values of {c}, first: {a.loc[bad[0]].to_dict()} != {b.loc[bad[0]].to_dict()}"
    return None


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name, fn in registered().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            mid = time.time()
            if name not in ORACLE:
                print(f"rows  {name} {len(got)} {mid - start:.1f}s", flush=True)
                continue
            result = difference(got, con.execute(ORACLE[name]).df())
        except Exception as e:  # report and go on to the next query
            result, mid = f"{type(e).__name__}: {str(e)[:900]}", time.time()
        bad += result is not None
        print(f"{'ok   ' if result is None else 'BAD  '} {name} {len(got)} rows, "
              f"{mid - start:.1f}s, oracle {time.time() - mid:.1f}s {(result or '')[:1200]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
