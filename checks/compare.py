"""Run the registered queries and their SQL on one folder and compare the rows.

    python -m checks.compare [folder] [query …]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

from checks.oracle import ORACLE
from checks.queries import QUERIES
from echolane.session import build_session


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in a fixed order."""
    df = df[sorted(df.columns)]
    for column in df.columns:
        if str(df[column].dtype) in ("Int64", "Int32", "float32", "Float64"):
            df = df.assign(**{column: df[column].astype("float64")})
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True) if len(df.columns) else df


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs first between the two, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    got, want = normal(got), normal(want)
    for column in got.columns:
        left, right = got[column], want[column]
        if str(left.dtype) != str(right.dtype) and len(left):
            kinds = {str(left.dtype)[:3], str(right.dtype)[:3]}
            if not kinds <= {"obj", "str"}:
                return f"{column}: {left.dtype} against {right.dtype}"
        unequal = ~((left == right) | (left.isna() & right.isna()))
        if unequal.any():
            i = unequal.idxmax()
            return f"{column}, row {i}: {got.loc[i].to_dict()} against {want.loc[i].to_dict()} ({unequal.sum()} rows)"
    return None


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = build_session(
        "compare",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    failures = 0
    for name, query in QUERIES.items():
        if names and name not in names:
            continue
        try:
            begin = time.time()
            got = query(spark, folder).toPandas()
            mid = time.time()
            want = con.execute(ORACLE[name]).df() if name in ORACLE else None
            end = time.time()
            problem = difference(got, want) if want is not None else None
        except Exception as error:  # report and go on with the next query
            problem, mid, end, got = str(error)[:1500] or traceback.format_exc(), time.time(), time.time(), pd.DataFrame()
        failures += problem is not None
        verdict = "FAIL" if problem else ("ok" if name in ORACLE else "rows")
        print(f"{verdict:5}{name:26}{len(got):9} rows {mid - begin:7.2f} s, sql {end - mid:6.2f} s  {problem or ''}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
