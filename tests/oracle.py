"""Order-insensitive comparison of a Spark result with its SQL twin."""

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        pdf[c] = pdf[c].map(lambda v: "<null>" if v is None or v != v else
                            str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return pdf.sort_values(list(pdf.columns), ignore_index=True)


def difference(spark_df, con, sql) -> str | None:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = normal(got), normal(want)
    if got.equals(want):
        return None
    bad = (got != want).any(axis=1)
    return f"{bad.sum()} rows differ, first:\n{got[bad].head(3)}\n{want[bad].head(3)}"
