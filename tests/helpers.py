import glob
import os

import pandas as pd

SF = "/root/testdata/sf0.001"


def oracle():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(plain(v) for v in row) for row in pdf.itertuples(index=False))
