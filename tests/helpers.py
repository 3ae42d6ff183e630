"""Rows of a Spark result and of DuckDB SQL, in one comparable form."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def rows(df, cols=None) -> list[tuple]:
    pdf = df if isinstance(df, pd.DataFrame) else df.toPandas()
    cols = cols or sorted(pdf.columns)

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 9) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else str(v)

    return sorted((tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False)), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con
