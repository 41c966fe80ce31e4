from __future__ import annotations

import pytest

from weft.session import local


@pytest.fixture(scope="session")
def spark():
    session = local(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def same(spark_df, duck_df) -> bool:
    """Whether two results hold the same rows, whatever their order."""

    def norm(df):
        out = df[sorted(df.columns)].copy()
        for c in out.columns:
            if str(out[c].dtype) in ("Int32", "Int64", "boolean"):
                out[c] = out[c].astype("float64")
            if out[c].dtype.kind in "fiub":
                out[c] = out[c].astype("float64").round(5) + 0.0
        out = out.astype(str).replace({"None": "", "nan": "", "<NA>": ""})
        return sorted(map(tuple, out.itertuples(index=False)))

    return sorted(spark_df.columns) == sorted(duck_df.columns) and norm(spark_df) == norm(duck_df)
