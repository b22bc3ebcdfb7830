"""Every registered query of the variant library against its SQL in DuckDB at sf0.001."""

import os

import duckdb
import pandas as pd
import pytest

from helixspark.plans import registry

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "supplier", "orders", "events", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(str, (tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x for x in r) for r in d[columns].itertuples(index=False))))
    assert rows(got) == rows(want)
