"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from ledgerline.plans import audit, audit_oracle, catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_the_catalogue_is_whole():
    assert len(audit.CATALOGUE) == 69
    assert set(audit.CATALOGUE) == set(audit_oracle.SQL)


def test_a_missing_parameter_is_refused(spark):
    with pytest.raises(ValueError, match="batch_id"):
        audit.CATALOGUE["match_volume_summary"].run({}, {})
