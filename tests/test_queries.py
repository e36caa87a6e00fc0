"""Every registered query of the library's own against its DuckDB oracle, on the smallest tables."""

import os

import duckdb
import pytest

from auditlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    place = {d[0]: k for k, d in enumerate(want.description)}
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(repr([plain(r[place[c]]) for c in columns]) for r in want.fetchall())
