"""Every registered query against its DuckDB statement at the smallest scale."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from dossierlake.workloads.oracle import ORACLE as OWN_ORACLE
from dossierlake.workloads.queries import REGISTRY

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
VIEWS = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for view in VIEWS.split():
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{sf_dir}/{view}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(OWN_ORACLE) == set(REGISTRY) <= set(QUERIES)
    assert set(OWN_ORACLE) <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(name, spark, duck, sf_dir):
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    ours = Counter(map(tuple, result.select(*columns).collect()))
    kinds = {item[0]: str(item[1]) for item in duck.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    assert sorted(kinds) == columns
    quoted = ", ".join(f'"{column}"' for column in columns)
    theirs = Counter(duck.execute(f"SELECT {quoted} FROM ({ORACLE[name]}) q").fetchall())
    assert ours == theirs
    for column, kind in result.dtypes:
        assert kinds[column] in (TYPES[kind], '"NULL"'), (column, kind, kinds[column])


def test_entry(spark):
    row = entry.entry(spark).collect()[0]
    assert row["total"] == row["valide"] + row["fraude"] == 1500
