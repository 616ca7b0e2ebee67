"""Every registered query that SQL can express against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import canonical

FOLDER = Path("/root/testdata/sf0.001")
#: Rows that strikes of several kinds meet in do not occur in the smallest tables.
LARGER = FOLDER.parent / "sf0.01"
ON_LARGER = ["strike_totals", "cheat_report", "cheat_summary", "cheat_join"]
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for folder in (FOLDER, LARGER):
        connection.execute(f'CREATE SCHEMA "{folder.name}"')
        for file in folder.glob("*.parquet"):
            connection.execute(f"CREATE VIEW \"{folder.name}\".{file.stem} AS SELECT * FROM '{file}'")
    return connection


def compare(spark, db, name, folder):
    db.execute(f"SET schema = '\"{folder.name}\"'")
    got = entry.queries()[name](spark, str(folder)).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    compare(spark, db, name, FOLDER)


@pytest.mark.parametrize("name", ON_LARGER)
def test_query_equals_sql_on_larger_tables(spark, db, name):
    compare(spark, db, name, LARGER)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
