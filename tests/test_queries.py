"""Every core query against its SQL; those without SQL must run."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import SMALL, database, differing  # noqa: E402

from lectern.plans import catalog  # noqa: E402

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the small tables")


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, str(SMALL))
    if name in catalog.oracle_sql():
        assert differing(df, db, catalog.oracle_sql()[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
