"""The operators' queries against their SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import SMALL, database, differing  # noqa: E402

from lectern.llm import queries  # noqa: E402


@pytest.mark.skipif(not SMALL.exists(), reason="needs the small tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert differing(queries.queries()[name](spark, str(SMALL)), database(), queries.oracle_sql()[name]) == []
