"""Every registered query runs; those with SQL twins give the same rows as DuckDB."""

from __future__ import annotations

import pytest

from docsieve.plans import catalogue, reports, structure, upkeep  # noqa: F401
from tests.compare import oracle_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    got = spark_rows(catalogue.QUERIES[name](spark, sf_dir))
    assert len(set(got[0])) == len(got[0])
    if name in catalogue.ORACLE_SQL:
        assert got == oracle_rows(catalogue.ORACLE_SQL[name], sf_dir)
