"""Every query of the catalogue against its SQL; those without one against expectations of their own."""

from __future__ import annotations

import pytest
from echolens import catalogue
from oracle import assert_same
from pyspark.sql import SparkSession


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark: SparkSession, small: str, name: str) -> None:
    assert_same(catalogue.QUERIES[name](spark, small), catalogue.ORACLE_SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark: SparkSession, small: str, name: str) -> None:
    df = catalogue.QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_flagship_is_registered() -> None:
    assert catalogue.FLAGSHIP in catalogue.QUERIES
