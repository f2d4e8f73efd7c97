"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare

STREAMS = [name for name in queries() if name.startswith("streamed")]
#: `audited_enrichment` runs the same job.
RUN = [name for name in STREAMS if name != "streamed_training_rows"]


@pytest.mark.parametrize("name", [name for name in queries() if name not in STREAMS])
def test_query_matches_sql(spark, name):
    verdict = compare(spark, SMALL, name)
    assert verdict.startswith("ok" if name in oracle_sql() else "no SQL"), verdict


@pytest.mark.parametrize("name", RUN)
def test_stream_matches_sql(spark, name):
    assert compare(spark, SMALL, name).startswith("ok")


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(oracle_sql()) <= set(queries())
