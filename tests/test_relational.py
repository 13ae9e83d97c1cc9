from __future__ import annotations

import pytest

from basinflow.plans import analytic, extended, relational
from basinflow.streaming import queries as streaming
from tests import parity


@pytest.mark.parametrize("name", sorted(relational.QUERIES))
def test_query_matches_sql(spark, name):
    parity.check(spark, relational.QUERIES[name], relational.SQL[name])


@pytest.mark.parametrize("name", sorted(analytic.QUERIES))
def test_analytic_query_matches_sql(spark, name):
    parity.check(spark, analytic.QUERIES[name], analytic.SQL[name])


@pytest.mark.parametrize("name", sorted(streaming.QUERIES))
def test_stream_matches_sql(spark, name):
    parity.check(spark, streaming.QUERIES[name], streaming.SQL[name])


@pytest.mark.parametrize("name", sorted(extended.QUERIES))
def test_extended_query_matches_sql(spark, name):
    parity.check(spark, extended.QUERIES[name], extended.SQL[name])
