"""Every registered query of the engine against its SQL at the smallest scale."""

import pytest

from rippletrace.plans.queries import QUERIES, SQL
from tests.compare import connect, same
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SMALL), con, SQL[name])


def test_first_visit_is_within_the_closure(spark):
    walk = {r.file_id for r in QUERIES["first_visit_states"](spark, SMALL).collect()}
    full = {r.file_id for r in QUERIES["reached_states"](spark, SMALL).collect()}
    assert walk and walk <= full
