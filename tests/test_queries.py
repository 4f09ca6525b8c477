"""Every registered query outside llm runs, and equals its SQL where it has one."""

import pytest
from compare import connection, rows

from vigil import plans

NAMES = sorted(plans.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tiny, name):
    got = plans.queries()[name](spark, tiny).toPandas()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    want = connection(tiny).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship_counts(spark, tiny):
    got = plans.queries()["boundary_events"](spark, tiny).where("zone_id = 'bay'").groupBy("kind").count().collect()
    assert {r[0]: r[1] for r in got} == {"entry": 38, "exit": 42}
