import pytest

from quern import registry
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.01"
CHECKED = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    assert differences(spark, con, SF, registry.queries()[name], registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(CHECKED)))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0
