"""Every core query against its DuckDB statement on the same tables."""

import os

import oracle
import pytest

from tasselworks.plans import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
REG = registry()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", REG.names())
def test_query(spark, name):
    df = REG.build(name, spark, SF)
    if name in REG.sql:
        oracle.compare(df, REG.sql[name], SF)
    else:
        raise AssertionError("every core query has a statement")


def test_registry_refuses_twice_and_unknown():
    with pytest.raises(ValueError):
        REG.add("p7_found")(lambda s, d: None)
    with pytest.raises(KeyError):
        REG.build("nothing", None, "")
