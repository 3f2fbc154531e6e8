import os

import oracle
import pytest

from tasselworks.llm.queries import REGISTRY

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", REGISTRY.names())
def test_query(spark, name):
    df = REGISTRY.build(name, spark, SF)
    if name in REGISTRY.sql:
        oracle.compare(df, REGISTRY.sql[name], SF)
    else:
        # what SQL cannot say is held against brute force or unseen sentences in the operator's own tests
        assert name in {"p4_grouped_split", "p8_ids", "p10_found", "p10_scores", "p10_rates"} and df.count() > 0
