import os

import pytest
from oracle import FOLDER, differences

from turnloom.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLE[name]) == ([], [], 0)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
