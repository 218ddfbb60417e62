"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import pytest

from compare import check, connection
from tidewatch.plans import registry

registry.load()

SF = "/root/testdata/sf0.001"

# Held against plain Python in test_policy.py.
PLAIN = {"redact_documents"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    verdict = check(spark, con, SF, registry.QUERIES[name], registry.ORACLES.get(name))
    assert verdict.startswith(("same", "rows") if name in PLAIN else "same"), verdict


def test_contract():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) - set(registry.ORACLES) == PLAIN
