"""Every registered query of the code-corpus operators against its SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

from srcloom.plans import registry

from .support import same_as_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, name):
    same_as_sql(spark, name, SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
