"""Every registered reference query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from bidloom.plans import registry
from tests.compare import same_rows
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SMALL)
    if name in registry.SQL:
        same_rows(frame, duck, registry.SQL[name])
    else:
        assert frame.count() > 0


def test_entry_works_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
