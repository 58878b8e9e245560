"""The queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from ordina.llm.oracles import ORACLES
from ordina.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])
