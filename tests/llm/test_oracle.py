"""Queries that SQL can express, against their SQL on the given tables."""

from __future__ import annotations

import pytest

from corpusaudit.llm.queries import ORACLE, QUERIES
from tests.compare import differences, duck


def test_every_operator_has_a_query():
    # Operator 2 has two: of bytes and of token ids.
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_reference(spark, sf_dir, name):
    assert differences(spark, duck(sf_dir), QUERIES[name], ORACLE[name], sf_dir) == []
