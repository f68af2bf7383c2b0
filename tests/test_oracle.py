"""Every registered query against its reference SQL on the given tables."""

from __future__ import annotations

import pytest

from catalog import ORACLE, QUERIES, SURVEY

from .compare import differences, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_reference_sql_and_survey_items():
    assert set(QUERIES) == set(ORACLE) == set(SURVEY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_reference(spark, con, sf_dir, name):
    assert differences(spark, con, QUERIES[name], ORACLE[name], sf_dir) == []
