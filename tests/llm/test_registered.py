"""Every registered query of the subpackage against its SQL, and their schemas."""

import pytest
from oracle import compare, connect

from tapeworks.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    verdict = compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_all_operators():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))
