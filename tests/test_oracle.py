"""Every registered query beside its SQL twin."""

import pytest

from compare import check, connect
from clonara.plans.catalogue import ORACLES, QUERIES
from support import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    status, note = check(spark, name, SF, con)
    assert status == "ok", note


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["dataset", "junction_aa", "score", "pos_freq", "neg_freq"]
    assert df.count() > 0
    assert QUERIES.keys() <= e.queries().keys() and ORACLES.keys() <= e.oracle_sql().keys()
