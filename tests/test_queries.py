"""Every registered query on the smallest tables, against its SQL where it has one."""

import oracle
import pytest

import __spark_entry__ as contract

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sf_dir, db, name):
    frame = contract.queries()[name](spark, sf_dir)
    if name in SQL:
        assert oracle.compare(frame, db, SQL[name]) is None
    else:
        assert frame.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(contract.queries())


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row["complete"]
