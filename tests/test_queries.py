import pytest

from oracles import same_rows
from pagewright.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(name, spark, duck, sf_dir):
    same_rows(QUERIES[name], ORACLES[name], spark, duck, sf_dir)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
