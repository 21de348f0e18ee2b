"""Every query of the catalogue against its SQL; those without SQL have to run and give rows."""

import pytest

from docloom.plans import catalogue
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    query = catalogue.QUERIES[name]
    df = query.run(spark, SF)
    if query.sql:
        assert compare(df, SF, query.sql) == ""
    else:
        assert df.count() > 0
