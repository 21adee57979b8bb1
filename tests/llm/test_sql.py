import pytest

from marketrisk.llm import queries
from tests.compare import TESTDATA, connect, fetch_duck, fetch_spark


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    sf_dir = str(TESTDATA / "sf0.001")
    columns, _, got = fetch_spark(queries.QUERIES[name](spark, sf_dir))
    wanted_columns, _, want = fetch_duck(connect(sf_dir), queries.ORACLE[name])
    assert columns == wanted_columns
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
