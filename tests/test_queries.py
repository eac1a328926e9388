"""Every query against its SQL; those without SQL must give rows."""

import duckdb
import pytest

from quillspark.plans import registry
from tests.oracle import DATA, compared


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    sql = registry.oracle_sql().get(name)
    if sql:
        compared(spark, registry.queries()[name], sql)
    else:
        assert registry.queries()[name](spark, DATA).count() > 0


def test_set_jaccard_of_nulls_and_all_words(spark, tmp_path):
    values = "(1, NULL, NULL), (2, 'a', NULL), (3, NULL, 'A'), (4, '', ''), (5, 'zeta small', 'SMALL ZETA X'), (6, 'a a b', 'A'), (7, ' a ', 'A  B ')"
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) t(p_partkey, p_name, p_type)) TO '{tmp_path}/part.parquet'")
    query = registry.queries()["set_jaccard"]
    assert compared(spark, query, registry.oracle_sql()["set_jaccard"], str(tmp_path)) == 7
    got = {r.p_partkey: r.jaccard for r in query(spark, str(tmp_path)).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: 1.0, 5: 0.666667, 6: 0.5, 7: 0.666667}
