"""Every registered cohort query against its SQL over the smallest given tables."""

import math
import os

import duckdb
import pytest

from isoframe.plans.bindings import TABLES
from isoframe.plans.oracles import SQL
from isoframe.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    said = con.execute(SQL[name])
    names = [d[0] for d in said.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, said.fetchall())


def test_every_query_has_sql_or_draws(spark):
    """Queries without SQL are those whose results depend on draws, fits, steps or the order of arrival; drawn ones give the same again."""
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {
        "effect_verdicts", "bootstrap_intervals", "difference_intervals", "permutation_pvalues", "risk_intervals", "two_modes", "capped_shortlist", "late_rows", "follow_up_plans",
    }
    for name in ("bootstrap_intervals", "permutation_pvalues", "capped_shortlist"):
        one, two = (sorted(map(tuple, QUERIES[name](spark, DATA).collect()), key=repr) for _ in range(2))
        assert one == two and one
