import duckdb
import pytest
from conftest import SF_SMALL

from catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = [
    "clean_counts", "observer_merge", "months_since", "bin_split", "life_stage", "missing_cells", "nearest_date",
    "match_summary", "holdout_split", "count_distribution", "temporal_support", "spearman", "level_support", "diversity_summary", "holm", "ks_uniform",
    "trend_moments", "sandwich_cells", "wald_cells", "grid_means",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def text(v):
    return None if v is None else repr(float(v) + 0.0) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 70


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql_and_has_no_cross_join(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    want = sorted((tuple(text(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(text(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == want
