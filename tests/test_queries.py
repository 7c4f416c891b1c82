import pytest
from compare import assert_same

from millrace.operators import sketches
from millrace.plans import catalog_queries, queries, registry  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), sf, registry.ORACLES[name])


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_approx_distinct_is_close(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    exact = events.select("user_id").distinct().count()
    assert abs(sketches.merge_distinct(sketches.distinct_sketch(events, ["event_type"], "user_id")).first()["n_distinct"] - exact) <= 0.05 * exact + 1
