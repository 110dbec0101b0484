import pytest
from helpers import DATA, assert_same

from maskforge import registry

QUICK = [n for n in registry.queries() if not n.startswith(("clf_", "search_", "protocol_"))]


@pytest.mark.parametrize("name", [n for n in QUICK if n in registry.oracle_sql()])
def test_same_rows_as_sql(spark, duck, name):
    assert_same(registry.queries()[name](spark, DATA), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["search_pso", "search_interval_q_full", "clf_dt", "protocol_cross_validation", "protocol_ablation"])
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["cand_id", "n_selected", "error", "fitness"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
