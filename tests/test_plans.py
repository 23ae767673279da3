"""Plans that must hold at scale."""

import pytest

from stocklens.plans import registry
from stocklens.sources.adapters import Tables

PYTHON_QUERIES = {"read_workbooks"}
# A checkout plans only after its allocation rounds have run.
EAGER = {"merge_cart", "merge_cart_lines", "checkout", "checkout_inventory"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - EAGER))
def test_no_cross_joins_and_no_python_in_the_way(spark, sf_dir, name):
    plan = plan_of(registry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name not in PYTHON_QUERIES:
        assert "MapInPandas" not in plan


@pytest.mark.parametrize("name", ["fast_movers", "recent_orders", "valuable_products", "category_share"])
def test_top_lists_do_not_sort_everything(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan_of(registry.queries()[name](spark, sf_dir))


def test_rank_limit_runs_before_the_shuffle(spark, sf_dir):
    plan = plan_of(registry.queries()["recently_viewed"](spark, sf_dir))
    assert plan.count("WindowGroupLimit") == 2


def test_product_facts_join_without_a_further_shuffle(spark, sf_dir):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(registry._facts(Tables(spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    after_join = plan[plan.index("FullOuter"):]
    first_lines = after_join.split("Aggregate")[0]
    assert "Exchange" not in first_lines


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    plan = plan_of(t.sql("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'"))
    assert "EqualTo(l_returnflag,N)" in plan and "ReadSchema: struct<l_partkey:bigint,l_returnflag:string>" in plan
    plan = plan_of(registry.queries()["dashboard_metrics"](spark, sf_dir))
    assert "p_name" not in plan.split("ReadSchema: ")[1]


def test_cart_merging_resolves_only_what_is_asked_for(spark, sf_dir):
    for name in ("merge_cart", "merge_cart_lines"):
        plan = plan_of(registry.queries()[name](spark, sf_dir))
        assert plan.count("Exchange hashpartitioning") <= 16 and plan.count("Scan parquet") <= 12
