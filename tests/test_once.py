import pytest

from flowmill.plans import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, most", [("jon3_latest_slice", 0), ("sta13_weight_scheme", 0), ("jon2_convergence_bonus", 0), ("jon17_watchlist_review", 1)])
def test_steps_asked_for_several_times_are_computed_once(spark, name, most):
    plan = registry.QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_suppkey" in line for line in plan.splitlines()) <= most


def test_features_of_a_ticker_are_ranked_where_the_ticker_lies(spark):
    """Bars in partitions of whole tickers are not shuffled again to be ranked by feature and ticker."""
    from flowmill.operators import stats

    b = spark.range(40).selectExpr("concat('S', id % 3) AS ticker", "id AS date", "id % 7 * 1.0D AS span", "id % 5 * 1.0D AS body", "id % 4 * 1.0D AS fwd").repartition(4, "ticker")
    r = stats.spearman(stats.unpivot(b, ["ticker", "date", "fwd"], ["span", "body"]), ["feature", "ticker"], "value", "fwd")
    assert r._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    assert r.count() == 6


@pytest.mark.parametrize("name", ["sta20_grade_stats_as_of", "agg26_grade_report"])
def test_a_plan_is_walked_once(spark, name):
    """A filter on the outcome is not moved below the walk."""
    plan = registry.QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def _longest_method(spark, df):
    """Bytes of the longest method of a plan's generated code; the JVM interprets what is longer than 8,000."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = df._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    return max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size()))


def test_generated_code_of_the_board_is_compiled(spark):
    assert _longest_method(spark, registry.QUERIES["sta20_grade_stats_as_of"](spark, D)) <= 8000


@pytest.mark.parametrize("name", ["sta16_normal_equations", "sta14_conditional_slices"])
def test_graded_rows_that_are_read_again_are_written_once(spark, name):
    plan = registry.QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_suppkey" in line for line in plan.splitlines()) == 0


def test_plans_are_not_walked_for_excess_returns_alone(spark):
    plan = registry.QUERIES["sta8_level_attribution"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
