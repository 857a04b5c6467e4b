"""Replay without a row per plan and bar."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from flowmill.operators import replay as R
from flowmill.plans.bar_queries import feat
from flowmill.plans.tracker_queries import replayed

D = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_replay_moves_events_once_and_bars_never(spark):
    p = plan(replayed(spark, D))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1 and "Join" not in p.replace("BroadcastHashJoin", "") and "Generate" not in p


def test_all_forms_of_replay_agree(spark):
    f = feat(spark, D)
    way, bucket = F.when(F.col("i") % 20 < 10, "LONG").otherwise("SHORT"), F.when(F.col("i") % 3 == 0, "91+").otherwise("8-30")
    marked = f.withColumns({"direction": way, "bucket": bucket})
    per_bar = R.replay_bars(marked).orderBy("ticker", "i").collect()
    apart = R.replay(R.plans_from(marked.select("ticker", "i", "direction", "bucket"), f), f).orderBy("ticker", "i").collect()
    by_date = R.replay_board(marked.select("ticker", "date", "direction", "bucket"), f).orderBy("ticker", "i").collect()
    assert len(per_bar) > 1000 and per_bar == apart == by_date


def test_a_plan_that_holds_longer_is_refused(spark):
    f = feat(spark, D).filter("ticker = 'S1'")
    p = R.plans_from(f.select("ticker", "i", F.lit("LONG").alias("direction"), F.lit("91+").alias("bucket")), f)
    with pytest.raises(Exception, match="holds more than"):
        R.replay(p.withColumn("max_hold", F.lit(R.LONGEST + 1)), f).collect()


def test_board_and_its_outcomes_move_events_only(spark):
    from flowmill.plans.tracker_queries import board, graded

    assert plan(board(spark, D)).count("REPARTITION_BY_NUM") == 1
    for df, most in ((board(spark, D), 1), (graded(spark, D), 2)):
        moved = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df)) if "ticker" in x]
        assert len(moved) <= most and "SortMergeJoin" not in plan(df)
