"""Small frames for the finer rules: bootstrap twin, convergence bonus, decayed sums, performance, exposure, projections."""

import datetime as dt
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowmill.functions import scores as C
from flowmill.operators import flow, lab, replay, tracker
from flowmill.operators import stats as S
from flowmill.plans import registry
from flowmill.plans.tracker_queries import replayed
from flowmill.sources import tables

D = "/root/testdata/sf0.001"


def test_bootstrap_against_a_plain_one(spark):
    per = replayed(spark, D).groupBy("ticker").agg(F.sum("realized_r").alias("s"), F.count("*").alias("n")).collect()
    cuts = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582)
    means = []
    for draw in range(2000):
        seed, top, bottom = xxhash.xxh64_intdigest(draw.to_bytes(4, "little"), 42), 0.0, 0
        for r in per:
            u = xxhash.xxh64_intdigest(r["ticker"].encode(), seed) % (1 << 40) / float(1 << 40)
            w = sum(u > c for c in cuts)
            top, bottom = top + w * r["s"], bottom + w * r["n"]
        if bottom:
            means.append(top / bottom)
    got = registry.QUERIES["sta12_block_bootstrap"](spark, D).first()
    assert [got["mean"], got["low"], got["high"]] == pytest.approx([np.mean(means), np.percentile(means, 2.5), np.percentile(means, 97.5)], abs=2e-6)


def test_print_convergence(spark):
    rows = [("A", "BULLISH", 7.0), ("B", "BULLISH", 7.0), ("C", "BEARISH", 7.0), ("D", "BEARISH", 7.0), ("E", "BULLISH", 7.0), ("F", "BULLISH", None)]
    b = spark.createDataFrame(rows, "ticker string, direction string, conviction_score double")
    p = spark.createDataFrame([("A", 0.8, 20.0), ("B", 0.4, 20.0), ("C", 0.35, 10.0), ("D", 0.5, 50.0), ("F", 0.9, 2.0)], "ticker string, dp_bias double, dp_bps double")
    got = {r["ticker"]: (r["dp_aligned"], r["dp_divergent"], round(r["dp_bonus"], 4), r["conviction_score"], r["conviction_grade"]) for r in tracker.with_print_convergence(b, p, ["ticker"]).collect()}
    assert got == {"A": (True, False, 0.3, 9.1, "A+"), "B": (False, True, 0.0, 7.0, "A-"), "C": (True, False, 0.075, 7.5, "A"), "D": (False, False, 0.0, 7.0, "A-"), "E": (False, False, 0.0, 7.0, "A-"), "F": (True, False, 0.0, None, "C")}


def test_decayed_and_delta_weighted_sums(spark):
    t = dt.datetime(2024, 1, 5, 16)
    rows = [("A", 100.0, t, "LONG", 1.0, 2e8, 0.5, "vendor"), ("A", 100.0, t - dt.timedelta(hours=6), "LONG", 0.5, 2e8, 1.0, "proxy"), ("A", 80.0, t, "SHORT", 1.0, 2e8, None, "missing"), ("B", None, t, "LONG", 1.0, 5e7, 0.3, "proxy")]
    e = spark.createDataFrame(rows, "ticker string, premium double, event_ts timestamp, direction string, direction_confidence double, marketcap double, delta_magnitude double, delta_source string")
    a, b = (r.asDict() for r in flow.weighted_by_key(e, F.lit(t), ["ticker"]).orderBy("ticker").collect())
    assert a["bullish_premium"] == pytest.approx(125) and a["bullish_premium_raw"] == 150 and a["bullish_delta_premium"] == pytest.approx(75)
    assert a["bullish_avg_delta"] == pytest.approx(100 / 150) and a["bullish_delta_source_mix"] == pytest.approx(100 / 150)
    assert a["bullish_flow_intensity"] == pytest.approx(150 / 2e8) and a["bearish_avg_delta"] == 0 and a["bearish_premium"] == 80
    assert b["bullish_premium"] == 0 and b["bullish_flow_intensity"] == 0 and b["bullish_avg_delta"] == 0


def test_performance_and_exposure(spark):
    p = spark.createDataFrame([(10.0, 1.0, "a"), (-5.0, -0.5, "a"), (3.0, 0.3, None)], "pnl_dollar double, r_multiple double, k string")
    got = {(r["dimension"], r["level"]): (r["trades"], r["win_rate"], r["total_pnl"], r["profit_factor"]) for r in replay.performance(p, {"k": F.col("k"), "all": F.lit("all")}).collect()}
    assert got[("k", "a")] == (2, 50.0, 5.0, 2.0) and got[("k", None)] == (1, 100.0, 3.0, None) and got[("all", "all")][0] == 3
    pos = spark.createDataFrame([("LONG", 10.0, 9.0, 10.0, "WEAK"), ("short", 20.0, None, 5.0, None), ("LONG", None, 1.0, 1.0, "STRONG")], "direction string, entry_price double, active_stop double, shares double, health_state string")
    r = C.exposure_summary(pos).first()
    assert (r["long_exposure"], r["short_exposure"], r["net_pct"], r["heat_pct"], r["positions"], r["health_weak"]) == (100.0, 100.0, 0.0, 5.0, 3, 1)
    assert C.exposure_summary(pos.limit(0)).first()["heat_pct"] == 0.0


def test_projection_and_graded_rows(spark):
    rows = spark.createDataFrame([("A", 5.0, None, 2.555, " ", "base"), ("B", 0.0, 0.0, None, "own", "base")], "ticker string, total_bullish_premium double, unusual_bullish_premium double, swing_bullish_premium double, e_dominant_dte_bucket string, dominant_dte_bucket string")
    target = {"ticker": "string", "unusual_bullish_premium": "double", "swing_bullish_premium": "double", "dominant_dte_bucket": "string", "sweep_share": "double"}
    assert [tuple(r) for r in tables.snapshot_projection(rows, target).orderBy("ticker").collect()] == [("A", 2.56, 2.56, "base", None), ("B", 0.0, 0.0, "own", None)]
    g = spark.createDataFrame([("A", None), (" ", "leap"), (None, "leap"), ("B", "leap")], "conviction_grade string, dominant_dte_bucket string")
    assert sorted(map(tuple, tables.graded_rows(g).collect())) == [("A", "unknown"), ("B", "leap")]


def test_streak_bonus_and_market_r(spark):
    rows = [(2, "rising", 0.9), (3, "rising", 0.9), (9, "rising", 0.9), (5, "flat", 0.4), (5, None, 0.4), (5, "falling", 0.9), (5, "rising", 0.3), (None, "rising", 0.9)]
    df = spark.createDataFrame(rows, "d int, t string, m double")
    assert [r[0] for r in df.select(C.streak_bonus(F.col("d"), F.col("t"), F.col("m"))).collect()] == [0.0, 0.25, 1.0, 0.375, 0.375, 0.0, 0.0, 0.0]
    a = spark.createDataFrame([("LONG", 10.0, 8.0, 13.0), ("SHORT", 10.0, 12.0, 9.0), ("LONG", 10.0, 10.0, 9.0), ("LONG", None, 1.0, 1.0)], "d string, e double, s double, x double")
    assert [tuple(r) for r in a.select(*C.r_at_market(*[F.col(c) for c in "desx"])).collect()] == [(1.5, 2.5), (0.5, 1.5), (None, None), (None, None)]


def test_volatility_by_hand(spark):
    rng = np.random.default_rng(2)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150)))
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(i), float(c)) for i, c in enumerate(close)]
    got = lab.volatility(spark.createDataFrame(rows, "ticker string, date date, close double")).orderBy("date").collect()
    r = close[1:] / close[:-1] - 1
    sd = lambda k, i: np.std(r[i - k : i], ddof=1)
    assert got[24]["realized_vol_regime"] is None and got[29]["rv_pct"] is None
    assert got[25]["realized_vol_regime"] == pytest.approx(sd(5, 25) / sd(20, 25))
    hist = [sd(30, i) for i in range(30, 150)]
    assert got[149]["rv_pct"] == pytest.approx(100 * np.mean([v <= hist[-1] for v in hist[-90:]]))


def test_mixed_scores_fall_back_to_peers_or_absolute_units(spark):
    from flowmill.plans.flow_queries import aggregated

    a = aggregated(spark, D).withColumn("sector", F.substring("ticker", 1, 1))
    other = spark.createDataFrame([("ZZ", 1.0), ("ZZ", 2.0)], "ticker string, v double")
    m = S.mixed_scores(a, {"flow_intensity": other}, "bullish").collect()
    assert len(m) == a.count() and all(r["bullish_zscore_tier"] == 4 and r["bullish_sweep_tier"] == 4 for r in m)
    assert {r["bullish_flow_intensity_tier"] for r in m} <= {3, 4}  # no history of their own
    assert all(0 <= r["bullish_score_mixed"] <= 10 for r in m)
    assert all(math.isclose(r["bullish_score_mixed"], r["bullish_score"]) for r in m if r["bullish_flow_intensity_tier"] == 4)
