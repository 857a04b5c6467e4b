"""Levels, stack score, trails, health and regimes on small frames."""

import datetime as dt

from pyspark.sql import functions as F

from flowmill.operators import levels as L
from flowmill.operators import positions as P
from flowmill.operators import stats as S


def test_clusters_chain_by_gap_and_keep_their_span(spark):
    df = spark.createDataFrame([([(10.0, 1), (10.4, 30), (10.8, 5), (12.0, 7)], 1.0), ([], 1.0), ([(1.0, 1)], 0.0)], "points array<struct<p:double,i:int>>, atr14 double")
    out = [r.c for r in df.select(L.clusters(F.col("points"), F.col("atr14")).alias("c")).collect()]
    assert [(round(c.level, 6), c.touches, c.span) for c in out[0]] == [(10.4, 3, 29), (12.0, 1, 0)]
    assert out[1] == [] and out[2] == []


def brute_range(values, band):
    group = [values[0]]
    for v in values[1:]:
        if v - group[0] <= band:
            group.append(v)
        elif len(group) >= 2:
            break
        else:
            group = [v]
    return (sum(group) / len(group), len(group)) if len(group) >= 2 else (None, 0)


def test_range_floor_is_the_first_band_with_two_touches(spark):
    lows = [9.0, 10.0, 10.2, 10.9, 8.0, 8.9, 11.0, 10.1, 12.0, 9.1, 7.0, 9.05]
    rows = [("A", dt.date(2026, 1, 1) + dt.timedelta(days=k), k, v, v + 3, 2.0) for k, v in enumerate(lows)]
    df = spark.createDataFrame(rows, "ticker string, date date, i int, low double, high double, atr14 double")
    got = {r.i: r for r in df.select("i", *[c.alias(k) for k, c in L.ranges().items()]).collect()}
    for k in range(1, len(lows)):
        window = lows[max(0, k - 9): k + 1]
        level, touches = brute_range(sorted(window), 0.5)
        assert got[k].range_floor_touches == touches and (level is None) == (got[k].range_floor is None)
        assert level is None or abs(got[k].range_floor - level) < 1e-9
        level, touches = brute_range(sorted(-(v + 3) for v in window), 0.5)
        assert got[k].range_ceiling_touches == touches and (level is None or abs(got[k].range_ceiling + level) < 1e-9)
    assert got[0].range_floor is None


STACK = "direction string, conviction_score double, dp_bias double, dp_bps double, dp_z double, hot_chain boolean, call_premium double, put_premium double, insider string, session_tone string, rs_5 double, rs_20 double, window_return_pct double, dealer_bias string"


def test_stack_score(spark):
    rows = [
        ("BULLISH", 10.0, 0.65, 6.0, 2.5, True, 2.0, 1.0, "buying", "STRENGTH", 1.0, 1.0, 9.0, "chase"),
        ("SHORT", 4.0, 0.65, 6.0, None, False, 2.0, 1.0, "buying", "STRENGTH", 1.0, 1.0, 9.0, "suppress"),
        (None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    full, poor, none = P.conviction_stack(spark.createDataFrame(rows, STACK)).collect()
    assert full.score == 100 and full.tier == "elite" and full.drivers == list(P.STACK) and full.drags == []
    assert full.dp_bias == 0.65 and poor.raw_score == 21.5 and poor.tier_label == "Stack D"
    assert poor.drags == ["dp_confirm", "chain_confirm", "insider", "price_confirm"]
    assert none.raw_score == 0 and none.tier == "weak"


def test_ranked_reasons(spark):
    parts = {"a": (F.col("a"), 2.0), "b": (F.col("b"), 2.0), "c": (F.col("c"), 2.0), "d": (F.col("d"), 2.0)}
    drivers, drag = P.ranked_reasons(parts)
    rows = [(1.0, 2.0, 1.0, 0.1), (0.0, 0.0, None, None), (None, None, None, None), (1.0, 1.0, 1.0, 1.0)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(drivers, drag).collect()]
    assert got == [(["b", "a", "c"], "d"), ([], "a"), ([], None), (["a", "b", "c"], None)]


POSITION = "direction string, entry_price double, initial_stop double, risk_per_share double, target_1 double, best_price double, days_held int, partial_filled boolean, bucket string, gamma_regime string, wall double, entry_grade string, current_grade string, sector_heat double, unusual_flow string, close double, high double, low double, atr14 double, ema20 double"


def test_trailing_stops_of_both_sides(spark):
    rows = [
        ("LONG", 100.0, 97.0, 3.0, 106.0, 108.0, 2, True, "swing", None, None, "A", "A", None, None, 107.0, 109.0, 106.0, 2.0, 101.0),
        ("SHORT", 100.0, 103.0, 3.0, 94.0, 92.0, 2, True, "swing", None, None, "A", "A", None, None, 93.0, 94.0, 91.0, 2.0, 99.0),
        ("LONG", 100.0, 97.0, 3.0, 106.0, 101.0, 5, False, None, "NEGATIVE", None, "A", "C", -9.0, "BEARISH", 100.5, 101.0, 100.0, 2.0, 98.0),
        ("LONG", 100.0, 97.0, 0.0, 106.0, 101.0, 0, False, None, None, 101.5, None, None, None, None, 100.5, 101.0, 100.0, 2.0, 90.0),
    ]
    a, b, c, e = P.trailing_stops(spark.createDataFrame(rows, POSITION)).collect()
    assert (a.best_price, round(a.trail_atr, 6), a.trail_hybrid, a.trail_post_t1, round(a.active_stop, 6)) == (109.0, 104.8, 105.0, 104.0, 105.0)
    assert (b.best_price, round(b.trail_atr, 6), b.trail_hybrid, b.trail_post_t1, round(b.active_stop, 6)) == (91.0, 95.2, 95.0, 96.0, 95.0)
    assert c.flow_decay_factor == 0.0 and c.trail_hybrid == 100.0 and c.trail_post_t1 is None and c.active_stop == 100.0
    assert e.unrealized_r == 0.0 and abs(e.trail_atr - 97.0) < 1e-9


def test_risk_regime(spark):
    rows = [
        (15.0, 16.0, 50.0, "BULLISH", 1.0, 0, 0, None, None, None), (None, None, None, None, None, None, None, None, None, None), (20.0, 19.0, 75.0, "BEARISH", 3.5, 3, 6, None, 3, None),
        (15.0, 16.0, 50.0, "BULLISH", 6.0, 0, 0, None, None, None), (15.0, 16.0, 50.0, "BULLISH", 1.0, 0, 0, 1, 0, None), (15.0, 16.0, 50.0, "BULLISH", 1.0, 0, 0, -1, None, None),
    ]
    df = spark.createDataFrame(rows, "vix double, vix3m double, rsi double, market_trend string, heat_pct double, same_sector int, same_direction int, fomc_days int, cpi_days int, nfp_days int")
    got = [(r.risk_tier, r.multiplier, r.risk_score, r.halt_reason, r.warnings) for r in P.risk_regime(df).collect()]
    assert got[0] == ("calm", 1.0, 100, None, []) and got[1] == ("calm", 1.0, 100, None, [])
    assert got[2][0] == "panic" and got[2][1] == 0.145 and got[2][4] == ["term", "trend", "rsi", "heat", "sector", "direction", "event"]
    assert got[3][:3] == ("halt", 0.0, 0) and got[4][3] == "FOMC tomorrow" and got[5][0] == "calm"


def test_print_ladder_falls_back(spark):
    day = dt.date(2026, 3, 1)
    rows = [("own", day - dt.timedelta(days=k), 100.0 + k) for k in range(25)] + [("few", day - dt.timedelta(days=k), 50.0 + 9 * k) for k in range(6)]
    rows += [(f"t{k}", day, 10.0 * k) for k in range(9)] + [("gone", day - dt.timedelta(days=90), 1.0)]
    got = {r.ticker: r for r in S.print_z_tier(spark.createDataFrame(rows, "ticker string, date date, v double")).collect()}
    assert got["own"].tier == 1 and got["few"].tier == 2 and got["t3"].tier == 3 and "gone" not in got
    alone = S.print_z_tier(spark.createDataFrame([("x", day, 1.0)], "ticker string, date date, v double")).first()
    assert alone.tier == 4 and alone.z is None
