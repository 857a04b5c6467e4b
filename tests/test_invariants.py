"""The reference's invariants on tiny frames, and the flow of a few queries against their SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowmill.functions import flow as X
from flowmill.functions import scores as C
from flowmill.operators import bars as B
from flowmill.operators import flow as O
from flowmill.operators import panels as N
from flowmill.operators import replay as R
from flowmill.operators import stats as S
from flowmill.operators import tracker as T

DAY = dt.date(2026, 5, 4)


def events(spark, minutes, n_ticker="A"):
    t = dt.datetime(2026, 5, 4, 14)
    rows = [(n_ticker, t - dt.timedelta(minutes=m), 1e5, 40, "LONG", 1.0, True, False, 1.0, 1e9) for m in minutes]
    return spark.createDataFrame(rows, "ticker string, event_ts timestamp_ntz, premium double, dte int, direction string, direction_confidence double, is_sweep boolean, is_multileg boolean, volume_oi_ratio double, marketcap double")


def test_acceleration_counts_the_last_two_hours(spark):
    a = O.aggregate_by_ticker(events(spark, [0, 60, 150, 240, 360])).first()
    assert (a.bullish_repeat_2h, a.bullish_accel_ratio) == (2, 0.4)
    b = O.aggregate_by_ticker(events(spark, range(0, 100, 10))).first()
    assert b.bullish_accel_ratio == 1.0 and b.bullish_accel_score <= 0.7
    c = O.aggregate_by_ticker(events(spark, [0, 10])).first()
    assert c.bullish_accel_ratio == 0.0 and round(c.bullish_accel_score, 3) == -0.308
    assert O.aggregate_by_ticker(events(spark, [0], None)).first().ticker is None


def test_contract_ids(spark):
    rows = [("aapl", dt.date(2026, 1, 16), "call", 150.0), ("SPY", dt.date(2026, 1, 16), "PUT", 412.5), ("", dt.date(2026, 1, 16), "CALL", 1.0), ("X", None, "CALL", 1.0), ("X", dt.date(2026, 1, 16), "FUT", 1.0), ("X", dt.date(2026, 1, 16), "CALL", -1.0)]
    df = spark.createDataFrame(rows, "t string, e date, o string, k double").select(X.occ_id(F.col("t"), F.col("e"), F.col("o"), F.col("k")).alias("id"))
    ids = [r.id for r in df.collect()]
    assert ids == ["AAPL260116C00150000", "SPY260116P00412500", None, None, None, None]
    r = df.filter("id is not null").select("id", *[c.alias(k) for k, c in X.parse_occ(F.col("id")).items()]).collect()[1]
    assert (r.occ_ticker, str(r.occ_expiry), r.occ_type, r.occ_strike) == ("SPY", "2026-01-16", "PUT", 412.5)


def test_delta_proxy(spark):
    rows = [("CALL", 50.0, 100.0, 30), ("CALL", 100.0, 100.0, 30), ("PUT", 100.0, 100.0, 30), ("CALL", 0.0, 100.0, 30)]
    a, b, c, d = [r.d for r in spark.createDataFrame(rows, "option_type string, strike double, underlying_price double, dte int").select(X.delta_proxy().alias("d")).collect()]
    assert a > 0.99 and abs(b - 0.5) < 0.06 and abs(c + 0.5) < 0.06 and d is None


def test_z_ladder(spark):
    history = [("FULL", DAY - dt.timedelta(i), float(i % 7)) for i in range(30)] + [("FEW", DAY - dt.timedelta(i), float(i % 3)) for i in range(8)]
    h = spark.createDataFrame(history, "ticker string, date date, v double")
    today = [("FULL", "Tech", 9.0), ("FEW", "Tech", 9.0), ("NEW", "Tech", 9.0), ("GAP", "Tech", None)] + [(f"P{i}", "Tech", float(i)) for i in range(12)]
    z = {r.ticker: r for r in S.z_ladder(spark.createDataFrame(today, "ticker string, sector string, v double"), h, "v").collect()}
    assert (z["FULL"].tier, z["FEW"].tier, z["NEW"].tier) == (1, 2, 3)
    assert all(-3.5 <= r.z <= 3.5 for r in z.values())
    small = S.z_ladder(spark.createDataFrame(today[2:4], "ticker string, sector string, v double"), h, "v").collect()
    assert {(r.tier, r.z) for r in small} == {(4, None)}


def snaps(spark, days, step=2e6):
    rows = [(DAY + dt.timedelta(i), "A", b * 1e6, s * 1e6, 1e9, 100.0 + i, 0.3, 0.9, "8-30", "Tech", 0.5) for i, (b, s) in enumerate(days)]
    return spark.createDataFrame(rows, "snapshot_date date, ticker string, total_bullish_premium double, total_bearish_premium double, marketcap double, close double, put_call_ratio double, perc_3_day_total double, dominant_dte_bucket string, sector string, sweep_share double")


def track(spark, days, at=None):
    as_of = spark.createDataFrame([(at or DAY + dt.timedelta(len(days) - 1),)], "as_of date")
    return T.track(snaps(spark, days), as_of, 7).collect()


def test_tracker_gates(spark):
    r = track(spark, [(8, 1), (9, 1), (11, 1), (14, 1), (18, 1)])[0]
    assert (r.passes_all, r.passes_activity, r.passes_strong, r.trend, r.direction) == (True, True, True, "accelerating", "BULLISH")
    spike = track(spark, [(0.2, 0.2), (0.2, 0.2), (0.2, 0.2), (3, 0.1), (3, 0.1)])[0]
    assert spike.passes_all and not spike.passes_strong
    assert track(spark, [(8, 1)]) == []


def test_day_persistence_and_flips(spark):
    r = track(spark, [(5, 1), (1, 5), (5, 1), (5, 1), (1.02, 1)])[0]
    assert (r.day_persistence, r.has_flips) == (0.6, True)


def test_later_rows_are_invisible(spark):
    days = [(8, 1), (9, 1), (11, 1), (14, 1), (18, 1)]
    at = DAY + dt.timedelta(2)
    assert track(spark, days, at)[0].cum_total == track(spark, days[:3])[0].cum_total == 31e6


def bars_of(spark, closes, ticker="A"):
    rows = [(ticker, DAY + dt.timedelta(i), c, c + 0.5, c - 0.5, c, 1000 + i) for i, c in enumerate(closes)]
    return B.features(spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long"))


def test_ramp_hits_the_target_and_drop_stops_out(spark):
    for closes, way, reason in (([100.0] * 20 + [100 + 0.9 * k for k in range(20)], "LONG", "T2"), ([100.0] * 20 + [100 - 0.9 * k for k in range(20)], "LONG", "stop"), ([100.0] * 20 + [100 - 0.9 * k for k in range(20)], "SHORT", "T2")):
        f = bars_of(spark, closes)
        plan = R.plans_from(spark.createDataFrame([("A", 19, way, "31-90")], "ticker string, i int, direction string, bucket string"), f)
        r = R.replay(plan, f).first()
        assert r.exit_reason == reason and (r.realized_r >= 1.5) == (reason == "T2")


def test_ewm_equals_the_recursion(spark):
    closes = [100 + (k * 7919 % 13) - (k * 31 % 7) for k in range(300)]
    y, want = None, []
    for c in closes:
        y = float(c) if y is None else y + (2 / 21) * (c - y)
        want.append(y)
    got = [r.ema20 for r in bars_of(spark, [float(c) for c in closes]).orderBy("date").collect()]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9


def test_reasons_and_labels(spark):
    raw = ["poor_rr (1.7:1)", "", None, " nan ", "brand new", "price_over_extended"]
    got = [r.x for r in spark.createDataFrame([(r,) for r in raw], "r string").select(C.reject_reason(F.col("r")).alias("x")).collect()]
    assert got == ["poor_rr", "none", "none", "none", "other", "price_over_extended"]
    h = spark.createDataFrame([("A", d, float(d)) for d in range(1, 8)] + [("B", 1, 5.0), ("B", 2, 5.0)], "ticker string, d int, v double")
    t = {r.ticker: r.flow_trend for r in N.streak_trend(h, ["ticker"], "v", "d").collect()}
    assert t == {"A": "rising", "B": "n/a"}


def test_insider_letters(spark):
    tx = spark.createDataFrame([("A", "SALE", DAY, 5.0), ("A", "PURCHASE", DAY, 7.0)], "ticker string, transaction_type string, filing_date date, value double")
    since = F.lit(DAY)
    assert N.insiders(tx, since).first().net_direction == "mixed"
    assert N.insiders(tx, since, strict=False).first().buy_count == 2


@pytest.mark.parametrize("name", ["agg1_flow_by_ticker", "win4_relative_volume", "sta3_z_ladder", "set2_keep_last"])
def test_queries_equal_their_sql(spark, name):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = entry.queries()[name](spark, d)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    c = sorted(got.columns)
    key = lambda rows: sorted(tuple(f"{x:.3f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert key(got.select(*[F.col(f"`{x}`") for x in c]).collect()) == key(want.project(", ".join(f'"{x}"' for x in c)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nearest_in_time_takes_the_least_id_of_a_tie(spark):
    from flowmill.operators.panels import nearest_in_time

    rows = [("a", 10, 1, False), ("a", 10, 3, False), ("a", 12, 5, True), ("a", 14, 7, False), ("a", 14, 6, False), ("a", 30, 9, True), ("a", 30, 8, False), ("a", 30, 11, False), ("b", 1, 20, True)]
    got = nearest_in_time(spark.createDataFrame(rows, "ticker string, at long, tracking_id long, asks boolean")).collect()
    assert {r.tracking_id: r.nearest for r in got} == {5: 1, 9: 8, 20: None}


def test_outcomes_join_over_both_vocabularies(spark):
    from flowmill.operators.panels import outcome_stamped

    history = spark.createDataFrame([("a", "BULLISH"), ("b", "BEARISH"), ("c", "LONG"), ("d", None)], "ticker string, direction string")
    promoted = spark.createDataFrame([("a", "LONG"), ("c", "BULLISH")], "ticker string, direction string")
    rejected = spark.createDataFrame([("b", "SHORT", "poor_rr"), ("b", "SHORT", "stale"), ("a", "SHORT", "x")], "ticker string, direction string, reject_reason string")
    got = {r.ticker: r.outcome for r in outcome_stamped(history, promoted, rejected).collect()}
    assert got == {"a": "promoted", "b": "rejected:poor_rr", "c": "promoted", "d": "not_evaluated"}


def test_rank_tenor_is_thirty_days_or_the_first(spark):
    from flowmill.operators.options import rank_tenor

    rows = [("a", 7, 0.1, 1.0), ("a", 30, 0.2, 1.0), ("b", 60, 0.3, 1.0), ("b", 14, 0.4, 1.0)]
    got = {r.ticker: r.days for r in rank_tenor(spark.createDataFrame(rows, "ticker string, days int, percentile double, volatility double")).collect()}
    assert got == {"a": 30, "b": 14}


def test_closed_trades_of_both_sides(spark):
    from flowmill.operators.replay import closed_trades

    rows = [("LONG", 100.0, 110.0, 4.0, 10), ("SHORT", 100.0, 110.0, 4.0, 10), ("SHORT", 50.0, 45.0, 0.0, None)]
    got = closed_trades(spark.createDataFrame(rows, "direction string, entry_price double, exit_price double, risk_per_share double, shares long")).collect()
    assert [(r.pnl_pct, r.pnl_dollar, r.r_multiple) for r in got] == [(0.1, 100.0, 2.5), (-0.1, -100.0, -2.5), (0.1, 0.0, 0.0)]


def test_exponential_means_of_a_long_series_are_the_recursion(spark):
    n, shape = 20_000, "sin(id / 7D) * 5 + 100"
    raw = spark.range(n).selectExpr("'A' AS ticker", "date_add(DATE'1950-01-01', int(id)) AS date", f"{shape} AS open", f"{shape} + 1 AS high", f"{shape} - 1 AS low", f"{shape} + cos(id * 1.3D) AS close", "100L AS volume")
    got = B.features(raw).select("date", "close", "tr", "ema50", "atr14", "adx", "rsi14").orderBy("date").collect()
    ema, atr, gain, loss = got[0].close, got[0].tr, 0.0, 0.0
    for k, r in enumerate(got[1:], 1):
        ema += (r.close - ema) * 2 / 51
        atr += (r.tr - atr) / 14
        d = r.close - got[k - 1].close
        gain = max(d, 0) if k == 1 else gain + (max(d, 0) - gain) / 14
        loss = max(-d, 0) if k == 1 else loss + (max(-d, 0) - loss) / 14
        assert abs(r.ema50 - ema) < 1e-9 and abs(r.atr14 - atr) < 1e-9 and 0 <= r.adx <= 100
        assert k < 14 or abs(r.rsi14 - (100 - 100 / (1 + gain / loss))) < 1e-7


def test_change_of_open_interest_adds_to_conviction(spark):
    base, as_of = snaps(spark, [(3, 1)] * 5), spark.createDataFrame([(DAY + dt.timedelta(4),)], "as_of date")
    score = lambda df: T.track(df, as_of, 7).first().conviction_score
    none, some, most = score(base), score(base.withColumn("total_oi_change_perc", F.lit(-25.0))), score(base.withColumn("total_oi_change_perc", F.lit(400.0)))
    assert score(base.withColumn("total_oi_change_perc", F.lit(None).cast("double"))) == none and none < some < most


def test_history_baselines_keep_the_last_delivery(spark):
    rows = [(" aa ", DAY, 0, 1e9, 1e6, 0.0, 2e6, 0.0, 10, 0, 5, 0), ("AA", DAY, 1, 1e9, 3e6, 0.0, 6e6, 0.0, 12, 4, 0, 8), ("LOW", DAY, 0, 1e7, 1e6, 0.0, 1e6, 0.0, 1, 1, 1, 1), ("AA", None, 0, 1e9, 1e6, 0.0, 1e6, 0.0, 1, 1, 1, 1), ("NUL", DAY, 0, None, 1e6, 0.0, 1e6, 0.0, 1, 1, 1, 1)]
    names = "ticker string, date date, feed int, marketcap double, bullish_premium double, bearish_premium double, call_premium double, put_premium double, call_volume long, put_volume long, call_open_interest long, put_open_interest long"
    (r,) = O.history_baselines(spark.createDataFrame(rows, names)).collect()
    assert (r.ticker, r.bullish_flow_intensity, r.bullish_vol_oi, r.bearish_vol_oi, r.bullish_unusual_premium_share, r.bearish_unusual_premium_share) == ("AA", 0.003, None, 0.5, 0.5, None)
