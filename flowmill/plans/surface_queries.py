"""Queries on prints, option chains and robust statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import flow as X
from ..operators import options as P
from ..operators import prints as D
from ..operators import stats as S
from ..sources.fixtures import BARS_SQL, FLOW_SQL, PRINTS_SQL, SNAPSHOTS_SQL, bars, prints, snapshots, table
from .flow_queries import OCC_SQL, flow
from ..sources.shared import settled
from .registry import query

# ---- prints ------------------------------------------------------------------------------------

CLASS_SQL = PRINTS_SQL + """,
cl AS (SELECT *, CASE WHEN nbbo_ask > 0 AND price >= nbbo_ask THEN 'buy' WHEN nbbo_bid > 0 AND price <= nbbo_bid THEN 'sell' ELSE 'neutral' END AS side, price * size AS notional FROM prints WHERE price > 0 AND size > 0)"""


def dp_agg_sql(by: str) -> str:
    return f"""SELECT {by}, CAST(sum(size) AS BIGINT) AS total_volume, round(sum(notional), 2) AS total_notional, CAST(coalesce(sum(size) FILTER (side = 'buy'), 0) AS BIGINT) AS buy_volume, CAST(coalesce(sum(size) FILTER (side = 'sell'), 0) AS BIGINT) AS sell_volume,
  count(*) AS print_count, count(*) FILTER (notional >= 1000) AS large_print_count, round(max(notional), 2) AS largest_print_notional FROM cl GROUP BY {by}"""


BIAS_SQL = "CASE WHEN {b} >= 0.6 THEN 'Buyers' WHEN {b} <= 0.4 THEN 'Sellers' ELSE 'Balanced' END"


@query("agg6_prints_by_ticker", f"""WITH {CLASS_SQL}, a AS ({dp_agg_sql('ticker')}), b AS (SELECT *, CAST(buy_volume AS DOUBLE) / total_volume AS x FROM a)
SELECT * EXCLUDE (x), round(x, 4) AS bias, {BIAS_SQL.format(b='x')} AS bias_label FROM b""")
def agg6(spark, d):
    return D.aggregate(D.classify(prints(spark, d)), ["ticker"], 1000).drop("first_seen", "last_seen")


@query("agg6_large_prints", f"WITH {CLASS_SQL} SELECT tracking_id, ticker, side, round(notional, 2) AS notional FROM cl WHERE notional >= 1000")
def agg6b(spark, d):
    return D.classify(prints(spark, d)).filter("notional >= 1000").select("tracking_id", "ticker", "side", F.round("notional", 2).alias("notional"))


DAILY_SQL = CLASS_SQL + f""",
d0 AS ({dp_agg_sql('ticker, date')}),
dp AS (SELECT *, round(CAST(buy_volume AS DOUBLE) / total_volume, 4) AS bias, 2e8 AS marketcap FROM d0)"""


def daily(spark, d):
    return D.aggregate(D.classify(prints(spark, d)), ["ticker", "date"], 1000).withColumn("marketcap", F.lit(2e8))


@query("agg7_multi_day_prints", f"""WITH {DAILY_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM dp), t AS (SELECT count(DISTINCT date) AS total_days FROM dp),
a AS (SELECT ticker, count(*) AS active_days, sum(total_notional) AS cn, sum(total_volume) AS cv, sum(bias * total_volume) AS bv, count(*) FILTER (bias > 0.55) AS buy_days, count(*) FILTER (bias < 0.45) AS sell_days,
  coalesce(sum(total_notional) FILTER (k <= n // 2), 0) AS n1, coalesce(sum(total_notional) FILTER (k > n // 2), 0) AS n2 FROM k GROUP BY 1 HAVING count(*) >= 2)
SELECT ticker, active_days, buy_days, sell_days, round(cn, 2) AS cumulative_notional, round(bv / cv, 4) AS bias, {BIAS_SQL.format(b='bv / cv')} AS bias_label,
  CASE WHEN buy_days >= 2.0::DOUBLE / 3 * active_days THEN 'Consistent buyer' WHEN sell_days >= 2.0::DOUBLE / 3 * active_days THEN 'Consistent seller' ELSE 'Mixed' END AS bias_consistency_label,
  CASE WHEN n1 <= 0 THEN CASE WHEN n2 > 0 THEN 'accelerating' ELSE 'steady' END WHEN n2 / n1 > 1.3 THEN 'accelerating' WHEN n2 / n1 < 0.7 THEN 'fading' ELSE 'steady' END AS trend,
  round(cn / 2e8 * 10000, 2) AS notional_mcap_bps, round(CAST(active_days AS DOUBLE) / total_days, 2) AS persistence_ratio FROM a, t""")
def agg7(spark, d):
    m = D.multi_day(daily(spark, d))
    return m.select("ticker", "active_days", "buy_days", "sell_days", F.round("cumulative_notional", 2).alias("cumulative_notional"), "bias", "bias_label", "bias_consistency_label", "trend", "notional_mcap_bps", "persistence_ratio")


# ---- option surface ----------------------------------------------------------------------------

CHAIN_SQL = FLOW_SQL + """,
spot AS (SELECT ticker, arg_max(underlying_price, (event_ts, l_orderkey, l_linenumber)) AS spot FROM flow GROUP BY 1),
cs AS (SELECT ticker, floor(underlying_price / 10) * 10 AS strike, sum(CASE WHEN option_type = 'CALL' THEN volume ELSE -volume END) * 1.5::DOUBLE AS net_gamma,
  CAST(coalesce(sum(open_interest) FILTER (option_type = 'CALL'), 0) AS BIGINT) AS call_oi, CAST(coalesce(sum(open_interest) FILTER (option_type = 'PUT'), 0) AS BIGINT) AS put_oi FROM flow GROUP BY 1, 2)"""


def strikes(spark, d):
    put = F.col("option_type") == "PUT"
    return flow(spark, d).groupBy("ticker", (F.floor(F.col("underlying_price") / 10) * 10).cast("double").alias("strike")).agg(
        (F.sum(F.when(put, -F.col("volume")).otherwise(F.col("volume"))) * 1.5).alias("net_gamma"), F.coalesce(F.sum(F.when(~put, F.col("open_interest"))), F.lit(0)).alias("call_oi"), F.coalesce(F.sum(F.when(put, F.col("open_interest"))), F.lit(0)).alias("put_oi")
    )


def spot(spark, d):
    return flow(spark, d).groupBy("ticker").agg(F.max_by("underlying_price", F.struct("event_ts", "l_orderkey", "l_linenumber")).alias("spot"))


@query("opt1_gamma_profile", f"""WITH {CHAIN_SQL}, c AS (SELECT cs.*, spot, sum(net_gamma) OVER (PARTITION BY cs.ticker ORDER BY strike) AS cum FROM cs JOIN spot ON cs.ticker = spot.ticker),
b AS (SELECT *, lag(cum) OVER (PARTITION BY ticker ORDER BY strike) AS prev, strike BETWEEN spot * 0.95::DOUBLE AND spot * 1.05::DOUBLE AS near FROM c),
a AS (SELECT ticker, sum(net_gamma) AS g, min(strike) FILTER ((prev > 0 AND cum <= 0) OR (prev < 0 AND cum >= 0)) AS gamma_flip, max(spot) AS spot, arg_max(strike, (abs(net_gamma), -strike)) FILTER (near) AS k, max(abs(net_gamma)) FILTER (near) AS top, sum(abs(net_gamma)) FILTER (near) AS band FROM b GROUP BY 1)
SELECT ticker, round(g, 2) AS net_gex, CASE WHEN g = 0 THEN 'NEUTRAL' WHEN g > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS gamma_regime, gamma_flip, CASE WHEN g = 0 THEN 'neutral' WHEN g > 0 THEN 'suppress' ELSE 'chase' END AS dealer_bias,
  CASE WHEN top / nullif(band, 0) >= 0.25 THEN k END AS pin_strike, round(CASE WHEN top / nullif(band, 0) >= 0.25 THEN k - spot END / spot * 100, 2) AS pin_distance_pct, CASE WHEN top / nullif(band, 0) >= 0.25 THEN round(top / band, 3) END AS pin_concentration FROM a""")
def opt1(spark, d):
    return P.gamma_profile(strikes(spark, d), spot(spark, d))


@query("opt2_oi_walls", f"""WITH {CHAIN_SQL}, a AS (SELECT cs.ticker, arg_max(strike, (call_oi, -strike)) FILTER (strike >= spot) AS c, arg_max(strike, (put_oi, -strike)) FILTER (strike <= spot) AS p, CAST(sum(call_oi) AS BIGINT) AS ticker_call_oi, CAST(sum(put_oi) AS BIGINT) AS ticker_put_oi, max(spot) AS spot FROM cs JOIN spot ON cs.ticker = spot.ticker GROUP BY 1)
SELECT ticker, c AS call_wall, p AS put_wall, round((c - spot) / spot * 100, 2) AS call_wall_pct, round((spot - p) / spot * 100, 2) AS put_wall_pct, ticker_call_oi, ticker_put_oi, CASE WHEN ticker_call_oi > 0 THEN round(CAST(ticker_put_oi AS DOUBLE) / ticker_call_oi, 3) END AS put_call_ratio FROM a""")
def opt2(spark, d):
    return P.oi_walls(strikes(spark, d), spot(spark, d))


EXP_SQL = FLOW_SQL + ", ex AS (SELECT ticker, CAST(date_trunc('month', expiration_date) AS DATE) AS expires, CAST(coalesce(sum(open_interest), 0) AS BIGINT) AS oi FROM flow GROUP BY 1, 2)"


def expiries(spark, d):
    return flow(spark, d).groupBy("ticker", F.to_date(F.date_trunc("month", "expiration_date")).alias("expires")).agg(F.coalesce(F.sum("open_interest"), F.lit(0)).alias("oi"))


@query("opt3_oi_by_term", f"""WITH {EXP_SQL} SELECT ticker, CAST(coalesce(sum(oi) FILTER (expires - DATE '1998-01-15' BETWEEN 0 AND 30), 0) AS BIGINT) AS near_term_oi, CAST(coalesce(sum(oi) FILTER (expires - DATE '1998-01-15' BETWEEN 31 AND 90), 0) AS BIGINT) AS swing_dte_oi,
  CAST(coalesce(sum(oi) FILTER (expires - DATE '1998-01-15' > 90), 0) AS BIGINT) AS long_dated_oi FROM ex GROUP BY 1""")
def opt3(spark, d):
    return P.oi_by_term(expiries(spark, d), F.lit("1998-01-15").cast("date"))


@query("opt4_volume_ratios", f"""WITH {SNAPSHOTS_SQL}, r AS (SELECT *, avg(call_volume) OVER w AS ca, avg(put_volume) OVER w AS pa FROM snapshots WINDOW w AS (PARTITION BY ticker ORDER BY snapshot_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT ticker, snapshot_date, round(call_volume / nullif(ca, 0), 4) AS call_volume_vs_avg, round(put_volume / nullif(pa, 0), 4) AS put_volume_vs_avg, net_premium AS premium_bias FROM r""")
def opt4(spark, d):
    w = Window.partitionBy("ticker").orderBy("snapshot_date").rowsBetween(-30, -1)
    ratio = lambda c: F.round(F.try_divide(F.col(c), F.nullif(F.avg(c).over(w), F.lit(0.0))), 4)
    return snapshots(spark, d).select("ticker", "snapshot_date", ratio("call_volume").alias("call_volume_vs_avg"), ratio("put_volume").alias("put_volume_vs_avg"), F.col("net_premium").alias("premium_bias"))


TENOR_SQL = FLOW_SQL + ", tn AS (SELECT ticker, CAST(dte // 10 * 10 AS INT) AS days, round(avg(l_partkey % 101) / 100, 6) AS percentile, round(stddev_samp(underlying_price) / 100, 6) AS volatility FROM flow GROUP BY 1, 2)"


def tenors(spark, d):
    return flow(spark, d).groupBy("ticker", (F.floor(F.col("dte") / 10) * 10).cast("int").alias("days")).agg(F.round(F.avg(F.col("l_partkey") % 101) / 100, 6).alias("percentile"), F.round(F.stddev_samp("underlying_price") / 100, 6).alias("volatility"))


@query("opt5_tenor_pick", f"""WITH {TENOR_SQL}, n AS (SELECT ticker, arg_min(volatility, (abs(days - 30), days)) AS v30, arg_min(volatility, (abs(days - 60), days)) AS v60, arg_min(volatility, (abs(days - 90), days)) AS v90, arg_min(percentile, (days <> 30, days)) AS p30 FROM tn GROUP BY 1)
SELECT ticker, round(p30 * 100, 2) AS iv_rank, v30 AS iv_30, v60 AS iv_60, v90 AS iv_90, round(v90 - v30, 6) + 0 AS term_slope FROM n""")
def opt5(spark, d):
    t = tenors(spark, d)
    near, mid, far = (P.tenor(t, n).select("ticker", F.col("volatility").alias(f"iv_{n}")) for n in (30, 60, 90))
    ranked = P.rank_tenor(t).select("ticker", F.round(F.col("percentile") * 100, 2).alias("iv_rank"))
    return ranked.join(near, "ticker").join(mid, "ticker").join(far, "ticker").withColumn("term_slope", F.round(F.col("iv_90") - F.col("iv_30"), 6) + F.lit(0.0))


@query("opt7_expiry_concentration", f"WITH {EXP_SQL} SELECT ticker, arg_max(expires, (oi, -date_diff('day', DATE '1970-01-01', expires))) AS top_expiry, round(max(oi) / CAST(sum(oi) AS DOUBLE), 6) AS top_share FROM ex GROUP BY 1")
def opt7(spark, d):
    return P.expiry_concentration(expiries(spark, d))


@query("opt8_max_pain", f"""WITH {FLOW_SQL}, m AS (SELECT ticker, expiration_date, round(avg(strike), 4) AS pain FROM flow WHERE expiration_date >= DATE '1998-01-15' GROUP BY 1, 2), n AS (SELECT ticker, min(expiration_date) AS expiry, arg_min(pain, expiration_date) AS max_pain FROM m GROUP BY 1),
s AS (SELECT ticker, arg_max(underlying_price, (event_ts, l_orderkey, l_linenumber)) AS spot FROM flow GROUP BY 1) SELECT ticker, expiry, max_pain, round((max_pain - spot) / spot * 100, 4) AS distance_pct FROM n JOIN s USING (ticker)""")
def opt8(spark, d):
    m = flow(spark, d).filter(F.col("expiration_date") >= F.lit("1998-01-15").cast("date")).groupBy("ticker", "expiration_date").agg(F.round(F.avg("strike"), 4).alias("pain"))
    n = m.groupBy("ticker").agg(F.min("expiration_date").alias("expiry"), F.min_by("pain", "expiration_date").alias("max_pain"))
    return n.join(spot(spark, d), "ticker").select("ticker", "expiry", "max_pain", F.round((F.col("max_pain") - F.col("spot")) / F.col("spot") * 100, 4).alias("distance_pct"))


@query("opt11_far_otm_share", f"""WITH {FLOW_SQL}, o AS (SELECT *, CASE WHEN option_type = 'CALL' THEN (strike - underlying_price) / underlying_price ELSE (underlying_price - strike) / underlying_price END AS otm FROM flow)
SELECT ticker, round(coalesce(sum(premium) FILTER (option_type = 'CALL' AND otm > 0.02), 0) / sum(premium), 6) AS far_call_share, round(coalesce(sum(premium) FILTER (option_type = 'PUT' AND otm > 0.02), 0) / sum(premium), 6) AS far_put_share FROM o GROUP BY 1""")
def opt11(spark, d):
    s, u = F.col("strike"), F.col("underlying_price")
    otm = F.when(F.col("option_type") == "CALL", (s - u) / u).otherwise((u - s) / u)
    part = lambda t: F.round(F.coalesce(F.sum(F.when((F.col("option_type") == t) & (otm > 0.02), F.col("premium"))), F.lit(0.0)) / F.sum("premium"), 6)
    return flow(spark, d).groupBy("ticker").agg(part("CALL").alias("far_call_share"), part("PUT").alias("far_put_share"))


CONTRACT_SQL = FLOW_SQL + f", ct AS (SELECT ticker, {OCC_SQL} AS contract_id, option_type, round(sum(premium), 2) AS premium FROM flow GROUP BY ALL)"


@query("agg12_hottest_chains", f"""WITH {CONTRACT_SQL}, a AS (SELECT ticker, count(*) AS contract_count, round(sum(premium), 2) AS total_premium, round(coalesce(sum(premium) FILTER (option_type = 'CALL'), 0), 2) AS call_premium, round(coalesce(sum(premium) FILTER (option_type = 'PUT'), 0), 2) AS put_premium FROM ct GROUP BY 1),
t AS (SELECT ticker, string_agg(contract_id, ',' ORDER BY premium DESC, contract_id) AS top FROM (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY premium DESC, contract_id) <= 5) GROUP BY 1)
SELECT a.*, top AS top_contracts, CASE WHEN call_premium > put_premium THEN 'Calls' ELSE 'Puts' END AS dominant_side, round(call_premium / (call_premium + put_premium) * 100, 1) AS call_pct FROM a JOIN t USING (ticker)""")
def agg12(spark, d):
    ids = flow(spark, d).withColumn("contract_id", X.occ_id(F.col("ticker"), F.col("expiration_date"), F.col("option_type"), F.col("strike")))
    c = P.chains_by_ticker(ids.groupBy("ticker", "contract_id", "option_type").agg(F.round(F.sum("premium"), 2).alias("premium")))
    return c.withColumn("top_contracts", F.array_join("top_contracts", ","))


@query("win35_gamma_flip", f"""WITH {CHAIN_SQL}, c AS (SELECT *, sum(net_gamma) OVER (PARTITION BY ticker ORDER BY strike) AS cum FROM cs), b AS (SELECT *, lag(cum) OVER (PARTITION BY ticker ORDER BY strike) AS prev FROM c)
SELECT ticker, min(strike) AS gamma_flip FROM b WHERE (prev > 0 AND cum <= 0) OR (prev < 0 AND cum >= 0) GROUP BY 1""")
def win35(spark, d):
    return P.gamma_profile(strikes(spark, d), spot(spark, d)).filter("gamma_flip is not null").select("ticker", "gamma_flip")


# ---- robust statistics -------------------------------------------------------------------------

HIST_SQL = SNAPSHOTS_SQL + """,
days AS (SELECT snapshot_date AS day, count(*) AS n FROM snapshots GROUP BY 1), newest AS (SELECT max(day) AS day FROM days WHERE n >= 0.25::DOUBLE * (SELECT max(n) FROM days)),
hist AS (SELECT ticker, sector, snapshot_date, total_bullish_premium / marketcap * 10000 AS v FROM snapshots, newest WHERE snapshot_date < day),
today AS (SELECT ticker, sector, snapshot_date, total_bullish_premium / marketcap * 10000 AS v FROM snapshots, newest WHERE snapshot_date = day)"""


def _history(spark, d):
    """Before and on the newest week that has at least a quarter of the fullest week's tickers."""
    s = snapshots(spark, d).withColumn("v", F.col("total_bullish_premium") / F.col("marketcap") * 10000).select("ticker", "sector", "snapshot_date", "v")
    days = s.groupBy("snapshot_date").count()
    most = days.agg(F.max("count").alias("_most"))  # one row
    day = F.lit(days.crossJoin(F.broadcast(most)).filter(F.col("count") >= 0.25 * F.col("_most")).agg(F.max("snapshot_date")).first()[0])
    return s.filter(F.col("snapshot_date") < day), s.filter(F.col("snapshot_date") == day)


OWN_SQL = """, om AS (SELECT ticker, median(v) AS m, count(*) AS n FROM hist GROUP BY 1), own AS (SELECT hist.ticker, any_value(m) AS m, median(abs(v - m)) AS d, any_value(n) AS n FROM hist JOIN om USING (ticker) GROUP BY 1),
pa AS (SELECT sector, v FROM today UNION ALL SELECT '*', v FROM today), pm AS (SELECT sector, median(v) AS m, count(*) AS n FROM pa GROUP BY 1), peers AS (SELECT pa.sector, any_value(m) AS m, median(abs(v - m)) AS d, any_value(n) AS n FROM pa JOIN pm USING (sector) GROUP BY 1 HAVING any_value(n) >= 10)"""


@query("sta1_ticker_median_mad", f"WITH {HIST_SQL}{OWN_SQL} SELECT ticker, round(m, 6) AS median, round(d, 6) AS mad, n FROM own")
def sta1(spark, d):
    h, _ = _history(spark, d)
    return S.median_mad(h, ["ticker"], "v").select("ticker", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "n")


@query("sta2_cohort_stats", f"WITH {HIST_SQL}{OWN_SQL} SELECT nullif(sector, '*') AS sector, round(m, 6) AS median, round(d, 6) AS mad, n FROM peers")
def sta2(spark, d):
    _, t = _history(spark, d)
    return S.cohort_stats(t, "v").select("sector", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "n")


def z_sql(x: str, m: str, d: str) -> str:
    return f"CASE WHEN {d} IS NULL OR {d} <= greatest(1e-6, scale * 1e-6) THEN 0 ELSE greatest(-3.5, least(3.5, 0.6745::DOUBLE * ({x} - {m}) / {d})) END"


LADDER_SQL = OWN_SQL + f""", sc AS (SELECT coalesce(median(abs(v)), 0) AS scale FROM today), al AS (SELECT max(m) AS am, max(d) AS ad FROM peers WHERE sector = '*'),
lad0 AS (SELECT today.ticker, today.sector, coalesce(v, 0) AS v, own.m AS om, own.d AS od, own.n AS n, peers.m AS sm, peers.d AS sd, am, ad, scale FROM today LEFT JOIN own USING (ticker) LEFT JOIN peers ON peers.sector = today.sector, sc, al),
lad1 AS (SELECT *, CASE WHEN n >= 20 THEN 1 WHEN n >= 5 AND ad IS NOT NULL THEN 2 WHEN sm IS NOT NULL OR am IS NOT NULL THEN 3 ELSE 4 END AS tier FROM lad0),
lad AS (SELECT *, CASE tier WHEN 1 THEN {z_sql('v', 'om', 'od')} WHEN 2 THEN {z_sql('v', 'om', '((n * od + 10 * ad) / (n + 10))')} WHEN 3 THEN {z_sql('v', 'coalesce(sm, am)', '(CASE WHEN sm IS NOT NULL THEN sd ELSE ad END)')} END AS z FROM lad1)"""


@query("sta3_z_ladder", f"WITH {HIST_SQL}{LADDER_SQL} SELECT ticker, round(z, 6) + 0 AS z, tier FROM lad")
def sta3(spark, d):
    h, t = _history(spark, d)
    return S.z_ladder(t, h, "v").select("ticker", (F.round("z", 6) + F.lit(0.0)).alias("z"), "tier")


@query("sta4_logistic_unit", f"WITH {HIST_SQL}{LADDER_SQL} SELECT ticker, round(coalesce(1 / (1 + exp(-z)), 0.5), 6) AS unit, tier FROM lad")
def sta4(spark, d):
    h, t = _history(spark, d)
    return S.z_ladder(t, h, "v").select("ticker", F.round(F.coalesce(S.logistic(F.col("z")), F.lit(0.5)), 6).alias("unit"), "tier")


@query("agg25_tier_coverage", f"WITH {HIST_SQL}{LADDER_SQL} SELECT tier, count(*) AS tickers, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lad), 4) AS pct FROM lad GROUP BY 1")
def agg25(spark, d):
    h, t = _history(spark, d)
    z = S.z_ladder(t, h, "v")
    n = z.agg(F.count("*").alias("_n"))
    return z.groupBy("tier").agg(F.count("*").alias("tickers")).crossJoin(F.broadcast(n)).select("tier", "tickers", F.round(F.col("tickers") * 100.0 / F.col("_n"), 4).alias("pct"))


FWD_SQL = BARS_SQL + """, fw AS (SELECT ticker, date, close, volume, high - low AS span, (close - open) / open AS body, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM bars),
lg AS (SELECT ticker, date, fwd, feature, value FROM fw UNPIVOT INCLUDE NULLS (value FOR feature IN (span, body)))"""


def _panel(spark, d):
    b = bars(spark, d).withColumn("fwd", F.lead("close", 5).over(Window.partitionBy("ticker").orderBy("date")) / F.col("close") - 1)
    p = b.withColumn("span", F.col("high") - F.col("low")).withColumn("body", (F.col("close") - F.col("open")) / F.col("open"))
    return S.unpivot(p, ["ticker", "date", "fwd"], ["span", "body"])


RANK_SQL = """, known AS (SELECT * FROM lg WHERE value IS NOT NULL AND fwd IS NOT NULL),
rk AS (SELECT {k}, rank() OVER (PARTITION BY {k} ORDER BY value) + (count(*) OVER (PARTITION BY {k}, value) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY {k} ORDER BY fwd) + (count(*) OVER (PARTITION BY {k}, fwd) - 1) / 2.0::DOUBLE AS ry FROM known)"""


def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.5::DOUBLE * {x}))"
    poly = f"{S.ERFC[-1]}::DOUBLE"
    for c in S.ERFC[-2::-1]:
        poly = f"({c}::DOUBLE + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


_P_SQL = "SELECT {k}, round(c, 6) + 0 AS spearman, n, round(CASE WHEN n >= 3 AND NOT isnan(c) THEN " + erfc_sql("(abs(c) * sqrt(n - 1) / sqrt(2.0::DOUBLE))") + " END, 6) AS p FROM (SELECT {k}, corr(rx, ry) AS c, count(*) AS n FROM rk GROUP BY ALL)"


def _with_p(df, *keys):
    return df.select(*keys, (F.round("spearman", 6) + F.lit(0.0)).alias("spearman"), "n", F.round(S.rank_p_value(F.col("spearman"), F.col("n")), 6).alias("p"))


@query("sta7_spearman_by_ticker", f"WITH {FWD_SQL}{RANK_SQL.format(k='feature, ticker')} {_P_SQL.format(k="feature, ticker")}")
def sta7(spark, d):
    return _with_p(S.spearman(_panel(spark, d), ["feature", "ticker"], "value", "fwd"), "feature", "ticker")


@query("sta8_attribution", f"WITH {FWD_SQL}{RANK_SQL.format(k='feature')} {_P_SQL.format(k="feature")}")
def sta8(spark, d):
    """Every feature over the whole panel; its ranks are counted in parts, not in one task a feature."""
    panel = settled(_panel(spark, d).filter("value is not null and fwd is not null").select("feature", "value", "fwd"))
    return _with_p(S.split_spearman(panel, ["feature"], "value", "fwd"), "feature")


@query("sta9_walk_forward", f"""WITH {FWD_SQL}, k0 AS (SELECT *, row_number() OVER (PARTITION BY feature, ticker ORDER BY date) AS r, count(*) OVER (PARTITION BY feature, ticker) AS c FROM lg WHERE value IS NOT NULL AND fwd IS NOT NULL),
known AS (SELECT * FROM k0 WHERE r > floor(c * 0.6::DOUBLE)), rk AS (SELECT feature, ticker, rank() OVER (PARTITION BY feature, ticker ORDER BY value) + (count(*) OVER (PARTITION BY feature, ticker, value) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature, ticker ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, ticker, fwd) - 1) / 2.0::DOUBLE AS ry FROM known)
SELECT feature, ticker, round(corr(rx, ry), 6) + 0 AS spearman, count(*) AS n FROM rk GROUP BY 1, 2""")
def sta9(spark, d):
    w = Window.partitionBy("feature", "ticker")
    p = _panel(spark, d).filter("value is not null and fwd is not null").withColumn("r", F.row_number().over(w.orderBy("date"))).withColumn("c", F.count("*").over(w))
    late = p.filter(F.col("r") > F.floor(F.col("c") * 0.6))
    return S.spearman(late, ["feature", "ticker"], "value", "fwd").select("feature", "ticker", (F.round("spearman", 6) + F.lit(0.0)).alias("spearman"), "n")


@query("sta10_quartile_spread", f"""WITH {FWD_SQL}, q AS (SELECT feature, ticker, fwd, ntile(4) OVER (PARTITION BY feature, ticker ORDER BY value, date) AS q FROM lg WHERE value IS NOT NULL AND fwd IS NOT NULL)
SELECT feature, ticker, round(avg(fwd) FILTER (q = 1), 6) + 0 AS q1, round(avg(fwd) FILTER (q = 4), 6) + 0 AS q4 FROM q GROUP BY 1, 2""")
def sta10(spark, d):
    w = Window.partitionBy("feature", "ticker").orderBy("value", "date")
    p = _panel(spark, d).filter("value is not null and fwd is not null").withColumn("q", F.ntile(4).over(w))
    return p.groupBy("feature", "ticker").agg(*[(F.round(F.avg(F.when(F.col("q") == k, F.col("fwd"))), 6) + F.lit(0.0)).alias(f"q{k}") for k in (1, 4)])


@query("sta11_sector_relative", f"""WITH {SNAPSHOTS_SQL}, g AS (SELECT snapshot_date, sector, quantile_cont(sweep_share, 0.1) AS p10, quantile_cont(sweep_share, 0.5) AS p50, quantile_cont(sweep_share, 0.9) AS p90 FROM snapshots GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT s.ticker, s.snapshot_date, round(CASE WHEN p90 > p10 THEN greatest(-2, least(2, (sweep_share - p50) / (p90 - p10))) END, 6) + 0 AS rel FROM snapshots s JOIN g USING (snapshot_date, sector)""")
def sta11(spark, d):
    s = snapshots(spark, d)
    g = s.groupBy("snapshot_date", "sector").agg(F.percentile("sweep_share", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.count("*").alias("n")).filter("n >= 3")
    p = [F.col("p")[i] for i in range(3)]
    rel = F.when(p[2] > p[0], F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("sweep_share") - p[1]) / (p[2] - p[0]))))
    return s.join(g, ["snapshot_date", "sector"]).select("ticker", "snapshot_date", (F.round(rel, 6) + F.lit(0.0)).alias("rel"))
