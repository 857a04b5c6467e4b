"""Queries on the finer parts of scores, streaks and positions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import scores as C
from ..operators import lab
from ..operators import panels as N
from ..operators import stats as S
from ..sources.fixtures import BARS_SQL, FLOW_SQL, SNAPSHOTS_SQL, bars, flow_events, snapshots
from .flow_queries import AGG_SQL, _clip, _score_sql, aggregated
from .panel_queries import SCAN_SQL
from .registry import query
from .review_queries import _R
from .surface_queries import LADDER_SQL
from .tracker_queries import PLAN_SQL, replayed

_SNAPS = SNAPSHOTS_SQL[SNAPSHOTS_SQL.index("snap0 AS"):]


@query("win29_vrp_proxy", f"""WITH {BARS_SQL}, {_SNAPS}, v0 AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars), v1 AS (SELECT *, count(r) {_R.format('UNBOUNDED')} AS n, stddev_samp(r) {_R.format(29)} AS s30 FROM v0),
v2 AS (SELECT *, CASE WHEN n >= 30 THEN s30 END AS rv FROM v1), v3 AS (SELECT *, list(rv) FILTER (rv IS NOT NULL) {_R.format(89)} AS hist FROM v2)
SELECT v3.ticker, date, round(100.0::DOUBLE * len(list_filter(hist, lambda x: x <= rv)) / len(hist), 4) AS rv_pct, round(s.iv_rank - 100.0::DOUBLE * len(list_filter(hist, lambda x: x <= rv)) / len(hist), 4) + 0 AS vrp_proxy FROM v3 JOIN snapshots s ON s.ticker = v3.ticker AND s.snapshot_date = date WHERE rv IS NOT NULL""")
def win29_vrp(spark, d):
    """The rank of implied volatility less the percentile of the realised one in its own history."""
    iv = snapshots(spark, d).select("ticker", F.col("snapshot_date").alias("date"), "iv_rank")
    v = lab.volatility(bars(spark, d)).filter("rv_pct is not null").join(iv, ["ticker", "date"])
    return v.select("ticker", "date", F.round("rv_pct", 4).alias("rv_pct"), (F.round(F.col("iv_rank") - F.col("rv_pct"), 4) + F.lit(0.0)).alias("vrp_proxy"))


@query("win32_streak_bonus", f"""WITH {SNAPSHOTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY snapshot_date DESC) AS r FROM snapshots), a AS (SELECT ticker, count(*) AS n, avg(sweep_share) AS mean_flow, regr_slope(sweep_share, -r) AS slope FROM r WHERE r <= 5 GROUP BY 1),
b AS (SELECT *, CAST(substr(ticker, 2) AS INT) % 9 AS days, CASE WHEN n < 3 THEN 'n/a' WHEN slope / greatest(abs(mean_flow), 1e-6) > 0.05 THEN 'rising' WHEN slope / greatest(abs(mean_flow), 1e-6) < -0.05 THEN 'falling' ELSE 'flat' END AS flow_trend FROM a)
SELECT ticker, days, flow_trend, CASE WHEN days >= 3 AND mean_flow >= 0.4 THEN round(least((days - 2) * 0.25::DOUBLE, 1) * CASE flow_trend WHEN 'rising' THEN 1 WHEN 'falling' THEN 0 ELSE 0.5::DOUBLE END, 4) ELSE 0 END AS streak_bonus FROM b""")
def win32_bonus(spark, d):
    t = N.streak_trend(snapshots(spark, d), ["ticker"], "sweep_share", "snapshot_date").withColumn("days", F.substring("ticker", 2, 9).cast("int") % 9)
    return t.select("ticker", "days", "flow_trend", C.streak_bonus(F.col("days"), F.col("flow_trend"), F.col("mean_flow")).alias("streak_bonus"))


@query("prj20_market_r", f"""WITH {PLAN_SQL} SELECT ticker, i, direction, round((x - en) / atr + 0.0000001, 2) + 0 AS r_from_entry, round((x - en) / atr + 1 + 0.0000001, 2) + 0 AS r_to_stop FROM replay""")
def prj20_r(spark, d):
    """Where replayed positions stood at their last price."""
    r = replayed(spark, d)
    a, b = C.r_at_market(F.col("direction"), F.col("entry"), F.col("stop"), F.col("exit_price"))
    return r.select("ticker", "i", "direction", *[(F.round(x + 1e-7, 2) + F.lit(0.0)).alias(n) for x, n in ((a, "r_from_entry"), (b, "r_to_stop"))])


@query("agg20_exposure_summary", f"""WITH {PLAN_SQL}, p AS (SELECT direction, s * en AS entry, floor(10000 / (s * en)) AS shares, atr, CASE CAST(i % 4 AS INT) WHEN 0 THEN 'STRONG' WHEN 1 THEN 'NEUTRAL' WHEN 2 THEN 'WEAK' ELSE 'FAILING' END AS h FROM replay),
q AS (SELECT sum(CASE direction WHEN 'LONG' THEN entry * shares ELSE 0 END) AS l, sum(CASE direction WHEN 'LONG' THEN 0 ELSE entry * shares END) AS s, count(*) AS positions, sum(atr * shares) AS risk, {', '.join(f"count(*) FILTER (h = '{h}') AS health_{h.lower()}" for h in C.HEALTH)} FROM p)
SELECT round(l, 1) AS long_exposure, round(s, 1) AS short_exposure, round(l + s, 1) AS gross_exposure, round(l - s, 1) + 0 AS net_exposure, round((l - s) / (l + s) * 100, 4) + 0 AS net_pct, round(least(risk / (l + s) * 100, 99.9::DOUBLE), 4) AS heat_pct, positions, {', '.join(f'health_{h.lower()}' for h in C.HEALTH)} FROM q""")
def agg20_summary(spark, d):
    """Replayed positions of ten thousand each as if all were open."""
    state = F.element_at(F.array(*[F.lit(h) for h in C.HEALTH]), (F.col("i") % 4 + 1).cast("int"))
    p = replayed(spark, d).select("direction", F.col("entry").alias("entry_price"), F.col("stop").alias("active_stop"), F.floor(10000 / F.col("entry")).alias("shares"), state.alias("health_state"))
    digits = {"long_exposure": 1, "short_exposure": 1, "gross_exposure": 1, "net_exposure": 1, "net_pct": 4, "heat_pct": 4}
    return C.exposure_summary(p).select(*[(F.round(c, k) + F.lit(0.0)).alias(c) for c, k in digits.items()], "positions", *[f"health_{h.lower()}" for h in C.HEALTH])


@query("agg17_trajectory_bonus", f"""WITH {SCAN_SQL}, a AS (SELECT ticker, direction, count(*) AS n, arg_min(premium, scan) AS f, arg_max(premium, scan) AS l, count(DISTINCT date_trunc('year', scan)) AS y FROM scans GROUP BY 1, 2), b AS (SELECT *, n % 11 AS active, least((l - f) / nullif(f, 0), 1) AS g FROM a)
SELECT ticker, direction, active, round(CASE WHEN active > 1 THEN 0.3::DOUBLE * least(active / 8.0::DOUBLE, 1) * (0.5::DOUBLE + 0.3::DOUBLE * greatest(0, coalesce(g, 0)) + 0.2::DOUBLE * y / 7.0::DOUBLE) ELSE 0 END, 4) AS trajectory_bonus FROM b""")
def agg17_bonus(spark, d):
    from .flow_queries import flow

    scans = flow(spark, d).filter("direction is not null").groupBy("ticker", "direction", F.date_trunc("month", "event_ts").alias("scan")).agg(F.round(F.sum("premium"), 2).alias("premium"))
    years = scans.groupBy("ticker", "direction").agg(F.count_distinct(F.date_trunc("year", "scan")).alias("y"))
    t = N.trajectory(scans).join(years, ["ticker", "direction"]).withColumn("active", F.col("scans_active") % 11)
    bonus = C.trajectory_bonus(F.col("active"), F.when(F.col("growth").isNotNull(), F.least(F.col("growth"), F.lit(1.0))), F.col("y") / 7.0)
    return t.select("ticker", "direction", "active", F.round(bonus, 4).alias("trajectory_bonus"))


def _roll_sql(k: int) -> str:
    over = f"OVER (PARTITION BY ticker, direction ORDER BY date RANGE BETWEEN INTERVAL {k - 1} DAY PRECEDING AND CURRENT ROW)"
    return f"SELECT ticker, direction, date, '{k}D' AS \"window\", " + ", ".join(f"sum({c}) {over} AS {c}" for c in ("p", "n", "dp", "v", "vn", "c", "u")) + " FROM dd"


@query("agg33_rolling_detail", f"""WITH {FLOW_SQL}, dd AS (SELECT ticker, direction, event_date AS date, sum(premium) AS p, count(*) AS n, sum(premium * dte) AS dp, coalesce(sum(CAST(volume AS DOUBLE) / open_interest), 0) AS v, count(open_interest) AS vn, sum(CASE option_type WHEN 'CALL' THEN premium ELSE 0 END) AS c, sum(CASE option_type WHEN 'PUT' THEN premium ELSE 0 END) AS u FROM flow WHERE direction IS NOT NULL GROUP BY 1, 2, 3),
w AS ({' UNION ALL '.join(_roll_sql(k) for k in (1, 3, 5))})
SELECT ticker, direction, date, "window", round(p, 2) AS total_premium, CAST(n AS BIGINT) AS event_count, round(dp / nullif(p, 0) + 0.0000001, 4) AS avg_dte_weighted, round(v / nullif(vn, 0) + 0.0000001, 4) AS avg_volume_oi_ratio, round(c, 2) AS call_premium, round(u, 2) AS put_premium, round((c - u) / nullif(c + u, 0), 4) + 0 AS flow_bias FROM w""")
def agg33_detail(spark, d):
    from .flow_queries import flow

    e = flow(spark, d).filter("direction is not null").withColumnRenamed("event_date", "date").withColumn("volume_oi_ratio", F.try_divide(F.col("volume").cast("double"), F.nullif("open_interest", F.lit(0))))
    r = N.rolling_flow(e)
    return r.select("ticker", "direction", "date", "window", F.round("total_premium", 2).alias("total_premium"), "event_count", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("avg_dte_weighted", "avg_volume_oi_ratio")], *[F.round(c, 2).alias(c) for c in ("call_premium", "put_premium")], (F.round("flow_bias", 4) + F.lit(0.0)).alias("flow_bias"))


def _ladder_sql(tag: str) -> str:
    """The z ladder over tables of its own: today_<tag>, hist_<tag> to lad_<tag>."""
    return re.sub(r"\b(om|own|pa|pm|peers|sc|al|lad0|lad1|lad|hist|today)\b", rf"\1_{tag}", LADDER_SQL)


_FLOW_UNIT, _SWEEP_UNIT = _clip("ln(1 + bullish_flow_intensity * 10000)", "ln(1.01::DOUBLE)", "ln(2.0::DOUBLE)"), _clip("bullish_sweep_count", "0.0::DOUBLE", "8.0::DOUBLE")
_MIXED = _score_sql("bullish").replace(_FLOW_UNIT, f"coalesce(1 / (1 + exp(-f.z)), {_FLOW_UNIT})").replace(_SWEEP_UNIT, f"coalesce(1 / (1 + exp(-w.z)), {_SWEEP_UNIT})")


@query("sta4_mixed_score", f"""WITH {AGG_SQL}, {_SNAPS}, se AS (SELECT ticker, min(sector) AS sector FROM flow_events GROUP BY 1),
today_f AS (SELECT ticker, sector, bullish_flow_intensity AS v FROM agg JOIN se USING (ticker)), hist_f AS (SELECT ticker, total_bullish_premium / marketcap AS v FROM snapshots WHERE trades > 1),
today_w AS (SELECT ticker, sector, CAST(bullish_sweep_count AS DOUBLE) AS v FROM agg JOIN se USING (ticker)), hist_w AS (SELECT ticker, sweep_share * trades AS v FROM snapshots WHERE CAST(substr(ticker, 2) AS INT) % 3 <> 0){_ladder_sql('f')}{_ladder_sql('w')}
SELECT agg.ticker, round({_MIXED}, 5) AS bullish_score_mixed, f.tier AS bullish_flow_intensity_tier, w.tier AS bullish_sweep_tier, 4 AS bullish_breadth_tier, greatest(f.tier, w.tier, 4) AS bullish_zscore_tier FROM agg JOIN lad_f f ON f.ticker = agg.ticker JOIN lad_w w ON w.ticker = agg.ticker""")
def sta4_mixed(spark, d):
    """Two components by their history, the others by absolute units; a third of the tickers have no history of one of them."""
    sector = flow_events(spark, d).groupBy("ticker").agg(F.min("sector").alias("sector"))
    agg, s = aggregated(spark, d).join(sector, "ticker"), snapshots(spark, d)
    past = {
        "flow_intensity": s.filter("trades > 1").select("ticker", (F.col("total_bullish_premium") / F.col("marketcap")).alias("v")),
        "sweep": s.filter(F.substring("ticker", 2, 9).cast("int") % 3 != 0).select("ticker", (F.col("sweep_share") * F.col("trades")).alias("v")),
    }
    m = S.mixed_scores(agg, past, "bullish")
    return m.select("ticker", F.round("bullish_score_mixed", 5).alias("bullish_score_mixed"), "bullish_flow_intensity_tier", "bullish_sweep_tier", "bullish_breadth_tier", "bullish_zscore_tier")
