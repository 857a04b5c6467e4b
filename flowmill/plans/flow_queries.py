"""Queries on flow events: projections, ticker aggregates, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import flow as X
from ..operators import flow as O
from ..sources.fixtures import FLOW_SQL, QUALIFIED_SQL, flow_events
from .registry import query

KEY = ["l_orderkey", "l_linenumber"]


def flow(spark: SparkSession, d: str) -> DataFrame:
    return X.with_direction(flow_events(spark, d))


def qualified(spark: SparkSession, d: str) -> DataFrame:
    return O.with_repeat_count(X.qualifying(flow(spark, d), 10_000)).withColumn("volume_oi_ratio", X.volume_oi_ratio())


@query("prj1_qualifying_flow", f"WITH {FLOW_SQL} SELECT l_orderkey, l_linenumber, ticker, premium, dte FROM flow WHERE premium >= 10000 AND dte BETWEEN 30 AND 120 AND execution_side IN ('ASK', 'BID')")
def prj1(spark, d):
    return X.qualifying(flow(spark, d), 10_000).select(*KEY, "ticker", "premium", "dte")


@query("prj1_ask_side_only", f"WITH {FLOW_SQL} SELECT l_orderkey, l_linenumber, ticker, premium FROM flow WHERE premium >= 50000 AND dte BETWEEN 30 AND 120 AND execution_side = 'ASK'")
def prj1b(spark, d):
    return X.qualifying(flow(spark, d), 50_000, require_ask_side=True).select(*KEY, "ticker", "premium")


@query("prj2_side_direction", f"WITH {FLOW_SQL} SELECT l_orderkey, l_linenumber, execution_side, direction, direction_confidence FROM flow")
def prj2(spark, d):
    return flow(spark, d).select(*KEY, "execution_side", "direction", "direction_confidence")


@query("prj3_volume_oi_ratio", f"WITH {FLOW_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN open_interest <> 0 THEN CAST(volume AS DOUBLE) / open_interest END AS volume_oi_ratio FROM flow")
def prj3(spark, d):
    return flow(spark, d).select(*KEY, X.volume_oi_ratio().alias("volume_oi_ratio"))


@query("prj4_recency_decay", f"""WITH {FLOW_SQL}, r AS (SELECT *, exp(-ln(2::DOUBLE) * greatest(epoch(event_date + INTERVAL 16 HOUR - event_ts) / 3600.0::DOUBLE, 0) / 6.0::DOUBLE) AS w FROM flow)
SELECT l_orderkey, l_linenumber, round(w, 8) AS recency_weight, round(premium * w, 4) AS premium FROM r""")
def prj4(spark, d):
    f = flow(spark, d).withColumn("w", X.recency_weight(F.timestamp_add("HOUR", F.lit(16), F.col("event_date").cast("timestamp"))))
    return f.select(*KEY, F.round("w", 8).alias("recency_weight"), F.round(F.col("premium") * F.col("w"), 4).alias("premium"))


OCC_SQL = "upper(trim(ticker)) || strftime(expiration_date, '%y%m%d') || substr(option_type, 1, 1) || lpad(CAST(CAST(round(strike * 1000) AS BIGINT) AS VARCHAR), 8, '0')"


@query("prj5_occ_build", f"WITH {FLOW_SQL} SELECT l_orderkey, l_linenumber, {OCC_SQL} AS contract_id FROM flow")
def prj5(spark, d):
    return flow(spark, d).select(*KEY, X.occ_id(F.col("ticker"), F.col("expiration_date"), F.col("option_type"), F.col("strike")).alias("contract_id"))


@query("prj6_occ_parse", f"WITH {FLOW_SQL} SELECT DISTINCT {OCC_SQL} AS contract_id, ticker AS occ_ticker, expiration_date AS occ_expiry, option_type AS occ_type, round(strike * 1000) / 1000 AS occ_strike FROM flow")
def prj6(spark, d):
    ids = flow(spark, d).select(X.occ_id(F.col("ticker"), F.col("expiration_date"), F.col("option_type"), F.col("strike")).alias("contract_id")).distinct()
    return ids.select("contract_id", *[c.alias(k) for k, c in X.parse_occ(F.col("contract_id")).items()])


CDF_SQL = """(CASE WHEN {x} >= 0 THEN (1 + {e}) / 2 ELSE (1 - {e}) / 2 END)"""
DELTA_SQL = """, dl0 AS (SELECT *, greatest(CAST(dte AS DOUBLE), 1.0::DOUBLE) / 365.0::DOUBLE AS t FROM flow),
dl1 AS (SELECT *, (ln(underlying_price / strike) + 0.5::DOUBLE * 0.35::DOUBLE * 0.35::DOUBLE * t) / (0.35::DOUBLE * sqrt(t)) AS d1 FROM dl0),
dl2 AS (SELECT *, abs(d1) / sqrt(2::DOUBLE) AS z FROM dl1),
dl3 AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z) AS k FROM dl2),
dl4 AS (SELECT *, 1 - k * (0.254829592::DOUBLE + k * (-0.284496736::DOUBLE + k * (1.421413741::DOUBLE + k * (-1.453152027::DOUBLE + k * 1.061405429::DOUBLE)))) * exp(-z * z) AS erf FROM dl3),
delta AS (SELECT *, CASE WHEN d1 >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END - CASE WHEN option_type = 'PUT' THEN 1 ELSE 0 END AS delta_proxy FROM dl4)"""


@query("prj7_delta_proxy", f"WITH {FLOW_SQL}{DELTA_SQL} SELECT l_orderkey, l_linenumber, round(delta_proxy, 6) + 0 AS delta FROM delta")
def prj7(spark, d):
    return flow(spark, d).select(*KEY, (F.round(X.delta_proxy(), 6) + F.lit(0.0)).alias("delta"))


@query("prj8_linear_delta", f"""WITH {FLOW_SQL} SELECT l_orderkey, l_linenumber, round(0.5::DOUBLE + greatest(-0.45::DOUBLE, least(0.45::DOUBLE, 5 * (underlying_price - strike) / underlying_price)) - CASE WHEN option_type = 'PUT' THEN 1 ELSE 0 END, 6) AS delta FROM flow""")
def prj8(spark, d):
    return flow(spark, d).select(*KEY, F.round(X.linear_delta(), 6).alias("delta"))


@query("prj9_delta_selection", f"""WITH {FLOW_SQL}{DELTA_SQL}, c AS (SELECT *, {OCC_SQL} AS id FROM delta),
g AS (SELECT id, max(l_partkey % 90 + 5) / 100.0::DOUBLE AS vendor FROM c WHERE l_orderkey % 3 = 0 GROUP BY 1),
m AS (SELECT *, least(abs(coalesce(vendor, delta_proxy)), 1.0::DOUBLE) AS mag FROM c LEFT JOIN g USING (id))
SELECT l_orderkey, l_linenumber, round(mag, 6) + 0 AS delta_magnitude, round(CASE WHEN option_type = 'PUT' THEN -mag ELSE mag END, 6) + 0 AS delta, round(premium * mag, 4) AS delta_premium,
  CASE WHEN vendor IS NOT NULL THEN 'vendor' WHEN delta_proxy IS NOT NULL THEN 'proxy' ELSE 'missing' END AS delta_source FROM m""")
def prj9(spark, d):
    f = flow(spark, d).withColumn("id", X.occ_id(F.col("ticker"), F.col("expiration_date"), F.col("option_type"), F.col("strike")))
    greeks = f.filter("l_orderkey % 3 = 0").groupBy("id").agg((F.max(F.col("l_partkey") % 90 + 5) / 100.0).alias("vendor"))
    j = X.delta_choice(f.join(greeks, "id", "left"), F.col("vendor"))
    return j.select(*KEY, *[(F.round(c, k) + F.lit(0.0)).alias(c) for c, k in (("delta_magnitude", 6), ("delta", 6), ("delta_premium", 4))], "delta_source")


@query("prj10_clip_scale", f"""WITH {QUALIFIED_SQL} SELECT l_orderkey, l_linenumber, round((least(greatest(coalesce(volume_oi_ratio, 0), 0.5::DOUBLE), 3.0::DOUBLE) - 0.5::DOUBLE) / 2.5::DOUBLE, 8) AS vol_oi_unit,
  round((least(greatest(ln(1 + premium / marketcap * 10000), ln(1.005::DOUBLE)), ln(1.5::DOUBLE)) - ln(1.005::DOUBLE)) / (ln(1.5::DOUBLE) - ln(1.005::DOUBLE)), 8) AS ppt_unit FROM q""")
def prj10(spark, d):
    t = X.FLOW_THRESHOLDS
    ppt = X.clip_scale(F.log1p(F.col("premium") / F.col("marketcap") * 10_000), *t["premium_per_trade"])
    return qualified(spark, d).select(*KEY, F.round(X.clip_scale(F.coalesce("volume_oi_ratio", F.lit(0.0)), *t["vol_oi"]), 8).alias("vol_oi_unit"), F.round(ppt, 8).alias("ppt_unit"))


@query("prj11_minmax_scale", f"""WITH {FLOW_SQL}, p AS (SELECT ticker, sum(premium) AS premium FROM flow GROUP BY 1), m AS (SELECT min(premium) AS lo, max(premium) AS hi FROM p)
SELECT ticker, round(CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (premium - lo) / (hi - lo) END, 6) AS scaled FROM p, m""")
def prj11(spark, d):
    p = flow(spark, d).groupBy("ticker").agg(F.sum("premium").alias("premium"))
    m = p.agg(F.min("premium").alias("lo"), F.max("premium").alias("hi"))  # one row
    return p.crossJoin(F.broadcast(m)).select("ticker", F.round(F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("premium") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("scaled"))


@query("prj12_dte_buckets", f"""WITH {FLOW_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN dte <= 7 THEN '0-7' WHEN dte <= 30 THEN '8-30' WHEN dte <= 90 THEN '31-90' ELSE '91+' END AS tracker_bucket,
  CASE WHEN dte BETWEEN 0 AND 14 THEN 'lottery' WHEN dte BETWEEN 30 AND 120 THEN 'swing' WHEN dte >= 180 THEN 'leap' END AS premium_bucket,
  CASE WHEN dte BETWEEN 30 AND 90 THEN 1.0::DOUBLE WHEN dte > 90 AND dte <= 150 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS dte_score FROM flow""")
def prj12(spark, d):
    return flow(spark, d).select(*KEY, X.bucket(F.col("dte")).alias("tracker_bucket"), X.bucket(F.col("dte"), X.PREMIUM_BUCKETS).alias("premium_bucket"), X.dte_score(F.col("dte")).alias("dte_score"))


def _side_sql(side: str, way: str) -> str:
    on = f"direction = '{way}'"
    return f"""coalesce(sum(premium * direction_confidence) FILTER ({on}), 0) AS {side}_premium, count(*) FILTER ({on}) AS {side}_count, avg(volume_oi_ratio) FILTER ({on}) AS {side}_vol_oi,
  count(*) FILTER ({on} AND is_sweep) AS {side}_sweep_count, coalesce(sum(premium * direction_confidence) FILTER ({on} AND is_sweep), 0) AS {side}_sweep_premium,
  coalesce(max(premium * direction_confidence) FILTER ({on}), 0) AS {side}_max_trade_premium, count(*) FILTER ({on} AND last_ts - event_ts <= INTERVAL 2 HOUR) AS {side}_repeat_2h"""


def _derived_sql(side: str) -> str:
    return f"""CASE WHEN {side}_count > 0 THEN {side}_premium / {side}_count ELSE 0 END AS {side}_premium_per_trade, CASE WHEN {side}_premium > 0 THEN 1 - {side}_max_trade_premium / {side}_premium ELSE 0 END AS {side}_breadth,
  coalesce({side}_premium / cap, 0) AS {side}_flow_intensity, coalesce(CASE WHEN {side}_count > 0 THEN {side}_premium / {side}_count ELSE 0 END / cap * 10000, 0) AS {side}_ppt_bps,
  CASE WHEN {side}_count >= 3 THEN CAST({side}_repeat_2h AS DOUBLE) / {side}_count ELSE 0 END AS {side}_accel_ratio"""


def _clip(x: str, lo: str, hi: str) -> str:
    return f"(least(greatest({x}, {lo}), {hi}) - {lo}) / ({hi} - {lo})"


def _score_sql(side: str) -> str:
    f = "::DOUBLE"
    return " + ".join([
        f"0.29{f} * {_clip(f'ln(1 + {side}_flow_intensity * 10000)', 'ln(1.01::DOUBLE)', 'ln(2.0::DOUBLE)')}", f"0.17{f} * {_clip(f'ln(1 + {side}_ppt_bps)', 'ln(1.005::DOUBLE)', 'ln(1.5::DOUBLE)')}",
        f"0.17{f} * {_clip(f'coalesce({side}_vol_oi, 0)', '0.5::DOUBLE', '3.0::DOUBLE')}", f"0.14{f} * {_clip(f'{side}_count', '1.0::DOUBLE', '10.0::DOUBLE')}",
        f"0.12{f} * {_clip(f'{side}_sweep_count', '0.0::DOUBLE', '8.0::DOUBLE')}", f"0.06{f} * {_clip('dte_score', '0.3::DOUBLE', '1.0::DOUBLE')}", f"0.05{f} * {_clip(f'{side}_breadth', '0.1::DOUBLE', '0.8::DOUBLE')}",
    ])


AGG_SQL = QUALIFIED_SQL + f""",
ql AS (SELECT *, max(event_ts) OVER (PARTITION BY ticker) AS last_ts FROM q),
a0 AS (SELECT ticker, sum(premium) AS total_premium, count(*) AS total_count, avg(dte) AS avg_dte, avg(volume_oi_ratio) AS avg_volume_oi_ratio, count(*) FILTER (is_multileg) AS multileg_count, max(marketcap) AS marketcap,
  {_side_sql("bullish", "LONG")}, {_side_sql("bearish", "SHORT")} FROM ql GROUP BY 1),
a1 AS (SELECT *, CASE WHEN marketcap >= 1e8 THEN marketcap END AS cap, bullish_premium - bearish_premium AS net_premium_bias FROM a0),
agg0 AS (SELECT *, CASE WHEN net_premium_bias > 0 THEN 'LONG' WHEN net_premium_bias < 0 THEN 'SHORT' ELSE 'NEUTRAL' END AS dominant_direction,
  CASE WHEN bearish_premium > 0 THEN least(bullish_premium / bearish_premium, 99) WHEN bullish_premium > 0 THEN 99 ELSE 1 END AS flow_imbalance_ratio,
  CASE WHEN avg_dte BETWEEN 30 AND 90 THEN 1.0::DOUBLE WHEN avg_dte > 90 AND avg_dte <= 150 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS dte_score, {_derived_sql("bullish")}, {_derived_sql("bearish")} FROM a1),
agg AS (SELECT *, {_score_sql("bullish")} AS bullish_score, {_score_sql("bearish")} AS bearish_score,
  CASE WHEN dominant_direction = 'SHORT' THEN CASE WHEN bearish_count > 0 THEN CAST(bearish_sweep_count AS DOUBLE) / bearish_count ELSE 0 END ELSE CASE WHEN bullish_count > 0 THEN CAST(bullish_sweep_count AS DOUBLE) / bullish_count ELSE 0 END END AS sweep_share,
  CAST(multileg_count AS DOUBLE) / total_count AS multileg_share FROM agg0)"""

ROUNDED = ["total_premium", "avg_dte", "avg_volume_oi_ratio", "flow_imbalance_ratio", "sweep_share", "multileg_share", "net_premium_bias"] + [f"{s}_{c}" for s in ("bullish", "bearish") for c in ("premium", "vol_oi", "sweep_premium", "premium_per_trade", "breadth", "accel_ratio", "score")]
WHOLE = ["ticker", "total_count", "multileg_count", "dominant_direction", "dte_score"] + [f"{s}_{c}" for s in ("bullish", "bearish") for c in ("count", "sweep_count", "repeat_2h")]


def aggregated(spark: SparkSession, d: str) -> DataFrame:
    return O.with_scores(O.aggregate_by_ticker(qualified(spark, d)))


@query("agg1_flow_by_ticker", f"WITH {AGG_SQL} SELECT {', '.join(WHOLE)}, {', '.join(f'round({c} + 0.00000001, 4) AS {c}' for c in ROUNDED)} FROM agg")
def agg1(spark, d):
    # the shift keeps quotients that end on a half away from the rounding edge, here and in the SQL
    return aggregated(spark, d).select(*WHOLE, *[F.round(F.col(c) + 1e-8, 4).alias(c) for c in ROUNDED])


def _weighted_sql(side: str, way: str) -> str:
    on = f"FILTER (direction = '{way}')"
    return f"""coalesce(sum(p * direction_confidence) {on}, 0) AS {side}_premium, coalesce(sum(premium * direction_confidence) {on}, 0) AS {side}_premium_raw, coalesce(sum(p * mag * direction_confidence) {on}, 0) AS {side}_delta_premium,
  coalesce(sum(premium * direction_confidence) {on}, 0) / max(cap) AS {side}_flow_intensity, coalesce(sum(p * mag * direction_confidence) {on}, 0) / max(cap) AS {side}_delta_intensity, coalesce(sum(p * mag) {on} / nullif(sum(p) {on}, 0), 0) AS {side}_avg_delta,
  coalesce(sum(CASE WHEN vendor IS NOT NULL THEN p ELSE 0 END) {on} / nullif(sum(p) {on}, 0), 0) AS {side}_delta_source_mix"""


_WEIGHTED = {f"{s}_{c}": k for s in ("bullish", "bearish") for c, k in (("premium", 2), ("premium_raw", 2), ("delta_premium", 2), ("flow_intensity", 9), ("delta_intensity", 9), ("avg_delta", 5), ("delta_source_mix", 5))}


@query("agg1_decayed_delta_flow", f"""WITH {FLOW_SQL}{DELTA_SQL}, c AS (SELECT *, {OCC_SQL} AS id FROM delta), g AS (SELECT id, max(l_partkey % 90 + 5) / 100.0::DOUBLE AS vendor FROM c WHERE l_orderkey % 3 = 0 GROUP BY 1),
m AS (SELECT *, least(abs(coalesce(vendor, delta_proxy)), 1.0::DOUBLE) AS mag, premium * exp(-ln(2::DOUBLE) * greatest(epoch(event_date + INTERVAL 16 HOUR - event_ts) / 3600.0::DOUBLE, 0) / 6.0::DOUBLE) AS p, CASE WHEN marketcap >= 1e8 THEN marketcap END AS cap FROM c LEFT JOIN g USING (id)),
w AS (SELECT ticker, event_date, {_weighted_sql("bullish", "LONG")}, {_weighted_sql("bearish", "SHORT")} FROM m GROUP BY 1, 2)
SELECT ticker, event_date, {', '.join(f'round(coalesce({c}, 0) + {1e-6 if k == 2 else 0:.6f}, {k}) + 0 AS {c}' for c, k in _WEIGHTED.items())} FROM w""")
def agg1_weighted(spark, d):
    """The day's flow of each ticker, decayed to its close."""
    f = flow(spark, d).withColumn("id", X.occ_id(F.col("ticker"), F.col("expiration_date"), F.col("option_type"), F.col("strike")))
    greeks = f.filter("l_orderkey % 3 = 0").groupBy("id").agg((F.max(F.col("l_partkey") % 90 + 5) / 100.0).alias("vendor"))
    e = X.delta_choice(f.join(greeks, "id", "left"), F.col("vendor"))
    a = O.weighted_by_key(e, F.timestamp_add("HOUR", F.lit(16), F.col("event_date").cast("timestamp")), ["ticker", "event_date"])
    return a.select("ticker", "event_date", *[(F.round(F.col(c) + (1e-6 if k == 2 else 0.0), k) + F.lit(0.0)).alias(c) for c, k in _WEIGHTED.items()])


@query("prj13_weighted_score", f"WITH {AGG_SQL} SELECT ticker, round(bullish_score, 6) AS bullish_score, round(bearish_score, 6) AS bearish_score, round(0.12::DOUBLE * {_clip('bullish_sweep_count', '0.0::DOUBLE', '8.0::DOUBLE')} * 10, 6) AS bullish_sweep_contrib FROM agg")
def prj13(spark, d):
    return aggregated(spark, d).select("ticker", *[F.round(c, 6).alias(c) for c in ("bullish_score", "bearish_score", "bullish_sweep_contrib")])


@query("prj14_grades", f"""WITH {AGG_SQL}, s AS (SELECT ticker, round(bullish_score * 10, 1) AS score FROM agg), g AS (SELECT *, CASE WHEN score >= 8.5 THEN 'A+' WHEN score >= 7.5 THEN 'A' WHEN score >= 6.75 THEN 'A-' WHEN score >= 6 THEN 'B+' WHEN score >= 5 THEN 'B' WHEN score >= 4 THEN 'B-' ELSE 'C' END AS grade FROM s)
SELECT ticker, score, grade, substr(grade, 1, 1) AS family FROM g""")
def prj14(spark, d):
    s = aggregated(spark, d).select("ticker", F.round(F.col("bullish_score") * 10, 1).alias("score")).withColumn("grade", X.grade(F.col("score")))
    return s.withColumn("family", X.coarse_grade(F.col("grade")))


@query("agg2_premium_by_bucket", f"WITH {FLOW_SQL} SELECT ticker, {', '.join(f'''round(coalesce(sum(premium) FILTER (dte BETWEEN {lo} AND {hi} AND direction = '{way}'), 0), 4) AS {b}_{s}_premium''' for b, lo, hi in X.PREMIUM_BUCKETS for s, way in O.SIDES)} FROM flow GROUP BY 1")
def agg2(spark, d):
    p = O.premium_by_bucket(flow(spark, d))
    return p.select("ticker", *[F.round(c, 4).alias(c) for c in p.columns[1:]])


@query("agg3_dominant_bucket", f"""WITH {FLOW_SQL}, b AS (SELECT ticker, CASE WHEN dte <= 7 THEN '0-7' WHEN dte <= 30 THEN '8-30' WHEN dte <= 90 THEN '31-90' ELSE '91+' END AS bucket, round(sum(premium), 4) AS premium FROM flow GROUP BY 1, 2)
SELECT ticker, bucket AS dominant_dte_bucket, premium FROM b QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY premium DESC, bucket) = 1""")
def agg3(spark, d):
    return O.dominant_bucket(flow(spark, d))


@query("agg4_acceleration", f"WITH {AGG_SQL} SELECT ticker, {', '.join(f'{s}_repeat_2h, round({s}_accel_ratio, 6) AS {s}_accel_ratio, round(greatest(-0.5::DOUBLE, least(0.7::DOUBLE, {s}_accel_ratio - 2.0::DOUBLE / 6.5::DOUBLE)), 6) AS {s}_accel_score' for s in ('bullish', 'bearish'))} FROM agg")
def agg4(spark, d):
    a = aggregated(spark, d)
    return a.select("ticker", *[c for s in ("bullish", "bearish") for c in (F.col(f"{s}_repeat_2h"), F.round(f"{s}_accel_ratio", 6).alias(f"{s}_accel_ratio"), F.round(f"{s}_accel_score", 6).alias(f"{s}_accel_score"))])


@query("agg5_unusual_share", f"""WITH {QUALIFIED_SQL}, t AS (SELECT ticker, sum(premium) FILTER (option_type = 'CALL') AS c, sum(premium) FILTER (option_type = 'PUT') AS p FROM flow GROUP BY 1),
f AS (SELECT ticker, coalesce(sum(premium * direction_confidence) FILTER (direction = 'LONG'), 0) AS b, coalesce(sum(premium * direction_confidence) FILTER (direction = 'SHORT'), 0) AS s FROM q GROUP BY 1)
SELECT ticker, round(b / CASE WHEN c > 0 THEN c END, 6) AS bullish_unusual_premium_share, round(s / CASE WHEN p > 0 THEN p END, 6) AS bearish_unusual_premium_share FROM f LEFT JOIN t USING (ticker)""")
def agg5(spark, d):
    u = O.unusual_share(qualified(spark, d), flow(spark, d))
    return u.select("ticker", *[F.round(c, 6).alias(c) for c in u.columns[1:]])


def _rank_sql(side: str) -> str:
    return f"""(SELECT ticker, '{side}' AS side, row_number() OVER (ORDER BY {side}_score DESC, {side}_premium DESC, {side}_vol_oi DESC NULLS LAST, {side}_sweep_premium DESC, ticker) AS rank, round({side}_score, 6) AS score, round({side}_premium, 4) AS premium
  FROM agg WHERE {side}_premium > 0 QUALIFY rank <= 10)"""


@query("top1_rank_candidates", f"WITH {AGG_SQL} {_rank_sql('bullish')} UNION ALL {_rank_sql('bearish')}")
def top1(spark, d):
    return O.rank_candidates(aggregated(spark, d)).withColumn("score", F.round("score", 6)).withColumn("premium", F.round("premium", 4))


BOTH_SQL = AGG_SQL + """,
results AS (SELECT ticker, 'LONG' AS direction, round(bullish_score * 10, 4) AS final_score, bullish_premium AS premium FROM agg UNION ALL SELECT ticker, 'SHORT', round(bearish_score * 10, 4), bearish_premium FROM agg)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    """Both directions of every ticker with a 0-10 score, from one pass over the aggregate."""
    a = aggregated(spark, d)
    both = F.array(*[F.struct(F.lit(way).alias("direction"), F.round(F.col(f"{s}_score") * 10, 4).alias("final_score"), F.col(f"{s}_premium").alias("premium")) for s, way in O.SIDES])
    return a.select("ticker", F.inline(both))


@query("top2_best_direction", f"WITH {BOTH_SQL} SELECT ticker, direction, final_score FROM results QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY final_score DESC, direction) = 1")
def top2(spark, d):
    r = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("final_score"), "direction"))
    return results(spark, d).withColumn("_r", r).filter("_r = 1").select("ticker", "direction", "final_score")


@query("top3_directional_balance", f"""WITH {BOTH_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY final_score DESC, ticker) AS k FROM results)
SELECT ticker, direction, final_score FROM n WHERE k <= 5 OR final_score >= 5 + 1.5::DOUBLE * (k - 5)""")
def top3(spark, d):
    k = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("final_score"), "ticker"))
    return results(spark, d).withColumn("k", k).filter((F.col("k") <= 5) | (F.col("final_score") >= 5 + 1.5 * (F.col("k") - 5))).select("ticker", "direction", "final_score")


@query("top7_peak_intensity", f"WITH {AGG_SQL} SELECT ticker, round(greatest(bullish_flow_intensity, bearish_flow_intensity) * 10000, 6) AS peak_bps FROM agg ORDER BY peak_bps DESC, ticker LIMIT 15")
def top7(spark, d):
    return aggregated(spark, d).select("ticker", F.round(F.greatest("bullish_flow_intensity", "bearish_flow_intensity") * 10_000, 6).alias("peak_bps")).orderBy(F.desc("peak_bps"), "ticker").limit(15)


@query("top8_sorted_page", f"WITH {AGG_SQL} SELECT ticker, round(bullish_vol_oi, 6) AS bullish_vol_oi FROM agg ORDER BY round(bullish_vol_oi, 6) DESC NULLS LAST, ticker LIMIT 20 OFFSET 20")
def top8(spark, d):
    return aggregated(spark, d).select("ticker", F.round("bullish_vol_oi", 6).alias("bullish_vol_oi")).orderBy(F.desc_nulls_last("bullish_vol_oi"), "ticker").offset(20).limit(20)


@query("top10_score_cut", f"WITH {BOTH_SQL} SELECT ticker, direction, final_score FROM results WHERE final_score >= CASE WHEN direction = 'LONG' THEN 6.0 + 0.5 ELSE 6.0 + 0.5 + 1.0 END")
def top10(spark, d):
    least = 6.0 + 0.5 + F.when(F.col("direction") == "SHORT", 1.0).otherwise(0.0)
    return results(spark, d).filter(F.col("final_score") >= least).select("ticker", "direction", "final_score")


@query("top6_trades_per_ticker", f"WITH {FLOW_SQL} SELECT ticker, l_orderkey, l_linenumber, premium FROM flow QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY premium DESC, l_orderkey, l_linenumber) <= 10")
def top6(spark, d):
    r = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("premium"), *KEY))  # cut to ten per task before the shuffle
    return flow(spark, d).withColumn("_r", r).filter("_r <= 10").select("ticker", *KEY, "premium")


@query("win34_repeat_count", f"WITH {QUALIFIED_SQL} SELECT l_orderkey, l_linenumber, repeat_flow_count FROM q")
def win34(spark, d):
    return qualified(spark, d).select(*KEY, "repeat_flow_count")


@query("top12_point_score", f"""WITH {AGG_SQL}, s AS (SELECT ticker, bullish_premium AS p, bullish_count AS n, bullish_breadth AS b, sweep_share AS w FROM agg),
m AS (SELECT min(p) AS p0, max(p) AS p1, min(n) AS n0, max(n) AS n1, min(b) AS b0, max(b) AS b1, min(w) AS w0, max(w) AS w1 FROM s),
r AS (SELECT ticker, round(0.45::DOUBLE * CASE WHEN p1 = p0 THEN 0.5::DOUBLE ELSE (p - p0) / (p1 - p0) END + 0.25::DOUBLE * CASE WHEN n1 = n0 THEN 0.5::DOUBLE ELSE CAST(n - n0 AS DOUBLE) / (n1 - n0) END
  + 0.20::DOUBLE * CASE WHEN b1 = b0 THEN 0.5::DOUBLE ELSE (b - b0) / (b1 - b0) END + 0.10::DOUBLE * CASE WHEN w1 = w0 THEN 0.5::DOUBLE ELSE (w - w0) / (w1 - w0) END, 6) AS rank_score FROM s, m)
SELECT ticker, rank_score, round(rank_score * 10, 2) AS points, row_number() OVER (ORDER BY rank_score DESC, ticker) AS rank FROM r""")
def top12(spark, d):
    s = aggregated(spark, d).select("ticker", F.col("bullish_premium").alias("p"), F.col("bullish_count").alias("n"), F.col("bullish_breadth").alias("b"), F.col("sweep_share").alias("w"))
    m = s.agg(*[f(c).alias(f"{c}{i}") for c in "pnbw" for i, f in enumerate((F.min, F.max))])
    norm = lambda c: F.when(F.col(f"{c}1") == F.col(f"{c}0"), 0.5).otherwise((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")))
    r = s.crossJoin(F.broadcast(m)).select("ticker", F.round(0.45 * norm("p") + 0.25 * norm("n") + 0.20 * norm("b") + 0.10 * norm("w"), 6).alias("rank_score"))
    return r.select("ticker", "rank_score", F.round(F.col("rank_score") * 10, 2).alias("points"), F.row_number().over(Window.orderBy(F.desc("rank_score"), "ticker")).alias("rank"))


_MIX = ", ".join(f"round(coalesce(sum(premium) FILTER (direction = '{w}' AND vendor IS NOT NULL), 0) / sum(premium) FILTER (direction = '{w}'), 6) AS {s}_vendor_mix" for s, w in O.SIDES)


@query("agg29_event_coverage", f"""WITH {FLOW_SQL}{DELTA_SQL}, c AS (SELECT *, {OCC_SQL} AS id FROM delta), g AS (SELECT id, max(l_partkey % 90 + 5) / 100.0::DOUBLE AS vendor FROM c WHERE l_orderkey % 3 = 0 GROUP BY 1),
m AS (SELECT *, CASE WHEN open_interest IS NOT NULL THEN event_ts END AS ts FROM c LEFT JOIN g USING (id))
SELECT sector, round(avg(CASE WHEN ts IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, avg(CASE WHEN ts IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) >= 0.8 AS coverage_ok, {_MIX} FROM m GROUP BY 1""")
def agg29(spark, d):
    """Events without open interest stand for those that came without a time."""
    f = flow(spark, d).withColumn("id", X.occ_id(F.col("ticker"), F.col("expiration_date"), F.col("option_type"), F.col("strike")))
    greeks = f.filter("l_orderkey % 3 = 0").groupBy("id").agg((F.max(F.col("l_partkey") % 90 + 5) / 100.0).alias("vendor"))
    e = X.delta_choice(f.join(greeks, "id", "left"), F.col("vendor")).withColumn("event_ts", F.when(F.col("open_interest").isNotNull(), F.col("event_ts")))
    c = O.event_coverage(e, "sector")
    return c.select("sector", "coverage_ok", *[F.round(x, 6).alias(x) for x in ("coverage", "bullish_vendor_mix", "bearish_vendor_mix")])


_BASE = (("flow_intensity", 10), ("vol_oi", 6), ("unusual_premium_share", 6))


@query("sta6_history_baselines", f"""WITH {FLOW_SQL}, h AS (SELECT ticker, event_date AS date, l_linenumber % 2 AS feed, max(marketcap) AS mc, {', '.join(f"coalesce(sum(premium) FILTER (direction = '{w}'), 0) AS {s}, coalesce(sum(premium) FILTER (option_type = '{k}'), 0) AS {s}_tape, coalesce(sum(volume) FILTER (option_type = '{k}'), 0) AS {s}_v, coalesce(sum(open_interest) FILTER (option_type = '{k}'), 0) AS {s}_oi" for s, w, k in (('bullish', 'LONG', 'CALL'), ('bearish', 'SHORT', 'PUT')))} FROM flow GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY feed DESC) AS r FROM h WHERE mc >= 1e8)
SELECT upper(trim(ticker)) AS ticker, date, {', '.join(f"round({s} / mc, 10) AS {s}_flow_intensity, round(CAST({s}_v AS DOUBLE) / nullif({s}_oi, 0), 6) AS {s}_vol_oi, round({s} / nullif({s}_tape, 0), 6) AS {s}_unusual_premium_share" for s in ('bullish', 'bearish'))} FROM k WHERE r = 1""")
def sta6(spark, d):
    """Daily history; a day's two deliveries are its even and its odd line numbers."""
    some = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    aggs = [F.max("marketcap").alias("marketcap")]
    for side, way, kind in (("bullish", "LONG", "CALL"), ("bearish", "SHORT", "PUT")):
        aggs.append(some("premium", F.col("direction") == way).alias(f"{side}_premium"))
        aggs += [some(c, F.col("option_type") == kind).alias(f"{kind.lower()}_{c}") for c in ("premium", "volume", "open_interest")]
    days = flow(spark, d).groupBy("ticker", F.col("event_date").alias("date"), (F.col("l_linenumber") % 2).alias("feed")).agg(*aggs)
    b = O.history_baselines(days)
    return b.select("ticker", "date", *[F.round(f"{s}_{c}", k).alias(f"{s}_{c}") for s in ("bullish", "bearish") for c, k in _BASE])
