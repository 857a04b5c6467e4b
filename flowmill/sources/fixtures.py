"""Market-flow tables derived from the driver's star schema, and the same as DuckDB CTEs.

flow_events: one option trade per line item. prints: one off-exchange print per event. bars: weekly price bars of
each ticker. snapshots: weekly flow per ticker. The SQL constants are CTE bodies to put after WITH."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settled


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def flow_events(spark: SparkSession, d: str) -> DataFrame:
    """Canonical flow events. The dimension tables are keyed by the fact's foreign keys; Spark picks the join by their
    size, which it knows as long as they are joined one by one (a joined table counts as the product of both)."""
    line, supp, part = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "part")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    places = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name"))
    s = supp.select("s_suppkey", "s_acctbal", "s_nationkey")
    p = part.select("p_partkey", "p_size", "p_retailprice")
    t = line.join(s, line.l_suppkey == s.s_suppkey).join(p, line.l_partkey == p.p_partkey).join(places, F.col("s_nationkey") == places.n_nationkey)
    minute = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 390
    day = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date"))
    ts = F.timestamp_add("MINUTE", minute.cast("int"), F.col("l_shipdate"))
    dte = ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 29) % 200).cast("int")
    ask = F.when(F.col("l_returnflag") == "A", 0.8).when(F.col("l_returnflag") == "R", 0.2).otherwise(0.5)
    return t.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), F.col("r_name").alias("sector"), ((F.col("s_acctbal") + 2000) * 1e5).alias("marketcap"),
        ts.alias("event_ts"), F.to_date(F.col("l_shipdate")).alias("event_date"),
        F.when(F.col("l_linestatus") == "O", "CALL").otherwise("PUT").alias("option_type"),
        F.round("p_retailprice", 2).alias("strike"),
        F.round(900 + F.col("l_extendedprice") / 1050 + 40 * F.sin(day / 200 + F.col("l_suppkey")), 4).alias("underlying_price"),
        dte.alias("dte"), F.date_add(F.to_date("l_shipdate"), dte).alias("expiration_date"), F.col("l_extendedprice").alias("premium"),
        F.round(F.col("l_extendedprice") * ask, 4).alias("ask_side_premium"), F.round(F.col("l_extendedprice") * (1 - ask), 4).alias("bid_side_premium"),
        F.col("l_quantity").cast("long").alias("volume"), F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("long")).alias("open_interest"),
        (F.col("l_tax") >= 0.04).alias("is_sweep"), (F.col("l_discount") >= 0.08).alias("is_multileg"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


FLOW_SQL = """flow_events AS (
  SELECT 'S' || l_suppkey AS ticker, r_name AS sector, (s_acctbal + 2000) * 1e5 AS marketcap,
    l_shipdate + to_minutes(CAST((l_orderkey * 37 + l_linenumber * 11) % 390 AS INT)) AS event_ts, CAST(l_shipdate AS DATE) AS event_date,
    CASE WHEN l_linestatus = 'O' THEN 'CALL' ELSE 'PUT' END AS option_type, round(p_retailprice, 2) AS strike,
    round(900 + l_extendedprice / 1050 + 40 * sin(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 200 + l_suppkey), 4) AS underlying_price,
    CAST((l_partkey * 7 + l_linenumber * 29) % 200 AS INT) AS dte,
    CAST(l_shipdate AS DATE) + CAST((l_partkey * 7 + l_linenumber * 29) % 200 AS INT) AS expiration_date, l_extendedprice AS premium,
    round(l_extendedprice * CASE l_returnflag WHEN 'A' THEN 0.8::DOUBLE WHEN 'R' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END, 4) AS ask_side_premium,
    round(l_extendedprice * (1 - CASE l_returnflag WHEN 'A' THEN 0.8::DOUBLE WHEN 'R' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END), 4) AS bid_side_premium,
    CAST(l_quantity AS BIGINT) AS volume, CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS BIGINT) END AS open_interest,
    l_tax >= 0.04 AS is_sweep, l_discount >= 0.08 AS is_multileg, l_orderkey, l_linenumber, l_partkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey),
sided AS (
  SELECT *, CASE WHEN ask_side_premium > bid_side_premium THEN 'ASK' WHEN bid_side_premium > ask_side_premium THEN 'BID' ELSE 'MIXED' END AS execution_side FROM flow_events),
flow AS (
  SELECT *, CASE WHEN execution_side = 'MIXED' THEN NULL WHEN (option_type = 'CALL') = (execution_side = 'ASK') THEN 'LONG' ELSE 'SHORT' END AS direction,
    CASE execution_side WHEN 'ASK' THEN 1.0::DOUBLE WHEN 'BID' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS direction_confidence FROM sided)"""

#: The filter that the queries below use: the default floors scaled to these premiums.
QUALIFIED_SQL = FLOW_SQL + """,
q AS (SELECT *, CASE WHEN open_interest <> 0 THEN CAST(volume AS DOUBLE) / open_interest END AS volume_oi_ratio, count(*) OVER (PARTITION BY ticker) AS repeat_flow_count
  FROM flow WHERE premium >= 10000 AND dte BETWEEN 30 AND 120 AND option_type IN ('CALL', 'PUT') AND execution_side IN ('ASK', 'BID'))"""


#: Events in a partition of tickers.
PER_TASK = 60_000


def tasks_of(spark: SparkSession, d: str) -> int:
    """Partitions of about PER_TASK events each."""
    rows = table(spark, d, "lineitem").count()  # from the footers
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PER_TASK)


def by_ticker(events: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """events in partitions of whole tickers, of about PER_TASK rows at any size of the input: what follows per ticker, or per
    ticker and week, needs no other shuffle. An event is hardly wider than a partial sum, and a ticker has few events a week."""
    return events.repartition(tasks_of(spark, d), "ticker")


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Weekly OHLCV bars per ticker from the underlying prices of its flow events, in partitions of whole tickers."""
    f = flow_events(spark, d).withColumn("date", F.to_date(F.date_trunc("week", "event_ts")))
    f = by_ticker(f.select("ticker", "date", "event_ts", "l_orderkey", "l_linenumber", "underlying_price", "volume"), spark, d)
    at = F.struct("event_ts", "l_orderkey", "l_linenumber")
    px = F.col("underlying_price")
    return f.groupBy("ticker", "date").agg(F.min_by(px, at).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, at).alias("close"), F.sum("volume").alias("volume"))


BARS_SQL = FLOW_SQL + """,
bars AS (SELECT ticker, CAST(date_trunc('week', event_ts) AS DATE) AS date, arg_min(underlying_price, (event_ts, l_orderkey, l_linenumber)) AS open, max(underlying_price) AS high,
    min(underlying_price) AS low, arg_max(underlying_price, (event_ts, l_orderkey, l_linenumber)) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM flow_events GROUP BY 1, 2)"""


def index_bars(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's weekly bars: those of all tickers together."""
    f = flow_events(spark, d).withColumn("date", F.to_date(F.date_trunc("week", "event_ts")))
    at = F.struct("event_ts", "l_orderkey", "l_linenumber")
    px = F.col("underlying_price")
    return f.groupBy("date").agg(F.min_by(px, at).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, at).alias("close"), F.sum("volume").alias("volume"))


INDEX_SQL = BARS_SQL + """,
index_bars AS (SELECT CAST(date_trunc('week', event_ts) AS DATE) AS date, arg_min(underlying_price, (event_ts, l_orderkey, l_linenumber)) AS open, max(underlying_price) AS high,
    min(underlying_price) AS low, arg_max(underlying_price, (event_ts, l_orderkey, l_linenumber)) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM flow_events GROUP BY 1)"""


def prints(spark: SparkSession, d: str) -> DataFrame:
    """Off-exchange prints from the events table."""
    v = F.col("value")
    ask = F.when(F.col("event_type") == "purchase", v).otherwise(v + 0.02)
    bid = F.when(F.col("event_type") == "error", v).otherwise(v - 0.02)
    return table(spark, d, "events").select(
        F.col("event_id").alias("tracking_id"), F.concat(F.lit("U"), F.col("user_id") % 50).alias("ticker"), F.col("ts").alias("executed_at"), F.to_date("ts").alias("date"),
        v.alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size"), bid.alias("nbbo_bid"), ask.alias("nbbo_ask"),
    )


PRINTS_SQL = """prints AS (
  SELECT event_id AS tracking_id, 'U' || (user_id % 50) AS ticker, ts AS executed_at, CAST(ts AS DATE) AS date, value AS price,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, CASE WHEN event_type = 'error' THEN value ELSE value - 0.02::DOUBLE END AS nbbo_bid,
    CASE WHEN event_type = 'purchase' THEN value ELSE value + 0.02::DOUBLE END AS nbbo_ask FROM events)"""


def weeks(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot_date) of all snapshots, one row per week with events; written once, since a board asks for it thrice."""
    return settled(flow_events(spark, d).select(F.to_date(F.date_trunc("week", "event_ts")).alias("snapshot_date")).distinct().coalesce(1))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Weekly flow snapshot per ticker, in partitions of whole tickers."""
    from ..functions.flow import with_direction

    f = with_direction(flow_events(spark, d)).withColumn("snapshot_date", F.to_date(F.date_trunc("week", "event_ts")))
    f = by_ticker(f, spark, d)
    prem, long_, short = F.col("premium"), F.col("direction") == "LONG", F.col("direction") == "SHORT"
    part = lambda cond: F.coalesce(F.sum(F.when(cond, prem)), F.lit(0.0))
    at = F.struct("event_ts", "l_orderkey", "l_linenumber")
    out = f.groupBy("snapshot_date", "ticker").agg(
        F.first("sector").alias("sector"), F.max_by("underlying_price", at).alias("close"), F.max("marketcap").alias("marketcap"),
        F.round(part(long_), 2).alias("total_bullish_premium"), F.round(part(short), 2).alias("total_bearish_premium"),
        *[F.round(part(c & F.col("dte").between(lo, hi)), 2).alias(f"{b}_{s}_premium") for b, lo, hi in (("lottery", 0, 14), ("swing", 30, 120), ("leap", 180, 9999)) for s, c in (("bullish", long_), ("bearish", short))],
        F.sum(F.when(F.col("option_type") == "CALL", F.col("volume")).otherwise(0)).alias("call_volume"),
        F.sum(F.when(F.col("option_type") == "PUT", F.col("volume")).otherwise(0)).alias("put_volume"),
        F.round(F.avg(F.col("l_partkey") % 101), 4).alias("iv_rank"), F.round(F.avg(F.col("l_partkey") % 100) / 100, 4).alias("perc_3_day_total"),
        F.round(F.avg(F.col("is_sweep").cast("double")), 4).alias("sweep_share"), F.round(F.avg(F.col("is_multileg").cast("double")), 4).alias("multileg_share"), F.count("*").alias("trades"),
    )
    return out.withColumn("net_premium", F.round(F.col("total_bullish_premium") - F.col("total_bearish_premium"), 2)).withColumn("put_call_ratio", F.round(F.try_divide(F.col("put_volume").cast("double"), F.col("call_volume")), 4))


SNAPSHOTS_SQL = FLOW_SQL + """,
snap0 AS (SELECT CAST(date_trunc('week', event_ts) AS DATE) AS snapshot_date, ticker, min(sector) AS sector, arg_max(underlying_price, (event_ts, l_orderkey, l_linenumber)) AS close, max(marketcap) AS marketcap,
    round(coalesce(sum(premium) FILTER (direction = 'LONG'), 0), 2) AS total_bullish_premium, round(coalesce(sum(premium) FILTER (direction = 'SHORT'), 0), 2) AS total_bearish_premium,
    round(coalesce(sum(premium) FILTER (direction = 'LONG' AND dte BETWEEN 0 AND 14), 0), 2) AS lottery_bullish_premium, round(coalesce(sum(premium) FILTER (direction = 'SHORT' AND dte BETWEEN 0 AND 14), 0), 2) AS lottery_bearish_premium,
    round(coalesce(sum(premium) FILTER (direction = 'LONG' AND dte BETWEEN 30 AND 120), 0), 2) AS swing_bullish_premium, round(coalesce(sum(premium) FILTER (direction = 'SHORT' AND dte BETWEEN 30 AND 120), 0), 2) AS swing_bearish_premium,
    round(coalesce(sum(premium) FILTER (direction = 'LONG' AND dte BETWEEN 180 AND 9999), 0), 2) AS leap_bullish_premium, round(coalesce(sum(premium) FILTER (direction = 'SHORT' AND dte BETWEEN 180 AND 9999), 0), 2) AS leap_bearish_premium,
    CAST(coalesce(sum(volume) FILTER (option_type = 'CALL'), 0) AS BIGINT) AS call_volume, CAST(coalesce(sum(volume) FILTER (option_type = 'PUT'), 0) AS BIGINT) AS put_volume,
    round(avg(l_partkey % 101), 4) AS iv_rank, round(avg(l_partkey % 100) / 100, 4) AS perc_3_day_total, round(avg(CAST(is_sweep AS DOUBLE)), 4) AS sweep_share, round(avg(CAST(is_multileg AS DOUBLE)), 4) AS multileg_share, count(*) AS trades
  FROM flow GROUP BY 1, 2),
snapshots AS (SELECT *, round(total_bullish_premium - total_bearish_premium, 2) AS net_premium, CASE WHEN call_volume <> 0 THEN round(CAST(put_volume AS DOUBLE) / call_volume, 4) END AS put_call_ratio FROM snap0)"""
