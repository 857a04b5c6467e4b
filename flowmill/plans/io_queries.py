"""Queries that write and read back: sources, sinks and drained streams, each with SQL for the final state.

Files go to a new folder below the shared one per call. Streams read a batch of files a trigger, in the order in which the
batches were written, and end when all is read; what a trigger emits is a partition of the output, so a repeated trigger
replaces its own rows, and the last version of a key is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.flow import with_direction
from ..sources import tables as T
from ..sources.fixtures import FLOW_SQL, PRINTS_SQL, SNAPSHOTS_SQL, flow_events, prints, snapshots, tasks_of
from ..sources.shared import settled, shared_folder
from ..streaming import streams as S
from .registry import query


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


# ---- sources --------------------------------------------------------------------------------------------

_RAW_SQL = """SELECT ticker, event_ts, option_type, strike, underlying_price, expiration_date, CAST(dte AS INT) AS dte, premium, volume, open_interest, ask_side_premium, is_sweep, is_multileg FROM flow_events"""


@query("src1_raw_flow", f"WITH {FLOW_SQL} {_RAW_SQL}")
def src1(spark, d):
    """Events written as the vendor's JSON, in its names and loose texts, then read and normalised."""
    f, path = flow_events(spark, d), _folder(spark)
    back = {v: k for k, v in T.RENAME.items()}
    text = {c: F.col(c).cast("string") for c in back if c in f.columns}
    text |= {"ticker": F.concat(F.lit(" "), F.lower("ticker")), "option_type": F.lower("option_type"), "event_ts": F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss")}
    f.select(*[v.alias(back[c]) for c, v in text.items()]).write.json(path)
    n = T.normalize_flow(T.read_raw_flow(spark, path))
    return n.select("ticker", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "option_type", "strike", "underlying_price", "expiration_date", "dte", "premium", "volume", "open_interest", "ask_side_premium", "is_sweep", "is_multileg")


_SCANS_SQL = SNAPSHOTS_SQL + """,
sc AS (SELECT ticker, net_premium, snapshot_date AS scan_date, CAST(snapshot_date AS TIMESTAMP) + to_hours(CASE CAST(trades % 3 AS INT) WHEN 0 THEN 9 WHEN 1 THEN 12 ELSE 15 END) AS scan_ts FROM snapshots WHERE snapshot_date >= (SELECT max(snapshot_date) - 70 FROM snapshots))"""


def _scans(spark, d):
    """The last ten weeks' snapshots as scans of three times of day, a folder of files each, read back with their stamps."""
    s, path = snapshots(spark, d), _folder(spark)
    newest = s.agg(F.max("snapshot_date").alias("_m"))
    s = s.crossJoin(F.broadcast(newest)).filter(F.col("snapshot_date") >= F.date_sub("_m", 70))  # one row
    hour = F.element_at(F.array(F.lit("09"), F.lit("12"), F.lit("15")), (F.col("trades") % 3 + 1).cast("int"))
    scan = F.concat(F.date_format("snapshot_date", "yyyyMMdd"), F.lit("_"), hour, F.lit("0000"))
    s.select("ticker", "net_premium", scan.alias("scan")).write.partitionBy("scan").json(path)
    return T.stamped(spark.read.schema("ticker string, net_premium double").json(f"{path}/*"), r"scan=(\d{8}_\d{6})", folders=True).withColumn("scan_ts", F.col("scan_ts").cast("timestamp_ntz"))


@query("src3_stamped_scans", f"WITH {_SCANS_SQL} SELECT ticker, net_premium, scan_ts, scan_date FROM sc")
def src3(spark, d):
    return _scans(spark, d).select("ticker", "net_premium", "scan_ts", "scan_date")


@query("src2_latest_scan_per_day", f"WITH {_SCANS_SQL}, l AS (SELECT scan_date, max(scan_ts) AS scan_ts FROM sc WHERE scan_date <= (SELECT max(scan_date) FROM sc) - 7 AND scan_date > (SELECT max(scan_date) FROM sc) - 49 GROUP BY 1) SELECT ticker, net_premium, scan_ts, scan_date FROM sc JOIN l USING (scan_date, scan_ts)")
def src2(spark, d):
    """The last scan of each day of six weeks that end a week before the newest."""
    s = _scans(spark, d)
    newest = s.agg(F.date_sub(F.max("scan_date"), 7)).first()[0]
    return T.latest_file_per_day(s, F.lit(newest), 42).select("ticker", "net_premium", "scan_ts", "scan_date")


_TARGET = {"snapshot_date": "date", "ticker": "string", "close": "double", "total_bullish_premium": "double", "unusual_bullish_premium": "double", "unusual_bearish_premium": "double", "swing_bullish_premium": "double", "dominant_dte_bucket": "string", "sweep_share": "double", "iv30d": "double"}


@query("src5_snapshot_projection", f"""WITH {SNAPSHOTS_SQL} SELECT snapshot_date, ticker, close, total_bullish_premium, CASE WHEN trades % 3 = 0 AND lottery_bullish_premium <> 0 THEN lottery_bullish_premium ELSE swing_bullish_premium END AS unusual_bullish_premium, swing_bearish_premium AS unusual_bearish_premium, swing_bullish_premium,
  CASE CAST(trades % 4 AS INT) WHEN 0 THEN 'own' WHEN 3 THEN NULL ELSE 'base' END AS dominant_dte_bucket, CASE WHEN trades % 2 = 0 THEN multileg_share ELSE sweep_share END AS sweep_share, CAST(NULL AS DOUBLE) AS iv30d FROM snapshots""")
def src5(spark, d):
    t = F.col("trades")
    s = snapshots(spark, d).withColumns({
        "unusual_bullish_premium": F.when(t % 3 == 0, F.col("lottery_bullish_premium")), "e_dominant_dte_bucket": F.when(t % 4 == 0, "own").otherwise(" "), "dominant_dte_bucket": F.when(t % 4 != 3, "base"), "e_sweep_share": F.when(t % 2 == 0, F.col("multileg_share")),
    })
    return T.snapshot_projection(s, _TARGET)


# ---- sinks ----------------------------------------------------------------------------------------------


def _read(spark, path):
    return spark.read.parquet(path)


@query("snk1_replaced_partitions", f"WITH {SNAPSHOTS_SQL}, m AS (SELECT max(snapshot_date) AS m FROM snapshots) SELECT ticker, snapshot_date, CASE WHEN snapshot_date = m THEN trades * 2 ELSE trades END AS trades FROM snapshots, m WHERE snapshot_date >= m - 90")
def snk1(spark, d):
    """History written, its newest day written again (twice) with other values, then cut to the retention."""
    path = _folder(spark)
    s = snapshots(spark, d).select("ticker", "snapshot_date", "trades")
    T.replace_partitions(s, path, "snapshot_date")
    newest = _read(spark, path).agg(F.max("snapshot_date")).first()[0]
    for _ in range(2):
        T.replace_partitions(s.filter(F.col("snapshot_date") == F.lit(newest)).withColumn("trades", F.col("trades") * 2), path, "snapshot_date")
    return T.retained(_read(spark, path), "snapshot_date", F.lit(newest), 90).select("ticker", "snapshot_date", "trades")


@query("snk2_upserted", f"WITH {SNAPSHOTS_SQL} SELECT ticker, snapshot_date, CASE WHEN trades % 3 = 0 THEN -trades ELSE trades END AS trades, CASE WHEN trades % 3 = 0 THEN 'new' END AS note FROM snapshots")
def snk2(spark, d):
    path, s = _folder(spark), snapshots(spark, d).select("ticker", "snapshot_date", "trades")
    s.write.parquet(f"{path}/old")
    new = s.filter("trades % 3 = 0").select("ticker", "snapshot_date", (-F.col("trades")).alias("trades"), F.lit("new").alias("note"))
    T.upserted(_read(spark, f"{path}/old"), new, ["ticker", "snapshot_date"]).write.parquet(f"{path}/new")
    return _read(spark, f"{path}/new")


@query("snk3_replaced_by_as_of", f"WITH {SNAPSHOTS_SQL} SELECT snapshot_date AS as_of, ticker, CASE CAST(trades % 3 AS INT) WHEN 0 THEN 'A' ELSE 'B' END AS conviction_grade, CASE CAST(trades % 4 AS INT) WHEN 0 THEN 'leap' ELSE 'unknown' END AS dominant_dte_bucket FROM snapshots WHERE trades % 3 <> 2")
def snk3(spark, d):
    path, t = _folder(spark), F.col("trades")
    g = snapshots(spark, d).select(F.col("snapshot_date").alias("as_of"), "ticker", F.when(t % 3 == 0, "A").when(t % 3 == 1, "B").otherwise(" ").alias("conviction_grade"), F.when(t % 4 == 0, "leap").when(t % 4 == 1, "").alias("dominant_dte_bucket"))
    g = settled(T.graded_rows(g))  # written twice below
    for _ in range(2):
        T.replace_partitions(g, path, "as_of")
    return _read(spark, path).select("as_of", "ticker", "conviction_grade", "dominant_dte_bucket")


@query("snk4_archive", f"WITH {SNAPSHOTS_SQL} SELECT ticker, snapshot_date, trades, CASE WHEN trades % 2 = 1 THEN sweep_share END AS sweep_share FROM snapshots")
def snk4(spark, d):
    """Two appends of which the later has a column more."""
    path, s = _folder(spark), snapshots(spark, d).withColumn("month", F.date_format("snapshot_date", "yyyyMM"))
    T.append(s.filter("trades % 2 = 0").select("ticker", "snapshot_date", "trades", "month"), path, "month")
    T.append(s.filter("trades % 2 = 1").select("ticker", "snapshot_date", "trades", "sweep_share", "month"), path, "month")
    return T.read_archive(spark, path).select("ticker", "snapshot_date", "trades", "sweep_share")


@query("snk7_run_outputs", f"WITH {SNAPSHOTS_SQL} SELECT 'long' AS output, '20260105' AS run, count(*) AS n, CAST(sum(trades) AS BIGINT) AS trades FROM snapshots WHERE net_premium > 0 UNION ALL SELECT 'short', '20260105', count(*), CAST(sum(trades) AS BIGINT) FROM snapshots WHERE net_premium < 0")
def snk7(spark, d):
    path, s = _folder(spark), snapshots(spark, d).select("ticker", "snapshot_date", "trades", "net_premium")
    for _ in range(2):
        T.save_run({"long": s.filter("net_premium > 0"), "short": s.filter("net_premium < 0")}, path, "20260105")
    parts = [_read(spark, f"{path}/{k}").groupBy(F.lit(k).alias("output"), F.col("run").cast("string").alias("run")).agg(F.count("*").alias("n"), F.sum("trades").alias("trades")) for k in ("long", "short")]
    return parts[0].unionByName(parts[1])


@query("snk8_restamped", f"""WITH {FLOW_SQL}, f AS (SELECT ticker, event_date AS date, CAST(sum(volume) AS BIGINT) AS volume FROM flow_events GROUP BY 1, 2), c AS (SELECT DISTINCT date AS session FROM f WHERE dayofweek(date) BETWEEN 1 AND 5)
SELECT ticker, date, session, volume FROM f ASOF JOIN c ON f.date >= c.session QUALIFY row_number() OVER (PARTITION BY ticker, session ORDER BY date) = 1""")
def snk8(spark, d):
    """Weekend days move to the session before; the days with events from Monday to Friday are the sessions."""
    f = flow_events(spark, d).groupBy("ticker", F.col("event_date").alias("date")).agg(F.sum("volume").alias("volume"))
    sessions = f.select(F.col("date").alias("session")).distinct().filter(F.dayofweek("session").between(2, 6))
    return T.to_sessions(f, sessions, ["ticker"]).filter("session is not null").select("ticker", "date", "session", "volume")


@query("snk9_backfilled", f"""WITH {SNAPSHOTS_SQL} SELECT ticker, snapshot_date, CASE CAST(trades % 5 AS INT) WHEN 0 THEN 'swing' WHEN 1 THEN 'leap' WHEN 2 THEN 'lottery' ELSE 'unknown' END AS bucket, CASE CAST(trades % 5 AS INT) WHEN 0 THEN 'own' WHEN 1 THEN 'archive' WHEN 2 THEN 'latest' ELSE 'unknown' END AS bucket_source FROM snapshots""")
def snk9(spark, d):
    t, s = F.col("trades"), snapshots(spark, d)
    key = ["ticker", "snapshot_date"]
    own = s.select(*key, F.when(t % 5 == 0, "swing").when(t % 5 == 1, " ").alias("bucket"))
    archive, latest = (s.filter(t % 5 == k).select(*key, F.lit(v).alias("bucket")) for k, v in ((1, "leap"), (2, "lottery")))
    return T.backfilled(own, archive, latest, key, "bucket").select(*key, "bucket", "bucket_source")


# ---- streams --------------------------------------------------------------------------------------------

EVER = "36500 days"


def _drained(spark, step, batches, path, mode="update"):
    """All that step, a function from stream to stream, emits over batches, DataFrames of one schema, with the number of the trigger as
    `batch`. A batch is written by as many tasks as it has partitions and is one trigger: the stream goes on from its
    checkpoint when the next one is there."""

    def sink(df, number):
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number:06d}")

    for b in batches:
        b.write.mode("append").parquet(f"{path}/in")
        S.run_available(step(spark.readStream.schema(b.schema).parquet(f"{path}/in")), f"{path}/state", sink, mode=mode)
    return spark.read.parquet(f"{path}/out/*")


def _last(df, keys):
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))).filter("_r = 1").drop("_r", "batch")


def _halves(df, at):
    """Earlier and later rows by the median of their times; the order within a trigger is not seen."""
    mid = df.agg(F.percentile_approx(F.col(at).cast("long"), 0.5)).first()[0]
    early = F.col(at).cast("long") < F.lit(mid)
    return df.filter(early), df.filter(~early)


def _prints(spark, d):
    return prints(spark, d).withColumn("executed_at", F.col("executed_at").cast("timestamp"))


def _flow(spark, d):
    return with_direction(flow_events(spark, d)).select("ticker", F.col("event_ts").cast("timestamp").alias("event_ts"), "direction", "premium", "l_orderkey", "l_linenumber")


def _spans(df, keys, more, digits=2):
    ntz = lambda c: F.col(f"w.{c}").cast("timestamp_ntz").alias(f"w_{c}")
    return df.select(ntz("start"), ntz("end"), *keys, *[F.round(c, digits).alias(c) if c in ("premium", "total_notional") else F.col(c) for c in more])


@query("str1_deduped_prints", f"WITH {PRINTS_SQL} SELECT tracking_id, ticker, price, size FROM prints")
def str1(spark, d):
    """Every print sent twice, in two scans that overlap."""
    path, p = _folder(spark), _prints(spark, d).select("tracking_id", "ticker", "executed_at", "price", "size")
    a, b = _halves(p, "executed_at")
    return _drained(spark, lambda s: S.dedupe_prints(s, EVER), [a, a.unionByName(b), b], path, "append").select("tracking_id", "ticker", "price", "size")


@query("str2_day_to_date", f"""WITH {PRINTS_SQL}, c AS (SELECT *, CASE WHEN nbbo_ask > 0 AND price >= nbbo_ask THEN 'buy' WHEN nbbo_bid > 0 AND price <= nbbo_bid THEN 'sell' ELSE 'neutral' END AS side FROM prints WHERE price > 0 AND size > 0)
SELECT CAST(date AS TIMESTAMP) AS w_start, CAST(date AS TIMESTAMP) + INTERVAL 1 DAY AS w_end, ticker, CAST(sum(size) AS BIGINT) AS total_volume, round(sum(price * size), 2) AS total_notional, CAST(sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE WHEN side = 'sell' THEN size ELSE 0 END) AS BIGINT) AS sell_volume, count(*) AS print_count FROM c GROUP BY 1, 2, 3""")
def str2(spark, d):
    path = _folder(spark)
    out = _last(_drained(spark, lambda s: S.day_to_date(s, EVER), _halves(_prints(spark, d), "executed_at"), path), ["w", "ticker"])
    return _spans(out, ["ticker"], ["total_volume", "total_notional", "buy_volume", "sell_volume", "print_count"])


@query("str3_hourly", f"WITH {FLOW_SQL} SELECT date_trunc('hour', event_ts) AS w_start, date_trunc('hour', event_ts) + INTERVAL 1 HOUR AS w_end, ticker, direction, round(sum(premium), 2) AS premium, count(*) AS trades FROM flow GROUP BY 1, 2, 3, 4")
def str3(spark, d):
    path = _folder(spark)
    out = _last(_drained(spark, lambda s: S.hourly(s, EVER), _halves(_flow(spark, d), "event_ts"), path), ["w", "ticker", "direction"])
    return _spans(out, ["ticker", "direction"], ["premium", "trades"])


@query("str4_last_two_hours", f"WITH {FLOW_SQL}, e AS (SELECT ticker, premium, time_bucket(INTERVAL 15 MINUTE, event_ts) - to_minutes(15 * k) AS w_start FROM flow, range(8) g(k)) SELECT w_start, w_start + INTERVAL 2 HOUR AS w_end, ticker, count(*) AS repeat_2h, round(sum(premium), 2) AS premium FROM e GROUP BY 1, 2, 3")
def str4(spark, d):
    """The stream keeps quarters of an hour, of which a span of two hours is eight: an eighth of the state that spans take. What it
    emits moves once, before the last versions are taken and spans are made of them."""
    path = _folder(spark)
    f = settled(_flow(spark, d).select("ticker", "event_ts", "premium"))  # read for the median and for each half
    out = _drained(spark, lambda s: S.quarters(s, EVER), _halves(f, "event_ts"), path)
    q = _last(S.stretches(out, tasks_of(spark, d)), ["ticker", "_s", "_k"])
    return _spans(S.spans_of(q), ["ticker"], ["repeat_2h", "premium"])


@query("str5_bursts", f"""WITH {FLOW_SQL}, a AS (SELECT *, CASE WHEN event_ts <= lag(event_ts) OVER (PARTITION BY ticker ORDER BY event_ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM flow), b AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY event_ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT min(event_ts) AS w_start, max(event_ts) + INTERVAL 30 MINUTE AS w_end, ticker, count(*) AS trades, round(sum(premium), 2) AS premium FROM b GROUP BY ticker, g""")
def str5(spark, d):
    """Sessions merge while they run, so the whole result of the last trigger counts."""
    path = _folder(spark)
    out = _drained(spark, lambda s: S.bursts(s, late=EVER), _halves(_flow(spark, d), "event_ts"), path, "complete")
    newest = out.agg(F.max("batch")).first()[0]
    return _spans(out.filter(F.col("batch") == newest), ["ticker"], ["trades", "premium"])


@query("str6_watch_streaks", """WITH c AS (SELECT 'U' || (user_id % 50) AS ticker, CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS score FROM events),
a AS (SELECT *, CASE WHEN date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) <= 5 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY ticker, direction ORDER BY ts, score)),
b AS (SELECT *, sum(new) OVER (PARTITION BY ticker, direction ORDER BY ts, score ROWS UNBOUNDED PRECEDING) AS g FROM a), e AS (SELECT *, row_number() OVER (PARTITION BY ticker, direction, g ORDER BY ts DESC, score DESC) AS k FROM b QUALIFY g = max(g) OVER (PARTITION BY ticker, direction))
SELECT ticker, direction, count(DISTINCT CAST(ts AS DATE)) AS streak_days, max(CAST(ts AS DATE)) AS last_date, string_agg(CAST(score AS VARCHAR), ',' ORDER BY ts, score) FILTER (k <= 10) AS history FROM e GROUP BY 1, 2""")
def str6(spark, d):
    path = _folder(spark)
    c = prints(spark, d).select("ticker", F.when(F.col("tracking_id") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), F.col("executed_at").cast("timestamp").alias("seen_at"), F.col("size").cast("double").alias("score"), "tracking_id")
    return _last(_drained(spark, S.watchlist_streaks, _halves(c, "seen_at"), path), ["ticker", "direction"])


@query("str7_late_rows", f"""WITH {FLOW_SQL}, m AS (SELECT quantile_disc(epoch(event_ts), 0.5) AS mid FROM flow), k AS (SELECT flow.* FROM flow, m WHERE NOT (epoch(event_ts) < mid - 864000 AND l_orderkey % 10 = 0))
SELECT date_trunc('hour', event_ts) AS w_start, date_trunc('hour', event_ts) + INTERVAL 1 HOUR AS w_end, ticker, direction, round(sum(premium), 2) AS premium, count(*) AS trades FROM k GROUP BY 1, 2, 3, 4""")
def str7(spark, d):
    """A tenth of the rows from ten days before the median time on come after all others; the watermark has left their hours."""
    path, f = _folder(spark), _flow(spark, d)
    mid = f.agg(F.percentile(F.col("event_ts").cast("long"), 0.5)).first()[0]
    mid = f.filter(F.col("event_ts").cast("long") <= F.lit(mid)).agg(F.max(F.col("event_ts").cast("long"))).first()[0]
    at = F.col("event_ts").cast("long")
    late = (at < F.lit(mid - 864000)) & (F.col("l_orderkey") % 10 == 0)
    batches = [f.filter(~late & (at < F.lit(mid))), f.filter(at == F.lit(mid)), f.filter(at > F.lit(mid)), f.filter(late)]
    out = _last(_drained(spark, S.hourly, batches, path), ["w", "ticker", "direction"])
    return _spans(out, ["ticker", "direction"], ["premium", "trades"])


@query("str8_ingested_files", "SELECT event_id, user_id, event_type, value FROM events")
def str8(spark, d):
    """Events as JSON files, each taken once, a few a trigger, upserted by id: a rerun over the same checkpoint adds nothing."""
    path = _folder(spark)
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")
    e.repartition(8, "event_id").write.json(f"{path}/in")
    schema = "event_id long, user_id long, event_type string, value double"

    def sink(df, number):
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number:06d}")

    for _ in range(2):
        S.ingest_files(spark, schema, f"{path}/in", f"{path}/state", sink, per_batch=3)
    return _last(spark.read.parquet(f"{path}/out/*"), ["event_id"])
