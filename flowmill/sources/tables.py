"""Sources and sinks: raw vendor JSON, stamped files, and partitioned, keyed or append-only writes.

Sinks write Parquet. Writers replace whole partitions (dynamic overwrite), so running one twice leaves the same
rows; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vendor field -> canonical name (fixed values).
RENAME = {
    "ticker": "ticker", "created_at": "event_ts", "type": "option_type", "strike": "strike", "underlying_price": "underlying_price", "expiry": "expiration_date",
    "total_premium": "premium", "volume": "volume", "open_interest": "open_interest", "total_ask_side_prem": "ask_side_premium", "total_bid_side_prem": "bid_side_premium", "has_sweep": "is_sweep", "has_multileg": "is_multileg",
}
RAW = ", ".join(f"{k} string" for k in RENAME)


def read_raw_flow(spark: SparkSession, path: str) -> DataFrame:
    """Vendor alerts from JSON lines, all fields as text."""
    return spark.read.schema(RAW).json(path)


def normalize_flow(raw: DataFrame) -> DataFrame:
    """Canonical flow events: names, trimmed upper-case enums, coerced numbers and times, days to expiry. A value
    that does not parse is null; fields that are absent are null columns."""
    have = {v: F.col(k) if k in raw.columns else F.lit(None).cast("string") for k, v in RENAME.items()}
    num = lambda c: have[c].try_cast("double")
    ts = F.try_to_timestamp(have["event_ts"])
    expiry = F.to_date(F.try_to_timestamp(have["expiration_date"]))
    flag = lambda c: F.coalesce(have[c].try_cast("boolean"), F.lit(False))
    return raw.select(
        F.upper(F.trim(have["ticker"])).alias("ticker"), ts.alias("event_ts"), F.upper(F.trim(have["option_type"])).alias("option_type"), num("strike").alias("strike"), num("underlying_price").alias("underlying_price"), expiry.alias("expiration_date"),
        F.datediff(expiry, F.to_date(ts)).alias("dte"), num("premium").alias("premium"), num("volume").cast("long").alias("volume"), num("open_interest").cast("long").alias("open_interest"),
        F.coalesce(num("ask_side_premium"), F.lit(0.0)).alias("ask_side_premium"), F.coalesce(num("bid_side_premium"), F.lit(0.0)).alias("bid_side_premium"), flag("is_sweep").alias("is_sweep"), flag("is_multileg").alias("is_multileg"),
    )


def stamped(df: DataFrame, pattern: str, fmt: str = "yyyyMMdd_HHmmss", folders: bool = False) -> DataFrame:
    """df, read from files, with the time in each file's name as scan_ts (in its whole path with `folders`, for scans that are
    folders of part files); files without one have null."""
    stamp = F.regexp_extract(F.col("_metadata.file_path" if folders else "_metadata.file_name"), pattern, 1)
    return df.select("*", F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit(fmt)).alias("scan_ts")).withColumn("scan_date", F.to_date("scan_ts"))


def latest_file_per_day(df: DataFrame, as_of: Column | None = None, lookback_days: int | None = None) -> DataFrame:
    """Rows of each day's last scan: the last stamp of a day is an aggregate of few rows, joined back. With `as_of` days after
    it are invisible, with `lookback_days` too those further back."""
    if as_of is not None:
        df = df.filter(F.col("scan_date") <= as_of)
        if lookback_days is not None:
            df = df.filter(F.col("scan_date") > F.date_sub(as_of, lookback_days))
    last = df.groupBy("scan_date").agg(F.max("scan_ts").alias("scan_ts"))
    return df.join(last, ["scan_date", "scan_ts"], "left_semi")


def to_schema(df: DataFrame, target: dict[str, str], **given: Column) -> DataFrame:
    """df projected to a fixed schema: given columns first, then df's by try_cast, null where absent."""
    at = lambda c, t: (given[c] if c in given else F.col(c) if c in df.columns else F.lit(None)).try_cast(t).alias(c)
    return df.select(*[at(c, t) for c, t in target.items()])


#: Labels of which enrichment's own value, if not blank, beats the base row's (fixed values).
ENRICHED = ("dominant_dte_bucket", "sweep_share", "multileg_share")


def snapshot_projection(rows: DataFrame, target: dict[str, str], prefix: str = "e_") -> DataFrame:
    """rows projected to the snapshot schema: premiums rounded to cents and 0 where missing, unusual premiums that are missing or 0
    replaced by the swing ones, enrichment columns (`prefix` + name) before the base's, null where nothing is known."""
    have = set(rows.columns)
    cents = lambda c: F.round(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)), 2) if c in have else F.lit(0.0)
    given = {c: cents(c) for c in target if c.endswith("_premium") and c != "net_premium"}
    for side in ("bullish", "bearish"):
        if f"unusual_{side}_premium" in target:
            given[f"unusual_{side}_premium"] = F.coalesce(F.nullif(cents(f"unusual_{side}_premium"), F.lit(0.0)), cents(f"swing_{side}_premium"))
    for c in ENRICHED:
        sources = [F.col(x) for x in (prefix + c, c) if x in have]
        if c in target and sources:
            given[c] = F.coalesce(*[F.when(F.trim(x.cast("string")) != "", x) for x in sources])
    return to_schema(rows, target, **given)


def graded_rows(df: DataFrame, grade: str = "conviction_grade", bucket: str = "dominant_dte_bucket") -> DataFrame:
    """What a grade history keeps: rows with a grade, a blank bucket as 'unknown'."""
    return df.filter(F.trim(F.col(grade)) != "").withColumn(bucket, F.coalesce(F.nullif(F.trim(F.col(bucket)), F.lit("")), F.lit("unknown")))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite exactly the partitions that df holds. Rows are first gathered by partition, a large one in several tasks, so that
    the number of files grows with the rows and not with tasks times partitions."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def retained(df: DataFrame, by: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the partitions that retention keeps; the filter prunes partitions."""
    return df.filter(F.col(by) >= F.date_sub(as_of, days))


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the rows of new's keys replaced; columns missing on one side are null."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def append(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("append").partitionBy(by).parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """An append-only archive whose later files may have more columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def to_sessions(df: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Dates that are no session move to the session before; of a key's rows on one session the first stays.
    sessions: session, a row per trading day; both sides are ordered together and the last session carried on."""
    days = df.select("date").distinct().select(F.col("date").alias("d"), F.lit(None).cast("date").alias("s"))
    both = days.unionByName(sessions.select(F.col("session").alias("d"), F.col("session").alias("s")))
    w = Window.orderBy("d", F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # a row per calendar day
    on = both.withColumn("session", F.last("s", ignorenulls=True).over(w)).filter("s is null").select(F.col("d").alias("date"), "session")
    out = df.join(on, "date")
    first = F.row_number().over(Window.partitionBy(*keys, "session").orderBy("date"))
    return out.withColumn("_r", first).filter("_r = 1").drop("_r")


def backfilled(df: DataFrame, archive: DataFrame, latest: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Blank labels from the archive, else the latest file, else 'unknown', with the source of each."""
    a, b = archive.select(*keys, F.col(column).alias("_a")), latest.select(*keys, F.col(column).alias("_b"))
    blank = F.nullif(F.trim(F.col(column)), F.lit(""))
    j = df.join(a, keys, "left").join(b, keys, "left")
    source = F.when(blank.isNotNull(), "own").when(F.col("_a").isNotNull(), "archive").when(F.col("_b").isNotNull(), "latest").otherwise("unknown")
    return j.select(*[c for c in df.columns if c != column], F.coalesce(blank, "_a", "_b", F.lit("unknown")).alias(column), source.alias(f"{column}_source"))


def save_run(tables: dict[str, DataFrame], folder: str, stamp: str) -> None:
    """Several outputs of one run under one stamp; shared parents should be cached by the caller."""
    for name, df in tables.items():
        df.withColumn("run", F.lit(stamp)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{folder}/{name}")
