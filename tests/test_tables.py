import json

import pytest
from pyspark.sql import functions as F

from flowmill.sources import tables as T


def test_normalize_coerces_and_derives(spark, tmp_path):
    rows = [
        {"ticker": " aapl ", "created_at": "2026-01-05T15:00:00Z", "type": "call", "strike": "150", "underlying_price": "151.5", "expiry": "2026-02-04", "total_premium": "1e5", "volume": "10", "open_interest": "x", "total_ask_side_prem": "9", "has_sweep": "true"},
        {"ticker": None, "created_at": "bad", "type": "PUT"},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    a, b = sorted(T.normalize_flow(T.read_raw_flow(spark, str(tmp_path))).collect(), key=lambda r: r.ticker or "~")
    assert (a.ticker, a.option_type, a.strike, a.dte, a.premium, a.volume, a.open_interest, a.is_sweep, a.is_multileg) == ("AAPL", "CALL", 150.0, 30, 1e5, 10, None, True, False)
    assert (b.ticker, b.event_ts, b.ask_side_premium) == (None, None, 0.0)


def test_latest_scan_of_each_day(spark, tmp_path):
    for stamp, n in (("20260105_100000", 1), ("20260105_150000", 2), ("20260106_090000", 3)):
        (tmp_path / f"rejected_{stamp}.json").write_text(json.dumps({"n": n}))
    s = T.stamped(spark.read.schema("n int").json(str(tmp_path)), r"rejected_(\d{8}_\d{6})")
    assert {r.n for r in T.latest_file_per_day(s).collect()} == {2, 3}
    assert s.filter("scan_date = '2026-01-05'").count() == 2


def test_partition_replace_is_idempotent(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([("2026-01-05", 1), ("2026-01-06", 2)], "d string, x int")
    for _ in range(2):
        T.replace_partitions(a, p, "d")
    T.replace_partitions(a.filter("d = '2026-01-06'").withColumn("x", F.lit(9)), p, "d")
    assert {(str(r.d), r.x) for r in spark.read.parquet(p).collect()} == {("2026-01-05", 1), ("2026-01-06", 9)}
    kept = T.retained(spark.read.parquet(p).withColumn("d", F.to_date("d")), "d", F.lit("2026-01-07").cast("date"), 1)
    assert kept.count() == 1


def test_files_of_replaced_partitions_do_not_grow_with_tasks(spark, tmp_path):
    a = spark.range(4000).selectExpr("id % 20 AS d", "id AS x").repartition(50)
    for _ in range(2):
        T.replace_partitions(a, str(tmp_path / "t"), "d")
    assert len(list((tmp_path / "t").glob("d=*/*.parquet"))) <= 4 * 20
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.groupBy("d").count().collect() == got.groupBy("d").count().filter("count = 200").collect() and got.distinct().count() == 4000


def test_upsert_append_and_archive(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 5)], "k int, v string, extra int")
    assert {tuple(r) for r in T.upserted(old, new, ["k"]).collect()} == {(1, "a", None), (2, "c", 5)}
    p = str(tmp_path / "arch")
    T.append(old.withColumn("d", F.lit("x")), p, "d")
    T.append(new.withColumn("d", F.lit("y")), p, "d")
    assert T.read_archive(spark, p).count() == 3


def test_sessions_backfill_and_schema(spark):
    day = lambda df, *c: df.withColumns({x: F.to_date(x) for x in c})
    df = day(spark.createDataFrame([("A", "2026-01-09", 1), ("A", "2026-01-10", 2), ("B", "2026-01-11", 3)], "ticker string, date string, v int"), "date")
    sessions = day(spark.createDataFrame([("2026-01-08",), ("2026-01-09",), ("2026-01-12",)], "session string"), "session")
    assert {(r.ticker, str(r.session), r.v) for r in T.to_sessions(df, sessions, ["ticker"]).collect()} == {("A", "2026-01-09", 1), ("B", "2026-01-09", 3)}
    g = spark.createDataFrame([("A", "x"), ("B", " "), ("C", None), ("D", None)], "k string, lab string")
    arch, last = spark.createDataFrame([("B", "arch")], "k string, lab string"), spark.createDataFrame([("B", "l"), ("C", "l")], "k string, lab string")
    assert {tuple(r) for r in T.backfilled(g, arch, last, ["k"], "lab").collect()} == {("A", "x", "own"), ("B", "arch", "archive"), ("C", "l", "latest"), ("D", "unknown", "unknown")}
    s = T.to_schema(spark.createDataFrame([("5", "no")], "a string, b string"), {"a": "int", "b": "double", "c": "string"}).first()
    assert tuple(s) == (5, None, None)


def test_missing_columns_are_named(spark):
    from flowmill.functions.flow import qualifying

    with pytest.raises(ValueError, match="execution_side"):
        qualifying(spark.createDataFrame([(1.0, 40, "CALL")], "premium double, dte int, option_type string"))
