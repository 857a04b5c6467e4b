"""Off-exchange prints: classification, ticker aggregates and multi-day accumulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGE = 1_000_000


def classify(prints: DataFrame) -> DataFrame:
    """Prints with a positive price and size, their side by the quote, and notional."""
    price, size = F.col("price"), F.col("size")
    side = F.when((F.col("nbbo_ask") > 0) & (price >= F.col("nbbo_ask")), "buy").when((F.col("nbbo_bid") > 0) & (price <= F.col("nbbo_bid")), "sell").otherwise("neutral")
    return prints.filter((price > 0) & (size > 0)).withColumn("side", side).withColumn("notional", price * size)


def bias_label(bias: Column) -> Column:
    return F.when(bias >= 0.60, "Buyers").when(bias <= 0.40, "Sellers").otherwise("Balanced")


def aggregate(classified: DataFrame, by: list[str], large: float = LARGE) -> DataFrame:
    """Volume, notional, counts, bias and its label per group."""
    vol = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("size"))), F.lit(0))
    a = classified.groupBy(*by).agg(
        F.sum("size").alias("total_volume"), F.round(F.sum("notional"), 2).alias("total_notional"), vol("buy").alias("buy_volume"), vol("sell").alias("sell_volume"), F.count("*").alias("print_count"),
        F.count_if(F.col("notional") >= large).alias("large_print_count"), F.round(F.max("notional"), 2).alias("largest_print_notional"), F.min("executed_at").alias("first_seen"), F.max("executed_at").alias("last_seen"),
    )
    bias = F.coalesce(F.try_divide(F.col("buy_volume").cast("double"), F.col("total_volume")), F.lit(0.5))
    return a.withColumn("bias", F.round(bias, 4)).withColumn("bias_label", bias_label(bias))


def multi_day(daily: DataFrame, min_active: int = 2) -> DataFrame:
    """Per ticker over all its days: volume-weighted bias, consistency at two thirds, trend between the halves of
    its own active days, persistence."""
    days = daily.select(F.count_distinct("date").alias("total_days"))  # one row
    own = Window.partitionBy("ticker")
    d = daily.withColumn("_k", F.row_number().over(own.orderBy("date"))).withColumn("_n", F.count("*").over(own))
    half = F.col("_k") <= F.floor(F.col("_n") / 2)
    a = d.groupBy("ticker").agg(
        F.count("*").alias("active_days"), F.sum("total_notional").alias("cumulative_notional"), F.sum("total_volume").alias("cumulative_volume"), F.sum("print_count").alias("cumulative_prints"),
        F.max("largest_print_notional").alias("largest_print"), F.sum(F.col("bias") * F.col("total_volume")).alias("_bv"), F.count_if(F.col("bias") > 0.55).alias("buy_days"), F.count_if(F.col("bias") < 0.45).alias("sell_days"),
        F.coalesce(F.sum(F.when(half, F.col("total_notional"))), F.lit(0.0)).alias("_n1"), F.coalesce(F.sum(F.when(~half, F.col("total_notional"))), F.lit(0.0)).alias("_n2"), F.max_by("marketcap", "date").alias("marketcap"),
        F.array_sort(F.collect_list(F.struct("date", F.col("total_notional").alias("notional"), "bias"))).alias("daily"),
    ).filter(F.col("active_days") >= min_active)
    a = a.crossJoin(F.broadcast(days))
    n, bias = F.col("active_days"), F.coalesce(F.try_divide(F.col("_bv"), F.col("cumulative_volume")), F.lit(0.5))
    ratio = F.try_divide(F.col("_n2"), F.nullif("_n1", F.lit(0.0)))
    trend = F.when(n < 2, "steady").when(F.col("_n1") <= 0, F.when(F.col("_n2") > 0, "accelerating").otherwise("steady")).when(ratio > 1.3, "accelerating").when(ratio < 0.7, "fading").otherwise("steady")
    bps = F.when(F.col("marketcap") > 0, F.round(F.col("cumulative_notional") / F.col("marketcap") * 10_000, 2)).otherwise(0.0)
    share = F.round(n / F.col("total_days"), 2)
    label = F.when(F.col("buy_days") >= 2 / 3 * n, "Consistent buyer").when(F.col("sell_days") >= 2 / 3 * n, "Consistent seller").otherwise("Mixed")
    return a.withColumns({"bias": F.round(bias, 4), "bias_label": bias_label(bias), "bias_consistency_label": label, "trend": trend, "notional_mcap_bps": bps, "persistence_ratio": share, "persistence_weighted": F.round(bps * share, 4)}).drop("_bv", "_n1", "_n2")
