"""Trade-plan replay: barrier labels by first touch over the bars after an entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import let

# Fixed values of the plan and, per expiry bucket, of holding and trailing.
STOP_ATR, T1_ATR, T2_ATR, POST_T1_ATR, PARTIAL = 1.0, 1.5, 3.0, 1.0, 0.5
HOLD = {"lottery": (3, 0.5, 1.5), "swing": (7, 0.5, 2.1), "position": (10, 1.0, 2.3), "leap": (15, 0.5, 2.1), "unknown": (5, 1.0, 2.4)}


def canonical_bucket(label):
    s = F.lower(F.trim(label))
    return (
        F.when(s.isin("0-7", "0-7d", "lottery"), "lottery").when(s.isin("8-30", "8-30d", "swing"), "swing").when(s.isin("31-90", "31-90d", "position"), "position").when(s.isin("91+", "91+d", "leap", "leaps"), "leap").otherwise("unknown")
    )


def _planned(p: DataFrame) -> DataFrame:
    """p (direction, bucket, atr, entry) with stop and targets (mirrored for shorts), holding and trailing by bucket."""
    sign = F.when(F.col("direction").isin("LONG", "BULLISH"), 1.0).otherwise(-1.0)
    p = p.withColumn("sign", sign).withColumn("bucket", canonical_bucket(F.col("bucket")))
    for k, name in enumerate(("max_hold", "min_r", "trail_atr")):
        v = F.lit(HOLD["unknown"][k])
        for b, x in HOLD.items():
            v = F.when(F.col("bucket") == b, x[k]).otherwise(v)
        p = p.withColumn(name, v)
    level = lambda m: F.col("entry") + F.col("sign") * m * F.col("atr")
    return p.withColumns({"stop": level(-STOP_ATR), "t1": level(T1_ATR), "t2": level(T2_ATR), "risk": STOP_ATR * F.col("atr")})


def plans_from(decisions: DataFrame, feat: DataFrame) -> DataFrame:
    """decisions (ticker, i, direction, bucket) at a decision bar -> plan: entry at the next bar's open, ATR of the
    decision bar, stop and targets (mirrored for shorts), holding and trailing by bucket."""
    w = Window.partitionBy("ticker").orderBy("i")
    at = feat.select("ticker", "i", F.col("date").alias("as_of"), F.col("atr14").alias("atr"), F.lead("open").over(w).alias("entry"), F.lead("date").over(w).alias("entry_date"))
    return _planned(decisions.join(at, ["ticker", "i"]).filter((F.col("atr") > 0) & (F.col("entry") > 0)))


#: The longest holding of a plan, hence the bars that are looked at after its entry.
LONGEST = max(x[0] for x in HOLD.values())
_BAR = ("i", "date", "open", "high", "low", "close", "ema20")


def replay(plans: DataFrame, feat: DataFrame) -> DataFrame:
    """Exit reason, price and day, partial fill, realised R, best and worst excursion and hit flags of every plan
    that has a bar after its entry. A plan holds LONGEST bars at most.

    Plans and bars meet in one window per ticker, in which a plan gathers the bars of its holding: nothing is moved per
    plan and bar."""
    p = plans.select("ticker", "i", F.struct("*").alias("_p"), F.lit(None).cast("struct<k:int,high:double,low:double,close:double,ema20:double>").alias("_b"))
    b = feat.select("ticker", "i", F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(F.col("i").cast("int").alias("k"), *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "ema20")]).alias("_b"))
    w = Window.partitionBy("ticker").orderBy("i").rangeBetween(2, 1 + LONGEST)
    rows = p.unionByName(b).withColumn("path", F.collect_list("_b").over(w)).filter("_p is not null").select("_p.*", "path")
    too_long = F.raise_error(F.lit(f"a plan holds more than {LONGEST} bars"))
    return _walked(rows.withColumn("max_hold", F.when(F.col("max_hold") > LONGEST, too_long.cast("int")).otherwise(F.col("max_hold"))))


def replay_bars(decided: DataFrame, more: tuple = ()) -> DataFrame:
    """replay of one plan per bar: decided are the bars with features, and direction and bucket of the decision taken at each
    (null: none). The plan, its entry and the bars after it come out of one window on the bars' own order. more: columns kept."""
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = F.collect_list(F.struct(F.col("i").alias("k"), *_BAR[1:])).over(w.rowsBetween(1, 1 + LONGEST))
    return _entered(decided.select("ticker", "i", F.col("date").alias("as_of"), "direction", "bucket", F.col("atr14").alias("atr"), *more, ahead.alias("path")), more)


def _met(decisions: DataFrame, feat: DataFrame) -> DataFrame:
    """decisions (ticker, date, ...) with _own, the bar of their date or null, and path, the bars after it. Decisions and bars
    meet in one window per ticker instead of a join: the inputs are moved once, or not at all if both lie by ticker."""
    d = decisions.select("ticker", "date", F.struct(*[c for c in decisions.columns if c not in ("ticker", "date")]).alias("_d"))
    bar = F.struct(F.col("i").alias("k"), *_BAR[1:], "atr14")
    b = feat.select("ticker", "date", F.lit(None).cast(d.schema["_d"].dataType).alias("_d"), bar.alias("_b"))
    both = d.withColumn("_b", F.lit(None).cast(b.schema["_b"].dataType)).unionByName(b)
    w = Window.partitionBy("ticker").orderBy("date", F.col("_d").isNotNull())
    both = both.withColumn("_own", F.last("_b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = F.collect_list("_b").over(Window.partitionBy("ticker").orderBy("_own.k").rangeBetween(1, 1 + LONGEST))
    both = both.withColumn("path", ahead).filter("_d is not null")
    own = F.when(F.col("_own.date") == F.col("date"), F.col("_own"))
    return both.select("ticker", "date", "_d.*", own.alias("_own"), F.when(own.isNotNull(), F.col("path")).alias("path"))


def replay_board(decisions: DataFrame, feat: DataFrame, more: tuple = ()) -> DataFrame:
    """replay of decisions (ticker, date, direction, bucket) taken at the bar of their date, each with the columns `more`; a
    decision without such a bar has no plan."""
    met = _met(decisions, feat).filter("_own is not null")
    return _entered(met.select("ticker", F.col("_own.k").alias("i"), F.col("date").alias("as_of"), "direction", "bucket", F.col("_own.atr14").alias("atr"), "path", *more), more)


def board_outcomes(board: DataFrame, feat: DataFrame, index: DataFrame, horizon: int) -> DataFrame:
    """The rows of a board with realized_r of the plan that each made (null without one) and signed_excess, the return of
    `horizon` bars less the benchmark's between the same dates, signed by direction. index: _d, _c, a row per date."""
    met = _met(board.withColumnRenamed("as_of", "date"), feat)
    later = F.try_element_at("path", F.lit(horizon))
    met = met.withColumns({"_then": later["date"], "_gain": later["close"] / F.col("_own.close") - 1})
    a, b = (F.broadcast(index.select(F.col("_d").alias(k), F.col("_c").alias(v))) for k, v in (("date", "_xc"), ("_then", "_yc")))
    met = met.join(a, "date", "left").join(b, "_then", "left")
    sign = F.when(F.col("direction") == "BEARISH", -1.0).otherwise(1.0)
    met = met.withColumn("signed_excess", sign * (F.col("_gain") - (F.col("_yc") / F.col("_xc") - 1)))
    row = F.struct(*[F.col("date").alias("as_of") if c == "as_of" else F.col(c) for c in board.columns], "signed_excess").alias("_row")
    plans = met.select("ticker", F.col("_own.k").alias("i"), F.col("date").alias("as_of"), "direction", F.col("dominant_dte_bucket").alias("bucket"), F.col("_own.atr14").alias("atr"), "path", row)
    return _entered(plans, ("_row",), every=True).select("_row.*", "realized_r")


def _entered(p: DataFrame, more: tuple = (), every: bool = False) -> DataFrame:
    """Plans entered at the open of the first bar of their path. every: what is no plan stays, without a result."""
    first = F.try_element_at("path", F.lit(1))
    p = p.withColumns({"entry": first["open"], "entry_date": first["date"]})
    sound = (F.col("atr") > 0) & (F.col("entry") > 0) & F.col("direction").isNotNull()
    return _walked(_planned(p.withColumn("path", F.when(sound, F.col("path"))) if every else p.filter(sound)), more, every)


def _walked(p: DataFrame, more: tuple = (), every: bool = False) -> DataFrame:
    """The outcome of plans with `path`, the bars from number k on in order.

    Prices are multiplied by the plan's sign, which turns shorts into longs: their low is then the high. The running
    maximum gives the trailing stop, which includes the bar's own high before its low is tested. Order in a bar: T2,
    stop, time. The walk ends at the first of them."""
    s, c = F.col("sign"), F.col
    p = p.withColumns({"en": s * c("entry"), "st": s * c("stop"), "a1": s * c("t1"), "a2": s * c("t2")})
    offset = lambda x: x["k"] - c("i") - 1
    within = F.filter("path", lambda x: (offset(x) >= 1) & (offset(x) <= c("max_hold")))
    seen = F.transform(within, lambda x: F.struct(
        offset(x).cast("int").alias("offset"), F.when(s > 0, x["high"]).otherwise(-x["low"]).alias("hi"), F.when(s > 0, x["low"]).otherwise(-x["high"]).alias("lo"), (s * x["close"]).alias("cl"), (s * x["ema20"]).alias("em"),
    ))
    if not every:
        p = p.filter(F.exists("path", lambda x: (offset(x) >= 1) & (offset(x) <= c("max_hold"))))
    p = p.withColumn("path", seen)
    null, no = (lambda t: F.lit(None).cast(t)), F.lit(False)
    start = F.struct(
        c("en").alias("best"), no.alias("t1_hit"), null("int").alias("t1_day"), null("double").alias("up"), null("int").alias("up_day"), null("double").alias("down"), no.alias("h1"), no.alias("h2"), no.alias("h3"), no.alias("h4"),
        null("int").alias("day"), null("string").alias("flag"), null("double").alias("active"), null("double").alias("cl"),
    )

    p = p.withColumns({"_lifted": F.greatest(c("st"), c("a1") - POST_T1_ATR * c("atr")), "_trail": c("trail_atr") * c("atr"), "_wide": F.least(c("trail_atr") * c("atr"), 2 * c("atr"))})

    def bar(x):
        """What a bar says by itself: excursions, result, and how far below the best the stop trails (the hybrid stop from twice the
        risk on is a trail of two ATR), with the floor that holds besides."""
        r = (x["cl"] - c("en")) / c("risk")
        return F.struct(((x["hi"] - c("en")) / c("risk")).alias("up"), ((x["lo"] - c("en")) / c("risk")).alias("down"), F.coalesce(x["hi"] >= c("a1"), no).alias("reached"), r.alias("r"))

    def step(a, x):
        def here(y):
            best, t1_hit = F.greatest(a["best"], x["hi"]), a["t1_hit"] | y["reached"]
            gap = F.when(y["r"] < 2, c("_trail")).otherwise(c("_wide"))
            active = F.greatest(F.when(t1_hit, c("_lifted")).otherwise(c("st")), best - gap, F.when(x["em"] < c("en"), x["em"]).otherwise(c("st")), F.when((y["r"] >= 1) & (y["r"] < 2), c("en")).otherwise(c("st")))
            return F.struct(best.alias("best"), t1_hit.alias("t1_hit"), active.alias("active"))

        def after(y, z):
            up, better = y["up"], y["up"].isNotNull() & (a["up"].isNull() | (y["up"] > a["up"]))
            flag = F.when(x["hi"] >= c("a2"), "T2").when(x["lo"] <= z["active"], "stop").when((x["offset"] >= c("max_hold")) & (y["r"] < c("min_r")), "time_stop")
            hit = lambda h, n, least: a[h] | F.coalesce((x["offset"] <= n) & (up >= least), no)
            return F.struct(
                z["best"].alias("best"), z["t1_hit"].alias("t1_hit"), F.coalesce(a["t1_day"], F.when(y["reached"], x["offset"])).alias("t1_day"), F.when(better, up).otherwise(a["up"]).alias("up"), F.when(better, x["offset"]).otherwise(a["up_day"]).alias("up_day"),
                F.least(a["down"], y["down"]).alias("down"), hit("h1", 3, 0.5).alias("h1"), hit("h2", 5, 1.0).alias("h2"), hit("h3", 5, 2.0).alias("h3"), hit("h4", 10, 3.0).alias("h4"),
                x["offset"].alias("day"), flag.alias("flag"), z["active"].alias("active"), x["cl"].alias("cl"),
            )

        # each part is bound to a name, as an expression that is used twice would be computed twice
        return F.when(a["flag"].isNotNull(), a).otherwise(let(bar(x), lambda y: let(here(y), lambda z: after(y, z))))

    walk = F.aggregate("path", start, step)
    g = p.select(*[k for k in p.columns if k != "path"], walk.alias("x"))
    flag, day, t1_day = c("x.flag"), c("x.day"), c("x.t1_day")
    g = g.withColumn("partial_filled", F.coalesce(F.when(flag == "T2", t1_day < day).otherwise(t1_day <= day), no))
    out = F.when(flag == "T2", c("a2")).when(flag == "stop", c("x.active")).otherwise(c("x.cl"))
    rest = (out - c("en")) / c("risk")
    realized = F.when(c("partial_filled"), PARTIAL * (c("a1") - c("en")) / c("risk") + (1 - PARTIAL) * rest).otherwise(rest)
    reason = F.when(flag.isNull(), "no_exit_yet").when((flag == "stop") & c("partial_filled"), "T1_then_stop").otherwise(flag)
    mfe = F.greatest(c("x.up"), F.lit(0.0))
    return g.select(
        "ticker", "i", "direction", "as_of", "entry_date", "bucket", "entry", "stop", "t1", "t2", reason.alias("exit_reason"), (c("sign") * out).alias("exit_price"), day.alias("days_held"), "partial_filled", realized.alias("realized_r"),
        mfe.alias("mfe_r"), F.least(c("x.down"), F.lit(0.0)).alias("mae_r"), F.when(mfe > 0, c("x.up_day")).alias("mfe_day"), c("x.h1").alias("hit_0_5r_within_3d"), c("x.h2").alias("hit_1r_within_5d"), c("x.h3").alias("hit_2r_within_5d"), c("x.h4").alias("hit_3r_within_10d"), *more,
    )


#: The stop that turns a return into a multiple of the risk where nothing was replayed (fixed value).
ASSUMED_STOP = 0.02


def excess_returns(bars: DataFrame, index: DataFrame, horizon: int) -> DataFrame:
    """(ticker, date, excess): the return over `horizon` bars less the benchmark's between the same dates."""
    b = bars.select("ticker", "date", "close", F.lead(F.struct("date", "close"), horizon).over(Window.partitionBy("ticker").orderBy("date")).alias("n")).filter("n is not null")
    x = index.select(F.col("date").alias("_xd"), F.col("close").alias("_xc"))
    y = index.select(F.col("date").alias("_yd"), F.col("close").alias("_yc"))
    j = b.join(x, b["date"] == x["_xd"]).join(y, F.col("n.date") == y["_yd"])
    return j.select("ticker", "date", ((F.col("n.close") / F.col("close") - 1) - (F.col("_yc") / F.col("_xc") - 1)).alias("excess"))


def known(rows: DataFrame, name: str, value) -> DataFrame:
    """rows with value as column `name` where it is not null. It is a generated column: the filter would else move below the walk of
    the plans, which would be walked twice."""
    return rows.select(*[k for k in rows.columns if k != name], F.explode(F.array(value)).alias(name)).filter(F.col(name).isNotNull())


def outcome_r(rows: DataFrame) -> DataFrame:
    """rows with r and hit: the replayed multiple, else the signed excess return over ASSUMED_STOP; rows with neither drop."""
    r = F.coalesce("realized_r", F.col("signed_excess") / ASSUMED_STOP)
    return known(rows, "r", r).withColumn("hit", F.col("r") > 0)


def closed_trades(positions: DataFrame) -> DataFrame:
    """positions (direction, entry_price, exit_price, risk_per_share, shares, ...) with pnl_pct, pnl_dollar and r_multiple of
    each closed trade; the multiple is 0 where nothing was at risk, a null size counts as none."""
    gain = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0) * (F.col("exit_price") - F.col("entry_price"))
    plain = lambda c, n: F.round(c, n) + F.lit(0.0)
    return positions.withColumns({
        "pnl_pct": plain(F.try_divide(gain, F.col("entry_price")), 4),
        "pnl_dollar": plain(gain * F.coalesce("shares", F.lit(0)), 2),
        "r_multiple": plain(F.when(F.col("risk_per_share") > 0, F.try_divide(gain, F.col("risk_per_share"))).otherwise(0.0), 2),
    })


def score_band(score):
    """Bands of a final score (fixed values)."""
    return F.when(score < 7, "<7").when(score < 8, "7-8").when(score < 9, "8-9").otherwise("9-10")


def performance(trades: DataFrame, dimensions: dict) -> DataFrame:
    """(dimension, level, trades, win_rate, avg_r, total_pnl, profit_factor) of closed trades under every dimension at once: each trade
    is put under all its levels, and partial sums leave the map side. Rates in percent; no profit factor without a loss."""
    tags = F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("string").alias("level")) for k, v in dimensions.items()])
    pnl = F.col("pnl_dollar")
    long_ = trades.select("pnl_dollar", "r_multiple", F.inline(tags))
    lost = -F.sum(F.when(pnl <= 0, pnl))
    return long_.groupBy("dimension", "level").agg(
        F.count("*").alias("trades"), F.avg(F.when(pnl > 0, 100.0).otherwise(0.0)).alias("win_rate"), F.avg("r_multiple").alias("avg_r"), F.sum("pnl_dollar").alias("total_pnl"), F.try_divide(F.sum(F.when(pnl > 0, pnl)), F.nullif(lost, F.lit(0.0))).alias("profit_factor"),
    )
