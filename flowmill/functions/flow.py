"""Column expressions on flow events and their scores. Every function returns Columns or adds columns; nothing
here moves rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scoring model.
BID_CONFIDENCE = 0.5
HALF_LIFE_HOURS = 6.0
SIGMA = 0.35
FLOW_WEIGHTS = {"flow_intensity": 0.29, "premium_per_trade": 0.17, "vol_oi": 0.17, "repeat": 0.14, "sweep": 0.12, "dte": 0.06, "breadth": 0.05}
FLOW_THRESHOLDS = {
    "flow_intensity": (math.log1p(0.01), math.log1p(1.0)), "premium_per_trade": (math.log1p(0.005), math.log1p(0.5)), "vol_oi": (0.5, 3.0),
    "repeat": (1.0, 10.0), "sweep": (0.0, 8.0), "dte": (0.3, 1.0), "breadth": (0.1, 0.8),
}
TRACKER_BUCKETS = (("0-7", 0, 7, 0.90), ("8-30", 8, 30, 1.00), ("31-90", 31, 90, 1.05), ("91+", 91, 9999, 1.05))
PREMIUM_BUCKETS = (("lottery", 0, 14), ("swing", 30, 120), ("leap", 180, 9999))
GRADES = ((8.5, "A+"), (7.5, "A"), (6.75, "A-"), (6.0, "B+"), (5.0, "B"), (4.0, "B-"))


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def with_direction(df: DataFrame) -> DataFrame:
    """execution_side from the premium split, direction from option type and side, and its confidence."""
    require_columns(df, "ask_side_premium", "bid_side_premium", "option_type")
    ask, bid = F.col("ask_side_premium"), F.col("bid_side_premium")
    side = F.when(ask > bid, "ASK").when(bid > ask, "BID").otherwise("MIXED")
    bought = (F.col("option_type") == "CALL") == (F.col("execution_side") == "ASK")
    return (
        df.withColumn("execution_side", side)
        .withColumn("direction", F.when(F.col("execution_side") != "MIXED", F.when(bought, "LONG").otherwise("SHORT")))
        .withColumn("direction_confidence", F.when(F.col("execution_side") == "ASK", 1.0).when(F.col("execution_side") == "BID", BID_CONFIDENCE).otherwise(0.0))
    )


def qualifying(df: DataFrame, min_premium: float = 500_000, min_dte: int = 30, max_dte: int = 120, require_ask_side: bool = False) -> DataFrame:
    """Events of the swing window whose side is known."""
    require_columns(df, "premium", "dte", "option_type", "execution_side")
    sides = ["ASK"] if require_ask_side else ["ASK", "BID"]
    return df.filter((F.col("premium") >= min_premium) & F.col("dte").between(min_dte, max_dte) & F.col("option_type").isin("CALL", "PUT") & F.col("execution_side").isin(sides))


def volume_oi_ratio() -> Column:
    return F.try_divide(F.col("volume").cast("double"), F.nullif(F.col("open_interest").cast("double"), F.lit(0.0)))


def recency_weight(as_of: Column, ts: Column | None = None) -> Column:
    """Half the weight for every HALF_LIFE_HOURS of age at as_of; future events weigh 1."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(ts if ts is not None else F.col("event_ts"))) / 3600.0
    return F.exp(-math.log(2) * F.greatest(age, F.lit(0.0)) / HALF_LIFE_HOURS)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function by the Abramowitz-Stegun 7.1.26 polynomial of erf (error below 2e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def delta_proxy(sigma: float = SIGMA) -> Column:
    """Signed Black-Scholes delta with rate 0 and flat volatility; null on bad input."""
    t = F.greatest(F.col("dte").cast("double"), F.lit(1.0)) / 365.0
    d1 = (F.ln(F.col("underlying_price") / F.col("strike")) + 0.5 * sigma * sigma * t) / (sigma * F.sqrt(t))
    good = (F.col("strike") > 0) & (F.col("underlying_price") > 0)
    return F.when(good & F.col("option_type").startswith("C"), norm_cdf(d1)).when(good & F.col("option_type").startswith("P"), norm_cdf(d1) - 1)


def linear_delta() -> Column:
    """Delta from moneyness alone: 0.5 plus five times moneyness, clipped; puts less one."""
    near = F.greatest(F.lit(-0.45), F.least(F.lit(0.45), 5 * (F.col("underlying_price") - F.col("strike")) / F.col("underlying_price")))
    return F.when(F.col("option_type") == "PUT", 0.5 + near - 1).otherwise(0.5 + near)


def delta_choice(df: DataFrame, vendor: Column) -> DataFrame:
    """The vendor's delta where there is one, else the proxy: magnitude at most 1, sign from the option type,
    the premium it weighs, and where it came from."""
    proxy = delta_proxy()
    df = df.withColumn("delta_magnitude", F.least(F.abs(F.coalesce(vendor, proxy)), F.lit(1.0)))
    source = F.when(vendor.isNotNull(), "vendor").when(proxy.isNotNull(), "proxy").otherwise("missing")
    signed = F.when(F.col("option_type") == "PUT", -F.col("delta_magnitude")).otherwise(F.col("delta_magnitude"))
    return df.withColumn("delta", signed).withColumn("delta_premium", F.col("premium") * F.col("delta_magnitude")).withColumn("delta_source", source)


def occ_id(ticker: Column, expiry: Column, option_type: Column, strike: Column) -> Column:
    """Contract id TICKERyymmddC00000000; null where a part is missing or bad."""
    letter = F.substring(F.upper(F.trim(option_type)), 1, 1)
    cents = F.round(strike * 1000).cast("long")
    ok = (F.length(F.trim(ticker)) > 0) & expiry.isNotNull() & letter.isin("C", "P") & (strike > 0)
    return F.when(ok, F.concat(F.upper(F.trim(ticker)), F.date_format(expiry, "yyMMdd"), letter, F.lpad(cents.cast("string"), 8, "0")))


def parse_occ(symbol: Column) -> dict[str, Column]:
    """Ticker, expiry, type and strike of a contract id. Years 69 to 99 are in the 1900s."""
    pattern = r"^([A-Z0-9]+?)(\d{6})([CP])(\d{8})$"
    part = lambda k: F.regexp_extract(symbol, pattern, k)
    ok = symbol.rlike(pattern)
    short = F.nullif(F.substring(part(2), 1, 2), F.lit("")).cast("int")
    year = F.when(short >= 69, 1900 + short).otherwise(2000 + short)
    return {
        "occ_ticker": F.when(ok, part(1)), "occ_expiry": F.when(ok, F.make_date(year, F.substring(part(2), 3, 2).cast("int"), F.substring(part(2), 5, 2).cast("int"))),
        "occ_type": F.when(ok, F.when(part(3) == "C", "CALL").otherwise("PUT")), "occ_strike": F.when(ok, part(4).cast("long") / 1000.0),
    }


def clip_scale(x: Column, floor: float, ceiling: float) -> Column:
    """0 at floor, 1 at ceiling, linear between."""
    if ceiling == floor:
        return F.lit(0.5)
    return (F.least(F.greatest(x, F.lit(float(floor))), F.lit(float(ceiling))) - floor) / (ceiling - floor)


def dte_score(dte: Column) -> Column:
    return F.when(dte.isNull(), 0.0).when(dte.between(30, 90), 1.0).when((dte > 90) & (dte <= 150), 0.7).otherwise(0.3)


def bucket(dte: Column, table: tuple = TRACKER_BUCKETS) -> Column:
    out = F.lit(None).cast("string")
    for label, lo, hi, *_ in reversed(table):
        out = F.when(dte.between(lo, hi), label).otherwise(out)
    return out


def unit_scores(side: str) -> dict[str, Column]:
    """The seven 0-1 components of one side of the ticker aggregate."""
    t = FLOW_THRESHOLDS
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return {
        "flow_intensity": clip_scale(F.log1p(zero(f"{side}_flow_intensity") * 10_000), *t["flow_intensity"]),
        "premium_per_trade": clip_scale(F.log1p(F.col(f"{side}_ppt_bps")), *t["premium_per_trade"]),
        "vol_oi": clip_scale(zero(f"{side}_vol_oi"), *t["vol_oi"]), "repeat": clip_scale(F.col(f"{side}_repeat_count").cast("double"), *t["repeat"]),
        "sweep": clip_scale(F.col(f"{side}_sweep_count").cast("double"), *t["sweep"]), "dte": clip_scale(F.col("dte_score"), *t["dte"]),
        "breadth": clip_scale(F.col(f"{side}_breadth"), *t["breadth"]),
    }


def weighted_score(units: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, u in units.items():
        total = total + FLOW_WEIGHTS[name] * u
    return total


def grade(score: Column) -> Column:
    """Seven-tier conviction grade of a 0-10 score; a missing score is a C."""
    out = F.lit("C")
    for least, label in reversed(GRADES):
        out = F.when(score >= least, label).otherwise(out)
    return out


def coarse_grade(g: Column) -> Column:
    return F.substring(g, 1, 1)


def mcap_or_null(mcap: Column, least: float = 1e8) -> Column:
    """Market caps below `least` (funds, broken data) count as missing."""
    return F.when(mcap >= least, mcap)
