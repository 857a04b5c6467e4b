"""Which option structure expresses a candidate: a table of rules, of which the first that fits decides.

A rule is data: the side, conviction tiers, volatility bands and conditions it asks for (none: any), the structure it
gives, its alternatives (each with what it asks for in turn) and what to avoid. `recommend` compiles the table to one
expression per output, so a row costs no join and no shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display names (fixed values).
LABELS = {
    "STOCK_LONG": "Long stock", "STOCK_SHORT": "Short stock", "LONG_CALL": "Long call", "LONG_PUT": "Long put", "CALL_DEBIT_SPREAD": "Call debit spread", "PUT_DEBIT_SPREAD": "Put debit spread",
    "RISK_REVERSAL_LONG": "Risk reversal (short put / long call)", "RISK_REVERSAL_SHORT": "Risk reversal (short call / long put)", "CALL_CREDIT_SPREAD": "Short call credit spread (bearish)",
    "PUT_CREDIT_SPREAD": "Short put credit spread (bullish)", "LONG_CALL_LEAP": "Long call LEAP", "LONG_PUT_LEAP": "Long put LEAP", "IRON_CONDOR": "Iron condor (mean-revert)", "STRADDLE_LONG": "Long straddle (vol expansion)",
    "STOCK_SHORT_WITH_HEDGE": "Short stock + long call hedge", "STAND_ASIDE": "Stand aside",
}
# Fixed values of the bands.
NEAR_EVENT, MID_EVENT, ILLIQUID_ADV, PIN_PCT, IV_MOVE = 5, 14, 20_000_000, 1.5, 10
MOST_ALTERNATIVES = 4
FIRM = ("elite", "strong")


@dataclass(frozen=True)
class Option:
    """A structure that is offered to some tiers, perhaps where long-dated flow dominates only."""

    structure: str
    tiers: tuple[str, ...] = ()
    leaps: bool = False


@dataclass(frozen=True)
class Rule:
    side: str | None
    structure: str
    tone: str
    tiers: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()
    illiquid: bool = False
    near_event: bool = False
    firm_tone: str | None = None
    options: tuple[Option, ...] = ()
    avoid: tuple[str, ...] = ()
    caveats: tuple[str, ...] = field(default=())


RICHER = ("RICH", "EXPENSIVE")
#: In order of precedence: weak conviction, illiquid chains, no side, then per side the event, rich to cheap volatility, the rest.
RULES = (
    Rule("LONG", "STAND_ASIDE", "warning", tiers=("weak",), avoid=("LONG_CALL", "RISK_REVERSAL_LONG"), caveats=("wait_for_second_signal",)),
    Rule(None, "STAND_ASIDE", "warning", tiers=("weak",), avoid=("LONG_PUT", "RISK_REVERSAL_SHORT"), caveats=("wait_for_second_signal",)),
    Rule("LONG", "STOCK_LONG", "neutral", illiquid=True, avoid=("CALL_DEBIT_SPREAD", "PUT_DEBIT_SPREAD"), caveats=("illiquid",)),
    Rule("SHORT", "STOCK_SHORT", "neutral", illiquid=True, avoid=("CALL_DEBIT_SPREAD", "PUT_DEBIT_SPREAD"), caveats=("illiquid",)),
    Rule(None, "STAND_ASIDE", "warning", illiquid=True, avoid=("CALL_DEBIT_SPREAD", "PUT_DEBIT_SPREAD"), caveats=("illiquid",)),
    Rule("NEUTRAL", "STAND_ASIDE", "info", bands=RICHER, options=(Option("IRON_CONDOR"),), caveats=("undefined_direction",)),
    Rule("NEUTRAL", "STAND_ASIDE", "info", caveats=("undefined_direction",)),
    Rule("LONG", "CALL_DEBIT_SPREAD", "warning", near_event=True, options=(Option("PUT_CREDIT_SPREAD"),), avoid=("LONG_CALL", "RISK_REVERSAL_LONG"), caveats=("event_near",)),
    Rule("LONG", "CALL_DEBIT_SPREAD", "neutral", bands=("EXPENSIVE",), firm_tone="positive", options=(Option("RISK_REVERSAL_LONG", FIRM), Option("PUT_CREDIT_SPREAD")), avoid=("LONG_CALL", "STRADDLE_LONG")),
    Rule("LONG", "CALL_DEBIT_SPREAD", "positive", bands=("RICH",), options=(Option("RISK_REVERSAL_LONG", ("elite",)), Option("STOCK_LONG")), avoid=("LONG_CALL",)),
    Rule("LONG", "LONG_CALL", "positive", bands=("CHEAP",), options=(Option("CALL_DEBIT_SPREAD"), Option("LONG_CALL_LEAP", FIRM, leaps=True), Option("RISK_REVERSAL_LONG", ("elite",)))),
    Rule("LONG", "STOCK_LONG", "neutral", options=(Option("CALL_DEBIT_SPREAD"), Option("RISK_REVERSAL_LONG", ("elite",))), caveats=("thin_chain",)),
    Rule("SHORT", "PUT_DEBIT_SPREAD", "warning", near_event=True, options=(Option("CALL_CREDIT_SPREAD"),), avoid=("LONG_PUT", "STOCK_SHORT"), caveats=("event_near",)),
    Rule("SHORT", "PUT_DEBIT_SPREAD", "neutral", bands=("EXPENSIVE",), firm_tone="positive", options=(Option("RISK_REVERSAL_SHORT", FIRM), Option("CALL_CREDIT_SPREAD")), avoid=("LONG_PUT", "STRADDLE_LONG")),
    Rule("SHORT", "PUT_DEBIT_SPREAD", "positive", bands=("RICH",), options=(Option("RISK_REVERSAL_SHORT", ("elite",)), Option("STOCK_SHORT")), avoid=("LONG_PUT",)),
    Rule("SHORT", "LONG_PUT", "positive", bands=("CHEAP",), options=(Option("PUT_DEBIT_SPREAD"), Option("LONG_PUT_LEAP", FIRM, leaps=True))),
    Rule("SHORT", "STOCK_SHORT", "neutral", options=(Option("PUT_DEBIT_SPREAD"), Option("STOCK_SHORT_WITH_HEDGE", ("elite",))), caveats=("thin_chain",)),
)


def side_of(direction: Column) -> Column:
    d = F.upper(F.trim(direction.cast("string")))
    return F.when(d.isin("LONG", "BULLISH", "BUY", "NET BULLISH"), "LONG").when(d.isin("SHORT", "BEARISH", "SELL", "NET BEARISH"), "SHORT").otherwise("NEUTRAL")


def iv_band(iv: Column) -> Column:
    return F.when(iv.isNull() | F.isnan(iv), "UNKNOWN").when(iv >= 70, "EXPENSIVE").when(iv >= 60, "RICH").when(iv >= 30, "MID").otherwise("CHEAP")


def conviction_tier(stack_score: Column, stack_tier: Column, conviction: Column) -> Column:
    """The stack's own tier, else that of the 0-10 score; weak without either. Halves round to even."""
    own = F.lower(stack_tier)
    s = F.bround(conviction * 10, 0)
    return F.when(stack_score.isNotNull() & (own != ""), own).when(s >= 80, "elite").when(s >= 65, "strong").when(s >= 50, "moderate").otherwise("weak")


def recommend(
    direction: Column, iv_rank: Column, tier: Column, days_to_earnings: Column | None = None, liquidity_tier: Column | None = None, adv_dollar: Column | None = None, dealer_bias: Column | None = None,
    window_return_pct: Column | None = None, pin_distance_pct: Column | None = None, iv_delta: Column | None = None, dte_bucket: Column | None = None,
) -> dict[str, Column]:
    """side, structure, label, tone, alternatives (at most four), avoid and caveats (codes, in order). Null inputs are unknown:
    they match no condition."""
    none = F.lit(None)
    num = lambda c: none.cast("double") if c is None else c.cast("double")
    text = lambda c: none.cast("string") if c is None else c.cast("string")
    sure = lambda c: F.coalesce(c, F.lit(False))
    side, band, days = side_of(direction), iv_band(iv_rank.cast("double")), num(days_to_earnings)
    liquid, adv = F.upper(text(liquidity_tier)), num(adv_dollar)
    illiquid = sure(liquid == "ILLIQUID") | (~sure(liquid == "THIN") & sure((adv > 0) & (adv < ILLIQUID_ADV)))
    near, thin, leaps = sure(days <= NEAR_EVENT), sure(liquid == "THIN"), sure(F.lower(text(dte_bucket)).isin("leap", "leaps"))

    def fits(r: Rule) -> Column:
        asks = [side == r.side] if r.side else []
        asks += [tier.isin(*r.tiers)] if r.tiers else []
        asks += [band.isin(*r.bands)] if r.bands else []
        asks += [illiquid] if r.illiquid else []
        asks += [near] if r.near_event else []
        out = F.lit(True)
        for a in asks:
            out = out & a
        return out

    # the number of the first rule that fits
    first = F.coalesce(*[F.when(fits(r), F.lit(k)) for k, r in enumerate(RULES)])
    pick = lambda of: F.element_at(F.array(*[of(r) for r in RULES]), first + 1)
    listed = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")

    def offered(o: Option) -> Column:
        ok = tier.isin(*o.tiers) if o.tiers else F.lit(True)
        return F.when(ok & leaps if o.leaps else ok, F.lit(o.structure))

    dealer, ret, pin, delta = F.lower(text(dealer_bias)), num(window_return_pct), num(pin_distance_pct), num(iv_delta)
    held = sure(dealer == "suppress") & (side != "NEUTRAL")
    earn = held & band.isin(*RICHER)
    credit = F.when(earn & (side == "LONG"), F.lit("PUT_CREDIT_SPREAD")).when(earn, F.lit("CALL_CREDIT_SPREAD"))
    s = F.when(side == "LONG", ret).when(side == "SHORT", -ret)
    more = [
        F.when(held, F.lit("dealers_long_gamma")).when(dealer == "chase", F.lit("dealers_short_gamma")), F.when(s <= -2.0, F.lit("price_fights_flow")).when(s >= 5.0, F.lit("late_chase")), F.when(pin <= PIN_PCT, F.lit("pin_near")),
        F.when(delta >= IV_MOVE, F.lit("iv_expanded")).when(delta <= -IV_MOVE, F.lit("iv_dropped")), F.when((days > NEAR_EVENT) & (days <= MID_EVENT), F.lit("event_ahead")),
    ]
    own = pick(lambda r: listed([F.when(thin, F.lit(c)) if c == "thin_chain" else F.lit(c) for c in r.caveats]))
    structure = pick(lambda r: F.lit(r.structure))
    return {
        "side": side, "structure": structure, "label": F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), structure),
        "tone": pick(lambda r: F.when(tier.isin(*FIRM), r.firm_tone).otherwise(r.tone) if r.firm_tone else F.lit(r.tone)),
        "alternatives": F.slice(F.array_compact(F.concat(pick(lambda r: listed([offered(o) for o in r.options])), F.array(credit))), 1, MOST_ALTERNATIVES),
        "avoid": pick(lambda r: listed([F.lit(a) for a in r.avoid])), "caveats": F.array_compact(F.concat(own, F.array(*more))),
    }
