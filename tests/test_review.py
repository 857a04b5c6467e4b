"""Structure rules on made rows, the refit against a plain version, split ranks, the complementary error function."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.functions import structures as V
from flowmill.operators import refit
from flowmill.operators import stats as S

ROW = "direction string, iv double, tier string, days int, liq string, adv double, dealer string, wr double, pin double, moved double, bucket string"
BASE = {"direction": "LONG", "iv": 45.0, "tier": "strong", "days": None, "liq": "DEEP", "adv": 1e9, "dealer": None, "wr": None, "pin": None, "moved": None, "bucket": "swing"}
CASES = [  # what differs from BASE, and what must come out
    ({"tier": "elite", "iv": 20.0}, {"structure": "LONG_CALL", "alternatives": ["CALL_DEBIT_SPREAD", "RISK_REVERSAL_LONG"], "tone": "positive"}),
    ({"tier": "elite", "iv": 20.0, "bucket": "LEAPS"}, {"alternatives": ["CALL_DEBIT_SPREAD", "LONG_CALL_LEAP", "RISK_REVERSAL_LONG"]}),
    ({"iv": 65.0, "days": 25}, {"structure": "CALL_DEBIT_SPREAD", "avoid": ["LONG_CALL"], "caveats": [], "alternatives": ["STOCK_LONG"]}),
    ({"tier": "moderate"}, {"structure": "STOCK_LONG", "alternatives": ["CALL_DEBIT_SPREAD"]}),
    ({"days": 3, "iv": 80.0}, {"structure": "CALL_DEBIT_SPREAD", "tone": "warning", "avoid": ["LONG_CALL", "RISK_REVERSAL_LONG"], "caveats": ["event_near"]}),
    ({"direction": "BEARISH", "iv": 65.0, "tier": "elite"}, {"structure": "PUT_DEBIT_SPREAD", "alternatives": ["RISK_REVERSAL_SHORT", "STOCK_SHORT"]}),
    ({"direction": "sell", "iv": 10.0}, {"side": "SHORT", "structure": "LONG_PUT"}),
    ({"direction": "SHORT", "tier": "elite", "liq": "THIN"}, {"structure": "STOCK_SHORT", "alternatives": ["PUT_DEBIT_SPREAD", "STOCK_SHORT_WITH_HEDGE"], "caveats": ["thin_chain"]}),
    ({"tier": "weak", "liq": "ILLIQUID"}, {"structure": "STAND_ASIDE", "tone": "warning", "avoid": ["LONG_CALL", "RISK_REVERSAL_LONG"]}),
    ({"liq": "ILLIQUID"}, {"structure": "STOCK_LONG", "avoid": ["CALL_DEBIT_SPREAD", "PUT_DEBIT_SPREAD"], "caveats": ["illiquid"]}),
    ({"liq": None, "adv": 5e6}, {"structure": "STOCK_LONG", "caveats": ["illiquid"]}),
    ({"dealer": "suppress", "iv": 75.0}, {"caveats": ["dealers_long_gamma"], "alternatives": ["RISK_REVERSAL_LONG", "PUT_CREDIT_SPREAD", "PUT_CREDIT_SPREAD"]}),
    ({"wr": 6.0, "pin": 1.0, "moved": 12.0, "days": 10}, {"caveats": ["late_chase", "pin_near", "iv_expanded", "event_ahead"]}),
    ({"direction": "SHORT", "wr": 2.5, "dealer": "chase", "moved": -10.0}, {"caveats": ["dealers_short_gamma", "price_fights_flow", "iv_dropped"]}),
    ({"direction": "mixed"}, {"side": "NEUTRAL", "structure": "STAND_ASIDE", "alternatives": [], "tone": "info"}),
    ({"direction": None, "iv": 72.0}, {"structure": "STAND_ASIDE", "alternatives": ["IRON_CONDOR"]}),
    ({"iv": None, "adv": None, "liq": None, "bucket": None}, {"structure": "STOCK_LONG", "label": "Long stock"}),
]


def test_structures(spark):
    rows = [tuple((BASE | change)[c] for c in BASE) + (i,) for i, (change, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, ROW + ", k int")
    out = V.recommend(*[F.col(c) for c in BASE])
    got = {r["k"]: r.asDict() for r in df.select("k", *[v.alias(n) for n, v in out.items()]).collect()}
    for i, (_, want) in enumerate(CASES):
        assert {k: got[i][k] for k in want} == want, CASES[i]
        assert all(x in V.LABELS for x in [got[i]["structure"], *got[i]["alternatives"], *got[i]["avoid"]])
    tiers = spark.createDataFrame([(90.0, "Elite", 1.0), (None, None, 8.0), (None, "x", 6.6), (50.0, "", 5.0), (None, None, None)], "s double, t string, c double")
    assert [r[0] for r in tiers.select(V.conviction_tier(F.col("s"), F.col("t"), F.col("c"))).collect()] == ["elite", "elite", "strong", "moderate", "weak"]


def plain_nnls(x, y):
    """The best of all subsets whose least-squares solution is non-negative."""
    best, out = y @ y, np.zeros(x.shape[1])
    for k in range(1, x.shape[1] + 1):
        for s in itertools.combinations(range(x.shape[1]), k):
            b = np.linalg.lstsq(x[:, s], y, rcond=None)[0]
            e = y - x[:, s] @ b
            if (b >= 0).all() and e @ e < best - 1e-12:
                best, out = e @ e, np.zeros(x.shape[1])
                out[list(s)] = b
    return out


def test_nnls():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = rng.random((50, 6))
        x[:, 3] = x[:, 2] * 0.7 + 0.3 * x[:, 3]
        y = x @ rng.normal(0, 1, 6) + rng.normal(0, 0.5, 50)
        assert refit.nnls(x.T @ x, x.T @ y) == pytest.approx(plain_nnls(x, y), abs=1e-8)


def ranks(v):
    order = sorted(v)
    return [(order.index(a) + len(order) - 1 - order[::-1].index(a)) / 2 for a in v]


def rho(a, b):
    a, b = ranks(a), ranks(b)
    return float(np.corrcoef(a, b)[0, 1]) if len(set(a)) > 1 and len(set(b)) > 1 else None


def made(n, bucket, good, seed):
    """Rows whose outcome follows mass alone (good) or nothing at all."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = [rng.randint(0, 20) / 20 for _ in refit.NAMES]
        y = 3 * p[4] + rng.gauss(0, 0.3) if good else rng.gauss(0, 1)
        out.append((dt.date(2024, 1, 1) + dt.timedelta(i // 7), f"T{i % 7}", bucket, y if i % 50 else None, *p))
    return out


def test_refit(spark):
    rows = made(200, "0-7", True, 1) + made(120, "leap", False, 2) + made(20, "swing", True, 3) + made(45, "position", True, 4)
    schema = "as_of date, ticker string, bucket string, r double, " + ", ".join(f"{n} double" for n in refit.NAMES)
    got = {x["group"]: x.asDict() for x in refit.refit(spark.createDataFrame(rows, schema), "r", "bucket", "as_of", ["ticker", "bucket"]).collect()}
    assert set(got) == {"global", *refit.BUCKETS}
    assert got["unknown"]["reason"] == "no_rows" and got["swing"]["reason"] == "insufficient_n" and got["swing"]["mass"] == 0.05
    assert got["lottery"]["accepted"] and got["lottery"]["confidence"] == "high" and got["lottery"]["mass"] > 0.5
    assert not got["leap"]["accepted"] and got["leap"]["reason"] == "tight_threshold_unmet" and got["leap"]["persistence"] == 0.25
    assert got["position"]["confidence"] == "medium" and got["position"]["accepted"]
    names = {"0-7": "lottery", "leap": "leap", "position": "position"}
    for bucket, name in names.items():
        own = sorted((x for x in rows if x[2] == bucket and x[3] is not None), key=lambda x: x[:2])
        n_train = min(max(30, int(len(own) * 0.6)), len(own) - 5)
        x, y = np.array([v[4:] for v in own]), np.array([v[3] for v in own])
        b = plain_nnls(x[:n_train], y[:n_train])
        w = [round(v, 4) for v in b / b.sum()]
        assert got[name]["n_train"] == n_train
        assert got[name]["rho_new"] == pytest.approx(rho([round(v, 12) for v in (x[n_train:] @ w).tolist()], y[n_train:].tolist()), abs=1e-6)
        assert got[name]["rho_old"] == pytest.approx(rho([round(v, 12) for v in (x[n_train:] @ list(refit.WEIGHTS.values())).tolist()], y[n_train:].tolist()), abs=1e-6)
        if got[name]["accepted"]:
            assert [got[name][k] for k in refit.NAMES] == pytest.approx(w, abs=1e-4)


def test_split_ranks_and_p_values(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.choice([rng.randint(0, 9), rng.gauss(0, 5)])), rng.gauss(0, 1)) for k in "ab" for _ in range(700)] + [("c", 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r for r in S.split_spearman(df, ["k"], "x", "y").withColumn("p", S.rank_p_value(F.col("spearman"), F.col("n"))).collect()}
    for k in "ab":
        want = rho([r[1] for r in rows if r[0] == k], [r[2] for r in rows if r[0] == k])
        assert got[k]["spearman"] == pytest.approx(want, abs=1e-12)
        assert got[k]["p"] == pytest.approx(math.erfc(abs(want) * math.sqrt(699) / math.sqrt(2)), abs=1e-6)
    assert got["c"]["spearman"] is None and got["c"]["p"] is None
    zs = spark.createDataFrame([(z / 10,) for z in range(60)], "z double").select("z", S.erfc(F.col("z"))).collect()
    assert all(abs(e - math.erfc(z)) < 1e-6 for z, e in zs)
