"""Personal data: base patterns, high-recall candidates and boosted trees, all in DataFrame functions.

Base kinds (email, ip, card, phone) are found by pattern and check. Generators then propose further, overlapping
spans (keys, assigned secrets, digits in the shape of phones or accounts). A gradient-boosted
ensemble of depth-two trees scores each candidate by format and context; those at or above a calibrated
threshold that overlap no base span are added as kind 'secret' or 'contact'. The trees are fitted on a bounded sample of
distinct candidates, as many of each generator and weak label (format rules) as there are, and run as one SQL
expression.

Base patterns are written so that Java's matcher stays linear: possessive runs, and starts only where a run
starts or the last match ended. Their matches are those of the plain patterns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Generators of further candidates.
KEYLIKE = r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{12,}+"
ASSIGNED = r"(?i)\b(?:api_?key|secret|password|passwd|pwd|token|access_?key)\b[\x20\"']*[=:][\x20\"']*[^\x20\x09-\x0D\"',;]{6,}"
NUMERIC = r"(?<![0-9(+])\(?[0-9]{2,4}[\x20().-]{1,2}[0-9]{2,4}(?:[\x20.-][0-9]{2,6}){1,3}(?![0-9.])"
#: Rows of weakly labelled candidates the trees are fitted on, at most.
SAMPLE = 4000
ROUNDS, RATE = 12, 0.5

SPAN = "array<struct<start:int,end:int,hit:string>>"


def hits(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start, end, hit), in code points. The gaps between matches and
    the matches alternate, so positions are running sums of their lengths."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, zero, step, lambda s: s["out"])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """The Luhn check of a string of digits."""
    signs = F.split(F.reverse(number), "")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    terms = F.transform(signs, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda s, x: s + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The checked spans of each base kind. Texts without the sign a kind needs skip its pattern."""
    none = F.array().cast(SPAN)
    number = F.lit(r"[0-9]")
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    size = lambda x: F.length(digits(x["hit"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), hits(text, EMAIL)).otherwise(none),
        "ip": F.when(F.regexp(text, F.lit(r"[0-9]\.[0-9]")), F.filter(hits(text, IP), lambda x: x["hit"].rlike(rf"^{part}\.{part}\.{part}\.{part}$"))).otherwise(none),
        "card": F.when(F.regexp(text, number), F.filter(F.filter(hits(text, CARD), lambda x: size(x).between(13, 19)), lambda x: luhn(digits(x["hit"])))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(hits(text, PHONE), lambda x: size(x).between(9, 15))).otherwise(none),
    }


def _count(x: Column, signs: str) -> Column:
    """Characters of x in a character class."""
    return F.length(x) - F.length(F.regexp_replace(x, f"[{signs}]", ""))


def features(hit: Column, before: Column) -> dict[str, Column]:
    """Format and context of a candidate; before: the 24 characters in front of it."""
    size = F.length(hit).cast("double")
    return {
        "size": size,
        "digit": _count(hit, "0-9") / size,
        "upper": _count(hit, "A-Z") / size,
        "lower": _count(hit, "a-z") / size,
        "mark": _count(hit, "^A-Za-z0-9") / size,
        "turns": F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")) / size,
        "named": F.when(F.concat(before, hit).rlike(r"(?i)(key|secret|passw|pwd|token|auth)"), 1.0).otherwise(0.0),
        "called": F.when(before.rlike(r"(?i)(tel|phone|mobile|fax|call|account|iban|ssn)"), 1.0).otherwise(0.0),
        "equals": F.when(F.concat(before, hit).rlike(r"[=:][\x20\"']*[A-Za-z0-9_/+-]+$"), 1.0).otherwise(0.0),
        "start": F.when(hit.rlike("^[A-Z]{4}"), 1.0).otherwise(0.0),
    }


FEATURES = ("size", "digit", "upper", "lower", "mark", "turns", "named", "called", "equals", "start")
#: Format rules that label candidates for fitting: fixed shapes of keys, assignments and national phone numbers.
SURE = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^(?:sk|pk|ghp|gho|xox[bp])[_-][A-Za-z0-9_-]{16,}$|(?i)^(?:api_?key|secret|password|passwd|pwd|token|access_?key)[\x20\"']*[=:][\x20\"']*[A-Za-z0-9_/+-]{8,}$|^(?=.*[0-9].*[0-9].*[0-9])(?=.*[a-f])[0-9a-f]{20,}$|^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"


def candidates(text: Column) -> Column:
    """Overlapping spans of all generators, with their kind, generator and the text in front."""
    none = F.array().cast(SPAN)

    def tag(spans: Column, kind: str, generator: int) -> Column:
        return F.transform(spans, lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.lit(kind).alias("kind"), F.lit(generator).alias("generator"),
            F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))).alias("before"),
        ))

    some = F.regexp(text, F.lit("[0-9]"))
    return F.concat(
        tag(F.when(some, hits(text, KEYLIKE)).otherwise(none), "secret", 0),
        tag(F.when(F.regexp(text, F.lit("[=:]")), hits(text, ASSIGNED)).otherwise(none), "secret", 1),
        tag(F.when(some, hits(text, NUMERIC)).otherwise(none), "contact", 2),
    )


def fit(rows: list[tuple], rounds: int = ROUNDS, rate: float = RATE) -> dict:
    """Gradient boosting with logistic loss on (features..., label): trees of one split and one in each half.

    Returns base, trees and the calibrated threshold: halfway between the highest negative score and the
    lowest positive one, or 0.5 where they overlap."""
    import numpy as np

    if not rows:
        return {"base": -9.0, "trees": [], "threshold": 0.5}
    data = np.array(rows, float)
    x, y = data[:, :-1], data[:, -1]
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    f, trees = np.full(len(y), base), []

    def split(rows_: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best = (1e-9, -1, 0.0)
        total = g[rows_].sum() ** 2 / (h[rows_].sum() + 1)
        for k in range(x.shape[1]):
            for cut_at in np.unique(np.quantile(x[rows_, k], np.linspace(0.02, 0.98, 25))):
                left = x[rows_, k] <= cut_at
                a, b = rows_[left], rows_[~left]
                if len(a) and len(b):
                    gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - total
                    if gain > best[0] + 1e-9:
                        best = (gain, k, float(cut_at))
        return best[1], best[2]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        every = np.arange(len(y))
        k, at = split(every, g, h)
        if k < 0:
            break
        node = []
        for half in (every[x[:, k] <= at], every[x[:, k] > at]):
            j, mid = split(half, g, h)
            parts = [half] if j < 0 else [half[x[half, j] <= mid], half[x[half, j] > mid]]
            leaves = [round(float(rate * g[r].sum() / (h[r].sum() + 1)), 9) for r in parts]
            for r, leaf in zip(parts, leaves, strict=True):
                f[r] += leaf
            node.append((j, mid, leaves))
        trees.append((k, at, node))
    p = 1 / (1 + np.exp(-f))
    low, high = p[y == 1].min() if y.any() else 1.0, p[y == 0].max() if (y == 0).any() else 0.0
    return {"base": base, "trees": trees, "threshold": float((low + high) / 2) if low > high else 0.5}


def score(model: dict, at: dict[str, Column]) -> Column:
    """The ensemble's probability as one expression over the features."""
    total: Column = F.lit(model["base"])
    for k, mid, node in model["trees"]:
        sides = []
        for j, m, leaves in node:
            sides.append(F.lit(leaves[0]) if j < 0 else F.when(at[FEATURES[j]] <= m, leaves[0]).otherwise(leaves[1]))
        total = total + F.when(at[FEATURES[k]] <= mid, sides[0]).otherwise(sides[1])
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` distinct candidates (hit and the text in front), those with the smallest hashes of
    each generator and weak label in turn, so that copies count once and no kind of candidate crowds out another."""
    found = docs.filter(F.regexp("text", F.lit("[0-9=:]"))).select(F.explode(candidates(F.col("text"))).alias("c"))
    drawn = found.groupBy(F.col("c.hit").alias("hit"), F.col("c.before").alias("before")).agg(F.min("c.generator").alias("generator"))
    label = F.col("hit").rlike(SURE) | (F.concat("before", "hit").rlike(r"(?i)(key|secret|passw|token)[a-z_]*[\x20\"']*[=:][\x20\"']*[A-Za-z0-9_/+-]{8,}$"))
    named = drawn.withColumns({"y": label.cast("int"), "h": F.xxhash64("hit", "before")})
    turn = F.row_number().over(Window.partitionBy("generator", "y").orderBy("h", "hit", "before"))
    rows = named.withColumn("turn", turn).filter(F.col("turn") <= sample).orderBy("turn", "generator", "y").limit(sample)
    made = features(F.col("hit"), F.col("before"))
    return fit([tuple(r) for r in rows.select(*[made[k].alias(k) for k in FEATURES], "y").collect()])


def _outside(spans: Column, others: list[Column]) -> Column:
    return F.filter(spans, lambda x: ~F.exists(F.concat(*others), lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"])))


def find(docs: DataFrame, model: dict | None = None, into: str = "spans") -> DataFrame:
    """docs with the column `into` (one of that name is replaced): one array of (start, end, hit) per base kind and for 'secret' and 'contact'.

    Null texts have no spans; every other column of docs is kept. Base spans are never changed; a span the
    trees add overlaps no base span, and of added spans that overlap one another the earliest, longest stays."""
    model = model or train(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("*", F.struct(*[v.alias(k) for k, v in base_spans(text).items()], candidates(text).alias("more")).alias("__pii_base"))
    base = [F.col(f"__pii_base.{k}") for k in BASE]
    chosen = F.filter(F.col("__pii_base.more"), lambda c: score(model, features(c["hit"], c["before"])) >= model["threshold"])
    plain = F.array_sort(F.transform(_outside(chosen, base), lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"), c["hit"].alias("hit"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string,kind:string>>").alias("out"))
    apart = F.aggregate(
        plain, zero,
        lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct((-x["back"]).alias("at"), F.array_append(s["out"], F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["hit"].alias("hit"), x["kind"].alias("kind"))).alias("out"))),
        lambda s: s["out"],
    )
    out = out.withColumn("__pii_added", apart)
    of = lambda kind: F.transform(F.filter("__pii_added", lambda x: x["kind"] == kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))
    return out.select(*[c for c in docs.columns if c != into], F.struct(*[F.col(f"__pii_base.{k}").alias(k) for k in BASE], of("secret").alias("secret"), of("contact").alias("contact")).alias(into))


def listed(spans: Column, kind: str) -> Column:
    return F.transform(spans[kind], lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, counts of base spans, base_sha256 and all spans as text."""
    s = F.col("spans")
    base = F.concat(*[listed(s, k) for k in BASE])
    return find(docs.select("doc_id", "text")).select(
        "doc_id", *[F.size(s[k]).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed(s, "secret"), listed(s, "contact")), ",").alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; overlapping spans merge into the
    first one's mark. Null texts stay null. Columns are those of docs."""
    found = find(docs, into="__pii_spans")

    def marked(kind: str) -> Column:
        return F.transform(F.col("__pii_spans")[kind], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"<{kind}>").alias("mark")))

    tagged = F.concat(*map(marked, (*BASE, "secret", "contact")))
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        apart = F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(gap, x["mark"])).alias("out"))
        return F.when(x["start"] >= s["at"], apart).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))

    clean = F.aggregate(F.array_sort(tagged), zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    cols = [F.when(F.size(tagged) == 0, text).otherwise(clean).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return found.select(*cols)
