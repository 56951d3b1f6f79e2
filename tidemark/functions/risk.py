"""Scalar risk functions as column expressions."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country sets, thresholds, score bounds.
BLACKLIST = ["IR", "KP", "SY"]
HIGH_RISK = ["MM", "RU", "VE", "AF", "PK", "LA", "TZ", "YE"]
MEDIUM_RISK = ["KY", "VG", "PA", "CH", "MX", "TR", "UA", "TH"]
HIGH_RISK_DESTINATIONS = ["IR", "KP", "SY", "MM", "RU", "VE", "AF", "PK"]
TAX_HAVENS = ["KY", "VG", "PA", "CH"]
ALLOW_MAX, CHALLENGE_MAX, SCORE_MAX = 399, 699, 999


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it does not or is unknown."""
    return F.when(condition, 1.0).otherwise(0.0)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def total(x: Column) -> Column:
    """Sum that is 0 over no rows."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a over b, with b taken as 1 at least."""
    return a / F.greatest(b, F.lit(1.0))


def capped(x: Column, most: float) -> Column:
    return F.least(x, F.lit(float(most))) / most


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def country_risk(code: Column) -> Column:
    """3 for a blacklisted country, 2 high, 1 medium, 0 for all others and unknown."""
    return F.when(code.isin(BLACKLIST), 3).when(code.isin(HIGH_RISK), 2).when(code.isin(MEDIUM_RISK), 1).otherwise(0)


def tier_score(tier: Column) -> Column:
    return F.when(tier == "CRITICAL", 3).when(tier == "HIGH", 2).when(tier == "MEDIUM", 1).otherwise(0)


def outcome(score: Column) -> Column:
    return F.when(score <= ALLOW_MAX, "ALLOW").when(score <= CHALLENGE_MAX, "CHALLENGE").otherwise("DECLINE")


# ln 2 as a part whose multiples are exact and the rest; e to multiples of 1/64 as the nearest double and the rest.
LN_2 = (6.93147180369123816490e-01, 1.90821492927058770002e-10)
STEPS = range(-23, 24)
POWERS = [(float(p), float(p - Decimal(float(p)))) for p in ((Decimal(n) / 64).exp() for n in STEPS)]


def exp_nearest(x: Column) -> Column:
    """e to the x, for x from -700 to 700, to the nearest double; F.exp is one beside it now and then, which shows where scores are halves."""
    twos = F.rint(x / math.log(2))
    near = x - twos * LN_2[0]
    step = F.rint(near * 64)
    at = step.cast("int") - STEPS[0] + 1
    high, low = (F.element_at(F.array(*(F.lit(p[k]) for p in POWERS)), at) for k in (0, 1))
    return F.pow(F.lit(2.0), twos) * (high + (high * F.expm1(near - step / 64 - twos * LN_2[1]) + low))


def sigmoid(x: Column, most: float = 1) -> Column:
    """From 0 to `most`, divided once, as a product of the probability can fall beside a half."""
    return most / (1 + exp_nearest(-x))


def score_of(probability: Column) -> Column:
    """0 to 999, halves to even."""
    return score_of_points(probability * SCORE_MAX)


def score_of_points(points: Column) -> Column:
    return F.least(F.greatest(half_even(points), F.lit(0.0)), F.lit(float(SCORE_MAX))).cast("int")


def confidence(probability: Column) -> Column:
    return half_even(F.least(F.lit(1.0), F.abs(probability - 0.5) * 2 + 0.5), 4)


def whole_days(since: Column, now: Column) -> Column:
    """Days passed, rounded down."""
    return F.timestamp_diff("DAY", since, now)


def fits_band(amount: Column) -> Column:
    """Just under the reporting threshold, as queries take it."""
    return (amount >= 9000) & (amount < 10000)


def named(*pairs: tuple[str, Column]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs)))


def truthy(text: Column) -> Column:
    """Whether a text says yes: true, 1, yes or y, whatever the case and blanks around."""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes", "y"), F.lit(False))


def filled(text: Column, default: str | None) -> Column:
    """default for null and blank texts."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def parsed_number(text: Column) -> Column:
    """The number, 0 where the text is none."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def alert_level(psi: Column) -> Column:
    return F.when(psi < 0.10, "OK").when(psi < 0.20, "WARNING").otherwise("CRITICAL")


def explanation(result: Column, score: Column, factors: Column) -> Column:
    """A sentence on an outcome, with the first three factors."""
    top = F.array_join(F.slice(factors, 1, 3), ", ")
    why = F.when(F.size(factors) > 0, top).otherwise("no single factor")
    return (
        F.when(result == "ALLOW", F.format_string("Let through at %d of 999.", score))
        .when(result == "CHALLENGE", F.format_string("Held for a question at %d of 999, because of %s.", score, why))
        .otherwise(F.format_string("Refused at %d of 999, because of %s.", score, why))
    )


def challenge(amount: Column, currency: Column, number: Column) -> Column:
    """A question to the payer, one of three by number; amounts with two places and commas between thousands."""
    money = F.concat_ws(" ", F.coalesce(currency, F.lit("USD")), F.format_string("%,.2f", half_even(F.coalesce(amount, F.lit(0.0)), 2)))
    texts = [F.concat(F.lit(a), money, F.lit(b)) for a, b in (("Did you yourself send ", "?"), ("Who is to receive ", "?"), ("What are the ", " for?"))]
    return F.element_at(F.array(*texts), F.pmod(number, F.lit(len(texts))).cast("int") + 1)


def payer_question(amount: Column, currency: Column, payee: Column, number: Column) -> Column:
    """A question to the payer, one of seven by number, with the payee's name in title case; a missing name is `the payee`."""
    money = F.concat_ws(" ", F.coalesce(currency, F.lit("USD")), F.format_string("%,.2f", half_even(F.coalesce(amount, F.lit(0.0)), 2)))
    name = F.coalesce(F.initcap(F.nullif(F.trim(payee), F.lit(""))), F.lit("the payee"))
    texts = [
        F.lit("Which code did we just send to your phone?"), F.lit("Which code did we just send to your mail address?"), F.lit("What are the last four digits of your phone number?"), F.concat(F.lit("What are the "), money, F.lit(" meant for?")),
        F.concat(F.lit("Do you want "), name, F.lit(" to receive "), money, F.lit("?")), F.concat(F.lit("In whose name is the account that receives "), money, F.lit("?")), F.concat(F.lit("Where do the "), money, F.lit(" come from?")),
    ]
    return F.element_at(F.array(*texts), F.pmod(number, F.lit(len(texts))).cast("int") + 1)


def answered(answer: Column, status: Column) -> Column:
    """Status after an answer to a challenge: COMPLETED for the agreed word whatever its case and the blanks around, else as before."""
    return F.when(F.upper(F.trim(answer)) == "TEST", "COMPLETED").otherwise(status)


def band(score: Column) -> Column:
    """Label of a score, which is taken between 0 and 100."""
    x = F.least(F.lit(100.0), F.greatest(F.lit(0.0), score.cast("double")))
    return F.when(x >= 70, "HIGH").when(x >= 40, "MEDIUM").otherwise("LOW")


def distance_words(a: Column, b: Column) -> Column:
    """How far two scores from 0 to 999 are apart, in a word."""
    d = F.abs(a - b)
    return F.when(d > 200, "far").when(d > 100, "apart").otherwise("close")


def contributions(scores: list[tuple[str, Column, float]]) -> tuple[Column, Column]:
    """(name, score, weight in per cent) as weighted points, halves rounded up, and the name with the most, the first of equals."""
    points = F.array(*(F.floor(s * w / 100 + 0.5).cast("long") for _, s, w in scores))
    best = F.array_max(F.array(*(F.struct((s * w).cast("double").alias("x"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (n, s, w) in enumerate(scores))))["n"]
    return points, best


def bounded(name: str, value: float, low: float, high: float) -> float:
    """value, if it lies between low and high."""
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not be {value}")
    return value


def pages(n: Column, size: int) -> Column:
    """Pages of `size` rows, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(n / bounded("size", size, 1, 1000)).cast("long"))
