"""Exact two-sided test of a 2x2 table, and the difference it could have seen."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two tables are equally extreme within this much probability.
TIE = 1e-12
# Tables farther from the mean than this many deviations and this many counts are
# likelier than exp(-700) of nothing: by Bernstein's bound they add nothing to a double.
DEVIATIONS, COUNTS = 40, 60


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher exact p of the table a, b / c, d, with built-in functions only.

    Probabilities are taken relative to the likeliest table of the same margins,
    stepping outward from it on either side by the ratio of neighbours: first for
    their total and the observed table's own, then for those no likelier than the
    observed. Steps stay within DEVIATIONS of the mean, so work grows with the
    root of the population.
    """
    drawn, rest, made = a + b, c + d, a + c
    n = drawn + rest
    mean = made * drawn / n
    spread = DEVIATIONS * F.sqrt(mean * (1 - drawn / n) * (1 - made / n) * n / F.greatest(n - 1, F.lit(1))) + COUNTS
    low, high = F.greatest(F.lit(0), made - rest), F.least(drawn, made)
    start = F.greatest(low, F.floor(mean - spread)).cast("long")
    stop = F.least(high, F.ceil(mean + spread)).cast("long")
    top = F.greatest(low, F.least(high, F.floor((drawn + 1) * (made + 1) / (n + 2)))).cast("long")
    shape = F.struct(a.cast("double").alias("a"), drawn.cast("double").alias("drawn"), made.cast("double").alias("made"),
                     (rest - made).cast("double").alias("gap"), (a == top).alias("at_top"),
                     _range(top, stop, 1).alias("up"), _range(top, start, -1).alias("down"))
    # One-element arrays bind what several later expressions read.
    walked = F.transform(F.array(shape), lambda t: F.struct(t.alias("t"), _walk(t, None, True).alias("u"), _walk(t, None, False).alias("d")))

    def totals(s: Column) -> Column:
        total = 1 + s["u"]["sum"] + s["d"]["sum"]
        own = F.when(s["t"]["at_top"], 1.0).otherwise(s["u"]["own"] + s["d"]["own"])
        return F.struct(s["t"].alias("t"), total.alias("total"), (own + TIE * total).alias("limit"))

    def tail(s: Column) -> Column:
        middle = F.when(s["limit"] >= 1, 1.0).otherwise(0.0)
        return (middle + _walk(s["t"], s["limit"], True)["sum"] + _walk(s["t"], s["limit"], False)["sum"]) / s["total"]

    p = F.transform(F.transform(walked, totals), tail)
    empty = F.least(drawn, rest, made, n - made) == 0
    return F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), F.element_at(p, 1)))


def _range(at: Column, end: Column, step: int) -> Column:
    beyond = end > at if step > 0 else end < at
    return F.when(beyond, F.sequence(at + step, end, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))


def _walk(t: Column, limit: Column | None, up: bool) -> Column:
    """On one side of the likeliest table: the sum of relative probabilities, of
    those within the limit if one is given, and the observed table's own."""
    zero = F.lit(0.0)
    start = F.struct(F.lit(1.0).alias("term"), zero.alias("sum"), zero.alias("own"), (zero if limit is None else limit).alias("limit"))

    def step(s: Column, k: Column) -> Column:
        k = k.cast("double")
        if up:
            ratio = (t["drawn"] - k + 1) * (t["made"] - k + 1) / (k * (t["gap"] + k))
        else:
            ratio = (k + 1) * (t["gap"] + k + 1) / ((t["drawn"] - k) * (t["made"] - k))
        term = s["term"] * ratio
        counted = term if limit is None else F.when(term <= s["limit"], term).otherwise(0.0)
        own = F.when(k == t["a"], term).otherwise(s["own"])
        return F.struct(term.alias("term"), (s["sum"] + counted).alias("sum"), own.alias("own"), s["limit"].alias("limit"))

    return F.aggregate(t["up"] if up else t["down"], start, step)


def detection_floor(rate: Column, with_arm: Column, without_arm: Column, power_z: float) -> Column:
    """The smallest difference in rate two arms of these sizes would have shown."""
    noise = rate * (1 - rate) * (F.try_divide(F.lit(1), with_arm) + F.try_divide(F.lit(1), without_arm))
    return power_z * F.sqrt(noise)
