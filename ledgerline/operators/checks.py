"""Accounting checks, repairs and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import gap, present


def check(expected: Column, actual: Column, percent: float = 0.01, absolute: float = 1e6) -> Column:
    """Struct passed, difference, difference_pct, severity of one equation.

    A missing side passes. Against an expected 0 the actual must be under 1000. Else it passes below ``percent`` per cent
    or below ``absolute``; failures up to 1 per cent are warnings.
    """
    diff = F.abs(actual - expected)
    pct = diff / present(F.abs(expected)) * 100
    missing = expected.isNull() | actual.isNull()
    passed = F.when(missing, True).when(expected == 0, F.abs(actual) < 1000).otherwise((pct < percent) | (diff < absolute))
    severity = F.when(passed, "ok").when(pct <= 1, "warning").otherwise("error")
    return F.struct(passed.alias("passed"), diff.alias("difference"), pct.alias("difference_pct"), severity.alias("severity"))


def within(expected: Column, actual: Column, tolerance: float) -> Column:
    """Whether two figures agree within a share of the expected one; missing figures agree."""
    return F.coalesce(F.abs(actual - expected) <= tolerance * F.abs(expected), F.lit(True))


#: Statement equations: name -> (sum of columns, its total, tolerance).
EQUATIONS = {
    "balance": (["total_liabilities", "total_equity"], "total_assets", 0.03),
    "assets": (["current_assets", "noncurrent_assets"], "total_assets", 0.001),
    "liabilities": (["current_liabilities", "noncurrent_liabilities"], "total_liabilities", 0.005),
    "gross_profit": (["revenue", "-cost_of_sales"], "gross_profit", 0.01),
    "ordinary": (["operating_income", "non_operating"], "ordinary_income", 0.15),
}


def statement_checks(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a statement and equation: keys, check_name, expected, actual, passed. An equation with a column absent is
    left out; with a value missing it passes."""
    have, rows = set(df.columns), []
    for name, (parts, total, tolerance) in EQUATIONS.items():
        if {p.lstrip("-") for p in parts} | {total} <= have:
            left = sum((-F.col(p[1:]) if p[0] == "-" else F.col(p) for p in parts[1:]), F.col(parts[0]))
            rows.append(F.struct(F.lit(name).alias("check_name"), F.col(total).cast("double").alias("expected"), left.cast("double").alias("actual"), within(F.col(total), left, tolerance).alias("passed")))
    return df.select(*keys, F.inline(F.array(*rows)))


def score(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Passed checks per hundred."""
    return checks.groupBy(*keys).agg(F.coalesce(F.avg(F.col("passed").cast("double")) * 100, F.lit(100.0)).alias("score"), F.count("*").alias("checks"))


def repair_candidates(needed: DataFrame, values: DataFrame, key: str, tolerance: float = 1e-4) -> DataFrame:
    """For each (key, needed) the value of the same key nearest to it within ``tolerance`` of its size; null without.

    A join on the key with the band as residual: it costs the key's own rows, never all pairs.
    """
    near = needed.join(values, key).where(F.abs(F.col("value") - F.col("needed")) <= tolerance * F.abs("needed"))
    best = near.groupBy(key, "needed").agg(F.min_by("value", F.struct(F.abs(F.col("value") - F.col("needed")), "value")).alias("found"))
    return needed.join(best, [key, "needed"], "left")


def repair_sum(total: Column, first: Column, second: Column, alternatives: Column, least_gap: float = 1000.0) -> Column:
    """Struct total, first, second after one repair of total = first + second: the total is replaced if an alternative
    equals the sum, else the first addend, else the second, by one that closes the gap; gaps under ``least_gap`` stay."""
    def pick(want: Column) -> Column:
        return F.get(F.filter(alternatives, lambda v: F.abs(v - want) <= 1e-4 * F.abs(want)), F.lit(0))

    off = F.abs(total - first - second) >= least_gap
    t, a, b = pick(first + second), pick(total - second), pick(total - first)
    return F.struct(
        F.when(off & t.isNotNull(), t).otherwise(total).alias("total"),
        F.when(off & t.isNull() & a.isNotNull(), a).otherwise(first).alias("first"),
        F.when(off & t.isNull() & a.isNull() & b.isNotNull(), b).otherwise(second).alias("second"),
    )


def compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of (keys, value): exact to 0.01 per cent, close to 5, mismatch, or one side only."""
    both = left.withColumnRenamed("value", "a").join(right.withColumnRenamed("value", "b"), keys, "full_outer")
    d = gap(F.col("a"), F.col("b"))
    status = F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").when(d <= 1e-4, "exact").when(d <= 0.05, "close").otherwise("mismatch")
    return both.withColumn("status", status)


def unit_fix(total: Column, parts: Column, factors: tuple = (10.0, 100.0, 0.1, 0.01)) -> Column:
    """The factor that brings a sum of parts near its total: 1 if it is within half, else the first of ``factors`` that
    leaves under 0.3, else null."""
    off = lambda f: F.abs(parts * f - total) / present(F.abs(total))
    out = F.when(off(1.0) <= 0.5, 1.0)
    for f in factors:
        out = out.when(off(f) < 0.3, f)
    return out


def range_status(value: Column, low: Column, high: Column, warn_low: Column, warn_high: Column) -> Column:
    """MISSING, ERROR outside the hard range, WARNING outside the usual one, else VALID."""
    return F.when(value.isNull(), "MISSING").when((value < low) | (value > high), "ERROR").when((value < warn_low) | (value > warn_high), "WARNING").otherwise("VALID")


def yoy_status(value: Column, prev: Column) -> Column:
    """Whether a figure moved more than fivefold."""
    r = value / present(prev)
    return F.when(value.isNull() | prev.isNull(), "MISSING").when(prev == 0, F.when(value == 0, "VALID").otherwise("WARNING")).when((r > 5) | (r < 0.2), "WARNING").otherwise("VALID")
