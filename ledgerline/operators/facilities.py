"""Land of companies: which rows are not believed, what land is worth, and a company's totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import dispersion_level, exact, first_case, present

#: Why a row (address, office, area in square metres, book in millions, price a square metre) is not believed, in
#: order; ``per`` is its book value a square metre.
OUTLIERS = [
    ("address_ambiguous", "address rlike '他|ほか|各地|全国'"),
    ("annotation_marked", "office rlike '[(（]注[)）]'"),
    ("area_too_large", "area >= 1e7"),
    ("leased_land", "coalesce(book, 0) = 0 and area > 100"),
    ("urban_area_implausible", "price > 3e6 and area > 1e5"),
    ("head_office_aggregate", "office rlike '本社|本店' and area > 5e5"),
    ("head_office_aggregate_urban", "office rlike '本社|本店' and area > 3e4 and price > 5e5"),
    ("book_too_low", "per < 500"),
    ("book_too_high", "per > 1e8"),
    ("book_against_price", "per > price * 10"),
    ("area_too_small", "area > 0 and area < 50 and book > 100"),
]


def with_outliers(rows: DataFrame) -> DataFrame:
    """``rows`` with ``reason``, the first that holds; null for a row that is believed."""
    per = F.when((F.col("area") > 0) & (F.col("book") > 0), F.col("book") * 1e6 / F.col("area"))
    return rows.withColumn("per", per).withColumn("reason", first_case([(F.coalesce(F.expr(test), F.lit(False)), name) for name, test in OUTLIERS])).drop("per")


def bounded_value(value: Column, book: Column, special_cap: Column, retail_cap: Column, premium: Column, floor: float = 1.2) -> Column:
    """A market value under its industry's multiples of the book value (null: no cap), then, where premium land would be
    worth less than its book value, ``floor`` times that. Without a book value it stays."""
    capped = F.least(value, F.coalesce(book * special_cap, value), F.coalesce(book * retail_cap, value))
    raised = F.when(F.coalesce(premium, F.lit(False)) & (capped < book), book * floor).otherwise(capped)
    return F.when(book > 0, raised).otherwise(value)


def land_totals(rows: DataFrame, key: str) -> DataFrame:
    """Per company, from rows (book, market, low, high, dispersion, reason): facilities, priced and excluded ones, sums over
    the priced ones, those of high dispersion apart, counts by level, and the share that is priced."""
    priced = F.col("reason").isNull() & F.col("market").isNotNull()
    level = dispersion_level(F.col("dispersion"))
    total = lambda c, test: F.sum(F.when(test, exact(F.col(c)))).cast("double")
    sums = [total(c, priced).alias(c) for c in ("book", "market", "low", "high")] + [total("market", priced & (level == "high")).alias("market_high")]
    counts = [F.count_if(priced & (level == x)).alias(f"level_{x}") for x in ("low", "medium", "high", "unknown")]
    out = rows.groupBy(key).agg(F.count("*").alias("facilities"), F.count_if(priced).alias("priced"), F.count_if(F.col("reason").isNotNull()).alias("excluded"), *sums, *counts)
    return out.withColumns({"gain": F.col("market") - F.col("book"), "coverage": F.col("priced") / F.col("facilities")})


def merged_prices(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two sets of aggregates (keys, n, mean, median, low, high, p25, p75) as one: counts add up, means weigh by them, and
    median and quartiles are the newer side's where it has any; ``newer`` is its count."""
    sides = [df.select(*keys, F.struct("n", "mean", "median", "low", "high", "p25", "p75").alias(x)) for x, df in (("o", old), ("w", new))]
    both = sides[0].join(sides[1], keys, "full_outer")
    n = F.coalesce("o.n", F.lit(0)) + F.coalesce("w.n", F.lit(0))
    mean = (F.coalesce(F.col("o.mean") * F.col("o.n"), F.lit(0.0)) + F.coalesce(F.col("w.mean") * F.col("w.n"), F.lit(0.0))) / present(n.cast("double"))
    later = lambda c: F.coalesce(f"w.{c}", f"o.{c}").alias(c)
    return both.select(*keys, n.alias("n"), mean.alias("mean"), later("median"), F.least("o.low", "w.low").alias("low"), F.greatest("o.high", "w.high").alias("high"), later("p25"), later("p75"), F.coalesce("w.n", F.lit(0).cast("long")).alias("newer"))


def rebuilt_total(merged: DataFrame, key: str) -> DataFrame:
    """Statistics over a place's categories, each mean standing as often as it has prices."""
    at = lambda p: F.percentile("mean", p, F.col("n"))
    return merged.groupBy(key).agg(F.sum("n").alias("n"), at(0.5).alias("median"), at(0.25).alias("p25"), at(0.75).alias("p75"), F.min("mean").alias("low"), F.max("mean").alias("high"))
