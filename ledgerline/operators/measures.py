"""Growth, trends, and market shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import exact, present

def yoy(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Growth on the year before, in per cent of its magnitude; null where that year is missing."""
    w = Window.partitionBy(key).orderBy(year)
    before = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(value).over(w))
    return df.withColumn("prev", before).withColumn("yoy", (F.col(value) - F.col("prev")) / present(F.abs("prev")) * 100)


def cagr(df: DataFrame, key: str, year: str, value: str, span: int) -> DataFrame:
    """Compound growth to the last year from the nearest year at least ``span`` years before, else the first year."""
    ends = df.groupBy(key).agg(F.max(year).alias("y1"), F.max_by(value, year).alias("v1"), F.min(year).alias("y_first"), F.min_by(value, year).alias("v_first"))
    far = df.join(ends.select(key, "y1"), key).where(F.col(year) <= F.col("y1") - span).groupBy(key).agg(F.max(year).alias("y_far"), F.max_by(value, year).alias("v_far"))
    out = ends.join(far, key, "left").withColumns({"y0": F.coalesce("y_far", "y_first"), "v0": F.when(F.col("y_far").isNotNull(), F.col("v_far")).otherwise(F.col("v_first"))})
    grow = (F.pow(F.col("v1") / F.col("v0"), 1 / (F.col("y1") - F.col("y0"))) - 1) * 100
    return out.select(key, "y0", "y1", F.when((F.col("y1") > F.col("y0")) & (F.col("v0") > 0) & (F.col("v1") > 0), grow).alias("cagr"))


def trend_map(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Year -> value, in order of years, with the latest year and the number of years."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(year).alias("y"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.map_from_entries(pairs).alias("trend"), F.max(year).alias("latest"), F.count("*").alias("years"))


def shares(df: DataFrame, category: str, company: str, value: str, top: int = 5) -> DataFrame:
    """Each company's share in its category (0 where the category's total is not positive), and the place of the first
    ``top`` (null beyond). Totals are sums that combine before the shuffle, and only the first rows of each partition's
    part of a category are ranked, so no category is gathered in one task."""
    total = df.groupBy(category).agg(F.sum(exact(F.col(value))).cast("double").alias("_t"))
    out = df.join(total, category).withColumn("share", F.when(F.col("_t") > 0, F.col(value) / F.col("_t")).otherwise(0.0)).drop("_t")
    w = Window.partitionBy(category).orderBy(F.desc(value), company)
    first = df.select(category, company, value).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    return out.join(first.select(category, company, "place"), [category, company], "left")


def concentration(shared: DataFrame, category: str, value: str) -> DataFrame:
    """Total, companies, Herfindahl index (0 to 10000) and the shares of the first one, three and five."""
    fixed = lambda x: x.cast("decimal(18,12)")  # noqa: E731  sums that do not depend on the order of rows
    top = lambda n: F.sum(fixed(F.when(F.col("place") <= n, F.col("share")).otherwise(0.0))).cast("double")
    return shared.groupBy(category).agg(F.sum(exact(F.col(value))).cast("double").alias("total"), F.count("*").alias("companies"), (F.sum(fixed(F.col("share") * F.col("share"))).cast("double") * 10000).alias("hhi"), top(1).alias("top1"), top(3).alias("top3"), top(5).alias("top5"))


def matrix(df: DataFrame, company: str, category: str, value: str) -> DataFrame:
    """Each company's sums by category, as a map in order of categories."""
    cells = df.groupBy(company, category).agg(F.sum(value).alias("_v"))
    return cells.groupBy(company).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(category, "_v")))).alias("matrix"))
