"""Selections of filings, companies and targets, and the figures that come from several tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import present, ticker


def normalized_name(name: Column) -> Column:
    """Company names for matching: case, blanks and legal forms go."""
    return F.regexp_replace(F.lower(name), r"株式会社|\(株\)|（株）|[\s・,.]|\b(inc|corp|co|ltd)\b", "")


def name_matches(filings: DataFrame, names: DataFrame, gram: int = 2) -> DataFrame:
    """Filings (name) whose normalised name contains a wanted name or is contained in one.

    One of two strings that contain each other begins with, or holds, the shorter one's first ``gram`` characters: those
    are the join key, so filings meet only names that share them.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - gram + 1, F.lit(1))), lambda k: F.substring(c, k, F.lit(gram))))
    f = filings.withColumn("_f", normalized_name(F.col("name"))).where("length(_f) > 0")
    n = names.select(normalized_name(F.col("name")).alias("_n")).where("length(_n) > 0").distinct()
    inside = f.withColumn("_g", F.explode(grams(F.col("_f")))).join(n.withColumn("_g", F.substring("_n", 1, gram)), "_g").where(F.contains("_f", F.col("_n")))
    around = f.withColumn("_g", F.substring("_f", 1, gram)).join(n.withColumn("_g", F.explode(grams(F.col("_n")))), "_g").where(F.contains("_n", F.col("_f")))
    return inside.unionByName(around).select(*filings.columns).distinct()


def listed(codes: DataFrame, market: str = "上場") -> DataFrame:
    """Tickers of rows whose market text says they are listed: normalised, without blanks or repeats, in order."""
    return codes.where(F.col("market").contains(market)).select(ticker(F.col("code")).alias("ticker")).where("ticker IS NOT NULL").distinct().orderBy("ticker")


def land_deals(deals: DataFrame) -> DataFrame:
    """Deals in building land with a unit price over 0 and up to 1e8."""
    price = F.regexp_replace("unit_price", ",", "").try_cast("double")
    return deals.where(F.col("kind").contains("宅地")).withColumn("unit_price", price).where((F.col("unit_price") > 0) & (F.col("unit_price") <= 1e8))


def patch_targets(rows: DataFrame, documents: DataFrame, field: str, least_revenue: float) -> DataFrame:
    """Rows (code, fy, revenue, field) that lack the field, are large enough, and have a document of the year or one
    beside it."""
    years = documents.select("code", F.explode(F.array(F.col("fy") - 1, F.col("fy"), F.col("fy") + 1)).alias("fy")).distinct()
    return rows.where(F.col("fy").isNotNull() & F.col(field).isNull() & (F.col("revenue") >= least_revenue)).join(years, ["code", "fy"], "left_semi")


def first_known(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key the first value that is not null, over repeated folders or sources."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def benchmark_gap(estimates: DataFrame, benchmark: DataFrame, key: str, value: str) -> DataFrame:
    """Estimates beside a benchmark's figures, with the gap in per cent of the latter."""
    both = estimates.select(key, value).join(benchmark.select(key, F.col(value).alias("reference")), key)
    return both.withColumn("gap", (F.col(value) - F.col("reference")) / present(F.abs("reference")) * 100)


def already_stored(incoming: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming documents that some slot of the store (annual or quarterly) holds under the same document id."""
    return incoming.join(store.select(*keys, "doc_id").distinct(), [*keys, "doc_id"], "left_semi")


def learned_tags(store: DataFrame, found: DataFrame) -> DataFrame:
    """The store of (field, tag, companies) after new sightings (field, tag, company): companies are added up as sets."""
    new = found.groupBy("field", "tag").agg(F.collect_set("company").alias("_new"))
    out = store.join(new, ["field", "tag"], "full_outer")
    empty = F.array().cast("array<string>")
    return out.select("field", "tag", F.array_sort(F.array_union(F.coalesce("companies", empty), F.coalesce("_new", empty))).alias("companies"))


def facility_summary(rows: DataFrame, group: str) -> DataFrame:
    """Facilities by group: companies, rows, rows with an area, and area and book value at home only."""
    home = F.col("country") == "JP"
    return rows.groupBy(group).agg(F.countDistinct("code").alias("companies"), F.count("*").alias("rows"), F.count_if(F.col("area") > 0).alias("with_area"), F.sum(F.when(home, F.col("area"))).alias("area"), F.sum(F.when(home, F.col("book_value"))).alias("book_value"))
