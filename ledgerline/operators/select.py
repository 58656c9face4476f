"""Choosing one row or value among several: priorities, latest filings, nearest keys."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order: one shuffle by key, limited to one row a key before it."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def best_value(df: DataFrame, keys: list[str], value: Column, order: list[Column], name: str) -> DataFrame:
    """The value with the smallest (order...) of each key: an aggregate, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(name))


def canonical_values(facts: DataFrame, tag_map: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, value): of a field's tags the numeric one of lowest priority number, list order breaking ties.

    ``tag_map`` (field, tag, priority, ordinal) is a dictionary, joined by hash; whether it is broadcast is left to its
    measured size.
    """
    named = facts.where(F.col("value").isNotNull()).join(tag_map, "tag")
    return named.groupBy(*keys, "field").agg(F.min_by("value", F.struct("priority", "ordinal")).alias("value"))


def first_positive(facts: DataFrame, tags: list[str], keys: list[str], name: str) -> DataFrame:
    """The value of the first listed tag that is above 0; priorities do not count, a text that is no number is passed by."""
    order = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    return best_value(facts.where((order > 0) & (F.col("value") > 0)), keys, F.col("value"), [order, F.col("value")], name)


def current_values(facts: DataFrame, tag_map: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, value) as ``canonical_values``, from contexts of the current year alone and of the field's kind:
    Instant where the map's ``instant`` says so, else Duration."""
    kind = F.when(F.col("instant"), F.contains("context", F.lit("Instant"))).otherwise(F.contains("context", F.lit("Duration")))
    named = facts.where(F.col("value").isNotNull() & F.contains("context", F.lit("CurrentYear"))).join(tag_map, "tag").where(kind)
    return named.groupBy(*keys, "field").agg(F.min_by("value", F.struct("priority", "ordinal", "value")).alias("value"))


#: Orders in which namespaces and units are tried.
NAMESPACES, UNITS = ["us-gaap", "ifrs-full"], ["USD", "shares", "USD/shares", "pure"]


def concept_values(values: DataFrame, concepts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, value) of company facts (tag, namespace, unit, value): a field's tags in list order, of each the first
    namespace that has it, then the units in order. ``concepts`` is (field, tag, ordinal)."""
    place = lambda c, order: F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c))
    rows = values.where(F.col("value").isNotNull()).join(concepts, "tag").withColumns({"_n": place("namespace", NAMESPACES), "_u": place("unit", UNITS)}).where("_n > 0 AND _u > 0")
    return rows.groupBy(*keys, "field").agg(F.min_by("value", F.struct("ordinal", "_n", "_u", "value")).alias("value"))


def context_rank(context: Column, patterns: list[str], allow_parent_only: bool = False) -> Column:
    """Place of the first pattern that the context contains; null for prior, segment and parent-only contexts. Contexts
    that match no pattern come last."""
    out = F.lit(len(patterns))
    for k in range(len(patterns) - 1, -1, -1):
        out = F.when(context.contains(patterns[k]), k).otherwise(out)
    bad = context.startswith("Prior") | (context.endswith("Member") & ~context.contains("NonConsolidated"))
    if not allow_parent_only:
        bad = bad | context.contains("NonConsolidated")
    return F.when(~bad, out)


def first_wins(facts: DataFrame, doc: str, tag: str, order: list[Column]) -> DataFrame:
    """One fact for each document and tag: numbers before texts, then the given order."""
    return first_row(facts, [doc, tag], [F.col("value").isNull().cast("int"), *order])


def annual_value(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the full-year entry (10 to 14 months, an unknown length counting as 12) with the newest end, then the
    newest filing; if none is annual, the same order among the rest. Rows: end, filed, months, value."""
    months = F.coalesce(F.round(F.col("days") / 30), F.lit(12))
    rows = entries.withColumn("annual", months.between(10, 14))
    return first_row(rows, keys, [F.col("annual").desc(), F.col("end").desc(), F.col("filed").desc(), F.col("value")])


def shifted_lookup(wanted: DataFrame, store: DataFrame, key: str, year: str, value: str, offsets: list[int]) -> DataFrame:
    """Each wanted (key, year) with the store's value at the first offset that has one, and the offset."""
    shifts = F.explode(F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(o).alias("shift")) for k, o in enumerate(offsets)])).alias("s")
    tries = wanted.select(key, year, shifts).select(key, year, "s.nth", "s.shift", (F.col(year) + F.col("s.shift")).alias("_at"))
    found = tries.join(store.select(key, F.col(year).alias("_at"), value), [key, "_at"])
    best = found.groupBy(key, year).agg(F.min_by(F.struct(F.col("shift"), F.col(value)), "nth").alias("b"))
    return wanted.select(key, year).join(best, [key, year], "left").select(key, year, F.col("b.shift").alias("shift"), F.col(f"b.{value}").alias(value))


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize leaves kana and their voice marks apart.
    return pa.array([x and unicodedata.normalize("NFKC", x) for x in text.to_pylist()], pa.string())


def normalized_segment(text: Column) -> Column:
    """Segment names for matching: NFKC, lower case, without blanks, joining signs and the words for business, division
    and segment, taken out one after the other."""
    t = F.regexp_replace(F.lower(_nfkc(text)), r"(?U)\A\s+|\s+\z", "")
    for word in ("事業", "部門", "セグメント", "・", " ", "\u3000", "-", "&", ","):
        t = F.replace(t, F.lit(word))
    return F.regexp_replace(t, r"[ \t\-_/]+", "")


def longest_alias(texts: DataFrame, aliases: DataFrame, least: int = 3) -> DataFrame:
    """For each text (id, text and, if there is one, description) its alias (alias, category, level): the one that equals
    the text, else the longest contained in text and description, then the deepest, then by name; all as normalised.

    Of aliases that are normalised alike the deepest stands, then the first by name. An alias of ``least`` characters or
    more is contained only where its first ``least`` are: those are the join key, met by the texts' distinct grams of that
    length, and containment the residual test, so no text meets every alias. Shorter ones only match as equals.
    """
    about = F.concat_ws(" ", "text", "description") if "description" in texts.columns else F.col("text")
    t = texts.select("id", normalized_segment(F.col("text")).alias("name"), normalized_segment(about).alias("full"))
    index = aliases.withColumn("norm", normalized_segment(F.col("alias"))).where("length(norm) > 0").groupBy("norm")
    index = index.agg(F.min_by(F.struct("alias", "category", "level"), F.struct(-F.col("level"), "alias", "category")).alias("a")).select("norm", "a.*")
    equal = t.join(index, t["name"] == index["norm"]).select("id", F.lit(0).alias("way"), "norm", "alias", "category", "level")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("full") - least + 1), lambda k: F.substring("full", k, F.lit(least))))
    keyed = t.where(F.length("full") >= least).select("id", "full", F.explode(grams).alias("gram"))
    starts = index.where(F.length("norm") >= least).withColumn("gram", F.substring("norm", 1, least))
    inside = keyed.join(starts, "gram").where(F.contains("full", F.col("norm"))).select("id", F.lit(1).alias("way"), "norm", "alias", "category", "level")
    order = F.struct("way", -F.length("norm"), -F.col("level"), "alias")
    return equal.unionByName(inside).groupBy("id").agg(F.min_by(F.struct("alias", "category"), order).alias("m")).select("id", "m.alias", "m.category")
