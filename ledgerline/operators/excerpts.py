"""Figures and passages out of report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import first_case, parse_number


def excerpts(docs: DataFrame, patterns: list[str], before: int = 100, after: int = 300, apart: int = 300, budget: int = 3000) -> DataFrame:
    """doc_id, nth, start, excerpt: stretches round the matches of ordered patterns. Matches are taken pattern by pattern
    and in the text's order within one; a match closer than ``apart`` to one already taken, on either side, is left out,
    and a document's excerpts stay within ``budget`` characters."""
    found = [F.transform(_positions(F.col("text"), p, F.split("text", p)), lambda s, k=k: F.struct(F.lit(k).alias("rank"), s.alias("start"))) for k, p in enumerate(patterns)]
    empty = F.array().cast("array<struct<rank:int,start:int>>")
    take = lambda done, m: F.when(F.exists(done, lambda t: F.abs(t["start"] - m["start"]) < apart), done).otherwise(F.array_append(done, m))
    taken = F.aggregate(F.concat(*found), empty, take)
    cut = docs.select("doc_id", "text", F.posexplode(taken).alias("pos", "m")).select("doc_id", (F.col("pos") + 1).alias("nth"), F.col("m.start").alias("start"), F.substring(F.col("text"), F.greatest(F.col("m.start") - before, F.lit(0)) + 1, F.lit(before + after)).alias("excerpt"))
    spent = F.sum(F.length("excerpt")).over(Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("spent", spent).where(F.col("spent") <= budget).drop("spent")


def _positions(text: Column, pattern: str, pieces: Column) -> Column:
    """Where each match begins: the lengths of the pieces and matches before it, added up."""
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    return F.transform(matches, lambda m, i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(matches, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)))


def rental_values(text: Column) -> Column:
    """Struct book, fair of rental property: the first of ordered patterns that has both figures."""
    number = r"([△▲\d,]+)"
    patterns = [rf"貸借対照表計上額.{{0,40}}?{number}.{{0,80}}?時価.{{0,40}}?{number}", rf"計上額\s*{number}\s*百万円.{{0,60}}?時価\s*(?:は)?\s*{number}", rf"期末残高\s*{number}.{{0,60}}?期末時価\s*{number}"]
    pick = lambda p, g: parse_number(F.nullif(F.regexp_extract(text, p, g), F.lit("")))
    both = [F.when(pick(p, 1).isNotNull() & pick(p, 2).isNotNull(), F.struct(pick(p, 1).alias("book"), pick(p, 2).alias("fair"))) for p in patterns]
    return F.coalesce(*both)


def rejoined_number(cell: Column) -> Column:
    """A figure that a line break cut: short digit groups on lines of their own join the line before."""
    return parse_number(F.split_part(F.regexp_replace(F.trim(cell), r"(?<=[\d,])\n(?=\d{1,3}(\n|$))", ""), F.lit("\n"), F.lit(1)))


def single_segment(pages: DataFrame, phrases: list[str], first_pages: int = 10) -> DataFrame:
    """doc_id and whether one of the phrases, blanks aside, stands on its first pages."""
    plain = F.regexp_replace("text", r"\s", "")
    hit = F.lit(False)
    for p in phrases:
        hit = hit | plain.contains(p)
    return pages.groupBy("doc_id").agg(F.coalesce(F.bool_or(hit & (F.col("page") <= first_pages)), F.lit(False)).alias("single"))


def office_and_address(text: Column) -> tuple[Column, Column]:
    """Office and the address in trailing parentheses; all of it is the office without any."""
    address = F.nullif(F.regexp_extract(text, r"[(（]([^()（）]+)[)）]\s*$", 1), F.lit(""))
    return F.trim(F.regexp_replace(text, r"[(（][^()（）]+[)）]\s*$", "")), address


def strided_sum(cells: Column, first: int, step: int) -> Column:
    """Sum of every ``step``-th cell from ``first`` (0-based), as figures; null without one."""
    picked = F.filter(F.transform(F.filter(cells, lambda x, i: (i >= first) & ((i - first) % step == 0)), parse_number), lambda x: x.isNotNull())
    return F.when(F.size(picked) > 0, F.aggregate(picked, F.lit(0.0), lambda s, x: s + x))


def use_category(text: Column) -> Column:
    """Land use by words, in order."""
    has = lambda *words: text.rlike("|".join(words))
    return first_case([(has("工業", "工場", "industrial"), "industrial"), (has("商業", "店舗", "commercial"), "commercial"), (has("住居", "住宅", "residential"), "residential")], "other")


def log_issues(ghost: Column, name: Column, segments: Column, deviation: Column) -> Column:
    """All issues of an extraction log row, in order."""
    return F.array_compact(F.array(F.when(ghost, "ghost_name"), F.when(name.rlike(r"[^\p{L}\p{N}\s・()（）&-]{3,}"), "garbage"), F.when(F.size(segments) == 0, "no_business"), F.when((F.size(segments) == 1) & F.array_contains(segments, "other"), "only_other"), F.when(F.abs(deviation) > 0.3, "deviation")))


def quality_grade(issues: Column, fatal: list[str]) -> Column:
    """FAIL with a fatal issue, WARN with any, else OK."""
    return F.when(F.arrays_overlap(issues, F.array(*[F.lit(x) for x in fatal])), "FAIL").when(F.size(issues) > 0, "WARN").otherwise("OK")


def mentions_against_facts(mentions: DataFrame, facts: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """Figures named in text (key, field, value) beside the facts of the same key and field, and whether they agree."""
    both = mentions.join(facts.withColumnRenamed("value", "fact"), [key, "field"], "left")
    return both.withColumn("status", first_case([(F.col("fact").isNull(), "no_fact"), (F.abs(F.col("value") - F.col("fact")) <= tolerance * F.abs("fact"), "agrees")], "differs"))
