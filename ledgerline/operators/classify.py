"""Ordered classifications, overrides, roll-ups and variance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import first_case, gap, present


def keyword_class(text: Column, cascade: list[tuple[str, list[str]]], otherwise: str = "other") -> Column:
    """The first class with a keyword contained in the text, case ignored."""
    low = F.lower(text)
    tests = []
    for name, words in cascade:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        tests.append((hit, name))
    return first_case(tests, otherwise)


def company_class(code: Column, banks: list[str], bank_tags: Column, ifrs: Column, gains: Column, operating: Column, leases: Column, assets: Column) -> Column:
    """bank by code or tags; of IFRS filers investment holdings (gains over twice the operating income) and retailers
    (leased assets over 5 per cent); else general."""
    big = F.abs(gains) > 2 * F.abs(operating)
    return first_case([(code.isin(banks) | bank_tags, "bank"), (ifrs & big, "investment_holding"), (ifrs & (leases / present(assets) > 0.05), "retail"), (ifrs, "ifrs")], "general")


def plausibility(value: Column, revenue: Column, kind: Column) -> Column:
    """Why a patched figure is not believed, the first reason that holds; null if it is."""
    share = F.abs(value) / present(F.abs(revenue))
    return first_case([(value.isNull(), "missing"), (F.abs(value) < 1000, "too_small"), ((kind == "part") & (share > 1), "exceeds_revenue"), ((kind == "income") & (share > 2), "over_200_percent"), ((kind == "cash") & ~share.between(0.3, 10), "ratio_out_of_range")])


def segment_issues(rows: DataFrame, key: str, value: str, total: str) -> DataFrame:
    """One issue a group of segment rows: NO_SEGMENT, ALL_NA, COPY_FROM_TOTAL (a segment within 1 per cent of the total),
    ALL_SAME, PARTIAL_NA, or OK."""
    v, t = F.col(value), F.col(total)
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.count(v).alias("known"), F.countDistinct(v).alias("kinds"), F.coalesce(F.bool_or((gap(v, t) < 0.01) & v.isNotNull()), F.lit(False)).alias("copy"))
    issue = first_case([(F.col("n") == 0, "NO_SEGMENT"), (F.col("known") == 0, "ALL_NA"), (F.col("copy") & (F.col("n") > 1), "COPY_FROM_TOTAL"), ((F.col("known") > 1) & (F.col("kinds") == 1), "ALL_SAME"), (F.col("known") < F.col("n"), "PARTIAL_NA")], "OK")
    return g.select(key, "n", "known", issue.alias("issue"))


def worst(statuses: DataFrame, key: str, ranks: dict[str, int]) -> DataFrame:
    """Each key's worst status by rank, ties to the name that sorts last."""
    rank = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    return statuses.groupBy(key).agg(F.max(F.struct(rank[F.col("status")].alias("r"), "status")).alias("w")).select(key, F.col("w.status").alias("status"))


def label_chain(rows: DataFrame, tables: list[DataFrame], key: str, label: str, fallback: Column) -> DataFrame:
    """The first table with the key names it, else the fallback."""
    out = rows
    for k, t in enumerate(tables):
        out = out.join(t.select(key, F.col(label).alias(f"_l{k}")), key, "left")
    return out.withColumn(label, F.coalesce(*[F.col(f"_l{k}") for k in range(len(tables))], fallback)).drop(*[f"_l{k}" for k in range(len(tables))])


def override(rows: DataFrame, overrides: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with ``category`` from the first override (ordinal) of their key whose ``part`` the text contains."""
    hits = rows.join(overrides.select(key, "part", "ordinal", F.col("category").alias("_c")), key).where(F.contains(F.col(text), F.col("part")))
    ids = [c for c in rows.columns if c != "category"]
    best = hits.groupBy(*ids).agg(F.min_by("_c", "ordinal").alias("_o"))
    return rows.join(best, ids, "left").withColumn("category", F.coalesce("_o", "category")).drop("_o")


def paired_medians(rows: DataFrame, key: str, a: str, b: str, least: int) -> DataFrame:
    """Groups of ``least`` or more: both medians, the median gap in per cent, and the share in which a is the higher."""
    g = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(key)
    out = g.agg(F.count("*").alias("n"), F.percentile(a, 0.5).alias("median_a"), F.percentile(b, 0.5).alias("median_b"), F.percentile((F.col(a) - F.col(b)) / present(F.abs(b)) * 100, 0.5).alias("median_gap"), (F.count_if(F.col(a) > F.col(b)) * 100 / F.count("*")).alias("higher"))
    return out.where(F.col("n") >= least)


def run_variance(rows: DataFrame, key: str, run: str, position: str, value: str) -> DataFrame:
    """Per key and position of keys with two runs or more: how far the runs' values lie apart."""
    runs = rows.select(key, run).distinct().groupBy(key).count().where("count >= 2").select(key)
    return rows.join(runs, key, "left_semi").groupBy(key, position).agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("spread"))


def missing_keys(old: DataFrame, new: DataFrame, key: str, names: str) -> DataFrame:
    """Names of the old row (array) that the new one lacks, where there are any."""
    both = old.select(key, F.col(names).alias("a")).join(new.select(key, F.col(names).alias("b")), key)
    return both.select(key, F.array_sort(F.array_except("a", F.coalesce("b", F.array().cast("array<string>")))).alias("missing")).where("size(missing) > 0")


def seeded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that key and seed fix."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def contaminated(contexts: DataFrame, doc: str, context: str) -> DataFrame:
    """Documents with interim contexts and none of the current year."""
    g = contexts.groupBy(doc).agg(F.count_if(F.col(context).contains("CurrentYear")).alias("current"), F.count_if(F.col(context).contains("Interim")).alias("interim"))
    return g.where("current = 0 AND interim > 0")


def densest(rows: DataFrame, key: str, position: str, score: Column, span: int, threshold: float) -> DataFrame:
    """Per key the window of ``span`` rows with the highest score sum, later ones winning ties, if it meets the threshold."""
    w = Window.partitionBy(key).orderBy(position).rowsBetween(0, span - 1)
    s = rows.withColumn("sum", F.sum(score).over(w)).where(F.col("sum") >= threshold)
    return s.groupBy(key).agg(F.max(F.struct("sum", position)).alias("m")).select(key, F.col(f"m.{position}").alias(position), F.col("m.sum").alias("sum"))


def rerouted(rows: DataFrame, contexts: DataFrame, keys: list[str], doc: str, context: str, folder: Column) -> DataFrame:
    """Annual slots (quarter null) of documents that have interim contexts and none of the current year, or that lie in an
    interim folder, go to the second quarter's slot."""
    bad = contaminated(contexts, doc, context).select(doc, F.lit(True).alias("_i"))
    out = rows.join(bad, doc, "left")
    half = F.col("quarter").isNull() & (F.coalesce("_i", F.lit(False)) | F.coalesce(folder, F.lit(False)))
    return out.withColumn("quarter", F.when(half, 2).otherwise(F.col("quarter"))).drop("_i")


def segment_sums(rows: DataFrame, key: str, measures: dict[str, tuple[str, float]], least: int = 2) -> DataFrame:
    """Groups of ``least`` segments or more: for each measure (segment column -> total column, tolerance) the sum, its gap
    to the total as a share, and whether that is under the tolerance; null where the total is missing or 0."""
    from ledgerline.functions.scalars import exact

    sums = [F.sum(exact(F.col(c))).cast("double").alias(f"{c}_sum") for c in measures] + [F.max(t).alias(t) for t, _ in measures.values()]
    out = rows.groupBy(key).agg(F.count("*").alias("segments"), *sums).where(F.col("segments") >= least)
    for c, (t, tolerance) in measures.items():
        gap = F.abs(F.col(f"{c}_sum") - F.col(t)) / present(F.abs(F.col(t)))
        out = out.withColumns({f"{c}_gap": gap, f"{c}_matches": gap < tolerance})
    return out


def verified_values(compared: DataFrame) -> DataFrame:
    """The final value of each compared figure (a, b, status): the left one where both agree or the right is missing, else
    the right one where the left is missing, else the left with low confidence."""
    sure = F.when(F.col("status") == "exact", "high").when(F.col("status") == "close", "medium").otherwise("low")
    return compared.withColumns({"value": F.coalesce("a", "b"), "confidence": sure})


def industry_values(facts: DataFrame, tags: DataFrame, industry: str, keys: list[str]) -> DataFrame:
    """(keys, field, value) by an industry's tag list (field, tag, industry, priority, ordinal, required, excluded): facts
    whose tag and context hold a required word, if there are any, and no excluded one; lowest priority first, the
    industry's own before those for all, then list order."""
    about = F.lower(F.concat_ws(" ", "tag", "context"))
    named = facts.where("value IS NOT NULL").join(tags.where(F.col("industry").isin(industry, "all")), "tag")
    fits = (F.size("required") == 0) | F.exists("required", lambda w: F.contains(about, F.lower(w)))
    fits = fits & ~F.exists("excluded", lambda w: F.contains(about, F.lower(w)))
    order = F.struct("priority", (F.col("industry") == "all").cast("int"), "ordinal", "value")
    return named.where(fits).groupBy(*keys, "field").agg(F.min_by("value", order).alias("value"))


def method_counts(rows: DataFrame, method: str, failed: Column, key: str, most: int = 50) -> DataFrame:
    """A run's summary: rows by method, and of the failed ones the first ``most`` keys."""
    w = Window.partitionBy(method).orderBy(key)
    some = rows.where(failed).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy(method).agg(F.sort_array(F.collect_list(key)).alias("failures"))
    return rows.groupBy(method).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed")).join(some, method, "left")
