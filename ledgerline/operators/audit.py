"""Completeness audits: what was expected against what is there, what is new, old or unverified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_status(expected: DataFrame, candidates: DataFrame, keys: list[str], ranks: dict[str, int], missing: str = "MISSING") -> DataFrame:
    """Each expected key with the best of its candidates' statuses (smallest rank, then name); ``missing`` without any."""
    rank = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    best = candidates.groupBy(*keys).agg(F.min(F.struct(rank[F.col("status")].alias("r"), "status")).alias("b"))
    return expected.join(best, keys, "left").withColumn("status", F.coalesce("b.status", F.lit(missing))).drop("b")


def existence(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with where they are: both, missing (expected only) or extra (actual only)."""
    e, a = expected.select(*keys).distinct().withColumn("_e", F.lit(True)), actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    both = e.join(a, keys, "full_outer")
    return both.withColumn("side", F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("both")).drop("_e", "_a")


def near_in_time(rows: DataFrame, others: DataFrame, key: str, when: str, days: int) -> DataFrame:
    """Rows for which the other side has the same key within so many days. Both sides are bucketed by the window's width,
    so the join is by (key, bucket) and meets three buckets at most."""
    width = days + 1
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    tries = rows.withColumn("_b", F.explode(F.array(*[F.floor(day(when) / width) + k for k in (-1, 0, 1)])))
    build = others.select(key, F.col(when).alias("_when"), F.floor(day(when) / width).alias("_b")).distinct()
    hits = tries.join(build, [key, "_b"]).where(F.abs(F.datediff(F.col(when), F.col("_when"))) <= days)
    return hits.select(*rows.columns).distinct()


def by_date(audited: DataFrame, date: str, entity: str, ok: Column) -> DataFrame:
    """Per date: expected, fine, and the sorted distinct entities in trouble."""
    return audited.groupBy(date).agg(F.count("*").alias("expected"), F.sum(F.when(ok, 1).otherwise(0)).alias("fine"), F.sort_array(F.collect_set(F.when(~ok, F.col(entity)))).alias("problems"))


def verdict(audited: DataFrame, bad: Column, unverified: Column) -> DataFrame:
    """One row: FAIL if anything is bad, PASS_PARTIAL if something could not be verified, else PASS."""
    got = audited.agg(F.coalesce(F.sum(F.when(bad, 1)), F.lit(0)).alias("bad"), F.coalesce(F.sum(F.when(unverified, 1)), F.lit(0)).alias("unverified"), F.count("*").alias("rows"))
    return got.withColumn("verdict", F.when(F.col("bad") > 0, "FAIL").when(F.col("unverified") > 0, "PASS_PARTIAL").otherwise("PASS"))


def confidence(parts: list[tuple[Column, float]], caps: list[tuple[Column, float]]) -> Column:
    """Weighted sum of shares (0 to 1), per hundred, under the lowest cap whose condition holds."""
    total = sum((F.coalesce(p, F.lit(0.0)) * (w * 100) for p, w in parts[1:]), F.coalesce(parts[0][0], F.lit(0.0)) * (parts[0][1] * 100))
    for test, cap in caps:
        total = F.when(test, F.least(total, F.lit(cap))).otherwise(total)
    return total


def eligible(docs: DataFrame, kinds: list[str], listed: DataFrame, excluded: DataFrame, code: str = "code") -> DataFrame:
    """Documents of the wanted kinds with a period end, of listed companies, but for the excluded ones."""
    own = docs.where(F.col("doc_type").isin(kinds) & F.col("period_end").isNotNull())
    return own.join(listed.select(code).distinct(), code, "left_semi").join(excluded.select(code).distinct(), code, "left_anti")


def archived(expected: DataFrame, paths: DataFrame, key: str = "doc_id", missing: str = "NO_ZIP") -> DataFrame:
    """Expected documents (key, year) with the first archive path that holds their id and lies in their year's folder."""
    from ledgerline.sources.filings import path_parts

    found = paths.select("path", path_parts(F.col("path")).alias("p")).where("p.document IS NOT NULL")
    first = found.groupBy(F.col("p.document").alias(key), F.col("p.year").alias("year")).agg(F.min("path").alias("path"))
    return expected.join(first, [key, "year"], "left").withColumn("status", F.when(F.col("path").isNull(), missing).otherwise("OK"))


def days(first: str, last: str) -> str:
    """SQL for a table of the dates from first to last."""
    return f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day"


def verified_days(lists: DataFrame, spine: DataFrame, day: str = "day") -> DataFrame:
    """Each day of the spine: 'unverified' if no list of it was kept, 'empty' if the list has no document, else 'listed',
    with the number of documents. ``lists`` has a row for each document and one with a null doc_id for each kept list."""
    kept = lists.groupBy(day).agg(F.count("doc_id").alias("documents"))
    out = spine.select(day).distinct().join(kept, day, "left")
    state = F.when(F.col("documents").isNull(), "unverified").when(F.col("documents") == 0, "empty").otherwise("listed")
    return out.withColumns({"state": state, "documents": F.coalesce("documents", F.lit(0).cast("long"))})


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a run that is resumed has still to do: work whose keys no finished record has."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def expired(files: DataFrame, when: str, today: Column, limits: dict[str, int], kind: str = "kind") -> DataFrame:
    """Files older than their kind's limit of days; kinds without a limit stay."""
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)]
    return files.where(F.datediff(today, F.col(when)) > limit)


def to_send(local: DataFrame, remote: DataFrame, key: str = "key", since: Column | None = None) -> DataFrame:
    """Local files (key, size, modified) that the other side lacks or has with another size, changed since then if given."""
    own = local if since is None else local.where(F.col("modified") >= since)
    return own.join(remote.select(key, "size"), [key, "size"], "left_anti")


def freshness(checks: DataFrame, when: str, now: Column, warn_hours: int = 96, fail_hours: int = 168) -> DataFrame:
    """Each check's status by the age of its last run: OK, WARN or FAIL; FAIL without a run."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(F.col(when))) / 3600
    return checks.withColumn("status", F.when(hours.isNull() | (hours > fail_hours), "FAIL").when(hours > warn_hours, "WARN").otherwise("OK"))


def reconcile(shown: DataFrame, store: DataFrame, keys: list[str], tolerance: float = 0.02, most: int | None = None) -> DataFrame:
    """Shown figures (keys, display text) that are off the store's (keys, value) by more than the tolerance, largest share
    first: keys, display, store, ratio. What cannot be read, or has no store figure or a zero one, is no finding."""
    from ledgerline.functions.scalars import parse_money, present

    both = shown.select(*keys, parse_money(F.col("display")).alias("display")).join(store.select(*keys, present(F.col("value")).alias("store")), keys)
    found = both.withColumn("ratio", F.abs(F.col("display") - F.col("store")) / F.col("store")).where(F.col("ratio") > tolerance).orderBy(F.desc("ratio"), *keys)
    return found if most is None else found.limit(most)


def sampled(audited: DataFrame, status: str, entity: str, most: int = 200) -> DataFrame:
    """Count and the first ``most`` entities of each status, in order: ranks cut before the shuffle, so no list is unbounded."""
    w = Window.partitionBy(status).orderBy(entity)
    some = audited.select(status, entity).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    lists = some.groupBy(status).agg(F.sort_array(F.collect_list(entity)).alias("samples"))
    return audited.groupBy(status).agg(F.count("*").alias("n")).join(lists, status)
