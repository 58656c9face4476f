"""Upserts and patches of a store, as new tables from old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.select import first_row


def core_count(fields: list[str]) -> Column:
    return sum((F.col(f).isNotNull().cast("int") for f in fields[1:]), F.col(fields[0]).isNotNull().cast("int"))


def action(old_id: Column, new_id: Column, old_flash: Column, old_core: Column) -> Column:
    """What to do with an incoming document: reprocess if nothing sound is stored, if the store has a flash report or an
    older document; skip the same and the older one."""
    return F.when(old_id.isNull() | old_flash | (old_core == 0), "reprocess").when(new_id > old_id, "reprocess").when(new_id == old_id, "same").otherwise("older")


def guarded_upsert(store: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The store after the incoming rows (keys, doc_id, flash, fields).

    Of rows with one key, reports stand before flash reports, later documents before earlier ones. A newer row with fewer
    core figures than a stored report's two or more is refused.
    """
    order = [F.col("flash").cast("int"), F.col("doc_id").desc_nulls_last()]
    columns = [*keys, "doc_id", "flash", *fields]
    new = first_row(incoming.select(*columns), keys, order)
    old = store.select(*keys, F.struct("doc_id", "flash", *fields, core_count(fields).alias("core")).alias("o"))
    new = new.select(*keys, F.struct("doc_id", "flash", *fields, core_count(fields).alias("core")).alias("n"))
    both = old.join(new, keys, "full_outer")
    sparse = (F.col("n.core") < F.col("o.core")) & (F.col("o.core") >= 2) & ~F.col("o.flash")
    newer = (F.col("o.flash") & ~F.col("n.flash")) | ((F.col("o.flash") == F.col("n.flash")) & (F.col("n.doc_id") > F.col("o.doc_id"))) | (F.col("o.core") == 0)
    take = F.col("o").isNull() | (F.col("n").isNotNull() & F.coalesce(newer & ~sparse, F.lit(False)))
    both = both.withColumn("r", F.when(take, F.col("n")).otherwise(F.col("o")))
    return both.select(*keys, "r.doc_id", "r.flash", *[F.col(f"r.{f}") for f in fields])


def patch(base: DataFrame, patches: DataFrame, keys: list[str], fields: list[str], overwrite: bool = False) -> DataFrame:
    """Fill null fields from the patch row of the same key, or with ``overwrite`` take its values, absent ones clearing."""
    side = patches.select(*keys, F.struct(*fields).alias("_p"))
    out = base.join(side, keys, "left")
    hit = F.col("_p").isNotNull()
    value = lambda f: F.when(hit, F.col(f"_p.{f}")).otherwise(F.col(f)) if overwrite else F.coalesce(F.col(f), F.col(f"_p.{f}"))
    return out.withColumns({f: value(f) for f in fields}).drop("_p")


def difference_counts(before: DataFrame, after: DataFrame, keys: list[str], field: str) -> DataFrame:
    """How many values of a field were filled, cleared, changed or kept."""
    both = before.select(*keys, F.col(field).alias("x")).join(after.select(*keys, F.col(field).alias("y")), keys)
    kind = F.when(F.col("x").eqNullSafe(F.col("y")), "kept").when(F.col("x").isNull(), "filled").when(F.col("y").isNull(), "cleared").otherwise("changed")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
