"""Mixing sources by temperature.

Source weights are the token shares raised to an exponent. The exponent is found by sections (bisection with many
interior points a step, one small aggregation each) so that the weights meet an entropy, or no source is repeated more
than a limit. The weights are then realised: each source's documents form one endless stream, its epochs in a hashed
order, of which the source's budget is taken; the streams are laid over one another in blocks of equal budget, and each
block is a permutation of what falls into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, partitions

SECTIONS, STEPS = 32, 7


def _find(totals: DataFrame, goal, low: float, high: float) -> float:
    """The exponent at which ``goal`` (columns for an exponent, then a test of their values: go higher?) turns."""
    columns, higher = goal
    for _ in range(STEPS):
        grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        got = totals.agg(*[F.struct(*columns(a)).alias(f"a{k}") for k, a in enumerate(grid)]).first()
        k = next((k for k in range(SECTIONS + 1) if not higher(got[f"a{k}"])), SECTIONS)
        low, high = grid[max(0, k - 1)], grid[k]
    return high


def exponent(totals: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent for ``totals`` (source totals in column n).

    With ``entropy`` (nats): the weights' entropy comes down to it, exponents 0 to 8. With ``max_repeats``: the smallest
    exponent from 0 to 1 at which no source is repeated more often, either within ``budget`` tokens or, without one, when
    every document is used at least once. Repeats are largest for the smallest source, and fall as the exponent grows.
    """
    if totals.isEmpty():
        return 1.0
    x = F.log("n")
    if entropy is not None:
        top = totals.agg(F.max(x)).first()[0]  # powers relative to the largest source
        power = lambda a: F.exp(a * (x - top))
        columns = lambda a: (F.sum(power(a)).alias("z"), F.sum(power(a) * a * (x - top)).alias("e"))
        import math

        return _find(totals, (columns, lambda r: math.log(r["z"]) - r["e"] / r["z"] > entropy), 0.0, 8.0)
    if budget is not None:
        columns = lambda a: (F.sum(F.pow("n", F.lit(a))).alias("z"), F.max(F.pow("n", F.lit(a - 1))).alias("r"))
        return _find(totals, (columns, lambda r: r["r"] / r["z"] * budget > max_repeats), 0.0, 1.0)
    ends = totals.agg(F.max("n").alias("hi"), F.min("n").alias("lo")).first()
    spread = F.lit(ends["hi"] / ends["lo"])
    return _find(totals, (lambda a: (F.max(F.pow(spread, F.lit(1 - a))).alias("r"),), lambda r: r["r"] > max_repeats), 0.0, 1.0)


def mix(docs: DataFrame, tokens: Column, entropy: float | None = None, max_repeats: float | None = 1.5, budget: float | None = None, block_tokens: int = 1 << 20, seed: int = 17, buckets: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, source, n_tokens, weight, copy, block, slot: one row for each use of a document.

    ``tokens`` counts a row's tokens; every row counts one at least. Without ``budget`` the budget is the least with
    which every document is used at least once, so nothing is lost and small sources repeat. A source's realised tokens
    differ from its weight's by less than one document. Null is a source of its own; rows that share a doc_id are
    documents each; an empty table gives an empty mix; other columns are ignored.

    Offsets within a source come from two levels, so no source is one task's work: hash buckets of each source are
    summed before the shuffle, added up over the buckets (``buckets`` rows a source), and rows only within a bucket.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    buckets = buckets or max(64, 16 * partitions(spark))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(1)).cast("long").alias("n_tokens"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))).withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11))
    rows = scratch.table(rows.withColumn("bucket", F.floor(F.col("h") / float(1 << 53) * buckets).cast("int")), "rows")
    parts = scratch.table(rows.groupBy("key", "bucket").agg(F.sum("n_tokens").alias("m")), "buckets")
    totals = scratch.table(parts.groupBy("key").agg(F.sum("m").alias("n")), "totals")
    a = exponent(totals, entropy, max_repeats, budget)
    norm = totals.agg(F.sum(F.pow("n", F.lit(a))).alias("z"), F.max(F.pow("n", F.lit(1 - a))).alias("r")).first()
    if norm["z"] is None:
        norm = {"z": 1.0, "r": 0.0}
    total = budget if budget is not None else norm["z"] * norm["r"]
    blocks = max(1, -(-int(total) // block_tokens))
    weight = F.pow("n", F.lit(a)) / norm["z"]
    goal = F.lit(float(total)) * weight
    if budget is None:
        goal = F.greatest(goal, F.col("n").cast("double"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).join(totals, "key").select("key", "bucket", "start", "n", weight.alias("weight"), goal.alias("goal"))
    within = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(starts, ["key", "bucket"])
    placed = placed.withColumn("offset", F.col("start") + F.col("inner"))
    copies = F.ceil((F.col("goal") - F.col("offset")) / F.col("n"))
    used = placed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1)))
    block = F.least(F.floor((F.col("copy") * F.col("n") + F.col("offset")) / F.col("goal") * blocks), F.lit(blocks - 1)).cast("long")
    slot = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("doc_id", "copy", "block", F.lit(seed)), "doc_id", "copy", "n_tokens"))
    return used.withColumn("block", block).withColumn("slot", slot).select("doc_id", "source", "n_tokens", "weight", "copy", "block", "slot")


def word_count(text: str = "text") -> Column:
    """Words between blanks, the measure of tokens where no vocabulary is given."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"))
