"""Line dedup over levelled sorted runs of line hashes.

A run is a written table (hi, lo, n_rows, max_doc), one row a line key, sorted by key within its partitions; no key stands
in two runs. Each batch of documents is reduced to its own keys and merge-anti-joined with the runs already there: the keys
that none of them holds become a run of level 0, the others go to the tallies of keys seen again. When a level holds
``fanout`` runs they are compacted into one sorted run of the next level, so n batches cost each key about log(n) rewrites.
A key's runs and tallies add up to its number of rows and its largest document; a key is two 64-bit hashes (128 bits) of
the stripped lower-cased line.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, pieces

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = {ord(a): ord(b) for a, b in zip(UPPER, LOWER)}
#: Spark's seed, and that of its second hash: a leading 7 hashed as a long.
SEED = 42
SECOND = xxhash.xxh64_intdigest((7).to_bytes(8, "little"), SEED)


def line_key(line: str, min_chars: int) -> tuple[int, int] | None:
    """The two hashes of a line whose stripped form has ``min_chars`` code points, else None; as ``keys_of`` gives them."""
    key = line.strip(BLANKS)
    if len(key) < min_chars:
        return None
    raw = key.translate(_LOWER).encode("utf-8", "surrogatepass")
    return tuple(int(np.uint64(xxhash.xxh64_intdigest(raw, s)).astype(np.int64)) for s in (SEED, SECOND))


def keys_of(text: Column, min_chars: int) -> Column:
    """The distinct keys (hi, lo) of a text's lines, as an array."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    long = F.filter(lines, lambda x: F.char_length(x) >= min_chars)
    # lower() is quick, and on ASCII the same as lower-casing A-Z alone.
    low = lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))
    key = lambda x: F.struct(F.xxhash64(x).alias("hi"), F.xxhash64(F.lit(7).cast("long"), x).alias("lo"))
    return F.array_distinct(F.transform(F.transform(long, low), key))


class LineRuns:
    """The runs of one store; ``levels[k]`` lists the names of the runs of level k, ``again`` the tallies."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 4):
        self.spark, self.scratch, self.fanout, self.levels, self.again, self.made = spark, scratch, fanout, [], [], 0

    def _read(self, names) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.schema("hi bigint, lo bigint, n_rows bigint, max_doc bigint").parquet(self.scratch.path(n)) for n in names))

    def _runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add one batch's rows (doc_id, hi, lo): the anti-join makes the new run, the rest tallies. Returns both."""
        own = keys.groupBy("hi", "lo").agg(F.count("*").alias("n_rows"), F.max("doc_id").alias("max_doc"))
        runs, base = self._runs(), f"batch-{self.made}"
        self.made += 1
        if runs:
            seen = self._read(runs).select("hi", "lo", F.lit(False).alias("fresh"))
            own = own.hint("merge").join(seen, ["hi", "lo"], "left").select("hi", "lo", "n_rows", "max_doc", F.coalesce("fresh", F.lit(True)).alias("fresh"))
        else:
            own = own.withColumn("fresh", F.lit(True))
        # One pass writes both; each side stays sorted by key.
        own.sortWithinPartitions("fresh", "hi", "lo").write.partitionBy("fresh").option("compression", "zstd").parquet(self.scratch.path(base))
        run, tally = f"{base}/fresh=true", f"{base}/fresh=false"
        for name in (run, tally):
            self.scratch.make(name)  # a side without a row has no folder
        self._place(run, 0)
        self.again.append(tally)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            parts, self.levels[level] = self.levels[level], []
            merged, self.made = f"run-{self.made}", self.made + 1
            self._read(parts).repartition("hi", "lo").sortWithinPartitions("hi", "lo").write.option("compression", "zstd").parquet(self.scratch.path(merged))
            self._place(merged, level + 1)
            self.scratch.drop(*[p for p in parts if p != run])
            level += 1
        return self._read([run]) if run in self._runs() else self._read([merged]), self._read([tally])

    def merged(self) -> DataFrame:
        """All keys with their figures: runs and tallies added up."""
        return self._read(self._runs() + self.again).groupBy("hi", "lo").agg(F.sum("n_rows").alias("n_rows"), F.max("max_doc").alias("max_doc"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text (the lines that stay, joined by newlines), n_lines, n_dropped of every row.

    A line goes if its key has at least ``min_chars`` code points, stands in at least ``min_docs`` documents, and a
    larger doc_id holds it too; all of a document's lines with one key share one fate. A null text is one empty line.
    Rows that share a doc_id are one document; a row whose doc_id is null keeps all its lines and counts for no key.
    Other columns are ignored; an empty table gives an empty result. The documents are dealt into ``batches`` by hash of
    their id, as a growing store would bring them, and pass through the runs one batch after another, whatever the number of files. No group of equal lines is
    ever gathered: counts combine before the shuffle, only lines with ``min_docs`` rows are counted by document, and the
    join of frequent keys with the lines is one that Spark may split on skew.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.explode(keys_of(F.col("text"), min_chars)).alias("k")).select("doc_id", "k.hi", "k.lo")
    keyed.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").option("compression", "zstd").parquet(scratch.path("keys"))
    keys = spark.read.schema("doc_id bigint, hi bigint, lo bigint, batch int").parquet(scratch.path("keys"))
    runs = LineRuns(spark, scratch, fanout)
    for k in range(batches):
        runs.add(keys.where(F.col("batch") == k).drop("batch"))
    # Written first, so that the joins with them are of two shuffles, which Spark splits where a line is in very many rows.
    often = scratch.table(runs.merged().where(F.col("n_rows") >= min_docs).select("hi", "lo", "max_doc"), "often")
    held = scratch.table(keys.drop("batch").join(often, ["hi", "lo"]), "held")
    frequent = scratch.table(held.groupBy("hi", "lo").agg(F.count_distinct("doc_id").alias("n_docs")).where(F.col("n_docs") >= min_docs).select("hi", "lo"), "frequent")
    drops = held.where(F.col("doc_id") < F.col("max_doc")).join(frequent, ["hi", "lo"])
    packed = scratch.table(drops.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("drops")), "drops")
    scratch.drop("keys", "often", "held", "frequent", *{n.split("/")[0] for n in runs._runs() + runs.again})
    # Sixteen bytes a dropped line are a fraction of a partition's texts: hashing them spares the texts a sort.
    rows = docs.join(packed.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", F.col("drops.hi").alias("hi"), F.col("drops.lo").alias("lo"))

    def rebuild(parts):
        for part in pieces(parts, 1 << 20):
            texts, total, dropped = [], [], []
            for text, hi, lo in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
                text = text or ""
                n = gone = text.count("\n") + 1
                if hi:
                    drop = set(zip(hi, lo))
                    kept = [x for x in text.split("\n") if line_key(x, min_chars) not in drop]
                    text, gone = "\n".join(kept), len(kept)
                texts.append(text)
                total.append(n)
                dropped.append(n - gone)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return rows.mapInArrow(rebuild, "doc_id bigint, text string, n_lines bigint, n_dropped bigint")
