"""Late and corrected filings as a stream: a store that newer documents replace and older ones never downgrade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per key the row with the largest order columns."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*keys, "r.*")


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], columns: list[str], buckets: int = 64):
    """Start a query that keeps, for each key, the newest row of all batches in a store of versions under ``path``.

    Keys are dealt into ``buckets`` by hash. A batch writes, as version batch_id + 1, the buckets it touches: each from its
    newest version below and the batch, so the rest of the store is neither read nor written, and a batch that is run again
    after a failure replaces its own version and nothing else. Of each touched bucket the two newest versions stay. Read
    with ``read_store``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        rows = newest(batch.select(*keys, *columns), keys, order, columns).select("*", bucket).persist()
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # ``buckets`` numbers at most
        have = _versions(spark, path, batch_id)
        paths = [f"{path}/version={max(have[b])}/bucket={b}" for b in touched if have.get(b)]
        merged = rows
        if paths:
            old = spark.read.schema(rows.schema).option("basePath", path).parquet(*paths)
            merged = newest(rows.drop("bucket").unionByName(old.select(*keys, *columns)), keys, order, columns).select("*", bucket)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/version={batch_id + 1}")
        rows.unpersist()
        for b in touched:
            for v in sorted(have.get(b, []))[:-1]:
                _delete(spark, f"{path}/version={v}/bucket={b}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where, fs = _folder(spark, path)
    fs.delete(where, True)


def _versions(spark: SparkSession, path: str, most: int | None = None) -> dict[int, list[int]]:
    """Finished versions (up to ``most``) of each bucket."""
    root, fs = _folder(spark, path)
    out: dict[int, list[int]] = {}
    if not fs.exists(root):
        return out
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if not name.startswith("version=") or (most is not None and int(name[8:]) > most) or not fs.exists(_folder(spark, f"{path}/{name}/_SUCCESS")[0]):
            continue
        for t in fs.listStatus(s.getPath()):
            if t.getPath().getName().startswith("bucket="):
                out.setdefault(int(t.getPath().getName()[7:]), []).append(int(name[8:]))
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of every bucket; None before the first batch."""
    paths = [f"{path}/version={max(v)}/bucket={b}" for b, v in sorted(_versions(spark, path).items())]
    return spark.read.option("basePath", path).parquet(*paths).drop("version", "bucket") if paths else None


def windowed_counts(stream: DataFrame, when: str, kind: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and kind, with a watermark for late rows; works on streams and on tables."""
    return stream.withWatermark(when, late).groupBy(F.window(when, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
