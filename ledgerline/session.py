"""Session defaults: UTC, adaptive execution, skew joins split at run time; the folder that all processes share."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "ledgerline", **conf: str) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; without one, under the warehouse, or in local mode a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        root = f"file://{tempfile.mkdtemp(prefix='ledgerline-')}" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
