"""Prices in space: statistics, fallback lookups, nearest neighbours, zones, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import cell, exact, haversine


def price_stats(df: DataFrame, value: str) -> list[Column]:
    """Aggregates: count, mean, median, min, max, and quartiles by exact interpolation where there are two values."""
    v = F.col(value)
    two = lambda x: F.when(F.count(v) >= 2, x)
    return [F.count(v).alias("n"), (F.sum(exact(v)).cast("double") / F.count(v)).alias("mean"), F.percentile(v, 0.5).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"), two(F.percentile(v, 0.25)).alias("p25"), two(F.percentile(v, 0.75)).alias("p75")]


def grouped_prices(df: DataFrame, region: str, use: str, value: str) -> DataFrame:
    """Statistics by (region, use) and by region (use null), with the quartile dispersion, in one pass of grouping sets."""
    out = df.groupingSets([[F.col(region), F.col(use)], [F.col(region)]], F.col(region), F.col(use)).agg(*price_stats(df, value))
    return out.withColumn("dispersion", F.when(F.col("median") > 0, (F.col("p75") - F.col("p25")) / F.col("median")))


def merge_stats(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two partial aggregates (n, mean, low, high) as one: means weigh by count."""
    both = a.unionByName(b)
    weighted = F.sum(exact(F.col("mean") * F.col("n"))).cast("double") / F.sum("n")
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), weighted.alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def lookup_with_fallback(rows: DataFrame, levels: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """Rows with the value of the first level that has their key, and that level's number; null and -1 without."""
    out, picks = rows, []
    for k, (table, keys) in enumerate(levels):
        side = table.select(*keys, F.col(value).alias(f"_v{k}"))
        out = out.join(side, keys, "left") if keys else out.crossJoin(F.broadcast(side.limit(1)))  # one row at most
        picks.append(F.when(F.col(f"_v{k}").isNotNull(), F.struct(F.lit(k).alias("level"), F.col(f"_v{k}").alias("value"))))
    got = F.coalesce(*picks)
    return out.withColumns({"level": F.coalesce(got["level"], F.lit(-1)), value: got["value"]}).drop(*[f"_v{k}" for k in range(len(levels))])


def nearest_prices(targets: DataFrame, points: DataFrame, radius_km: float = 3.0, size: float = 0.05, most: int = 10, least: int = 3, floor_km: float = 0.05) -> DataFrame:
    """For each target (id, lat, lon, use) the inverse-distance mean price of its nearest points (lat, lon, price, use).

    Points within ``radius_km``, at most ``most``, of the same use; where fewer than ``least`` are there, of any use but
    'other'. Targets meet the points of the cells around them only: an equi-join on cells, then the exact distance.
    """
    reach = int(radius_km / 5.0) + 1
    steps = [F.lit(k) for k in range(-reach, reach + 1)]
    t = targets.select("id", "lat", "lon", "use", cell(F.col("lat"), size).alias("_y"), cell(F.col("lon"), size).alias("_x"))
    t = t.withColumn("_dy", F.explode(F.array(*steps))).withColumn("_dx", F.explode(F.array(*steps)))
    t = t.select("id", "lat", "lon", "use", (F.col("_y") + F.col("_dy")).alias("_y"), (F.col("_x") + F.col("_dx")).alias("_x"))
    p = points.select(F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.col("price"), F.col("use").alias("puse"), cell(F.col("lat"), size).alias("_y"), cell(F.col("lon"), size).alias("_x"))
    near = t.join(p, ["_y", "_x"]).withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where(F.col("km") <= radius_km)
    same = F.col("use") == F.col("puse")
    counted = near.withColumn("same", F.sum(F.when(same, 1).otherwise(0)).over(Window.partitionBy("id")))
    used = counted.where(F.when(F.col("same") >= least, same).otherwise(F.col("puse") != "other"))
    top = used.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("km", "price"))).where(F.col("n") <= most)
    w = 1 / F.greatest("km", F.lit(floor_km))
    return top.groupBy("id").agg((F.sum(F.col("price") * w) / F.sum(w)).alias("price"), F.count("*").alias("neighbours"))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule against one ring, as one expression."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((y >= min(y1, y2)) & (y < max(y1, y2))) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def first_zone(x: Column, y: Column, zones: list[tuple[str, list[tuple[float, float]]]]) -> Column:
    """The first zone that holds the point; bounding boxes are tested first. For zone lists of a program's size."""
    out = None
    for name, ring in zones:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        test = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & in_polygon(x, y, ring)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule against a ring (array of struct x, y), by a fold over its edges."""
    after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    low, high = (lambda e: F.least(e["y1"], e["y2"])), (lambda e: F.greatest(e["y1"], e["y2"]))
    at = lambda e: e["x1"] + (y - e["y1"]) * ((e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))
    return F.size(F.filter(edges, lambda e: (y >= low(e)) & (y < high(e)) & (x < at(e)))) % 2 == 1


def zone_join(points: DataFrame, zones: DataFrame, size: float = 0.05) -> DataFrame:
    """id, use of points (id, lat, lon): the first zone (nth, use, ring) that holds each, null without one.

    Zones stand in every grid cell that their bounding box meets, points in one: an equi-join on cells, then the exact test.
    """
    square = lambda c: F.floor(c / size).cast("int")
    ends = lambda k: (F.array_min(F.transform("ring", lambda p: p[k])), F.array_max(F.transform("ring", lambda p: p[k])))
    cells = lambda k: F.explode(F.sequence(*[square(e) for e in ends(k)]))
    z = zones.withColumn("_x", cells("x")).withColumn("_y", cells("y"))
    p = points.select("id", "lat", "lon", square(F.col("lon")).alias("_x"), square(F.col("lat")).alias("_y"))
    hits = p.join(z, ["_x", "_y"]).where(in_ring(F.col("lon"), F.col("lat"), F.col("ring")))
    return points.select("id").join(hits.groupBy("id").agg(F.min_by("use", "nth").alias("use")), "id", "left")


def group_outliers(df: DataFrame, key: str, value: str, times: float = 10.0, floor: float = 30.0, least: int = 3) -> DataFrame:
    """Rows of groups of ``least`` or more whose value exceeds ``times`` the group's upper median and ``floor``."""
    # The discrete median from above is the upper one; it merges counts of values, not lists of rows.
    upper = df.groupBy(key).agg(F.count(value).alias("_n"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)").alias("upper_median")).where(F.col("_n") >= least).drop("_n")
    return df.join(upper, key).where((F.col(value) > times * F.col("upper_median")) & (F.col(value) > floor))
