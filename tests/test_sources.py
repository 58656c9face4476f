"""Readers and writers on small files."""

import json
import struct

from pyspark.sql import functions as F

from ledgerline.operators import spatial
from ledgerline.sources import filings


def shapefile(rings):
    """Main part and attributes of polygons, as the format has them."""
    records = b""
    for k, ring in enumerate(rings):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        records += struct.pack(">2i", k + 1, len(body) // 2) + body
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    fields = b"USE".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8, 0]) + bytes(14)
    table = struct.pack("<4BIHH", 3, 24, 1, 1, len(rings), 32 + len(fields) + 1, 9) + bytes(20) + fields + b"\r" + b"".join(b" " + f"u{k}".encode().ljust(8) for k in range(len(rings)))
    return head + records, table


def test_polygons(spark, tmp_path):
    square, far = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)], [(5.0, 5.0), (5.0, 6.0), (6.0, 5.0)]
    shp, dbf = shapefile([square, far])
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.dbf").write_bytes(dbf)
    zones = filings.polygons(spark, str(tmp_path), "USE")
    assert [(r["nth"], r["use"], len(r["ring"])) for r in zones.orderBy("nth").collect()] == [(0, "u0", 4), (1, "u1", 3)]
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.2, 5.2), (3, 9.0, 9.0), (4, 5.9, 5.9)], "id int, lat double, lon double")
    assert {r["id"]: r["use"] for r in spatial.zone_join(points, zones).collect()} == {1: "u0", 2: "u1", 3: None, 4: None}


def test_lists_and_stores(spark, tmp_path):
    (tmp_path / "codes.csv").write_bytes("コード,市場\n1301,上場\n".encode("shift_jis"))
    assert [tuple(r) for r in filings.listings(spark, str(tmp_path / "codes.csv"), "Shift_JIS").collect()] == [("1301", "上場")]
    (tmp_path / "deals.json").write_text(json.dumps([{"Type": "宅地", "UnitPrice": "100", "Prefecture": "東京都", "Municipality": "港区"}, {"Type": "林地"}]))
    assert [r["kind"] for r in filings.deals(spark, str(tmp_path / "deals.json")).collect()] == ["宅地", "林地"]
    store = str(tmp_path / "store")
    filings.write_store(spark.createDataFrame([(1, 2023), (2, 2024)], "v int, fy int"), store)
    filings.write_store(spark.createDataFrame([(9, 2024)], "v int, fy int"), store)
    assert sorted(map(tuple, spark.read.parquet(store).select("v", "fy").collect())) == [(1, 2023), (9, 2024)]
    rows = spark.createDataFrame([("a", 2024, 1, "x"), ("a", 2024, 0, "y"), ("b", 2024, 2, "z")], "code string, fy int, pos int, v string")
    assert [r["v"] for r in filings.sheet_rows(rows, "a", 2024).collect()] == ["y"]
    assert filings.markdown(rows.where("code = 'b'").select("code", F.lit(None).alias("n")), "T") == "# T\n\n| code | n |\n|---|---|\n| b |  |\n"
