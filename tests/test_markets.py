"""Market-specific operators on small rows."""

from pyspark.sql import functions as F

from ledgerline.operators import classify, markets


def test_retry_and_guard(spark):
    a = spark.createDataFrame([(1, None, None), (2, 5.0, None)], "id int, revenue double, profit double")
    b = spark.createDataFrame([(1, 7.0, 1.0), (2, 9.0, 9.0)], "id int, revenue double, profit double")
    assert sorted(map(tuple, markets.with_parent_only_retry(a, b, ["id"], ["revenue", "profit"]).collect())) == [(1, 7.0, 1.0), (2, 5.0, None)]
    f = spark.createDataFrame([(1, "x", "jpigp:x", "C", 1.0), (2, "x", "jpigp:x", "C", 1.0), (2, "OrdinaryIncome", "jp:o", "CurrentYear", 3.0), (3, "y", "jp:y", "C", 1.0)], "d int, tag string, full_tag string, context string, value double")
    assert [r["d"] for r in markets.foreign_ordinary_income(f, "d").collect()] == [1]
    g = spark.createDataFrame([(1, "a", "CurrentYearInstant", 1.0), (1, "b", "CurrentYearInstant", 2.0), (1, "a", "Prior1YearInstant", 9.0), (2, "c", "CurrentYearInstant", 5.0)], "d int, tag string, context string, value double")
    assert [tuple(r) for r in markets.component_sum(g, "d", ["a", "b"], "inventories").collect()] == [(1, 3.0)]


def test_layouts(spark):
    rows = spark.createDataFrame([(1, 100.0, 60.0, 40.0, 0.0), (2, 7.0, 100.0, 60.0, 40.0), (3, 1.0, 2000.0, 3000.0, 4000.0)], "id int, a double, b double, c double, d double")
    c = [F.col(x) for x in "abcd"]
    got = rows.withColumn("layout", markets.layout((c[0], c[1], c[2]), (c[1], c[2], c[3])))
    assert {r["id"]: r["layout"] for r in got.collect()} == {1: "normal", 2: "shifted", 3: None}
    kept, other = markets.drop_unread(got, rows.select("id"), ["id"])
    assert kept.count() == 2 and sorted(r["id"] for r in other.collect()) == [1, 2]
    y = spark.createDataFrame([(113,), (2024,)], "y int").select(markets.gregorian(F.col("y"))).collect()
    assert [r[0] for r in y] == [2024, 2024]


def test_segments(spark):
    s = spark.createDataFrame([("a", 5.0, 1.0, None), ("b", None, None, 0.0), ("c", 1.0, None, 9.0)], "m string, revenue_external double, revenue_internal double, revenue_total double")
    assert [r["revenue_total"] for r in markets.segment_values(s).orderBy("m").collect()] == [6.0, None, 9.0]
    m = spark.createDataFrame([("ReconcilingItemsMember",), ("ReportableSegmentsMember",), ("OtherMember",), ("SteelMember",)], "m string")
    assert [r[0] for r in m.select(markets.member_role(F.col("m"))).collect()] == ["reconciling", "total", "other", "segment"]
    seg = spark.createDataFrame([("x", "s1", 1.0)], "code string, label string, v double")
    store = spark.createDataFrame([("x", 9.0), ("y", 8.0)], "code string, v double")
    assert sorted(map(tuple, markets.whole_company(seg, store, ["code"], "label").collect())) == [("x", "s1", 1.0), ("y", "whole company", 8.0)]


def test_addresses(spark):
    t = spark.createDataFrame([("東京都港区芝1",), ("神奈川県横浜市西区みなと",), ("北海道札幌市",), ("Texas, USA",)], "t string")
    p, c = markets.address_parts(F.col("t"))
    assert [tuple(r) for r in t.select(p, c).collect()] == [("東京都", "港区"), ("神奈川県", "横浜市西区"), ("北海道", "札幌市"), (None, None)]
    assert [r[0] for r in t.select(markets.foreign_address(F.col("t"), ["USA"])).collect()] == [False, False, False, True]
    assert spark.range(1).select(markets.merged_digits(F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(2e15)))).first()[0]


def test_empty_groups(spark):
    none = spark.createDataFrame([], "k string, v double, t double")
    assert classify.segment_issues(none, "k", "v", "t").count() == 0
    one = spark.createDataFrame([("k", None, 1.0)], "k string, v double, t double")
    assert classify.segment_issues(one, "k", "v", "t").first()["issue"] == "ALL_NA"
