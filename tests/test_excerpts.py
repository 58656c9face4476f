"""Selections and excerpts on small rows."""

from pyspark.sql import functions as F

from ledgerline.operators import excerpts, filters


def value(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column).first()[0]


def test_names(spark):
    f = spark.createDataFrame([(1, "Alpha Steel Inc"), (2, "Beta"), (3, "Gamma Works")], "id int, name string")
    n = spark.createDataFrame([("alpha",), ("The Beta Company",), (None,)], "name string")
    assert sorted(r["id"] for r in filters.name_matches(f, n).collect()) == [1, 2]
    c = spark.createDataFrame([("12340", "上場"), ("130A0", "上場"), ("9999", "非"), ("", "上場"), ("1234", "上場")], "code string, market string")
    assert [r[0] for r in filters.listed(c).collect()] == ["1234", "130A"]


def test_targets(spark):
    d = spark.createDataFrame([("宅地(土地)", "1,000"), ("宅地", "x"), ("林地", "5"), ("宅地", "200000000")], "kind string, unit_price string")
    assert [r["unit_price"] for r in filters.land_deals(d).collect()] == [1000.0]
    r = spark.createDataFrame([("a", 2020, 10.0, None), ("a", 2023, 10.0, None), ("b", 2020, 1.0, None), ("a", 2021, 10.0, 1.0)], "code string, fy int, revenue double, capex double")
    docs = spark.createDataFrame([("a", 2021), ("b", 2020)], "code string, fy int")
    assert [(x["code"], x["fy"]) for x in filters.patch_targets(r, docs, "capex", 5).collect()] == [("a", 2020)]
    s = spark.createDataFrame([("f", "t", ["x"])], "field string, tag string, companies array<string>")
    n = spark.createDataFrame([("f", "t", "y"), ("g", "u", "z")], "field string, tag string, company string")
    assert sorted((r["field"], r["companies"]) for r in filters.learned_tags(s, n).collect()) == [("f", ["x", "y"]), ("g", ["z"])]
    e, b = spark.createDataFrame([(1, 12.0)], "k int, v double"), spark.createDataFrame([(1, 10.0)], "k int, v double")
    assert filters.benchmark_gap(e, b, "k", "v").first()["gap"] == 20.0


def test_excerpts(spark):
    text = "x" * 400 + "KEY one" + "y" * 50 + "KEY two" + "z" * 400 + "other three"
    d = spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id int, text string")
    got = excerpts.excerpts(d, ["KEY", "other"], before=5, after=10, apart=100, budget=100).orderBy("nth").collect()
    assert [(r["doc_id"], r["start"], r["excerpt"]) for r in got] == [(1, 400, "xxxxxKEY oneyyy"), (1, 864, "zzzzzother thre")]
    assert [r["nth"] for r in excerpts.excerpts(d, ["KEY", "other"], 5, 10, 100, 20).collect()] == [1]


def test_excerpts_against_taken_only(spark):
    chain = "".join("KEY" + "." * 247 for _ in range(9))  # a match every 250 characters
    clash = "." * 50 + "low" + "." * 97 + "TOP" + "." * 600 + "low" + "." * 100 + "TOP"
    d = spark.createDataFrame([(1, chain), (2, clash), (3, None)], "doc_id int, text string")
    got = {}
    for r in excerpts.excerpts(d, ["KEY|TOP", "low"]).orderBy("doc_id", "nth").collect():
        got.setdefault(r["doc_id"], []).append((r["nth"], r["start"]))
    assert got == {1: [(1, 0), (2, 500), (3, 1000), (4, 1500), (5, 2000)], 2: [(1, 150), (2, 856)]}


def test_figures(spark):
    got = value(spark, excerpts.rental_values(F.col("t")), "賃貸等不動産の貸借対照表計上額は1,200百万円、時価は3,400百万円")
    assert (got["book"], got["fair"]) == (1200.0, 3400.0)
    assert value(spark, excerpts.rejoined_number(F.col("t")), "12,\n345") == 12345.0
    assert value(spark, F.struct(*excerpts.office_and_address(F.col("t"))), "本社 (東京都港区)") == ("本社", "東京都港区")
    cells = F.array(*[F.lit(x) for x in ("a", "1,0", "b", "2", "c", "－")])
    assert value(spark, excerpts.strided_sum(cells, 1, 2), "") == 12.0
    assert value(spark, excerpts.use_category(F.col("t")), "準工業地域") == "industrial"
    issues = excerpts.log_issues(F.lit(False), F.col("t"), F.array(F.lit("other")), F.lit(0.5))
    assert value(spark, issues, "ok name") == ["only_other", "deviation"]
    assert value(spark, excerpts.quality_grade(issues, ["deviation"]), "ok") == "FAIL"
    pages = spark.createDataFrame([(1, 2, "単一 セグメント"), (2, 11, "単一セグメント")], "doc_id int, page int, text string")
    assert {r["doc_id"]: r["single"] for r in excerpts.single_segment(pages, ["単一セグメント"]).collect()} == {1: True, 2: False}
    m = spark.createDataFrame([(1, "revenue", 100.0), (1, "profit", 5.0), (1, "x", 1.0)], "d int, field string, value double")
    f = spark.createDataFrame([(1, "revenue", 100.5), (1, "profit", 9.0)], "d int, field string, value double")
    assert {r["field"]: r["status"] for r in excerpts.mentions_against_facts(m, f, "d").collect()} == {"revenue": "agrees", "profit": "differs", "x": "no_fact"}
