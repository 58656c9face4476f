"""Operators on small rows: the cases that the driver tables do not have."""

import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import audit, checks, measures, merge, select, spatial, statements, text, tree
from ledgerline.sources import filings
from ledgerline.streaming import upsert


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_numbers(spark):
    cases = {"1,234": 1234.0, "△56": -56.0, "▲7.5": -7.5, "－": None, "N/A": None, "12%": 12.0, "8※1": 8.0, "x": None}
    for given, want in cases.items():
        assert one(spark, S.parse_number(F.col("t")), t=given) == want
    assert one(spark, S.parse_money(F.col("t")), t="1兆2,000億円") == 1.2e12
    assert one(spark, S.parse_money(F.col("t")), t="3百万円") == 3e6
    assert one(spark, S.camel_words(F.col("t")), t="NetSalesOfFYOne") == "Net Sales Of FY One"
    assert one(spark, S.document_id(F.col("t")), t="a_S100ABCD_x") == "S100ABCD"
    assert one(spark, S.ticker(F.col("t")), t="130A0") == "130A"
    assert one(spark, S.first_json(F.col("t")), t='<think>{no}</think> so {"a": 1} done') == '{"a": 1}'
    assert one(spark, S.plain_text(F.col("t")), t="<p>a &amp; b</p><script>x</script><br>c") == "a & b\nc"


def test_quarters(spark):
    got = {m: one(spark, S.fiscal_quarter(F.col("m"), 3), m=m) for m in (4, 6, 7, 12, 1, 3)}
    assert got == {4: 1, 6: 1, 7: 2, 12: 3, 1: 4, 3: 4}
    assert [one(spark, S.quarter_of_days(F.col("d")), d=d) for d in (90, 180, 270, 365)] == [1, 2, 3, None]


def test_contexts_and_canonical(spark):
    ranked = spark.createDataFrame([("CurrentYearDuration",), ("Prior1YearDuration",), ("CurrentYearDuration_NonConsolidatedMember",), ("CurrentYearDuration_XMember",), ("Other",)], "c string")
    got = [r[0] for r in ranked.select(select.context_rank(F.col("c"), ["CurrentYear", "Interim"])).collect()]
    assert got == [0, None, None, None, 2]
    facts = spark.createDataFrame([("d", "NetSales", 1.0), ("d", "Sales", 2.0), ("d", "Profit", None)], "doc string, tag string, value double")
    tags = spark.createDataFrame([("revenue", "Sales", 1, 0), ("revenue", "NetSales", 1, 1), ("profit", "Profit", 1, 0)], "field string, tag string, priority int, ordinal int")
    assert [tuple(r) for r in select.canonical_values(facts, tags, ["doc"]).collect()] == [("d", "revenue", 2.0)]


def test_shifted_lookup(spark):
    wanted = spark.createDataFrame([("a", 2020), ("b", 2020), ("c", 2020)], "k string, y int")
    store = spark.createDataFrame([("a", 2020, 1.0), ("a", 2019, 9.0), ("b", 2019, 2.0)], "k string, y int, v double")
    got = {r["k"]: (r["shift"], r["v"]) for r in select.shifted_lookup(wanted, store, "k", "y", "v", [0, -1, 1]).collect()}
    assert got == {"a": (0, 1.0), "b": (-1, 2.0), "c": (None, None)}


def test_checks(spark):
    c = lambda e, a: one(spark, checks.check(F.col("e").cast("double"), F.col("a").cast("double")), e=e, a=a)
    assert c(1e10, 1e10 + 2e6)["severity"] == "warning" or c(1e10, 1e10 + 2e6)["passed"]
    assert c(0.0, 999.0)["passed"] and not c(0.0, 1001.0)["passed"]
    assert c(1e9, 2e9)["severity"] == "error"
    r = one(spark, checks.repair_sum(F.lit(100000.0), F.lit(30000.0), F.lit(40000.0), F.array(F.lit(60000.0))))
    assert (r["total"], r["first"], r["second"]) == (100000.0, 60000.0, 40000.0)
    df = spark.createDataFrame([(1, 10.0, 6.0, 4.0)], "id int, total_assets double, total_liabilities double, total_equity double")
    assert [(x["check_name"], x["passed"]) for x in checks.statement_checks(df, ["id"]).collect()] == [("balance", True)]


def test_measures(spark):
    df = spark.createDataFrame([("a", 2018, 100.0), ("a", 2019, 110.0), ("a", 2021, 121.0)], "k string, y int, v double")
    assert [r["prev"] for r in measures.yoy(df, "k", "y", "v").orderBy("y").collect()] == [None, 100.0, None]
    assert abs(measures.cagr(df, "k", "y", "v", 2).first()["cagr"] - 4.8808848) < 1e-6
    x = spark.createDataFrame([(10.0, 0.0, 5.0)], "net_income double, total_equity double, revenue double")
    assert statements.derive(x, "jp").first()["roe"] is None and statements.derive(x, "us").first()["net_margin"] == 200.0


def test_time_window_join(spark):
    rows = spark.createDataFrame([(1, "u", dt.date(2024, 1, 10)), (2, "u", dt.date(2024, 2, 10))], "id int, k string, d date")
    other = spark.createDataFrame([("u", dt.date(2024, 1, 24))], "k string, d date")
    assert [r["id"] for r in audit.near_in_time(rows, other, "k", "d", 14).collect()] == [1]
    assert audit.near_in_time(rows, other, "k", "d", 13).count() == 0


def test_upserts(spark):
    schema = "k string, doc_id string, flash boolean, a double, b double"
    old = spark.createDataFrame([("x", "S1", False, 1.0, 2.0), ("y", "T9", True, 1.0, 2.0), ("z", "S5", False, 1.0, None)], schema)
    new = spark.createDataFrame([("x", "S2", False, 9.0, None), ("y", "S0", False, 5.0, None), ("z", "S4", False, 7.0, 7.0), ("w", "S1", False, 3.0, 3.0)], schema)
    got = {r["k"]: r["doc_id"] for r in merge.guarded_upsert(old, new, ["k"], ["a", "b"]).collect()}
    assert got == {"x": "S1", "y": "S0", "z": "S5", "w": "S1"}


def test_space(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert one(spark, spatial.in_polygon(F.lit(0.5), F.lit(0.5), square)) and not one(spark, spatial.in_polygon(F.lit(1.5), F.lit(0.5), square))
    t = spark.createDataFrame([(1, 35.0, 135.0, "r")], "id int, lat double, lon double, use string")
    p = spark.createDataFrame([(35.001, 135.0, 10.0, "r"), (35.002, 135.0, 20.0, "c"), (35.003, 135.0, 30.0, "other"), (36.0, 135.0, 99.0, "r")], "lat double, lon double, price double, use string")
    got = spatial.nearest_prices(t, p).first()
    assert got["neighbours"] == 2 and 10 < got["price"] < 20


def test_text(spark):
    assert one(spark, text.terms(F.col("t")), t="売上高Net 12") == ["売上", "高", "Net", "12"]
    d = spark.createDataFrame([(1, "aaa\n\nbbb\nccc"), (2, None), (3, "")], "doc_id int, text string")
    assert [(r["doc_id"], r["content"]) for r in text.paragraph_chunks(d, 7, 2).orderBy("doc_id", "chunk").collect()] == [(1, "aaa\nbbb"), (1, "ccc")]
    s = spark.createDataFrame([(1, "Item 1 x\nItem 2 y\nbody\nItem 1 longer text here\nItem 2 much longer than before")], "doc_id int, text string")
    assert {r["section"]: r["content"].strip() for r in text.sections(s).collect()} == {"Item 1": "longer text here", "Item 2": "much longer than before"}


def test_tree(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "d")], "parent string, child string")
    laid = tree.layout(e)
    assert [(r["id"], r["level"]) for r in laid.orderBy("path").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    kept = tree.pruned(laid, spark.createDataFrame([("c",)], "id string"))
    assert sorted(r["id"] for r in kept.collect()) == ["a", "b", "c"]


def test_archives(spark, tmp_path):
    folder = tmp_path / "2024" / "annual"
    folder.mkdir(parents=True)
    xml = '<xbrl xmlns:jp="urn:jp"><context id="CurrentYearDuration"><period><startDate>2023-04-01</startDate><endDate>2024-03-31</endDate></period></context><jp:Sales contextRef="CurrentYearDuration" unitRef="JPY" decimals="0">1,200</jp:Sales><jp:Name contextRef="FilingDate">Co</jp:Name></xbrl>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("XBRL/PublicDoc/a.xbrl", xml)
    (folder / "1234_S100ABCD.zip").write_bytes(buffer.getvalue())
    (folder / "9999_bad.zip").write_bytes(b"no archive")
    files = filings.archives(spark, str(tmp_path))
    assert {(r["code"], r["doc_type"], r["document"]) for r in files.collect()} == {("1234", "annual", "S100ABCD"), ("9999", "annual", None)}
    got = {(r["tag"], r["value"], r["value_text"], r["period_start"], r["period_end"], r["error"]) for r in filings.facts(files).collect()}
    assert got == {("Sales", 1200.0, "1,200", "2023-04-01", "2024-03-31", None), ("Name", None, "Co", None, None, None), (None, None, None, None, None, "no archive")}
    kinds = spark.createDataFrame([("a", "annual"), ("a", "quarterly"), ("a", "interim"), ("b", "quarterly")], "code string, doc_type string")
    assert sorted(map(tuple, filings.preferred(kinds, ["code"]).collect())) == [("a", "annual"), ("a", "interim"), ("b", "quarterly")]


def test_company_facts(spark, tmp_path):
    entry = {"fy": 2023, "fp": "FY", "start": "2023-01-01", "end": "2023-12-31", "filed": "2024-02-01", "val": 5.0}
    (tmp_path / "c.json").write_text(json.dumps({"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [entry, entry | {"end": "2022-12-31"}]}}}}}))
    rows = filings.company_facts(spark, str(tmp_path))
    assert rows.count() == 2
    e = rows.withColumn("days", F.datediff("end", "start")).withColumnRenamed("val", "value")
    assert select.annual_value(e, ["cik", "tag"]).first()["end"] == dt.date(2023, 12, 31)
    page = spark.createDataFrame([(1, '<ix:nonFraction name="a:B" contextRef="C" scale="6" sign="-">1,2<b>3</b></ix:nonFraction>')], "doc_id int, html string")
    assert filings.inline_facts(page).first()["value"] == -123e6


def test_stream_upsert(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    schema = "k string, doc_id int, v double"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upsert.stream_upsert(stream, store, state, ["k"], ["doc_id"], ["doc_id", "v"]).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in upsert.read_store(spark, store).collect())

    assert feed([("a", 2, 1.0), ("b", 1, 1.0)]) == [("a", 2, 1.0), ("b", 1, 1.0)]
    assert feed([("a", 1, 9.0), ("b", 3, 9.0)]) == [("a", 2, 1.0), ("b", 3, 9.0)]


def test_alias_inside_words(spark):
    aliases = [("ring", "jewel", 2), ("半導体", "chip", 2), ("半導体製造装置", "tool", 3), ("EV", "car", 3), ("ＥＶ 事業", "car_top", 2), ("silver ring", "silver", 3), ("gold-ring", "gold", 3)]
    texts = [(1, "Earring shop", None), (2, "先端半導体製造装置部門", None), (3, "ＥＶ事業", "半導体製造装置"), (4, "EVs", None), (5, "Silver  Rings", None), (6, "その他", "車載半導体"), (7, "GOLD RING", "silver ring"), (8, None, None), (9, "ri", None), (10, "部事業門ﾘﾝｸﾞ", None)]
    a = spark.createDataFrame(aliases, "alias string, category string, level int")
    t = spark.createDataFrame(texts, "id int, text string, description string")
    got = {r["id"]: (r["alias"], r["category"]) for r in select.longest_alias(t, a).collect()}
    assert got == {1: ("ring", "jewel"), 2: ("半導体製造装置", "tool"), 3: ("EV", "car"), 5: ("silver ring", "silver"), 6: ("半導体", "chip"), 7: ("gold-ring", "gold")}
    plain = {r["id"]: r["alias"] for r in select.longest_alias(t.select("id", "text"), a).collect()}
    assert plain == {1: "ring", 2: "半導体製造装置", 3: "EV", 5: "silver ring", 7: "gold-ring"}
    assert t.where("id = 10").select(select.normalized_segment(F.col("text"))).first()[0] == "リング"


def test_question_documents(spark):
    docs = [(1, "cover", 1, "s"), (2, "alpha risk", 2, "s"), (3, "beta beta risk", 3, "s"), (4, "gamma", 4, "s"), (5, "beta", 1, "other")]
    d = spark.createDataFrame(docs, "id int, text string, ordinal int, section string")
    q = spark.createDataFrame([(10, "beta risk"), (11, "nothing")], "id int, text string")
    run = lambda k, n: sorted((r["query_id"], r["place"], r["doc_id"]) for r in text.question_documents(d, q, "s", k, n).collect())
    assert run(3, 1) == [(10, 1, 1), (10, 2, 3), (10, 3, 2), (11, 1, 1), (11, 2, 2), (11, 3, 3)]
    assert run(9, 1) == [(10, 1, 1), (10, 2, 3), (10, 3, 2), (10, 4, 4), (11, 1, 1), (11, 2, 2), (11, 3, 3), (11, 4, 4)]
    assert run(2, 2) == [(10, 1, 1), (10, 2, 2), (11, 1, 1), (11, 2, 2)]
