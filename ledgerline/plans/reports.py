"""Queries of tables, reports and sources rendered from the driver tables and read back, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import reports, tables
from ledgerline.plans.star import query, table
from ledgerline.sources import filings


def rendered(spark, d):
    """A page for each nation: its suppliers in a table, the nation's name in one cell beside them all."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    amount = F.concat(F.format_number(F.floor(F.abs("s_acctbal")) + 1000, 0), F.lit(" ("), F.format_number(F.col("s_suppkey") + 100, 0), F.lit(")"))
    g = s.groupBy("n_nationkey", "n_name").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", F.concat(cell(F.concat(F.col("s_name"), F.lit(" 工場"))), cell(amount)).alias("h")))).alias("rows"))
    first = F.concat(F.lit('<td rowspan="'), F.size("rows").cast("string"), F.lit('">'), "n_name", F.lit("</td>"))
    body = F.array_join(F.transform("rows", lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(F.lit("")), r["h"], F.lit("</tr>"))), "")
    head = F.lit("<table><tr><th>セグメントの名称</th><th>事業所名 [千㎡]</th><th>土地 帳簿価額(千円)</th></tr>")
    return g.select(F.col("n_nationkey").cast("bigint").alias("page_id"), F.concat(F.lit("<p>x</p>"), head, body, F.lit("</table>")).alias("html"))


@query("""
SELECT n_nationkey::BIGINT AS page_id, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS INTEGER) AS row, n_name AS segment, s_name || ' 工場' AS office FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def spread_tables(spark, d):
    """A cell that spans all rows stands in each of them; data rows as maps by header."""
    r = tables.records(tables.spread_cells(rendered(spark, d)))
    return r.select("page_id", "row", F.col("values")["セグメントの名称"].alias("segment"), F.col("values")["事業所名 [千㎡]"].alias("office"))


@query("""
SELECT n_nationkey::BIGINT AS page_id, s_name || ' 工場' AS office, round((floor(abs(s_acctbal)) + 1000) * 0.001, 6) AS land, (s_suppkey + 100) * 1000.0::DOUBLE AS area FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def facility_tables(spark, d):
    """Offices with land in millions and square metres, by the table's own units."""
    f = tables.facility_rows(tables.spread_cells(rendered(spark, d)))
    return f.select("page_id", "office", F.round("land", 6).alias("land"), "area")


@query("""
SELECT n_regionkey::BIGINT AS page_id, 'parallel' AS layout, n_name AS segment, 'revenue' AS measure, n_nationkey * 1e3 + 5 AS value FROM nation
UNION ALL SELECT n_regionkey, 'headed', n_name, 'profit', -(n_nationkey + 1e0) FROM nation UNION ALL SELECT n_regionkey, 'stacked', n_name, m, CASE m WHEN 'revenue' THEN n_nationkey * 1e3 + 5 ELSE n_nationkey + 1e0 END FROM nation, (VALUES ('revenue'), ('profit')) t(m)""")
def segment_layouts(spark, d):
    """The three ways in which reports print segments, read into one form."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.regexp_replace("n_name", " ", "").alias("name")))).alias("n"))
    td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    tr = lambda *c: F.concat(F.lit("<tr>"), *c, F.lit("</tr>"))
    joined = lambda f, sep="": F.array_join(F.transform("n", f), sep)
    sales = lambda x: F.format_number(x["n_nationkey"] * 1000 + 5, 0)
    loss, profit = (lambda x: F.concat(F.lit("△"), (x["n_nationkey"] + 1).cast("string"))), (lambda x: (x["n_nationkey"] + 1).cast("string"))
    parallel = F.concat(F.lit("<table>"), tr(td(F.lit("セグメント")), td(F.lit("売上高"))), tr(td(joined(lambda x: x["name"], "<br>")), td(joined(sales, "<br>"))), F.lit("</table>"))
    headed = F.concat(F.lit("<table>"), tr(td(F.lit("")), joined(lambda x: td(x["name"])), td(F.lit("合計"))), tr(td(F.lit("セグメント利益")), joined(lambda x: td(loss(x))), td(F.lit("9"))), F.lit("</table>"))
    stacked = F.concat(F.lit("<table>"), tr(td(F.lit("区分")), td(F.lit("売上高")), td(F.lit("営業利益"))), joined(lambda x: tr(td(x["name"]), td(sales(x)), td(profit(x)))), tr(td(F.lit("調整額")), td(F.lit("1")), td(F.lit("2"))), F.lit("</table>"))
    kinds = {"revenue": "売上", "profit": "利益"}
    page = lambda html: tables.spread_cells(n.select("page_id", html.alias("html")))
    shape = lambda df, name: df.select("page_id", F.lit(name).alias("layout"), "segment", "measure", "value")
    a = tables.parallel_segments(page(parallel)).select("page_id", F.col("name").alias("segment"), F.lit("revenue").alias("measure"), "value")
    out = shape(a, "parallel").unionByName(shape(tables.headed_segments(page(headed), kinds), "headed")).unionByName(shape(tables.stacked_segments(page(stacked), kinds), "stacked"))
    names = table(spark, d, "nation").select(F.regexp_replace("n_name", " ", "").alias("segment"), "n_name")
    return out.join(names, "segment").select("page_id", "layout", F.col("n_name").alias("segment"), "measure", "value")


@query("""
WITH c AS (SELECT p_partkey, [CAST(p_size * 100 AS VARCHAR), '2024年3月31日現在', '(1) 提出会社', '(' || p_partkey || ',500)', '12', '土地'][p_partkey % 6 + 1] AS t, p_partkey % 6 AS k, p_size FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN true WHEN 3 THEN true ELSE false END AS figure, k = 5 AS head FROM c""")
def table_cells_kinds(spark, d):
    """Which cells are figures, and which rows are headers once more."""
    k = F.col("p_partkey") % 6
    t = F.get(F.array((F.col("p_size") * 100).cast("string"), F.lit("2024年3月31日現在"), F.lit("(1) 提出会社"), F.concat(F.lit("("), F.col("p_partkey").cast("string"), F.lit(",500)")), F.lit("12"), F.lit("土地")), k)
    return table(spark, d, "part").select("p_partkey", tables.numeric_cell(t).alias("figure"), tables.subheader(F.array(t)).alias("head"))


REPORT = """rp AS (
  SELECT o_orderkey, o_totalprice AS cur, o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.5 ELSE 0.9 END AS prev, CASE WHEN o_orderkey % 3 = 0 THEN 99.0 END AS said, o_orderkey % 5 = 0 AS nosec, o_orderkey % 7 = 0 AS deal, o_totalprice * CASE o_orderkey % 6 WHEN 0 THEN 1.05 ELSE 1 END AS store, o_orderkey % 13 AS risks FROM orders),
sg AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_extendedprice) AS kinds, sum(CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE AS s FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1),
fl AS (SELECT o_orderkey, unnest(list_filter([
   CASE WHEN nosec THEN 'L1 missing esg_governance' END, CASE WHEN n IS NULL THEN 'L1 no segments' END,
   CASE WHEN abs(s - cur) / cur * 100 > 5 THEN 'L2 segment sum' END, CASE WHEN abs(s - cur) / cur * 100 > 2 AND abs(s - cur) / cur * 100 <= 5 THEN 'L2 segment sum' END,
   CASE WHEN abs((cur - prev) / prev * 100 - coalesce(said, (cur - prev) / prev * 100)) > 1 THEN 'L2 revenue growth' END, CASE WHEN n > 1 AND kinds = 1 THEN 'L2 one revenue' END,
   CASE WHEN abs(cur - store) / abs(store) > 0.01 THEN 'L3 revenue differs' END, CASE WHEN coalesce(said, (cur - prev) / prev * 100) > 50 AND NOT deal THEN 'L4 revenue leap' END, CASE WHEN risks > 10 THEN 'L5 many high risks' END], lambda x: x IS NOT NULL)) AS what FROM rp LEFT JOIN sg ON l_orderkey = o_orderkey)"""


@query(f"WITH {REPORT} SELECT what, count(*) AS n FROM fl GROUP BY 1")
def report_layers(spark, d):
    """Five layers of checks over orders as reports and their lines as segments; findings counted."""
    k = F.col("o_orderkey")
    li = table(spark, d, "lineitem").where("l_extendedprice > 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("revenue"), F.lit(None).cast("double").alias("yoy"))).alias("segments"))
    cur = F.col("o_totalprice")
    prev = cur * F.when(k % 4 == 0, 0.5).otherwise(0.9)
    figure = lambda a, b, y: F.struct(a.alias("current"), b.alias("previous"), y.alias("yoy"))
    yoy = F.coalesce(F.when(k % 3 == 0, 99.0), (cur - prev) / prev * 100)
    fine = figure(F.lit(100.0), F.lit(90.0), F.lit(100 / 0.9 - 100))
    full = F.create_map(*[x for s in reports.SECTIONS for x in (F.lit(s), F.when((k % 5 == 0) & F.lit(s == "esg_governance"), "").when(F.lit(s == "md_and_a") & (k % 7 == 0), "大型M&A").otherwise("text"))])
    r = table(spark, d, "orders").join(li, "o_orderkey", "left").select(
        k, full.alias("sections"), F.create_map(F.lit("revenue"), figure(cur, prev, yoy), F.lit("operating_profit"), fine, F.lit("net_profit"), fine).alias("figures"), "segments",
        F.create_map(F.lit("revenue"), cur * F.when(k % 6 == 0, 1.05).otherwise(1.0)).alias("store"), F.lit("").alias("drivers"), (k % 13).alias("high_risks"), F.lit(None).cast("double").alias("guidance_yoy"))
    x = reports.layered_checks(r).select(F.explode("findings").alias("f"))
    return x.groupBy(F.concat_ws(" ", "f.layer", "f.what").alias("what")).agg(F.count("*").alias("n"))


def report_text(k, v):
    growth = lambda n: F.concat(F.lit("- 売上高: 10百万円 ("), n, F.lit("%)\n"))
    a, b = F.concat(F.lit("+"), (k % 9).cast("string"), F.lit(".5")), F.when(k % 2 == 0, F.concat(F.lit("+"), (k % 9).cast("string"), F.lit(".5"))).otherwise(F.lit("-3"))
    return F.concat(F.lit("# 会社\n## 数字で見る2022年\n営業利益: "), F.when(k % 4 == 0, F.lit("N/A")).otherwise(F.concat(v.cast("string"), F.lit("億円"))), F.lit(" (前年比)\nEBITDA: 5億円\n## セグメント別ハイライト\n"), growth(a), growth(b), growth(a), F.lit("## 終わり\n"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'N/A' ELSE p_size || '億円' END AS operating_income, '5億円' AS ebitda, p_partkey % 9 + 0.5::DOUBLE AS first_growth, array_to_string(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'operating_income N/A' END, CASE WHEN p_partkey % 2 = 0 THEN 'one growth' END], lambda x: x IS NOT NULL), ',') AS issues FROM part""")
def report_scrape(spark, d):
    """Scoreboard, growth of segments and what is wrong with them, from report texts."""
    p = table(spark, d, "part").select("p_partkey", report_text(F.col("p_partkey"), F.col("p_size")).alias("t"))
    board, growth = reports.scoreboard(F.col("t")), reports.segment_growths(F.col("t"))
    return p.select("p_partkey", board["operating_income"].alias("operating_income"), board["ebitda"].alias("ebitda"), growth[0].alias("first_growth"), F.array_join(reports.report_issues(F.col("t")), ",").alias("issues"))


@query("""
SELECT p_partkey, 0 AS pos, CASE WHEN p_partkey % 3 = 0 THEN '売上高: ' || format('{:,}', p_partkey + 2000) || '億円（前年比）' ELSE '売上高: ' || (p_partkey + 1000) || '億円（前年比）' END AS line, p_partkey % 3 = 0 AS changed FROM part WHERE p_partkey < 8000
UNION ALL SELECT p_partkey, 1, '#### 部門', false FROM part WHERE p_partkey < 8000 UNION ALL SELECT p_partkey, 2, '売上高: 7億円', false FROM part WHERE p_partkey < 8000""")
def rewritten_figures(spark, d):
    """A wrong headline figure is brought to the fact; the segment's own line stays."""
    p, k = table(spark, d, "part").where("p_partkey < 8000"), F.col("p_partkey")
    head = F.concat(F.lit("売上高: "), (k + 1000).cast("string"), F.lit("億円（前年比）"))
    lines = p.select(k, F.posexplode(F.array(head, F.lit("#### 部門"), F.lit("売上高: 7億円"))).alias("pos", "line"))
    facts = p.select(k, F.lit("revenue").alias("field"), (F.when(k % 3 == 0, k + 2000).otherwise(k + 1000) * 1e8).alias("value"))
    return reports.rewritten_figures(lines, facts, "p_partkey", {"revenue": "売上高"})


@query("""
WITH t AS (SELECT conv_id, turn, role, left(text, 80) AS s, CASE WHEN length(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS section FROM conversations)
SELECT conv_id AS doc_id, turn, role, s AS answer FROM t""")
def scored_texts(spark, d):
    """Texts handed to a caller's scorer, here one that keeps a beginning."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", "text")
    return reports.scored(c, "text", lambda texts: [t[:80] for t in texts]).select("doc_id", "turn", "role", "answer")


@query("""
WITH t AS (SELECT conv_id AS doc_id, CASE WHEN length(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS section, string_agg(left(text, 6000), chr(10) ORDER BY turn, role) AS body FROM (SELECT conv_id, turn, role, text FROM conversations) GROUP BY 1, 2),
s AS (SELECT doc_id, section, length(left(body, 6000)) || ' chars' AS summary FROM t)
SELECT doc_id, 'section' AS level, section, summary FROM s UNION ALL SELECT doc_id, 'document', '', length(string_agg(summary, chr(10) ORDER BY section)) || ' chars' FROM s GROUP BY 1""")
def summary_tree(spark, d):
    """Chunks to sections to documents, with stand-ins for the model."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.struct("turn", "role").alias("chunk"), F.left("text", F.lit(6000)).alias("content"))
    kind = lambda texts: ["even" if len(t) % 2 == 0 else "odd" for t in texts]
    return reports.summary_tree(c, kind, lambda texts: [f"{len(t)} chars" for t in texts])


@query()
def page_chunks(spark, d):
    """A conversation's turns as pages, packed by tokens."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 10 + F.when(F.col("role") == "user", 0).otherwise(1)).alias("page"), "text")
    return reports.page_chunks(c, 100, 10).select("doc_id", "chunk", "first_page", "last_page", F.md5(F.col("content").cast("binary")).alias("md5"))


@query()
def item_sections(spark, d):
    """Annual reports made of documents: contents, then items; every third without a heading, every fifth by keyword."""
    k, t = F.col("doc_id"), F.left(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), F.lit(4000))
    contents = F.lit("TABLE OF CONTENTS\n" + "." * 90 + "\nPART I\nItem 1. Business 3\nItem 1A. Risk Factors 9\nPART II\nItem 7. MD&A 20\n")
    body = F.concat(F.lit("\nPART I\nItem 1. Business\n"), t, F.lit("\nItem 1A. Risk Factors\n"), t, F.lit("\nItem 7. Discussion\n"), t, F.lit("\nItem 8. Statements\n"), t)
    keyed = F.concat(F.lit("Business Overview 3\n"), t, F.lit("\nRISK FACTORS\n"), t, F.lit("\nManagement's Discussion and Analysis of it\n"), t)
    text = F.when(k % 3 == 0, t).when(k % 5 == 0, keyed).otherwise(F.concat(contents, body))
    out = reports.item_sections(table(spark, d, "documents").select("doc_id", text.alias("text")))
    return out.select("doc_id", "nth", "section", F.length("content").alias("chars"))


@query("""
SELECT s_suppkey, replace('山田 太郎' || s_suppkey, ' ', '') AS name, 2 AS posts, '1990年4月' AS joined, s_name || ' 入社' AS first_post FROM supplier""")
def officer_rows(spark, d):
    """Officers' names and careers from cells."""
    t = F.concat(F.lit("山田　太郎"), F.col("s_suppkey").cast("string"), F.lit("（やまだ）1965年1月1日生\n1990年4月  "), "s_name", F.lit(" 入社\n2010年6月 取締役"))
    name, career = reports.officers(t)
    return table(spark, d, "supplier").select("s_suppkey", name.alias("name"), F.size(career).alias("posts"), career[0]["date"].alias("joined"), career[0]["what"].alias("first_post"))


@query("""SELECT DISTINCT '東京都港区' || p_size || '番地' AS address FROM part WHERE p_partkey % 3 = 0""")
def real_addresses(spark, d):
    k = F.col("p_partkey") % 3
    a = F.when(k == 0, F.concat(F.lit(" 東京都港区"), F.col("p_size").cast("string"), F.lit("番地"))).when(k == 1, "その他の市").otherwise("Texas")
    return reports.real_addresses(table(spark, d, "part").select(a.alias("address")))


@query("""
SELECT c_custkey AS cik, 'us-gaap' AS namespace, o_orderpriority AS tag, 'USD' AS unit, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(o_orderdate AS DATE) AS "end", o_totalprice AS val FROM orders JOIN customer ON c_custkey = o_custkey""")
def company_facts(spark, d):
    """Company facts written as JSON and read back."""
    o = table(spark, d, "orders")
    e = F.struct(F.year("o_orderdate").alias("fy"), F.lit("FY").alias("fp"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"))
    g = o.groupBy("o_custkey", "o_orderpriority").agg(F.collect_list(e).alias("e"))
    g = g.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.struct(F.create_map(F.lit("USD"), F.col("e")).alias("units"))))).alias("tags"))
    js = g.select(F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.create_map(F.lit("us-gaap"), F.col("tags")).alias("facts"))).alias("j"))
    return filings.fact_entries(js.select(F.from_json("j", filings.COMPANY_FACTS).alias("x")).select("x.*")).select("cik", "namespace", "tag", "unit", "fy", "end", "val")


@query("""SELECT l_orderkey AS doc_id, 'jp:' || l_returnflag AS name, 'Current' AS context, (floor(l_extendedprice) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * 1000)::DOUBLE AS value FROM lineitem""")
def inline_facts(spark, d):
    """Inline figures with scale and sign."""
    tag = F.concat(F.lit('<ix:nonFraction name="jp:'), "l_returnflag", F.lit('" contextRef="Current" scale="3"'), F.when(F.col("l_linenumber") % 2 == 0, ' sign="-"').otherwise(""), F.lit(">"), F.format_number(F.floor("l_extendedprice"), 0), F.lit("</ix:nonFraction>"))
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.collect_list(tag), "<br/>").alias("html"))
    return filings.inline_facts(pages)


@query("""SELECT o_custkey AS cik, o_orderpriority AS form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "reportDate", CAST(o_orderkey AS VARCHAR) AS accession FROM orders""")
def filing_index(spark, d):
    """Parallel arrays of a filings list as rows."""
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(F.struct("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderkey").cast("string").alias("key"))).alias("x"))
    return filings.filing_index(g.select("cik", F.col("x.o_orderpriority").alias("form"), F.col("x.day").alias("reportDate"), F.col("x.key").alias("accession")))


@query("""SELECT 35 + s_suppkey / 100.0::DOUBLE AS lat, 135 + s_nationkey / 10.0::DOUBLE AS lon, s_acctbal AS price, CASE WHEN s_suppkey % 2 = 0 THEN '住宅' ELSE '商業' END AS use FROM supplier""")
def geo_points(spark, d):
    """Points of a feature collection."""
    f = F.struct(F.struct(F.array(135 + F.col("s_nationkey") / 10.0, 35 + F.col("s_suppkey") / 100.0).alias("coordinates")).alias("geometry"), F.create_map(F.lit("p"), F.col("s_acctbal").cast("string"), F.lit("u"), F.when(F.col("s_suppkey") % 2 == 0, "住宅").otherwise("商業")).alias("properties"))
    js = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(f).alias("features"))).alias("j"))
    return filings.features(js.select(F.from_json("j", filings.FEATURES).alias("x")).select("x.*"), "p", "u")


@query("""SELECT c_custkey AS code, 'Name ' || c_custkey AS name, (c_custkey % 500) * 1000.0::DOUBLE AS revenue, 2024 AS year FROM customer""")
def api_statements(spark, d):
    """Statement rows of an API: strings in thousands, Minguo years, two names for one field."""
    c = table(spark, d, "customer").select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("公司代號"), F.concat(F.lit("Name "), F.col("c_custkey").cast("string")).alias("公司名稱"), F.lit("113").alias("年度"), F.when(F.col("c_custkey") % 2 == 0, F.format_number(F.col("c_custkey") % 500, 0)).alias("營業收入"), F.when(F.col("c_custkey") % 2 == 1, F.format_number(F.col("c_custkey") % 500, 0)).alias("收益"))).alias("j"))
    return filings.statement_rows(c, "j", {"revenue": ["營業收入", "收益"]})


@query("""SELECT o_orderkey AS id, lpad(CAST(o_custkey AS VARCHAR), 4, '0') AS ticker, 'f' || o_orderkey || '.zip' AS file FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_custkey < 10000""")
def flash_lists(spark, d):
    """Rows of a day's list page: results with an archive behind them."""
    k = F.col("o_orderkey")
    row = F.concat(F.lit("<tr><td>"), F.lpad(F.col("o_custkey").cast("string"), 4, "0"), F.lit("0</td><td>"), F.when(k % 2 == 0, "決算短信〔日本基準〕").otherwise("人事異動"), F.lit("</td><td>"), F.when(k % 3 != 0, F.concat(F.lit('<a href="f'), k.cast("string"), F.lit('.zip">XBRL</a>'))).otherwise(F.lit("")), F.lit("</td></tr>"))
    pages = table(spark, d, "orders").where("o_custkey < 10000").select(k.alias("page_id"), F.concat(F.lit("<table>"), row, F.lit("</table>")).alias("html"))
    return filings.flash_list(pages, "決算短信").select(F.col("page_id").alias("id"), "ticker", "file")


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END, s_nationkey)::DOUBLE AS per, CASE WHEN s_suppkey % 3 = 0 THEN 1.5 END::DOUBLE AS pbr FROM supplier""")
def valuations(spark, d):
    """Sector figures under several names, joined to companies."""
    from ledgerline.operators import markets

    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    v = s.select(k, F.when(k % 2 == 0, F.col("s_acctbal")).alias("PER"), F.col("s_nationkey").cast("double").alias("PEratio"), F.when(k % 3 == 0, 1.5).alias("PBratio"))
    return s.select(k).join(markets.renamed(v, {"per": ["PER", "PEratio"], "pbr": ["PBratio", "PBR"]}), "s_suppkey", "left")
