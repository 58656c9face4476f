"""Queries of selections, merges and audits over the star tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import audit, classify, excerpts, facilities, filters, markets, select, spatial, text
from ledgerline.plans.star import query, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""
SELECT l_orderkey, l_returnflag, value, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY value IS NULL, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM (SELECT *, CASE WHEN l_linenumber % 3 <> 1 THEN l_extendedprice END AS value FROM lineitem)) WHERE n = 1""")
def fact_first_wins(spark, d):
    """Lines as facts, flags as tags: numbers before texts, then the order of lines."""
    f = table(spark, d, "lineitem").withColumn("value", F.when(F.col("l_linenumber") % 3 != 1, F.col("l_extendedprice")))
    out = select.first_wins(f, "l_orderkey", "l_returnflag", [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    return out.select("l_orderkey", "l_returnflag", "value", "l_linenumber")


def tagged(spark, d):
    """(o_custkey, tag, context, value): a customer's orders by priority and status."""
    context = F.when(F.col("o_orderstatus") == "F", "CurrentYearInstant").when(F.col("o_orderstatus") == "O", "CurrentYearDuration").otherwise("Prior1YearDuration")
    return table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("tag"), context.alias("context")).agg((F.max("o_totalprice") - 200000).alias("value"))


TAGGED = """tg AS (SELECT o_custkey, o_orderpriority AS tag, CASE o_orderstatus WHEN 'F' THEN 'CurrentYearInstant' WHEN 'O' THEN 'CurrentYearDuration' ELSE 'Prior1YearDuration' END AS context, max(o_totalprice) - 200000 AS value FROM orders GROUP BY 1, 2, 3)"""


@query(f"""WITH {TAGGED}
SELECT o_custkey, arg_min(value, {{'t': CASE tag WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, 'v': value}}) AS revenue FROM tg WHERE value > 0 AND tag IN ('5-LOW', '1-URGENT', '2-HIGH') GROUP BY 1""")
def first_positive_tag(spark, d):
    """By list order alone, positive figures only."""
    return select.first_positive(tagged(spark, d), ["5-LOW", "1-URGENT", "2-HIGH"], ["o_custkey"], "revenue")


@query(f"""WITH {TAGGED}, m(field, tag, priority, ordinal, kind) AS (VALUES ('stock', '1-URGENT', 1, 0, 'Instant'), ('stock', '2-HIGH', 2, 1, 'Instant'), ('flow', '1-URGENT', 1, 0, 'Duration'), ('flow', '5-LOW', 1, 1, 'Duration'))
SELECT o_custkey, field, arg_min(value, {{'p': priority, 'o': ordinal, 'v': value}}) AS value FROM tg JOIN m USING (tag) WHERE contains(context, 'CurrentYear') AND contains(context, kind) GROUP BY 1, 2""")
def current_year_values(spark, d):
    """Contexts of the current year and of the field's kind."""
    m = spark.createDataFrame([("stock", "1-URGENT", 1, 0, True), ("stock", "2-HIGH", 2, 1, True), ("flow", "1-URGENT", 1, 0, False), ("flow", "5-LOW", 1, 1, False)], "field string, tag string, priority int, ordinal int, instant boolean")
    return select.current_values(tagged(spark, d), m, ["o_custkey"])


@query("""
WITH v AS (SELECT o_custkey, o_orderpriority AS tag, CASE o_orderstatus WHEN 'F' THEN 'ifrs-full' WHEN 'O' THEN 'us-gaap' ELSE 'dei' END AS namespace, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'shares' ELSE 'EUR' END AS unit, max(o_totalprice) AS value FROM orders GROUP BY ALL),
c(field, tag, ordinal) AS (VALUES ('a', '3-MEDIUM', 0), ('a', '1-URGENT', 1), ('b', '2-HIGH', 0))
SELECT o_custkey, field, arg_min(value, {'o': ordinal, 'n': CASE namespace WHEN 'us-gaap' THEN 1 ELSE 2 END, 'u': CASE unit WHEN 'USD' THEN 1 ELSE 2 END, 'v': value}) AS value
FROM v JOIN c USING (tag) WHERE namespace <> 'dei' AND unit <> 'EUR' GROUP BY 1, 2""")
def concept_values(spark, d):
    """Tags in list order, then namespaces, then units."""
    ns = F.when(F.col("o_orderstatus") == "F", "ifrs-full").when(F.col("o_orderstatus") == "O", "us-gaap").otherwise("dei")
    unit = F.when(F.col("o_orderkey") % 3 == 0, "USD").when(F.col("o_orderkey") % 3 == 1, "shares").otherwise("EUR")
    v = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("tag"), ns.alias("namespace"), unit.alias("unit")).agg(F.max("o_totalprice").alias("value"))
    c = spark.createDataFrame([("a", "3-MEDIUM", 0), ("a", "1-URGENT", 1), ("b", "2-HIGH", 0)], "field string, tag string, ordinal int")
    return select.concept_values(v, c, ["o_custkey"])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN c_acctbal * 2 WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS revenue, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 1.0 END::DOUBLE AS profit FROM customer""")
def parent_only_retry(spark, d):
    """Every third company has no consolidated figure; the parent's own stands in, if there is one."""
    k, c = F.col("c_custkey"), table(spark, d, "customer")
    whole = c.select(k, F.when(k % 3 != 0, F.col("c_acctbal")).alias("revenue"), F.when((k % 3 != 0) & (k % 5 == 0), 1.0).alias("profit"))
    own = c.select(k, F.when(k % 2 == 0, F.col("c_acctbal") * 2).alias("revenue"), F.lit(None).cast("double").alias("profit"))
    return markets.with_parent_only_retry(whole, own, ["c_custkey"], ["revenue", "profit"])


def line_facts(spark, d):
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    tag = F.when(n % 4 == 0, "OrdinaryIncome").when(n % 4 == 1, "ProfitIFRS").otherwise("Merchandise")
    full = F.when(flag == "R", F.concat(F.lit("jpigp_cor:"), tag)).when(flag == "A", F.concat(F.lit("jppfs_cor:"), tag))
    context = F.when(F.col("l_linestatus") == "F", "CurrentYearInstant").when(n % 2 == 0, "CurrentYearInstant_NonConsolidatedMember").otherwise("Prior1YearInstant")
    return table(spark, d, "lineitem").select("l_orderkey", tag.alias("tag"), full.alias("full_tag"), context.alias("context"), F.when(n % 5 != 0, F.col("l_extendedprice")).alias("value"))


LINE_FACTS = """lf AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 'jpigp_cor:' || tag WHEN 'A' THEN 'jppfs_cor:' || tag END AS full_tag FROM (SELECT l_orderkey, l_returnflag, CASE l_linenumber % 4 WHEN 0 THEN 'OrdinaryIncome' WHEN 1 THEN 'ProfitIFRS' ELSE 'Merchandise' END AS tag,
  CASE WHEN l_linestatus = 'F' THEN 'CurrentYearInstant' WHEN l_linenumber % 2 = 0 THEN 'CurrentYearInstant_NonConsolidatedMember' ELSE 'Prior1YearInstant' END AS context, CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice END AS value FROM lineitem))"""


@query(f"""WITH {LINE_FACTS}
SELECT l_orderkey FROM lf GROUP BY 1 HAVING bool_or(value IS NOT NULL AND (contains(coalesce(full_tag, ''), 'jpigp') OR (full_tag IS NULL AND contains(tag, 'IFRS')))) AND NOT bool_or(tag = 'OrdinaryIncome' AND value IS NOT NULL AND NOT contains(context, 'NonConsolidated'))""")
def foreign_ordinary_income(spark, d):
    return markets.foreign_ordinary_income(line_facts(spark, d), "l_orderkey")


@query(f"""WITH {LINE_FACTS}
SELECT l_orderkey, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS inventories FROM lf WHERE tag IN ('Merchandise', 'RawMaterials') AND contains(context, 'Instant') AND NOT starts_with(context, 'Prior') AND value IS NOT NULL GROUP BY 1""")
def component_sums(spark, d):
    return markets.component_sum(line_facts(spark, d), "l_orderkey", ["Merchandise", "RawMaterials"], "inventories")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'shifted' END AS layout, p_retailprice * CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 2 END AS assets FROM part WHERE p_partkey % 3 <> 2""")
def statement_layouts(spark, d):
    """Columns read in place, shifted by one, or not at all: what is not read goes with its balance sheet."""
    k, v = F.col("p_partkey"), F.col("p_retailprice") * 1000
    cells = F.when(k % 3 == 0, F.array(v, v * 0.6, v * 0.4, v * 9)).when(k % 3 == 1, F.array(F.lit(7.0), v, v * 0.6, v * 0.4)).otherwise(F.array(v, v, v, v * 5))
    p = table(spark, d, "part").select(k, cells.alias("c"))
    rows = p.select(k, markets.layout(tuple(F.col("c")[i] for i in (0, 1, 2)), tuple(F.col("c")[i] for i in (1, 2, 3))).alias("layout"))
    sheets = table(spark, d, "part").select(k, (F.col("p_retailprice") * F.when(k % 3 == 0, 1).otherwise(2)).alias("assets"))
    kept, other = markets.drop_unread(rows, sheets, ["p_partkey"])
    return kept.join(other, "p_partkey")


@query("""
SELECT p_partkey, CAST(p_partkey % 100 + 1911 + CASE WHEN p_partkey % 100 < 1911 THEN 0 ELSE -1911 END AS BIGINT) AS year, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_size END * 1000 AS revenue, CAST(p_size AS DOUBLE) AS eps FROM part""")
def field_aliases(spark, d):
    """A field under either of two names, in thousands but for the figure a share, in Minguo years."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, (k % 100).alias("y"), F.when(k % 2 == 0, F.col("p_retailprice")).alias("sales"), F.col("p_size").cast("double").alias("turnover"), F.col("p_size").cast("double").alias("eps"))
    out = markets.renamed(p, {"revenue": ["sales", "turnover", "income"], "year": ["y"]})
    return markets.from_thousands(out, ["revenue", "eps"]).withColumn("year", markets.gregorian(F.col("year")))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice WHEN p_size + coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END, 0) <> 0 THEN p_size + coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END, 0) END AS total,
  CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_retailprice END::DOUBLE AS assets FROM part""")
def segment_figures(spark, d):
    """A segment's total, from its parts where it is missing or 0; a stock figure read at an instant, else over a period."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    p = table(spark, d, "part").select(k, size.alias("revenue_external"), F.when(k % 3 == 0, F.col("p_retailprice")).alias("revenue_internal"), F.when(k % 4 == 0, F.col("p_retailprice")).otherwise(F.lit(0.0)).alias("revenue_total"), F.when(F.col("p_size") % 2 == 0, size).otherwise(F.lit(0.0)).alias("assets_instant"), F.col("p_retailprice").alias("assets_duration"))
    out = markets.instant_or_duration(markets.segment_values(p), ["assets"], [])
    return out.select(k, F.col("revenue_total").alias("total"), "assets")


@query("""
WITH a AS (SELECT s_suppkey, s_acctbal AS bal, s_nationkey AS nat FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 10 END AS bal FROM supplier)
SELECT s_suppkey, a.bal AS first_bal, a.nat AS first_nat, b.bal AS second_bal, coalesce(b.bal, a.bal) AS bal, a.nat AS nat FROM a FULL JOIN b USING (s_suppkey)""")
def merged_sheets(spark, d):
    """Two sheets: the later one wins where it is filled, and both stay under their names."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    a = s.where(k % 2 == 0).select(k, F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nat"), F.lit("x").alias("nat_note"))
    return markets.merge_sheets([("first", a), ("second", s.select(k, F.when(k % 3 == 0, F.col("s_acctbal") * 10).alias("bal")))], ["s_suppkey"], ("_note",))


@query("""
SELECT o_orderkey AS doc_id, o_custkey AS code FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_custkey % 10 <> 0""")
def eligible_filings(spark, d):
    """Wanted kinds, a period end, listed, not excluded."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("doc_type"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("period_end"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), "c_mktsegment")
    return audit.eligible(o, ["1-URGENT", "2-HIGH"], c.where("c_mktsegment = 'BUILDING'"), c.where("code % 10 = 0")).select("doc_id", "code")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NO_ZIP' ELSE 'OK' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN '/base/' || year(o_orderdate) || '/annual/1301_x_S100' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '_' || o_orderkey || '.zip' END AS path FROM orders WHERE o_orderkey < 10000""")
def archived_filings(spark, d):
    """Expected documents and the archives that carry their ids in the right year's folder."""
    o = table(spark, d, "orders").where("o_orderkey < 10000").withColumns({"doc_id": F.concat(F.lit("S100"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")), "year": F.year("o_orderdate")})
    at = lambda y: F.concat(F.lit("/base/"), y.cast("string"), F.lit("/annual/1301_x_"), "doc_id", F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".zip"))
    paths = o.select(at(F.when(F.col("o_orderkey") % 3 == 0, F.col("year") + 1).otherwise(F.col("year"))).alias("path"))
    return audit.archived(o.select("o_orderkey", "doc_id", "year"), paths).select("o_orderkey", "status", "path")


@query("""
WITH f AS (SELECT p_partkey, regexp_replace(lower(p_name), '[\\s,.]', '', 'g') AS f FROM part), n AS (SELECT unnest(['redwidget', 'ring', 'thesmallgadgetcompany']) AS n)
SELECT DISTINCT p_partkey FROM f, n WHERE contains(f, n) OR contains(n, f)""")
def company_name_matches(spark, d):
    n = spark.createDataFrame([("Red Widget",), ("RING",), ("The small gadget company",)], "name string")
    return filters.name_matches(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), n).select("p_partkey").distinct()


@query("""SELECT DISTINCT lpad(CAST(c_custkey % 500 AS VARCHAR), 4, '0') AS ticker FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def listed_tickers(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lpad((F.col("c_custkey") % 500).cast("string"), 4, "0"), F.lit("0")).alias("code"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "上場").otherwise("非上場企業").alias("market"))
    return filters.listed(c.withColumn("market", F.when(F.col("market") == "上場", "上場").otherwise("未公開")))


@query("""SELECT o_orderkey, floor(o_totalprice * 1000) AS unit_price FROM orders WHERE o_orderstatus = 'F' AND floor(o_totalprice * 1000) > 0 AND floor(o_totalprice * 1000) <= 1e8""")
def land_deals(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "宅地(土地と建物)").otherwise("林地").alias("kind"), F.when(F.col("o_orderkey") % 7 < 9, F.format_number(F.floor(F.col("o_totalprice") * 1000), 0)).alias("unit_price"))
    return filters.land_deals(o).select("o_orderkey", "unit_price")


@query("""
WITH s AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS fy, max(o_totalprice) AS revenue, max(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS capex FROM orders GROUP BY 1, 2), k AS (SELECT DISTINCT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS fy FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT code, fy FROM s WHERE capex IS NULL AND revenue >= 200000 AND EXISTS (SELECT 1 FROM k WHERE k.code = s.code AND abs(k.fy - s.fy) <= 1)""")
def patch_targets(spark, d):
    """Large company years that lack a field, with a document of the year or one beside it."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("fy"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    s = o.groupBy("code", "fy").agg(F.max("o_totalprice").alias("revenue"), F.max(F.when(F.col("o_orderstatus") == "F", 1)).alias("capex"))
    return filters.patch_targets(s, o.where("o_orderpriority = '1-URGENT'"), "capex", 200000).select("code", "fy")


@query("""SELECT user_id, arg_min(value, event_id) FILTER (WHERE value IS NOT NULL AND event_type = 'purchase') AS value FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase' AND value IS NOT NULL) > 0""")
def first_known_value(spark, d):
    return filters.first_known(table(spark, d, "events").withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value"))), "user_id", "event_id", "value")


@query("""
WITH e AS (SELECT p_brand, max(p_retailprice) AS v FROM part GROUP BY 1), b AS (SELECT p_brand, min(p_retailprice) AS v FROM part WHERE p_size < 25 GROUP BY 1)
SELECT p_brand, e.v, b.v AS reference, round((e.v - b.v) / abs(b.v) * 100, 6) AS gap FROM e JOIN b USING (p_brand)""")
def benchmark_gaps(spark, d):
    p = table(spark, d, "part")
    out = filters.benchmark_gap(p.groupBy("p_brand").agg(F.max("p_retailprice").alias("v")), p.where("p_size < 25").groupBy("p_brand").agg(F.min("p_retailprice").alias("v")), "p_brand", "v")
    return out.withColumn("gap", F.round("gap", 6))


@query("""SELECT o_orderkey AS doc_id, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderkey % 4 = 0""")
def already_stored(spark, d):
    """Incoming documents that a slot of the store holds already."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderdate")
    slots = o.where("doc_id % 4 = 0").unionByName(o.where("doc_id % 8 = 0"))
    return filters.already_stored(o.where("o_orderdate >= '1998-01-01'"), slots, ["o_custkey"]).select("doc_id", "o_custkey")


@query("""
WITH old AS (SELECT event_type AS field, 'k' || user_id % 5 AS tag, list(DISTINCT 'c' || user_id % 7) AS c FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1, 2), new AS (SELECT event_type AS field, 'k' || user_id % 6 AS tag, list(DISTINCT 'c' || user_id % 9) AS c FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2)
SELECT field, tag, array_to_string(list_sort(list_distinct(list_concat(coalesce(old.c, []), coalesce(new.c, [])))), ',') AS companies FROM old FULL JOIN new USING (field, tag)""")
def learned_tags(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("field"), "user_id", "ts")
    name = lambda p, n: F.concat(F.lit(p), (F.col("user_id") % n).cast("string"))
    old = e.where("ts < '2024-01-10'").groupBy("field", name("k", 5).alias("tag")).agg(F.collect_set(name("c", 7)).alias("companies"))
    new = e.where("ts >= '2024-01-10'").select("field", name("k", 6).alias("tag"), name("c", 9).alias("company"))
    return filters.learned_tags(old, new).withColumn("companies", F.array_join("companies", ","))


@query("""
SELECT p_brand, count(DISTINCT p_size) AS companies, count(*) AS rows, count(*) FILTER (WHERE p_retailprice > 950) AS with_area, CAST(sum(CAST(p_retailprice AS DECIMAL(18,4))) FILTER (WHERE p_type = 'ECONOMY' AND p_retailprice > 950) AS DOUBLE) AS area FROM part GROUP BY 1""")
def facilities_by_industry(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_size").alias("code"), F.when(F.col("p_retailprice") > 950, S.exact(F.col("p_retailprice"))).alias("area"), F.lit(1).alias("book_value"), F.when(F.col("p_type") == "ECONOMY", "JP").otherwise("US").alias("country"))
    return filters.facility_summary(p, "p_brand").select("p_brand", "companies", "rows", "with_area", F.col("area").cast("double").alias("area"))


@query(f"""WITH {TAGGED}, m(field, tag, industry, priority, ordinal) AS (VALUES ('x', '1-URGENT', 'all', 1, 0), ('x', '2-HIGH', 'bank', 1, 1), ('x', '3-MEDIUM', 'retail', 0, 2), ('y', '5-LOW', 'all', 1, 0))
SELECT o_custkey, field, arg_min(value, {{'p': priority, 'a': CASE industry WHEN 'all' THEN 1 ELSE 0 END, 'o': ordinal, 'v': value}}) AS value FROM tg JOIN m USING (tag) WHERE industry IN ('bank', 'all') AND (field <> 'x' OR NOT contains(context, 'Prior')) AND (field <> 'y' OR contains(context, 'Instant')) GROUP BY 1, 2""")
def industry_values(spark, d):
    """A bank's own tags before those for all; words that a context must hold or must not."""
    m = spark.createDataFrame([("x", "1-URGENT", "all", 1, 0, [], ["prior"]), ("x", "2-HIGH", "bank", 1, 1, [], ["prior"]), ("x", "3-MEDIUM", "retail", 0, 2, [], ["prior"]), ("y", "5-LOW", "all", 1, 0, ["INSTANT"], [])], "field string, tag string, industry string, priority int, ordinal int, required array<string>, excluded array<string>")
    return classify.industry_values(tagged(spark, d), m, "bank", ["o_custkey"])


@query("""
SELECT o_custkey AS code, o_orderpriority AS label, o_totalprice AS v FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'whole company', c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0)""")
def whole_companies(spark, d):
    """Companies without segments come in with a row of their own."""
    seg = table(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("v"))
    return markets.whole_company(seg, table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("v")), ["code"], "label")


@query("""
WITH bad AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'N') = 0 AND count(*) FILTER (WHERE l_returnflag = 'R') > 0)
SELECT o_orderkey, CAST(CASE WHEN q IS NULL AND (o_orderkey IN (SELECT l_orderkey FROM bad) OR o_orderpriority = '5-LOW') THEN 2 ELSE q END AS INTEGER) AS quarter FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS q FROM orders)""")
def interim_rerouted(spark, d):
    """Interim documents in annual slots move to the second quarter's."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 1).alias("quarter"), (F.col("o_orderpriority") == "5-LOW").alias("half"))
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "N", "CurrentYearDuration").when(F.col("l_returnflag") == "R", "InterimDuration").otherwise("FilingDate").alias("context"))
    return classify.rerouted(o, c, ["o_orderkey"], "o_orderkey", "context", F.col("half")).select("o_orderkey", "quarter")


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS segments, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS s, max(o_totalprice) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) >= 2)
SELECT l_orderkey, segments, round(abs(s - t) / t, 9) AS gap, abs(s - t) / t < 0.5 AS matches FROM g""")
def segment_sums(spark, d):
    """Lines as segments of their order: does their sum come near the total."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("revenue")).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("total")), "l_orderkey")
    return classify.segment_sums(x, "l_orderkey", {"revenue": ("total", 0.5)}).select("l_orderkey", "segments", F.round("revenue_gap", 9).alias("gap"), F.col("revenue_matches").alias("matches"))


@query("""
SELECT c_custkey AS code, floor(c_acctbal) * CASE WHEN c_custkey % 3 = 0 THEN 1.5 ELSE 1 END * 1e6 AS display, floor(c_acctbal) * 1e6 AS store, round(CASE WHEN c_custkey % 3 = 0 THEN 5e-1 ELSE 0e0 END, 6) AS ratio FROM customer WHERE c_custkey % 3 = 0 AND floor(c_acctbal) > 0""")
def reconciled(spark, d):
    """Figures on display that are off the store's, largest first."""
    c = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("code"), F.floor("c_acctbal").alias("v"))
    shown = c.select("code", F.concat((F.col("v") * F.when(F.col("code") % 3 == 0, 1.5).otherwise(1.0)).cast("decimal(18,1)").cast("string"), F.lit("百万円")).alias("display"))
    out = audit.reconcile(shown, c.select("code", (F.col("v") * 1e6).alias("value")), ["code"])
    return out.withColumn("ratio", F.round("ratio", 6))


@query("""
WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (WHERE o_orderstatus = 'F') AS documents FROM orders GROUP BY 1), p AS (SELECT CAST(unnest(range(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, coalesce(documents, 0) AS documents, CASE WHEN documents IS NULL THEN 'unverified' WHEN documents = 0 THEN 'empty' ELSE 'listed' END AS state FROM p LEFT JOIN s USING (day)""")
def unverified_days(spark, d):
    """Days without a kept list are not days without a document."""
    lists = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("doc_id"))
    return audit.verified_days(lists, spark.sql(audit.days("1995-01-01", "1996-12-30"))).select("day", "documents", "state")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def pending_work(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return audit.pending(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""SELECT event_id FROM events WHERE (event_type = 'view' AND date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 10) OR (event_type = 'click' AND date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 20)""")
def expired_files(spark, d):
    return audit.expired(table(spark, d, "events"), "ts", F.lit("2024-01-31").cast("date"), {"view": 10, "click": 20}, "event_type").select("event_id")


@query("""SELECT p_partkey AS key FROM part WHERE p_size >= 10 AND NOT (p_partkey % 2 = 0 AND p_partkey % 3 <> 0)""")
def files_to_send(spark, d):
    """New files, and files of another size, changed since then."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"), F.col("p_size").alias("modified"))
    return audit.to_send(p, p.where("key % 2 = 0").withColumn("size", F.col("size") + F.when(F.col("key") % 3 == 0, 1).otherwise(0)), since=F.lit(10)).select("key")


@query("""SELECT user_id, CASE WHEN h IS NULL OR h > 168 THEN 'FAIL' WHEN h > 96 THEN 'WARN' ELSE 'OK' END AS status FROM (SELECT user_id, epoch(TIMESTAMP '2024-01-31' - max(ts) FILTER (WHERE event_type = 'purchase')) / 3600 AS h FROM events GROUP BY 1)""")
def stale_checks(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.date_trunc("microsecond", F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))).alias("ran"))
    return audit.freshness(last, "ran", F.lit("2024-01-31").cast("timestamp")).select("user_id", "status")


@query("""
WITH x AS (SELECT o_orderpriority AS status, o_orderkey FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY o_orderkey) AS n FROM x)
SELECT status, (SELECT count(*) FROM x WHERE x.status = r.status) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS samples FROM r WHERE n <= 200 GROUP BY status""")
def status_samples(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("status"), "o_orderkey")
    return audit.sampled(x, "status", "o_orderkey").select("status", "n", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query("""
WITH c AS (SELECT coalesce(a.k, b.k) AS k, a.v AS a, b.v AS b FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) * 1.03 AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) b ON a.k = b.k)
SELECT k, coalesce(a, b) AS value, CASE WHEN a IS NULL OR b IS NULL THEN 'low' WHEN abs(a - b) / greatest(abs(a), abs(b)) <= 1e-4 THEN 'high' WHEN abs(a - b) / greatest(abs(a), abs(b)) <= 0.05 THEN 'medium' ELSE 'low' END AS confidence FROM c""")
def verified_values(spark, d):
    from ledgerline.operators import checks

    o = table(spark, d, "orders")
    a = o.where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("value"))
    b = o.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("k")).agg((F.max("o_totalprice") * 1.03).alias("value"))
    return classify.verified_values(checks.compare(a, b, ["k"])).select("k", "value", "confidence")


@query("""
SELECT l_returnflag AS method, count(*) AS n, count(*) FILTER (WHERE l_tax = 0) AS failed, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem i WHERE i.l_returnflag = lineitem.l_returnflag AND l_tax = 0 ORDER BY k LIMIT 50)) AS failures FROM lineitem GROUP BY 1""")
def run_summary(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), "l_tax", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return classify.method_counts(x, "method", F.col("l_tax") == 0, "k").withColumn("failures", F.array_join(F.col("failures").cast("array<string>"), ","))


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END, CASE WHEN s_suppkey % 5 = 0 THEN 0 END)::DOUBLE AS dividend FROM supplier""")
def dividend_chain(spark, d):
    """Tag, other tag, text block, none: the first that is there."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    side = lambda n, v: s.where(k % n == 0).select(k, v.cast("double").alias("dividend"))
    return classify.label_chain(s.select(k), [side(3, F.col("s_acctbal")), side(2, F.col("s_nationkey")), side(5, F.lit(0))], "s_suppkey", "dividend", F.lit(None).cast("double"))


@query("""
SELECT unit, status, count(*) AS n FROM (
  SELECT unnest(['million', '%']) AS unit, unnest([CASE WHEN doc_id % 2 <> 0 THEN 'no_fact' WHEN abs(1000 + doc_id - 1050) <= 0.01 * 1050 THEN 'agrees' ELSE 'differs' END, CASE WHEN doc_id % 2 <> 0 THEN 'no_fact' WHEN abs(doc_id % 10 + 0.5 - 1050) <= 10.5 THEN 'agrees' ELSE 'differs' END]) AS status FROM documents) GROUP BY 1, 2""")
def figures_in_text(spark, d):
    """Figures with a unit, written into every text, against a fact of the document."""
    docs = table(spark, d, "documents")
    said = F.concat(F.lit("Sales were "), F.format_number(F.col("doc_id") + 1000, 0), F.lit(" million, up "), (F.col("doc_id") % 10).cast("string"), F.lit(".5%. Of 12 shops, none"))
    found = text.number_mentions(docs.select("doc_id", said.alias("text"))).select("doc_id", F.col("unit").alias("field"), "value")
    facts = docs.where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit("%"), F.lit("million"), F.lit("billion"))).alias("field"), F.lit(1050.0).alias("value"))
    return excerpts.mentions_against_facts(found, facts, "doc_id").groupBy(F.col("field").alias("unit"), "status").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id AS doc_id, bool_or(turn <= 2 AND contains(regexp_replace(text, '\\s', '', 'g'), 'ofthe')) AS single FROM conversations GROUP BY 1""")
def single_segment(spark, d):
    """A phrase on the first pages, blanks aside."""
    return excerpts.single_segment(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"), ["ofthe"], 2)


@query("""SELECT p_partkey, p_brand, p_size FROM part""")
def seeded_order(spark, d):
    """All rows, in an order that key and seed fix."""
    return classify.seeded_order(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey", 42)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT r_name AS parent, n_name AS child FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT DISTINCT n_name, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
v AS (SELECT s_name FROM supplier WHERE s_acctbal > 5000)
SELECT DISTINCT id FROM (SELECT s_name AS id FROM v UNION ALL SELECT parent FROM e WHERE child IN (SELECT s_name FROM v) UNION ALL SELECT a.parent FROM e a WHERE a.child IN (SELECT parent FROM e WHERE child IN (SELECT s_name FROM v)))""")
def pruned_tree(spark, d):
    """Branches with a supplier of means."""
    from ledgerline.operators import tree

    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    up = n.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    down = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("parent"), F.col("s_name").alias("child"))
    return tree.pruned(tree.layout(up.unionByName(down)), s.where("s_acctbal > 5000").select(F.col("s_name").alias("id"))).select("id")


@query("""
WITH f AS (SELECT l_suppkey, l_extendedprice AS book, CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice * 1.5 END AS market, l_discount * 10 AS dispersion, CASE WHEN l_tax = 0 THEN 'x' END AS reason FROM lineitem),
p AS (SELECT *, reason IS NULL AND market IS NOT NULL AS ok, CASE WHEN dispersion < 0.25 THEN 'low' WHEN dispersion < 0.5 THEN 'medium' ELSE 'high' END AS level FROM f)
SELECT l_suppkey, count(*) AS facilities, count(*) FILTER (WHERE ok) AS priced, count(*) FILTER (WHERE reason IS NOT NULL) AS excluded, CAST(sum(CAST(book AS DECIMAL(18,4))) FILTER (WHERE ok) AS DOUBLE) AS book, CAST(sum(CAST(market AS DECIMAL(18,4))) FILTER (WHERE ok) AS DOUBLE) AS market,
  CAST(sum(CAST(market AS DECIMAL(18,4))) FILTER (WHERE ok AND level = 'high') AS DOUBLE) AS market_high, count(*) FILTER (WHERE ok AND level = 'low') AS level_low, round(count(*) FILTER (WHERE ok) / count(*), 9) AS coverage FROM p GROUP BY 1""")
def land_totals(spark, d):
    """A company's land: what is priced, what is left out, and how far prices lie apart."""
    n, v = F.col("l_linenumber"), F.col("l_extendedprice")
    f = table(spark, d, "lineitem").select("l_suppkey", v.alias("book"), F.when(n % 5 != 0, v * 1.5).alias("market"), v.alias("low"), (v * 2).alias("high"), (F.col("l_discount") * 10).alias("dispersion"), F.when(F.col("l_tax") == 0, "x").alias("reason"))
    out = facilities.land_totals(f, "l_suppkey")
    return out.select("l_suppkey", "facilities", "priced", "excluded", "book", "market", "market_high", "level_low", F.round("coverage", 9).alias("coverage"))


def _price_stats(df, *keys):
    return df.groupBy(*keys).agg(*spatial.price_stats(df, "p_retailprice"))


PRICE_SIDES = """{n} AS (SELECT p_brand, p_type, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean, quantile_cont(p_retailprice, 0.5) AS median, min(p_retailprice) AS low, max(p_retailprice) AS high, CASE WHEN count(*) >= 2 THEN quantile_cont(p_retailprice, 0.25) END AS p25 FROM part WHERE {w} GROUP BY 1, 2)"""
MERGED = f"WITH {PRICE_SIDES.format(n='o', w='p_size < 35')}, {PRICE_SIDES.format(n='w', w='p_size >= 35')}, m AS (SELECT coalesce(o.p_brand, w.p_brand) AS p_brand, coalesce(o.p_type, w.p_type) AS p_type, coalesce(o.n, 0) + coalesce(w.n, 0) AS n, (coalesce(o.mean * o.n, 0) + coalesce(w.mean * w.n, 0)) / (coalesce(o.n, 0) + coalesce(w.n, 0)) AS mean, coalesce(w.median, o.median) AS median, least(o.low, w.low) AS low, greatest(o.high, w.high) AS high, coalesce(w.p25, o.p25) AS p25, coalesce(w.n, 0) AS newer FROM o FULL JOIN w ON o.p_brand = w.p_brand AND o.p_type = w.p_type)"


@query(f"{MERGED} SELECT p_brand, p_type, n, round(mean, 6) AS mean, round(median, 6) AS median, low, high, round(p25, 6) AS p25, newer FROM m")
def merged_prices(spark, d):
    """Older and newer price statistics of a place and use as one."""
    p = table(spark, d, "part")
    out = facilities.merged_prices(_price_stats(p.where("p_size < 35"), "p_brand", "p_type"), _price_stats(p.where("p_size >= 35"), "p_brand", "p_type"), ["p_brand", "p_type"])
    return out.select("p_brand", "p_type", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "low", "high", F.round("p25", 6).alias("p25"), "newer")


@query(f"{MERGED}, x AS (SELECT p_brand, mean, unnest(range(n)) FROM m) SELECT p_brand, count(*) AS n, round(quantile_cont(mean, 0.5), 6) AS median, round(quantile_cont(mean, 0.25), 6) AS p25 FROM x GROUP BY 1")
def rebuilt_totals(spark, d):
    """A place's statistics over its uses, each mean weighing as much as it has prices."""
    p = table(spark, d, "part")
    m = facilities.merged_prices(_price_stats(p.where("p_size < 35"), "p_brand", "p_type"), _price_stats(p.where("p_size >= 35"), "p_brand", "p_type"), ["p_brand", "p_type"])
    return facilities.rebuilt_total(m, "p_brand").select("p_brand", "n", F.round("median", 6).alias("median"), F.round("p25", 6).alias("p25"))
