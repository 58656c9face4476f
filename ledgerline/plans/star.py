"""Queries over the star tables: the filings operators on sales data, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import audit, checks, measures, merge, select, spatial, tree

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def revenue(x="l_extendedprice", y="l_discount"):
    return S.exact(F.col(x) * (1 - F.col(y)))


def by_supplier(spark, d):
    """(supplier key, revenue): lines are summed by supplier before any join."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(revenue()).alias("dec")).select(F.col("l_suppkey").alias("s_suppkey"), F.col("dec").cast("double").alias("revenue"))


def nation_years(spark, d):
    """nation, year, revenue, cost, quantity, lines."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("year"), revenue().alias("rev"), "l_quantity")
    # Retail prices by part: joined to sums by part, not to lines.
    sums = li.groupBy("l_suppkey", "l_partkey", "year").agg(F.sum("rev").alias("rev"), F.sum(S.exact(F.col("l_quantity"))).alias("qty"), F.count("*").alias("lines"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), S.exact(F.col("p_retailprice")).alias("price"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    rows = sums.join(part, "l_partkey").join(supplier, "l_suppkey").join(nation, "n_nationkey")
    cost = (F.col("price") * F.col("qty")).cast("decimal(28,4)")
    return rows.groupBy("nation", "year").agg(F.sum("rev").cast("double").alias("revenue"), F.sum(cost).cast("double").alias("cost"), F.sum("qty").cast("double").alias("quantity"), F.sum("lines").alias("lines"))


NATION_YEARS = """
ny AS (
  SELECT n_name AS nation, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
         CAST(sum(CAST(CAST(p_retailprice AS DECIMAL(18,4)) * CAST(l_quantity AS DECIMAL(18,4)) AS DECIMAL(28,4))) AS DOUBLE) AS cost,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity, count(*) AS lines
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  GROUP BY 1, 2)"""

SUPPLIER_REVENUE = """
sr AS (SELECT l_suppkey AS s_suppkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1)"""


@query(f"""WITH {SUPPLIER_REVENUE},
rows AS (
  SELECT unnest([n_name, r_name]) AS category, s_name AS company, revenue
  FROM sr JOIN supplier USING (s_suppkey) JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
shares AS (
  SELECT category, company, revenue, CASE WHEN sum(revenue) OVER (PARTITION BY category) > 0 THEN revenue / CAST(t AS DOUBLE) ELSE 0 END AS share,
         row_number() OVER (PARTITION BY category ORDER BY revenue DESC, company) AS place
  FROM rows JOIN (SELECT category, sum(CAST(revenue AS DECIMAL(18,4))) AS t FROM rows GROUP BY 1) USING (category))
SELECT category, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS companies,
  CAST(sum(CAST(share * share AS DECIMAL(18,12))) AS DOUBLE) * 10000 AS hhi,
  CAST(sum(CAST(CASE WHEN place <= 1 THEN share ELSE 0 END AS DECIMAL(18,12))) AS DOUBLE) AS top1,
  CAST(sum(CAST(CASE WHEN place <= 3 THEN share ELSE 0 END AS DECIMAL(18,12))) AS DOUBLE) AS top3,
  CAST(sum(CAST(CASE WHEN place <= 5 THEN share ELSE 0 END AS DECIMAL(18,12))) AS DOUBLE) AS top5
FROM shares GROUP BY category""")
def market_share_hhi(spark, d):
    """Revenue, concentration and top shares of nations and of the regions above them."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    edges = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    above = tree.closure(tree.layout(edges)).select("ancestor", F.col("id").alias("n_name"))
    sold = by_supplier(spark, d).join(table(spark, d, "supplier"), "s_suppkey").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    rows = sold.join(above, "n_name").select(F.col("ancestor").alias("category"), F.col("s_name").alias("company"), "revenue")
    return measures.concentration(measures.shares(rows, "category", "company", "revenue"), "category", "revenue")


@query("""
SELECT s_name, list_sort(list(p_brand || '=' || CAST(CAST(rev AS DECIMAL(28,4)) AS VARCHAR))) AS matrix FROM (
  SELECT s_name, p_brand, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS rev
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) GROUP BY s_name
""".replace("list_sort(list(", "array_to_string(list_sort(list(").replace("VARCHAR)))", "VARCHAR))), ';')"))
def company_category_matrix(spark, d):
    """Supplier by brand, every brand of the table: a row's cells by category, so that new ones need no new columns."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(revenue()).alias("rev"))
    rows = li.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    m = measures.matrix(rows, "s_name", "p_brand", "rev")
    cells = F.transform(F.map_entries("matrix"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("decimal(28,4)").cast("string")))
    return m.select("s_name", F.array_join(F.array_sort(cells), ";").alias("matrix"))


@query("""
WITH v AS (SELECT o_custkey, o_orderpriority AS tag, max(o_totalprice) AS value FROM orders GROUP BY 1, 2),
m(field, tag, priority, ordinal) AS (VALUES ('amount', '1-URGENT', 1, 1), ('amount', '2-HIGH', 1, 0), ('amount', '5-LOW', 3, 2), ('rest', '3-MEDIUM', 2, 0))
SELECT o_custkey, field, arg_min(value, priority * 10 + ordinal) AS value FROM v JOIN m USING (tag) GROUP BY 1, 2""")
def priority_coalesce(spark, d):
    """Per customer and field the largest order of the tag that ranks first, list order between equals."""
    facts = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("tag")).agg(F.max("o_totalprice").alias("value"))
    tags = spark.createDataFrame([("amount", "1-URGENT", 1, 1), ("amount", "2-HIGH", 1, 0), ("amount", "5-LOW", 3, 2), ("rest", "3-MEDIUM", 2, 0)], "field string, tag string, priority int, ordinal int")
    return select.canonical_values(facts, tags, ["o_custkey"])


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_wins_dedup(spark, d):
    return select.first_row(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def latest_wins(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))


@query("""
SELECT l_orderkey, days, annual, value FROM (
  SELECT l_orderkey, days, annual, value, row_number() OVER (PARTITION BY l_orderkey ORDER BY annual DESC, l_shipdate DESC, l_linenumber DESC, value, days) AS n FROM (
    SELECT l_orderkey, l_shipdate, l_linenumber, l_extendedprice AS value, CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) * 10 AS days,
           CAST(round(date_diff('day', o_orderdate, l_shipdate) * 10 / 30.0) AS INTEGER) BETWEEN 10 AND 14 AS annual
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey)) WHERE n = 1""")
def annual_value_pick(spark, d):
    """Lines as entries of a period ten times their delivery time: the annual ones first, then the newest."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    e = li.join(o, "l_orderkey").select("l_orderkey", (F.datediff("l_shipdate", "o_orderdate") * 10).alias("days"), F.col("l_shipdate").alias("end"), F.col("l_linenumber").alias("filed"), F.col("l_extendedprice").alias("value"))
    return select.annual_value(e, ["l_orderkey"]).select("l_orderkey", "days", "annual", "value")


@query(f"""WITH {NATION_YEARS}
SELECT a.nation, a.year, a.revenue, b.revenue AS prev, (a.revenue - b.revenue) / nullif(abs(b.revenue), 0) * 100 AS yoy
FROM ny a LEFT JOIN ny b ON a.nation = b.nation AND b.year = a.year - 1""")
def yoy(spark, d):
    return measures.yoy(nation_years(spark, d).select("nation", "year", "revenue"), "nation", "year", "revenue")


@query(f"""WITH {NATION_YEARS},
e AS (SELECT nation, max(year) AS y1, arg_max(revenue, year) AS v1, min(year) AS yf FROM ny GROUP BY 1),
f AS (SELECT e.nation, e.y1, e.v1, coalesce(max(CASE WHEN ny.year <= e.y1 - 3 THEN ny.year END), any_value(e.yf)) AS y0 FROM e JOIN ny USING (nation) GROUP BY 1, 2, 3)
SELECT f.nation, f.y0, f.y1, CASE WHEN f.y1 > f.y0 AND ny.revenue > 0 AND f.v1 > 0 THEN round((pow(f.v1 / ny.revenue, 1.0 / (f.y1 - f.y0)) - 1) * 100, 6) END AS cagr
FROM f JOIN ny ON ny.nation = f.nation AND ny.year = f.y0""")
def cagr(spark, d):
    return measures.cagr(nation_years(spark, d).select("nation", "year", "revenue"), "nation", "year", "revenue", 3).withColumn("cagr", F.round("cagr", 6))


@query(f"""WITH {NATION_YEARS}
SELECT nation, string_agg(CAST(year AS VARCHAR) || '=' || CAST(CAST(revenue AS BIGINT) AS VARCHAR), ';' ORDER BY year) AS trend, max(year) AS latest, count(*) AS years FROM (SELECT nation, year, floor(revenue) AS revenue FROM ny) GROUP BY nation""")
def trend_map(spark, d):
    t = measures.trend_map(nation_years(spark, d).withColumn("revenue", F.floor("revenue")), "nation", "year", "revenue")
    text = F.array_join(F.transform(F.map_entries("trend"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ";")
    return t.select("nation", text.alias("trend"), "latest", "years")


ORDER_SUMS = """
os AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS lines, max(l_extendedprice) AS largest FROM lineitem GROUP BY 1)"""


def order_sums(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(S.exact(F.col("l_extendedprice"))).cast("double").alias("total"), F.count("*").alias("lines"), F.max("l_extendedprice").alias("largest"))


def checked_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    x = o.join(order_sums(spark, d), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return x.withColumn("c", checks.check(F.col("o_totalprice"), F.col("total"), percent=5.0, absolute=1e4)).select("o_orderkey", "o_custkey", "o_totalprice", "total", "c.*")


CHECKED = f"""{ORDER_SUMS},
co AS (
  SELECT *, CASE WHEN passed THEN 'ok' WHEN difference_pct <= 1 THEN 'warning' ELSE 'error' END AS severity FROM (
    SELECT *, CASE WHEN total IS NULL OR o_totalprice IS NULL THEN true WHEN o_totalprice = 0 THEN abs(total) < 1000 ELSE difference_pct < 5.0 OR difference < 1e4 END AS passed FROM (
      SELECT o_orderkey, o_custkey, o_totalprice, total, abs(total - o_totalprice) AS difference, abs(total - o_totalprice) / nullif(abs(o_totalprice), 0) * 100 AS difference_pct
      FROM orders LEFT JOIN os ON l_orderkey = o_orderkey)))"""


@query(f"WITH {CHECKED} SELECT o_orderkey, passed, difference, difference_pct, severity FROM co")
def equation_check(spark, d):
    """Order totals against the sum of their lines."""
    return checked_orders(spark, d).select("o_orderkey", "passed", "difference", "difference_pct", "severity")


@query(f"WITH {CHECKED} SELECT o_custkey, CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) * 100 AS score, count(*) AS checks FROM co GROUP BY 1")
def check_score(spark, d):
    return checks.score(checked_orders(spark, d), ["o_custkey"])


@query(f"""WITH {ORDER_SUMS},
need AS (SELECT o_orderkey, o_totalprice * 0.25 AS needed FROM orders),
near AS (SELECT DISTINCT o_orderkey, needed, l_extendedprice AS value FROM need JOIN lineitem ON l_orderkey = o_orderkey WHERE abs(l_extendedprice - needed) <= 0.05 * abs(needed))
SELECT o_orderkey, needed, (SELECT arg_min(value, {{'d': abs(value - n.needed), 'v': value}}) FROM near WHERE near.o_orderkey = n.o_orderkey) AS found FROM need n""")
def repair_by_value_search(spark, d):
    """For a quarter of each order's total, the line value of the order nearest to it within 5 per cent."""
    need = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 0.25).alias("needed"))
    values = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("value"))
    return checks.repair_candidates(need, values, "o_orderkey", 0.05).select("o_orderkey", "needed", "found")


@query(f"""WITH {ORDER_SUMS},
a AS (SELECT o_custkey AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS a FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
b AS (SELECT o_custkey AS k, CAST(sum(CAST(total AS DECIMAL(18,4))) AS DOUBLE) AS b FROM orders JOIN os ON l_orderkey = o_orderkey GROUP BY 1)
SELECT k, a, b, CASE WHEN a IS NULL THEN 'right_only' WHEN b IS NULL THEN 'left_only' WHEN g <= 1e-4 THEN 'exact' WHEN g <= 0.05 THEN 'close' ELSE 'mismatch' END AS status
FROM (SELECT coalesce(a.k, b.k) AS k, a, b, CASE WHEN greatest(abs(a), abs(b)) = 0 THEN 0 ELSE abs(a - b) / greatest(abs(a), abs(b)) END AS g FROM a FULL OUTER JOIN b ON a.k = b.k)""")
def comparator(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(S.exact(F.col("o_totalprice"))).cast("double").alias("value"))
    b = o.join(order_sums(spark, d), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.sum(S.exact(F.col("total"))).cast("double").alias("value"))
    return checks.compare(a, b, ["k"]).select("k", "a", "b", "status")


#: Fixed ranks of line flags as audit statuses.
RANKS = {"R": 0, "A": 1, "N": 2}
STATUS = """
au AS (
  SELECT o_orderkey, o_custkey, o_orderdate, coalesce(st, 'MISSING') AS status FROM orders LEFT JOIN (
    SELECT l_orderkey, arg_min(l_returnflag, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS st FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey)"""


def audited(spark, d):
    expected = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    got = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("status"))
    return audit.best_status(expected, got, ["o_orderkey"], RANKS)


@query(f"WITH {STATUS} SELECT status, count(*) AS n FROM au GROUP BY 1")
def audit_expected_actual(spark, d):
    return audited(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {STATUS} SELECT o_orderdate, count(*) AS expected, count(*) FILTER (WHERE status <> 'MISSING') AS fine,
coalesce(array_to_string(list_sort(list(DISTINCT o_custkey) FILTER (WHERE status = 'MISSING')), ','), '') AS problems FROM au GROUP BY 1""")
def audit_by_date(spark, d):
    return audit.by_date(audited(spark, d), "o_orderdate", "o_custkey", F.col("status") != "MISSING").withColumn("problems", F.array_join(F.col("problems").cast("array<string>"), ","))


@query(f"WITH {STATUS} SELECT bad, unverified, rows, CASE WHEN bad > 0 THEN 'FAIL' WHEN unverified > 0 THEN 'PASS_PARTIAL' ELSE 'PASS' END AS verdict FROM (SELECT count(*) FILTER (WHERE status = 'R') AS bad, count(*) FILTER (WHERE status = 'MISSING') AS unverified, count(*) AS rows FROM au)")
def audit_verdict(spark, d):
    out = audit.verdict(audited(spark, d), F.col("status") == "R", F.col("status") == "MISSING")
    return out.select(F.col("bad").cast("bigint"), F.col("unverified").cast("bigint"), "rows", "verdict")


@query("""
SELECT k, CASE WHEN bool_or(e) AND bool_or(a) THEN 'both' WHEN bool_or(e) THEN 'missing' ELSE 'extra' END AS side FROM (
  SELECT c_custkey AS k, true AS e, false AS a FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT o_custkey, false, true FROM orders WHERE o_orderstatus = 'P') GROUP BY k""")
def existence_both_ways(spark, d):
    e = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("k"))
    return audit.existence(e, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), ["k"])


@query("""
SELECT event_id, user_id FROM events e WHERE event_type = 'purchase' AND EXISTS (
  SELECT 1 FROM events o WHERE o.event_type = 'signup' AND o.user_id = e.user_id AND abs(date_diff('day', CAST(o.ts AS DATE), CAST(e.ts AS DATE))) <= 3)""")
def window_semi_join(spark, d):
    """Purchases with a sign-up of the same user within three days."""
    e = table(spark, d, "events")
    return audit.near_in_time(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'signup'"), "user_id", "ts", 3).select("event_id", "user_id")


@query("""
WITH s AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
w AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, year, shift, value FROM (
  SELECT w.o_custkey, w.year, t.shift, s.value, row_number() OVER (PARTITION BY w.o_custkey, w.year ORDER BY s.value IS NULL, t.n) AS k
  FROM w LEFT JOIN (s CROSS JOIN (VALUES (0, 0), (1, -1), (2, 1)) t(n, shift)) ON s.o_custkey = w.o_custkey AND s.year = w.year + t.shift) WHERE k = 1""")
def shifted_key_fallback(spark, d):
    """The year's value, else the year before's, else the year after's."""
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    store = o.where("o_orderstatus = 'F'").groupBy("o_custkey", "year").agg(F.max("o_totalprice").alias("value"))
    return select.shifted_lookup(o.where("o_orderstatus = 'O'").select("o_custkey", "year").distinct(), store, "o_custkey", "year", "value", [0, -1, 1])


PRICES = """
gp AS (
  SELECT p_brand, p_type, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean, quantile_cont(p_retailprice, 0.5) AS median, min(p_retailprice) AS low, max(p_retailprice) AS high,
         CASE WHEN count(*) >= 2 THEN quantile_cont(p_retailprice, 0.25) END AS p25, CASE WHEN count(*) >= 2 THEN quantile_cont(p_retailprice, 0.75) END AS p75
  FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand)))"""


@query(f"WITH {PRICES} SELECT p_brand, p_type, n, round(mean, 6) AS mean, round(median, 6) AS median, low, high, round(p25, 6) AS p25, round(p75, 6) AS p75, CASE WHEN (p75 - p25) / median < 0.25 THEN 'low' WHEN (p75 - p25) / median < 0.5 THEN 'medium' WHEN p25 IS NULL THEN 'unknown' ELSE 'high' END AS level FROM gp")
def price_stats_grouping_sets(spark, d):
    x = spatial.grouped_prices(table(spark, d, "part"), "p_brand", "p_type", "p_retailprice")
    return x.select("p_brand", "p_type", "n", *[F.round(c, 6).alias(c) if c not in ("low", "high") else F.col(c) for c in ("mean", "median", "low", "high", "p25", "p75")], S.dispersion_level(F.col("dispersion")).alias("level"))


@query("""
SELECT l_returnflag, count(*) AS n, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1""")
def weighted_merge(spark, d):
    """Statistics of two halves of the lines, merged."""
    li = table(spark, d, "lineitem")
    part = lambda x: x.groupBy("l_returnflag").agg(F.count("*").alias("n"), (F.sum(S.exact(F.col("l_quantity"))).cast("double") / F.count("*")).alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    out = spatial.merge_stats(part(li.where("l_linestatus = 'F'")), part(li.where("l_linestatus <> 'F' OR l_linestatus IS NULL")), ["l_returnflag"])
    return out.withColumn("mean", F.round("mean", 6))


@query("""
WITH a AS (SELECT p_brand, p_size, max(p_retailprice) AS v FROM part WHERE p_type = 'ECONOMY' GROUP BY 1, 2 HAVING count(*) >= 2),
b AS (SELECT p_brand, max(p_retailprice) AS v FROM part WHERE p_type = 'ECONOMY' GROUP BY 1), c AS (SELECT max(p_retailprice) AS v FROM part)
SELECT p_partkey, CAST(CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS level, coalesce(a.v, b.v, c.v) AS price
FROM part p LEFT JOIN a ON a.p_brand = p.p_brand AND a.p_size = p.p_size LEFT JOIN b ON b.p_brand = p.p_brand, c""")
def fallback_lookup(spark, d):
    """Price by brand and size where two parts give one, else by brand, else over all."""
    p = table(spark, d, "part")
    eco = p.where("p_type = 'ECONOMY'")
    levels = [
        (eco.groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("price"), F.count("*").alias("n")).where("n >= 2"), ["p_brand", "p_size"]),
        (eco.groupBy("p_brand").agg(F.max("p_retailprice").alias("price")), ["p_brand"]),
        (p.agg(F.max("p_retailprice").alias("price")), []),
    ]
    return spatial.lookup_with_fallback(p.select("p_partkey", "p_brand", "p_size"), levels, "price").select("p_partkey", "level", "price")


@query("""
SELECT reason, count(*) AS n, CAST(sum(CAST(capped AS DECIMAL(18,4))) AS DOUBLE) AS capped FROM (
  SELECT CASE WHEN l_quantity <= 0 THEN 'no_quantity' WHEN l_discount >= 0.1 THEN 'deep_discount' WHEN l_tax = 0 THEN 'untaxed' WHEN l_extendedprice / l_quantity > 4000 THEN 'dear' WHEN l_extendedprice < 5000 THEN 'small' ELSE 'fine' END AS reason,
         least(l_extendedprice, l_quantity * 2000) AS capped FROM lineitem) GROUP BY 1""")
def outlier_reason(spark, d):
    """Ordered rules, the first that holds; values capped by quantity."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    rules = [(q <= 0, "no_quantity"), (F.col("l_discount") >= 0.1, "deep_discount"), (F.col("l_tax") == 0, "untaxed"), (p / S.present(q) > 4000, "dear"), (p < 5000, "small")]
    x = table(spark, d, "lineitem").select(S.first_case(rules, "fine").alias("reason"), F.least(p, q * 2000).alias("capped"))
    return x.groupBy("reason").agg(F.count("*").alias("n"), F.sum(S.exact(F.col("capped"))).cast("double").alias("capped"))


@query("""
WITH u AS (SELECT l_suppkey, list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1] AS upper_median, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3)
SELECT l_suppkey, count(*) AS n, max(l_extendedprice) AS largest, any_value(upper_median) AS upper_median FROM lineitem JOIN u USING (l_suppkey) WHERE l_extendedprice > 1.8 * upper_median AND l_extendedprice > 30 GROUP BY 1""")
def intra_group_outlier(spark, d):
    x = spatial.group_outliers(table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice", times=1.8)
    return x.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("largest"), F.first("upper_median").alias("upper_median"))


def points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") + 35).alias("lat"), (F.col("embedding")[1].cast("double") + 135).alias("lon"), F.when(F.col("label") % 3 == 0, "residential").when(F.col("label") % 3 == 1, "commercial").otherwise("other").alias("use"), (F.col("label") * 10.0 + 5).alias("price"))


@query("""
WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) + 35 AS lat, CAST(embedding[2] AS DOUBLE) + 135 AS lon, CASE WHEN label % 3 = 0 THEN 'residential' WHEN label % 3 = 1 THEN 'commercial' ELSE 'other' END AS use, label * 10.0 + 5 AS price FROM embeddings),
near AS (
  SELECT t.id, t.use, p.use AS puse, p.price, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(p.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - t.lon) / 2), 2), 1))) AS km
  FROM p t JOIN p ON abs(t.lat - p.lat) < 0.1 AND abs(t.lon - p.lon) < 0.1),
c AS (SELECT *, count(*) FILTER (WHERE use = puse) OVER (PARTITION BY id) AS same FROM near WHERE km <= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, price) AS n FROM c WHERE CASE WHEN same >= 3 THEN use = puse ELSE puse <> 'other' END)
SELECT id, round(sum(price / greatest(km, 0.05)) / sum(1 / greatest(km, 0.05)), 6) AS price, count(*) AS neighbours FROM k WHERE n <= 10 GROUP BY id""")
def knn_join(spark, d):
    p = points(spark, d)
    return spatial.nearest_prices(p, p).withColumn("price", F.round("price", 6))


#: Literal zones for the point-in-polygon query.
ZONES = [("core", [(134.95, 34.95), (135.05, 34.95), (135.05, 35.05), (134.95, 35.05)]), ("wedge", [(135.0, 35.0), (135.4, 35.1), (135.1, 35.4)])]


@query("""
WITH p AS (SELECT CAST(embedding[2] AS DOUBLE) + 135 AS x, CAST(embedding[1] AS DOUBLE) + 35 AS y FROM embeddings)
SELECT zone, count(*) AS n FROM (
  SELECT CASE WHEN x >= 134.95 AND x < 135.05 AND y >= 34.95 AND y < 35.05 THEN 'core'
    WHEN x BETWEEN 135.0 AND 135.4 AND y BETWEEN 35.0 AND 35.4 AND
      (CASE WHEN y >= 35.0 AND y < 35.1 AND x < 135.0 + (y - 35.0) * ((135.4 - 135.0) / (35.1 - 35.0)) THEN 1 ELSE 0 END + CASE WHEN y >= 35.1 AND y < 35.4 AND x < 135.4 + (y - 35.1) * ((135.1 - 135.4) / (35.4 - 35.1)) THEN 1 ELSE 0 END + CASE WHEN y >= 35.0 AND y < 35.4 AND x < 135.1 + (y - 35.4) * ((135.0 - 135.1) / (35.0 - 35.4)) THEN 1 ELSE 0 END) % 2 = 1 THEN 'wedge' ELSE 'none' END AS zone FROM p) GROUP BY 1""")
def polygon_zone(spark, d):
    zone = spatial.first_zone(F.col("lon"), F.col("lat"), ZONES)
    return points(spark, d).select(F.coalesce(zone, F.lit("none")).alias("zone")).groupBy("zone").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT CAST(embedding[2] AS DOUBLE) + 135 AS x, CAST(embedding[1] AS DOUBLE) + 35 AS y FROM embeddings)
SELECT zone, count(*) AS n FROM (
  SELECT CASE WHEN x >= 134.95 AND x < 135.05 AND y >= 34.95 AND y < 35.05 THEN 'core'
    WHEN x BETWEEN 135.0 AND 135.4 AND y BETWEEN 35.0 AND 35.4 AND
      (CASE WHEN y >= 35.0 AND y < 35.1 AND x < 135.0 + (y - 35.0) * ((135.4 - 135.0) / (35.1 - 35.0)) THEN 1 ELSE 0 END + CASE WHEN y >= 35.1 AND y < 35.4 AND x < 135.4 + (y - 35.1) * ((135.1 - 135.4) / (35.4 - 35.1)) THEN 1 ELSE 0 END + CASE WHEN y >= 35.0 AND y < 35.4 AND x < 135.1 + (y - 35.4) * ((135.0 - 135.1) / (35.0 - 35.4)) THEN 1 ELSE 0 END) % 2 = 1 THEN 'wedge' ELSE 'none' END AS zone FROM p) GROUP BY 1""")
def zone_join(spark, d):
    """The same zones as rows, found by cells."""
    rings = [(k, name, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, (name, ring) in enumerate(ZONES)]
    zones = spark.createDataFrame(rings, "nth int, use string, ring array<struct<x:double,y:double>>")
    out = spatial.zone_join(points(spark, d), zones)
    return out.select(F.coalesce("use", F.lit("none")).alias("zone")).groupBy("zone").agg(F.count("*").alias("n"))


@query("""
WITH a(alias, category, level) AS (VALUES ('red', 'colour', 1), ('red widget', 'product', 2), ('widget', 'goods', 1), ('ring', 'jewel', 1), ('small ring', 'jewel_s', 2))
SELECT p_partkey AS id, alias, category FROM (
  SELECT p_partkey, alias, category, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, level DESC, alias) AS n
  FROM part JOIN a ON contains(lower(p_name), alias) AND list_contains(string_split(lower(p_name), ' '), string_split(alias, ' ')[1])) WHERE n = 1""")
def alias_match(spark, d):
    a = spark.createDataFrame([("red", "colour", 1), ("red widget", "product", 2), ("widget", "goods", 1), ("ring", "jewel", 1), ("small ring", "jewel_s", 2)], "alias string, category string, level int")
    return select.longest_alias(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), a)


@query("""
SELECT event_type, key, count(DISTINCT user_id) AS users, count(*) AS uses, min(value) AS low, max(value) AS high FROM (SELECT event_type, unnest(json_keys(props)) AS key, user_id, value FROM events) GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 3""")
def tag_frequency(spark, d):
    """Keys of the events' properties: users, uses, range; those of three users or more."""
    e = table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"), "user_id", "value")
    return e.groupBy("event_type", "key").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("uses"), F.min("value").alias("low"), F.max("value").alias("high")).where("users >= 3")


@query("""
SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean20, count(*) AS used FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 20 GROUP BY 1""")
def learned_stats(spark, d):
    """Mean over each user's first twenty values."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 20")
    return x.groupBy("user_id").agg((F.sum(S.exact(F.col("value"))).cast("double") / F.count("*")).alias("mean20"), F.count("*").alias("used"))


@query("""
SELECT o_orderkey, floor(o_totalprice) AS parsed, -floor(o_totalprice) AS minus, CAST(floor(o_totalprice / 1000) AS DOUBLE) * 1e6 AS money FROM orders""")
def money_parse(spark, d):
    """Amounts rendered as filings print them, read back."""
    whole = F.floor("o_totalprice")
    o = table(spark, d, "orders").select("o_orderkey", F.format_number(whole, 0).alias("t"), F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("百万円")).alias("m"))
    return o.select("o_orderkey", S.parse_number(F.col("t")).alias("parsed"), S.parse_number(F.concat(F.lit("△"), "t")).alias("minus"), S.parse_money(F.col("m")).alias("money"))


@query("""
SELECT fy, q, count(*) AS n FROM (SELECT CAST(CASE WHEN month(o_orderdate) > 3 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS INTEGER) AS fy, CAST(((month(o_orderdate) - 3 - 1 + 12) % 12) // 3 + 1 AS INTEGER) AS q FROM orders) GROUP BY 1, 2""")
def quarter_of(spark, d):
    m, y = F.month("o_orderdate"), F.year("o_orderdate")
    x = table(spark, d, "orders").select(S.fiscal_year(y, m, 3).alias("fy"), S.fiscal_quarter(m, 3).alias("q"))
    return x.groupBy("fy", "q").agg(F.count("*").alias("n"))


def halves(spark, d):
    e = table(spark, d, "events")
    shape = lambda x: x.groupBy("user_id", "event_type").agg(F.max("event_id").alias("doc_id"), F.max_by("value", "event_id").alias("a"), F.max_by(F.when(F.col("value") > 5, F.col("value")), "event_id").alias("b")).withColumn("flash", F.col("doc_id") % 7 == 0)
    return shape(e.where("ts < '2024-01-16'")), shape(e.where("ts >= '2024-01-16'"))


HALVES = "".join(f"""{n} AS (SELECT *, doc_id % 7 = 0 AS flash, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS core FROM (
  SELECT user_id, event_type, max(event_id) AS doc_id, arg_max(value, event_id) AS a, arg_max_null(CASE WHEN value > 5 THEN value END, event_id) AS b FROM events WHERE ts {op} TIMESTAMP '2024-01-16' GROUP BY 1, 2))""" + s for n, op, s in (("o", "<", ",\n"), ("n", ">=", "")))  # fmt: skip


@query(f"""WITH {HALVES}
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type,
  CASE WHEN t THEN n.doc_id ELSE o.doc_id END AS doc_id, CASE WHEN t THEN n.flash ELSE o.flash END AS flash, CASE WHEN t THEN n.a ELSE o.a END AS a, CASE WHEN t THEN n.b ELSE o.b END AS b
FROM (SELECT o, n, o IS NULL OR (n IS NOT NULL AND coalesce(((o.flash AND NOT n.flash) OR (o.flash = n.flash AND n.doc_id > o.doc_id) OR o.core = 0) AND NOT (n.core < o.core AND o.core >= 2 AND NOT o.flash), false)) AS t
      FROM o FULL OUTER JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type)""")
def upsert_guard(spark, d):
    """The first half month's store after the second half's documents."""
    old, new = halves(spark, d)
    return merge.guarded_upsert(old, new, ["user_id", "event_type"], ["a", "b"])


@query(f"""WITH {HALVES}
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN o.b IS NOT DISTINCT FROM n.b THEN 'kept' WHEN o.b IS NULL THEN 'filled' WHEN n.b IS NULL THEN 'cleared' ELSE 'changed' END AS kind FROM o JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type) GROUP BY 1""")
def diff_counts(spark, d):
    old, new = halves(spark, d)
    return merge.difference_counts(old, new, ["user_id", "event_type"], "b")


@query(f"""WITH {HALVES}
SELECT o.user_id, o.event_type, o.a, coalesce(o.b, n.b) AS filled, CASE WHEN n.user_id IS NOT NULL THEN n.b ELSE o.b END AS overwritten FROM o LEFT JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type""")
def patch_overwrite(spark, d):
    old, new = halves(spark, d)
    keys = ["user_id", "event_type"]
    filled = merge.patch(old, new, keys, ["b"]).select(*keys, "a", F.col("b").alias("filled"))
    return filled.join(merge.patch(old, new, keys, ["b"], overwrite=True).select(*keys, F.col("b").alias("overwritten")), keys)


@query("""
SELECT source, least(CASE WHEN labelled = 0 THEN 50 ELSE 100 END, coalesce(good, 0) * (0.6 * 100) + coalesce(covered, 0) * (0.4 * 100)) AS confidence FROM (
  SELECT source, count(l.doc_id) AS labelled, CAST(sum(quality) AS DOUBLE) / nullif(count(l.doc_id), 0) AS good, CAST(count(l.doc_id) AS DOUBLE) / count(*) AS covered
  FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1)""")
def confidence_score(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = x.groupBy("source").agg(F.count("quality").alias("labelled"), S.ratio(F.sum("quality"), F.count("quality")).alias("good"), (F.count("quality").cast("double") / F.count("*")).alias("covered"))
    return g.select("source", audit.confidence([(F.col("good"), 0.6), (F.col("covered"), 0.4)], [(F.col("labelled") == 0, 50.0), (F.lit(True), 100.0)]).alias("confidence"))


@query(f"""WITH {NATION_YEARS}
SELECT a.nation, a.year, CASE WHEN b.revenue IS NULL THEN 'MISSING' WHEN b.revenue = 0 THEN CASE WHEN a.revenue = 0 THEN 'VALID' ELSE 'WARNING' END WHEN a.revenue / b.revenue > 5 OR a.revenue / b.revenue < 0.2 THEN 'WARNING' ELSE 'VALID' END AS status
FROM ny a LEFT JOIN ny b ON a.nation = b.nation AND b.year = a.year - 1""")
def yoy_sanity(spark, d):
    y = measures.yoy(nation_years(spark, d).select("nation", "year", "revenue"), "nation", "year", "revenue")
    return y.select("nation", "year", checks.yoy_status(F.col("revenue"), F.col("prev")).alias("status"))


@query("""
SELECT c_mktsegment, status, count(*) AS n FROM (SELECT c_mktsegment, CASE WHEN c_acctbal IS NULL THEN 'MISSING' WHEN c_acctbal < -900 OR c_acctbal > 9500 THEN 'ERROR' WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'WARNING' ELSE 'VALID' END AS status FROM customer) GROUP BY 1, 2""")
def range_rules(spark, d):
    status = checks.range_status(F.col("c_acctbal"), F.lit(-900), F.lit(9500), F.lit(0), F.lit(9000))
    return table(spark, d, "customer").select("c_mktsegment", status.alias("status")).groupBy("c_mktsegment", "status").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, count(*) AS n, count(DISTINCT l_quantity) AS kinds, CASE WHEN count(*) < 2 THEN 'single' WHEN count(DISTINCT l_quantity) = 1 THEN 'all_same' WHEN max(c) * 2 > count(*) THEN 'mostly_same' ELSE 'mixed' END AS kind
FROM (SELECT l_orderkey, l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_quantity) AS c FROM lineitem) GROUP BY 1""")
def sibling_duplicates(spark, d):
    """Lines of an order that share one quantity."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey", "l_quantity").agg(F.count("*").alias("c"))
    g = c.groupBy("l_orderkey").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.max("c").alias("most"))
    kind = F.when(F.col("n") < 2, "single").when(F.col("kinds") == 1, "all_same").when(F.col("most") * 2 > F.col("n"), "mostly_same").otherwise("mixed")
    return g.select("l_orderkey", "n", "kinds", kind.alias("kind"))


@query(f"""WITH {ORDER_SUMS},
x AS (SELECT o_orderkey, total * 3 AS whole, CASE o_orderkey % 4 WHEN 0 THEN total * 3 WHEN 1 THEN total * 0.3 WHEN 2 THEN total * 30 ELSE total * 1000 END AS parts FROM orders JOIN os ON l_orderkey = o_orderkey)
SELECT o_orderkey, CAST(CASE WHEN abs(parts - whole) / nullif(abs(whole), 0) <= 0.5 THEN 1.0 WHEN abs(parts * 10.0 - whole) / nullif(abs(whole), 0) < 0.3 THEN 10.0 WHEN abs(parts * 100.0 - whole) / nullif(abs(whole), 0) < 0.3 THEN 100.0
  WHEN abs(parts * 0.1 - whole) / nullif(abs(whole), 0) < 0.3 THEN 0.1 WHEN abs(parts * 0.01 - whole) / nullif(abs(whole), 0) < 0.3 THEN 0.01 END AS DOUBLE) AS factor FROM x""")
def unit_autocorrect(spark, d):
    k = F.col("o_orderkey") % 4
    x = table(spark, d, "orders").select("o_orderkey").join(order_sums(spark, d), F.col("o_orderkey") == F.col("l_orderkey"))
    parts = F.when(k == 0, F.col("total") * 3).when(k == 1, F.col("total") * 0.3).when(k == 2, F.col("total") * 30).otherwise(F.col("total") * 1000)
    return x.select("o_orderkey", checks.unit_fix(F.col("total") * 3, parts).alias("factor"))


@query("""
SELECT n_name, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean, CAST(sum(CAST(s_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS total, arg_max(s_name, {'b': s_acctbal, 'n': s_name}) AS best,
  row_number() OVER (ORDER BY sum(CAST(s_acctbal AS DECIMAL(18,4))) DESC, n_name) AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1 HAVING count(*) >= 3""")
def sector_overview(spark, d):
    """Sectors of three members or more: mean, total, best member, place."""
    x = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    dec = F.sum(S.exact(F.col("s_acctbal")))
    g = x.groupBy("n_name").agg(F.count("*").alias("n"), (dec.cast("double") / F.count("*")).alias("mean"), dec.cast("double").alias("total"), F.max_by("s_name", F.struct("s_acctbal", "s_name")).alias("best")).where("n >= 3")
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "n_name")).cast("bigint"))  # one row a sector


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT r_name AS parent, n_name AS child FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT DISTINCT n_name, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
t(id, parent, level, path) AS (SELECT DISTINCT parent, CAST(NULL AS VARCHAR), 0, parent FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, e.parent, t.level + 1, t.path || '/' || e.child FROM t JOIN e ON t.id = e.parent)
SELECT id, parent, CAST(level AS INTEGER) AS level, path FROM t""")
def tree_layout(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    up = n.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    down = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("parent"), F.col("s_name").alias("child"))
    return tree.layout(up.unionByName(down)).drop("ids")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_upsert(spark, d):
    """The newest event of each user and type in a store that a stream keeps: late rows, here the older half, come second."""
    from ledgerline.session import shared_path
    from ledgerline.streaming import upsert

    path = shared_path(spark, "stream")
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    for late in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        e.where(late).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
        started = upsert.stream_upsert(stream, f"{path}/store", f"{path}/state", ["user_id", "event_type"], ["event_id"], ["event_id", "value"], buckets=8).trigger(availableNow=True).start()
        started.awaitTermination()
    return upsert.read_store(spark, f"{path}/store")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def daily_windows(spark, d):
    from ledgerline.streaming.upsert import windowed_counts

    e = table(spark, d, "events").withColumn("value", S.exact(F.col("value")))
    return windowed_counts(e, "ts", "event_type", "value").select(F.col("w.start").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))
