"""Queries of classifications, overrides and checks over the star tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import checks, classify, text
from ledgerline.plans.star import query, table


@query("""
SELECT class, count(*) AS n FROM (SELECT CASE WHEN contains(lower(p_name), 'ring') THEN 'jewel' WHEN contains(lower(p_name), 'widget') OR contains(lower(p_name), 'gadget') THEN 'device' WHEN contains(lower(p_name), 'red') THEN 'red' ELSE 'other' END AS class FROM part) GROUP BY 1""")
def keyword_classes(spark, d):
    c = classify.keyword_class(F.col("p_name"), [("jewel", ["Ring"]), ("device", ["widget", "gadget"]), ("red", ["RED"])])
    return table(spark, d, "part").select(c.alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("""
SELECT class, count(*) AS n FROM (SELECT CASE WHEN s_nationkey IN (1, 2) OR s_acctbal < -500 THEN 'bank' WHEN s_suppkey % 2 = 0 AND abs(s_acctbal) > 2 * 3000 THEN 'investment_holding'
  WHEN s_suppkey % 2 = 0 AND s_acctbal / nullif(CAST(s_nationkey AS DOUBLE) * 1000, 0) > 0.05 THEN 'retail' WHEN s_suppkey % 2 = 0 THEN 'ifrs' ELSE 'general' END AS class FROM supplier) GROUP BY 1""")
def company_classes(spark, d):
    b, n = F.col("s_acctbal"), F.col("s_nationkey")
    c = classify.company_class(n.cast("string"), ["1", "2"], b < -500, F.col("s_suppkey") % 2 == 0, b, F.lit(3000.0), b, n.cast("double") * 1000)
    return table(spark, d, "supplier").select(c.alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_extendedprice IS NULL THEN 'missing' WHEN abs(l_extendedprice) < 1000 THEN 'too_small' WHEN l_returnflag = 'R' AND s > 1 THEN 'exceeds_revenue' WHEN l_returnflag = 'A' AND s > 2 THEN 'over_200_percent'
  WHEN l_returnflag = 'N' AND NOT (s BETWEEN 0.3 AND 10) THEN 'ratio_out_of_range' ELSE 'fine' END AS reason FROM (SELECT *, abs(l_extendedprice) / nullif(abs(o_totalprice), 0) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey)) GROUP BY 1""")
def patch_plausibility(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    kind = F.when(F.col("l_returnflag") == "R", "part").when(F.col("l_returnflag") == "A", "income").otherwise("cash")
    return x.select(F.coalesce(classify.plausibility(F.col("l_extendedprice"), F.col("o_totalprice"), kind), F.lit("fine")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, n, known, CASE WHEN known = 0 THEN 'ALL_NA' WHEN cp AND n > 1 THEN 'COPY_FROM_TOTAL' WHEN known > 1 AND kinds = 1 THEN 'ALL_SAME' WHEN known < n THEN 'PARTIAL_NA' ELSE 'OK' END AS issue FROM (
  SELECT l_orderkey, count(*) AS n, count(v) AS known, count(DISTINCT v) AS kinds, coalesce(bool_or(CASE WHEN greatest(abs(v), abs(o_totalprice)) = 0 THEN 0 ELSE abs(v - o_totalprice) / greatest(abs(v), abs(o_totalprice)) END < 0.01) FILTER (WHERE v IS NOT NULL), false) AS cp
  FROM (SELECT l_orderkey, CASE WHEN l_discount < 0.09 THEN l_extendedprice END AS v, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1)""")
def segment_issue_class(spark, d):
    """Lines as segments of their order; deeply discounted ones count as unknown."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return classify.segment_issues(x.withColumn("v", F.when(F.col("l_discount") < 0.09, F.col("l_extendedprice"))), "l_orderkey", "v", "o_totalprice")


@query("SELECT user_id, arg_max(event_type, {'r': CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 1 ELSE 0 END, 's': event_type}) AS status FROM events GROUP BY 1")
def health_rollup(spark, d):
    return classify.worst(table(spark, d, "events").select("user_id", F.col("event_type").alias("status")), "user_id", {"error": 3, "signup": 1, "view": 0, "click": 0, "purchase": 0})


@query("""
SELECT n_nationkey, coalesce(CASE WHEN n_nationkey < 3 THEN 'first ' || n_name END, CASE WHEN n_regionkey = 1 THEN 'second ' || n_name END, lower(n_name)) AS label FROM nation""")
def label_fallback(spark, d):
    n = table(spark, d, "nation")
    first = n.where("n_nationkey < 3").select("n_nationkey", F.concat(F.lit("first "), "n_name").alias("label"))
    second = n.where("n_regionkey = 1").select("n_nationkey", F.concat(F.lit("second "), "n_name").alias("label"))
    return classify.label_chain(n.select("n_nationkey", "n_name"), [first, second], "n_nationkey", "label", F.lower("n_name")).select("n_nationkey", "label")


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_brand = 'Brand#1' AND contains(p_name, 'ring') THEN 'rings1' WHEN p_brand = 'Brand#1' AND contains(p_name, 'red') THEN 'red1' WHEN p_brand = 'Brand#2' AND contains(p_name, 'small') THEN 'small2' END, p_type) AS category FROM part""")
def mapping_override(spark, d):
    o = spark.createDataFrame([("Brand#1", "ring", 0, "rings1"), ("Brand#1", "red", 1, "red1"), ("Brand#2", "small", 2, "small2")], "p_brand string, part string, ordinal int, category string")
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.col("p_type").alias("category"))
    return classify.override(rows, o, "p_brand", "p_name").select("p_partkey", "category")


@query("""
SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 6) AS median_a, round(quantile_cont(t, 0.5), 6) AS median_b, round(quantile_cont((o_totalprice - t) / nullif(abs(t), 0) * 100, 0.5), 6) AS median_gap, round(count(*) FILTER (WHERE o_totalprice > t) * 100 / count(*), 6) AS higher
FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) >= 5""")
def cross_validation(spark, d):
    """Order totals against line sums by priority: medians and gaps."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(S.exact(F.col("l_extendedprice"))).cast("double").alias("t"))
    x = table(spark, d, "orders").join(t, F.col("l_orderkey") == F.col("o_orderkey"))
    out = classify.paired_medians(x, "o_orderpriority", "o_totalprice", "t", 5)
    return out.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("median_a", "median_b", "median_gap", "higher")])


@query("""
WITH r AS (SELECT user_id, event_type, CAST(date_trunc('day', ts) AS DATE) AS run, value FROM events),
m AS (SELECT user_id FROM (SELECT DISTINCT user_id, run FROM r) GROUP BY 1 HAVING count(*) >= 2)
SELECT user_id, event_type, count(*) AS n, max(value) - min(value) AS spread FROM r WHERE user_id IN (SELECT user_id FROM m) GROUP BY 1, 2""")
def run_variance(spark, d):
    """Days as runs, event types as positions."""
    return classify.run_variance(table(spark, d, "events").withColumn("run", F.to_date("ts")), "user_id", "run", "event_type", "value")


@query("""
WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT user_id, list(DISTINCT event_type) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-28' GROUP BY 1)
SELECT user_id, array_to_string(list_sort([x for x in a.k if NOT list_contains(b.k, x)]), ',') AS missing FROM a JOIN b USING (user_id) WHERE len([x for x in a.k if NOT list_contains(b.k, x)]) > 0""")
def diff_latest(spark, d):
    """Event types of a user's first half month that its last days lack."""
    e = table(spark, d, "events")
    kinds = lambda x: x.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    out = classify.missing_keys(kinds(e.where("ts < '2024-01-16'")), kinds(e.where("ts >= '2024-01-28'")), "user_id", "k")
    return out.select("user_id", F.array_join("missing", ",").alias("missing"))


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS current, count(*) FILTER (WHERE event_type = 'signup') AS interim FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase' AND value > 100) = 0 AND count(*) FILTER (WHERE event_type = 'signup') > 0""")
def interim_contamination(spark, d):
    """Users with sign-ups (interim) and no purchase over 100 (current year)."""
    e = table(spark, d, "events")
    c = F.when((F.col("event_type") == "purchase") & (F.col("value") > 100), "CurrentYear").when(F.col("event_type") == "signup", "Interim").otherwise("x")
    bad = classify.contaminated(e.withColumn("c", c), "user_id", "c").select("user_id")
    return e.join(bad, "user_id", "left_semi").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("current"), F.count_if(F.col("event_type") == "signup").alias("interim"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, pos, sum(length(line) - length(replace(line, '.', ''))) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM l)
SELECT doc_id, CAST(arg_max(pos, {'s': s, 'p': pos}) AS INTEGER) AS pos, CAST(max(s) AS BIGINT) AS sum FROM w WHERE s >= 5 GROUP BY 1""")
def densest_lines(spark, d):
    """The four lines of a document with the most full stops."""
    dots = F.length("line") - F.length(F.replace(F.col("line"), F.lit("."), F.lit("")))
    return classify.densest(text.lines(table(spark, d, "documents")), "doc_id", "pos", dots, 4, 5)


@query("""
WITH x AS (
  SELECT o_orderkey, unnest([{'c': 'balance', 'e': o_totalprice, 'a': t, 'tol': 0.03}, {'c': 'gross_profit', 'e': t * 0.9, 'a': t - dsc, 'tol': 0.01}]) AS k
  FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS t, CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS dsc FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT check_name, count(*) AS n, count(*) FILTER (WHERE passed) AS passed FROM (SELECT k.c AS check_name, coalesce(abs(k.a - k.e) <= k.tol * abs(k.e), true) AS passed FROM x) GROUP BY 1""")
def statement_checks(spark, d):
    """Two statement equations on orders: total against lines, and lines less discounts against nine tenths."""
    e = F.col("l_extendedprice")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(S.exact(e)).cast("double").alias("revenue"), F.sum(S.exact(e * F.col("l_discount"))).cast("double").alias("cost_of_sales"))
    x = table(spark, d, "orders").join(g, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.col("o_totalprice").alias("total_assets"), F.lit(0.0).alias("total_liabilities"), F.col("revenue").alias("total_equity"), "revenue", "cost_of_sales", (F.col("revenue") * 0.9).alias("gross_profit"))
    c = checks.statement_checks(x, ["o_orderkey"])
    return c.groupBy("check_name").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@query("""
SELECT c_mktsegment, c_custkey, place FROM (SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_nationkey < 5 THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM customer) WHERE place <= 10""")
def members_first(spark, d):
    """Ten of each segment, members of the first nations before all others."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.when(F.col("c_nationkey") < 5, 0).otherwise(1), F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("place", F.row_number().over(w)).where("place <= 10").select("c_mktsegment", "c_custkey", "place")


@query("""
SELECT event_type, check_name, count(*) AS failures FROM (SELECT event_type, unnest(list_filter([CASE WHEN value < 1 THEN 'low' END, CASE WHEN value > 60 THEN 'high' END, CASE WHEN user_id % 10 = 0 THEN 'round_user' END], lambda x: x IS NOT NULL)) AS check_name FROM events) GROUP BY 1, 2""")
def failure_pivot(spark, d):
    """Failed checks of events, one row each, counted by type and check."""
    v = F.col("value")
    failed = F.array_compact(F.array(F.when(v < 1, "low"), F.when(v > 60, "high"), F.when(F.col("user_id") % 10 == 0, "round_user")))
    return table(spark, d, "events").select("event_type", F.explode(failed).alias("check_name")).groupBy("event_type", "check_name").agg(F.count("*").alias("failures"))
