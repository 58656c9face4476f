"""Queries over texts, pages and conversations, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import text as T
from ledgerline.plans.star import query, table

TERMS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"


@query(rf"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format("text")}) AS term FROM documents) GROUP BY 1, 2),
len AS (SELECT doc_id, len({TERMS.format("text")}) AS len FROM documents), tot AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS qn FROM (SELECT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (
  SELECT item_id, doc_id, round(CAST(sum(CAST(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean)) AS DECIMAL(28,12))) AS DOUBLE), 6) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id), tot GROUP BY 1, 2)
SELECT item_id AS query_id, doc_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 5""")
def bm25_topk(spark, d):
    """The five documents that rank best for each benchmark passage."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return T.bm25(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 5)


@query(r"""
SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS uses FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) > 0 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def boilerplate_lines(spark, d):
    return T.boilerplate(T.lines(table(spark, d, "documents")), 3)


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT *, max(CASE WHEN regexp_matches(line, '[Ll]icense|rights') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hit FROM l)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, line, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 1, 0) AS after_gap FROM h WHERE hit = 1""")
def context_lines(spark, d):
    """Licence lines with two lines around them."""
    return T.context_lines(T.lines(table(spark, d, "documents")), "[Ll]icense|rights")


@query()
def chunks(spark, d):
    """Paragraph chunks of every document: lengths and beginnings."""
    c = T.paragraph_chunks(table(spark, d, "documents"), 1200, 200)
    return c.select("doc_id", "chunk", F.length("content").alias("chars"), F.md5(F.col("content").cast("binary")).alias("md5"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, '. ') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, length(s[1]) AS first_chars, CAST(sum_chars AS BIGINT) AS chars FROM (SELECT *, list_sum([length(x) for x in s]) AS sum_chars FROM l)""")
def section_stats(spark, d):
    """Sentences of every document: how many, the first one's length, all lengths."""
    s = F.split("text", r"\. ")
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("sentences"), F.length(s[0]).cast("bigint").alias("first_chars"), F.aggregate(s, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("chars"))


@query()
def sections(spark, d):
    """Pages cut at headings."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", r"(?is)<h([1-6])\b", "\nItem $1 <h$1").alias("text"))
    return T.sections(pages).select("doc_id", "section", F.length("content").alias("chars"))


@query()
def html_text(spark, d):
    """Text of every page."""
    return table(spark, d, "pages").select("page_id", S.plain_text(F.col("html")).alias("text"))


@query(r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS links, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages""")
def html_links(spark, d):
    """Links and title of every page."""
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("links"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


@query()
def html_tables(spark, d):
    """Cells of tables in pages; list items stand in for rows where a page has no table."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("html", r"(?i)<(/?)ul\b[^>]*>", "<$1tr>"), r"(?i)<(/?)li\b[^>]*>", "<$1td>").alias("html"))
    return T.table_cells(pages)


@query(r"""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS asked FROM conversations""")
def forward_fill(spark, d):
    """Every turn with the last user text before or at it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("asked"))


@query(r"""
WITH l AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS s, string_split(text, '. ') AS t FROM conversations)
SELECT conv_id, turn, role, s[k] AS line, t[k] AS sentence, CAST(k AS INTEGER) AS k FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM l WHERE len(s) = len(t))""")
def zip_pairs(spark, d):
    """Lines and sentences of a turn side by side where there are as many of each."""
    c = table(spark, d, "conversations").withColumns({"s": F.split("text", "\n"), "t": F.split("text", r"\. ")}).where("size(s) = size(t)")
    x = c.select("conv_id", "turn", "role", F.posexplode(F.arrays_zip("s", "t")).alias("p", "z"))
    return x.select("conv_id", "turn", "role", F.col("z.s").alias("line"), F.col("z.t").alias("sentence"), (F.col("p") + 1).alias("k"))


@query("""
SELECT query_id, vec_id, CAST(place AS INTEGER) AS place FROM (
  SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS place
  FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE place <= 3""")
def vector_search(spark, d):
    """For every vector whose id is divisible by 20, the three nearest with its label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    out = T.vector_search(e, e.where("id % 20 = 0"), 3, ["label"])
    return out.select("query_id", F.col("id").alias("vec_id"), "place")
