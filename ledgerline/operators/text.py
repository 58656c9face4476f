"""Report text: terms, ranking, chunks, sections, lines, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Alphanumeric runs as they stand, and CJK runs in non-overlapping pairs (an odd last character alone)."""
    return F.regexp_extract_all(text, F.lit(r"([぀-ヿ㐀-鿿]{1,2}|(?:(?![぀-ヿ㐀-鿿])[\p{L}\p{N}])+)"), 1)


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, place: each query's best documents; both inputs are (id, text).

    Query terms count with their multiplicity. Term and document counts are aggregates; a query meets only the
    documents that hold one of its terms.
    """
    tf = docs.select(F.col("id").alias("doc_id"), F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    length = docs.select(F.col("id").alias("doc_id"), F.size(terms(F.col("text"))).alias("len"))
    totals = length.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select(F.col("id").alias("query_id"), F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    rows = asked.join(df, "term").join(tf, "term").join(length, "doc_id").crossJoin(F.broadcast(totals))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("qn") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(part.cast("decimal(28,12)")).cast("double"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def question_documents(docs: DataFrame, questions: DataFrame, section: str, k: int = 3, least: int = 1) -> DataFrame:
    """query_id, doc_id, place: a section's first ``least`` documents (id, text, ordinal, section) for every question (id,
    text), then the best of its other ones by BM25, measured among those only; ``k`` in all, filled up in order with
    documents that hold none of the question's terms."""
    own = docs.where(F.col("section") == section).select(F.struct("ordinal", "id").alias("id"), "text")
    head = own.orderBy("id").limit(least).select("id")
    asked = questions.select(F.col("id").alias("query_id"))
    each = lambda few, score: asked.crossJoin(F.broadcast(few)).select("query_id", F.col("id").alias("doc_id"), score.alias("score"))  # noqa: E731  at most ``k`` rows
    found = each(head, F.lit(float("inf")))
    if k > least:
        rest = own.join(head, "id", "left_anti")
        best = bm25(rest, questions, k - least).select("query_id", "doc_id", "score")
        # Among the first k - least there are as many without a term as can be needed.
        spare = each(rest.orderBy("id").limit(k - least).select("id"), F.lit(0.0))
        found = found.unionByName(best).unionByName(spare.join(best, ["query_id", "doc_id"], "left_anti"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("place", place).where(F.col("place") <= max(k, least)).select("query_id", F.col("doc_id.id").alias("doc_id"), "place")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def boilerplate(rows: DataFrame, least_docs: int) -> DataFrame:
    """Lines that stand in at least so many documents."""
    return rows.where("length(trim(line)) > 0").groupBy("line").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("uses")).where(F.col("docs") >= least_docs)


def context_lines(rows: DataFrame, pattern: str, around: int = 2) -> DataFrame:
    """Lines that match and so many before and after, with a mark where lines were left out before."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    hit = F.max(F.col("line").rlike(pattern).cast("int")).over(w.rowsBetween(-around, around))
    kept = rows.withColumn("_hit", hit).where("_hit = 1").drop("_hit")
    return kept.withColumn("after_gap", F.col("pos") > F.coalesce(F.lag("pos").over(w) + 1, F.lit(0)))


def paragraph_chunks(docs: DataFrame, most: int = 6000, overlap: int = 500) -> DataFrame:
    """doc_id, chunk, content: paragraphs packed up to ``most`` characters; a last paragraph under ``overlap`` characters
    opens the next chunk as well. The fold is a higher-order function: no Python."""
    step = """aggregate(filter(split(coalesce(text, ''), '\\n\\n|\\n'), p -> length(trim(p)) > 0),
      named_struct('done', cast(array() as array<string>), 'cur', cast('' as string), 'last', cast('' as string)),
      (a, p) -> CASE
        WHEN a.cur = '' THEN named_struct('done', a.done, 'cur', p, 'last', p)
        WHEN length(a.cur) + 1 + length(p) <= {most} THEN named_struct('done', a.done, 'cur', concat(a.cur, '\\n', p), 'last', p)
        ELSE named_struct('done', array_append(a.done, a.cur), 'cur', CASE WHEN length(a.last) < {overlap} THEN concat(a.last, '\\n', p) ELSE p END, 'last', p) END,
      a -> CASE WHEN a.cur = '' THEN a.done ELSE array_append(a.done, a.cur) END)""".format(most=most, overlap=overlap)
    return docs.select("doc_id", F.posexplode(F.expr(step)).alias("chunk", "content"))


def sections(docs: DataFrame, heading: str = r"(?m)^\s*(Item\s+\d+[AB]?)\b") -> DataFrame:
    """doc_id, section, content: the text from each heading to the next; the longest part of a repeated heading stays, so
    a table of contents gives way to the section itself."""
    cut = F.split(F.regexp_replace("text", heading, "\u0001$1\u0002"), "\u0001")
    parts = docs.select("doc_id", F.posexplode(cut).alias("pos", "part")).where(F.contains("part", F.lit("\u0002")))
    parts = parts.select("doc_id", "pos", F.regexp_replace(F.split_part("part", F.lit("\u0002"), F.lit(1)), r"\s+", " ").alias("section"), F.split_part("part", F.lit("\u0002"), F.lit(2)).alias("content"))
    return parts.groupBy("doc_id", "section").agg(F.max_by("content", F.struct(F.length("content"), -F.col("pos"))).alias("content"))


def table_cells(pages: DataFrame) -> DataFrame:
    """page_id, row, col, content of the cells between <tr> and <td> or <th>."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("row", "tr"))
    cells = rows.select("page_id", "row", F.posexplode(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1)).alias("col", "td"))
    return cells.select("page_id", "row", "col", F.trim(F.regexp_replace("td", r"<[^>]*>", "")).alias("content"))


def number_mentions(docs: DataFrame) -> DataFrame:
    """doc_id, nth, value, unit: every figure with a unit in the text."""
    found = F.regexp_extract_all("text", F.lit(r"(\d[\d,]*(?:\.\d+)?\s*(?:%|兆円|億円|百万円|million|billion))"), 1)
    rows = docs.select("doc_id", F.posexplode(found).alias("nth", "m"))
    return rows.select("doc_id", "nth", F.regexp_replace(F.regexp_extract("m", r"([\d,.]+)", 1), ",", "").try_cast("double").alias("value"), F.trim(F.regexp_extract("m", r"([^\d,.\s]+)$", 1)).alias("unit"))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, same: list[str]) -> DataFrame:
    """query_id, id, score, place: each query's ``k`` vectors with the largest inner products (rounded to nine places), ties
    to smaller ids, among those that equal it in the columns ``same``; its own id is no match. Both inputs are (id, vector
    and those columns); every query meets every row of its filter, and only the best of each partition are shuffled."""
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("_q"), *same)
    v = vectors.select("id", F.col("vector").cast("array<double>").alias("_v"), *same)
    dot = F.aggregate(F.zip_with("_q", "_v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if not same:
        raise ValueError("without a filter use an index")
    both = v.join(q, same)
    scored = both.where("query_id <> id").select("query_id", "id", F.round(dot, 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)
