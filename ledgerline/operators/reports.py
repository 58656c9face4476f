"""Reports: their layered checks, what is scraped from them, and texts handed to a caller's own scorer."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import gap, present

#: The sections and figures a report has, and words that explain a leap.
SECTIONS = ["company_overview", "financial_highlights", "business_risks", "md_and_a", "segment_analysis", "esg_governance"]
FIGURES = ["revenue", "operating_profit", "net_profit"]
EXPLAINS = "買収|合併|事業譲渡|再編|m&a|統合"


def layered_checks(reports: DataFrame) -> DataFrame:
    """``reports`` with ``findings``: array of struct(layer, level, what), in order, and ``confidence``.

    Columns: sections map<string,string>, figures map<string,struct<current,previous,yoy>>, segments array<struct<name,
    revenue,yoy>>, store map<string,double>, drivers string, high_risks int, guidance_yoy double. L1 is what is missing, L2
    arithmetic (segments' sum off by 5 per cent an issue, by 2 a warning; growth off by 1 point; all segments with one growth
    or one revenue), L3 the store's figures (1 per cent), L4 leaps over 50 per cent that no text explains, L5 drivers that
    name no segment, more than ten high risks, guidance 20 points off. Confidence loses 5 an issue, 30 at most.
    """
    fig = lambda f: F.col("figures")[f]
    out = lambda layer, level, what, test: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(layer).alias("layer"), F.lit(level).alias("level"), F.lit(what).alias("what")))
    rows = [out("L1", "issue", f"missing {s}", F.coalesce(F.col("sections")[s], F.lit("")) == "") for s in SECTIONS]
    rows += [out("L1", "warning", f"no {f}", fig(f)["current"].isNull()) for f in FIGURES]
    rows += [out("L1", "warning", "no segments", F.coalesce(F.size("segments"), F.lit(0)) <= 0), out("L1", "issue", "unnamed segment", F.exists("segments", lambda s: F.coalesce(s["name"], F.lit("")) == ""))]
    revenues = F.filter(F.transform("segments", lambda s: s["revenue"]), lambda r: r.isNotNull())
    total = fig("revenue")["current"]
    summed = F.aggregate(revenues, F.lit(0.0), lambda n, r: n + r)
    off = F.when(summed > 0, F.abs(summed - total) / present(total) * 100)
    rows += [out("L2", "issue", "segment sum", off > 5), out("L2", "warning", "segment sum", (off > 2) & (off <= 5))]
    for f in FIGURES:
        want = (fig(f)["current"] - fig(f)["previous"]) / present(fig(f)["previous"]) * 100
        rows.append(out("L2", "issue", f"{f} growth", F.abs(want - fig(f)["yoy"]) > 1))
    growths = F.filter(F.transform("segments", lambda s: s["yoy"]), lambda y: y.isNotNull())
    one = lambda a: (F.size(a) > 1) & (F.size(F.array_distinct(a)) == 1)
    copied = F.abs(F.get(growths, F.lit(0)) - fig("revenue")["yoy"]) < 0.1
    sold = F.filter(revenues, lambda r: r > 0)
    rows += [out("L2", "issue", "one growth, the company's", one(growths) & copied), out("L2", "warning", "one growth", one(growths) & ~F.coalesce(copied, F.lit(False))), out("L2", "issue", "one revenue", one(sold))]
    rows += [out("L3", "issue", f"{f} differs", F.abs(present(fig(f)["current"]) - F.col("store")[f]) / present(F.abs(F.col("store")[f])) > 0.01) for f in FIGURES]
    said = F.lower(F.concat_ws(" ", F.col("sections")["business_risks"], F.col("sections")["md_and_a"]))
    rows += [out("L4", "warning", f"{f} leap", (F.abs(fig(f)["yoy"]) > 50) & ~said.rlike(EXPLAINS)) for f in FIGURES]
    words = F.split(F.lower("drivers"), r"\s+")
    named = F.exists("segments", lambda s: F.arrays_overlap(F.split(F.lower(s["name"]), r"\s+"), words))
    rows += [out("L5", "warning", "drivers name no segment", (F.length("drivers") > 0) & (F.size("segments") > 0) & ~F.coalesce(named, F.lit(False)))]
    rows += [out("L5", "warning", "many high risks", F.col("high_risks") > 10), out("L5", "warning", "guidance", F.abs(present(F.col("guidance_yoy")) - present(fig("revenue")["yoy"])) > 20)]
    found = F.array_compact(F.array(*rows))
    issues = F.size(F.filter("findings", lambda x: x["level"] == "issue"))
    return reports.withColumn("findings", found).withColumn("confidence", 100 - F.least(F.lit(30), issues * 5))


#: Labels of the scoreboard's figures.
BOARD = {"operating_income": "営業利益[:：]\\s*([^(\\n]+)", "dividend_per_share": "1株配当[:：]\\s*([^(\\n]+)", "interest_bearing_debt": "有利子負債.*[:：]\\s*([^(\\n]+)", "ebitda": "EBITDA[:：]\\s*([^(\\n]+)", "net_debt": "Net Debt.*[:：]\\s*([^(\\n]+)"}


def report_part(text: Column, heading: str, mark: str = "##") -> Column:
    """What stands under a heading, up to the next of its rank; null without it."""
    return F.nullif(F.regexp_extract(text, rf"(?s){mark} {heading}[^\n]*\n(.*?)(?={mark}|\z)", 1), F.lit(""))


def scoreboard(text: Column) -> Column:
    """Map of the scoreboard's figures, as printed."""
    board = report_part(text, "数字で見る")
    pairs = [F.struct(F.lit(k), F.nullif(F.trim(F.regexp_extract(board, p, 1)), F.lit(""))) for k, p in BOARD.items()]
    return F.map_filter(F.map_from_entries(F.array(*pairs)), lambda k, v: v.isNotNull())


def segment_growths(text: Column) -> Column:
    """Growth figures of the segments' sales, in order."""
    part = report_part(text, "セグメント別ハイライト")
    return F.transform(F.regexp_extract_all(part, F.lit(r"売上高[:：][^(]*\(([+-]?\d+\.?\d*)%\)"), 1), lambda x: x.cast("double"))


def report_issues(text: Column) -> Column:
    """What is wrong with a report's text: figures printed as N/A; three segments or more with one growth, or 70 per cent of
    them within a tenth of a point of the first."""
    board, growth = scoreboard(text), segment_growths(text)
    missing = [F.when(board[k] == "N/A", f"{k} N/A") for k in ("operating_income", "dividend_per_share", "interest_bearing_debt", "ebitda")]
    near = F.size(F.filter(growth, lambda y: F.abs(y - F.get(growth, F.lit(0))) < 0.1))
    same = F.when((F.size(growth) >= 3) & (F.size(F.array_distinct(growth)) == 1), "one growth").when((F.size(growth) >= 3) & (near >= 0.7 * F.size(growth)), "like growth")
    return F.array_compact(F.array(*missing, same))


def rewritten_figures(lines: DataFrame, facts: DataFrame, key: str, labels: dict[str, str], tolerance: float = 0.01) -> DataFrame:
    """Lines (key, pos, line) with a labelled figure in 億円 brought to the facts (key, field, value in yen) where it is off by
    more than the tolerance. Lines under a segment's heading (``####``) are the segments' own and stay; so do lines whose
    figure agrees, is no number or has no fact. Adds ``changed``."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("line").rlike("^#"), F.col("line").rlike("^#{4,}"))
    out = lines.withColumn("_own", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit(False)))
    pattern = "({label}[^\\d△-]*)([\\d,]+(?:\\.\\d+)?)(億円)"
    field = F.coalesce(*[F.when(F.col("line").rlike(pattern.format(label=label)), f) for f, label in labels.items()])
    number = F.coalesce(*[F.nullif(F.regexp_extract("line", pattern.format(label=label), 2), F.lit("")) for label in labels.values()])
    out = out.withColumns({"field": field, "_said": F.regexp_replace(number, ",", "").try_cast("double") * 1e8}).join(facts.select(key, "field", F.col("value").alias("_fact")), [key, "field"], "left")
    wrong = ~F.col("_own") & F.coalesce(gap(F.col("_said"), F.col("_fact")) > tolerance, F.lit(False))
    shown = F.regexp_replace(F.format_number(F.col("_fact") / 1e8, 0), "$", "")
    new = F.coalesce(*[F.when(F.col("field") == f, F.regexp_replace(F.col("line"), F.lit(pattern.format(label=label)), F.concat(F.lit("$1"), shown, F.lit("$3")))) for f, label in labels.items()])
    return out.select(key, "pos", F.when(wrong, new).otherwise(F.col("line")).alias("line"), wrong.alias("changed"))


#: Headings of annual reports and the sections they open.
ITEMS = {"1": "01_business", "1A": "02_risk_factors", "7": "03_mda", "8": "04_financial_statements"}
KEYWORDS = [("03_mda", r"Management'?s\s+Discussion\s+and\s+Analysis"), ("02_risk_factors", r"Risk\s+Factors\b"), ("01_business", r"(?:Description\s+of\s+Business|Business\s+Overview)"), ("04_financial_statements", r"Financial\s+Statements\s+and\s+Supplementary")]
_HEADS = [re.compile(p, re.M | re.I) for p in (r"^\s*Item\s+(\d{1,2}[ABC]?)\s*[.:–—-]", r"^\s*Item\s+(\d{1,2}[ABC]?)\b")]
_JUNK = re.compile(r"(https?://fasb\.org|us-gaap:|xbrli:|iso4217:|\d{10}\s+\w+:)", re.I)
_PART = re.compile(r"^\s*PART\s+I\s*$", re.M | re.I)


def split_items(text: str | None) -> list[tuple[str, str]]:
    """(section, content) of an annual report, in order.

    Machine data before the first sentence goes. The contents end where Part I is named for the second time; an end past 30
    per cent of the text is not believed. Then the first heading of each item counts, looser patterns after stricter ones;
    five headings or more within 1,500 characters are contents too. Without items, headings by keyword (but for lines that
    end in a page number) cut the text, and without those it is one section.
    """
    text = (text or "").replace("\xa0", " ")
    lines = text.split("\n")
    start = 0
    while start < len(lines) and (not lines[start].strip() or (len(lines[start]) > 500 and _JUNK.search(lines[start])) or (len(lines[start]) > 100 and lines[start].strip().startswith(("true", "false")))):
        start += 1
    text = "\n".join(lines[start:])
    body = 0
    contents = text.lower().find("table of contents")
    if contents >= 0:
        parts = [m.start() for m in _PART.finditer(text, contents + 100)]
        body = (parts[1] if len(parts) > 1 else parts[0]) if parts else contents + 5000
    if body > len(text) * 0.3:
        body = 0
    at: dict[str, int] = {}
    for head in _HEADS:
        for m in head.finditer(text, body):
            at.setdefault(m[1].upper(), m.start())
    places = sorted(at.values())
    if len(places) >= 5 and places[-1] - places[0] < 1500:
        at = {}
    if at:
        marks = sorted((p, ITEMS.get(i, f"item_{i}")) for i, p in at.items())
        cover = text[body : marks[0][0]].strip()
        out = [("00_cover", cover)] if len(cover) > 100 else []
        least = 50
    else:
        marks, out, least = [], [], 200
        for name, words in KEYWORDS:
            found = [m for m in re.finditer(words, text, re.I) if not re.match(r"[\s.\-]*(?:Page\s*)?\d{1,3}\s*$", text[m.end() :].split("\n", 1)[0])]
            best = next((m for m in found[1:] if m[0].isupper()), found[0] if found else None)
            if best:
                marks.append((text.rfind("\n", 0, best.start()) + 1, name))
        marks.sort()
        if not marks:
            return [("00_full_text", text)] if text else []
    for (a, name), b in zip(marks, [*(m[0] for m in marks[1:]), len(text)]):
        part = text[a:b].strip()
        if len(part) >= least:
            out.append((name, part))
    return out


def item_sections(docs: DataFrame) -> DataFrame:
    """doc_id, nth, section, content of annual reports (doc_id, text)."""

    def cut(batches):
        for batch in batches:
            rows = [(i, k, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, s in enumerate(split_items(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "nth", "section", "content"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id bigint, nth int, section string, content string")


def page_chunks(pages: DataFrame, tokens: int = 6000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk, content, first_page, last_page: a document's pages (doc_id, page, text) packed up to so many tokens (two
    characters each); a new chunk opens with the last ``overlap`` * 3 characters of the one before, if that is longer. The
    fold is a higher-order function over a document's pages in order."""
    held = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("pages"))
    step = f"""aggregate(pages,
      named_struct('done', cast(array() as array<struct<content:string,first:bigint,last:bigint>>), 'cur', '', 'first', cast(null as bigint), 'last', cast(null as bigint)),
      (a, p) -> CASE
        WHEN a.cur = '' THEN named_struct('done', a.done, 'cur', p.text, 'first', coalesce(a.first, cast(p.page as bigint)), 'last', cast(p.page as bigint))
        WHEN length(a.cur) + 2 + length(p.text) <= {2 * tokens + 1} THEN named_struct('done', a.done, 'cur', concat(a.cur, '\\n\\n', p.text), 'first', a.first, 'last', cast(p.page as bigint))
        ELSE named_struct('done', array_append(a.done, named_struct('content', trim(a.cur), 'first', a.first, 'last', a.last)),
          'cur', concat(CASE WHEN length(a.cur) > {3 * overlap} THEN right(a.cur, {3 * overlap}) ELSE '' END, '\\n\\n', p.text), 'first', cast(p.page as bigint), 'last', cast(p.page as bigint)) END,
      a -> CASE WHEN trim(a.cur) = '' THEN a.done ELSE array_append(a.done, named_struct('content', trim(a.cur), 'first', a.first, 'last', a.last)) END)"""
    out = held.select("doc_id", F.posexplode(F.expr(step)).alias("chunk", "c"))
    return out.select("doc_id", "chunk", "c.content", F.col("c.first").alias("first_page"), F.col("c.last").alias("last_page"))


def scored(rows: DataFrame, text: str, score: Callable[[list[str]], list[str]], longest: int = 6000, name: str = "answer", missing: str = "N/A") -> DataFrame:
    """``rows`` with the scorer's answer to each text, cut to ``longest`` characters and handed over in batches; an answer that
    is None or empty is ``missing``. The scorer is the caller's own (a rule, a model): this only carries texts to it."""
    out = rows.withColumn(name, F.left(F.coalesce(F.col(text), F.lit("")), F.lit(longest)))
    schema = out.schema

    def ask(batches):
        for batch in batches:
            at = batch.schema.get_field_index(name)
            said = [a or missing for a in score(batch.column(at).to_pylist())] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(said, c.type) if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return out.mapInArrow(ask, schema)


def summary_tree(chunks: DataFrame, classify: Callable, condense: Callable) -> DataFrame:
    """doc_id, level, section, summary: chunks (doc_id, chunk, content) get a section each, a section's chunks in order are
    condensed, and a document's sections once more; both callables take and give lists of texts."""
    leaves = scored(chunks, "content", classify, name="section")
    join = lambda c, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, c))), lambda x: x[c]), "\n")
    sections = scored(leaves.groupBy("doc_id", "section").agg(join("content", "chunk").alias("text")), "text", condense, name="summary").select("doc_id", F.lit("section").alias("level"), "section", "summary")
    whole = scored(sections.groupBy("doc_id").agg(join("summary", "section").alias("text")), "text", condense, name="summary").select("doc_id", F.lit("document").alias("level"), F.lit("").alias("section"), "summary")
    return sections.unionByName(whole)


def officers(text: Column) -> tuple[Column, Column]:
    """An officer's clean name, and the career as an array of struct(date, what): blanks in the name, reading aids and birth
    dates go."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^\s*([^\n]+)", 1), r"[(（][^)）]*[)）]|\d{4}年.*$", ""), r"[\s　]+", "")
    # One match holds both, so that dates and what they say stay side by side.
    lines = F.regexp_extract_all(text, F.lit(r"(?m)(\d{4}年\d{1,2}月[ \t　]+[^\n]+)$"), 1)
    career = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\d{4}年\d{1,2}月)", 1).alias("date"), F.trim(F.regexp_replace(x, r"^\d{4}年\d{1,2}月[ \t　]+", "")).alias("what")))
    return name, career


def real_addresses(rows: DataFrame, column: str = "address") -> DataFrame:
    """The different addresses worth a look-up: with a Japanese place's ending, longer than three characters, no "and
    others"."""
    a = F.trim(column)
    return rows.select(a.alias("address")).where(F.col("address").rlike("[都道府県市区町村]") & (F.length("address") > 3) & ~F.col("address").rlike("^(その他|各地|国内|同上)")).distinct()
