"""Tables of pages: cells with spans laid out, headers, what columns and cells are, and the rows that follow from them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import first_case, parse_number

CELLS = "page_id bigint, tab int, row int, col int, content string, header boolean, from_row int, from_col int"


def _span(attrs: list[tuple], name: str) -> int:
    """A span's number, 1 if there is none or it is 0; past 18 digits it is more than any table has."""
    found = re.match(r"\s*0*(\d+)\s*$", dict(attrs).get(name) or "1")
    return max(1, int(found[1][:18])) if found else 1


class _Grid(HTMLParser):
    """Rows of the outermost tables' cells: (content, is header, rowspan, colspan)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.depth, self.cell = [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            if not self.tables[-1]:
                self.tables[-1].append([])
            # A row span ends with the table, so its number needs no bound; a column span makes its columns, 1000 at most as in HTML.
            self.cell = ([], tag == "th", _span(attrs, "rowspan"), min(1000, _span(attrs, "colspan")))
        elif self.cell and tag in ("br", "p", "div"):
            self.cell[0].append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table") and self.depth == 1:
            self._close()
        if tag == "table":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.cell:
            self.cell[0].append(data)

    def _close(self):
        if self.cell:
            text, *rest = self.cell
            self.tables[-1][-1].append((" ".join("".join(text).split()), *rest))
            self.cell = None


def laid_out(html: str) -> Iterator[tuple]:
    """(table, row, col, content, header, from_row, from_col) of every place that a cell covers, spans spread out."""
    p = _Grid()
    p.feed(html or "")
    p.close()
    for t, rows in enumerate(p.tables):
        # By column the cells that cover it from this row on, (end, content, header, row, col): the first stands, one that
        # ends no later than those before it never will.
        covers: dict = {}
        for r, cells in enumerate(rows):
            covers = {x: left for x, held in covers.items() if (left := [v for v in held if v[0] > r])}
            c = 0
            for content, header, down, across in cells:
                while c in covers:
                    c += 1
                end = min(r + down, len(rows))
                for x in range(c, c + across):
                    held = covers.setdefault(x, [])
                    if not held or held[-1][0] < end:
                        held.append((end, content, header, r, c))
                c += across
            for x in sorted(covers):
                yield (t, r, x, *covers[x][0][1:])


def spread_cells(pages: DataFrame, most: int = 1 << 16) -> DataFrame:
    """One row for each place of the tables of pages (page_id, html): what stands there, and the cell it comes from.
    Workers hand on ``most`` rows at a time, however many a page has."""
    names = [f.split()[0] for f in CELLS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]

    def lay(batches):
        for batch in batches:
            rows = ((i, *x) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in laid_out(h))
            while part := list(islice(rows, most)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(lay, CELLS)


def records(cells: DataFrame) -> DataFrame:
    """page_id, tab, row, values: each data row of a table as a map from its header row (the first) to its cells; columns
    without a header and cells past the header are left out, of equal headers the first stands."""
    named = cells.where("row > 0").alias("d").join(cells.where("row = 0 AND content <> ''").alias("h"), ["page_id", "tab", "col"])
    first = named.groupBy("page_id", "tab", "d.row", F.col("h.content").alias("name")).agg(F.min_by("d.content", "col").alias("content"))
    return first.groupBy("page_id", "tab", "row").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "content")))).alias("values"))


#: Words by which a column's header tells what it holds, in the order in which they are tried.
ROLES = [("office", "事業所|会社名.*所在地"), ("segment", "セグメント|事業内容"), ("facility", "設備の?内容"), ("land", "土地(?!.*面積)"), ("building", "建物(?!.*機械)"), ("machinery", "機械"), ("total", "^合計"), ("employees", "従業"), ("address", "所在地")]
#: Words of a subheader, of what is no table of facilities, and of cells that are dates or notes.
SUBHEADER = "土地|建物|機械|合計|面積|帳簿|金額|工具|リース|ソフト|借地|使用権|車両|構築物|動産"
OTHER_TABLES = "投資予定|予定金額|資金調達|着手|完了予定|売却時期|営業キロ|線名|区間|電動客車"
NOT_NUMBERS = "年|月|日|％|現在|以下|以上|注記"


def column_role(header: Column) -> Column:
    return first_case([(header.rlike(p), name) for name, p in ROLES])


def numeric_cell(text: Column) -> Column:
    """Whether a cell holds a figure: three digits or more, or a number in brackets; dates, notes and numbers of sections
    (a bracket with digits alone, or with one digit before words) do not count."""
    t = F.trim(text)
    plain = F.regexp_replace(t, "[,，]", "")
    note = t.rlike(NOT_NUMBERS) | t.rlike(r"^[(（]\s*[\d１-９０]+\s*[)）]\s*$") | t.rlike(r"^[(（]\s*\d\s*[)）]\s*[^\d\s,.]")
    figure = t.rlike(r"^[(\[（]\s*[\d,.]+") | t.rlike(r"^-?[\d,]+(\.\d+)?\s*[(（]") | t.rlike(r"^[-－―−0]\s*[(（]\s*[\d,.]+") | plain.rlike(r"\d{3}")
    return F.coalesce(~note & figure, F.lit(False))


def subheader(cells: Column) -> Column:
    """Whether a row's cells (array) are headers once more: no figure of two digits, and two of the words, or one if there
    are three cells at most."""
    hits = F.size(F.filter(cells, lambda c: c.rlike(SUBHEADER)))
    return (F.size(cells) > 0) & ~F.exists(cells, lambda c: c.rlike(r"\d{2}")) & ((hits >= 2) | ((F.size(cells) <= 3) & (hits >= 1)))


def book_factor(header: Column) -> Column:
    """What brings a table's amounts to millions."""
    return F.when(header.contains("千円") & ~header.contains("百万"), 0.001).when(header.contains("億円"), 100.0).otherwise(1.0)


def area_factor(header: Column) -> Column:
    """What brings a table's areas to square metres."""
    return F.when(header.rlike("千(㎡|m|ｍ|平方)"), 1000.0).otherwise(1.0)


def facility_rows(cells: DataFrame, deep: int = 8) -> DataFrame:
    """page_id, tab, row, office, land (in millions), area (square metres) of tables of facilities: those whose first
    ``deep`` rows speak of land and of book values or yen and of nothing that belongs to plans or lines. A column's role is
    the first that one of its header cells has; rows without a figure are left out; an area stands in brackets."""
    head = cells.where(F.col("row") < deep).groupBy("page_id", "tab").agg(F.concat_ws(" ", F.collect_list("content")).alias("head"))
    head = head.where(F.contains("head", F.lit("土地")) & F.col("head").rlike("帳簿価額|百万|千円") & ~F.col("head").rlike(OTHER_TABLES))
    data = cells.groupBy("page_id", "tab", "row").agg(F.bool_or(numeric_cell(F.col("content"))).alias("data"))
    first = data.where("data").groupBy("page_id", "tab").agg(F.min("row").alias("first"))
    roles = cells.join(first, ["page_id", "tab"]).where("row < first").select("page_id", "tab", "col", "row", column_role(F.col("content")).alias("role")).where("role IS NOT NULL")
    roles = roles.groupBy("page_id", "tab", "col").agg(F.min_by("role", "row").alias("role"))
    roles = roles.groupBy("page_id", "tab", "role").agg(F.min("col").alias("col"))
    rows = cells.join(data.where("data"), ["page_id", "tab", "row"]).join(roles, ["page_id", "tab", "col"]).join(head, ["page_id", "tab"])
    text = lambda role: F.max(F.when(F.col("role") == role, F.col("content")))
    out = rows.groupBy("page_id", "tab", "row").agg(text("office").alias("office"), text("land").alias("l"), F.first("head").alias("head"))
    amount = parse_number(F.regexp_replace("l", r"[(（\[〔].*$", ""))
    area = parse_number(F.nullif(F.regexp_extract("l", r"[(（\[〔]\s*([\d,.]+)", 1), F.lit("")))
    return out.select("page_id", "tab", "row", "office", (amount * book_factor(F.col("head"))).alias("land"), (area * area_factor(F.col("head"))).alias("area"))


def parallel_segments(cells: DataFrame, least: int = 2) -> DataFrame:
    """page_id, tab, nth, name, value of tables that list segments side by side: one cell of names and one of figures in a
    row, divided by blanks or line ends, as many of each and ``least`` at least. Totals and eliminations are left out."""
    split = lambda c: F.filter(F.split(c, r"[\s　]+"), lambda x: x != "")
    w = Window.partitionBy("page_id", "tab", "row").orderBy("col")
    rows = cells.withColumn("after", F.lead("content").over(w)).withColumns({"names": split(F.col("content")), "figures": split(F.col("after"))})
    rows = rows.where((F.size("names") >= least) & (F.size("names") == F.size("figures")) & F.forall("figures", lambda x: x.rlike(r"^[△▲(-]?[\d,]+\)?$")) & ~F.exists("names", lambda x: x.rlike(r"^\d")))
    out = rows.select("page_id", "tab", F.posexplode(F.arrays_zip("names", "figures")).alias("nth", "z"))
    return out.select("page_id", "tab", "nth", F.col("z.names").alias("name"), parse_number(F.col("z.figures")).alias("value")).where(~F.col("name").rlike("計$|調整|消去"))


def headed_segments(cells: DataFrame, measures: dict[str, str]) -> DataFrame:
    """page_id, tab, segment, measure, value of tables whose header row names the segments (by column) and whose first
    column names the measures (patterns); columns of totals and eliminations are left out."""
    names = cells.where("row = 0 AND col > 0").select("page_id", "tab", "col", F.col("content").alias("segment")).where(~F.col("segment").rlike("計$|調整|消去|^$"))
    labels = cells.where("row > 0 AND col = 0").select("page_id", "tab", "row", first_case([(F.col("content").rlike(p), m) for m, p in measures.items()]).alias("measure")).where("measure IS NOT NULL")
    rows = cells.where("row > 0 AND col > 0").join(names, ["page_id", "tab", "col"]).join(labels, ["page_id", "tab", "row"])
    return rows.groupBy("page_id", "tab", "segment", "measure").agg(F.min_by(parse_number(F.col("content")), "row").alias("value"))


def stacked_segments(cells: DataFrame, measures: dict[str, str]) -> DataFrame:
    """The same of tables whose header row names the measures (patterns) and whose first column names the segments."""
    roles = cells.where("row = 0 AND col > 0").select("page_id", "tab", "col", first_case([(F.col("content").rlike(p), m) for m, p in measures.items()]).alias("measure")).where("measure IS NOT NULL")
    names = cells.where("row > 0 AND col = 0").select("page_id", "tab", "row", F.col("content").alias("segment")).where(~F.col("segment").rlike("計$|調整|消去|^$"))
    rows = cells.where("row > 0 AND col > 0").join(roles, ["page_id", "tab", "col"]).join(names, ["page_id", "tab", "row"])
    return rows.groupBy("page_id", "tab", "segment", "measure").agg(F.min_by(parse_number(F.col("content")), "col").alias("value"))
