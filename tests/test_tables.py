"""Tables of pages on small rows: spans, long tables."""

import duckdb
import pytest

from ledgerline import plans
from ledgerline.operators import tables
from tests.oracle import against_sql


def tall(n, span=None):
    """A page whose first cell stands beside ``n`` offices."""
    rows = "".join(f"<tr>{f'<td rowspan={span or n}>東部</td>' if k == 0 else ''}<td>第{k + 1000}工場</td><td>{k + 1000:,} ({k + 100:,})</td></tr>" for k in range(n))
    return f"<table><tr><th>セグメントの名称</th><th>事業所名 [千㎡]</th><th>土地 帳簿価額(千円)</th></tr>{rows}</table>"


@pytest.mark.parametrize("n", [1000, 1001, 70000])
def test_row_span_of_any_length(n):
    got = list(tables.laid_out(tall(n)))[3:]
    assert got == [x for k in range(n) for x in ((0, k + 1, 0, "東部", False, 1, 0), (0, k + 1, 1, f"第{k + 1000}工場", False, k + 1, 1), (0, k + 1, 2, f"{k + 1000:,} ({k + 100:,})", False, k + 1, 2))]


@pytest.mark.parametrize("span, rows", [("2", 2), (" 2 ", 2), ("02", 2), ("２", 2), ("0", 1), ("", 1), ("-2", 1), ("²", 1), ("x", 1), ("9" * 5000, 3)])
def test_odd_spans(span, rows):
    got = tables.laid_out(f'<table><tr><td rowspan="{span}">a</td></tr><tr><td>b</td></tr><tr><td>c</td></tr></table>')
    assert sum(x[3] == "a" for x in got) == rows


def test_facilities_of_a_long_table(spark):
    n = 1100
    pages = spark.createDataFrame([(1, tall(n))], "page_id long, html string")
    got = {r["office"]: (round(r["land"], 6), r["area"]) for r in tables.facility_rows(tables.spread_cells(pages)).collect()}
    assert got == {f"第{k + 1000}工場": (round((k + 1000) * 0.001, 6), (k + 100) * 1000.0) for k in range(n)}


def test_records_of_a_long_table(spark):
    n = 1100
    pages = spark.createDataFrame([(1, tall(n)), (2, "<p>none</p>"), (3, tall(3)), (4, None)], "page_id long, html string")
    want = [(p, k + 1, "東部", f"第{k + 1000}工場") for p, m in ((1, n), (3, 3)) for k in range(m)]
    for most in ({}, {"most": 7}):
        got = [(r["page_id"], r["row"], r["values"]["セグメントの名称"], r["values"]["事業所名 [千㎡]"]) for r in tables.records(tables.spread_cells(pages, **most)).collect()]
        assert sorted(got) == want


@pytest.mark.parametrize("name", ["facility_tables", "spread_tables"])
def test_nation_of_many_suppliers(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT n::INTEGER AS n_nationkey, 'NATION_' || n AS n_name, 0 AS n_regionkey FROM range(3) t(n)) TO '{tmp_path}/nation.parquet'")
    con.sql(f"COPY (SELECT s AS s_suppkey, 'Supplier#' || lpad(s::VARCHAR, 9, '0') AS s_name, (s % 2)::INTEGER AS s_nationkey, s % 3001 * 1.25::DOUBLE - 500 AS s_acctbal FROM range(2600) t(s)) TO '{tmp_path}/supplier.parquet'")
    against_sql(plans.QUERIES[name](spark, str(tmp_path)), plans.ORACLE[name], str(tmp_path))


def test_covered_by_two_spans():
    got = tables.laid_out("<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2 rowspan=9>c</td></tr><tr></tr><tr><td>d</td></tr></table>")
    assert [x[1:4] for x in got] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "b"), (2, 0, "c"), (2, 1, "c"), (3, 0, "c"), (3, 1, "c"), (3, 2, "d")]
