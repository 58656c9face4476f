"""Scalar operators on fixed inputs: part keys deal the inputs over the whole table, and the SQL holds the values that must
come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import classify, excerpts, facilities, markets, merge, select
from ledgerline.plans.star import ORACLE, QUERIES, table


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def cased(name: str, kind: str, make, pairs: list[tuple]) -> None:
    """Register a query (p_partkey, value): ``make`` of the input that a part's key picks; ``kind`` is the value's SQL type."""

    def run(spark, d):
        given = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(pairs)], f"k bigint, x {_TYPES.get(type(next(x for x, _ in pairs if x is not None)), 'string')}")
        made = given.select("k", make(F.col("x")).alias("value"))
        return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(pairs)).alias("k")).join(made, "k").select("p_partkey", "value")

    run.__name__, run.__doc__ = name, f"{name}: {len(pairs)} inputs over all parts."
    QUERIES[name] = run
    ORACLE[name] = f"SELECT p_partkey, CAST([{', '.join(_sql(v) for _, v in pairs)}][p_partkey % {len(pairs)} + 1] AS {kind}) AS value FROM part"


_TYPES = {int: "bigint", float: "double"}
text = lambda *cols: F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])

cased("number_parse", "DOUBLE", S.parse_number, [("1,234", 1234.0), ("△56", -56.0), ("▲7.5", -7.5), ("－", None), ("-", None), ("N/A", None), ("12%", 12.0), ("8※1", 8.0), ("x", None), ("", None), (None, None), (" 3 ", 3.0)])
cased("money_amounts", "DOUBLE", S.parse_money, [("1兆2,000億円", 1.2e12), ("3百万円", 3e6), ("5億円", 5e8), ("2.5B", 2.5e9), ("750M", 7.5e8), ("1,000", 1000.0), ("なし", None)])
cased("money_format", "VARCHAR", S.format_money, [(1.5e12, "1.50T"), (-2.34e9, "-2.34B"), (7.5e6, "7.50M"), (999.5, "999.50"), (0.0, "0.00")])
cased("quarter_by_days", "INTEGER", S.quarter_of_days, [(80, 1), (100, 1), (101, None), (182, 2), (275, 3), (365, None), (None, None)])
cased("quarter_slot", "VARCHAR", lambda m: S.quarter_key(F.lit(2023), m, 3), [(4, "2024_Q1"), (7, "2024_Q2"), (12, "2024_Q3"), (2, None), (6, "2024_Q1")])
cased("document_ids", "VARCHAR", S.document_id, [("1301_x_S100ABCD_2.zip", "S100ABCD"), ("S1009999", "S1009999"), ("S200ABCD", None), ("S10XABCD", None), (None, None)])
cased("tickers", "VARCHAR", S.ticker, [("13010", "1301"), ("130A0", "130A"), (" 7203 ", "7203"), ("", None), (None, None)])
cased("flash_names", "VARCHAR", lambda x: F.when(S.report_name(x).isNotNull(), text(*[S.report_name(x)[k] for k in ("ticker", "period_end", "form", "submission", "announced")])), [
    ("tse-acedjpfr-76020-2026-03-31-01-2026-05-13-ixbrl.htm", "7602|2026-03-31|annual|1|2026-05-13"), ("tse-acediffr-45020-2026-03-31-02-2026-06-05", "4502|2026-03-31|annual|2|2026-06-05"), ("tse-qnedjpfr-130A0-2026-03-31-01-2026-05-11-x", "130A|2026-03-31|quarterly|1|2026-05-11"),
    ("tse-acedjpsm-59380-20260518359380-ixbrl.htm", "5938|-|annual|-|2026-05-18"), ("tse-scedjpsy-13830-20260615313830-ixbrl.htm", "1383|-|semi|-|2026-06-15"), ("other.htm", None),
])
cased("archive_names", "VARCHAR", lambda x: text(*[filings_part(x)[k] for k in ("year", "doc_type", "code", "document")]), [
    ("file:/base/2024/annual/7203_Toyota_20240625_S100TOYO.zip", "2024|annual|7203|S100TOYO"), ("/base/2023/quarterly/130A0_x_S1001234.zip", "2023|quarterly|130A0|S1001234"), ("/base/2022/interim/noname.zip", "2022|interim|-|-"),
])
cased("segment_names", "VARCHAR", select.normalized_segment, [("ＥＶ 事業", "ev"), ("半導体・製造装置部門", "半導体製造装置"), ("ﾘﾝｸﾞ", "リング"), (" Silver-Ring & Co, セグメント ", "silverringco"), ("事業", ""), (None, None)])
cased("company_names", "VARCHAR", lambda x: __import__("ledgerline.operators.filters", fromlist=["x"]).normalized_name(x), [("株式会社アルファ", "アルファ"), ("Alpha Steel Inc", "alphasteel"), ("ベータ（株）", "ベータ"), ("Beta Co., Ltd", "beta")])
cased("file_names", "VARCHAR", S.file_name, [('a/b:c*?"<>|d', "a_b_c_d"), ("x" * 60, "x" * 50), ("plain", "plain"), ("two  blanks", "two_blanks")])
cased("addresses", "VARCHAR", lambda x: text(*markets.address_parts(x)), [
    ("愛知県豊田市", "愛知県|豊田市"), ("東京都港区芝1", "東京都|港区"), ("東京都 多摩市ほか", "東京都|多摩市"), ("神奈川県横浜市西区みなと", "神奈川県|横浜市西区"), ("京都市南区", "京都府|京都市南区"), ("名古屋市中村区", "愛知県|名古屋市中村区"), ("北海道札幌市", "北海道|札幌市"),
    ("埼玉県入間郡三芳町上富", "埼玉県|入間郡三芳町"), ("千葉県千葉市美浜区等", "千葉県|千葉市美浜区"), ("Texas, USA", "-|-"), ("本社 東京都", "-|-"), ("沖縄県国頭郡恩納村", "沖縄県|国頭郡恩納村"), (None, "-|-"),
])
cased("foreign_sites", "BOOLEAN", lambda x: markets.foreign_address(x, ["USA", "中国", "タイ"]), [("東京都港区", False), ("Texas, USA", True), ("中国江蘇省蘇州市", True), ("Paris", True), ("大阪市北区", False)])
cased("offices", "VARCHAR", lambda x: text(*excerpts.office_and_address(x)), [("本社 (東京都港区)", "本社|東京都港区"), ("大阪工場（大阪府堺市）", "大阪工場|大阪府堺市"), ("研究所", "研究所|-")])
cased("land_use", "VARCHAR", excerpts.use_category, [("準工業地域", "industrial"), ("近隣商業地域", "commercial"), ("第一種住居地域", "residential"), ("原野", "other"), ("店舗、住宅", "commercial")])
cased("unit_factors", "DOUBLE", S.unit_factor, [("（単位：百万円）", 1e6), ("（単位：千円）", 1e3), ("億円", 1e8), ("円", 1.0)])
cased("event_scores", "DOUBLE", lambda x: S.event_score(x, {"買収": 1.0, "提携": 0.5, "訂正": -2.0}), [("買収を発表", 1.0), ("買収と提携と", 1.5), ("訂正のみ", 0.0), ("何もない", 0.0), ("提携を訂正", 0.0)])
cased("json_in_text", "VARCHAR", S.first_json, [('<think>{no}</think> so {"a": 1} done', '{"a": 1}'), ("none", None), ('{"a": {"b": 2}} tail }', '{"a": {"b": 2}} tail }')])
cased("label_words", "VARCHAR", S.camel_words, [("NetSalesOfFYOne", "Net Sales Of FY One"), ("CashAndDeposits", "Cash And Deposits"), ("EPS", "EPS")])
cased("token_estimates", "BIGINT", S.token_estimate, [("abcd", 2), ("abc", 1), ("", 0), ("半導体装置", 2)])
cased("context_ranks", "INTEGER", lambda x: select.context_rank(x, ["CurrentYear", "Interim"]), [("CurrentYearDuration", 0), ("Prior1YearDuration", None), ("CurrentYearDuration_NonConsolidatedMember", None), ("CurrentYearDuration_XMember", None), ("InterimInstant", 1), ("FilingDateInstant", 2)])
cased("member_roles", "VARCHAR", markets.member_role, [("ReconcilingItemsMember", "reconciling"), ("ReportableSegmentsMember", "total"), ("TotalOfReportableSegmentsAndOthersMember", "total"), ("OtherMember", "other"), ("SteelMember", "segment")])
cased("western_years", "BIGINT", markets.gregorian, [(113, 2024), (2024, 2024), (98, 2009)])
cased("larger_figures", "DOUBLE", lambda x: markets.larger_override(F.lit(100.0), x, F.lit(150.0)), [(1.0, 150.0), (None, 100.0)])
cased("rental_property", "VARCHAR", lambda x: text(excerpts.rental_values(x)["book"], excerpts.rental_values(x)["fair"]), [("賃貸等不動産の貸借対照表計上額は1,200百万円、時価は3,400百万円", "1200.0|3400.0"), ("期末残高 500 期末時価 700", "500.0|700.0"), ("計上額 10百万円 時価は 20", "10.0|20.0"), ("なし", "-|-")])
cased("broken_numbers", "DOUBLE", excerpts.rejoined_number, [("12,\n345", 12345.0), ("1,234\n567\n890", 1234567890.0), ("△5\nnote", -5.0), ("－", None)])
cased("log_audit", "VARCHAR", lambda x: F.array_join(excerpts.log_issues(x.contains("ghost"), x, F.split(x, "/"), F.length(x) / F.lit(10.0)), ","), [("other", "only_other,deviation"), ("ab/c", "deviation"), ("ab", ""), ("ghost/x", "ghost_name,deviation"), ("＠＠＠", "garbage")])
cased("extract_grades", "VARCHAR", lambda x: excerpts.quality_grade(F.filter(F.split(x, ","), lambda i: i != ""), ["no_segment"]), [("", "OK"), ("minor", "WARN"), ("minor,no_segment", "FAIL")])
cased("strided_sums", "DOUBLE", lambda x: excerpts.strided_sum(F.split(x, ";"), 1, 2), [("a;1,0;b;2;c;－", 12.0), ("a", None), ("a;x;b;5", 5.0)])
cased("merged_numbers", "BOOLEAN", lambda x: markets.merged_digits(F.transform(F.split(x, ";"), lambda v: v.try_cast("double"))), [("1;2", False), ("1;2e15", True), ("x;;", False)])
cased("store_actions", "VARCHAR", lambda x: merge.action(F.nullif(F.split(x, ";")[0], F.lit("")), F.split(x, ";")[1], F.split(x, ";")[2] == "flash", F.split(x, ";")[3].cast("int")), [
    (";S2;;0", "reprocess"), ("S1;S2;;4", "reprocess"), ("S2;S2;;4", "same"), ("S3;S2;;4", "older"), ("S3;S2;flash;4", "reprocess"), ("S3;S2;;0", "reprocess")])
cased("date_texts", "DATE", S.any_date, [("2024-05-01", "2024-05-01"), ("2024/05/01", "2024-05-01"), ("20240501", "2024-05-01"), ("May", None), (None, None)])
cased("industries", "VARCHAR", lambda x: classify.keyword_class(x, [("bank", ["銀行", "bank"]), ("retail", ["ストア", "store"]), ("maker", ["製作所", "工業"])]), [("みずほ銀行", "bank"), ("App Store KK", "retail"), ("日立製作所", "maker"), ("その他", "other")])


#: Facilities (address;office;area;book;price) and why they are not believed.
FACILITIES = [
    ("東京都ほか;工場;10;1;", "address_ambiguous"), ("港区;支店（注）;10;1;", "annotation_marked"), ("港区;鉱山;10000000;1;", "area_too_large"), ("港区;倉庫;101;;", "leased_land"), ("港区;倉庫;100001;5000000;3000001", "urban_area_implausible"),
    ("豊田市;本社;500001;9000;100", "head_office_aggregate"), ("港区;本店;30001;900000;500001", "head_office_aggregate_urban"), ("港区;山林;10000;4.9;", "book_too_low"), ("港区;店;60;6001;", "book_too_high"), ("港区;店;1000;1000;99999", "book_against_price"),
    ("港区;店;49;101;", "area_too_small"), ("港区;店;1000;1000;100000", None), ("港区;店;100;0;", None)
]


def outlier_rules(spark, d):
    """Facilities over all parts, and the first reason not to believe them."""
    names = ["address", "office", "area", "book", "price"]
    given = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(FACILITIES)], "k bigint, x string")
    cells = [F.split("x", ";")[i].alias(n) if n in names[:2] else F.split("x", ";")[i].try_cast("double").alias(n) for i, n in enumerate(names)]
    judged = facilities.with_outliers(given.select("k", *cells)).select("k", F.col("reason").alias("value"))
    return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(FACILITIES)).alias("k")).join(judged, "k").select("p_partkey", "value")


QUERIES["outlier_rules"] = outlier_rules
ORACLE["outlier_rules"] = f"SELECT p_partkey, [{', '.join(_sql(v) for _, v in FACILITIES)}][p_partkey % {len(FACILITIES)} + 1] AS value FROM part"
cased("bounded_values", "DOUBLE", lambda x: facilities.bounded_value(*[F.split(x, ";")[k].try_cast("double") for k in range(4)], F.split(x, ";")[4] == "1"), [
    ("500;100;3;;0", 300.0), ("500;100;;2;0", 200.0), ("500;100;;;0", 500.0), ("50;100;;;1", 120.0), ("50;100;;;0", 50.0), ("500;;3;2;1", 500.0), ("200;100;3;;1", 200.0)])


def filings_part(path):
    from ledgerline.sources.filings import path_parts

    return path_parts(path)
