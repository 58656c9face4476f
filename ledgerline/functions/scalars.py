"""Scalar expressions of filings work. All are built-in column expressions: they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(x: Column) -> Column:
    """A double as a decimal of four places, so that sums do not depend on the order of rows."""
    return x.cast("decimal(18,4)")


def present(x: Column) -> Column:
    """Null where the value is zero: figures of zero count as missing."""
    return F.nullif(x, F.lit(0).cast("double"))


def ratio(a: Column, b: Column, times: float = 1.0) -> Column:
    """a / b * times, null where either is null or b is zero."""
    return a.cast("double") / present(b.cast("double")) * times


def gap(a: Column, b: Column) -> Column:
    """Difference over the larger magnitude, 0 if both are 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, F.lit(0.0)).otherwise(F.abs(a - b) / present(top))


def parse_number(text: Column) -> Column:
    """Figures as filings print them: thousands commas, minus triangles, per cent signs, note marks; dashes are null."""
    t = F.trim(F.regexp_replace(text, r"[,\s%]|※\d*", ""))
    t = F.regexp_replace(t, r"^[△▲−]", "-")
    return F.when(t.isin("", "-", "－", "―", "N/A"), None).otherwise(t.try_cast("double"))


#: Money units and their size.
MONEY_UNITS = {"兆": 1e12, "億": 1e8, "百万": 1e6, "T": 1e12, "B": 1e9, "M": 1e6}


def parse_money(text: Column) -> Column:
    """Sum of an amount's parts with their units (兆 億 百万, or T B M); null without a number."""
    parts = [F.coalesce(F.regexp_extract(text, rf"([\d,.]+)\s*{unit}", 1), F.lit("")) for unit in MONEY_UNITS]
    values = [F.coalesce(F.regexp_replace(p, ",", "").try_cast("double") * size, F.lit(0.0)) for p, size in zip(parts, MONEY_UNITS.values())]
    plain = parse_number(text)
    total = sum(values[1:], values[0])
    return F.when(total != 0, total).otherwise(plain)


def format_money(x: Column) -> Column:
    """Trillions, billions or millions with two places."""
    a = F.abs(x)
    return F.when(a >= 1e12, F.concat(F.format_number(x / 1e12, 2), F.lit("T"))).when(a >= 1e9, F.concat(F.format_number(x / 1e9, 2), F.lit("B"))).when(a >= 1e6, F.concat(F.format_number(x / 1e6, 2), F.lit("M"))).otherwise(F.format_number(x, 2))


def fiscal_quarter(month: Column, end_month: int) -> Column:
    """Quarter of a month in a fiscal year that ends with ``end_month``."""
    return (F.pmod(month - end_month - 1, F.lit(12)) / 3).cast("int") + 1


def fiscal_year(year: Column, month: Column, end_month: int) -> Column:
    return F.when(month > end_month, year + 1).otherwise(year)


def quarter_of_days(days: Column) -> Column:
    """Quarter that a reporting period of so many days closes; null outside the known lengths."""
    return F.when(days.between(80, 100), 1).when(days.between(170, 195), 2).when(days.between(260, 290), 3)


def document_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(S10[0-9][0-9A-Z]{4})", 1), F.lit(""))


def ticker(code: Column) -> Column:
    """Four characters; the check digit of a five-character code goes."""
    c = F.upper(F.trim(code))
    return F.when(F.length(c) == 5, F.left(c, F.lit(4))).otherwise(F.nullif(c, F.lit("")))


def file_name(text: Column, longest: int = 50) -> Column:
    return F.left(F.regexp_replace(text, r'[\\/:*?"<>|\s]+', "_"), F.lit(longest))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell(x: Column, size: float) -> Column:
    """Grid cell, truncated towards zero."""
    return (x / size).cast("int")


def dispersion_level(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x < 0.25, "low").when(x < 0.5, "medium").otherwise("high")


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block tags become line ends, entities characters."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(p|div|tr|li|h[1-6]|table|article|nav|ul|header|footer)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 2)


def camel_words(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2"))


def first_json(text: Column) -> Column:
    """From the first opening to the last closing brace, thoughts removed; null without."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))


def unit_factor(text: Column) -> Column:
    return F.when(text.contains("百万円"), 1e6).when(text.contains("千円"), 1e3).when(text.contains("億円"), 1e8).otherwise(1.0)


def event_score(text: Column, weights: dict[str, float], floor: float = 0.0, cap: float = 1.5) -> Column:
    """Sum of the weights of the keywords contained, clipped."""
    total = sum((F.when(text.contains(k), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.greatest(F.lit(floor), F.least(F.lit(cap), total))


def first_case(rules: list[tuple[Column, object]], otherwise=None) -> Column:
    """The first rule that holds decides."""
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


#: Letters of a report's form in file names and the period it covers.
FORMS = {"a": "annual", "s": "semi", "q": "quarterly"}


def report_name(name: Column) -> Column:
    """Struct ticker, period_end, form, submission, announced of a flash report's file name (the summary's name has neither
    period nor number); null if it is none."""
    full = r"tse-([asq])[cn]ed(?:jp|if|us)[a-z]{2}-([0-9A-Z]{4,5})-(\d{4}-\d{2}-\d{2})-(\d{2})-(\d{4}-\d{2}-\d{2})"
    short = r"tse-([asq])[cn]ed(?:jp|if|us)s[a-z]-([0-9A-Z]{4,5})-(\d{8})[0-9A-Z]+-ixbrl"
    part = lambda p, k: F.nullif(F.regexp_extract(name, p, k), F.lit(""))
    form = F.coalesce(part(full, 1), part(short, 1))
    period = F.coalesce(*[F.when(form == k, v) for k, v in FORMS.items()])
    said = F.coalesce(part(full, 5), F.date_format(F.try_to_date(part(short, 3), "yyyyMMdd"), "yyyy-MM-dd"))
    return F.when(form.isNotNull(), F.struct(F.left(F.coalesce(part(full, 2), part(short, 2)), F.lit(4)).alias("ticker"), part(full, 3).alias("period_end"), period.alias("form"), part(full, 4).try_cast("int").alias("submission"), said.alias("announced")))


def quarter_key(year: Column, month: Column, end_month: int) -> Column:
    """Key of a quarterly slot, ``{fy}_Q{n}``; null for the fourth quarter, which is the annual slot."""
    q = fiscal_quarter(month, end_month)
    return F.when(q <= 3, F.concat(fiscal_year(year, month, end_month).cast("string"), F.lit("_Q"), q.cast("string")))


def any_date(text: Column) -> Column:
    """A date written with hyphens, slashes or as eight digits; null for anything else."""
    t = F.trim(text)
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "yyyy/MM/dd"), F.try_to_date(t, "yyyyMMdd"))
