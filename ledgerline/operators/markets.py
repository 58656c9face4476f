"""Market-specific shaping of statements: retries, guards, component sums, overrides, shifted layouts, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import exact, first_case, present
from ledgerline.operators.merge import core_count


def with_parent_only_retry(consolidated: DataFrame, parent_only: DataFrame, keys: list[str], core: list[str]) -> DataFrame:
    """Rows whose core fields are all null are taken from the parent-only reading, if that has any of them."""
    have = core_count(core)
    side = parent_only.where(have > 0).select(*keys, F.struct(*[c for c in parent_only.columns if c not in keys]).alias("_p"))
    out = consolidated.join(side, keys, "left")
    use = (have == 0) & F.col("_p").isNotNull()
    return out.select(*keys, *[F.when(use, F.col(f"_p.{c}")).otherwise(F.col(c)).alias(c) for c in consolidated.columns if c not in keys])


def foreign_ordinary_income(facts: DataFrame, key: str) -> DataFrame:
    """Documents whose ordinary income is an artifact: no consolidated figure of that name, and some numeric tag of a
    foreign standard (by its full name, or by its local name where that is missing)."""
    low = F.lower(F.coalesce("full_tag", F.lit("")))
    foreign = F.col("value").isNotNull() & (low.contains("jpigp") | low.contains("usgaap") | ((low == "") & F.col("tag").contains("IFRS")))
    own = (F.col("tag") == "OrdinaryIncome") & F.col("value").isNotNull() & ~F.col("context").contains("NonConsolidated")
    return facts.groupBy(key).agg(F.bool_or(foreign).alias("f"), F.bool_or(own).alias("o")).where("f AND NOT o").select(key)


def component_sum(facts: DataFrame, key: str, tags: list[str], name: str) -> DataFrame:
    """Sum of the listed tags at the current instant; null (no row) without any."""
    rows = facts.where(F.col("tag").isin(tags) & F.col("context").contains("Instant") & ~F.col("context").startswith("Prior") & F.col("value").isNotNull())
    return rows.groupBy(key).agg(F.sum(exact(F.col("value"))).cast("double").alias(name))


def larger_override(value: Column, trigger: Column, other: Column) -> Column:
    """The other figure where the trigger is present and the other is larger."""
    return F.when(trigger.isNotNull() & (other > value), other).otherwise(value)


def gregorian(year: Column) -> Column:
    """Western year of a Minguo year; years that are western already stay."""
    return F.when(year < 1911, year + 1911).otherwise(year)


def from_thousands(df: DataFrame, columns: list[str], except_: tuple[str, ...] = ("eps", "bps")) -> DataFrame:
    return df.withColumns({c: F.col(c) * 1000 for c in columns if c not in except_})


def near(a: Column, b: Column, share: float = 0.002, least: float = 10.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(least), share * F.greatest(F.abs(a), F.abs(b)))


def layout(normal: tuple[Column, Column, Column], shifted: tuple[Column, Column, Column]) -> Column:
    """'shifted' or 'normal' by which reading satisfies first - second = third; null if neither does (shifted is tried
    first, so a row that satisfies both is shifted)."""
    holds = lambda t: F.coalesce(near(t[0] - t[1], t[2]), F.lit(False))
    return first_case([(holds(shifted), "shifted"), (holds(normal), "normal")])


def drop_unread(rows: DataFrame, others: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a layout, and the other statement's rows without the keys of those that have none."""
    bad = rows.where(F.col("layout").isNull()).select(*keys).distinct()
    return rows.where(F.col("layout").isNotNull()), others.join(bad, keys, "left_anti")


def segment_values(df: DataFrame) -> DataFrame:
    """external, internal, total of segments: the total is synthesised from its parts where it is missing or 0."""
    total = F.coalesce(present(F.col("revenue_total")), F.coalesce(F.col("revenue_external"), F.lit(0.0)) + F.coalesce(F.col("revenue_internal"), F.lit(0.0)))
    return df.withColumn("revenue_total", present(total))


def member_role(member: Column) -> Column:
    """Role of a segment axis member."""
    m = F.lower(member)
    return first_case([(m.contains("reconcil") | m.contains("adjust"), "reconciling"), (m.contains("reportablesegments") | m.contains("totalof"), "total"), (m.contains("other"), "other")], "segment")


def whole_company(segments: DataFrame, store: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Companies without segments come in with one row of their own figures."""
    alone = store.join(segments.select(*keys).distinct(), keys, "left_anti").withColumn(label, F.lit("whole company"))
    return segments.unionByName(alone.select(*segments.columns))


#: The 47 prefectures.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 "
    "滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()
#: The cities designated by ordinance, by prefecture.
DESIGNATED = {
    "北海道": ["札幌市"], "宮城県": ["仙台市"], "埼玉県": ["さいたま市"], "千葉県": ["千葉市"], "神奈川県": ["横浜市", "川崎市", "相模原市"], "新潟県": ["新潟市"], "静岡県": ["静岡市", "浜松市"],
    "愛知県": ["名古屋市"], "京都府": ["京都市"], "大阪府": ["大阪市", "堺市"], "兵庫県": ["神戸市"], "岡山県": ["岡山市"], "広島県": ["広島市"], "福岡県": ["北九州市", "福岡市"], "熊本県": ["熊本市"],
}


def address_parts(text: Column) -> tuple[Column, Column]:
    """Prefecture and city of a Japanese address; null where none stands at its beginning. Blanks and what says "and
    others" go; a designated city that comes first brings its prefecture. The city is the shortest beginning that ends a
    city's ward, a ward, a city, a county's town, a town, a county's village or a village, in this order."""
    t = F.regexp_replace(F.regexp_replace(text, r"[\u3000\s]", ""), r"(ほか|外|他).*$|等$", "")
    home = F.coalesce(*[F.when(F.regexp_extract(t, f"^({'|'.join(cities)})", 1) != "", p) for p, cities in DESIGNATED.items()])
    named = F.nullif(F.regexp_extract(t, f"^({'|'.join(PREFECTURES)})", 1), F.lit(""))
    # 千葉市 and the like begin with no prefecture's whole name, so a name that is there stands.
    prefecture = F.coalesce(named, home)
    rest = F.when(named.isNotNull(), F.substr(t, F.length(named) + 1)).otherwise(t)
    ends = ["市.+?区", "区", "市", "郡.+?町", "町", "郡.+?村", "村"]
    city = F.coalesce(*[F.nullif(F.regexp_extract(rest, f"^(.+?{e})", 1), F.lit("")) for e in ends])
    return prefecture, F.when(prefecture.isNotNull(), city)


def foreign_address(text: Column, markers: list[str]) -> Column:
    """A foreign marker vetoes; else an address without a Japanese suffix is foreign."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | text.contains(m)
    return hit | ~text.rlike("[都道府県市区町村]")


def merged_digits(values: Column, limit: float = 1e15) -> Column:
    """Whether an array of figures holds one too large to be true."""
    return F.exists(values, lambda x: F.coalesce(x > limit, F.lit(False)))


def renamed(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each field from the first of its aliases that the table has and the row fills; the aliases go."""
    gone = {a for names in aliases.values() for a in names}
    picks = [F.coalesce(*[F.col(a) for a in names if a in df.columns], F.lit(None)).alias(f) for f, names in aliases.items()]
    return df.select(*[c for c in df.columns if c not in gone and c not in aliases], *picks)


def instant_or_duration(df: DataFrame, instant: list[str], duration: list[str]) -> DataFrame:
    """Figures read at both kinds of context (``x_instant``, ``x_duration``): the field's own kind first, a zero giving way
    to the other kind."""
    both = {f: (f"{f}_instant", f"{f}_duration") for f in instant} | {f: (f"{f}_duration", f"{f}_instant") for f in duration}
    return df.withColumns({f: F.coalesce(present(F.col(a)), F.col(b)) for f, (a, b) in both.items()}).drop(*[c for pair in both.values() for c in pair])


def merge_sheets(sheets: list[tuple[str, DataFrame]], keys: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """One row a key from several sheets: a field comes from the last sheet that fills it, and once more under the sheet's
    name; fields that end in one of ``without`` are left out."""
    out, fields = None, []
    for name, df in sheets:
        own = [c for c in df.columns if c not in keys and not c.endswith(without or ("\0",))]
        fields += [c for c in own if c not in fields]
        side = df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in own])
        out = side if out is None else out.join(side, keys, "full_outer")
    last = lambda c: F.coalesce(*[F.col(f"{n}_{c}") for n, _ in reversed(sheets) if f"{n}_{c}" in out.columns])
    return out.withColumns({c: last(c) for c in fields})
