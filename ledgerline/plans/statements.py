"""Queries of statement figures and checks. The statements are the nations' years, spread over the fields by fixed shares;
both engines build them from the same short expressions, and the figures are worked out by each for itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import statements
from ledgerline.plans.star import NATION_YEARS, nation_years, query

#: Field of the fixture -> expression that both engines read alike.
FIELDS = {
    "net_income": "revenue * 5e-2", "total_equity": "revenue * 4e-1", "total_assets": "revenue * 1e0 + (year % 3) * 1e5", "total_liabilities": "revenue * 6e-1", "gross_profit": "revenue - cost * 5e-1 + (year % 2) * 5e3",
    "cost_of_sales": "cost * 5e-1", "selling_general_admin": "CASE WHEN year % 4 = 0 THEN NULL ELSE revenue * 1e-1 END", "operating_income": "CASE WHEN year % 3 = 0 THEN NULL ELSE revenue * 15e-2 END",
    "ordinary_income": "revenue * 16e-2", "current_assets": "revenue * 3e-1", "non_current_assets": "revenue * 7e-1", "current_liabilities": "CASE WHEN year % 5 = 0 THEN 0e0 ELSE revenue * 2e-1 END", "non_current_liabilities": "revenue * 4e-1",
    "short_term_loans": "revenue * 1e-2", "long_term_loans": "CASE WHEN year % 2 = 0 THEN NULL ELSE revenue * 5e-2 END", "cash_and_deposits": "quantity * 1e2", "cash_end": "quantity * 11e1", "merchandise": "quantity * 5e0", "raw_materials": "quantity * 1e0",
    "accounts_receivable": "revenue * 8e-2", "accounts_payable": "cost * 4e-2", "operating_cf": "revenue * 9e-2", "investing_cf": "revenue * -3e-2", "financing_cf": "revenue * -1e-2", "purchase_ppe": "revenue * -2e-2", "depreciation": "cost * 1e-2",
    "dividends_paid": "revenue * -1e-2", "shares_issued": "quantity * 1e1", "eps": "1e1", "interest_expenses": "CASE WHEN year % 4 = 1 THEN NULL ELSE cost * 2e-3 END", "interest_paid": "cost * -15e-4", "income_before_tax": "revenue * 8e-2", "income_taxes": "revenue * 25e-3",
    "non_operating_income": "revenue * 1e-2", "free_cash_flow": "revenue * 6e-2", "long_term_debt": "revenue * 1e-1", "sga_expense": "revenue * 1e-1", "research_development": "CASE WHEN year % 2 = 1 THEN cost * 1e-2 END", "capex": "revenue * 2e-2",
    "interest_income_bank": "revenue * 3e-1", "interest_expense_bank": "CASE WHEN year % 3 = 1 THEN 0e0 ELSE revenue * 5e-2 END", "loans_bank": "revenue * 2e0", "fee_income_bank": "quantity * 2e1", "fee_expense_bank": "quantity * 3e0", "general_admin_bank": "revenue * 1e-1", "deposits_bank": "revenue * 3e0", "shareholders_equity": "revenue * 38e-2",
}
STATEMENTS = f"{NATION_YEARS},\nst AS (SELECT nation, year, revenue, {', '.join(f'{e} AS {n}' for n, e in FIELDS.items())} FROM ny)"


def filed(spark, d):
    """nation, year, revenue and the fields."""
    return nation_years(spark, d).select("nation", "year", "revenue", *[F.expr(e).cast("double").alias(n) for n, e in FIELDS.items()])


def shown(df, *names):
    return df.select("nation", "year", *[F.round(n, 6).alias(n) for n in names])


def rounded(**columns):
    return ", ".join(f"round({e}, 6) AS {n}" for n, e in columns.items())


@query(f"""WITH {STATEMENTS},
b AS (SELECT *, coalesce(operating_income, gross_profit - selling_general_admin) AS oi, merchandise + raw_materials AS inv, short_term_loans + coalesce(long_term_loans, 0) AS debt0, abs(dividends_paid) / shares_issued AS dps FROM st)
SELECT nation, year, {rounded(operating_margin="oi / revenue * 100", roe="net_income / total_equity * 100", ordinary_margin="ordinary_income / revenue * 100", current_ratio="current_assets / CASE WHEN current_liabilities <> 0 THEN current_liabilities END * 100",
  debt="debt0", net_de_ratio="(debt0 - cash_and_deposits) / total_equity * 100", inventory_days="inv / revenue * 365", cash_cycle="accounts_receivable / revenue * 365 + inv / revenue * 365 - accounts_payable / cost_of_sales * 365", free_cash_flow="operating_cf + investing_cf",
  payout_ratio="dps / eps * 100", interest_coverage="oi / coalesce(interest_expenses, CASE WHEN interest_expense_bank <> 0 THEN interest_expense_bank END)", ebitda="oi + depreciation", net_debt_ebitda="(debt0 - cash_and_deposits) / CASE WHEN oi + depreciation > 0 THEN oi + depreciation END", short_debt_ratio="short_term_loans / debt0 * 100",
  capex_depreciation="abs(purchase_ppe) / depreciation * 100")} FROM b""")
def derived_jp(spark, d):
    """Domestic figures, with income, inventories, receivables and dividends filled in."""
    out = statements.derive(filed(spark, d).drop("free_cash_flow"), "jp")
    return shown(out, "operating_margin", "roe", "ordinary_margin", "current_ratio", "debt", "net_de_ratio", "inventory_days", "cash_cycle", "free_cash_flow", "payout_ratio", "interest_coverage", "ebitda", "net_debt_ebitda", "short_debt_ratio", "capex_depreciation")


@query(f"""WITH {STATEMENTS},
b AS (SELECT *, coalesce(operating_income, gross_profit - sga_expense - coalesce(research_development, 0)) AS oi FROM st)
SELECT b.nation, b.year, {rounded(operating_margin="oi / b.revenue * 100", roic="oi * 0.79 / (b.total_assets - b.current_liabilities + b.long_term_debt) * 100", free_cash_flow="b.operating_cf - b.capex", ebitda_margin="(oi + b.depreciation) / b.revenue * 100", current_ratio="b.current_assets / CASE WHEN b.current_liabilities <> 0 THEN b.current_liabilities END",
  payables_days="b.accounts_payable / b.cost_of_sales * 365", capex_intensity="b.capex / b.revenue * 100", revenue_yoy="(b.revenue - p.revenue) / p.revenue * 100", noncash_interest_ratio="(b.interest_expense - abs(b.interest_paid)) / b.interest_expense * 100", pik_interest="CASE WHEN b.interest_expense > abs(b.interest_paid) THEN b.interest_expense - abs(b.interest_paid) END", eps_calculated="b.net_income / b.shares_issued")}
FROM (SELECT *, interest_expenses AS interest_expense FROM b) b LEFT JOIN ny p ON p.nation = b.nation AND p.year = b.year - 1""")
def derived_us(spark, d):
    """Foreign figures with the year before's beside them."""
    x = filed(spark, d)
    before = x.select("nation", (F.col("year") + 1).alias("year"), F.col("revenue").alias("prev_revenue"))
    x = x.withColumnsRenamed({"interest_expenses": "interest_expense", "depreciation": "depreciation_amortization", "shares_issued": "shares_outstanding"}).drop("free_cash_flow")
    out = statements.derive(x.join(before, ["nation", "year"], "left"), "us")
    return shown(out, "operating_margin", "roic", "free_cash_flow", "ebitda_margin", "current_ratio", "payables_days", "capex_intensity", "revenue_yoy", "noncash_interest_ratio", "pik_interest", "eps_calculated")


@query(f"""WITH {STATEMENTS}
SELECT nation, year, {rounded(gross_margin="gross_profit / revenue * 100", operating_margin="operating_income / revenue * 100", net_margin="net_income / revenue * 100", roe="net_income / total_equity * 100", roa="net_income / total_assets * 100", equity_ratio="total_equity / total_assets * 100", current_ratio="current_assets / CASE WHEN current_liabilities <> 0 THEN current_liabilities END", debt_equity="total_liabilities / total_equity")} FROM st""")
def derived_tw(spark, d):
    return shown(statements.derive(filed(spark, d), "tw"), "gross_margin", "operating_margin", "net_margin", "roe", "roa", "equity_ratio", "current_ratio", "debt_equity")


@query(f"""WITH {STATEMENTS},
b AS (SELECT *, CASE WHEN interest_expense_bank <> 0 THEN interest_income_bank - interest_expense_bank END AS nii, fee_income_bank - fee_expense_bank AS fee FROM st)
SELECT nation, year, {rounded(free_cash_flow="free_cash_flow", net_interest_income="nii", nim="nii / loans_bank * 100", net_fee_income="fee", gross_profit_bank="nii + fee", overhead_ratio="general_admin_bank / (nii + fee) * 100", loan_deposit_ratio="loans_bank / deposits_bank * 100", roic="operating_income * 0.7 / (total_equity + short_term_loans + coalesce(long_term_loans, 0)) * 100", payout_ratio="abs(dividends_paid) / net_income * 100")} FROM b""")
def derived_report(spark, d):
    """A report's figures, bank figures among them, filled in only where they are absent."""
    return shown(statements.derive(filed(spark, d), "report", keep=True), "free_cash_flow", "net_interest_income", "nim", "net_fee_income", "gross_profit_bank", "overhead_ratio", "loan_deposit_ratio", "roic", "payout_ratio")


@query(f"""WITH {STATEMENTS},
s AS (SELECT *, NULL::DOUBLE AS roe, NULL::DOUBLE AS debt_equity FROM st)
SELECT nation, year, round(net_income / total_equity * 100, 6) AS roe, CAST(NULL AS DOUBLE) AS inventory_turn FROM s""")
def recomputed(spark, d):
    """A repair makes ratios anew: a stored one that is stale goes, one whose base is missing becomes null."""
    x = filed(spark, d).withColumns({"roe": F.lit(999.0), "inventory_days": F.lit(999.0)}).drop("merchandise", "raw_materials")
    return statements.derive(x, "jp").select("nation", "year", F.round("roe", 6).alias("roe"), F.col("inventory_days").alias("inventory_turn"))


#: A class for each row, from the year.
CLASS = "CASE year % 5 WHEN 0 THEN 'general' WHEN 1 THEN 'ifrs' WHEN 2 THEN 'bank' WHEN 3 THEN 'investment_holding' ELSE 'retail' END"
CHECKED = f"""{STATEMENTS},
cl AS (SELECT *, {CLASS} AS class FROM st),
ch AS (
  SELECT nation, year, class, 'balance' AS check_name, total_assets AS e, total_liabilities + total_equity AS a, 3.0 AS tol FROM cl WHERE class <> 'bank'
  UNION ALL SELECT nation, year, class, 'balance', total_liabilities + total_equity, total_assets, 0 FROM cl WHERE class = 'bank'
  UNION ALL SELECT nation, year, class, 'assets', total_assets, current_assets + non_current_assets, 0.1 FROM cl WHERE class <> 'bank'
  UNION ALL SELECT nation, year, class, 'liabilities', total_liabilities, current_liabilities + non_current_liabilities, 0.5 FROM cl WHERE class <> 'bank'
  UNION ALL SELECT nation, year, class, 'gross_profit', revenue - cost_of_sales, gross_profit, CASE WHEN class = 'investment_holding' THEN 0 ELSE 1 END FROM cl WHERE class <> 'bank'
  UNION ALL SELECT nation, year, class, 'free_cash_flow', operating_cf + investing_cf, free_cash_flow, CASE WHEN class = 'bank' THEN 30 ELSE 0 END FROM cl
  UNION ALL SELECT nation, year, class, 'ordinary_income', operating_income + non_operating_income, ordinary_income, 15 FROM cl WHERE class = 'general' AND abs(operating_income - ordinary_income) >= 1000
  UNION ALL SELECT nation, year, class, 'ordinary_income', revenue - cost_of_sales, ordinary_income, 30 FROM cl WHERE class = 'bank'
  UNION ALL SELECT nation, year, class, 'net_income', income_before_tax - income_taxes, net_income, 20 FROM cl WHERE class = 'investment_holding'
  UNION ALL SELECT nation, year, class, 'cash', greatest(cash_end, cash_and_deposits), least(cash_end, cash_and_deposits), 30 FROM cl WHERE class = 'bank'),
ev AS (SELECT nation, year, class, check_name, e, a, CASE WHEN tol > 0 THEN abs(a - e) / abs(e) * 100 <= tol WHEN e = 0 THEN abs(a) < 1000 ELSE abs(a - e) / abs(e) * 100 < 0.01 OR abs(a - e) < 1e6 END AS passed FROM ch WHERE e IS NOT NULL AND a IS NOT NULL)"""
NAMED = ["balance", "assets", "liabilities", "gross_profit", "free_cash_flow", "ordinary_income"]


@query(f"WITH {CHECKED} SELECT nation, year, class, check_name, round(e, 4) AS expected, round(a, 4) AS actual, passed FROM ev")
def class_checks(spark, d):
    """Each class's own checks, those that decide; what is informational always passes."""
    out = statements.class_checks(filed(spark, d), ["nation", "year"], F.expr(CLASS))
    decides = F.col("check_name").isin(NAMED) | ((F.col("check_name") == "net_income") & (F.col("class") == "investment_holding")) | ((F.col("check_name") == "cash") & (F.col("class") == "bank"))
    return out.where(decides).select("nation", "year", "class", "check_name", F.round("expected", 4).alias("expected"), F.round("actual", 4).alias("actual"), "passed")


@query(f"WITH {CHECKED} SELECT class, check_name, count(*) AS n, count(*) FILTER (WHERE NOT passed) AS failed FROM ev GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT passed) > 0")
def failed_checks(spark, d):
    """Failed checks by class and kind."""
    out = class_checks(spark, d).groupBy("class", "check_name").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))
    return out.where("failed > 0")


@query(f"""WITH {STATEMENTS},
x AS (SELECT nation, year, revenue, cost_of_sales AS cogs, CASE WHEN year % 2 = 0 THEN revenue - cost_of_sales ELSE gross_profit * 0.5 END AS gp, revenue - cost_of_sales AS want FROM st)
SELECT nation, year, CASE WHEN abs(revenue - cogs - gp) >= 1000 THEN 'gross_profit' ELSE '' END AS fixes, round(CASE WHEN abs(revenue - cogs - gp) >= 1000 THEN want ELSE gp END, 4) AS gross_profit FROM x""")
def repaired_statements(spark, d):
    """Gross profits that were read wrongly, replaced by the fact that closes the equation."""
    x = filed(spark, d).select("nation", "year", "revenue", "cost_of_sales", F.expr("CASE WHEN year % 2 = 0 THEN revenue - cost_of_sales ELSE gross_profit * 5e-1 END").alias("gross_profit"), F.expr("array(named_struct('tag', 'OtherIncome', 'value', revenue - cost_of_sales), named_struct('tag', 'GrossProfit', 'value', revenue - cost_of_sales))").alias("facts"))
    out = statements.repaired(x)
    return out.select("nation", "year", F.array_join("fixes", ",").alias("fixes"), F.round("gross_profit", 4).alias("gross_profit"))


@query(f"""WITH {STATEMENTS}
SELECT nation, year, CASE WHEN year % 2 = 1 THEN 1 ELSE 0 END::BIGINT AS before, 0::BIGINT AS after, CASE WHEN year % 2 = 1 THEN 'total_equity' ELSE '' END AS fixes FROM st""")
def fix_and_recheck(spark, d):
    """Odd years lost a fifth of their equity: found by the balance check, mended from the facts, checked again."""
    x = filed(spark, d).select("nation", "year", F.expr("total_liabilities + total_equity").alias("total_assets"), "total_liabilities", F.expr("CASE WHEN year % 2 = 1 THEN total_equity * 8e-1 ELSE total_equity END").alias("total_equity"), F.expr("array(named_struct('tag', 'NetAssets', 'value', total_equity))").alias("facts"))
    out = statements.fix_and_recheck(x, ["nation", "year"], F.lit("general"))
    return out.select("nation", "year", "before", "after", F.array_join("fixes", ",").alias("fixes"))


@query(f"""WITH {STATEMENTS}
SELECT nation, year, round(CASE WHEN abs(gross_profit - (revenue - cost_of_sales)) > 0.05 * abs(revenue - cost_of_sales) THEN revenue - cost_of_sales ELSE gross_profit END, 4) AS gross_profit FROM (SELECT * REPLACE (gross_profit * CASE WHEN year % 3 = 0 THEN 0.5 ELSE 1 END AS gross_profit) FROM st)""")
def alternative_tags(spark, d):
    """A figure more than 5 per cent off gives way to the first alternative that lies nearer."""
    x = filed(spark, d).withColumn("gross_profit", F.expr("gross_profit * CASE WHEN year % 3 = 0 THEN 5e-1 ELSE 1e0 END"))
    want = F.col("revenue") - F.col("cost_of_sales")
    return x.select("nation", "year", F.round(statements.better_alternative(F.col("gross_profit"), want, F.array(F.col("gross_profit") * 0.1, want, F.col("revenue"))), 4).alias("gross_profit"))
