"""Figures derived from statements, by market, and the checks of each company class.

Rules are data: a name and an expression over fields, worked through in order, so that later rules see earlier ones. A
field that the table lacks counts as null; ``nullif(x, 0)`` marks where a zero counts as missing. Nothing is rounded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import present
from ledgerline.operators.checks import check

_WORD = re.compile(r"\b[a-z][a-z0-9_]*\b(?!\s*\()")
_NOT_FIELDS = {"case", "when", "then", "else", "end", "and", "or", "not", "is", "null", "in"}


def share(a: str, b: str, times: int = 100) -> str:
    return f"{a} / nullif({b}, 0) * {times}"


def total(*fields: str) -> str:
    """Sum with gaps as 0; null where nothing is left of it."""
    return f"nullif({' + '.join(f'coalesce({f}, 0)' for f in fields)}, 0)"


#: Profit and balance ratios that all markets share.
_COMMON = [
    ("gross_margin", share("gross_profit", "revenue")), ("operating_margin", share("operating_income", "revenue")), ("net_margin", share("net_income", "revenue")),
    ("roe", share("net_income", "total_equity")), ("roa", share("net_income", "total_assets")), ("equity_ratio", share("total_equity", "total_assets")),
]
_CYCLE = [
    ("inventory_days", share("inventories", "revenue", 365)), ("receivables_days", share("receivables", "revenue", 365)), ("payables_days", share("payables", "cost_of_sales", 365)),
    ("cash_cycle", "receivables_days + inventory_days - payables_days"), ("asset_turnover", share("revenue", "total_assets", 1)),
]
_INTEREST = [
    ("cash_interest_share", "abs(interest_paid) / nullif(greatest(interest_expense, 0), 0)"), ("noncash_interest", "interest_expense - abs(interest_paid)"),
    ("noncash_interest_ratio", share("noncash_interest", "nullif(greatest(interest_expense, 0), 0)")), ("pik_interest", "coalesce(nullif(greatest(pik_direct, 0), 0), nullif(greatest(pik_tagged, 0), 0), nullif(greatest(noncash_interest, 0), 0))"),
    ("interest_coverage", "nullif(operating_income, 0) / nullif(greatest(interest_expense, 0), 0)"), ("cash_coverage", "nullif(operating_cf, 0) / nullif(abs(interest_paid), 0)"),
]
_DEBT = [
    ("net_debt", "debt - coalesce(cash_and_deposits, 0)"), ("net_debt_ebitda", "net_debt / nullif(greatest(ebitda, 0), 0)"), ("short_debt_ratio", share("nullif(coalesce(short_term_loans, 0) + coalesce(current_portion_long_term, 0), 0)", "debt")),
]

RULES = {
    "jp": [
        ("operating_income", "coalesce(operating_income, nullif(gross_profit, 0) - nullif(selling_general_admin, 0))"),
        ("inventories", "coalesce(nullif(inventories, 0), " + total("merchandise", "work_in_progress", "raw_materials", "supplies") + ")"),
        ("receivables", "coalesce(nullif(trade_receivables, 0), " + total("notes_receivable", "accounts_receivable") + ")"),
        ("payables", "coalesce(nullif(trade_payables, 0), " + total("notes_payable", "accounts_payable") + ")"),
        ("dividend_per_share", "coalesce(dividend_per_share, abs(nullif(dividends_paid, 0)) / nullif(shares_issued, 0))"),
        ("interest_expense", "coalesce(interest_expenses, interest_expense_bank)"),
        *_COMMON,
        ("ordinary_margin", share("ordinary_income", "revenue")), ("sga_ratio", share("selling_general_admin", "revenue")), ("cost_ratio", share("cost_of_sales", "revenue")),
        ("debt_equity", share("total_liabilities", "total_equity")), ("current_ratio", share("current_assets", "current_liabilities")),
        ("debt", total("short_term_loans", "long_term_loans", "bonds_payable", "current_portion_long_term")), ("de_ratio", share("debt", "total_equity")), ("net_de_ratio", share("(debt - cash_and_deposits)", "total_equity")),
        *_CYCLE, ("free_cash_flow", "operating_cf + investing_cf"), ("ocf_margin", share("operating_cf", "revenue")), ("capex_depreciation", share("abs(purchase_ppe)", "depreciation")),
        ("payout_ratio", share("dividend_per_share", "eps")), *_INTEREST, ("ebitda", "nullif(operating_income, 0) + nullif(depreciation, 0)"), *_DEBT,
        ("allowance_total", "coalesce(abs(allowance_for_doubtful_total), nullif(abs(coalesce(allowance_for_doubtful_current, 0)) + abs(coalesce(allowance_for_doubtful_non_current, 0)), 0))"),
    ],
    "us": [
        ("net_income", "coalesce(nullif(net_income, 0), net_income_attributable)"),
        ("operating_income", "coalesce(operating_income, gross_profit - sga_expense - coalesce(research_development, 0), revenue - cost_of_sales - sga_expense - coalesce(research_development, 0), income_before_tax)"),
        ("receivables", "accounts_receivable"), ("payables", "accounts_payable"), ("depreciation", "depreciation_amortization"), ("cash_and_deposits", "cash_and_equivalents"),
        *_COMMON, ("ocf_margin", share("operating_cf", "revenue")), ("roic", "operating_income * 0.79D / nullif(greatest(total_assets - coalesce(current_liabilities, 0) + coalesce(long_term_debt, 0), 0), 0) * 100"),
        ("debt_equity", share("total_liabilities", "total_equity", 1)), ("current_ratio", share("current_assets", "current_liabilities", 1)),
        ("free_cash_flow", "coalesce(operating_cf - abs(capex), operating_cf + investing_cf)"), ("ebitda", "operating_income + depreciation"), ("ebitda_margin", share("ebitda", "revenue")),
        ("eps_calculated", share("nullif(net_income, 0)", "shares_outstanding", 1)), ("bps", share("nullif(total_equity, 0)", "shares_outstanding", 1)), ("payout_ratio", share("abs(nullif(dividends_paid, 0))", "net_income")),
        ("shareholder_return", total("abs(dividends_paid)", "abs(share_repurchases)")),
        ("receivables_days", share("receivables", "revenue", 365)), ("inventory_days", share("inventories", "coalesce(cost_of_sales, revenue)", 365)), ("payables_days", share("payables", "coalesce(cost_of_sales, revenue)", 365)),
        ("cash_cycle", "receivables_days + inventory_days - payables_days"), ("asset_turnover", share("revenue", "total_assets", 1)), ("capex_depreciation", share("abs(capex)", "depreciation", 1)), ("capex_intensity", share("abs(capex)", "revenue")),
        ("revenue_yoy", share("(revenue - nullif(prev_revenue, 0))", "abs(prev_revenue)")), ("operating_income_yoy", share("(nullif(operating_income, 0) - nullif(prev_operating_income, 0))", "abs(prev_operating_income)")), ("net_income_yoy", share("(nullif(net_income, 0) - nullif(prev_net_income, 0))", "abs(prev_net_income)")),
        *_INTEREST, ("debt", total("short_term_loans", "current_portion_long_term", "long_term_debt")), *_DEBT,
        ("accrued_interest_growth", "(interest_receivable - prev_interest_receivable) / nullif(greatest(interest_income, 0), 0) * 100"),
        ("pik_income_ratio", share("investment_income_pik", "greatest(coalesce(nullif(investment_income_total, 0), revenue), 0)")), ("credit_loss_coverage", share("nullif(allowance_for_credit_loss, 0)", "greatest(financing_receivable_net, 0)")),
        ("allowance_growth", "(nullif(allowance_for_credit_loss, 0) - prev_allowance) / nullif(greatest(prev_allowance, 0), 0) * 100"), ("nonaccrual_ratio", share("financing_receivable_nonaccrual", "greatest(financing_receivable_net, 0)")),
        ("level_3_ratio", share("level_3_assets", "greatest(total_assets, 0)")),
    ],
    "tw": [*_COMMON, ("current_ratio", share("current_assets", "current_liabilities", 1)), ("debt_equity", share("total_liabilities", "total_equity", 1))],
    "report": [
        *_COMMON, ("ebitda", "nullif(operating_income, 0) + abs(nullif(coalesce(nullif(depreciation, 0), depreciation_cf), 0))"), ("ebitda_margin", share("ebitda", "revenue")),
        ("free_cash_flow", "coalesce(operating_cf + investing_cf, operating_cf - abs(coalesce(nullif(capex, 0), purchase_ppe)))"),
        ("debt", "coalesce(" + total("short_term_loans", "long_term_loans", "bonds_payable") + ", " + total("financial_liabilities_current", "financial_liabilities_non_current") + ")"),
        ("net_debt", "debt - coalesce(nullif(cash_and_deposits, 0), cash_end, 0)"), ("net_debt_ebitda", "net_debt / nullif(greatest(ebitda, 0), 0)"), ("de_ratio", "debt / nullif(greatest(coalesce(nullif(total_equity, 0), shareholders_equity), 0), 0)"),
        ("roic", "nullif(operating_income, 0) * 0.7D / nullif(greatest(coalesce(nullif(total_equity, 0), shareholders_equity) + debt, 0), 0) * 100"),
        ("payout_ratio", "coalesce(nullif(total_dividend, 0), abs(nullif(dividends_paid, 0))) / nullif(greatest(net_income, 0), 0) * 100"),
        ("net_interest_income", "nullif(interest_income_bank, 0) - nullif(interest_expense_bank, 0)"), ("nim", share("net_interest_income", "greatest(loans_bank, 0)")),
        ("net_fee_income", "nullif(fee_income_bank, 0) - nullif(fee_expense_bank, 0)"), ("gross_profit_bank", "net_interest_income + net_fee_income + coalesce(trading_income_bank, 0) - coalesce(trading_expense_bank, 0)"),
        ("overhead_ratio", share("nullif(general_admin_bank, 0)", "greatest(gross_profit_bank, 0)")), ("loan_deposit_ratio", share("nullif(loans_bank, 0)", "greatest(deposits_bank, 0)")), ("securities_ratio", share("nullif(securities_bank, 0)", "greatest(total_assets, 0)")),
    ],
}


def derive(df: DataFrame, market: str, keep: bool = False) -> DataFrame:
    """All of a market's figures added. Figures are recomputed from base columns, so a stale one becomes null where it can
    no longer be computed; ``keep`` leaves what is there and only fills gaps (as reports do)."""
    rules = RULES[market]
    made = {n for n, _ in rules}
    needed = {w for _, e in rules for w in _WORD.findall(e)} - _NOT_FIELDS
    out = df.withColumns({f: F.lit(None).cast("double") for f in sorted(needed - set(df.columns) - made)})
    for name, rule in rules:
        value = F.expr(rule if name in out.columns else re.sub(rf"\b{name}\b", "CAST(NULL AS DOUBLE)", rule))
        out = out.withColumn(name, F.coalesce(F.col(name), value) if keep and name in df.columns else value)
    return out


def _rule(name: str, expected: str, actual: str, within: float | None, when: str = "true") -> tuple:
    return name, expected, actual, within, when


#: Checks by class: name, expected, actual, tolerance in per cent of the expected figure (0: the exact rule of
#: ``checks.check``; None: informational, always passed), and when it applies.
_BALANCE = _rule("balance", "nullif(total_assets, 0)", "total_liabilities + total_equity", 3.0)
_STATEMENTS = [
    _BALANCE,
    _rule("assets", "nullif(total_assets, 0)", "current_assets + non_current_assets + coalesce(deferred_assets, 0)", 0.1),
    _rule("liabilities", "nullif(total_liabilities, 0)", "current_liabilities + non_current_liabilities", 0.5),
    _rule("inventories", "inventories", total("merchandise", "finished_goods", "work_in_progress", "raw_materials", "supplies"), None),
    _rule("gross_profit", "nullif(revenue - cost_of_sales, 0)", "gross_profit", 1.0),
    _rule("net_income", "income_before_tax - income_taxes - coalesce(non_controlling_profit, 0)", "net_income", None),
    _rule("operating_margin", "operating_income / nullif(greatest(revenue, 0), 0) * 100", "operating_margin", 0.0),
    _rule("free_cash_flow", "operating_cf + investing_cf", "free_cash_flow", 0.0, "financing_cf is not null"),
    _rule("cash", "cash_end", "cash_and_deposits", None),
    _rule("capex", "capex", "abs(purchase_ppe) + abs(coalesce(purchase_intangibles, 0))", None),
    _rule("dividends", "nullif(greatest(dividend_per_share * (shares_issued - abs(coalesce(treasury_shares, 0))), 0), 0)", "abs(nullif(dividends_paid, 0))", 20.0),
]
_EQUITY_IFRS = "shareholders_equity + coalesce(accumulated_oci, 0) + coalesce(non_controlling_interests, 0) - case when treasury_stock < 0 then 0 else abs(coalesce(treasury_stock, 0)) end"
_EQUITY_JP = "shareholders_equity + coalesce(nullif(valuation_adjustments, 0), accumulated_oci, 0) + coalesce(subscription_rights, 0) + coalesce(non_controlling_interests, 0)"
_OPERATING = "coalesce(nullif(operating_gross_profit, 0), gross_profit) - selling_general_admin"
_OTHER = "coalesce(other_income, 0) - coalesce(other_expenses, 0)"


def _nearest(target: str, *ways: str) -> str:
    """The way that comes nearest to the target, the first of equals; zero ways do not count."""
    pairs = ", ".join(f"named_struct('d', abs({target} - ({w})) / abs(nullif({w}, 0)), 'k', {k}, 'v', {w})" for k, w in enumerate(ways))
    return f"array_min(filter(array({pairs}), p -> p.d is not null)).v"


CHECKS = {
    "general": [
        *_STATEMENTS,
        _rule("equity", "total_equity", _EQUITY_JP, None, "abs(shareholders_equity - total_equity) >= 1000"),
        _rule("operating_income", "operating_income", _OPERATING, None),
        _rule("ordinary_income", "nullif(operating_income + coalesce(non_operating_income, 0) - coalesce(non_operating_expenses, 0), 0)", "ordinary_income", 15.0, "abs(operating_income - ordinary_income) >= 1000 and (coalesce(non_operating_income, 0) <> 0 or coalesce(non_operating_expenses, 0) <> 0)"),
    ],
    "ifrs": [
        *_STATEMENTS,
        _rule("equity", "total_equity", _EQUITY_IFRS, None, "abs(shareholders_equity - total_equity) >= 1000"),
        _rule("operating_income", "operating_income", _nearest("operating_income", _OPERATING, f"{_OPERATING} + {_OTHER}", f"{_OPERATING} - coalesce(rd_expenses, 0) + {_OTHER}", f"{_OPERATING} - coalesce(rd_expenses, 0)"), None),
    ],
    "bank": [
        _rule("balance", "total_liabilities + total_equity", "total_assets", 0.0),
        _rule("equity", "nullif(total_equity, 0)", "shareholders_equity + coalesce(accumulated_oci, 0) + coalesce(non_controlling_interests, 0)", None),
        _rule("ordinary_income", "nullif(nullif(revenue, 0) - nullif(cost_of_sales, 0), 0)", "coalesce(nullif(ordinary_income, 0), nullif(operating_income, 0))", 30.0),
        _rule("net_income", "income_before_tax - income_taxes", "net_income", None),
        _rule("free_cash_flow", "nullif(operating_cf + investing_cf, 0)", "free_cash_flow", 30.0),
        _rule("cash", "nullif(greatest(cash_end, cash_and_deposits), 0)", "least(cash_end, cash_and_deposits)", 30.0),
    ],
}
CHECKS["retail"] = CHECKS["ifrs"]
CHECKS["investment_holding"] = [
    *[r for r in _STATEMENTS if r[0] not in ("gross_profit", "net_income", "operating_margin")],
    _rule("gross_profit", "revenue - cost_of_sales", "gross_profit", 0.0),
    _rule("net_income", "nullif(income_before_tax - income_taxes, 0)", "net_income", 20.0),
]


def class_checks(df: DataFrame, keys: list[str], company_class: Column) -> DataFrame:
    """One row for each check that a row's class has and whose figures are there: keys, class, check_name, expected, actual,
    difference_pct, passed, severity (info, warning, error)."""
    needed = {w for rules in CHECKS.values() for r in rules for e in (r[1], r[2], r[4]) for w in _WORD.findall(e)} - _NOT_FIELDS - {"true", "p", "d", "v"}
    out = df.withColumns({f: F.lit(None).cast("double") for f in sorted(needed - set(df.columns))}).withColumn("class", company_class)

    def one(name, expected, actual, within, when):
        e, a = F.expr(expected).cast("double"), F.expr(actual).cast("double")
        pct = F.abs(a - e) / present(F.abs(e)) * 100
        exact = check(e, a)
        passed = F.lit(True) if within is None else exact["passed"] if within == 0 else F.coalesce(pct <= within, F.lit(False))
        severity = F.when(passed, "info").otherwise(exact["severity"] if within == 0 else F.lit("warning"))
        row = F.struct(F.lit(name).alias("check_name"), e.alias("expected"), a.alias("actual"), pct.alias("difference_pct"), passed.alias("passed"), severity.alias("severity"))
        return F.when(e.isNotNull() & a.isNotNull() & F.expr(when), row)

    rows = None
    for name, rules in CHECKS.items():
        own = F.array_compact(F.array(*[one(*r) for r in rules]))
        rows = F.when(F.col("class") == name, own) if rows is None else rows.when(F.col("class") == name, own)
    return out.select(*keys, "class", F.inline(rows))


#: Equations that are repaired, in order: total, addends, and the words that a replacement's tag has to hold for each.
REPAIRS = [
    ("total_assets", "total_liabilities", "total_equity", ("asset",), ("liabilit",), ("equity", "netasset")),
    ("total_assets", "current_assets", "non_current_assets", ("asset",), ("currentasset",), ("noncurrentasset",)),
    ("total_liabilities", "current_liabilities", "non_current_liabilities", ("liabilit",), ("currentliabilit",), ("noncurrentliabilit",)),
    ("revenue", "cost_of_sales", "gross_profit", ("sales", "revenue"), ("cost",), ("gross",)),
]


def repaired(df: DataFrame, facts: str = "facts", least_gap: float = 1000.0, near: float = 1e-4) -> DataFrame:
    """``df`` after the equations' repairs, with ``fixes``: the fields replaced, in order.

    Where an equation is off by ``least_gap`` or more, the first of total, first and second addend is replaced for which
    the row's ``facts`` (array of tag, value) hold the wanted value, within ``near`` of its size, under a tag with one of
    the field's words. Later equations see earlier repairs.
    """
    def find(want: Column, words: tuple[str, ...]) -> Column:
        fits = lambda x: (F.abs(x["value"] - want) <= near * F.abs(want)) & F.lower(x["tag"]).rlike("|".join(words))
        return F.get(F.filter(F.coalesce(F.col(facts), F.array().cast("array<struct<tag:string,value:double>>")), fits), F.lit(0))["value"]

    fields = {f for r in REPAIRS for f in r[:3]}
    out = df.withColumns({f: F.lit(None).cast("double") for f in sorted(fields - set(df.columns))}).withColumn("fixes", F.array().cast("array<string>"))
    for t, a, b, *words in REPAIRS:
        off = F.coalesce(F.abs(F.col(t) - F.col(a) - F.col(b)) >= least_gap, F.lit(False))
        wants = [find(F.col(a) + F.col(b), words[0]), find(F.col(t) - F.col(b), words[1]), find(F.col(t) - F.col(a), words[2])]
        out = out.withColumn("_f", F.when(off, F.coalesce(*[F.when(w.isNotNull(), F.struct(F.lit(f).alias("field"), w.alias("value"))) for f, w in zip((t, a, b), wants)])))
        out = out.withColumns({f: F.when(F.col("_f.field") == f, F.col("_f.value")).otherwise(F.col(f)) for f in (t, a, b)} | {"fixes": F.when(F.col("_f").isNotNull(), F.array_append("fixes", F.col("_f.field"))).otherwise(F.col("fixes"))}).drop("_f")
    return out


def better_alternative(value: Column, expected: Column, alternatives: Column, off: float = 0.05) -> Column:
    """The first alternative (array, in order) that lies nearer to the expected figure, where the value is off by more than
    the share ``off``; else the value."""
    gap = lambda v: F.abs(v - expected)
    return F.when(gap(value) > off * F.abs(expected), F.coalesce(F.get(F.filter(alternatives, lambda v: gap(v) < gap(value)), F.lit(0)), value)).otherwise(value)


def fix_and_recheck(df: DataFrame, keys: list[str], company_class: Column) -> DataFrame:
    """Per key: failed checks before and after the repairs, and the fixes; a repair that leaves more failures is undone."""
    failed = lambda x, name: class_checks(x, keys, company_class).groupBy(*keys).agg(F.count_if(~F.col("passed")).alias(name))
    fixed = repaired(df)
    out = fixed.select(*keys, "fixes").join(failed(df, "before"), keys, "left").join(failed(fixed, "after"), keys, "left").na.fill(0, ["before", "after"])
    worse = F.col("after") > F.col("before")
    return out.withColumns({"fixes": F.when(worse, F.array().cast("array<string>")).otherwise(F.col("fixes")), "after": F.least("before", "after")})
