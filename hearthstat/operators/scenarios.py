"""Investment scenarios over whole tables of listings and assumptions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def annuity(loan: Column, rate_pct: Column, months: Column) -> Column:
    r = rate_pct / 1200
    return F.when(loan <= 0, 0.0).when(r == 0, loan / months).otherwise(loan * r / (1 - F.pow(1 + r, -months)))


def balance(loan: Column, rate_pct: Column, months: Column, paid: Column) -> Column:
    """What is owed after so many payments."""
    r = rate_pct / 1200
    return F.when(loan <= 0, 0.0).when(r == 0, loan * (1 - paid / months)).otherwise(loan * (F.pow(1 + r, months) - F.pow(1 + r, paid)) / (F.pow(1 + r, months) - 1))


def cash_flow(s: DataFrame) -> DataFrame:
    """Yields and exit equity of scenarios (price, loan_pct, rate_pct, years, hold_years, rent, vacancy_pct, cost_pct, growth_pct, acquisition_pct)."""
    c = F.col
    s = s.withColumn("loan", c("price") * c("loan_pct") / 100).withColumn("equity", c("price") * (1 + c("acquisition_pct") / 100) - c("loan"))
    s = s.withColumn("payment", annuity(c("loan"), c("rate_pct"), c("years") * 12)).withColumn("noi", 12 * c("rent") * (1 - c("vacancy_pct") / 100) * (1 - c("cost_pct") / 100))
    s = s.withColumn("exit_equity", c("price") * F.pow(1 + c("growth_pct") / 100, c("hold_years")) - balance(c("loan"), c("rate_pct"), c("years") * 12, c("hold_years") * 12))
    return s.withColumns({
        "net_yield_pct": 100 * c("noi") / c("price"), "cash_on_cash_pct": F.when(c("equity") > 0, 100 * (c("noi") - 12 * c("payment")) / c("equity")),
        "profit": c("exit_equity") + c("hold_years") * (c("noi") - 12 * c("payment")) - c("equity"),
    })


#: Assumptions of a deal and what stands in for a missing one (fixed values); None: there is no stand-in.
ASSUMPTIONS = {
    "purchase_price": 0, "purchase_tax": 0, "legal_fees": 0, "broker_fees": 0, "appraisal_fees": 0, "renovation": 0, "furnishing": 0, "other_acquisition": 0, "loan_amount": 0, "interest_rate_pct": 0, "loan_term_years": 25,
    "monthly_rent": 0, "vacancy_pct": 0, "annual_maintenance": 0, "annual_other_operating": 0, "exit_years": 5, "appreciation_pct": 2.5, "exit_price": None, "sale_costs_pct": 0, "sale_tax": 0, "target_return_pct": 8,
}


def deal_outputs(s: DataFrame) -> DataFrame:
    """Every figure of a deal from all its assumptions (columns of ``ASSUMPTIONS``; those that are absent or NULL take their
    stand-in): costs, debt service, rent, yields, cash flow, exit, profit, rate of return and break-even rent.

    The loan is at most the whole cost; what an exit leaves is never below nothing; an exit price that is given overrides
    appreciation.
    """
    c, pos = F.col, lambda name: F.greatest(F.lit(0.0), F.col(name))
    have = {n: F.coalesce(c(n).cast("double"), F.lit(d).cast("double")) if n in s.columns else F.lit(d).cast("double") for n, d in ASSUMPTIONS.items()}
    d = s.withColumns(have)
    fees = sum((pos(n) for n in ("purchase_tax", "legal_fees", "broker_fees", "appraisal_fees", "renovation", "furnishing", "other_acquisition")), F.lit(0.0))
    part = lambda n: F.least(F.greatest(c(n), F.lit(0.0)), F.lit(100.0)) / 100
    d = d.withColumn("_total", pos("purchase_price") + fees).withColumn("_loan", F.least(pos("loan_amount"), c("_total"))).withColumn("_rate", pos("interest_rate_pct"))
    d = d.withColumn("_months", F.greatest(F.lit(1.0), F.floor(F.greatest(F.lit(0.01), c("loan_term_years")) * 12 + 0.5))).withColumn("_hold", F.greatest(F.lit(1.0), F.floor(c("exit_years") + 0.5)))
    d = d.withColumn("_monthly", annuity(c("_loan"), c("_rate"), c("_months"))).withColumn("_rent", 12 * pos("monthly_rent") * (1 - part("vacancy_pct"))).withColumn("_costs", pos("annual_maintenance") + pos("annual_other_operating"))
    d = d.withColumn("_noi", c("_rent") - c("_costs")).withColumn("_cash", c("_noi") - 12 * c("_monthly")).withColumn("_equity", F.greatest(F.lit(0.0), c("_total") - c("_loan")))
    value = F.when(c("exit_price").isNotNull(), pos("exit_price")).otherwise(pos("purchase_price") * F.pow(1 + c("appreciation_pct") / 100, c("_hold")))
    paid = F.least(c("_hold") * 12, c("_months"))
    d = d.withColumn("_value", value).withColumn("_owed", F.when(paid >= c("_months"), 0.0).otherwise(balance(c("_loan"), c("_rate"), c("_months"), paid)))
    d = d.withColumn("_exit", F.greatest(F.lit(0.0), c("_value") - c("_value") * part("sale_costs_pct") - pos("sale_tax") - c("_owed")))
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    whole = lambda x: F.floor(x + 0.5)
    return d.withColumns({
        "total_cost": whole(c("_total")), "equity": whole(c("_equity")), "monthly_debt": whole(c("_monthly")), "annual_debt": whole(12 * c("_monthly")), "effective_rent": whole(c("_rent")), "operating_costs": whole(c("_costs")),
        "gross_yield_pct": F.when(pos("purchase_price") > 0, cents(12 * pos("monthly_rent") / pos("purchase_price") * 100)), "net_yield_pct": F.when(c("_total") > 0, cents(c("_noi") / c("_total") * 100)),
        "annual_cash": whole(c("_cash")), "monthly_cash": whole(c("_cash") / 12), "cash_on_cash_pct": F.when(c("_equity") > 0, cents(c("_cash") / c("_equity") * 100)),
        "exit_value": whole(c("_value")), "owed_at_exit": whole(c("_owed")), "exit_equity": whole(c("_exit")), "profit": whole(c("_exit") + c("_cash") * c("_hold") - c("_equity")),
        "irr_pct": F.when(c("_equity") > 0, cents(100 * irr(c("_equity"), c("_cash"), c("_exit"), c("_hold")))), "break_even_rent": whole((12 * c("_monthly") + c("_costs")) / (12 * F.greatest(F.lit(0.0001), 1 - part("vacancy_pct")))),
    }).drop(*[n for n in ("_total", "_loan", "_rate", "_months", "_hold", "_monthly", "_rent", "_costs", "_noi", "_cash", "_equity", "_value", "_owed", "_exit")])


@F.pandas_udf(DoubleType())
def irr(equity: pd.Series, yearly: pd.Series, last: pd.Series, years: pd.Series) -> pd.Series:
    """Rate at which equity, yearly flows and the last one are worth nothing, by bisection on [-0.99, 5] over all rows at once; NULL without a change of sign."""
    import numpy as np

    e, y, x, n = (s.to_numpy(float) for s in (equity, yearly, last, years))

    def worth(r):
        q = 1 / (1 + r)
        with np.errstate(all="ignore"):
            flows = np.where(np.abs(r) < 1e-12, y * n, y * q * (1 - q**n) / (1 - q))
        return -e + flows + x * q**n

    low, high = np.full(len(e), -0.99), np.full(len(e), 5.0)
    ok = worth(low) * worth(high) <= 0
    for _ in range(120):
        mid = (low + high) / 2
        left = worth(low) * worth(mid) <= 0
        low, high = np.where(left, low, mid), np.where(left, mid, high)
    return pd.Series(np.where(ok, (low + high) / 2, np.nan)).astype("Float64").where(pd.Series(ok))


def max_purchase_price(s: DataFrame) -> DataFrame:
    """The price at which a scenario just earns ``target_pct`` a year.

    At a fixed rate the present value is income times an annuity less price times a constant, so the price has a closed
    form; NULL where income buys nothing, or where the constant is not positive and any price would do.
    """
    c = F.col
    rate, hold = c("target_pct") / 100, c("hold_years")
    fall = F.pow(1 + rate, -hold)
    years = F.when(rate == 0, hold).otherwise((1 - fall) / rate)
    share, months = c("loan_pct") / 100, c("years") * 12
    income = 12 * c("rent") * (1 - c("vacancy_pct") / 100) * (1 - c("cost_pct") / 100)
    exit_ = F.pow(1 + c("growth_pct") / 100, hold) - balance(share, c("rate_pct"), months, hold * 12)
    each = 1 + c("acquisition_pct") / 100 - share + 12 * annuity(share, c("rate_pct"), months) * years - exit_ * fall
    return s.withColumn("max_price", F.when((each > 0) & (income > 0), income * years / each))


def problems(s: DataFrame, key: list[str]) -> DataFrame:
    """(key, rule) of every assumption out of its range; the ranges are fixed."""
    c = F.col
    rules = {"price": c("price") > 0, "rent": c("rent") >= 0, "loan_pct": c("loan_pct").between(0, 100), "rate_pct": c("rate_pct").between(0, 30), "years": c("years").between(1, 40), "hold_years": c("hold_years").between(1, 40), "vacancy_pct": c("vacancy_pct").between(0, 100)}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()]))
    return s.select(*key, F.explode(broken).alias("rule"))
