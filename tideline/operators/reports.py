"""Figures chosen by the priority of their concepts, with guards by industry and currency, as of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import equity as E
from . import joins as J

# Concepts in the order of their priority, marks of an industry, forms of foreign filers, currencies.
REVENUE = (
    "us-gaap/Revenues", "us-gaap/RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap/SalesRevenueNet",
    "us-gaap/RevenueFromContractWithCustomerIncludingAssessedTax", "us-gaap/SalesRevenueGoodsNet", "us-gaap/SalesRevenueServicesNet",
)
IFRS_REVENUE = ("ifrs-full/Revenues",)
SHARES = (
    "us-gaap/WeightedAverageNumberOfDilutedSharesOutstanding", "us-gaap/WeightedAverageNumberOfSharesOutstandingBasic",
    "us-gaap/CommonStockSharesOutstanding", "us-gaap/CommonStockSharesIssued",
)
EPS = ("us-gaap/EarningsPerShareDiluted", "us-gaap/EarningsPerShareBasic")
IFRS_EPS = ("ifrs-full/EarningsPerShareDiluted", "ifrs-full/EarningsPerShareBasic")
EQUITY = ("us-gaap/StockholdersEquity", "us-gaap/LiabilitiesAndStockholdersEquity")
BANK = ("us-gaap/NetInterestIncome", "us-gaap/InterestAndDividendIncomeOperating", "us-gaap/LoansAndLeasesReceivableNetReportedAmount")
INSURER = (
    "us-gaap/SupplementaryInsuranceInformationPremiumRevenue", "us-gaap/PolicyholderBenefitsAndClaimsIncurredNet",
    "us-gaap/PremiumsEarnedNet", "us-gaap/InsuranceLossReserves",
)
BANK_NAMES = ("BANCORP", "BANCSHARES", "BANKERS", "BANKING", "NATIONAL BANK", "SAVINGS BANK", "FEDERAL SAVINGS", "FINANCIAL GROUP")
INSURER_NAMES = ("INSURANCE", "INSURER", "REINSURANCE", "REINSURER", "CASUALTY", "LIFE & ANNUITY")
FOREIGN_FORMS = ("20-F", "6-K", "40-F")
CURRENCIES = tuple("USD CNY EUR GBP JPY AUD CAD CHF HKD INR KRW BRL MXN SEK NOK DKK SGD TWD ZAR RUB ILS TRY SAR AED NZD THB IDR".split())


def seen(asof: DataFrame, events: DataFrame, values: dict[str, Column], *, then: tuple[str, ...] = ()) -> DataFrame:
    """asof (symbol, as_of, ...) with the last value that isn't null of each column of events (symbol, day, ...) at or before the day, all of them in one
    shuffle. `then` orders events of one day. Events without a day don't count."""
    side = asof.select("symbol", F.col("as_of").alias("day"), F.lit(1).alias("_side"), F.struct(*asof.columns).alias("_row"))
    own = events.filter(F.col("day").isNotNull()).select("symbol", "day", F.lit(0).alias("_side"), *then, *(v.alias(k) for k, v in values.items()))
    both = own.unionByName(side, allowMissingColumns=True)
    out = J.running_last(both, {f"_seen_{k}": F.col(k) for k in values}, by="symbol", t="day", then=("_side", *then))
    return out.filter("_side = 1").select("_row.*", *(F.col(f"_seen_{k}").alias(k) for k in values))


def named(name: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.upper(name).rlike("|".join(words)), F.lit(False))


def prioritised(asof: DataFrame, facts: DataFrame, filings: DataFrame, *, bank_totals: tuple[str, ...] = REVENUE[:1]) -> DataFrame:
    """asof (symbol, as_of, name, ...) with revenue, shares, eps and equity: each from the first of its concepts that has a value by then, the
    latest one; IFRS figures only where they are in USD and no other is there (or revenue is 0). is_bank and is_insurer by concepts
    seen by then, then by name; foreign filers with the currency of their latest revenue. facts (symbol, concept, value, unit, day, id),
    filings (symbol, form, day)."""
    pick = lambda c, ok=F.lit(True): F.when((F.col("concept") == c) & F.col("value").isNotNull() & ok, F.col("value"))
    usd = F.coalesce((F.col("unit") == "USD") | F.col("unit").startswith("USD/"), F.lit(False))
    marks = lambda cs, ok=F.lit(True): F.when(F.col("concept").isin(*cs) & ok, F.lit(True))
    local, world = [*REVENUE, *SHARES, *EPS, *EQUITY], [*IFRS_REVENUE, *IFRS_EPS]
    column = {c: f"_c{i}" for i, c in enumerate(local + world)}
    values = {column[c]: pick(c) for c in local} | {column[c]: pick(c, usd) for c in world}
    values |= {
        "_bank": marks(BANK), "_insurer": marks(INSURER), "bank_total": marks(bank_totals, F.col("value").isNotNull()),
        "_unit": F.when(F.col("concept").isin(*REVENUE) & F.col("value").isNotNull(), F.col("unit")),
        "_foreign": F.when(F.col("form").isin(*FOREIGN_FORMS), F.lit(True)),
    }
    events = facts.unionByName(filings.select("symbol", "form", "day"), allowMissingColumns=True)
    x = seen(asof, events, values, then=("id",))
    first = lambda cs: F.coalesce(*(F.col(column[c]) for c in cs))
    revenue = F.when(first(REVENUE) != 0, first(REVENUE))
    insurer, bank = F.col("_insurer").isNotNull(), F.col("_bank").isNotNull()
    marked = insurer | bank
    x = x.withColumns({
        "revenue": F.coalesce(revenue, first(IFRS_REVENUE)), "shares": first(SHARES), "eps": F.coalesce(first(EPS), first(IFRS_EPS)), "equity": first(EQUITY),
        "is_insurer": insurer | (~marked & named(F.col("name"), INSURER_NAMES)),
        "is_bank": (bank & ~insurer) | (~marked & named(F.col("name"), BANK_NAMES) & ~named(F.col("name"), INSURER_NAMES)),
        "is_foreign": F.col("_foreign").isNotNull(), "currency": F.when(F.col("_unit").isin(*CURRENCIES), F.col("_unit")), "bank_total": F.col("bank_total").isNotNull(),
    })
    return x.drop(*column.values(), "_bank", "_insurer", "_unit", "_foreign")


def guarded_valuation(df: DataFrame) -> DataFrame:
    """Rows of `prioritised` with close, high_52w and rows: the ratios of `equity.valuation`, null where a guard forbids them, and why. A foreign filer's
    ratios need a reporting currency, which must be USD; a bank's sales need a concept of total revenue."""
    x = E.valuation(df)
    abroad = F.when(F.col("is_foreign") & F.col("currency").isNull(), "foreign_filer_currency_unknown").when(F.col("is_foreign") & (F.col("currency") != "USD"), "foreign_currency_not_normalized")
    bad, priced = F.lit("valuation_denominator_invalid"), F.col("close") != 0
    few, counted = F.col("shares") < E.MIN_SHARES, F.col("shares") >= E.MIN_SHARES
    partial = F.when(F.col("is_bank") & ~F.col("bank_total"), "bank_revenue_concept_missing")
    reasons = {
        "ps": F.coalesce(abroad, partial, F.when(F.col("ps").isNull() & ((priced & (F.col("revenue") > 0) & counted) | few), bad)),
        "pe": F.coalesce(abroad, F.when(F.col("pe").isNull() & priced & (F.col("eps") > 0), bad)),
        "pb": F.coalesce(abroad, F.when(F.col("pb").isNull() & ((priced & (F.col("equity") > 0) & counted) | few), bad)),
    }
    x = x.withColumns({f"{k}_reason": v for k, v in reasons.items()})
    return x.withColumns({c: F.when(F.col(f"{k}_reason").isNull(), F.col(c)) for k in reasons for c in (k, f"{k}_score")})


def industry_confidence(df: DataFrame) -> DataFrame:
    """Confidence of growth and margin by industry, and the warning that goes with the margin, for rows with growth, margin, is_bank, is_insurer."""
    growth = F.when(F.col("growth").isNull() | F.col("is_bank"), "low").otherwise("medium")
    margin = F.when(F.col("margin").isNull() | F.col("is_bank") | F.col("is_insurer"), "low").otherwise("medium")
    warning = F.when(F.col("is_bank"), "bank_specific_quality_required").when(F.col("is_insurer"), "insurance_specific_quality_required")
    return df.withColumns({"growth_confidence": growth, "margin_confidence": margin, "margin_warning": F.when(F.col("margin").isNotNull(), warning)})
