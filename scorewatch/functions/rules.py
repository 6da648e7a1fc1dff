"""Business rules of the labelled population as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label and maturity definitions as
# (suffix, days past due, instalments that must be observed, instalments that count as bad).
OUTCOMES: tuple[tuple[str, int, int, tuple[int, ...]], ...] = (
    ("fpd0", 0, 1, (1,)),
    ("fpd10", 10, 1, (1,)),
    ("fpd30", 30, 1, (1,)),
    ("fspd30", 30, 2, (1, 2)),
    ("fstpd30", 30, 3, (1, 2, 3)),
)


def one_if(test: Column) -> Column:
    """1 where the test holds, 0 where it fails or is unknown."""
    return F.when(test, F.lit(1)).otherwise(F.lit(0))


def outcome_flags(observed: str = "obs_min_inst_def", reached: str = "min_inst_def") -> dict[str, Column]:
    """`def<suffix>` labels and `flg_mature_<suffix>` flags."""
    flags: dict[str, Column] = {}
    for suffix, days, needed, bad in OUTCOMES:
        seen = F.col(f"{observed}{days}") >= needed
        flags[f"def{suffix}"] = one_if(seen & F.col(f"{reached}{days}").isin(*bad))
        flags[f"flg_mature_{suffix}"] = one_if(seen)
    return flags


def canonical_name(name: Column, names: Mapping[str, str]) -> Column:
    """Map old display names to their current one; others stay."""
    chain = None
    for old, new in names.items():
        chain = F.when(name == old, F.lit(new)) if chain is None else chain.when(name == old, F.lit(new))
    return name if chain is None else chain.otherwise(name)


def filled(text: Column, default: str) -> Column:
    """Default for null and empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def derived_trench(trench: Column, user_type: Column, onboarded: Column, as_of: Column) -> Column:
    """Given trench, or one derived from repeat status and days since onboarding."""
    repeat = user_type == "1_Repeat Applicant"
    settled = (user_type != "1_Repeat Applicant") & (F.datediff(as_of, onboarded) > 30)
    derived = (
        F.when(repeat, F.lit("Trench 3")).when(settled, F.lit("Trench 2")).otherwise(F.lit("Trench 1"))
    )
    return F.coalesce(F.nullif(trench, F.lit("")), derived)


def operating_system(reported: Column, version: Column, device: Column) -> Column:
    """Reported system, or one read from the loan's version and device texts."""
    def kind(text: Column) -> Column:
        low = F.lower(text)
        return F.when(low.like("%andro%"), F.lit("android")).when(low.like("%os%"), F.lit("ios"))

    from_report = F.coalesce(kind(reported), F.lower(reported))
    from_loan = F.coalesce(
        kind(version), F.when(F.lower(device).like("%andro%"), F.lit("android")), F.lit("ios")
    )
    return F.coalesce(from_report, from_loan)


def product_type(loan_type: Column, store_type: Column, store_tag: Column) -> Column:
    """Product of an instalment loan from its store type."""
    # Store types 1 to 3.
    stores = {1: "Appliance", 2: "Mobile", 3: "Mall"}
    bought = loan_type == "BNPL"
    chain = None
    for code, name in stores.items():
        test = bought & (store_type == code)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.when(bought & ~store_type.isin(*stores), store_tag).otherwise(F.lit("not applicable"))


def inverted(target: Column) -> Column:
    """Swap 0 and 1; anything else becomes 0."""
    return F.when(target == 0, F.lit(1)).otherwise(F.lit(0))


def version_group(version: Column) -> Column:
    """Device group from the system name and the two digits after it."""
    # Fixed values: (system pattern, position of the digits, versions, group).
    groups = (
        ("%ios%", 4, (0, 12, 13, 14, 15), "G1"),
        ("%andro%", 8, (0, 6, 7, 8, 9, 10, 11), "G1"),
        ("%andro%", 8, (12,), "G2"),
        ("%andro%", 8, (13, 14), "G3"),
        ("%ios%", 4, (16, 17), "G4"),
    )
    chain = None
    for pattern, position, versions, group in groups:
        number = F.coalesce(F.substring(version, position, 2).try_cast("int"), F.lit(0))
        test = F.lower(version).like(pattern) & number.isin(*versions)
        chain = F.when(test, F.lit(group)) if chain is None else chain.when(test, F.lit(group))
    return chain.otherwise(F.lit("G5"))


def upper_bands(value: Column, bands: Sequence[tuple[str, float | None]]) -> Column:
    """Label of the first band whose upper limit is not exceeded; None is open."""
    chain = None
    for label, limit in bands:
        test = value.isNotNull() if limit is None else value <= F.lit(float(limit))
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain


def yearly_and_monthly(amount: Column, indicator: Column) -> tuple[Column, Column]:
    """(monthly, yearly) income from an amount stated per month 'M' or per year 'Y'."""
    given = F.coalesce(amount.try_cast("double"), F.lit(0.0))
    monthly = F.when(indicator == "M", F.round(given, 0)).when(
        indicator == "Y", F.round(given / F.lit(12.0), 0)
    )
    yearly = F.when(indicator == "M", F.round(given * F.lit(12.0), 0)).when(
        indicator == "Y", F.round(given, 0)
    )
    return (
        F.coalesce(monthly, F.lit(0.0)).cast("long"),
        F.coalesce(yearly, F.lit(0.0)).cast("long"),
    )


def other_segment_verdict(main: Column, side: Column) -> Column:
    """1 when only side contracts occur."""
    return one_if((main == 0) & (side > 0))


# Industries reported under another name, and those reported as null.
INDUSTRY_NAMES: dict[str, str | None] = {
    "Entertainment and Media": "Recreation (Arts, Entertainment/Media, Sports)",
    "Non Government Organization/Foundation": "NGOs/NonProfit Organization/Foundation",
    "Manufacturing - Food": "Manufacturing",
    "Manufacturing - Non Food": "Manufacturing",
    "Gold, Jewelry and Precious Metals": "Gold/Jewelry/Precious Metals/Art/Antique Dealership",
    "Online Gaming/Lottery/Casino": "Gambling and Betting (Online Gaming, Lottery, Casino)",
    "Education/Schools": "Education/Private Schools",
    "Accounting/Bookkeeping": "Accounting/Bookkeeping/Auditing",
    "Leasing and Rental Services": None,
    "Repair, Sanitation and Housekeeping ": None,
    "Repair, Sanitation and Housekeeping": None,
    "Embassy": None,
    "Recycling": None,
    "Publishing and Printing": None,
}

# Sources of funds reported under another name (two end in a blank) or as null.
FUNDS_SOURCES: dict[str, str | None] = {
    "Income from Business": "Income from Business ",
    "Allowance": "Allowance ",
    "Others": None,
    "Commissions": None,
}

# Contract statuses counted as bad.
BAD_STATUSES: tuple[str, ...] = (
    "Write-off (BLW)",
    "Past Due",
    "Blocked by the Bank due to Credit Reasons",
    "Under dispute / non performing",
    "Under litigation / Delinquent",
    "Blocked or Closed voluntary by the Customer",
    "Blocked or Closed due to Restructuring",
    "There are unpaid amounts, Negotiated Settlement",
    "Previous delinquency settled",
    "Write-off and Credit transferred to third party / Collection",
    "Write-off and Fully Settled",
    "Blocked by the Bank due to card lost/stolen",
    "Blocked by the Bank due to fraud",
    "Dispute / Litigation contested",
)

# Fixed values: (contract phase, statuses, category); an empty status covers null too.
PHASE_CATEGORIES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("Active", ("",), "Neutral"),
    ("Active", ("Pre-Activated", "Foreclosure"), "Good"),
    ("Closed", ("",), "Good"),
    ("Closed in advance", ("", "Foreclosure"), "Good"),
)


def repayment_category(phase: Column, status: Column) -> Column:
    """Neutral, Good, Bad or Unknown from contract phase and status."""
    known = F.coalesce(status, F.lit(""))
    chain = None
    for name, statuses, category in PHASE_CATEGORIES:
        test = (phase == name) & known.isin(*statuses)
        chain = F.when(test, F.lit(category)) if chain is None else chain.when(test, F.lit(category))
    return (
        chain.when(status.isin("Debt Assumption", "Repossessed"), F.lit("Neutral"))
        .when(status.isin(*BAD_STATUSES), F.lit("Bad"))
        .otherwise(F.lit("Unknown"))
    )
