"""The labelled population: scored log, loan master, outcomes and merchants joined and de-duplicated."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.dates import application_time, month_label
from scorewatch.functions.rules import (
    canonical_name,
    derived_trench,
    operating_system,
    outcome_flags,
    product_type,
)
from scorewatch.functions.text import literal_to_json, number_or_null, payload_value
from scorewatch.operators.dedup import earliest_per_key, latest_per_key
from scorewatch.operators.joins import with_latest, with_lookup, with_train_precedence

ACCOUNT = "digitalLoanAccountId"
NO_OFFER, NO_SEGMENT = "Unsegmented", "NA"


def scored_log(
    runs: DataFrame,
    score: Column,
    names: Mapping[str, str],
    score_mart: DataFrame | None = None,
    requests: DataFrame | None = None,
    as_of: Column | None = None,
    selection: str | None = "Prod",
) -> DataFrame:
    """Cleaned model runs of the wanted models with their score and trench.

    `names` maps every accepted display name to its current one. The trench comes from the
    run, then from the latest request payload, then from the customer's history.
    """
    wanted = runs.where(F.col("modelDisplayName").isin(*names))
    rows = wanted.withColumns(
        {
            "modelDisplayName": canonical_name(F.col("modelDisplayName"), names),
            "calcFeature": literal_to_json(F.col("calcFeature")),
            "prediction": literal_to_json(F.col("prediction")),
        }
    )
    rows = rows.withColumn("score", number_or_null(score.cast("string"))).where(F.col("score").isNotNull())
    if requests is not None:
        rows = with_latest(
            rows, requests, "digitalLoanAccountId", "digitalLoanAccountId", "publish_time", ["requestPayload"], spread_like=wanted
        )
        rows = rows.withColumn(
            "trenchCategory", F.coalesce("trenchCategory", payload_value(F.col("requestPayload"), "trenchCategory"))
        ).drop("requestPayload")
    if score_mart is not None:
        mart = score_mart.select("digitalLoanAccountId", "ln_user_type", "onb_tsa_onboarding_datetime")
        rows = rows.join(mart, "digitalLoanAccountId", "left").withColumn(
            "trenchCategory",
            derived_trench(
                F.col("trenchCategory"), F.col("ln_user_type"), F.col("onb_tsa_onboarding_datetime"),
                as_of if as_of is not None else F.current_date(),
            ),
        ).drop("ln_user_type", "onb_tsa_onboarding_datetime")
    return rows if selection is None else rows.withColumn("Data_selection", F.lit(selection))


def risk_segments(
    loans: DataFrame,
    offers: DataFrame,
    decided_from: Column,
    loan_type: str = "Quick",
    offer_type: str = "SEGMENTED_ACL",
    decided: str = "decision_date",
) -> DataFrame:
    """Risk segment of each account: that of the segmented offer its loan was decided on.

    Only loans of `loan_type` decided from a date on count, for an account with several the
    latest; of an offer the latest state counts. Loans without such an offer are 'Unsegmented'.
    """
    eligible = loans.where((F.to_date(decided) >= decided_from) & (F.col("new_loan_type") == loan_type) & F.col(ACCOUNT).isNotNull())
    own = latest_per_key(eligible.select(ACCOUNT, "offer_id", decided), [ACCOUNT], decided, ["offer_id"])
    segmented = offers.where(F.col("offer_type") == offer_type)
    found = with_latest(own, segmented, "offer_id", "offer_id", "created_date", ["risk_segment"], ["risk_segment"], eligible)
    return found.select(ACCOUNT, F.coalesce("risk_segment", F.lit(NO_OFFER)).alias("risk_segment"))


def final_segments(responses: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Latest known final risk segment of each account, up to a date if one is given."""
    known = responses.where(F.col("risk_segment_final").isNotNull() & F.col(ACCOUNT).isNotNull())
    if as_of is not None:
        known = known.where(F.to_date("created_dt") <= as_of)
    return latest_per_key(known, [ACCOUNT], "created_dt", ["risk_segment_final"]).select(ACCOUNT, "risk_segment_final")


def with_risk_segments(
    rows: DataFrame, segments: DataFrame, finals: DataFrame, spread_like: DataFrame | None = None
) -> DataFrame:
    """Add risk_segment and risk_segment_final by account; accounts without one read 'NA'."""
    for lookup, name in ((segments, "risk_segment"), (finals, "risk_segment_final")):
        like = rows if spread_like is None else spread_like
        rows = with_lookup(rows, lookup, [ACCOUNT], like.select(ACCOUNT)).withColumn(name, F.coalesce(name, F.lit(NO_SEGMENT)))
    return rows


def labelled_population(
    log: DataFrame,
    loans: DataFrame,
    delinquency: DataFrame,
    merchants: DataFrame,
    outcome: str = "fpd10",
    risk: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Disbursed, matured loans with score, label and segment columns; first run per version.

    `risk`: segments and final segments by account, for two more segment columns.
    """
    mature = "flg_mature_" + {"fspd30": "fspd_30", "fstpd30": "fstpd_30"}.get(outcome, outcome)
    flags = outcome_flags()
    labels = delinquency.select(
        "loanAccountNumber",
        flags[f"def{outcome}"].alias(f"def{outcome}"),
        flags[f"flg_mature_{outcome}"].alias(mature),
    ).where(F.col(mature) == 1)
    paid_out = loans.where((F.col("flagDisbursement") == 1) & F.col("disbursementDateTime").isNotNull())
    joined = log.join(paid_out, "digitalLoanAccountId", "inner").join(labels, "loanAccountNumber", "inner")
    joined = with_latest(
        joined, merchants, "purpleKey", "mer_refferal_code", "created_dt", ["store_type", "store_tagging"], spread_like=paid_out
    )
    version = F.coalesce("osversion_v2", "osVersion")
    submitted = application_time(
        F.col("new_loan_type"), F.col("startApplyDateTime"), F.col("termsAndConditionsSubmitDateTime"), F.col("start_time")
    )
    rows = joined.select(
        "customerId", "digitalLoanAccountId", "loanAccountNumber", "modelDisplayName", "modelVersionId", "score",
        submitted.alias("appln_submit_datetime"),
        F.to_date("disbursementDateTime").alias("disbursementdate"),
        month_label(submitted).alias("Application_month"),
        "Data_selection",
        F.col(f"def{outcome}").alias("label"),
        mature,
        "new_loan_type", "trenchCategory",
        product_type(F.col("loantype"), F.col("store_type"), F.col("store_tagging")).alias("loan_product_type"),
        operating_system(F.col("deviceOs"), version, F.col("deviceType")).alias("osType"),
    ).distinct()
    first = earliest_per_key(
        rows, ["digitalLoanAccountId", "modelVersionId"], "appln_submit_datetime", ["score"]
    )
    return first if risk is None else with_risk_segments(first, *risk, loans)


def psi_population(
    log: DataFrame, loans: DataFrame, merchants: DataFrame, risk: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Scored applications with segment columns, latest run per customer, account and version.

    `risk`: segments and final segments by account, for two more segment columns.
    """
    joined = log.join(loans, "digitalLoanAccountId", "left")
    joined = with_latest(
        joined, merchants, "purpleKey", "mer_refferal_code", "created_dt", ["store_type", "store_tagging"], spread_like=loans
    )
    submitted = application_time(
        F.col("new_loan_type"), F.col("startApplyDateTime"), F.col("termsAndConditionsSubmitDateTime"), F.col("start_time")
    )
    none = F.lit(None).cast("string")
    rows = joined.select(
        "customerId", "digitalLoanAccountId", "modelDisplayName", "modelVersionId", "trenchCategory", "score",
        "calcFeature", "Data_selection", "new_loan_type", "gender",
        product_type(F.col("loantype"), F.col("store_type"), F.col("store_tagging")).alias("loan_product_type"),
        operating_system(none, F.coalesce("osversion_v2", "osVersion"), F.col("deviceType")).alias("osType"),
        submitted.alias("appln_submit_datetime"),
        month_label(submitted).alias("Application_month"),
        "disbursementDateTime",
    )
    latest = latest_per_key(
        rows, ["customerId", "digitalLoanAccountId", "modelVersionId"], "appln_submit_datetime", ["score"]
    )
    return latest if risk is None else with_risk_segments(latest, *risk, loans)


def combined_population(train: DataFrame, test: DataFrame, account: str = "digitalLoanAccountId") -> DataFrame:
    """Train and test together; accounts known from train keep their train rows only."""
    return with_train_precedence(train, test, account)
