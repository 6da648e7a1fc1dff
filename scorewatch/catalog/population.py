"""The population builder end to end on the driver's tables.

Line items stand for model runs, orders for loans and their request payloads, customers for
merchants. Keys to merchants and trenches hold nulls, merchants and requests have older rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.catalog.base import table
from scorewatch.catalog.registry import registry
from scorewatch.plans import population as plan

QUERIES, CHECKS, query = registry()

NAMES = {"alpha old": "alpha", "alpha": "alpha"}
AS_OF = "1998-01-01"


def _runs(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("{'score': "), F.col("l_extendedprice").cast("string"), F.lit(", 'known': True, 'other': None}"))
    return item.select(
        F.col("l_orderkey").alias("digitalLoanAccountId"),
        F.col("l_suppkey").alias("customerId"),
        F.when(F.col("l_returnflag") == "A", "alpha old").when(F.col("l_returnflag") == "N", "alpha").otherwise("beta").alias("modelDisplayName"),
        F.col("l_linestatus").alias("modelVersionId"),
        F.when(F.col("l_linenumber") != 7, text).alias("prediction"),
        F.concat(F.lit("{'quantity': "), F.col("l_quantity").cast("string"), F.lit("}")).alias("calcFeature"),
        F.when(F.col("l_tax") > 0.06, "Trench 9").when(F.col("l_tax") < 0.02, "").alias("trenchCategory"),
        F.col("l_shipdate").alias("start_time"),
        F.when(F.col("l_discount") > 0.05, "Android 12").when(F.col("l_discount") > 0.03, "iOS 16").alias("deviceOs"),
    )


def _requests(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    day = F.expr("interval 1 day")
    late = orders.select(F.col("o_orderkey").alias("digitalLoanAccountId"), F.col("o_orderdate").alias("publish_time"), F.lit("id=1, trenchCategory='Trench 5', x=2").alias("requestPayload"))
    return late.unionByName(late.withColumns({"publish_time": F.col("publish_time") - day, "requestPayload": F.lit("trenchCategory='Trench 6'")}))


def _mart(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == 0)
    return orders.select(
        F.col("o_orderkey").alias("digitalLoanAccountId"),
        F.when(F.col("o_orderstatus") == "F", "1_Repeat Applicant").otherwise("2_New Applicant").alias("ln_user_type"),
        F.col("o_orderdate").alias("onb_tsa_onboarding_datetime"),
    )


def _loans(spark, sf_dir):
    priority, day = F.col("o_orderpriority"), F.expr("interval 1 day")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("digitalLoanAccountId"),
        (F.col("o_orderkey") + 1_000_000).alias("loanAccountNumber"),
        F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("flagDisbursement"),
        F.when(F.col("o_totalprice") >= 20_000, F.col("o_orderdate")).alias("disbursementDateTime"),
        F.when(priority != "1-URGENT", F.col("o_custkey").cast("string")).alias("purpleKey"),
        F.when(F.col("o_orderstatus") == "F", "Flex-up").otherwise("Quick").alias("new_loan_type"),
        F.when(priority.isin("2-HIGH", "3-MEDIUM"), "BNPL").otherwise("CASH").alias("loantype"),
        (F.col("o_orderdate") - 2 * day).alias("startApplyDateTime"),
        F.when(priority != "5-LOW", F.col("o_orderdate") - day).alias("termsAndConditionsSubmitDateTime"),
        F.lit(None).cast("string").alias("osversion_v2"),
        F.when(priority == "3-MEDIUM", "Android 10").when(priority == "2-HIGH", "iOS 15").alias("osVersion"),
        F.when(priority == "5-LOW", "ANDROID phone").alias("deviceType"),
        F.lit("F").alias("gender"),
    )


def _merchants(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == 0)
    now = customer.select(
        F.col("c_custkey").cast("string").alias("mer_refferal_code"), F.lit("2020-01-01").alias("created_dt"),
        (F.col("c_custkey") % 5).cast("int").alias("store_type"), F.concat(F.lit("tag"), F.col("c_nationkey").cast("string")).alias("store_tagging"),
    )
    return now.unionByName(now.withColumns({"created_dt": F.lit("2019-01-01"), "store_type": F.lit(9), "store_tagging": F.lit("old")}))


DECIDED_FROM, SEGMENTS_AS_OF = "1996-06-01", "1998-12-31"


def risk_tables(spark, sf_dir):
    """Segments and final segments: customers stand for offers, every fifth order for a response."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    loans = orders.select(
        F.col("o_orderkey").alias("digitalLoanAccountId"), F.col("o_orderdate").alias("decision_date"),
        F.when(F.col("o_orderstatus") == "F", "Flex-up").otherwise("Quick").alias("new_loan_type"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")).alias("offer_id"),
    )
    offers = customer.select(
        F.col("c_custkey").alias("offer_id"), F.when(F.col("c_nationkey") % 2 == 0, "SEGMENTED_ACL").otherwise("OTHER").alias("offer_type"),
        F.lit("2020-01-01").alias("created_date"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("risk_segment"),
    )
    offers = offers.unionByName(offers.withColumns({"created_date": F.lit("2019-01-01"), "risk_segment": F.lit("old")}))
    responses = orders.where(F.col("o_orderkey") % 5 == 0).select(
        F.col("o_orderkey").alias("digitalLoanAccountId"), F.col("o_orderdate").alias("created_dt"),
        F.when(F.col("o_orderkey") % 10 != 0, F.substring("o_orderpriority", 1, 1)).alias("risk_segment_final"),
    )
    responses = responses.unionByName(responses.withColumns({"created_dt": F.col("created_dt") - F.expr("interval 1 day"), "risk_segment_final": F.lit("old")}))
    return (
        plan.risk_segments(loans, offers, F.lit(DECIDED_FROM).cast("date")),
        plan.final_segments(responses, F.lit(SEGMENTS_AS_OF).cast("date")),
    )


def _delinquency(spark, sf_dir):
    key = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1_000_000).alias("loanAccountNumber"),
        (key % 3).alias("obs_min_inst_def10"), (key % 2).alias("min_inst_def10"),
    )


def _log(spark, sf_dir, selection="Prod", version=None):
    runs = _runs(spark, sf_dir)
    runs = runs if version is None else runs.where(F.col("modelVersionId") == version)
    return plan.scored_log(
        runs, F.get_json_object("prediction", "$.score"), NAMES, _mart(spark, sf_dir), _requests(spark, sf_dir),
        F.lit(AS_OF).cast("date"), selection,
    )


# The log, loans and merchants, and the join of the three, in the check's own words.
LOG = f"""log as (
  select l_orderkey as account, l_suppkey as customer, l_linestatus as ver, l_extendedprice as score, l_shipdate as run,
    case when l_discount > 0.05 then 'android' when l_discount > 0.03 then 'ios' end as system,
    coalesce(nullif(coalesce(case when l_tax > 0.06 then 'Trench 9' when l_tax < 0.02 then '' end,
        case when o_orderpriority = '1-URGENT' then 'Trench 5' end), ''),
      case when o_orderkey % 3 = 0 and o_orderstatus = 'F' then 'Trench 3'
        when o_orderkey % 3 = 0 and date_diff('day', cast(o_orderdate as date), date '{AS_OF}') > 30 then 'Trench 2'
        else 'Trench 1' end) as trench
  from lineitem left join orders on o_orderkey = l_orderkey
  where l_returnflag in ('A', 'N') and l_linenumber <> 7)"""
LOANS = LOG + """, loans as (
  select *, case when o_orderstatus = 'F' then 'Flex-up' else 'Quick' end as loan,
    case when o_orderstatus = 'F' then o_orderdate - interval 2 day when o_orderpriority <> '5-LOW' then o_orderdate - interval 1 day end as sent,
    case when o_totalprice >= 20000 then o_orderdate end as paid,
    case when o_orderpriority not in ('2-HIGH', '3-MEDIUM') or c_custkey is null then 'not applicable'
      when c_custkey % 5 = 1 then 'Appliance' when c_custkey % 5 = 2 then 'Mobile' when c_custkey % 5 = 3 then 'Mall'
      else 'tag' || c_nationkey end as product,
    case o_orderpriority when '3-MEDIUM' then 'android' when '5-LOW' then 'android' else 'ios' end as device
  from orders left join customer on c_custkey = o_custkey and c_custkey % 2 = 0 and o_orderpriority <> '1-URGENT')"""


RISK = f"""segmented as (
  select o_orderkey as account, case when o_orderpriority = '1-URGENT' or c_nationkey is null or c_nationkey % 2 <> 0 or c_custkey % 7 = 0
    then 'Unsegmented' else c_mktsegment end as risk_segment
  from orders left join customer on c_custkey = o_custkey where o_orderstatus <> 'F' and o_orderdate >= timestamp '{DECIDED_FROM}'),
finals as (
  select o_orderkey as account, case when o_orderkey % 10 = 0 or cast(o_orderdate as date) > date '{SEGMENTS_AS_OF}' then 'old' else left(o_orderpriority, 1) end as risk_segment_final
  from orders where o_orderkey % 5 = 0 and cast(o_orderdate as date) <= date '{SEGMENTS_AS_OF}' + 1)"""


@query(
    "population_scored_log",
    f"""with {LOG} select account as "digitalLoanAccountId", customer as "customerId", 'alpha' as "modelDisplayName", ver as "modelVersionId",
  score, trench as "trenchCategory", 'Prod' as "Data_selection", run as start_time from log""",
)
def population_scored_log(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "digitalLoanAccountId", "customerId", "modelDisplayName", "modelVersionId", "score", "trenchCategory", "Data_selection", "start_time"
    )


@query(
    "population_labelled",
    f"""with {LOANS}, rows_ as (
  select distinct account, customer, ver, score, trench, o_orderkey + 1000000 as number, coalesce(sent, run) as submitted, paid, loan, product,
    coalesce(system, device) as system, o_custkey % 2 as label
  from log join loans on o_orderkey = account
  where o_orderstatus <> 'P' and paid is not null and o_custkey % 3 >= 1),
ranked as (select *, row_number() over (partition by account, ver order by submitted nulls last, score) as rn from rows_)
select customer as "customerId", account as "digitalLoanAccountId", number as "loanAccountNumber", 'alpha' as "modelDisplayName", ver as "modelVersionId",
  score, submitted as appln_submit_datetime, cast(paid as date) as disbursementdate, strftime(submitted, '%Y-%m') as "Application_month",
  'Prod' as "Data_selection", cast(label as int) as label, 1 as flg_mature_fpd10, loan as new_loan_type, trench as "trenchCategory",
  product as loan_product_type, system as "osType"
from ranked where rn = 1""",
)
def population_labelled(spark, sf_dir):
    """Disbursed and matured loans, latest merchant, first run per account and version."""
    return plan.labelled_population(
        _log(spark, sf_dir), _loans(spark, sf_dir), _delinquency(spark, sf_dir), _merchants(spark, sf_dir)
    )


@query(
    "population_risk_segments",
    f"""with {LOANS}, {RISK}, rows_ as (
  select distinct account, ver, score, trench, coalesce(sent, run) as submitted, paid, o_custkey % 2 as label
  from log join loans on o_orderkey = account
  where o_orderstatus <> 'P' and paid is not null and o_custkey % 3 >= 1),
ranked as (select *, row_number() over (partition by account, ver order by submitted nulls last, score) as rn from rows_)
select account as "digitalLoanAccountId", ver as "modelVersionId", score, cast(paid as date) as disbursementdate, cast(label as int) as label,
  trench as "trenchCategory", coalesce(risk_segment, 'NA') as risk_segment, coalesce(risk_segment_final, 'NA') as risk_segment_final
from ranked left join segmented using (account) left join finals using (account) where rn = 1""",
)
def population_risk_segments(spark, sf_dir):
    """The labelled population with both risk segments."""
    rows = plan.labelled_population(
        _log(spark, sf_dir), _loans(spark, sf_dir), _delinquency(spark, sf_dir), _merchants(spark, sf_dir), risk=risk_tables(spark, sf_dir)
    )
    return rows.select(
        "digitalLoanAccountId", "modelVersionId", "score", "disbursementdate", "label", "trenchCategory", "risk_segment", "risk_segment_final"
    )


PSI = LOANS + """, joined as (
  select customer, account, ver, trench, score, loan, product, device as system, coalesce(sent, run) as submitted, paid
  from log left join loans on o_orderkey = account),
latest as (select * from (select *, row_number() over (partition by customer, account, ver order by submitted desc nulls last, score desc) as rn from joined) where rn = 1)"""


@query(
    "population_psi",
    f"""with {PSI} select customer as "customerId", account as "digitalLoanAccountId", 'alpha' as "modelDisplayName", ver as "modelVersionId",
  trench as "trenchCategory", score, 'Prod' as "Data_selection", loan as new_loan_type, 'F' as gender, product as loan_product_type,
  system as "osType", submitted as appln_submit_datetime, strftime(submitted, '%Y-%m') as "Application_month", paid as "disbursementDateTime"
from latest""",
)
def population_psi(spark, sf_dir):
    """All scored applications, latest run per customer, account and version."""
    return plan.psi_population(_log(spark, sf_dir), _loans(spark, sf_dir), _merchants(spark, sf_dir)).drop("calcFeature")


@query(
    "population_psi_risk_segments",
    f"""with {PSI}, {RISK} select customer as "customerId", account as "digitalLoanAccountId", ver as "modelVersionId", score,
  coalesce(risk_segment, 'NA') as risk_segment, coalesce(risk_segment_final, 'NA') as risk_segment_final
from latest left join segmented using (account) left join finals using (account)""",
)
def population_psi_risk_segments(spark, sf_dir):
    """All scored applications with both risk segments."""
    rows = plan.psi_population(_log(spark, sf_dir), _loans(spark, sf_dir), _merchants(spark, sf_dir), risk_tables(spark, sf_dir))
    return rows.select("customerId", "digitalLoanAccountId", "modelVersionId", "score", "risk_segment", "risk_segment_final")


@query(
    "population_train_and_test",
    f"""with {PSI}, both_ as (select *, case ver when 'F' then 'Train' else 'Test' end as selection from latest)
select account as "digitalLoanAccountId", customer as "customerId", selection as "Data_selection", score, trench as "trenchCategory", system as "osType"
from both_ where selection = 'Train' or account not in (select account from both_ where selection = 'Train')""",
)
def population_train_and_test(spark, sf_dir):
    """Train and test populations together; accounts known from train keep their train rows only."""
    loans, merchants = _loans(spark, sf_dir), _merchants(spark, sf_dir)
    train = plan.psi_population(_log(spark, sf_dir, "Train", "F"), loans, merchants)
    test = plan.psi_population(_log(spark, sf_dir, "Test", "O"), loans, merchants)
    return plan.combined_population(train, test).select(
        "digitalLoanAccountId", "customerId", "Data_selection", "score", "trenchCategory", "osType"
    )
