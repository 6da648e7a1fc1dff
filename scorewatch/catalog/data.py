"""Population building, payload, de-duplication, join, summary and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from scorewatch.catalog.base import LINES, POPULATION, lines, population, quantile_at, quantile_list, r, rounded, table
from scorewatch.catalog.registry import registry
from scorewatch.functions import dates, rules, text
from scorewatch.operators import aggregates, binning, dedup, joins, payload, profiling
from scorewatch.operators.ordered import numbered
from scorewatch.operators.segments import version_trench_config
from scorewatch.sources.files import run_query, same_columns_union
from scorewatch.sources.sinks import rows_without, with_schema

QUERIES, CHECKS, query = registry()


# --- payloads ------------------------------------------------------------------------------

# Events as Python-literal payloads with a number, a text, a truth value and a null.
K = "cast(json_extract_string(props, '$.k') as bigint)"


def payload_events(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit("{'k': "), k, F.lit(", 'kind': '"), F.col("event_type"), F.lit("', 'large': "),
        F.when(F.col("value") > 10, "True").otherwise("False"), F.lit(", 'gap': "),
        F.when(F.col("user_id") % 3 == 0, "None").otherwise(F.col("user_id").cast("string")), F.lit("}"),
    )
    calc = (
        F.when(F.col("event_type") == "error", "it's broken {")
        .when(F.col("event_type") == "signup", F.concat(F.lit("["), k, F.lit(", 'x']")))
        .otherwise(body)
    )
    return table(spark, sf_dir, "events").withColumns({"calcFeature": calc, "k": k.cast("long")})


@query(
    "expand_payload",
    f"""select event_id, case when event_type in ('error', 'signup') then null else cast({K} as varchar) end as calc_k,
 case when event_type in ('error', 'signup') then null else event_type end as calc_kind,
 case when event_type in ('error', 'signup') then null when value > 10 then 'true' else 'false' end as calc_large,
 case when event_type in ('error', 'signup') or user_id % 3 = 0 then null else cast(user_id as varchar) end as calc_gap,
 case when event_type = 'signup' then '[' || {K} || ', "x"]' end as calc_raw_list from events""",
)
def expand_payload(spark, sf_dir):
    rows = payload_events(spark, sf_dir).select("event_id", "calcFeature")
    return payload.expand_payload(rows, "calcFeature", drop_source=True)


@query(
    "expand_payload_excluding",
    f"""select event_id, case when event_type in ('error', 'signup') then null else event_type end as v1_kind,
 case when event_type in ('error', 'signup') then null when value > 10 then 'true' else 'false' end as v1_large from events""",
)
def expand_payload_excluding(spark, sf_dir):
    rows = payload_events(spark, sf_dir).select("event_id", "calcFeature")
    wide = payload.expand_payload(
        rows, "calcFeature", prefix="v1_Calc_", exclude=["k", "gap", "raw_list"], drop_source=True
    )
    return payload.plain_names(wide)


@query(
    "safe_path",
    f"""select event_id, cast(case when event_type in ('error', 'signup') then null else {K} end as double) as k,
 cast(null as double) as kind_number, case when event_type in ('error', 'signup') then null when user_id % 3 = 0 then {K} else user_id end as first_of from events""",
)
def safe_path(spark, sf_dir):
    clean = text.literal_to_json(F.col("calcFeature"))
    return payload_events(spark, sf_dir).select(
        "event_id",
        text.json_number(clean, "$.k").alias("k"),
        text.json_number(clean, "$.kind").alias("kind_number"),
        text.first_json_number(clean, ["$.gap", "$.k"], "bigint").alias("first_of"),
    )


@query(
    "regex_key",
    f"""select event_id, case when event_type in ('error', 'signup') then null else event_type end as kind,
 case when event_type in ('error', 'signup') then null else cast({K} as double) end as k from events""",
)
def regex_key(spark, sf_dir):
    loose = F.replace(F.col("calcFeature"), F.lit("': "), F.lit("="))
    return payload_events(spark, sf_dir).select(
        "event_id", text.payload_value(loose, "kind").alias("kind"), text.payload_number(loose, "k").alias("k")
    )


@query(
    "split_details",
    """select event_id, event_type as model_type, 'v' || (user_id % 3) as version, strftime(ts, '%Y%m%d') as date, case when user_id % 2 = 0 then 'path' end as file_path,
 case when user_id % 2 = 0 then 'model.pkl' end as file_name from events""",
)
def split_details(spark, sf_dir):
    packed = F.concat(
        F.lit("{"), F.col("event_type"), F.lit(":v"), (F.col("user_id") % 3).cast("string"), F.lit(":"),
        F.date_format("ts", "yyyyMMdd"), F.when(F.col("user_id") % 2 == 0, F.lit(":path:model.pkl}")).otherwise(F.lit("}")),
    )
    rows = table(spark, sf_dir, "events").select("event_id", text.model_details(packed).alias("d"))
    return rows.select("event_id", "d.*")


@query(
    "pack_features",
    """select user_id as customerId, event_id as digitalLoanAccountId, value as prediction, 'back_score' as modelDisplayName, 'v1.1' as modelVersionId,
 '{"value":' || value || case when user_id % 3 = 0 then '' else ',"gap":' || user_id end || ',"event_type":"' || event_type || '"}' as calcFeature,
 'march models' as subscription_name, '{}' as attributes, 'Trench 1' as trenchCategory, 'android' as deviceOs, 'Dev_Test' as Data_selection, cast(ts as date) as Application_date from events""",
)
def pack_features(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"), F.col("event_id").alias("digitalLoanAccountId"), "value",
        F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("gap"), "event_type",
        F.lit("android").alias("osType"), F.lit("Dev_Test").alias("Data_selection"), F.to_date("ts").alias("application_date"),
    )
    packed = payload.pack_features(
        rows, ["value", "gap", "event_type", "absent"], "value", "back_score", "Trench 1", "march models", "v1.1"
    )
    return packed.drop("crifApplicationId", "message_id", "start_time", "end_time", "publish_time")


@query(
    "feature_fill_counts",
    f"""select event_type, feature, filled from (select event_type, count(case when event_type not in ('error', 'signup') then 1 end) as k, count(case when event_type not in ('error', 'signup') and user_id % 3 <> 0 then 1 end) as gap
 from events group by 1) unpivot (filled for feature in (k, gap)) where filled > 0""",
)
def feature_fill_counts(spark, sf_dir):
    rows = payload_events(spark, sf_dir).select("event_type", "calcFeature")
    wide = payload.expand_payload(rows, "calcFeature", prefix="", keys=["k", "gap"])
    return payload.feature_fill_counts(wide, ["k", "gap"], ["event_type"])


@query("map_keys", f"select event_id, cast({K} as varchar) as feature_k, cast(null as varchar) as feature_z from events")
def map_keys(spark, sf_dir):
    rows = payload.with_payload_map(table(spark, sf_dir, "events"), "props", "features")
    return payload.map_columns(rows, "features", ["k", "z"], "feature_").select("event_id", "feature_k", "feature_z")


# --- de-duplication --------------------------------------------------------------------------


@query(
    "latest_per_key",
    "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
)
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return dedup.latest_per_key(rows, ["user_id"], "ts", ["event_id"]).drop("ts")


@query(
    "first_per_version",
    "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
)
def first_per_version(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return dedup.earliest_per_key(rows, ["user_id", "event_type"], "ts", ["event_id"]).drop("ts")


@query(
    "first_submission",
    f"""with {LINES} select digitalLoanAccountId, Data_selection, modelVersionId, disbursementdate, partkey, line, score, quantity from lines
 qualify row_number() over (partition by digitalLoanAccountId, Data_selection, modelVersionId order by disbursementdate nulls last, partkey, line, score, quantity) = 1""",
)
def first_submission(spark, sf_dir):
    rows = lines(spark, sf_dir).select(
        "digitalLoanAccountId", "Data_selection", "modelVersionId", "disbursementdate", "partkey", "line", "score", "quantity"
    )
    return dedup.first_submission(rows, submitted="disbursementdate", ties=["partkey", "line", "score", "quantity"])


@query("whole_row_distinct", f"with {LINES} select distinct flag, line, Application_month, modelVersionId from lines")
def whole_row_distinct(spark, sf_dir):
    return dedup.whole_row_distinct(lines(spark, sf_dir).select("flag", "line", "Application_month", "modelVersionId"))


@query("repeated_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def repeated_keys(spark, sf_dir):
    return dedup.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- joins ------------------------------------------------------------------------------------


@query(
    "latest_dimension",
    """select o_orderkey, o_custkey, event_type, value from orders left join (select user_id, event_type, value from events
 qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) on user_id = o_custkey""",
)
def latest_dimension(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.with_latest(
        orders, table(spark, sf_dir, "events"), "o_custkey", "user_id", "ts", ["event_type", "value"], ["event_id"]
    )


@query(
    "train_precedence",
    f"""with {LINES} select digitalLoanAccountId, Data_selection, line, partkey from lines where Data_selection = 'Train'
 union all select digitalLoanAccountId, Data_selection, line, partkey from lines where Data_selection = 'Test' and digitalLoanAccountId not in (select digitalLoanAccountId from lines where Data_selection = 'Train')""",
)
def train_precedence(spark, sf_dir):
    rows = lines(spark, sf_dir).select("digitalLoanAccountId", "Data_selection", "line", "partkey")
    return joins.with_train_precedence(
        rows.where(F.col("Data_selection") == "Train"), rows.where(F.col("Data_selection") == "Test"), "digitalLoanAccountId"
    )


@query(
    "outer_on_months",
    """select coalesce(a.month, b.month) as month, ordered, shipped from (select strftime(o_orderdate, '%Y-%m') as month, count(*) as ordered from orders group by 1) a
 full outer join (select strftime(l_shipdate, '%Y-%m') as month, count(*) as shipped from lineitem group by 1) b on a.month = b.month""",
)
def outer_on_months(spark, sf_dir):
    def per_month(name, column, output):
        return (
            table(spark, sf_dir, name).groupBy(F.date_format(column, "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias(output))
        )

    return joins.outer_on(
        [per_month("orders", "o_orderdate", "ordered"), per_month("lineitem", "l_shipdate", "shipped")], ["month"]
    )


@query(
    "nearest_date",
    """with a as (select user_id, cast(ts as date) onboarded from events where event_type = 'signup' qualify row_number() over (partition by user_id order by ts, event_id) = 1),
 s as (select user_id, event_id, cast(ts as date) run_date, value as score from events where event_type = 'purchase')
select user_id, onboarded, event_id, run_date, score, cast(abs(date_diff('day', onboarded, run_date)) as int) as day_gap from a join s using (user_id)
where abs(date_diff('day', onboarded, run_date)) < 2 qualify row_number() over (partition by user_id order by abs(date_diff('day', onboarded, run_date)), run_date, event_id) = 1""",
)
def nearest_date(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    signups = events.where(F.col("event_type") == "signup").select("user_id", "ts", "event_id")
    anchors = dedup.earliest_per_key(signups, ["user_id"], "ts", ["event_id"]).select(
        "user_id", F.to_date("ts").alias("onboarded")
    )
    snapshots = events.where(F.col("event_type") == "purchase").select(
        "user_id", "event_id", F.to_date("ts").alias("run_date"), F.col("value").alias("score")
    )
    return joins.nearest_in_time(anchors, snapshots, "user_id", "onboarded", "run_date", 2, ["event_id"])


@query(
    "due_date_snapshot",
    """select o_orderkey, cast(o_orderdate as date) as due_date, max(l_extendedprice) as worst_l_extendedprice from orders join lineitem on l_orderkey = o_orderkey
 and (cast(l_shipdate as date) = cast(o_orderdate as date) + 10 or cast(l_shipdate as date) = cast(o_orderdate as date) + 11) group by 1, 2""",
)
def due_date_snapshot(spark, sf_dir):
    loans = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("due_date"))
    return joins.worst_snapshot_after(
        loans, table(spark, sf_dir, "lineitem"), "o_orderkey", "due_date", "l_orderkey", "l_shipdate", "l_extendedprice"
    )


@query(
    "membership_flags",
    """select o_orderkey, case when o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') then 1 else 0 end as returned,
 case when o_orderkey in (select l_orderkey from lineitem where l_quantity > 45) then 1 else 0 end as bulk, (select min(cast(l_shipdate as date)) from lineitem where l_orderkey = o_orderkey) as first_shipped,
 case when o_orderkey in (select l_orderkey from lineitem where l_linenumber = 7) then 0 else 1 end as no_seventh from orders""",
)
def membership_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    items = table(spark, sf_dir, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    flagged = joins.with_membership_flags(
        orders, items, "o_orderkey", {"returned": F.col("l_returnflag") == "R", "bulk": F.col("l_quantity") > 45}
    )
    shipped = items.withColumn("shipped", F.to_date("l_shipdate"))
    dated = joins.with_first_value(flagged, shipped, "o_orderkey", "shipped", "first_shipped")
    seventh = items.where(F.col("l_linenumber") == 7).select("o_orderkey")
    return joins.with_absence_flag(dated, seventh, "o_orderkey", "no_seventh")


@query(
    "funnel_flags",
    """select c_custkey, cast(c_custkey in (select o_custkey from orders) as int) as applied, cast(c_custkey in (select o_custkey from orders where o_orderstatus = 'F') as int) as approved,
 cast(c_custkey in (select o_custkey from orders where o_orderstatus = 'O') as int) as disbursed, cast(c_custkey in (select o_custkey from orders where o_totalprice < 2000) as int) as rejected from customer""",
)
def funnel_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    stages = {
        "applied": orders, "approved": orders.where(status == "F"), "disbursed": orders.where(status == "O"),
        "rejected": orders.where(F.col("o_totalprice") < 2000),
    }
    return joins.with_stage_flags(
        table(spark, sf_dir, "customer").select("c_custkey"), {n: (s, "o_custkey") for n, s in stages.items()}, "c_custkey"
    )


@query(
    "null_safe_surrogate",
    f"""with {POPULATION}, f as (select trenchCategory, osType, count(*) n from population group by 1, 2),
 d as (select *, row_number() over (order by trenchCategory nulls first, osType nulls first) - 1 segment_id from f)
select trenchCategory, osType, n, segment_id from d""",
)
def null_safe_surrogate(spark, sf_dir):
    keys = ["trenchCategory", "osType"]
    fact = population(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dimension = numbered(fact.select(*keys), keys, "segment_id", start=0)
    return joins.with_surrogate(fact, dimension, keys, "segment_id")


@query(
    "recode",
    """select p_type, count(*) as n, case p_type when 'SMALL' then 'Tiny' when 'LARGE' then null else p_type end as kept, case p_type when 'SMALL' then 'Tiny' else null end as dropped from part group by 1""",
)
def recode(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    names = {"SMALL": "Tiny", "LARGE": None}
    return joins.recoded(joins.recoded(counts, "p_type", names, "kept"), "p_type", names, "dropped", False)


INDUSTRY_LABELS = [*rules.INDUSTRY_NAMES, "Retail", "Agriculture"]
INDUSTRY_CASE = " ".join(
    f"when {i} then {'null' if new is None else chr(39) + new + chr(39)}"
    for i, new in enumerate([rules.INDUSTRY_NAMES.get(old, old) for old in INDUSTRY_LABELS])
)


@query(
    "recode_industry",
    f"""select p_partkey, case p_partkey % {len(INDUSTRY_LABELS)} {INDUSTRY_CASE} end as industry,
 case p_partkey % 6 when 0 then 'Salary' when 1 then 'Income from Business ' when 2 then 'Allowance ' when 3 then null when 4 then null else 'Pension' end as funds from part""",
)
def recode_industry(spark, sf_dir):
    """Industries and sources of funds under their reported name, some null, others as they are."""
    key = F.col("p_partkey")
    industries = F.array(*[F.lit(x) for x in INDUSTRY_LABELS])
    funds = F.array(*[F.lit(x) for x in ("Salary", "Income from Business", "Allowance", "Others", "Commissions", "Pension")])
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.get(industries, (key % len(INDUSTRY_LABELS)).cast("int")).alias("old"),
        F.get(funds, (key % 6).cast("int")).alias("source"),
    )
    named = joins.recoded(parts, "old", rules.INDUSTRY_NAMES, "industry").drop("old")
    return joins.recoded(named, "source", rules.FUNDS_SOURCES, "funds").drop("source")


# --- scalar rules ------------------------------------------------------------------------------


@query(
    "labels_and_maturity",
    """with d as (select l_orderkey, l_linenumber as ln, cast(l_quantity as bigint) % 4 as mi, l_quantity from lineitem)
select l_orderkey, l_quantity, case when ln >= 1 and mi = 1 then 1 else 0 end as deffpd0, case when ln >= 1 then 1 else 0 end as flg_mature_fpd0, case when ln >= 1 and mi = 1 then 1 else 0 end as deffpd10,
 case when ln - 1 >= 1 and mi = 1 then 1 else 0 end as deffpd30, case when ln - 1 >= 2 and mi in (1, 2) then 1 else 0 end as deffspd30, case when ln - 1 >= 3 and mi in (1, 2, 3) then 1 else 0 end as deffstpd30,
 case when ln >= 1 then 1 else 0 end as flg_mature_fpd10, case when ln - 1 >= 1 then 1 else 0 end as flg_mature_fpd30, case when ln - 1 >= 2 then 1 else 0 end as flg_mature_fspd30, 1 as flg_mature_fstpd30
from d where ln - 1 >= 3""",
)
def labels_and_maturity(spark, sf_dir):
    reached = F.col("l_quantity").cast("long") % 4
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity",
        *[F.col("l_linenumber").alias(f"obs_min_inst_def{d}") for d in (0, 10)],
        (F.col("l_linenumber") - 1).alias("obs_min_inst_def30"), *[reached.alias(f"min_inst_def{d}") for d in (0, 10, 30)],
    )
    flagged = rows.withColumns(rules.outcome_flags()).where(F.col("flg_mature_fstpd30") == 1)
    return flagged.select("l_orderkey", "l_quantity", *rules.outcome_flags())


@query(
    "split_windows",
    """select o_orderkey, case when cast(o_orderdate as date) between date '1996-01-01' and date '1997-12-31' then 'Dev_Train' when cast(o_orderdate as date) < date '1996-01-01' then 'Pre_Train' else 'Dev_Test' end as Data_selection,
 strftime(o_orderdate, '%Y-%m') as month, cast(date_trunc('week', o_orderdate) as date) as week_start, cast(strftime(o_orderdate, '%W') as int) as week_number from orders""",
)
def split_windows(spark, sf_dir):
    day = F.to_date("o_orderdate")
    windows = [("Dev_Train", "1996-01-01", "1997-12-31"), ("Pre_Train", None, "1995-12-31")]
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.split_by_windows(day, windows, "Dev_Test").alias("Data_selection"),
        dates.month_label(day).alias("month"), dates.week_start(day).alias("week_start"), dates.week_number(day).alias("week_number"),
    )


@query(
    "application_times",
    """select event_id, case when event_type = 'view' then ts when user_id % 2 = 0 then ts + interval 2 hour else ts + interval 1 hour end as submitted,
 round(user_id % 50 + 0.5, 4) + cast(0 as double) as minutes, cast(ts + interval 8 hour as date) as local_day from events""",
)
def application_times(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumns(
        {
            "started": F.col("ts"),
            "accepted": F.when(F.col("user_id") % 2 == 0, F.col("ts") + F.expr("interval 2 hours")),
            "scored": F.col("ts") + F.expr("interval 1 hour"),
            "loan_type": F.when(F.col("event_type") == "view", "Flex-up").otherwise("Quick"),
            "finished": F.col("ts") + F.make_dt_interval(mins=(F.col("user_id") % 50).cast("int"), secs=F.lit(30)),
        }
    )
    return rows.select(
        "event_id",
        dates.application_time(F.col("loan_type"), F.col("started"), F.col("accepted"), F.col("scored")).alias("submitted"),
        (dates.elapsed_minutes(F.col("started"), F.col("finished")) + F.lit(0.0)).alias("minutes"),
        dates.local_date(F.col("ts"), "Asia/Manila").alias("local_day"),
    )


@query(
    "ages_and_income",
    """select o_orderkey, (2010 - year(o_orderdate)) - case when month(o_orderdate) * 100 + day(o_orderdate) > 615 then 1 else 0 end as age,
 (2010 * 12 + 6) - (year(o_orderdate) * 12 + month(o_orderdate)) as months, cast(case o_orderstatus when 'F' then round(o_totalprice, 0) when 'O' then round(o_totalprice / 12.0, 0) else 0 end as bigint) as monthly,
 cast(case o_orderstatus when 'F' then round(o_totalprice * 12.0, 0) when 'O' then round(o_totalprice, 0) else 0 end as bigint) as yearly,
 case when o_totalprice <= 100000 then 'a. low' when o_totalprice <= 300000 then 'b. middle' else 'c. high' end as band from orders""",
)
def ages_and_income(spark, sf_dir):
    day, on = F.to_date("o_orderdate"), F.lit("2010-06-15").cast("date")
    indicator = F.when(F.col("o_orderstatus") == "F", "M").when(F.col("o_orderstatus") == "O", "Y")
    monthly, yearly = rules.yearly_and_monthly(F.col("o_totalprice").cast("string"), indicator)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.full_years(day, on).cast("long").alias("age"), dates.months_started(day, on).cast("long").alias("months"),
        monthly.alias("monthly"), yearly.alias("yearly"),
        rules.upper_bands(F.col("o_totalprice"), [("a. low", 100000), ("b. middle", 300000), ("c. high", None)]).alias("band"),
    )


@query(
    "os_and_product_rules",
    """with o as (select o_orderkey, case when o_orderpriority like '1%' then 'Android 13' when o_orderpriority like '2%' then 'iOS' when o_orderpriority like '3%' then 'HarmonyX' end as reported,
 case when o_orderstatus = 'F' then 'Android12' when o_orderstatus = 'O' then 'iOS17.1' end as version, case when o_custkey % 2 = 0 then 'ANDROID phone' else 'tablet' end as device, case when o_custkey % 3 = 0 then 'BNPL' else 'CASH' end as loantype, o_custkey % 5 as store from orders)
select o_orderkey, case when reported is not null then case when lower(reported) like '%andro%' then 'android' when lower(reported) like '%os%' then 'ios' else lower(reported) end
  when lower(version) like '%andro%' then 'android' when lower(version) like '%os%' then 'ios' when lower(device) like '%andro%' then 'android' else 'ios' end as osType,
 case when loantype <> 'BNPL' then 'not applicable' when store = 1 then 'Appliance' when store = 2 then 'Mobile' when store = 3 then 'Mall' else 'tag' || store end as loan_product_type,
 case version when 'Android12' then 'G2' when 'iOS17.1' then 'G4' else 'G5' end as device_group from o""",
)
def os_and_product_rules(spark, sf_dir):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    reported = F.when(priority.like("1%"), "Android 13").when(priority.like("2%"), "iOS").when(priority.like("3%"), "HarmonyX")
    version = F.when(status == "F", "Android12").when(status == "O", "iOS17.1")
    device = F.when(F.col("o_custkey") % 2 == 0, "ANDROID phone").otherwise("tablet")
    loan = F.when(F.col("o_custkey") % 3 == 0, "BNPL").otherwise("CASH")
    store = F.col("o_custkey") % 5
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", rules.operating_system(reported, version, device).alias("osType"),
        rules.product_type(loan, store, F.concat(F.lit("tag"), store.cast("string"))).alias("loan_product_type"),
        rules.version_group(version).alias("device_group"),
    )


@query(
    "trench_rules",
    """with o as (select o_orderkey, case when o_orderpriority like '1%' then null when o_orderpriority like '2%' then '' else o_orderpriority end as t, case o_orderstatus when 'F' then '1_Repeat Applicant' when 'O' then '2_New Applicant' end as u, cast(o_orderdate as date) d from orders)
select o_orderkey, case when coalesce(t, '') = '' then 'ALL' else t end as filled_trench, case when coalesce(t, '') <> '' then t when u = '1_Repeat Applicant' then 'Trench 3' when u <> '1_Repeat Applicant' and date_diff('day', d, date '1998-06-30') > 30 then 'Trench 2' else 'Trench 1' end as derived,
 case when u = '1_Repeat Applicant' then 'cash_model' when u is null then 'other' else 'sil_model' end as model, coalesce(u, 'Unsegmented') as risk_segment, 1 - (o_orderkey % 2) as inverted,
 try_cast(case when o_orderkey % 4 = 0 then 'abc' else cast(o_orderkey as varchar) end as double) as coerced from o where lower(u) not like '%repeat%'""",
)
def trench_rules(spark, sf_dir):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    trench = F.when(priority.like("1%"), None).when(priority.like("2%"), "").otherwise(priority)
    user = F.when(status == "F", "1_Repeat Applicant").when(status == "O", "2_New Applicant")
    name = F.when(status == "F", "Alpha").when(status == "O", "Beta").otherwise("other")
    loose = F.when(F.col("o_orderkey") % 4 == 0, "abc").otherwise(F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").where(~F.lower(user).like("%repeat%"))
    return rows.select(
        "o_orderkey", rules.filled(trench, "ALL").alias("filled_trench"),
        rules.derived_trench(trench, user, F.to_date("o_orderdate"), F.lit("1998-06-30").cast("date")).alias("derived"),
        rules.canonical_name(name, {"Alpha": "cash_model", "Beta": "sil_model"}).alias("model"),
        rules.filled(user, "Unsegmented").alias("risk_segment"),
        rules.inverted(F.col("o_orderkey") % 2).cast("long").alias("inverted"), text.number_or_null(loose).alias("coerced"),
    )


@query(
    "text_rules",
    """select p_partkey, case when p_type = 'SMALL' then 'SIL' when p_type = 'LARGE' then 'CASH' else 'ALL' end as product, p_name as without_code, right('id-' || lpad(cast(p_partkey as varchar), 30, '0'), 25) as suffix,
 case when p_size % 5 = 0 then 'Neutral' when p_size % 5 = 1 then 'Good' when p_size % 5 = 2 then 'Bad' when p_size % 5 = 3 then 'Unknown' else 'Neutral' end as category from part""",
)
def text_rules(spark, sf_dir):
    name = F.when(F.col("p_type") == "SMALL", "beta_sil").when(F.col("p_type") == "LARGE", "alpha_cash").otherwise("x")
    identifier = F.concat(F.lit("id-"), F.lpad(F.col("p_partkey").cast("string"), 30, "0"))
    rest = F.col("p_size") % 5
    phase = F.when(rest == 0, "Active").when(rest == 1, "Closed").otherwise("Frozen")
    status = F.when(rest == 1, "").when(rest == 2, "Past Due").when(rest == 3, "odd").when(rest == 4, "Repossessed")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.product_of(name).alias("product"),
        text.without_leading_code(F.concat(F.col("p_size").cast("string"), F.lit(" - "), F.col("p_name"))).alias("without_code"),
        text.id_suffix(identifier).alias("suffix"), rules.repayment_category(phase, status).alias("category"),
    )


# --- summaries ---------------------------------------------------------------------------------


@query(
    "split_summary",
    f"""with {LINES} select Data_selection, count(digitalLoanAccountId) as digitalLoanAccountId_count, min(disbursementdate) as disbursementdate_min, max(disbursementdate) as disbursementdate_max from lines group by 1""",
)
def split_summary(spark, sf_dir):
    return aggregates.split_summary(lines(spark, sf_dir), "Data_selection", "digitalLoanAccountId", "disbursementdate")


@query("value_shares", f"with {LINES} select modelVersionId, flag, count(*) as n, {r('count(*) / cast(sum(count(*)) over (partition by modelVersionId) as double)')} as share from lines group by 1, 2")
def value_shares(spark, sf_dir):
    return aggregates.value_shares(lines(spark, sf_dir), ["modelVersionId"], "flag").withColumn("share", rounded("share"))


def _halves(spark, sf_dir, column):
    rows = lines(spark, sf_dir).select(column, "Data_selection")
    return [rows.where(F.col("Data_selection") == s) for s in ("Train", "Test")]


@query(
    "category_overlap",
    f"""with {LINES}, a as (select distinct digitalLoanAccountId c from lines where Data_selection = 'Train'), b as (select distinct digitalLoanAccountId c from lines where Data_selection = 'Test')
select (select count(*) from a) as train_categories_count, (select count(*) from b) as test_categories_count, (select count(*) from a semi join b using (c)) as common_categories_count,
 (select count(*) from b anti join a using (c)) as categories_only_in_test_count, (select count(*) from a anti join b using (c)) as categories_only_in_train_count, 'digitalLoanAccountId' as feature""",
)
def category_overlap(spark, sf_dir):
    return aggregates.category_overlap(*_halves(spark, sf_dir, "digitalLoanAccountId"), "digitalLoanAccountId")


@query(
    "unmatched_categories",
    f"""with {LINES}, a as (select distinct digitalLoanAccountId from lines where Data_selection = 'Train'), b as (select distinct digitalLoanAccountId from lines where Data_selection = 'Test')
select digitalLoanAccountId, 'train' as only_in from (from a except from b) union all select digitalLoanAccountId, 'test' from (from b except from a)""",
)
def unmatched_categories(spark, sf_dir):
    return aggregates.unmatched_categories(*_halves(spark, sf_dir, "digitalLoanAccountId"), "digitalLoanAccountId")


@query(
    "range_statistics",
    f"""with {POPULATION} select count(*) filter (where digitalLoanAccountId is null) as digitalLoanAccountId_nulls, count(*) filter (where trenchCategory is null) as trenchCategory_nulls,
 count(*) filter (where Application_month is null) as Application_month_nulls, min(Application_month) as first_month, max(Application_month) as last_month from population""",
)
def range_statistics(spark, sf_dir):
    return aggregates.range_statistics(population(spark, sf_dir), "digitalLoanAccountId", "trenchCategory", "Application_month")


@query(
    "flag_rollup",
    """with f as (select l_orderkey, cast(sum(case when l_returnflag = 'R' and l_linestatus = 'O' then 1 else 0 end) as bigint) as r, cast(sum(case when l_returnflag = 'A' and l_linestatus = 'O' then 1 else 0 end) as bigint) as a,
 cast(sum(case when l_returnflag = 'N' then 1 else 0 end) as bigint) as n from lineitem group by 1) select *, case when r + a = 0 and n > 0 then 1 else 0 end as flag_other_segment_granted from f""",
)
def flag_rollup(spark, sf_dir):
    flag, is_open = F.col("l_returnflag"), F.col("l_linestatus") == "O"
    rows = aggregates.with_one_if(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"),
        r=(flag == "R") & is_open, a=(flag == "A") & is_open, n=flag == "N",
    )
    return aggregates.flag_rollup(rows, "l_orderkey", ["r", "a"], ["n"])


@query(
    "flag_maximum_and_range",
    """select l_orderkey, max(case when l_returnflag = 'R' then 0 else l_linenumber end) as largest_flag, 'MAX_CL-' || max(cast(l_quantity as int)) || '-MIN_CL-' || min(cast(l_quantity as int)) as quantity_range from lineitem group by 1""",
)
def flag_maximum_and_range(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("int").alias("quantity"),
        F.when(F.col("l_returnflag") == "R", "x").otherwise(F.col("l_linenumber").cast("string")).alias("flag"),
    )
    largest = aggregates.max_flag(rows, ["l_orderkey"], "flag", "largest_flag")
    return joins.outer_on([largest, aggregates.range_label(rows, ["l_orderkey"], "quantity", "quantity_range")], ["l_orderkey"])


USER_TYPES = """with l as (select o_custkey c, o_orderkey k, case when o_orderstatus <> 'P' then o_orderdate end s, case when o_orderstatus = 'F' then o_orderdate + interval 5 day end d from orders),
 a as (select *, row_number() over (partition by c order by s nulls first, k) ra from l), b as (select k, row_number() over (partition by c order by d, k) rp from l where d is not null),
 t as (select c, a.k, case when s is null and ra <= 1 then '4_Never_start_loan_appln' when s is not null and rp is null then '3_Applied_Not_Disbursed' when s is not null and rp = 1 then '2_New Applicant'
   when s is not null and rp > 1 then '1_Repeat Applicant' else '5_others' end u from a left join b using (k))"""


def _user_types(spark, sf_dir, per_loan):
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    loans = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.when(status != "P", day).alias("submitted"),
        F.when(status == "F", day + F.expr("interval 5 days")).alias("disbursed"),
    )
    return aggregates.user_types(loans, "o_custkey", "o_orderkey", "submitted", "disbursed", per_loan, ["o_orderkey"])


@query("user_type", USER_TYPES + " select c as o_custkey, min(u) as user_type from t group by 1")
def user_type(spark, sf_dir):
    return _user_types(spark, sf_dir, False)


@query("user_type_per_loan", USER_TYPES + " select c as o_custkey, k as o_orderkey, min(u) as user_type from t group by 1, 2")
def user_type_per_loan(spark, sf_dir):
    return _user_types(spark, sf_dir, True)


@query(
    "version_config",
    f"""with {POPULATION}, m as (select case modelVersionId when 'O' then 'beta_sil' else 'alpha_cash' end modelDisplayName, modelVersionId, trenchCategory t from population)
select distinct modelDisplayName, modelVersionId, trenchCategory, case when modelDisplayName like '%sil%' then 'SIL' when modelDisplayName like '%cash%' then 'CASH' else 'ALL' end as product_category
from (select modelDisplayName, modelVersionId, coalesce(t, 'ALL') trenchCategory from m union all select modelDisplayName, modelVersionId, 'ALL' from m where t is not null)""",
)
def version_config(spark, sf_dir):
    name = F.when(F.col("modelVersionId") == "O", "beta_sil").otherwise("alpha_cash")
    return version_trench_config(population(spark, sf_dir).withColumn("modelDisplayName", name))


@query(
    "stacked_sources",
    """select * from (select c_custkey as id, 'customer' as source, c_mktsegment as segment, cast(null as int) as nation from customer union all select s_suppkey, 'supplier', null, s_nationkey from supplier)""",
)
def stacked_sources(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("customer").alias("source"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation")
    )
    return aggregates.stacked([customers, suppliers])


@query(
    "union_distinct",
    f"with {LINES} select distinct digitalLoanAccountId, modelVersionId from lines where flag = 'R' or line > 3",
)
def union_distinct(spark, sf_dir):
    rows = lines(spark, sf_dir)
    parts = [rows.where(F.col("flag") == "R"), rows.where(F.col("line") > 3)]
    return aggregates.distinct_union([p.select("digitalLoanAccountId", "modelVersionId") for p in parts])


@query("two_raw_sources", "select event_id, user_id, value from events where event_type in ('click', 'view')")
def two_raw_sources(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    one, other = (events.where(F.col("event_type") == t).drop("event_type") for t in ("click", "view"))
    return same_columns_union(one, other)


@query("rows_without", f"with {POPULATION} select digitalLoanAccountId, line, trenchCategory from population where not coalesce(trenchCategory = 'HIGH' and modelVersionId = 'F', false)")
def remaining_rows(spark, sf_dir):
    rows = population(spark, sf_dir)
    condition = (F.col("trenchCategory") == "HIGH") & (F.col("modelVersionId") == "F")
    return rows_without(rows, condition).select("digitalLoanAccountId", "line", "trenchCategory")


DECLARED = StructType(
    [
        StructField("digitalLoanAccountId", StringType()), StructField("score", DoubleType()),
        StructField("line", LongType()), StructField("disbursementdate", DateType()), StructField("remark", StringType()),
    ]
)


@query("declared_schema", f"with {LINES} select cast(digitalLoanAccountId as varchar) as digitalLoanAccountId, score, cast(line as bigint) as line, disbursementdate, cast(null as varchar) as remark from lines")
def declared_schema(spark, sf_dir):
    return with_schema(lines(spark, sf_dir), DECLARED)


@query("sql_scan", "select n_name, count(*) as customers from customer join nation on n_nationkey = c_nationkey group by 1")
def sql_scan(spark, sf_dir):
    statement = "select n_name, count(*) as customers from {customer} join {nation} on n_nationkey = c_nationkey group by n_name"
    return run_query(
        spark, statement, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation")
    )


# --- profiling ---------------------------------------------------------------------------------

PROFILED = ["score", "quantity", "line", "flag", "label"]


def _quality_sql(column: str, numeric: bool, kind: str) -> str:
    text_form = f"cast({column} as varchar)"
    head = f"""select '{column}' as "column", '{kind}' as data_type, count(*) filter (where {column} is null) as missing, {r(f'count(*) filter (where {column} is null) * 100.0 / count(*)')} as missing_pct,
 {r(f'count({column}) * 100.0 / count(*)')} as non_missing_pct, count(distinct {column}) as unique_values,"""
    mode = f"""(select {text_form} from rows0 where {column} is not null group by {column} order by count(*) desc, {column} limit 1) as mode,
 {r(f'(select count(*) from rows0 where {column} is not null group by {column} order by count(*) desc, {column} limit 1) * 100.0 / count(*)')} as mode_pct,"""
    if not numeric:
        nulls = ", ".join(f"cast(null as double) as {c}" for c in ("min", "max", "mean", "median", "std", "q25", "q50", "q75", "iqr", "skewness", "kurtosis", "correlation", "cv_pct"))
        return f"{head} {mode} {nulls} from rows0"
    xs = f"list(cast({column} as double) order by {column}) filter (where {column} is not null)"
    q = {p: quantile_at(xs, p) for p in (0.25, 0.5, 0.75)}
    corr = "cast(null as double)" if column == "label" else r(f"corr(cast({column} as double), label)", 4)
    return f"""{head} {mode} {r(f'cast(min({column}) as double)')} as min, {r(f'cast(max({column}) as double)')} as max, {r(f'avg({column})', 4)} as mean, {r(q[0.5])} as median,
 {r(f'stddev_samp({column})', 4)} as std, {r(q[0.25])} as q25, {r(q[0.5])} as q50, {r(q[0.75])} as q75, {r(f'{q[0.75]} - {q[0.25]}')} as iqr,
 {r(f'skewness({column})', 4)} as skewness, {r(f'kurtosis({column})', 4)} as kurtosis, {corr} as correlation, {r(f'stddev_samp({column}) / avg({column}) * 100', 4)} as cv_pct from rows0"""


@query(
    "data_quality",
    f"""with {LINES}, rows0 as (select case when line = 7 then null else score end score, quantity, line, case when line = 3 then null else flag end flag, label from lines)
 {' union all by name '.join(f'({_quality_sql(c, c != "flag", k)})' for c, k in zip(PROFILED, ("double", "double", "int", "string", "int")))}""",
)
def data_quality(spark, sf_dir):
    rows = lines(spark, sf_dir).select(
        F.when(F.col("line") != 7, F.col("score")).alias("score"), "quantity", "line",
        F.when(F.col("line") != 3, F.col("flag")).alias("flag"), "label",
    )
    report = profiling.data_quality(rows, "label")
    digits = {c: 4 for c in ("mean", "std", "skewness", "kurtosis", "correlation", "cv_pct")}
    plain = ["column", "data_type", "missing", "unique_values", "mode"]
    return report.select(*plain, *[rounded(c, digits.get(c, 6)) for c in report.columns if c not in plain])


@query(
    "quota_sample",
    """select event_id, event_type from events where event_type in ('error', 'signup') union all select event_id, event_type from
 (select event_id, event_type, row_number() over (order by md5('42-' || event_id), event_id) rn from events where event_type = 'view') where rn <= 5000 - (select count(*) from events where event_type in ('error', 'signup'))""",
)
def quota_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return profiling.quota_sample(rows, "event_type", ["error", "signup"], "view", 5000, "event_id")


@query(
    "id_check",
    """with i as (select case when o_orderkey % 9 = 0 then null when o_orderkey % 7 = 0 then 'short' || o_orderkey else 'app-' || lpad(cast(o_orderkey as varchar), 30, '0') end id from orders)
select count(*) filter (where id is null) as nulls, count(distinct id) as unique_ids, count(distinct right(id, 25)) as unique_suffixes, count(*) filter (where length(id) < 25) as shorter_ids, cast(max(length(right(id, 25))) as int) as longest_suffix from i""",
)
def id_check(spark, sf_dir):
    key = F.col("o_orderkey")
    identifier = (
        F.when(key % 9 == 0, None)
        .when(key % 7 == 0, F.concat(F.lit("short"), key.cast("string")))
        .otherwise(F.concat(F.lit("app-"), F.lpad(key.cast("string"), 30, "0")))
    )
    return profiling.id_check(table(spark, sf_dir, "orders").select(identifier.alias("id")), "id")


@query(
    "feature_types",
    f"""with {LINES}, c as (select 'score' f, count(distinct score) d, bool_and(score = floor(score)) w from lines union all select 'quantity', count(distinct quantity), bool_and(quantity = floor(quantity)) from lines
 union all select 'discount', count(distinct discount), bool_and(discount = floor(discount)) from lines union all select 'line', count(distinct line), true from lines union all select 'label', count(distinct label), true from lines)
select f as feature, case when d < 15 and w then 'categorical' else 'numerical' end as few_integers, case when d <= 10 then 'categorical' else 'numerical' end as at_most from c
union all select 'flag', 'categorical', 'categorical'""",
)
def feature_types(spark, sf_dir):
    rows = lines(spark, sf_dir)
    features = ["score", "quantity", "discount", "line", "label", "flag"]
    few, most = (binning.feature_types(rows, features, rule) for rule in ("few_integers", "at_most"))
    return spark.createDataFrame([(f, few[f], most[f]) for f in features], "feature string, few_integers string, at_most string")


@query(
    "feature_types_by_name",
    f"""with {LINES}, c as (select 'score' f, count(distinct score) d, bool_and(score = floor(score)) w from lines union all select 'qty_max', count(distinct quantity), bool_and(quantity = floor(quantity)) from lines
 union all select 'discount_type', count(distinct discount), bool_and(discount = floor(discount)) from lines union all select 'line', count(distinct line), true from lines union all select 'label', count(distinct label), true from lines)
select f as feature, case when d <= 10 and w then 'categorical' else 'numerical' end as at_most_integers,
 case when f = 'discount_type' then 'categorical' when f = 'qty_max' then 'numerical' when d <= 20 then 'categorical' else 'numerical' end as names from c
union all select 'flag', 'categorical', 'categorical'""",
)
def feature_types_by_name(spark, sf_dir):
    """The rules for few whole numbers and for words in the feature's name."""
    rows = lines(spark, sf_dir).withColumnsRenamed({"quantity": "qty_max", "discount": "discount_type"})
    features = ["score", "qty_max", "discount_type", "line", "label", "flag"]
    whole, names = (binning.feature_types(rows, features, rule) for rule in ("at_most_integers", "names"))
    return spark.createDataFrame([(f, whole[f], names[f]) for f in features], "feature string, at_most_integers string, names string")


@query(
    "bin_audit",
    f"""with {LINES}, t as (select quantity x from lines where Data_selection = 'Train'), v as (select list(x order by x) v from t),
 e as (select list_sort(list_distinct({quantile_list('v')})) e from v),
 b as (select x, e, case when x >= e[len(e) - 1] then len(e) - 1 else greatest(len(list_filter(e, lambda y: y <= x)), 1) end bin from t, e)
select cast(bin as int) as bin, case when bin > 1 then {r('max(e[bin])')} end as lower_bound, case when bin < max(len(e)) - 1 then {r('max(e[bin + 1])')} end as upper_bound, count(*) as count,
 {r('count(*) * 100.0 / (select count(*) from t)')} as percentage, {r('min(x)')} as min_in_bin, {r('max(x)')} as max_in_bin, {r('avg(x)')} as mean_in_bin from b group by bin""",
)
def bin_audit(spark, sf_dir):
    rows = lines(spark, sf_dir)
    audit = binning.bin_audit(rows.where(F.col("Data_selection") == "Train"), "quantity")
    def finite(c):
        return F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.round(c, 6)).alias(c)

    return audit.select(
        "bin", finite("lower_bound"), finite("upper_bound"), F.col("count"),
        *[rounded(c) for c in ("percentage", "min_in_bin", "max_in_bin", "mean_in_bin")],
    )
