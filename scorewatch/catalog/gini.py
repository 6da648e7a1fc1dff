"""Rank-ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.catalog.base import LINES, POPULATION, lines, population, quantile_at, r, rounded, table
from scorewatch.catalog.population import RISK, risk_tables
from scorewatch.catalog.registry import registry
from scorewatch.operators.aggregates import account_summary, score_statistics, stacked
from scorewatch.plans import gini
from scorewatch.plans.population import ACCOUNT, with_risk_segments

QUERIES, CHECKS, query = registry()

DIMS = [("Version", "modelVersionId"), ("Trench", "trenchCategory"), ("OSType", "osType")]


def auc_gini(source: str, keys: str, score: str, label: str) -> str:
    """SQL: keys, n, b, g, gini, lo, hi, cumulative gini."""
    return f"""select {keys}, sum(b + g) n, sum(b) b, sum(g) g, min({score}) lo, max({score}) hi,
   case when sum(b) > 0 and sum(g) > 0 then 2.0 * (sum(b * (gb + g / 2.0)) / (cast(sum(b) as double) * cast(sum(g) as double))) - 1.0 end gini,
   case when sum(b + g) >= 2 and sum(b) > 0 then 1.0 - 2.0 * (sum((b + g) * bb + b * (b + g + 1) / 2.0) / (cast(sum(b + g) as double) * cast(sum(b) as double))) end cumu
  from (select {keys}, {score}, b, g, coalesce(sum(g) over w, 0) gb, coalesce(sum(b) over w, 0) bb from
    (select {keys}, {score}, count(*) filter (where {label} = 1) b, count(*) filter (where {label} <> 1) g from {source} group by {keys}, {score})
    window w as (partition by {keys} order by {score} rows between unbounded preceding and 1 preceding)) group by {keys}"""


@query(
    "gini_overall",
    f"""with {LINES}, u as (select 'All' k, score, label from lines union all select modelVersionId, score, label from lines)
select k as segment, cast(n as bigint) as n, cast(b as bigint) as bad, cast(g as bigint) as good, {r('gini')} as gini from ({auc_gini('u', 'k', 'score', 'label')})""",
)
def gini_overall(spark, sf_dir):
    rows = lines(spark, sf_dir)
    each = rows.select("score", "label", F.explode(F.array(F.lit("All"), F.col("modelVersionId"))).alias("segment"))
    return gini.gini_by(each, ["segment"], "score", "label").select("segment", "n", "bad", "good", rounded("gini"))


@query(
    "gini_methods_with_ties",
    f"""with {LINES}, u as (select Application_month k, case when Application_month < '1998' then discount else quantity end x, label from lines),
 s as ({auc_gini('u', 'k', 'x', 'label')})
select k as month, 'auc' as method, {r('gini')} as gini from s union all select k, 'cumulative', {r('cumu')} from s
union all select k, 'trapezoid', {r('coalesce(-gini, 0)')} from s union all select k, 'hybrid', {r('case when lo >= 0 and hi <= 1 then gini else -gini end')} from s""",
)
def gini_methods_with_ties(spark, sf_dir):
    rows = lines(spark, sf_dir).select(
        F.col("Application_month").alias("month"), "label",
        F.when(F.col("Application_month") < "1998", F.col("discount")).otherwise(F.col("quantity")).alias("x"),
    )
    counts = gini.collapse(gini.scored_outcomes(rows, "x", "label"), ["month"], "x", "label")
    return stacked(
        [
            gini.gini_of_counts(counts, ["month"], "x", m).select("month", F.lit(m).alias("method"), rounded("gini"))
            for m in gini.METHODS
        ]
    )


@query(
    "gini_by_language",
    f"""with u as (select lang, n_chars, quality from documents join labels using (doc_id) where quality is not null and n_chars is not null)
select lang, cast(n as bigint) as n, {r('gini')} as gini from ({auc_gini('u', 'lang', 'n_chars', 'quality')})""",
)
def gini_by_language(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "inner")
    return gini.gini_by(rows, ["lang"], "n_chars", "quality").select("lang", "n", rounded("gini"))


PERIODS = """pr as (select 'Week' period, cast(date_trunc('week', disbursementdate) as date) start_date, * from {source}
  union all select 'Month', cast(date_trunc('month', disbursementdate) as date), * from {source})"""
END = "case period when 'Week' then start_date + 6 else last_day(start_date) end"
LEAST = "case period when 'Week' then 10 else 20 end"


@query(
    "gini_periodic",
    f"""with {LINES}, {PERIODS.format(source='lines')}, s as ({auc_gini('pr', 'period, start_date', 'score', 'label')}),
 q as ({auc_gini('pr', 'period, start_date', 'discount', 'label')})
select start_date, cast({END} as date) as end_date, period, case when n >= {LEAST} then {r('gini')} end as gini, 'score' as Model_Name, '1.1.0' as version, 'FPD10' as bad_rate from s
union all select start_date, cast({END} as date), period, {r('coalesce(-gini, 0)')}, 'trapezoid', '1.1.0', 'FPD10' from s
union all select start_date, cast({END} as date), period, case when n >= {LEAST} then {r('gini')} end, 'discount', '1.1.0', 'FPD10' from q""",
)
def gini_periodic(spark, sf_dir):
    rows = lines(spark, sf_dir)
    results = [
        gini.periodic_gini(rows, "score", "label", "FPD10"),
        gini.periodic_gini(rows, "score", "label", "FPD10", method="trapezoid").withColumn("Model_Name", F.lit("trapezoid")),
        gini.periodic_gini(rows, "discount", "label", "FPD10", method="hybrid"),
    ]
    columns = ["start_date", "end_date", "period", rounded("gini"), "Model_Name", "version", "bad_rate"]
    return stacked([x.select(*columns) for x in results])


def _cube_sql(dims=DIMS, source=POPULATION, name="population", least=LEAST) -> str:
    from itertools import combinations

    columns = [c for _, c in dims]
    names, first = ", ".join(columns), ", ".join(f"s.{c}" for c in columns)
    order = ", ".join(f"{c} nulls first" for c in columns)
    parts = []
    for depth in range(len(dims) + 1):
        for number, chosen in enumerate(combinations(dims, depth)):
            active = [c for _, c in chosen]
            shown = ", ".join(c if c in active else f"cast(null as varchar) {c}" for c in columns)
            known = " and ".join(f"{c} is not null" for c in active) or "true"
            label = " || '_' || ".join(f"'{n}_' || {c}" for n, c in chosen) or "'Overall'"
            parts.append(
                f"select {depth} dp, {number} nr, {label} segment_type, {shown}, score, label, disbursementdate, digitalLoanAccountId acct from {name} where {known}"
            )
    keys = f"dp, nr, segment_type, {names}"
    grouped = f"{keys}, period, start_date"
    return f"""{source}, cu as ({' union all '.join(parts)}), {PERIODS.format(source='cu')},
 s as ({auc_gini('pr', grouped, 'score', 'label')}),
 ac as (select dp, nr, segment_type, period, start_date, count(distinct acct) da, count(distinct acct) filter (where label = 1) ba from pr group by all),
 di as (select {keys}, row_number() over (order by dp, nr, {order}) - 1 segment_id from (select distinct {keys} from s)),
 fa as (select segment_id, start_date, cast({END} as date) end_date, period, case when n >= {least} then {r('gini')} end gini_value, da distinct_accounts, ba bad_count,
   'score' Model_Name, 'FPD10' bad_rate, segment_type, {first}
   from s join ac using (dp, nr, segment_type, period, start_date) join di using (dp, nr, segment_type))"""


CUBE = _cube_sql()


def _cube(spark, sf_dir, **options):
    return gini.gini_cube(population(spark, sf_dir), "score", "label", "FPD10", DIMS, **options)


RISK_DIMS = [("risk_segment", "risk_segment"), ("risk_segment_final", "risk_segment_final"), ("Trench", "trenchCategory")]
RISK_SOURCE = f"""{POPULATION}, {RISK}, segmented_population as (
  select p.*, coalesce(s.risk_segment, 'NA') as risk_segment, coalesce(f.risk_segment_final, 'NA') as risk_segment_final
  from population p left join segmented s on s.account = digitalLoanAccountId left join finals f on f.account = digitalLoanAccountId)"""


@query(
    "gini_cube_risk_segments",
    f"with {_cube_sql(RISK_DIMS, RISK_SOURCE, 'segmented_population', '0')} select * exclude (segment_id) from fa",
)
def gini_cube_risk_segments(spark, sf_dir):
    """Every combination of both risk segments and the trench, no group left out for its size."""
    rows = with_risk_segments(population(spark, sf_dir), *risk_tables(spark, sf_dir), table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", ACCOUNT))
    fact, _ = gini.gini_cube(rows, "score", "label", "FPD10", RISK_DIMS, min_week=0, min_month=0)
    return fact.withColumn("gini_value", rounded("gini_value")).drop("segment_id")


@query("gini_cube_fact", f"with {CUBE} select * from fa")
def gini_cube_fact(spark, sf_dir):
    fact, _ = _cube(spark, sf_dir)
    return fact.withColumn("gini_value", rounded("gini_value"))


@query(
    "gini_cube_dimension",
    f"with {CUBE} select segment_id, 'score' as Model_Name, 'FPD10' as bad_rate, segment_type, modelVersionId, trenchCategory, osType from di",
)
def gini_cube_dimension(spark, sf_dir):
    _, dimension = _cube(spark, sf_dir)
    return dimension


@query(
    "gini_cube_published",
    f"""with {CUBE}, kept as (select * from fa where gini_value is not null),
 ids as (select segment_type, row_number() over (order by min(segment_id)) - 1 id from kept group by segment_type)
select id as segment_id, * exclude (segment_id, id, modelVersionId, trenchCategory, osType), 'cash_beta' as Model_display_name, 'CASH' as Product_Category,
 coalesce(modelVersionId, 'Overall') as modelVersionId, coalesce(trenchCategory, 'Overall') as trenchCategory, coalesce(osType, 'Overall') as osType
from kept join ids using (segment_type)""",
)
def gini_cube_published(spark, sf_dir):
    tables = _cube(spark, sf_dir, drop_small=True)
    fact, _ = gini.published(tables, "cash_beta", "CASH", [c for _, c in DIMS])
    return fact.withColumn("gini_value", rounded("gini_value"))


WIDE_COLUMNS = ["Overall", "Trench_HIGH", "Trench_LOW", "Trench_MEDIUM", "Trench_URGENT"]


@query(
    "gini_wide",
    f"""with {POPULATION}, cu as (select 'Overall' segment_type, score, label, disbursementdate from population
   union all select 'Trench_' || trenchCategory, score, label, disbursementdate from population where trenchCategory is not null), {PERIODS.format(source='cu')},
 s as ({auc_gini('pr', 'segment_type, period, start_date', 'score', 'label')})
select start_date, cast({END} as date) as end_date, period, {', '.join(f"max(case when n >= {LEAST} then {r('gini')} end) filter (where segment_type = '{c}') as {c}" for c in WIDE_COLUMNS)}
from s group by period, start_date""",
)
def gini_wide(spark, sf_dir):
    rows = population(spark, sf_dir)
    fact, _ = gini.gini_cube(rows, "score", "label", "FPD10", [("Trench", "trenchCategory")], account=None)
    wide = gini.wide_gini(fact)
    return wide.select("start_date", "end_date", "period", *[rounded(c) for c in wide.columns[3:]])


NAMED = [("Early", "1995-01-01", "1996-12-31"), ("Middle", "1996-06-01", "1998-12-31"), ("Late", "1999-01-01", "2001-12-31"), ("None", "2010-01-01", "2010-12-31")]
NAMED_SQL = "np as (select * from (values " + ", ".join(f"('{n}', date '{s}', date '{e}')" for n, s, e in NAMED) + ") t(Period, Start_Date, End_Date))"


@query(
    "gini_named_periods",
    f"""with {LINES}, {NAMED_SQL}, u as (select Period, score, label from lines join np on disbursementdate between Start_Date and End_Date), s as ({auc_gini('u', 'Period', 'score', 'label')})
select np.*, {r('gini', 4)} as score_gini, cast(coalesce(n, 0) as bigint) as sample_size from np left join s using (Period)""",
)
def gini_named_periods(spark, sf_dir):
    result = gini.named_period_gini(lines(spark, sf_dir), "disbursementdate", "label", ["score"], NAMED, digits=4)
    return result.select("Period", "Start_Date", "End_Date", rounded("score_gini", 4), "sample_size")


@query(
    "gini_reversed_pair",
    f"""with {LINES}, {NAMED_SQL}, u as (select Period, score, -quantity quantity, label from lines join np on disbursementdate between Start_Date and End_Date
   where score is not null and quantity is not null), s as ({auc_gini('u', 'Period', 'score', 'label')}), q as ({auc_gini('u', 'Period', 'quantity', 'label')})
select np.*, {r('s.gini')} as score_gini, {r('q.gini')} as quantity_gini, cast(coalesce(s.n, 0) as bigint) as sample_size from np left join s using (Period) left join q using (Period)""",
)
def gini_reversed_pair(spark, sf_dir):
    result = gini.named_period_gini(
        lines(spark, sf_dir), "disbursementdate", "label", ["score", "quantity"], NAMED, reverse=["quantity"]
    )
    return result.select("Period", "Start_Date", "End_Date", rounded("score_gini"), rounded("quantity_gini"), "sample_size")


SCALED = """sp as (select min(score) sl, max(score) sh, min(quantity) ql, max(quantity) qh, min(tax) tl, max(tax) th from lines),
 sc as (select label, (score - sl) / (sh - sl) a, (quantity - ql) / (qh - ql) b, (tax - tl) / (th - tl) c, score, quantity, tax from lines, sp)"""


def _one(score: str) -> str:
    return f"(select gini from ({auc_gini('(select 1 as k, * from sc)', 'k', score, 'label')}))"


@query(
    "gini_combined",
    f"""with {LINES}, {SCALED},
 ww as (select greatest({_one('score')}, 0) + 1 x, greatest({_one('quantity')}, 0) + 1 y, greatest({_one('tax')}, 0) + 1 z),
 lo as (select label, 'mean' method, (0.0 + a + b + c) / 3 v from sc union all select label, 'median', list_sort([a, b, c])[2] from sc union all select label, 'max', greatest(a, b, c) from sc
   union all select label, 'min', least(a, b, c) from sc
   union all select label, 'weighted', cast(0 as double) + a * (x / (cast(0 as double) + x + y + z)) + b * (y / (cast(0 as double) + x + y + z)) + c * (z / (cast(0 as double) + x + y + z)) from sc, ww)
select method, {r('gini', 5)} as gini from ({auc_gini('lo', 'method', 'v', 'label')})""",
)
def gini_combined(spark, sf_dir):
    result = gini.combined_gini(lines(spark, sf_dir), ["score", "quantity", "tax"], "label")
    return result.select("method", rounded("gini", 5))


SUMMARY_SQL = f"""with {LINES}, sg as (select 'modelVersionId' gc, modelVersionId gv, score, quantity, label, 1 mat from lines
   union all select 'Application_month', Application_month, score, quantity, label, 1 from lines),
 sp as (select gc, gv, min(score) sl, max(score) sh, min(quantity) ql, max(quantity) qh, count(*) n, sum(label / cast(mat as double)) cb from sg group by gc, gv having count(distinct label) > 1),
 cm as (select gc, gv, label, (0.0 + case when sh > sl then (score - sl) / (sh - sl) else 0 end + case when qh > ql then (quantity - ql) / (qh - ql) else 0 end) / 2 v from sg join sp using (gc, gv)),
 g1 as ({auc_gini('sg', 'gc, gv', 'score', 'label')}), g2 as ({auc_gini('sg', 'gc, gv', 'quantity', 'label')}), g3 as ({auc_gini('cm', 'gc, gv', 'v', 'label')})"""


@query(
    "gini_summary",
    f"""{SUMMARY_SQL} select gc as Segment_Column, gv as Segment_Value, sp.n as Sample_Size, {r('g1.gini')} as score_Gini, {r('(g1.gini + 1) / 2')} as score_AUC,
 {r('g2.gini')} as quantity_Gini, {r('(g2.gini + 1) / 2')} as quantity_AUC, {r('g3.gini', 5)} as Combined_Gini, {r('cb')} as Count_Bad, {r('cb / sp.n * 100')} as Pct_Bad
from sp join g1 using (gc, gv) join g2 using (gc, gv) join g3 using (gc, gv)""",
)
def gini_summary(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("mature", F.lit(1))
    result = gini.gini_summary(rows, ["score", "quantity"], ["modelVersionId", "Application_month"], "label", "mature")
    numbers = ["score_Gini", "score_AUC", "quantity_Gini", "quantity_AUC", "Count_Bad", "Pct_Bad"]
    return result.select(
        "Segment_Column", "Segment_Value", "Sample_Size", *[rounded(c) for c in numbers], rounded("Combined_Gini", 5)
    )


@query(
    "bad_metrics",
    f"""with {LINES}, m as (select *, case when line <= 5 then 1 else 0 end mat from lines)
select Application_month, {r('sum(case when mat = 1 then label else null end)')} as count_bad, {r('sum(case when mat = 1 then label else null end) / count(*) * 100')} as pct_bad from m group by 1""",
)
def bad_metrics(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("mature", F.when(F.col("line") <= 5, 1).otherwise(0))
    result = gini.bad_metrics(rows, ["Application_month"], "label", "mature")
    return result.select("Application_month", rounded("count_bad"), rounded("pct_bad"))


@query(
    "account_summary",
    f"""with {LINES} select modelVersionId, Application_month, count(distinct digitalLoanAccountId) as distinct_accounts,
 count(distinct digitalLoanAccountId) filter (where label = 1) as bad_accounts from lines group by 1, 2""",
)
def accounts(spark, sf_dir):
    result = account_summary(lines(spark, sf_dir), ["modelVersionId", "Application_month"], "digitalLoanAccountId", "label")
    return result


# --- deciles, ROC, dashboard ---------------------------------------------------------------------


def decile_sql(source: str, keys: str, account: str = "digitalLoanAccountId") -> str:
    return f"""select {keys}, cast(decile as int) as decile, {r('min(score)')} as score_min, {r('max(score)')} as score_max, {r('avg(score) + 1e-7', 4)} as score_avg,
   count(*) as records_in_decile, cast(sum(label) as bigint) as bads_in_decile, cast(count(*) - sum(label) as bigint) as goods_in_decile
  from (select *, 11 - case when nn = 1 then 1 else greatest(ceil((rn - 1) * cast(10 as double) / (nn - 1)), 1) end decile from
    (select *, row_number() over (partition by {keys} order by score, {account}, label) rn, count(*) over (partition by {keys}) nn from {source})) group by {keys}, decile"""


def gains_sql(deciles: str, keys: str) -> str:
    out = [f"select {keys}, decile, score_min, score_max, score_avg, records_in_decile, bads_in_decile, goods_in_decile"]
    for w in ("records", "bads", "goods"):
        out.append(f"cast(sum({w}_in_decile) over g as bigint) as total_{w}")
        out.append(f"cast(sum({w}_in_decile) over u as bigint) as cum_{w}")
        out.append(f"{r(f'case when sum({w}_in_decile) over g = 0 then 0 else {w}_in_decile * 100.0 / sum({w}_in_decile) over g end')} as pct_{w}")
        out.append(f"{r(f'case when sum({w}_in_decile) over g = 0 then 0 else sum({w}_in_decile) over u * 100.0 / sum({w}_in_decile) over g end')} as cum_pct_{w}")
    out.append(f"{r('bads_in_decile * 100.0 / records_in_decile')} as bad_rate_decile")
    return ", ".join(out) + f" from ({deciles}) window g as (partition by {keys}), u as (partition by {keys} order by decile rows between unbounded preceding and current row)"


def _gain_output(df, keys):
    exact = ["records_in_decile", "bads_in_decile", "goods_in_decile"] + [f"{p}_{w}" for p in ("total", "cum") for w in ("records", "bads", "goods")]
    ratios = [f"{p}_{w}" for p in ("pct", "cum_pct") for w in ("records", "bads", "goods")] + ["bad_rate_decile", "score_min", "score_max"]
    # Means of cents often end exactly between two roundings; both sides shift them alike.
    mean = F.round(F.col("score_avg") + F.lit(1e-7), 4).alias("score_avg")
    return df.select(*keys, "decile", *exact, *[rounded(c) for c in ratios], mean)


@query("decile_gain", f"with {LINES} {gains_sql(decile_sql('lines', 'Application_month'), 'Application_month')}")
def decile_gain(spark, sf_dir):
    return _gain_output(gini.decile_gains(lines(spark, sf_dir), ["Application_month"], "score", "label"), ["Application_month"])


@query(
    "roc_points",
    f"""with {LINES}, c as (select modelVersionId k, quantity q, count(*) filter (where label = 1) b, count(*) filter (where label = 0) g from lines group by 1, 2)
select k as modelVersionId, q as threshold, {r('sum(g) over w / cast(sum(g) over p as double)')} as fpr, {r('sum(b) over w / cast(sum(b) over p as double)')} as tpr
from c window w as (partition by k order by q desc rows between unbounded preceding and current row), p as (partition by k)""",
)
def roc_points(spark, sf_dir):
    result = gini.roc_points(lines(spark, sf_dir), ["modelVersionId"], "quantity", "label")
    return result.select("modelVersionId", "threshold", rounded("fpr"), rounded("tpr"))


KNOWN = ("HIGH", "LOW", "MEDIUM")
DASHBOARD = POPULATION + """, dash as (select 'cash_beta' modelDisplayName, population.*, p_type loan_product_type from population join part on p_partkey = partkey where trenchCategory is not null),
 seg as (select 'Trench_Level' segment_type, modelDisplayName, modelVersionId, trenchCategory, 'All' new_loan_type, 'All' loan_product_type, score, label, disbursementdate, digitalLoanAccountId from dash
  union all select 'Model_Level', modelDisplayName, modelVersionId, 'All', 'All', 'All', score, label, disbursementdate, digitalLoanAccountId from dash where trenchCategory in ('HIGH', 'LOW', 'MEDIUM')
  union all select 'Loan_Type_Level', modelDisplayName, modelVersionId, trenchCategory, new_loan_type, 'All', score, label, disbursementdate, digitalLoanAccountId from dash
  union all select 'Product_Type_Level', modelDisplayName, modelVersionId, trenchCategory, 'All', loan_product_type, score, label, disbursementdate, digitalLoanAccountId from dash
  union all select 'Full_Level', modelDisplayName, modelVersionId, trenchCategory, new_loan_type, loan_product_type, score, label, disbursementdate, digitalLoanAccountId from dash),
 tm as (select 'Overall' time_type, 'Overall' time_period, * from seg union all select 'Month', strftime(disbursementdate, '%Y-%m'), * from seg
  union all select 'Week', cast(cast(date_trunc('week', disbursementdate) as date) as varchar), * from seg)"""
DASH_KEYS = "segment_type, modelDisplayName, modelVersionId, trenchCategory, new_loan_type, loan_product_type"


def dashboard_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_type").alias("loan_product_type"))
    return (
        population(spark, sf_dir).where(F.col("trenchCategory").isNotNull())
        .join(part, "partkey", "inner").withColumn("modelDisplayName", F.lit("cash_beta"))
    )


@query(
    "gini_dashboard",
    f"""with {DASHBOARD}, s as ({auc_gini('tm', DASH_KEYS + ', time_type, time_period', 'score', 'label')})
select {DASH_KEYS}, time_type, time_period, {r('(gini + 1) / 2')} as auc, {r('gini')} as gini, cast(n as bigint) as record_count, cast(b as bigint) as bad_count,
 cast(g as bigint) as good_count, {r('b * 100.0 / n')} as bad_rate_pct from s""",
)
def gini_dashboard(spark, sf_dir):
    result = gini.dashboard_metrics(dashboard_rows(spark, sf_dir), "score", "label", known_trenches=KNOWN)
    return result.withColumns({c: rounded(c) for c in ("auc", "gini", "bad_rate_pct")})


@query(
    "gini_dashboard_segments",
    f"""with {DASHBOARD} select *, row_number() over (order by {DASH_KEYS}) as segment_id from
 (select distinct {DASH_KEYS}, modelDisplayName || '_' || modelVersionId || '_' || trenchCategory || case when new_loan_type <> 'All' then '_' || new_loan_type else '' end
   || case when loan_product_type <> 'All' then '_' || loan_product_type else '' end as segment_name from seg)""",
)
def gini_dashboard_segments(spark, sf_dir):
    metrics = gini.dashboard_metrics(dashboard_rows(spark, sf_dir), "score", "label", known_trenches=KNOWN)
    return gini.dashboard_segments(metrics)


@query("dashboard_deciles", f"with {DASHBOARD} {gains_sql(decile_sql('tm', DASH_KEYS + ', time_type, time_period'), DASH_KEYS + ', time_type, time_period')}")
def dashboard_deciles(spark, sf_dir):
    rows = dashboard_rows(spark, sf_dir)
    keys = [*DASH_KEYS.split(", "), "time_type", "time_period"]
    return _gain_output(gini.dashboard_deciles(rows, "score", "label", known_trenches=KNOWN), keys)


def _statistics(column: str) -> str:
    return f"""select '{column}' as score_name, {r(f'min({column})')} as min, {r(f'max({column})')} as max, {r(f'avg({column})', 4)} as mean,
 {r(quantile_at(f'list({column} order by {column})', 0.5))} as median, {r(f'stddev_samp({column})', 4)} as std, {r(quantile_at(f'list({column} order by {column})', 0.25))} as q1,
 {r(quantile_at(f'list({column} order by {column})', 0.75))} as q3, {r(f'skewness({column})', 4)} as skewness, {r(f'kurtosis({column})', 4)} as kurtosis from lines"""


@query("score_statistics", f"with {LINES} {_statistics('score')} union all {_statistics('quantity')}")
def statistics(spark, sf_dir):
    result = score_statistics(lines(spark, sf_dir), ["score", "quantity"])
    digits = {"mean": 4, "std": 4, "skewness": 4, "kurtosis": 4}
    return result.select("score_name", *[rounded(c, digits.get(c, 6)) for c in result.columns[1:]])
