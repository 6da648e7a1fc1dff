"""Score and feature stability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.catalog.base import (
    LINES,
    POPULATION,
    SEGMENTS,
    left_bin,
    lines,
    population,
    quantile_list,
    r,
    right_bin,
    rounded,
    table,
)
from scorewatch.catalog.feature_sql import bin_rows, equal_width, feature_shares, psi_rows, term
from scorewatch.catalog.registry import registry
from scorewatch.functions.dates import week_start
from scorewatch.functions.stability import POLICIES
from scorewatch.operators.aggregates import stacked
from scorewatch.plans import psi, reports

QUERIES, CHECKS, query = registry()

NUMERIC = ["score", "quantity", "discount"]
CATEGORICAL = ["line", "flag"]
FEATURES = NUMERIC + CATEGORICAL
PSI_COLUMNS = [
    "Feature", "Feature_Type", "Segment_Column", "Segment_Value", "Month", "Current_Month", "Base_Month",
    "Base_Count", "Actual_Count",
]


def psi_output(df, *keys):
    return df.select(
        *PSI_COLUMNS, *keys, rounded("Expected_Percentage"), rounded("Actual_Percentage"), rounded("PSI")
    )


def finite(column: str):
    value = F.when(F.abs(F.col(column)) < F.lit(float("inf")), F.round(F.col(column), 6) + F.lit(0.0))
    return value.alias(column)


def bin_output(df, *keys):
    return df.select(
        *PSI_COLUMNS, *keys, "Bin", finite("Bin_Min"), finite("Bin_Max"), rounded("Base_Percentage"),
        rounded("Actual_Percentage"), rounded("Bin_PSI"),
    )


# --- score PSI -------------------------------------------------------------------------------

# Train deciles of the score and the shares per test month.
SCORE_SHARES = f"""{LINES}, v as (select list(score order by score) v from lines where Data_selection = 'Train'),
 e as (select list_sort(list_distinct({quantile_list('v')})) e from v),
 binned as (select lines.*, {right_bin('score', 'e.e')} as bin from lines, e),
 tr as (select bin, count(*) n, sum(count(*)) over () t from binned where Data_selection = 'Train' group by bin),
 te as (select Application_month as m, bin, count(*) n, sum(count(*)) over (partition by Application_month) t
        from binned where Data_selection = 'Test' group by 1, 2),
 months as (select m, max(t) t from te group by m),
 grid as (select m, bins.bin from months, (select distinct bin from tr union select distinct bin from te) bins where bins.bin is not null),
 sh as (select g.m, g.bin, tr.n / cast((select max(t) from tr) as double) es, te.n / cast(months.t as double) as sa
        from grid g join months on months.m = g.m left join tr on tr.bin = g.bin left join te on te.bin = g.bin and te.m = g.m)"""


@query(
    "psi_monthly_overall",
    f"""with {SCORE_SHARES},
 ad as (select m, bin, case when coalesce(es, 0) = 0 then 1e-4 else es end e0, case when coalesce(sa, 0) = 0 then 1e-4 else sa end a0 from sh),
 nm as (select m, e0 / sum(e0) over (partition by m) e, a0 / sum(a0) over (partition by m) a from ad),
 acc as (select Application_month m, count(distinct digitalLoanAccountId) c from lines where Data_selection = 'Test' group by 1)
select nm.m as Month, 'score' as scorename, 'Monthly' as DateCategory,
  {r('sum(' + term('e', 'a') + ')')} as psivalues, max(acc.c) as account_count
from nm join acc on acc.m = nm.m group by nm.m
union all
select (select max(Application_month) from lines where Data_selection = 'Train'), 'score', 'Training', 0.0,
  (select count(distinct digitalLoanAccountId) from lines where Data_selection = 'Train')""",
)
def psi_monthly_overall(spark, sf_dir):
    rows = psi.monthly_score_psi(lines(spark, sf_dir), "score", policy="zero_1e-4_renormalised")
    return rows.select("Month", "scorename", "DateCategory", rounded("psivalues"), "account_count")


def _policy_sql() -> str:
    """Every zero policy on the same shares."""
    parts = []
    for name, p in POLICIES.items():
        def side(share: str) -> str:
            value = share if p.zero is None else f"case when {share} = 0 then {p.zero!r} else {share} end"
            value = f"coalesce({value}, {p.absent!r})"
            if p.floor is not None:
                value = f"greatest({value}, {p.floor!r})"
            return f"{value} + {p.add!r}"
        e, a = side("es"), side("sa")
        if p.renormalise:
            e, a = f"({e}) / sum({e}) over (partition by m)", f"({a}) / sum({a}) over (partition by m)"
        empty = "0.0" if p.on_zero == "nothing" else "cast('infinity' as double)"
        part = f"case when e > 0 and a > 0 then {term('e', 'a')} when e > 0 or a > 0 then {empty} end"
        parts.append(
            f"select '{name}' as policy, m as Month, case when not isinf(sum(t)) then {r('sum(t)')} end as psivalues "
            f"from (select m, {part} t from (select m, {e} e, {a} a from sh)) group by m"
        )
    return " union all ".join(parts)


@query("psi_zero_policies", f"with {SCORE_SHARES} {_policy_sql()}")
def psi_zero_policies(spark, sf_dir):
    rows = lines(spark, sf_dir)
    each = [
        psi.monthly_score_psi(rows, "score", policy=name)
        .where(F.col("DateCategory") == "Monthly")
        .select(F.lit(name).alias("policy"), "Month", finite("psivalues"))
        for name in POLICIES
    ]
    return stacked(each)


WATERFALL = ["trenchCategory", "new_loan_type", "osType"]


def _waterfall_levels() -> str:
    parts = []
    for depth in range(1, len(WATERFALL) + 1):
        columns = ", ".join(
            f"{c} as s{i}" if i < depth else f"'NA' as s{i}" for i, c in enumerate(WATERFALL)
        )
        known = " and ".join(f"{c} is not null" for c in WATERFALL[:depth])
        parts.append(
            f"select {depth} d, {columns}, Application_month m, Data_selection ds, score, digitalLoanAccountId acct from population where {known}"
        )
    return " union all ".join(parts)


G = "d, s0, s1, s2"


@query(
    "psi_waterfall",
    f"""with {POPULATION}, lv as ({_waterfall_levels()}),
 v as (select {G}, list(score order by score) v from lv where ds = 'Train' group by {G}),
 e as (select {G}, list_sort(list_distinct({quantile_list('v')})) e from v),
 b as (select lv.*, {right_bin('score', 'e')} bin from lv join e using ({G})),
 tr as (select {G}, bin, count(*) n from b where ds = 'Train' group by {G}, bin),
 tt as (select {G}, count(*) t from b where ds = 'Train' group by {G}),
 te as (select {G}, m, bin, count(*) n from b where ds = 'Test' group by {G}, m, bin),
 et as (select {G}, m, count(*) t from b where ds = 'Test' group by {G}, m),
 bins as (select distinct bin from b where bin is not null),
 g as (select {G}, m, et.t am, tt.t et, bin from et join tt using ({G}), bins),
 sh as (select {G}, m, coalesce(tr.n / cast(et as double), 1e-10) e, coalesce(te.n / cast(am as double), 1e-10) a
   from g left join tr using ({G}, bin) left join te using ({G}, m, bin)),
 ps as (select {G}, m, sum({term('e', 'a')}) p from sh group by {G}, m),
 ac as (select {G}, m, count(distinct acct) c from lv where ds = 'Test' group by {G}, m),
 am as (select {G}, count(distinct acct) c from lv where ds = 'Train' group by {G})
select m as Month, 'Monthly' as DateCategory, {r('p')} as psivalues, c as account_count, s0 as trenchCategory,
  s1 as new_loan_type, s2 as osType, 'score' as scorename from ps join ac using ({G}, m)
union all
select (select max(Application_month) from population where Data_selection = 'Train'), 'Training', 0.0, c, s0, s1, s2, 'score'
from am semi join et using ({G})""",
)
def psi_waterfall(spark, sf_dir):
    rows = psi.waterfall_score_psi(population(spark, sf_dir), "score", WATERFALL)
    return rows.select("Month", "DateCategory", rounded("psivalues"), "account_count", *WATERFALL, "scorename")


# --- feature PSI -----------------------------------------------------------------------------

FEATURE_SQL = feature_shares("population", NUMERIC, CATEGORICAL, SEGMENTS)


@query("psi_features_segments", f"with {POPULATION}, {FEATURE_SQL}{psi_rows()}")
def psi_features_segments(spark, sf_dir):
    return psi_output(psi.feature_psi(population(spark, sf_dir), FEATURES, SEGMENTS))


@query("psi_bin_level", f"with {POPULATION}, {FEATURE_SQL}{bin_rows()}")
def psi_bin_level(spark, sf_dir):
    return bin_output(psi.feature_bin_psi(population(spark, sf_dir), FEATURES, SEGMENTS))


VERSION_SQL = feature_shares("lines", ["score", "quantity"], ["flag"], ["line"], ["modelVersionId"])
CATEGORY = ", case when f = 'score' then 'Score' else 'Expanded_Feature' end as Feature_Category"


@query("psi_by_version", f"with {LINES}, {VERSION_SQL}{psi_rows(['modelVersionId'], extra=CATEGORY)}")
def psi_by_version(spark, sf_dir):
    result = psi.psi_by_version(lines(spark, sf_dir), "score", ["quantity", "flag"], ["line"])
    return psi_output(result, "modelVersionId", "Feature_Category")


@query("psi_by_version_bins", f"with {LINES}, {VERSION_SQL}{bin_rows(['modelVersionId'], extra=CATEGORY)}")
def psi_by_version_bins(spark, sf_dir):
    result = psi.psi_by_version(lines(spark, sf_dir), "score", ["quantity", "flag"], ["line"], by_bin=True)
    return bin_output(result, "modelVersionId", "Feature_Category")


CONFIG_KEYS = ["modelDisplayName", "modelVersionId", "config_trench"]
CONFIGURED = """configured as (
  select population.*, 'cash_model' as modelDisplayName, unnest(list_distinct([coalesce(trenchCategory, 'ALL'), 'ALL'])) as config_trench
  from population)"""
SHIFT = ", case when psi < 0.1 then 'Very Stable' when psi < 0.2 then 'Stable' when psi < 0.5 then 'Moderate Shift' else 'Significant Shift' end as PSI_Interpretation"


@query(
    "psi_config_all",
    f"""with {POPULATION}, {CONFIGURED},
 {feature_shares('configured', ['score', 'quantity'], ['line', 'flag'], ['new_loan_type', 'trenchCategory'], CONFIG_KEYS, 'deciles', 10)}
 {psi_rows(CONFIG_KEYS, 'max', SHIFT, '1e-10')}""",
)
def psi_config_all(spark, sf_dir):
    rows = population(spark, sf_dir).withColumn("modelDisplayName", F.lit("cash_model"))
    result = psi.psi_by_config(rows, ["score", "quantity", "line", "flag"], ["new_loan_type", "trenchCategory"])
    return psi_output(result, *CONFIG_KEYS, "PSI_Interpretation")


@query(
    "psi_within_definition",
    f"""with {POPULATION},
 {feature_shares('population', ['score'], ['flag'], within="coalesce(trenchCategory in ('HIGH', 'LOW') and new_loan_type = 'MACHINERY', false)")},
 res as (select * from ({'with dummy as (select 1)' + psi_rows()}))
select * exclude (Segment_Column, Segment_Value) from res""",
)
def psi_within_definition(spark, sf_dir):
    definition = {"trenchCategory": ["HIGH", "LOW"], "new_loan_type": "MACHINERY"}
    result = psi.psi_within(population(spark, sf_dir), ["score", "flag"], definition)
    return result.select(
        *[c for c in PSI_COLUMNS if not c.startswith("Segment")],
        rounded("Expected_Percentage"), rounded("Actual_Percentage"), rounded("PSI"),
    )


# Trench subsets per version: every non-empty subset of the five known trenches.
SUBSETS = """members as (select modelVersionId, list_sort(list_distinct(list(trenchCategory))) l from population where trenchCategory is not null group by 1),
 masks as (select modelVersionId, l, unnest(range(1, cast(pow(2, len(l)) as bigint))) mk from members),
 subsets as (select modelVersionId, list_filter(l, lambda x, i: (mk >> (i - 1)) & 1 = 1) parts from masks),
 spread as (select p.* exclude (trenchCategory), array_to_string(parts, ',') trenchCategory_set
   from population p join subsets on subsets.modelVersionId = p.modelVersionId and list_contains(parts, p.trenchCategory))"""


@query(
    "psi_trench_subsets",
    f"""with {POPULATION}, {SUBSETS},
 {feature_shares('spread', ['score'], ['flag'], ['new_loan_type', 'osType'], ['modelVersionId', 'trenchCategory_set'])
  .replace("es using (f, modelVersionId, trenchCategory_set)", "es using (f)")
  .replace("ct using (f, modelVersionId, trenchCategory_set)", "ct using (f)")
  .replace("vv as (select f, modelVersionId, trenchCategory_set, list(num order by num) v from lg where tr and num is not null group by f, modelVersionId, trenchCategory_set)",
           "vv as (select 'score' f, list(score order by score) v from population where Data_selection = 'Train')")
  .replace("qq as (select f, modelVersionId, trenchCategory_set,", "qq as (select f,")
  .replace("uu as (select f, modelVersionId, trenchCategory_set,", "uu as (select f,")
  .replace("ch as (select f, modelVersionId, trenchCategory_set,", "ch as (select f,")
  .replace("es as (select f, modelVersionId, trenchCategory_set,", "es as (select f,")
  .replace("cc as (select f, modelVersionId, trenchCategory_set, cat, row_number() over (partition by f, modelVersionId, trenchCategory_set order by count(*) desc, cat) rn from lg where tr and cat is not null group by f, modelVersionId, trenchCategory_set, cat)",
           "cc as (select 'flag' f, flag cat, row_number() over (order by count(*) desc, flag) rn from population where Data_selection = 'Train' group by flag)")
  .replace("ct as (select f, modelVersionId, trenchCategory_set, list(cat) tops from cc where rn <= 6 group by f, modelVersionId, trenchCategory_set)",
           "ct as (select f, list(cat) tops from cc where rn <= 6 group by f)")},
 res as (select * from ({'with dummy as (select 1)' + psi_rows(['modelVersionId', 'trenchCategory_set'])})),
 kept as (select * from res where Segment_Column <> 'Overall' or Feature = 'score'),
 ids as (select *, row_number() over (order by case Segment_Column when 'Overall' then 1 when 'new_loan_type' then 2 else 3 end,
    modelVersionId, trenchCategory_set, Segment_Value) - 1 as Segment_ID
   from (select distinct Segment_Column, Segment_Value, modelVersionId, trenchCategory_set from kept))
select kept.*, ids.Segment_ID, 'Model_' || modelVersionId || '_Trench_' || replace(trenchCategory_set, ',', '_') ||
  case when Segment_Column = 'Overall' then '' else '_' || Segment_Column || '_' || Segment_Value end as Segment_Name
from kept join ids using (Segment_Column, Segment_Value, modelVersionId, trenchCategory_set)""",
)
def psi_trench_subsets(spark, sf_dir):
    result = psi.psi_report(
        population(spark, sf_dir), "score", ["score", "flag"], ["new_loan_type", "osType"]
    )
    return psi_output(result, "modelVersionId", "trenchCategory_set", "Segment_ID", "Segment_Name")


# --- other baselines ---------------------------------------------------------------------------


@query(
    "psi_first_period",
    f"""with {LINES}, r0 as (select modelVersionId k, Application_month m, score, digitalLoanAccountId acct from lines where score is not null),
 sp as (select k, min(m) b, min(score) lo, max(score) hi from r0 group by k),
 v as (select k, list(score order by score) v from r0 join sp using (k) where m = b group by k),
 q as (select k, list_sort(list_distinct({quantile_list('v')})) q from v),
 e as (select k, b, list_concat(list_concat([lo - 0.0001], q[2:len(q) - 1]), [hi + 0.0001]) e from q join sp using (k) where len(q) >= 3),
 p as (select r0.*, b, {right_bin('score', 'e')} bin, len(e) - 1 nb from r0 join e using (k)),
 bs as (select k, unnest(range(1, len(e))) bin from e),
 tr as (select k, bin, count(*) n, sum(count(*)) over (partition by k) t from p where m = b group by k, bin),
 te as (select k, m, bin, count(*) n from p group by k, m, bin),
 tt as (select k, m, count(*) t, count(distinct acct) c, min(score) mn, max(score) mx, avg(score) av, max(b) b, max(nb) nb from p group by k, m),
 s0 as (select k, m, coalesce(tr.n / cast((select max(t) from tr x where x.k = tt.k) as double), 1e-4) e, coalesce(te.n / cast(tt.t as double), 1e-4) a
   from tt join bs using (k) left join tr using (k, bin) left join te using (k, m, bin)),
 s1 as (select k, m, e / sum(e) over w e, a / sum(a) over w a from s0 window w as (partition by k, m)),
 ps as (select k, m, sum({term('e', 'a')}) p from s1 group by k, m)
select k as modelVersionId, m as month, {r('p')} as PSI, tt.b as baseline_month, tt.t as sample_size, {r('mn')} as prediction_min,
  {r('mx')} as prediction_max, {r('av + 1e-7', 4)} as prediction_mean, cast(nb as int) as num_bins, c as account_count from ps join tt using (k, m)""",
)
def psi_first_period(spark, sf_dir):
    result = psi.first_period_psi(lines(spark, sf_dir), "modelVersionId", "score", "disbursementdate")
    return result.select(
        "modelVersionId", "month", rounded("PSI"), "baseline_month", "sample_size", rounded("prediction_min"),
        rounded("prediction_max"),
        # Means of cents often end exactly between two roundings; both sides shift them alike.
        F.round(F.col("prediction_mean") + F.lit(1e-7), 4).alias("prediction_mean"),
        "num_bins", "account_count",
    )


def _baseline_month_sql(final: str) -> str:
    return f"""with {POPULATION},
 sg as (select 'Overall' sc, 'Overall' sv, Application_month m, score, flag from population
   union all select 'trenchCategory', trenchCategory, Application_month, score, flag from population where trenchCategory is not null
   union all select 'osType', osType, Application_month, score, flag from population where osType is not null),
 sz as (select sc, sv, m, count(*) n from sg group by sc, sv, m),
 bs as (select sc, sv, min(m) b from sz group by sc, sv having count(*) >= 2),
 lg as (select sc, sv, m, b, 'score' f, 'numerical' ft, score num, null cat from sg join bs using (sc, sv) where score is not null
   union all select sc, sv, m, b, 'flag', 'categorical', null, flag from sg join bs using (sc, sv) where flag is not null),
 v as (select sc, sv, f, list(num order by num) v from lg where m = b and num is not null group by sc, sv, f),
 es as (select sc, sv, f, list_sort(list_distinct({quantile_list('v')})) e from v),
 cc as (select sc, sv, f, cat, row_number() over (partition by sc, sv, f order by count(*) desc, cat) rn from lg where m = b and cat is not null group by sc, sv, f, cat),
 ct as (select sc, sv, f, list(cat) tops from cc where rn <= 6 group by sc, sv, f),
 pl as (select lg.*, e, case when ft = 'numerical' then case when num > e[1] and num <= e[len(e)] then len(list_filter(e, lambda y: y < num)) end end bi,
    case when ft = 'categorical' then case when list_contains(tops, cat) then cat else 'Other' end end cb
   from lg left join es using (sc, sv, f) left join ct using (sc, sv, f)),
 bn as (select sc, sv, m, b, f, ft, case when bi is not null then 'Bin_' || bi else cb end bin, e[bi] lo, e[bi + 1] hi from pl),
 tot as (select sc, sv, f, m, count(*) t from bn group by sc, sv, f, m),
 cn as (select sc, sv, f, ft, b, m, bin, count(*) n, max(lo) lo, max(hi) hi from bn where bin is not null group by sc, sv, f, ft, b, m, bin),
 gr as (select x.sc, x.sv, x.f, x.ft, x.b, y.m, x.bin, x.lo, x.hi from cn x join (select distinct sc, sv, f, m from bn where m <> b) y
     on x.sc = y.sc and x.sv = y.sv and x.f = y.f where x.m = x.b
   union select sc, sv, f, ft, b, m, bin, lo, hi from cn where m <> b),
 sh as (select gr.*, coalesce(x.n, 0) en, coalesce(y.n, 0) an,
    case when coalesce(x.n, 0) = 0 then 1e-6 else x.n / cast(tx.t as double) end e, case when coalesce(y.n, 0) = 0 then 1e-6 else y.n / cast(ty.t as double) end a
   from gr join tot tx on tx.sc = gr.sc and tx.sv = gr.sv and tx.f = gr.f and tx.m = gr.b
   join tot ty on ty.sc = gr.sc and ty.sv = gr.sv and ty.f = gr.f and ty.m = gr.m
   left join cn x on x.sc = gr.sc and x.sv = gr.sv and x.f = gr.f and x.m = gr.b and x.bin = gr.bin
   left join cn y on y.sc = gr.sc and y.sv = gr.sv and y.f = gr.f and y.m = gr.m and y.bin = gr.bin)
 {final}"""


@query(
    "psi_baseline_month",
    _baseline_month_sql(
        f""", ps as (select sc, sv, b, f, ft, m, sum({term('e', 'a')}) p from sh group by all)
select sc as Segment_Column, sv as Segment_Value, b as baseline_month, f as Feature, ft as Feature_Type, ps.m as current_month, {r('p')} as psi,
  (select n from sz where sz.sc = ps.sc and sz.sv = ps.sv and sz.m = ps.b) as num_baseline_records,
  (select n from sz where sz.sc = ps.sc and sz.sv = ps.sv and sz.m = ps.m) as num_current_records,
  case when p < 0.1 then 'No significant change' when p < 0.2 then 'Minor change' when p < 0.5 then 'Moderate change' else 'Significant change' end as psi_interpretation
from ps"""
    ),
)
def psi_baseline_month(spark, sf_dir):
    result = psi.baseline_month_psi(population(spark, sf_dir), ["score", "flag"], ["trenchCategory", "osType"])
    return result.select(
        "Segment_Column", "Segment_Value", "baseline_month", "Feature", "Feature_Type", "current_month",
        rounded("psi"), "num_baseline_records", "num_current_records", "psi_interpretation",
    )


@query(
    "psi_baseline_month_bins",
    _baseline_month_sql(
        f"""select sc as Segment_Column, sv as Segment_Value, b as baseline_month, f as Feature, ft as Feature_Type, m as current_month,
  bin as Bin, {r('lo')} as Bin_Min, {r('hi')} as Bin_Max, {r('e')} as baseline_percentage, {r('a')} as current_percentage, {r(term('e', 'a'))} as psi_component,
  en as baseline_count, an as current_count, {r('a - e')} as percentage_change,
  case when abs(a - e) < 0.01 then 'Very Small' when abs(a - e) < 0.05 then 'Small' when abs(a - e) < 0.1 then 'Moderate' else 'Large' end as change_interpretation
from sh"""
    ),
)
def psi_baseline_month_bins(spark, sf_dir):
    result = psi.baseline_month_bin_psi(population(spark, sf_dir), ["score", "flag"], ["trenchCategory", "osType"])
    kept = ["Segment_Column", "Segment_Value", "baseline_month", "Feature", "Feature_Type", "current_month", "Bin"]
    numbers = ["Bin_Min", "Bin_Max", "baseline_percentage", "current_percentage", "psi_component", "percentage_change"]
    return result.select(*kept, *[rounded(c) for c in numbers], "baseline_count", "current_count", "change_interpretation")


LARGEST_ORDER = ["Segment_Column", "Segment_Value", "Feature", "current_month", "Bin"]


@query(
    "psi_largest_bins",
    f"""select 'component' as by, * from (select * from ({CHECKS['psi_baseline_month_bins']}) order by psi_component desc, {', '.join(LARGEST_ORDER)} limit 10)
 union all select 'change', * from (select * from ({CHECKS['psi_baseline_month_bins']}) order by abs(percentage_change) desc, {', '.join(LARGEST_ORDER)} limit 10)""",
)
def psi_largest_bins(spark, sf_dir):
    rows = psi_baseline_month_bins(spark, sf_dir)
    return stacked(
        [
            reports.largest(rows, "psi_component", 10, ties=LARGEST_ORDER).withColumn("by", F.lit("component")),
            reports.largest(rows, "percentage_change", 10, True, LARGEST_ORDER).withColumn("by", F.lit("change")),
        ]
    )


@query(
    "psi_whole_frame_bins",
    f"""with {LINES}, v as (select list(quantity order by quantity) v from lines where quantity is not null),
 e as (select list_sort(list_distinct({quantile_list('v')})) e from v),
 b as (select Application_month m, case when quantity is null then 'Missing' else cast(({right_bin('quantity', 'e')}) - 1 as varchar) end bin from lines, e),
 base as (select min(m) b from b),
 t as (select m, count(*) t from b group by m), c as (select m, bin, count(*) n from b group by m, bin),
 s as (select t.m, bs.bin, coalesce(x.n, 0) / cast((select t from t where m = (select b from base)) as double) + 1e-6 e,
     coalesce(y.n, 0) / cast(t.t as double) + 1e-6 a from t, (select distinct bin from b) bs
   left join c x on x.m = (select b from base) and x.bin = bs.bin left join c y on y.m = t.m and y.bin = bs.bin)
select 'quantity' as feature, (select b from base) as base_month, s.m as month, {r('sum(' + term('e', 'a') + ')')} as psi, max(t.t) as sample_size
from s join t on t.m = s.m group by s.m""",
)
def psi_whole_frame_bins(spark, sf_dir):
    result = psi.whole_frame_feature_psi(lines(spark, sf_dir), "quantity", "numerical")
    return result.select("feature", "base_month", "month", rounded("psi"), "sample_size")


@query(
    "psi_whole_frame_categories",
    f"""with parts as (select p_type, l_shipdate from lineitem join part on p_partkey = l_partkey),
 tp as (select p_type from parts group by 1 order by count(*) desc, p_type limit 3),
 b as (select strftime(l_shipdate, '%Y-%m') m, case when p_type in (select p_type from tp) then p_type else 'Others' end bin from parts),
 base as (select min(m) b from b),
 t as (select m, count(*) t from b group by m), c as (select m, bin, count(*) n from b group by m, bin),
 s as (select t.m, bs.bin, coalesce(x.n, 0) / cast((select t from t where m = (select b from base)) as double) + 1e-6 e,
     coalesce(y.n, 0) / cast(t.t as double) + 1e-6 a from t, (select distinct bin from b) bs
   left join c x on x.m = (select b from base) and x.bin = bs.bin left join c y on y.m = t.m and y.bin = bs.bin)
select (select b from base) as base_month, m as month, bin as Bin, {r('e')} as expected_share, {r('a')} as actual_share, {r(term('e', 'a'))} as psi_component
from s where not (e < 2e-6 and a < 2e-6)""",
)
def psi_whole_frame_categories(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_type")
    rows = lines(spark, sf_dir).join(part, "partkey", "inner").select("Application_month", "p_type")
    result = psi.whole_frame_feature_psi(rows, "p_type", "categorical", by_bin=True, top=3)
    return result.select("base_month", "month", "Bin", *[rounded(c) for c in ("expected_share", "actual_share", "psi_component")])


def _pooled_sql(period: str, value: str, source: str, baseline: str) -> str:
    return f"""rows0 as (select {period} p, {value} x from {source} where {value} is not null),
 ps as (select distinct p from rows0 where p > {baseline}),
 both0 as (select p, x, 'a' side from rows0 where p > {baseline} union all select ps.p, x, 'e' from rows0, ps where rows0.p = {baseline}),
 v as (select p, list(x order by x) v from both0 group by p),
 e as (select p, {quantile_list('v')} e from v),
 b as (select p, side, {left_bin('x', 'e')} bin from both0 join e using (p)),
 tot as (select p, side, count(*) t from b group by p, side), cn as (select p, side, bin, count(*) n from b group by p, side, bin),
 g as (select distinct p, bin from b),
 s as (select g.p, coalesce(x.n / cast(tx.t as double), 1e-7) e, coalesce(y.n / cast(ty.t as double), 1e-7) a from g
   join tot tx on tx.p = g.p and tx.side = 'e' join tot ty on ty.p = g.p and ty.side = 'a'
   left join cn x on x.p = g.p and x.side = 'e' and x.bin = g.bin left join cn y on y.p = g.p and y.side = 'a' and y.bin = g.bin)
select p as {period}, {r('sum(' + term('e', 'a') + ')')} as psi from s group by p"""


@query("psi_pooled_bins", f"with {LINES}, {_pooled_sql('Application_month', 'quantity', 'lines', chr(39) + '1999-01' + chr(39))}")
def psi_pooled_bins(spark, sf_dir):
    result = psi.pooled_bin_psi(lines(spark, sf_dir), "quantity", "Application_month", "1999-01")
    return result.select("Application_month", rounded("psi"))


@query(
    "psi_pooled_weekly",
    "with weekly as (select cast(date_trunc('week', ts) as date) as week_start, value from events), "
    + _pooled_sql("week_start", "value", "weekly", "date '2024-01-01'"),
)
def psi_pooled_weekly(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(week_start(F.col("ts")).alias("week_start"), "value")
    return psi.pooled_bin_psi(rows, "value", "week_start", "2024-01-01").select("week_start", rounded("psi"))


def _detail_sql(value: str) -> str:
    return f"""with {LINES}, v as (select list({value} order by {value}) v, list_sort(list_distinct(list({value}))) u from lines where Data_selection = 'Train'),
 q as (select list_sort(list_distinct({quantile_list('v')})) d, {quantile_list('u')} du, len(u) nu, {quantile_list('v')} dv from v),
 e as (select case when len(d) = 11 then d when nu >= 11 then du else {equal_width('dv[1]', 'dv[11]', 10)} end e from q),
 b as (select Data_selection ds, {left_bin(value, 'e')} bin from lines, e),
 t as (select count(*) filter (where ds = 'Train') tr, count(*) filter (where ds = 'Test') te from b),
 c as (select bin, count(*) filter (where ds = 'Train') tr, count(*) filter (where ds = 'Test') te from b where bin is not null group by bin),
 d as (select bin, coalesce(c.tr, 0) tr, coalesce(c.te, 0) te, coalesce(c.tr, 0) / cast(t.tr as double) e, coalesce(c.te, 0) / cast(t.te as double) a
   from range(1, 11) g(bin) left join c using (bin), t),
 o as (select cast(bin as varchar) Bins, tr train, e * 100 train_pct, te test, a * 100 test_pct, (a - e) * 100 difference,
   case when e > 0 and a > 0 then ln(a / e) else 0.0 end ln_ratio, case when e > 0 and a > 0 then {term('e', 'a')} * 100 else 0.0 end PSI from d)
select Bins, train, {r('train_pct')} as train_pct, test, {r('test_pct')} as test_pct, {r('difference')} as difference, {r('ln_ratio')} as ln_ratio, {r('PSI')} as PSI from o
union all select 'Grand Total', cast(sum(train) as bigint), 100.0, cast(sum(test) as bigint), 100.0, null, null, {r('sum(PSI)')} from o"""


def _detail(spark, sf_dir, value):
    numbers = ["train_pct", "test_pct", "difference", "ln_ratio", "PSI"]
    return psi.period_psi_detail(lines(spark, sf_dir), value).select("Bins", "train", "test", *[rounded(c) for c in numbers])


@query("psi_period_detail", _detail_sql("score"))
def psi_period_detail(spark, sf_dir):
    return _detail(spark, sf_dir, "score")


@query("psi_period_detail_ties", _detail_sql("discount"))
def psi_period_detail_ties(spark, sf_dir):
    return _detail(spark, sf_dir, "discount")


# --- reports on stability results ----------------------------------------------------------------

MONTHLY_SQL = f"with {LINES}, {feature_shares('lines', ['score', 'quantity'], ['flag'], ['line'])}, res as (select * from ({'with dummy as (select 1)' + psi_rows()}))"


def _monthly(spark, sf_dir):
    return psi.feature_psi(lines(spark, sf_dir), ["score", "quantity", "flag"], ["line"])


@query(
    "psi_labels",
    MONTHLY_SQL
    + """ select Feature, Segment_Column, Segment_Value, Month, PSI,
 case when PSI < 0.1 then 'stable' when PSI < 0.25 then 'warning' else 'critical' end as status,
 case when PSI < 0.1 then 'No significant change' when PSI < 0.2 then 'Minor change' when PSI < 0.5 then 'Moderate change' else 'Significant change' end as change,
 case when PSI < 0.1 then 'Very Stable' when PSI < 0.2 then 'Stable' when PSI < 0.5 then 'Moderate Shift' else 'Significant Shift' end as shift,
 case when PSI <= 0.1 then 'Green' when PSI <= 0.25 then 'Amber' else 'Red' end as traffic,
 case when PSI < 0.01 then 'Very Small' when PSI < 0.05 then 'Small' when PSI < 0.1 then 'Moderate' else 'Large' end as size from res""",
)
def psi_labels(spark, sf_dir):
    result = _monthly(spark, sf_dir).select("Feature", "Segment_Column", "Segment_Value", "Month", rounded("PSI"))
    for name in ("status", "change", "shift", "traffic", "size"):
        result = reports.with_band(result, "PSI", name, name)
    return result


@query("psi_alerts", MONTHLY_SQL + " select Feature, Segment_Column, Segment_Value, Month, PSI from res where PSI >= 0.1")
def psi_alerts(spark, sf_dir):
    result = _monthly(spark, sf_dir).select("Feature", "Segment_Column", "Segment_Value", "Month", rounded("PSI"))
    return reports.alerts(result)


@query(
    "psi_recount",
    MONTHLY_SQL
    + """, sides as (
  select 'line' sc, cast(line as varchar) sv, Data_selection ds, "Application_month" am, "digitalLoanAccountId" id from lines
  union all select 'Overall', 'All', Data_selection, "Application_month", "digitalLoanAccountId" from lines),
 t as (select sc, sv, count(distinct id) c from sides where ds = 'Train' group by all),
 m as (select sc, sv, am, count(distinct id) c from sides where ds <> 'Train' group by all),
 counted as (select res.*, coalesce(t.c, 0) tc, coalesce(m.c, 0) mc from res
  left join t on t.sc = Segment_Column and t.sv = Segment_Value left join m on m.sc = Segment_Column and m.sv = Segment_Value and m.am = Month)
 select Feature, Segment_Column, Segment_Value, Month, Base_Count, Actual_Count, tc as Actual_Train_Count, mc as Actual_Test_Count,
 Base_Count = tc as Train_Match, Actual_Count = mc as Test_Match, Base_Count - tc as Train_Difference, Actual_Count - mc as Test_Difference from counted""",
)
def psi_recount(spark, sf_dir):
    source = lines(spark, sf_dir)
    checked = reports.recount(
        _monthly(spark, sf_dir), source, ["line"], "digitalLoanAccountId", "Application_month", "Data_selection"
    )
    return checked.select(
        "Feature", "Segment_Column", "Segment_Value", "Month", "Base_Count", "Actual_Count", "Actual_Train_Count",
        "Actual_Test_Count", "Train_Match", "Test_Match", "Train_Difference", "Test_Difference",
    )


@query(
    "psi_summaries",
    MONTHLY_SQL
    + f""", lab as (select *, case when PSI < 0.1 then 'No significant change' when PSI < 0.2 then 'Minor change' when PSI < 0.5 then 'Moderate change' else 'Significant change' end l from res),
 u as (select 'feature' summary, Feature as value, PSI p from lab union all select 'segment', Segment_Column, PSI from lab
   union all select 'month', Current_Month, PSI from lab union all select 'label', l, PSI from lab)
select summary, value, {r('avg(p)')} as mean_psi, count(*) as n, {r('count(*) * 100.0 / sum(count(*)) over (partition by summary)')} as pct from u group by summary, value""",
)
def psi_summaries(spark, sf_dir):
    rows = reports.with_band(
        _monthly(spark, sf_dir).withColumnRenamed("Current_Month", "current_month").withColumn("PSI", F.round("PSI", 6)),
        "PSI", "change", "psi_interpretation",
    )
    result = reports.psi_summaries(rows, "PSI")
    return result.select("summary", "value", rounded("mean_psi"), "n", rounded("pct"))


@query(
    "psi_wide_scores",
    f"""with {LINES}, r0 as (select 'score' s, score x, Application_month m, Data_selection ds from lines union all select 'quantity', quantity, Application_month, Data_selection from lines),
 v as (select s, list(x order by x) v from r0 where ds = 'Train' group by s),
 e as (select s, list_sort(list_distinct({quantile_list('v')})) e from v),
 b as (select s, m, ds, {right_bin('x', 'e')} bin from r0 join e using (s)),
 tr as (select s, bin, count(*) n, sum(count(*)) over (partition by s) t from b where ds = 'Train' group by s, bin),
 te as (select s, m, bin, count(*) n from b where ds = 'Test' group by s, m, bin), tt as (select s, m, count(*) t from b where ds = 'Test' group by s, m),
 g as (select tt.s, tt.m, tt.t, bs.bin from tt join (select distinct s, bin from b where bin is not null) bs on bs.s = tt.s),
 sh as (select g.s, g.m, coalesce(tr.n / cast((select max(t) from tr x where x.s = g.s) as double), 1e-10) e, coalesce(te.n / cast(g.t as double), 1e-10) a
   from g left join tr on tr.s = g.s and tr.bin = g.bin left join te on te.s = g.s and te.m = g.m and te.bin = g.bin),
 p as (select s, m, {r('sum(' + term('e', 'a') + ')')} p from sh group by s, m)
select m as Month, case when s = 'score' then 'Price score' else s end as scorename, case when s = 'score' then p end as score_psivalues, case when s = 'quantity' then p end as quantity_psivalues,
  'Line model' as Modelname from p""",
)
def psi_wide_scores(spark, sf_dir):
    rows = lines(spark, sf_dir)
    frames = {
        s: psi.monthly_score_psi(rows, s, policy="absent_1e-10")
        .where(F.col("DateCategory") == "Monthly")
        .select("Month", "scorename", rounded("psivalues"))
        for s in ("score", "quantity")
    }
    return reports.relabelled(
        reports.wide_scores(frames), "scorename", {"score": "Price score"}, Modelname="Line model"
    )
