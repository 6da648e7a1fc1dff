"""Characteristic stability queries on hand-set bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.catalog.base import LINES, POPULATION, lines, population, quantile_list, r, right_bin, rounded
from scorewatch.catalog.feature_sql import term
from scorewatch.catalog.registry import registry
from scorewatch.functions.bins import fixed_bins
from scorewatch.operators.aggregates import pivoted
from scorewatch.plans import csi, reports

QUERIES, CHECKS, query = registry()

# Hand-set bins: label, low, high (both included); quantities 31 to 40 fall in no bin.
SCORE_RANGES = [
    ("0-20000", 0.0, 20000.0), ("20000.01-50000", 20000.01, 50000.0), ("50000.01-80000", 50000.01, 80000.0), (">80000", 80000.0, None),
]
QUANTITY_RANGES = [("1-10", 1.0, 10.0), ("11-30", 11.0, 30.0), (">40", 40.0, None)]


def _case(column: str, ranges) -> str:
    tests = [f"when {column} is null then '{chr(97 + len(ranges))}. missing'"]
    for i, (label, low, high) in enumerate(ranges):
        test = f"{column} > {low}" if high is None else f"{column} between {low} and {high}"
        tests.append(f"when {test} then '{chr(97 + i)}. {label}'")
    return "case " + " ".join(tests) + " end"


BINNED = f"""{POPULATION}, binned as (select *, {_case('score', SCORE_RANGES)} score_bin,
  {_case('case when quantity = 7 then null else quantity end', QUANTITY_RANGES)} quantity_bin from population)"""
FEATURES = ["score_bin", "quantity_bin"]
SEGMENTS = ["trenchCategory", "osType"]


def with_bins(df):
    quantity = F.when(F.col("quantity") != 7, F.col("quantity"))
    return df.withColumns(
        {"score_bin": fixed_bins(F.col("score"), SCORE_RANGES), "quantity_bin": fixed_bins(quantity, QUANTITY_RANGES)}
    )


def binned(spark, sf_dir):
    return with_bins(population(spark, sf_dir))


@query(
    "fixed_bins",
    f"with {BINNED} select score_bin, quantity_bin, count(*) as n from binned group by all",
)
def fixed_bin_counts(spark, sf_dir):
    return with_bins(lines(spark, sf_dir)).groupBy("score_bin", "quantity_bin").agg(F.count(F.lit(1)).alias("n"))


COUNTS = f"""{BINNED},
 lg as (select 'score_bin' f, score_bin b, * from binned union all select 'quantity_bin', quantity_bin, * from binned),
 sg as (select 'Overall' sc, 'All' sv, f, b, Application_month m, Data_selection ds, digitalLoanAccountId acct from lg
   union all select 'trenchCategory', trenchCategory, f, b, Application_month, Data_selection, digitalLoanAccountId from lg where trenchCategory is not null
   union all select 'osType', osType, f, b, Application_month, Data_selection, digitalLoanAccountId from lg where osType is not null),
 tr as (select sc, sv, f, b, count(*) n from sg where ds = 'Train' group by sc, sv, f, b),
 te as (select sc, sv, f, m, b, count(*) n from sg where ds = 'Test' group by sc, sv, f, m, b),
 tt as (select sc, sv, f, sum(n) a, sum(n) filter (where b is not null) k from tr group by sc, sv, f),
 et as (select sc, sv, f, m, sum(n) a, sum(n) filter (where b is not null) k from te group by sc, sv, f, m),
 gr as (select sc, sv, f, m, b from et join tr using (sc, sv, f) where b is not null union select sc, sv, f, m, b from te where b is not null),
 sh as (select gr.*, tr.n tn, te.n en, tt.a ta, tt.k tk, et.a ea, et.k ek from gr join tt using (sc, sv, f) join et using (sc, sv, f, m)
   left join tr using (sc, sv, f, b) left join te using (sc, sv, f, m, b)),
 fe as (select *, coalesce(tn / cast(tk as double), 1e-4) e, coalesce(en / cast(ek as double), 1e-4) a from sh),
 fc as (select sc, sv, f, m, sum({term('e', 'a')}) c from fe group by sc, sv, f, m),
 bi as (select *, greatest(coalesce(tn / cast(ta as double), 0), 1e-4) e, greatest(coalesce(en / cast(ea as double), 0), 1e-4) a from sh),
 ne as (select sc, sv, m, count(distinct acct) c from sg where ds = 'Test' group by sc, sv, m),
 nt as (select sc, sv, count(distinct acct) c, max(m) m from sg where ds = 'Train' group by sc, sv)"""


@query(
    "csi_segmented",
    f"""with {COUNTS}
select sc as Segment_Column, sv as Segment_Value, f as feature, m as Month, {r('fc.c')} as csi, ne.c as account_count, 'Monthly' as DateCategory from fc join ne using (sc, sv, m)
union all select sc, sv, f, nt.m, 0.0, nt.c, 'Training' from tt join nt using (sc, sv)""",
)
def csi_segmented(spark, sf_dir):
    result = csi.segmented_csi(binned(spark, sf_dir), FEATURES, SEGMENTS, selection="Data_selection")
    return result.select(
        "Segment_Column", "Segment_Value", "feature", "Month", rounded("csi"), "account_count", "DateCategory"
    )


BINS = f"""with {COUNTS}, mk as (select sc, sv, m, dense_rank() over (partition by sc, sv order by m) p from (select distinct sc, sv, m from et)),
 ou as (select sc, sv, f, m, case when p <= 25 then chr(cast(97 + p as int)) else 'z' || lpad(cast(p as varchar), 4, '0') end || '_' || m mk, b, 'b_Monthly' dc, e, a,
    {term('e', 'a')} bc, fc.c fcsi, ne.c ac from bi join fc using (sc, sv, f, m) join mk using (sc, sv, m) join ne using (sc, sv, m)
  union all select sc, sv, f, nt.m, 'a_' || nt.m, b, 'a_Training', n / cast(tt.a as double), n / cast(tt.a as double), 0.0, 0.0, nt.c
  from tr join tt using (sc, sv, f) join nt using (sc, sv) where b is not null)"""


def _bins(spark, sf_dir):
    return csi.bin_csi(binned(spark, sf_dir), FEATURES, SEGMENTS, selection="Data_selection")


@query(
    "csi_bins",
    f"""{BINS} select sc as Segment_Column, sv as Segment_Value, f as feature, m as Month, mk as MonthSortKey, b as bin_value, dc as DateCategory,
 {r('e')} as train_pct, {r('a')} as test_pct, {r('bc')} as bin_csi, {r('fcsi')} as feature_csi, ac as account_count from ou""",
)
def csi_bins(spark, sf_dir):
    return _bins(spark, sf_dir).select(
        "Segment_Column", "Segment_Value", "feature", "Month", "MonthSortKey", "bin_value", "DateCategory",
        *[rounded(c) for c in ("train_pct", "test_pct", "bin_csi", "feature_csi")], "account_count",
    )


TOP_KEYS = ["Segment_Column", "Segment_Value", "feature", "Month"]
TOP = f"""{BINS}, rk as (select *, row_number() over (partition by sc, sv, f, m order by abs(round(bc, 9)) desc, b) rn from ou)"""


def _top(spark, sf_dir):
    rows = _bins(spark, sf_dir).withColumn("bin_csi", F.round("bin_csi", 9))
    return reports.top_bins(rows, TOP_KEYS)


@query(
    "csi_top3",
    f"""{TOP} select sc as Segment_Column, sv as Segment_Value, f as feature, m as Month, b as bin_value, {r('bc')} as bin_csi, {r('fcsi')} as feature_csi,
 cast(rn as int) as rank, case when fcsi <> 0 then {r('round(bc, 9) / fcsi * 100', 4)} else 0.0 end as pct_contribution from rk where rn <= 3""",
)
def csi_top3(spark, sf_dir):
    return _top(spark, sf_dir).select(
        *TOP_KEYS, "bin_value", rounded("bin_csi"), rounded("feature_csi"), "rank", rounded("pct_contribution", 4)
    )


@query(
    "csi_top3_wide",
    f"""{TOP} select sc as Segment_Column, sv as Segment_Value, f as feature, m as Month,
 {', '.join(f"max(b) filter (where rn = {i}) as bin_value_{i}, {r(f'max(bc) filter (where rn = {i})')} as bin_csi_{i}" for i in (1, 2, 3))}
 from rk group by sc, sv, f, m""",
)
def csi_top3_wide(spark, sf_dir):
    wide = reports.top_bins_wide(_top(spark, sf_dir), TOP_KEYS)
    return wide.select(*TOP_KEYS, *[c for i in (1, 2, 3) for c in (f"bin_value_{i}", rounded(f"bin_csi_{i}"))])


def _month_keys() -> list[str]:
    months = [f"{y}-{m:02d}" for y in (1999, 2000, 2001) for m in range(1, 13)][:35]
    return [
        f"{chr(98 + i)}_{m}" if i < 25 else f"z{i + 1:04d}_{m}" for i, m in enumerate(months)
    ]


@query(
    "csi_pivot",
    f"""{BINS} select f as feature, b as bin_value, {', '.join(f'''{r(f"max(bc) filter (where mk = '{k}')")} as "{k}"''' for k in _month_keys())}
 from ou where sc = 'Overall' and dc = 'b_Monthly' group by f, b""",
)
def csi_pivot(spark, sf_dir):
    rows = csi.bin_csi(with_bins(lines(spark, sf_dir)), FEATURES, (), selection="Data_selection")
    rows = rows.where(F.col("DateCategory") == "b_Monthly").withColumn("bin_csi", F.round("bin_csi", 6) + F.lit(0.0))
    return pivoted(rows, ["feature", "bin_value"], "MonthSortKey", "bin_csi")


@query(
    "csi_pair",
    f"""with {BINNED}, c as (select score_bin b, count(*) filter (where Data_selection = 'Train') t, count(*) filter (where Data_selection = 'Test') e from binned group by 1),
 s as (select b, greatest(t / cast(sum(t) over () as double), 1e-4) e, greatest(c.e / cast(sum(c.e) over () as double), 1e-4) a from c)
select 'score_bin' as feature, b as bin_value, {r('e')} as train_pct, {r('a')} as test_pct, {r(term('e', 'a'))} as bin_csi,
 {r('sum(' + term('e', 'a') + ') over ()')} as feature_csi from s""",
)
def csi_pair(spark, sf_dir):
    rows = with_bins(lines(spark, sf_dir))
    result = csi.pair_bin_csi(
        rows.where(F.col("Data_selection") == "Train"), rows.where(F.col("Data_selection") == "Test"), "score_bin"
    )
    return result.select("feature", "bin_value", *[rounded(c) for c in ("train_pct", "test_pct", "bin_csi", "feature_csi")])


@query(
    "csi_band_share",
    f"""with {BINNED}, c as (select quantity_bin b, Application_month m, count(*) n from binned where quantity_bin is not null group by 1, 2),
 g as (select b, m from (select distinct b from c), (select distinct Application_month m from binned where Application_month > '1999-01')),
 s as (select g.b, g.m, x.n / cast(x.n + y.n as double) e, y.n / cast(x.n + y.n as double) a from g left join c x on x.b = g.b and x.m = '1999-01' left join c y on y.b = g.b and y.m = g.m)
select b as quantity_bin, m as Application_month, {r(term('e', 'a'))} as csi from s""",
)
def csi_band_share(spark, sf_dir):
    rows = with_bins(lines(spark, sf_dir))
    result = csi.band_share_csi(rows, "quantity_bin", "score", "Application_month", "1999-01")
    return result.select("quantity_bin", "Application_month", rounded("csi"))


@query(
    "psi_table",
    f"""with {LINES}, v as (select list(score order by score) v from lines where Data_selection = 'Train'),
 e as (select list_sort(list_distinct({quantile_list('v')})) e from v),
 b as (select Data_selection ds, {right_bin('score', 'e')} bin from lines, e),
 c as (select bin, count(*) filter (where ds = 'Train') t, count(*) filter (where ds = 'Test') x from b where bin is not null group by bin),
 s as (select bin, t / cast(sum(t) over () as double) e, x / cast(sum(x) over () as double) a from c)
select cast(bin as int) as bin, {r('e')} as train_pct, {r('a')} as test_pct, {r(term('e', 'a'))} as psi, {r('sum(' + term('e', 'a') + ') over ()')} as total_psi from s""",
)
def psi_table(spark, sf_dir):
    rows = lines(spark, sf_dir)
    result = csi.psi_table(
        rows.where(F.col("Data_selection") == "Train"), rows.where(F.col("Data_selection") == "Test"), "score"
    )
    return result.select("bin", *[rounded(c) for c in ("train_pct", "test_pct", "psi", "total_psi")])


def _csi_table_sql(column: str, parts: int) -> str:
    return f"""select '{column}' as feature, sum({term('e', 'a')}) as csi from (
  select t / cast(sum(t) over () as double) e, x / cast(sum(x) over () as double) a from (
    select bin, count(*) filter (where ds = 'Train') t, count(*) filter (where ds = 'Test') x from (
      select Data_selection ds, {right_bin(column, 'e')} bin from lines, (select list_sort(list_distinct({quantile_list('v', parts)})) e from (select list({column} order by {column}) v from lines where Data_selection = 'Train')))
    where bin is not null group by bin))"""


@query(
    "csi_table",
    f"""with {LINES}, res as ({_csi_table_sql('score', 10)} union all {_csi_table_sql('quantity', 5)} union all
 select 'flag', sum({term('e', 'a')}) from (select t / cast(sum(t) over () as double) e, x / cast(sum(x) over () as double) a from
   (select flag, count(*) filter (where Data_selection = 'Train') t, count(*) filter (where Data_selection = 'Test') x from lines group by flag)))
select feature, {r('csi')} as csi, case when csi < 0.1 then 'stable' when csi < 0.25 then 'warning' else 'critical' end as status from res""",
)
def csi_table(spark, sf_dir):
    rows = lines(spark, sf_dir)
    tables = reports.monitor(
        rows.where(F.col("Data_selection") == "Train"), rows.where(F.col("Data_selection") == "Test"), "score",
        ["score", "quantity", "flag"], bins={"score": 10, "quantity": 5},
    )
    return tables["csi"].select("feature", rounded("csi"), "status")


@query(
    "monitor_gini",
    f"""with {LINES}, t as (select score, label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as place from lines where Data_selection = 'Test'),
 s as (select count(*) n, sum(label) bad, count(*) - sum(label) good, sum(place) filter (where label = 1) places from t)
select n, cast(bad as bigint) as bad, cast(good as bigint) as good,
 {r('2 * (places - bad * (bad + 1) / 2.0) / (bad * cast(good as double)) - 1')} as gini from s""",
)
def monitor_gini(spark, sf_dir):
    """The Gini part of the combined monitor."""
    rows = lines(spark, sf_dir)
    tables = reports.monitor(
        rows.where(F.col("Data_selection") == "Train"), rows.where(F.col("Data_selection") == "Test"), "score",
        ["quantity"], target="label",
    )
    return tables["gini"].select("n", "bad", "good", rounded("gini"))
