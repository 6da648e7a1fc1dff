"""Check SQL of feature stability: long rows, bins, segments, shares and account counts."""

from __future__ import annotations

from collections.abc import Sequence

from scorewatch.catalog.base import open_edges, quantile_at, quantile_list, r, right_bin


def term(e: str, a: str) -> str:
    return f"(({a}) - ({e})) * ln(({a}) / ({e}))"


def equal_width(low: str, high: str, parts: int) -> str:
    inner = ", ".join(f"{low} + {i} * (({high} - {low}) / {parts}.0)" for i in range(1, parts))
    return f"[{low}, {inner}, {high}]"


def feature_shares(
    source: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    segments: Sequence[str] = (),
    keys: Sequence[str] = (),
    edges: str = "ladder",
    top: int = 6,
    within: str | None = None,
) -> str:
    """CTEs ending in sh(sc, sv, keys, f, ft, m, bin, lo, hi, en, an, et, am) and bc, nc account counts."""
    k = "".join(f", {c}" for c in keys)
    s = "".join(f", {c}" for c in segments if c not in keys)
    using = "".join(f", {c}" for c in keys)
    long = " union all ".join(
        [f"select m, tr, inside{k}{s}, '{f}' f, 'numerical' ft, cast({f} as double) num, cast(null as varchar) cat from src" for f in numeric]
        + [f"select m, tr, inside{k}{s}, '{f}' f, 'categorical' ft, cast(null as double) num, cast({f} as varchar) cat from src" for f in categorical]
    )
    def per_segment(columns: str, table: str) -> str:
        parts = [f"select 'Overall' sc, 'All' sv{columns} from {table}"]
        parts += [f"select '{c}' sc, cast({c} as varchar) sv{columns} from {table} where {c} is not null" for c in segments]
        return " union all ".join(parts)

    chosen = {
        "ladder": (
            "case when len(dd) >= 11 then dd when len(fv) >= 6 then fv when len(t3) >= 4 then t3 "
            "when lo = hi then [lo - 0.1, lo, lo + 0.1] "
            f"else list_sort(list_distinct({equal_width('lo', 'hi', 5)})) end"
        ),
        "deciles": "case when len(dd) >= 2 then dd else [lo, lo - 0.001, lo, lo + 0.001, lo] end",
    }[edges]
    group = f"sc, sv{k}, f, ft"
    return f"""src as (select *, Application_month m, Data_selection = 'Train' tr, {within or 'true'} inside from {source}),
 lg as ({long}),
 vv as (select f{k}, list(num order by num) v from lg where tr and num is not null group by f{k}),
 qq as (select f{k}, {quantile_list('v')} d, [{quantile_at('v', 0.3333)}, {quantile_at('v', 0.6667)}] th from vv),
 uu as (select f{k}, list_sort(list_distinct(d)) dd, list_sort(list_distinct([d[1], d[3], d[5], d[7], d[9], d[11]])) fv,
   list_sort(list_distinct([d[1], th[1], th[2], d[11]])) t3, d[1] lo, d[11] hi from qq),
 ch as (select f{k}, {chosen} c from uu),
 es as (select f{k}, {open_edges('c')} e from ch),
 cc as (select f{k}, cat, row_number() over (partition by f{k} order by count(*) desc, cat) rn from lg where tr and cat is not null group by f{k}, cat),
 ct as (select f{k}, list(cat) tops from cc where rn <= {top} group by f{k}),
 pl as (select lg.*, e, case when ft = 'numerical' then
      case when num is null then 'Missing' when e is null then 'No_Bins' else 'Bin_' || ({right_bin('num', 'e')}) end
    when cat is null then 'Missing' when list_contains(tops, cat) then cat else 'Others' end bin
   from lg left join es using (f{using}) left join ct using (f{using}) where inside),
 bd as (select *, case when bin like 'Bin_%' then cast(bin[5:] as int) end bi from pl),
 sg as ({per_segment(f", m, tr{k}, f, ft, bin, e[bi] lo, e[bi + 1] hi", 'bd')}),
 ex as (select {group}, bin, count(*) n, max(lo) lo, max(hi) hi from sg where tr group by {group}, bin),
 ac as (select {group}, m, bin, count(*) n, max(lo) lo, max(hi) hi from sg where not tr group by {group}, m, bin),
 et as (select {group}, sum(n) t from ex group by {group}),
 am as (select {group}, m, sum(n) t from ac group by {group}, m),
 gr as (select {group}, m, bin, lo, hi from am join ex using ({group}) union select {group}, m, bin, lo, hi from ac semi join et using ({group})),
 sh as (select gr.*, ex.n en, ac.n an, et.t et, am.t am from gr join et using ({group}) join am using ({group}, m)
   left join ex using ({group}, bin) left join ac using ({group}, m, bin)),
 sa as ({per_segment(f", m, tr{k}, digitalLoanAccountId acct", "(select * from src where inside)")}),
 bc as (select sc, sv{k}, count(distinct acct) bcount from sa where tr group by sc, sv{k}),
 nc as (select sc, sv{k}, m, count(distinct acct) ncount from sa where not tr group by sc, sv{k}, m)"""


def psi_rows(keys: Sequence[str] = (), floor: str = "zero", extra: str = "", eps: str = "1e-4") -> str:
    """Final SELECT of feature PSI rows over `feature_shares`."""
    k = "".join(f", {c}" for c in keys)
    def adjust(n: str, t: str) -> str:
        share = f"coalesce({n}, 0) / cast({t} as double)"
        if floor == "max":
            return f"greatest({share}, {eps})"
        return f"case when coalesce({n}, 0) = 0 then {eps} else {share} end"

    return f""", ad as (select *, {adjust('en', 'et')} e0, {adjust('an', 'am')} a0 from sh),
 nm as (select *, e0 / sum(e0) over w e1, a0 / sum(a0) over w a1 from ad window w as (partition by sc, sv{k}, f, ft, m)),
 ps as (select sc, sv{k}, f, ft, m, sum({term('e1', 'a1')}) psi, 100.0 / count(en) ep, 100.0 / count(an) ap from nm group by sc, sv{k}, f, ft, m)
select f as Feature, ft as Feature_Type, sc as Segment_Column, sv as Segment_Value{k}, m as Month, m as Current_Month,
  'Train' as Base_Month, bcount as Base_Count, ncount as Actual_Count, {r('ep')} as Expected_Percentage,
  {r('ap')} as Actual_Percentage, {r('psi')} as PSI{extra}
from ps join bc using (sc, sv{k}) join nc using (sc, sv{k}, m)"""


def bin_rows(keys: Sequence[str] = (), extra: str = "") -> str:
    """Final SELECT of bin level rows over `feature_shares`."""
    k = "".join(f", {c}" for c in keys)
    e = "case when coalesce(en, 0) = 0 then 1e-4 else en / cast(et as double) end"
    a = "case when coalesce(an, 0) = 0 then 1e-4 else an / cast(am as double) end"
    return f"""
select f as Feature, ft as Feature_Type, sc as Segment_Column, sv as Segment_Value{k}, m as Month, m as Current_Month,
  'Train' as Base_Month, bcount as Base_Count, ncount as Actual_Count, bin as Bin,
  case when isinf(lo) then null else {r('lo')} end as Bin_Min, case when isinf(hi) then null else {r('hi')} end as Bin_Max,
  {r('coalesce(en, 0) / cast(et as double) * 100')} as Base_Percentage,
  {r('coalesce(an, 0) / cast(am as double) * 100')} as Actual_Percentage, {r(term(e, a))} as Bin_PSI{extra}
from sh join bc using (sc, sv{k}) join nc using (sc, sv{k}, m)"""
