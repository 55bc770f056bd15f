"""DuckDB twin of the adapter and of the marts, as one chain of common table expressions."""

from __future__ import annotations

from . import rules


def _facts() -> str:
    rows = ",\n".join(
        f"{{'keep': {r.when}, 'concept': '{r.concept}', 'source_tag': '{r.tag}', "
        f"'tag_priority': {r.priority}, 'unit': '{r.unit}', 'period_start': {r.start}, "
        f"'period_end': {r.end}, 'form': cast({r.form} as varchar), "
        f"'accession': cast({r.accession} as varchar), 'value': cast({r.amount} as double)}}"
        for r in rules.RULES)
    return f"""
base as (
  select l_suppkey as s, cast(year(l_shipdate) + 15 as integer) as y,
    cast(sum(cast(floor(l_extendedprice * 100) as bigint)) as bigint) as r,
    cast(sum(cast(floor(l_extendedprice * l_discount * 100) as bigint)) as bigint) as d,
    cast(sum(cast(l_quantity as bigint)) as bigint) as q, count(*) as n
  from lineitem group by 1, 2),
told as (
  select *, unnest(range(0, least(2, 2016 - y) + 1)) as v from base),
filing as (
  select told.*, s_name, 'A' || s || '-' || (y + v) as accession,
    case when s % 19 = 0 then '20-F' else '10-K' end as form
  from told join supplier on s = s_suppkey),
listed as (
  select s, s_name, y, v, cast({rules.FILED} as date) as filed_date, unnest([
{rows}
  ]) as f from filing),
facts as (
  select lpad(cast(s as varchar), 10, '0') as entity_id, 'T' || s as ticker,
    s_name as company_name, f.concept, f.source_tag, f.tag_priority, f.unit,
    cast(f.period_start as date) as period_start, cast(f.period_end as date) as period_end,
    cast(y + v as integer) as fiscal_year, 'FY' as fiscal_period, f.form, filed_date,
    f.accession, cast(null as varchar) as frame, f.value
  from listed where f.keep),
prices as (
  select 'T' || s as ticker, cast(day + interval 15 year as date) as date,
    {rules.CLOSE} as close
  from (select s, day, date_diff('day', date '1970-01-01', day) as k
        from (select distinct l_suppkey as s, cast(l_shipdate as date) as day from lineitem))),
company as (
  select s_suppkey as s, lpad(cast(s_suppkey as varchar), 10, '0') as entity_id,
    'T' || s_suppkey as ticker, s_name as company_name, s_nationkey from supplier),
sectors as (
  select ticker, company_name, case when not ({rules.NO_SECTOR}) then n_name end as gics_sector
  from company join nation on s_nationkey = n_nationkey),
cases as (
  select ticker, 'Case, no. ' || s as case_study_note from company where {rules.CASE_STUDY}),
events as (
  select ticker, 'pre_disclosure' as event_label, {rules.AS_OF} as as_of_date,
    {rules.AS_OF} + 500 as public_event_date, 'before' as event_description from company
  union all
  select ticker, 'full_history', date '2099-01-01', date '2099-01-01', 'control' from company)"""


_STAGED = """
timed as (
  select f.*, cast(case when month(period_end) = 1 and day(period_end) < 11
      then year(period_end) - 1 else year(period_end) end as integer) as period_fiscal_year,
    cast(period_end - period_start as integer) as period_days,
    cast(filed_date - period_end as integer) as filing_lag_days
  from facts f where value is not null),
staged as (
  select * exclude (value, fiscal_year, fiscal_period, frame),
    case when period_days is null then 'instant'
      when period_days >= 350 and period_days <= 380 then 'annual'
      when period_days >= 80 and period_days <= 100 then 'quarter'
      when period_days >= 170 and period_days <= 195 then 'half'
      when period_days >= 260 and period_days <= 285 then 'three_quarter'
      else 'other' end as period_type,
    concept <> 'shares_diluted' as restatement_eligible,
    if(concept = 'cogs', 'sum', 'best') as combine_mode,
    if(concept in ('cogs', 'sga', 'depreciation_amortisation', 'interest_expense'),
       'always_positive', 'any') as sign_convention,
    if(sign_convention = 'always_positive', abs(value), value) as value,
    sign_convention = 'always_positive' and timed.value < 0 as sign_was_negative
  from timed where period_fiscal_year >= 2010 and filing_lag_days >= 1)"""


# By way of text, as the double's shortest decimal; and back, rounded once.
_EXACT_SUM = ("cast(cast(sum(cast(cast(value as varchar) as decimal(38, 10))) as varchar) "
              "as double)")


def _pit(source: str, world: str, mark: str = "") -> str:
    """Bitemporal chain over ``source``; ``world`` lists the key columns, ``mark`` suffixes the
    CTE names so that two chains can stand side by side."""
    return f"""
kept{mark} as (
  select * from (
    select *, bool_or(period_type = 'annual') over (
        partition by {world}, accession, period_end) as full_year
    from {source}
    where form in ('10-K', '10-K/A', '20-F', '20-F/A') and period_type in ('annual', 'instant'))
  where (period_type = 'annual' or (full_year and accession is not null))
    and unit in ('USD', 'shares')),
told_once{mark} as (
  select {world}, ticker, company_name, concept, source_tag, period_start, period_end,
    period_fiscal_year, filed_date, filing_lag_days, form, accession, value,
    restatement_eligible, sign_was_negative
  from kept{mark} where combine_mode = 'best'
  qualify row_number() over (partition by {world}, concept, period_end, accession
    order by tag_priority, value desc, coalesce(period_start, date '9999-12-31'), unit,
      source_tag, filed_date, form, sign_was_negative) = 1
  union all
  select {world}, max(ticker), max(company_name), concept,
    array_to_string(list_sort(list_distinct(list(source_tag))), '+'), max(period_start),
    period_end, max(period_fiscal_year), max(filed_date), max(filing_lag_days), max(form),
    accession, {_EXACT_SUM}, bool_and(restatement_eligible), bool_or(sign_was_negative)
  from (
    select {world}, concept, period_end, accession, source_tag, unit, period_start, ticker,
      company_name, period_fiscal_year, filed_date, filing_lag_days, form,
      restatement_eligible, max(value) as value,
      bool_or(sign_was_negative) as sign_was_negative
    from kept{mark} where combine_mode = 'sum' group by all)
  group by {world}, concept, period_end, accession),
tagged{mark} as (
  select o.*, first_value(source_tag) over (partition by {world}, concept, period_end
      order by filed_date desc, accession desc nulls last) as latest_tag,
    count(distinct source_tag) over (partition by {world}, concept, period_end)
      as n_distinct_tags,
    source_tag = latest_tag as in_lineage
  from told_once{mark} o),
measured{mark} as (
  select *, row_number() over w as nth, count(*) over p as n_told,
    first_value(value) over w as v_first,
    first_value(value) over (partition by {world}, concept, period_end, in_lineage
      order by filed_date desc, accession desc nulls first) as v_last,
    min(filed_date) over p as d_first, max(filed_date) over p as d_last
  from tagged{mark}
  window w as (partition by {world}, concept, period_end, in_lineage
               order by filed_date, accession nulls last),
         p as (partition by {world}, concept, period_end, in_lineage)),
versioned{mark} as (
  select * exclude (nth, n_told, v_first, v_last, d_first, d_last),
    in_lineage and accession is not null as counted,
    if(counted, nth, null) as report_version, if(counted, n_told, null) as n_reports,
    if(counted, v_first, null) as first_reported_value,
    if(counted, v_last, null) as latest_reported_value,
    if(counted, d_first, null) as first_filed_date,
    if(counted, d_last, null) as latest_filed_date
  from measured{mark}),
ruling{mark} as (
  select {world}, period_fiscal_year, arg_max(period_end, (n, period_end)) as canonical
  from (select {world}, period_fiscal_year, period_end, count(*) as n from versioned{mark}
        where report_version = 1 group by all)
  group by all),
pit{mark} as (
  select v.* exclude (counted),
    n_distinct_tags > 1 as tag_switch_detected,
    report_version = 1 and period_end = canonical as is_first_report,
    filed_date = latest_filed_date as is_latest_report,
    (latest_reported_value - first_reported_value) / nullif(abs(first_reported_value), 0)
      as restatement_pct,
    coalesce(abs(restatement_pct) > 0.005, false) as was_restated
  from versioned{mark} v left join ruling{mark} using ({world}, period_fiscal_year))"""


_FIGURES = ("revenue", "cogs", "receivables", "current_assets", "total_assets", "ppe_net",
            "depreciation_amortisation", "sga", "current_liabilities", "long_term_debt",
            "net_income", "cfo", "retained_earnings", "operating_income")


def _years(source: str, world: str, seen: str, mark: str = "") -> str:
    def pick(concept: str, column: str = "value") -> str:
        return f"max(if({seen} and concept = '{concept}', {column}, null))"

    figures = ",\n    ".join(f"{pick(c)} as {c}" for c in _FIGURES)
    return f"""
years{mark} as (
  select {world}, period_end, period_fiscal_year,
    max(if({seen}, ticker, null)) as ticker, max(if({seen}, company_name, null)) as company_name,
    max(if({seen}, form, null)) as form,
    {figures},
    {pick('gross_profit')} as gross_profit_reported,
    {pick('total_liabilities')} as total_liabilities_reported,
    {pick('shares_diluted')} as shares,
    {pick('shares_diluted', 'latest_reported_value')} as shares_current_basis,
    max(if({seen} and concept in ('net_income', 'cfo', 'total_assets'), first_filed_date, null))
      as accrual_known_date,
    coalesce(gross_profit_reported, revenue - cogs) as gross_profit,
    coalesce(total_liabilities_reported, current_liabilities + long_term_debt)
      as total_liabilities
  from {source} group by {world}, period_end, period_fiscal_year having bool_or({seen})),
abroad{mark} as (
  select distinct {world} from {source} where form in ('20-F', '20-F/A'))"""


def _scores(world: str, mark: str = "", shares: str = "shares") -> str:
    def same(other: str) -> str:
        return " and ".join(f"a.{k} = {other}.{k}" for k in world.split(", "))

    return f"""
quoted{mark} as (
  select {world}, period_end, arg_max(price_date, (price_date, close)) as price_date,
    arg_max(close, (price_date, close)) as price_at_period_end
  from years{mark} y join (select ticker, date as price_date, close from prices) p
    on p.ticker = y.ticker and price_date between y.period_end - 10 and y.period_end
  group by all),
rated{mark} as (
  select a.*, price_date, price_at_period_end,
    if(f.entity_id is null, price_at_period_end * a.shares_current_basis, null)
      as market_value_of_equity,
    (a.receivables / nullif(a.revenue, 0)) / nullif(b.receivables / nullif(b.revenue, 0), 0)
      as dsri,
    (b.gross_profit / nullif(b.revenue, 0)) / nullif(a.gross_profit / nullif(a.revenue, 0), 0)
      as gmi,
    (1 - (a.current_assets + a.ppe_net) / nullif(a.total_assets, 0))
      / nullif(1 - (b.current_assets + b.ppe_net) / nullif(b.total_assets, 0), 0) as aqi,
    a.revenue / nullif(b.revenue, 0) as sgi,
    (b.depreciation_amortisation / nullif(b.depreciation_amortisation + b.ppe_net, 0))
      / nullif(a.depreciation_amortisation / nullif(a.depreciation_amortisation + a.ppe_net, 0),
               0) as depi,
    (a.sga / nullif(a.revenue, 0)) / nullif(b.sga / nullif(b.revenue, 0), 0) as sgai,
    (a.net_income - a.cfo) / nullif(a.total_assets, 0) as tata,
    (a.total_liabilities / nullif(a.total_assets, 0))
      / nullif(b.total_liabilities / nullif(b.total_assets, 0), 0) as lvgi,
    (a.current_assets - a.current_liabilities) / nullif(a.total_assets, 0) as x1,
    a.retained_earnings / nullif(a.total_assets, 0) as x2,
    a.operating_income / nullif(a.total_assets, 0) as x3,
    market_value_of_equity / nullif(a.total_liabilities, 0) as x4,
    a.revenue / nullif(a.total_assets, 0) as x5,
    cast(a.net_income > 0 as integer) as signal_positive_roa,
    cast(a.cfo > 0 as integer) as signal_positive_cfo,
    cast(a.net_income / nullif(a.total_assets, 0) > b.net_income / nullif(b.total_assets, 0)
      as integer) as signal_roa_improved,
    cast(a.cfo > a.net_income as integer) as signal_earnings_quality,
    cast(a.long_term_debt / nullif(a.total_assets, 0)
      < b.long_term_debt / nullif(b.total_assets, 0) as integer) as signal_leverage_decreased,
    cast(a.current_assets / nullif(a.current_liabilities, 0)
      > b.current_assets / nullif(b.current_liabilities, 0) as integer)
      as signal_liquidity_improved,
    cast(a.{shares} <= b.{shares} as integer) as signal_no_dilution,
    cast(a.gross_profit / nullif(a.revenue, 0) > b.gross_profit / nullif(b.revenue, 0)
      as integer) as signal_margin_improved,
    cast(a.revenue / nullif(a.total_assets, 0) > b.revenue / nullif(b.total_assets, 0)
      as integer) as signal_turnover_improved
  from years{mark} a
  left join years{mark} b on {same('b')} and b.period_fiscal_year = a.period_fiscal_year - 1
  left join quoted{mark} q on {same('q')} and q.period_end = a.period_end
  left join abroad{mark} f on {same('f')}),
scored{mark} as (
  select *,
    round(-4.84 + 0.920 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi + 0.115 * depi
      - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi, 3) as m_score,
    1.2 * x1 + 1.4 * x2 + 3.3 * x3 + 0.6 * x4 + 1.0 * x5 as z_sum,
    round(z_sum, 3) as z_score,
    case when z_sum > 2.99 then 'safe' when z_sum >= 1.81 then 'grey'
      when z_sum is not null then 'distress' end as zone,
    signal_positive_roa + signal_positive_cfo + signal_roa_improved + signal_earnings_quality
      + signal_leverage_decreased + signal_liquidity_improved + signal_no_dilution
      + signal_margin_improved + signal_turnover_improved as f_score,
    case when f_score >= 8 then 'strong' when f_score <= 2 then 'weak'
      when f_score is not null then 'neutral' end as band
  from rated{mark})"""


_SCREENER = """
screener as (
  select entity_id, s.ticker, s.company_name, d.gics_sector,
    c.ticker is not null as is_case_study, case_study_note, period_fiscal_year, period_end,
    m_score, z_score, zone as z_zone, f_score, band as f_band,
    m_score > -1.78 as m_score_flag, zone = 'distress' as z_score_flag,
    band = 'weak' as f_score_flag,
    cast(coalesce(m_score > -1.78, false) as integer)
      + cast(coalesce(zone = 'distress', false) as integer)
      + cast(coalesce(band = 'weak', false) as integer) as red_flag_count,
    if(m_score is null, 0, 1) + if(zone is null, 0, 1) + if(band is null, 0, 1)
      as models_scored
  from scored s left join sectors d on upper(d.ticker) = s.ticker
  left join cases c on c.ticker = s.ticker)"""

WORLD = "event_ticker, event_label, as_of_date, public_event_date, event_description, entity_id"

_ASOF_ROWS = """
asof_rows as (
  select p.*, e.ticker as event_ticker, event_label, as_of_date, public_event_date,
    event_description
  from pit p join events e on e.ticker = p.ticker)"""

_STRICT_ROWS = """
known as (
  select f.*, e.ticker as event_ticker, event_label, as_of_date, public_event_date,
    event_description
  from staged f join events e on e.ticker = f.ticker and f.filed_date <= e.as_of_date)"""

_RETURNS = """
accrual as (
  select entity_id, ticker, period_fiscal_year, tata, accrual_known_date as first_filed_date
  from scored where tata is not null),
quotes as (select ticker, date as price_date, max(close) as close from prices group by all),
bought as (
  select a.*, arg_min(price_date, price_date) as entry_date, arg_min(close, price_date) as entry_price
  from accrual a left join quotes q on q.ticker = a.ticker
    and price_date between first_filed_date and first_filed_date + 10
  group by all),
sold as (
  select b.*, arg_min(price_date, price_date) as exit_date, arg_min(close, price_date) as exit_price
  from bought b left join quotes q on q.ticker = b.ticker
    and price_date between first_filed_date + 365 and first_filed_date + 375
  group by all),
earned as (
  select *, round(exit_price / nullif(entry_price, 0) - 1, 4) as fwd_return_12m from sold),
accruals as (
  select *, if(fwd_return_12m is null, null, cast(ntile(5) over (
      partition by period_fiscal_year, fwd_return_12m is null order by tata, entity_id)
      as integer)) as accrual_quintile
  from earned),
quintiles as (
  select accrual_quintile, count(*) as n, avg(tata) as mean_tata,
    avg(fwd_return_12m) as mean_return, median(fwd_return_12m) as median_return,
    stddev_samp(fwd_return_12m) as std_return
  from accruals where accrual_quintile is not null group by 1)"""

_PARTS = {
    "facts": (_facts(), ()),
    "staged": (_STAGED, ("facts",)),
    "pit": (_pit("staged", "entity_id"), ("staged",)),
    "years": (_years("pit", "entity_id", "coalesce(is_first_report, false)"), ("pit",)),
    "scored": (_scores("entity_id"), ("years",)),
    "screener": (_SCREENER, ("scored",)),
    "asof_rows": (_ASOF_ROWS, ("pit",)),
    "asof_years": (_years(
        "asof_rows", WORLD,
        "coalesce(is_first_report and first_filed_date <= as_of_date, false)", "_asof"),
        ("asof_rows",)),
    "asof": (_scores(WORLD, "_asof"), ("asof_years",)),
    "strict_pit": (_STRICT_ROWS + "," + _pit("known", WORLD, "_strict"), ("staged",)),
    "strict_years": (_years("pit_strict", WORLD, "coalesce(is_first_report, false)", "_strict"),
                     ("strict_pit",)),
    "strict": (_scores(WORLD, "_strict"), ("strict_years",)),
    "accruals": (_RETURNS, ("scored",)),
}


def pit_of(facts: str, sql: str) -> str:
    """``sql`` over the bitemporal table of any table of facts."""
    return f"with {_STAGED.replace('from facts f', f'from {facts} f')},{_PARTS['pit'][0]}\n{sql}"


def after(*parts: str, sql: str) -> str:
    """``sql`` preceded by the CTEs of the named parts and of all they need."""
    needed: list[str] = []

    def add(part: str) -> None:
        for before in _PARTS[part][1]:
            add(before)
        if part not in needed:
            needed.append(part)

    for part in parts:
        add(part)
    return "with " + ",".join(_PARTS[p][0] for p in needed) + "\n" + sql
