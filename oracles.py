"""DuckDB SQL for every query that SQL can express, over the same Parquet tables.

Written apart from the Spark plans: integer arithmetic, plain windows and joins, no shared expressions.
"""

from __future__ import annotations

AS_OF = "timestamp '2024-01-15 09:30:00'"
CUTOFF = "timestamp '2024-01-15 09:00:00'"


def key(n: str) -> str:
    return f"('U' || lpad(cast({n} as varchar), 10, '0'))"


def unless(m: int, value: str) -> str:
    return f"case when h % {m} <> 0 then {value} end"


def worst(*factors: str) -> str:
    return f"greatest({', '.join(factors)})"


def label(x: str) -> str:
    return f"case {x} when 1 then 'green' when 2 then 'yellow' when 3 then 'red' end"


def half_up(num: str, den: str, scale: str) -> str:
    """num/den rounded half away from zero over integers, then divided by ``scale``."""
    return f"(sign({num}) * ((2 * abs({num}) + {den}) // (2 * {den}))) / {scale}"


def pct(part: str, total: str) -> str:
    return f"((2 * 1000 * {part} + {total}) // (2 * {total})) / 10.0"


ELEMENTS = f"""
  {unless(23, '240 - 2*a + h % 101')} as tmax,
  {unless(29, '200 - 2*a + h % 101 - h % 67')} as tmin,
  {unless(19, 'case when h % 10 < 6 then 0 else h % 211 end')} as prcp,
  {unless(13, 'h % 40')} as snow, {unless(13, 'h % 90')} as snwd, {unless(13, '5 + h % 40')} as awnd,
  {unless(7, '10 + h % 60')} as wsf2, {unless(11, '15 + h % 70')} as wsf5
"""

SCORES = """
  case when hi is null then null when hi between 500 and 900 then 1 when hi between 400 and 950 then 2 else 3 end as p_temp,
  case when rain is null then null when rain = 0 then 1 when rain < 10 then 2 else 3 end as p_rain,
  case when wmax is null then null when wmax < 100 then 1 when wmax < 200 then 2 else 3 end as p_wind,
  case when (hi is null or rain is null) and (hi is not null or rain is not null or wmax is not null) then 2 end as p_data,
  case when rain is null then null when rain = 0 then 1 when rain < 5 then 2 else 3 end as s_rain,
  case when hi is null or lo is null then null when lo >= 500 and hi <= 900 then 1 when lo >= 400 then 2 else 3 end as s_temp,
  case when (rain is null or hi is null or lo is null) and (rain is not null or (hi is not null and lo is not null)) then 2 end as s_data
"""


def tenths_of(expr: str) -> str:
    return f"cast(round({expr} * 10) as bigint)"


def daily_ctes(prefix: str, keyed: str) -> dict[str, str]:
    """hi/lo/mean/wmax/wavg/snow/depth in tenths, rain in hundredths, plus the reference doubles."""
    return {
        f"{prefix}elements": f"""
            select station_id, d, h, {ELEMENTS}
            from (select *, abs(dayofyear(d) - 200) as a from ({keyed}))""",
        f"{prefix}units": f"""
            select station_id, d,
              round((tmax*18 + 3200)/100.0, 1) as f_hi, round((tmin*18 + 3200)/100.0, 1) as f_lo,
              round(prcp/254.0, 2) as f_rain, round(snow*10/254.0, 1) as f_snow, round(snwd*10/254.0, 1) as f_depth,
              round(awnd*2237/10000.0, 1) as f_wavg, round(coalesce(wsf2, wsf5)*2237/10000.0, 1) as f_wmax
            from {prefix}elements""",
        f"{prefix}days": f"""
            select *, cast(printf('%.1f', (f_hi + f_lo)/2) as double) as f_mean,
              {tenths_of('f_hi')} as hi, {tenths_of('f_lo')} as lo,
              cast(round(f_rain*100) as bigint) as rain, {tenths_of('f_wmax')} as wmax
            from {prefix}units""",
        f"{prefix}daily": f"""
            select *, {tenths_of('f_mean')} as mean, {label(worst('p_temp', 'p_rain', 'p_wind', 'p_data'))} as pour,
              {label(worst('s_rain', 's_temp', 's_data'))} as seal
            from (select *, {SCORES} from {prefix}days)""",
    }


CTES: dict[str, str] = {
    "stations": f"""select {key('s_suppkey')} as station_id, s_name as name, n_name as covers, r_name as state, s_suppkey as k
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "regions": f"select {key('n_nationkey')} as station_id, n_name as name from nation",
    **daily_ctes(
        "",
        f"""select {key('l_suppkey')} as station_id, cast(l_shipdate as date) as d,
              cast(sum(l_partkey*31 + l_orderkey*7 + l_linenumber) as bigint) as h from lineitem group by 1, 2""",
    ),
    **daily_ctes(
        "r_",
        f"""select {key('s_nationkey')} as station_id, cast(l_shipdate as date) as d,
              cast(sum(l_partkey*31 + l_orderkey*7 + l_linenumber) as bigint) as h
            from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2""",
    ),
    "jobs": f"""select o_orderkey as job_id,
          case when o_orderkey % 101 <> 0 then cast(o_orderdate as date) end as start_date,
          case when o_orderkey % 97 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 5 as integer) end as completion_date,
          cast(round(o_totalprice*100) as bigint) as cents, o_orderkey % 2000 as area, o_orderkey % 3 as coats,
          'lead-' || o_custkey as lead_name, 'site-' || (o_orderkey % 977) as address, o_orderpriority as job_type,
          o_orderstatus as concrete_type, strftime(o_orderdate, '%b') as month,
          'mixer-' || (o_orderkey % 13) as company, {key('(o_custkey // 15)')} as station_id from orders""",
    "staged_jobs": """select *, completion_date - start_date as duration,
          case when area > 0 then ((2*cents + area) // (2*area)) / 100.0 end as per_sqft
        from jobs where start_date is not null""",
    "event_rows": """select event_id, user_id, ts, event_type, props, user_id // 15 as site, cast(ts as date) as day,
          hour(ts) as hour, event_id*17 + cast(round(value*100) as bigint) as k from events""",
    "hour_keys": "select site, day, hour, cast(sum(k) as bigint) as h from event_rows group by 1, 2, 3",
}


def measures(source: str, extra: str = "") -> str:
    t10 = "430 - 8*abs(hour-15) + (hd*13) % 400 + h % 31"
    base = "10 + (hd*3) % 80 + h % 40"
    return f"""
      select site, hour, day, {key('site')} as station_id {extra},
        {unless(61, t10)} as t10,
        {unless(67, '25 + (hd*7) % 45 + h % 9')} as hum,
        {unless(61, t10 + ' - 90 - (hd*11) % 150 - h % 20')} as d10,
        {unless(73, 'case when hd % 4 >= 3 then h % 60 else h % 16 end')} as prob,
        {unless(79, 'case when hd % 4 >= 3 then h % 12 else 0 end')} as p100,
        {unless(71, base)} as w10, {base} + h % 150 as g10, h % 101 as cloud
      from (select *, (site*7919 + dayofyear(day)*104729) % 1009 as hd from {source})"""


HOUR_FACTORS = """
  case when t10 is null then null when t10 between 500 and 900 then 1 when t10 between 400 and 950 then 2 else 3 end as f_temperature,
  case when hum is null then null when hum between 25 and 70 then 1 when hum between 15 and 85 then 2 else 3 end as f_humidity,
  case when w10 is null then null when w10 < 100 then 1 when w10 < 200 then 2 else 3 end as f_wind,
  case when prob is null then null when prob < 15 then 1 when prob < 40 then 2 else 3 end as f_precipitation,
  case when t10/10.0 - d10/10.0 is null then null when t10/10.0 - d10/10.0 > 10 then 1 when t10/10.0 - d10/10.0 > 5 then 2 else 3 end as f_dewpoint
"""
HOUR_SCORE = "greatest(f_temperature, f_humidity, f_wind, f_precipitation, f_dewpoint)"
HOUR_DATA = f"""case when (t10 is null or hum is null or w10 is null or prob is null) and {HOUR_SCORE} is not null then 2 end"""

CTES |= {
    "hourly": f"""select *, cast(day as timestamp) + to_hours(cast(hour as bigint)) as time from ({measures('hour_keys')})""",
    "graded": f"""select *, {HOUR_DATA} as f_data, greatest({HOUR_SCORE}, {HOUR_DATA}) as sev
        from (select *, {HOUR_FACTORS} from hourly)""",
    "ahead": f"select * from graded where time >= {CUTOFF}",
    "placed": "select *, row_number() over (partition by station_id order by time) as place from ahead",
    "readings": f"""select *, {HOUR_DATA} as f_data, greatest({HOUR_SCORE}, {HOUR_DATA}) as sev from (
        select * exclude (prob), null::bigint as prob, {HOUR_FACTORS.replace('case when prob is null then null when prob < 15 then 1 when prob < 40 then 2 else 3 end', 'null::integer')}
        from ({measures('(select *, k as h from event_rows)', ', ts, event_id as seq')}))""",
    "alert_rows": """select case when event_id % 41 = 0 then '' else user_id || '-' || (event_id % 3) end as alert_id,
          ['Tornado Watch','Freeze Warning','Wind Advisory','Rip Current Statement','Special Weather Statement','Excessive Heat Warning', null][event_id % 7 + 1] as event,
          event_type || ' notification' as headline,
          ['Extreme','Severe','Moderate','Minor', null][event_id % 5 + 1] as severity,
          'area ' || (user_id // 15) as areas, strftime(ts, '%Y-%m-%dT%H:%M:%S') as onset, repeat(props, 60) as description,
          ts, event_id as seq from events""",
    "relevant_alerts": """select * from alert_rows where coalesce(severity in ('Extreme','Severe'), false)
          or regexp_matches(lower(coalesce(event,'') || ' ' || coalesce(headline,'')),
             'freeze|frost|wind|thunder|hail|flood|ice|tornado|heat|storm|snow|blizzard|winter|rain|hurricane')""",
    "snapshots": """select h.*, f.fetched_at, f.fetched_at + interval 1 hour as expires_at from graded h,
          (select unnest([timestamp '2024-01-15 06:30:00', timestamp '2024-01-15 08:30:00', timestamp '2024-01-15 09:30:00']) as fetched_at) f""",
}

ORDER = list(CTES)


def sql(body: str, *extra: tuple[str, str]) -> str:
    """``body`` behind the CTEs it needs."""
    import re

    named = {**CTES, **dict(extra)}
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in named:
            if name not in needed and re.search(rf"(?<![\w.']){re.escape(name)}(?![\w(.'])", text):
                needed.add(name)
                need(named[name])

    need(body)
    parts = [f"{n} as ({named[n]})" for n in [*ORDER, *dict(extra)] if n in needed]
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body


# --- daily -----------------------------------------------------------------------------------

DAILY_COLUMNS = """station_id, d as observation_date, f_hi as temp_max_f, f_lo as temp_min_f, f_mean as temp_mean_f,
  f_rain as precip_in, f_snow as snow_in, f_depth as snow_depth_in, f_wavg as wind_avg_mph, f_wmax as wind_max_mph"""


def text_of(pairs: list[tuple[str, str]]) -> str:
    """Sorted name=verdict text of the factors present."""
    items = ", ".join(f"'{n}=' || ({label(c)})" for n, c in sorted(pairs))
    return f"concat_ws('|', {items})"


POUR_TEXT = text_of([("temperature", "p_temp"), ("precipitation", "p_rain"), ("wind", "p_wind"), ("data", "p_data")])
SEAL_TEXT = text_of([("precipitation", "s_rain"), ("temperature", "s_temp"), ("data", "s_data")])

SQL: dict[str, str] = {}
SQL["unit_convert"] = sql(f"select {DAILY_COLUMNS} from days")
SQL["daily_scores"] = sql(
    f"select {DAILY_COLUMNS}, pour as pour_score, seal as sealer_score, {POUR_TEXT} as pour_factors, {SEAL_TEXT} as sealer_factors from daily"
)
SQL["stage_daily"] = sql(
    f"select {DAILY_COLUMNS}, pour as pour_score, seal as sealer_score, hi is null and lo is null and rain is null as is_incomplete_record from daily"
)
SQL["stage_stations"] = sql(
    """select station_id, name as station_name, covers as coverage_area, state,
         (k*37 % 900000)/10000.0 as latitude, (k*53 % 1800000)/-10000.0 as longitude, (k*11 % 20000)/10.0 as elevation_m
       from stations"""
)
SQL["stage_jobs"] = sql(
    """select job_id, station_id, start_date, completion_date, cast(duration as bigint) as job_duration_days,
         cents/100.0 as final_revenue, cast(area as bigint) as square_footage, cast(coats as bigint) as sealer_coats,
         per_sqft as revenue_per_sqft from staged_jobs"""
)
SQL["parse_fixed_width"] = sql(
    """select station_id, d as observation_date, tmax as "TMAX", tmin as "TMIN", prcp as "PRCP", snow as "SNOW",
         snwd as "SNWD", awnd as "AWND", wsf2 as "WSF2", wsf5 as "WSF5"
       from elements where h % 53 <> 0 and year(d) >= 1996
         and coalesce(tmax, tmin, prcp, snow, snwd, awnd, wsf2, wsf5) is not null"""
)
SQL["temp_anomalies"] = sql(
    f"""select station_id, name as station_name, d as observation_date, f_mean as temp_mean_f,
          {half_up('s7', 'n7', '10.0')} as temp_7d_avg, {half_up('(mean*n7 - s7)', 'n7', '10.0')} as temp_anomaly,
          case when n30 > 1 then floor(sqrt(cast(n30*q30 - s30*s30 as double)/(n30*(n30-1))) + 0.5)/10.0 end as temp_30d_stddev,
          case when n30 < 2 and abs(mean*n7 - s7) > 200*n7 then 'EXTREME' when n30 < 2 and abs(mean*n7 - s7) > 100*n7 then 'MODERATE'
               when n30 < 2 then 'NORMAL'
               when (mean*n7 - s7)*(mean*n7 - s7)*n30*(n30-1) > 4*n7*n7*(n30*q30 - s30*s30) then 'EXTREME'
               when (mean*n7 - s7)*(mean*n7 - s7)*n30*(n30-1) > n7*n7*(n30*q30 - s30*s30) then 'MODERATE' else 'NORMAL' end as anomaly_flag
        from framed join stations using (station_id)""",
    ("framed", """select station_id, d, f_mean, mean, count(*) over w as n7, cast(sum(mean) over w as bigint) as s7,
          count(*) over m as n30, cast(sum(mean) over m as bigint) as s30, cast(sum(mean*mean) over m as bigint) as q30
        from daily where mean is not null
        window w as (partition by station_id order by d rows 6 preceding), m as (partition by station_id order by d rows 29 preceding)"""),
)
STREAKS = (
    ("runs", """select station_id, wet, min(d) as streak_start, max(d) as streak_end, count(*) as streak_days, sum(coalesce(rain, 0)) as total
        from (select station_id, d, rain, wet, d - cast(row_number() over (partition by station_id, wet order by d) as integer) as g
              from (select station_id, d, rain, case when coalesce(rain, 0) > 0 then 1 else 0 end as wet from daily))
        group by station_id, wet, g having count(*) >= 3"""),
    ("streaks", """select station_id, name as station_name, case when wet = 1 then 'WET' else 'DRY' end as streak_type,
          streak_start, streak_end, streak_days, cast(total/100.0 as double) as total_precip_in,
          rank() over (partition by station_id, wet order by streak_days desc) as streak_rank
        from runs join stations using (station_id)"""),
)
SQL["wet_dry_streaks"] = sql("select * from streaks", *STREAKS)
SQL["top_streaks"] = sql(
    "select * from streaks where streak_type = 'DRY' order by streak_days desc, station_id, streak_start limit 50", *STREAKS
)
SQL["top_anomalies"] = SQL["temp_anomalies"] + (
    " where (mean*n7 - s7)*(mean*n7 - s7)*n30*(n30-1) > 4*n7*n7*(n30*q30 - s30*s30) and n30 > 1"
    " order by abs(temp_anomaly) desc, station_id, observation_date limit 50"
)
MONTHLY = f"""select station_id, name as station_name, covers, cast(year(d) as bigint) as year, cast(month(d) as bigint) as month_num,
      strftime(d, '%b') as month_name, count(*) as total_days,
      count(*) filter (pour = 'green') as pour_green, count(*) filter (pour = 'yellow') as pour_yellow,
      count(*) filter (pour = 'red') as pour_red, {pct("count(*) filter (pour = 'green')", 'count(*)')} as pct_pour_green,
      count(*) filter (seal = 'green') as sealer_green, {pct("count(*) filter (seal = 'green')", 'count(*)')} as pct_sealer_green,
      case when count(hi) > 0 then {half_up('cast(sum(hi) as bigint)', 'count(hi)', '10.0')} end as avg_high,
      case when count(lo) > 0 then {half_up('cast(sum(lo) as bigint)', 'count(lo)', '10.0')} end as avg_low,
      cast({half_up('cast(sum(coalesce(rain, 0)) as bigint)', '10', '10.0')} as double) as total_precip_in,
      count(*) filter (rain > 0) as rainy_days
    from daily join stations using (station_id) group by 1, 2, 3, 4, 5, 6"""
SQL["monthly_viability"] = sql(MONTHLY)
SQL["seasonal_year"] = sql(MONTHLY.replace("from daily join", "from (select * from daily where year(d) = 1999) join"))
COVERAGE = (
    ("span", "select cast(max(d) - min(d) + 1 as bigint) as n from daily"),
    ("coverage", f"""select s.station_id, s.name as station_name, s.covers, count(distinct d) as days_with_data, any_value(n) as expected_days,
          {pct('count(distinct d)', 'any_value(n)')} as coverage_pct,
          count(*) filter (hi is null) as missing_temp, count(*) filter (rain is null) as missing_precip,
          count(*) filter (wmax is null) as missing_wind, min(d) as first_date, max(d) as last_date,
          any_value(n) - count(distinct d) as gap_days
        from stations s left join daily using (station_id) cross join span group by 1, 2, 3"""),
)
SQL["coverage_audit"] = sql("select * from coverage", *COVERAGE)
SQL["date_spine_gaps"] = sql(
    """select cast(e as date) as expected_date, count(distinct station_id) as stations_reporting
       from (select unnest(generate_series((select min(d) from daily), (select max(d) from daily), interval 1 day)) as e)
       left join daily on daily.d = cast(e as date) group by 1"""
)
YOY = (
    ("monthly", f"""select station_id, year(d) as y, month(d) as m, {half_up('cast(sum(mean) as bigint)', 'count(*)', '1')} as t,
          sum(coalesce(rain, 0)) as p, count(*) filter (pour = 'green') as g, count(*) as n
        from daily where mean is not null group by 1, 2, 3"""),
    ("yoy", """select station_id, name as station_name, cast(y as bigint) as year, cast(m as bigint) as month,
          strftime(make_date(2000, m, 1), '%b') as month_name, t/10.0 as avg_temp, cast(p/100.0 as double) as total_precip,
          g as green_days, n as total_days, lag(t) over w / 10.0 as prev_year_avg_temp,
          (t - lag(t) over w)/10.0 as temp_change_yoy, lag(g) over w as prev_year_green_days
        from monthly join stations using (station_id) window w as (partition by station_id, m order by y)"""),
)
SQL["year_over_year"] = sql("select * from yoy", *YOY)
SQL["yearly_change"] = sql("select * from yoy where prev_year_avg_temp is not null", *YOY)
WEEKS = (
    ("five", """select station_id, d, sum(case when pour = 'green' then 1 else 0 end) over w as g,
          sum(case when pour = 'red' then 1 else 0 end) over w as r, cast(sum(hi) over w as bigint) as s, count(hi) over w as n
        from daily where pour is not null window w as (partition by station_id order by d rows 4 preceding)"""),
    ("weeks", f"""select station_id, name as station_name, d - 4 as week_starting, d as week_ending,
          cast(g as bigint) as green_in_5day, cast(r as bigint) as red_in_5day,
          case when n > 0 then {half_up('s', 'n', '10.0')} end as avg_high_5day,
          rank() over (partition by station_id, year(d) order by g desc, r) as year_rank
        from five join stations using (station_id) where g >= 3"""),
)
SQL["best_work_weeks"] = sql("select * from weeks", *WEEKS)
SQL["top_weeks"] = sql(
    """select * from weeks where year_rank <= 10
       order by green_in_5day desc, avg_high_5day desc nulls first, station_id, week_ending limit 50""", *WEEKS
)
PAIRS = f"""select station_a, station_b, sa.name as station_a_name, sb.name as station_b_name, n as compared_days,
         {half_up('ad', 'n', '10.0')} as avg_temp_diff_f, md/10.0 as max_temp_diff_f, dis as score_disagree_days,
         {pct('dis', 'n')} as pct_disagree,
         round(cast(n*sab - sa_ * sb_ as double) / nullif(sqrt(cast(n*saa - sa_*sa_ as double)) * sqrt(cast(n*sbb - sb_*sb_ as double)), 0), 3) as temp_correlation
       from paired join stations sa on sa.station_id = station_a join stations sb on sb.station_id = station_b"""
PAIRED = ("paired", """select a.station_id as station_a, b.station_id as station_b, count(*) as n,
          cast(sum(abs(a.hi - b.hi)) as bigint) as ad, max(abs(a.hi - b.hi)) as md,
          count(*) filter (a.pour <> b.pour) as dis, sum(a.hi) as sa_, sum(b.hi) as sb_, sum(a.hi*a.hi) as saa,
          sum(b.hi*b.hi) as sbb, sum(a.hi*b.hi) as sab
        from daily a join daily b on a.d = b.d and a.station_id < b.station_id
        where a.hi is not null and b.hi is not null group by 1, 2""")
SQL["station_pairs"] = sql(PAIRS, PAIRED)
SQL["pair_report"] = sql(PAIRS + " where sa.state = sb.state", PAIRED)
SQL["season_bounds"] = sql(
    """select station_id, name as station_name, cast(y as bigint) as year, min(d) filter (up <= 5) as season_start_approx,
         max(d) filter (down <= 5) as season_end_approx,
         cast(max(d) filter (down <= 5) - min(d) filter (up <= 5) as bigint) as season_length_days,
         count(*) filter (pour = 'green') as total_green_days, count(*) filter (pour = 'yellow') as total_yellow_days
       from (select *, year(d) as y, row_number() over (partition by station_id, year(d) order by d) as up,
               row_number() over (partition by station_id, year(d) order by d desc) as down
             from daily where pour in ('green', 'yellow') and dayofyear(d) between 60 and 340)
       join stations using (station_id) group by 1, 2, 3"""
)
JOB_WEATHER = f"""select j.job_id, lead_name, address, job_type, concrete_type, start_date, completion_date,
      cast(duration as bigint) as job_duration_days, cents/100.0 as final_revenue, cast(area as bigint) as square_footage,
      per_sqft as revenue_per_sqft, cast(coats as bigint) as sealer_coats, s.name as station_name,
      case when count(hi) > 0 then {half_up('cast(sum(hi) as bigint)', 'count(hi)', '10.0')} end as avg_high,
      case when count(lo) > 0 then {half_up('cast(sum(lo) as bigint)', 'count(lo)', '10.0')} end as avg_low,
      cast(sum(coalesce(rain, 0))/100.0 as double) as total_precip_in, count(*) filter (rain > 0) as rainy_days,
      count(*) filter (rain is null) as missing_precip_days, count(*) filter (pour = 'green') as green_days,
      count(*) filter (pour = 'yellow') as yellow_days, count(*) filter (pour = 'red') as red_days,
      max(wmax)/10.0 as max_wind_mph, max(hi) filter (d = start_date)/10.0 as pour_day_high,
      max(rain) filter (d = start_date)/100.0 as pour_day_precip, max(pour) filter (d = start_date) as pour_day_score
    from staged_jobs j join stations s using (station_id)
      join daily w on w.station_id = j.station_id and w.d between start_date and completion_date group by all"""
SQL["job_weather"] = sql(JOB_WEATHER)
JOB_DAYS = """select j.job_id, j.station_id, d as observation_date, f_hi as temp_max_f, f_lo as temp_min_f, f_rain as precip_in,
      f_wmax as wind_max_mph, pour as pour_score, seal as sealer_score
    from staged_jobs j join daily w on w.station_id = j.station_id and w.d between start_date and completion_date"""
SQL["job_days"] = sql(JOB_DAYS)
SQL["one_job"] = sql(JOB_DAYS + " where j.job_id = (select min(job_id) from staged_jobs j2 join daily w2 on w2.station_id = j2.station_id and w2.d = j2.start_date where completion_date is not null and area % 5 = 4)")
SQL["point_lookup"] = sql(
    f"""select {DAILY_COLUMNS}, pour as pour_score, seal as sealer_score from daily
        where station_id = (select min(station_id) from stations) and d = (select min(d) from daily where station_id = (select min(station_id) from stations))"""
)

# --- hours -----------------------------------------------------------------------------------

NAMES = ["temperature", "humidity", "wind", "precipitation", "dewpoint", "data"]
HOUR_TEXT = text_of([(n, f"f_{n}") for n in NAMES])
HOUR_COLUMNS = """station_id, time, cast(hour as bigint) as hour, t10/10.0 as temp_f, cast(hum as double) as humidity_pct,
  d10/10.0 as dewpoint_f, cast(prob as double) as precip_prob_pct, p100/100.0 as precip_in, w10/10.0 as wind_mph,
  {gust} as wind_gust_mph, cast(cloud as double) as cloud_cover_pct"""
SQL["flatten_forecast"] = sql(
    f"select {HOUR_COLUMNS.format(gust='case when right(station_id, 1) <> chr(51) then g10/10.0 end')} from hourly"
)
SQL["quarantine"] = sql(
    """select station_id, case when k % 11 = 0 then 0 when k % 7 = 0 then n - d else n end as hours_read,
         case when k % 11 = 0 then d else 0 end as broken_documents, case when k % 11 <> 0 and k % 7 = 0 then d else 0 end as broken_hours
       from (select station_id, cast(substr(station_id, 2) as bigint) as k, count(*) as n, count(distinct cast(time as date)) as d from hourly group by 1, 2)"""
)
SITES = ("sites", "select station_id, cast(substr(station_id, 2) as bigint) as k, count(*) as n, count(distinct cast(time as date)) as d from hourly group by 1, 2")
WARNED = ("warned", "select areas, onset, min(seq) as id, count(*) as n from alert_rows group by 1, 2")
TALLY = ("tally", """select 'forecast' as kind, sum(case when k % 11 = 0 then 0 when k % 7 = 0 then n - d else n end) as r,
      sum(case when k % 11 = 0 then d else 0 end) as w, sum(case when k % 11 <> 0 and k % 7 = 0 then d else 0 end) as e from sites
    union all select 'current', count(*) filter (seq % 11 <> 0 and seq % 7 <> 0), count(*) filter (seq % 11 = 0 or seq % 7 = 0), 0 from readings
    union all select 'alerts', coalesce(sum(n) filter (id % 11 <> 0), 0), count(*) filter (id % 11 = 0), 3 * count(*) filter (id % 11 <> 0 and id % 7 = 0) from warned""")
SQL["stream_quarantine"] = sql(
    """select kind, cast(r as bigint) as entries_read, cast(w as bigint) as documents_aside, cast(e as bigint) as entries_aside,
         cast(r as bigint) as counted_read, cast(w + e as bigint) as counted_aside from tally""", SITES, WARNED, TALLY
)
SQL["flatten_history"] = SQL["flatten_forecast"].replace("cast(prob as double) as precip_prob_pct", "cast(null as double) as precip_prob_pct")
SQL["hourly_pour"] = sql(f"select station_id, time, {label('sev')} as pour_score, {HOUR_TEXT} as pour_factors from graded")
WORK = "hour >= 7 and hour < 17"
DAYS = f"""select station_id, cast(time as date) as date,
      case when count(sev) filter ({WORK}) = 0 then null
           when max(sev) filter ({WORK}) = 3 then 'red'
           when max(sev) filter ({WORK}) = 2 or count(sev) filter ({WORK}) < count(*) filter ({WORK}) then 'yellow' else 'green' end as score,
      max(t10)/10.0 as temp_high_f, min(t10)/10.0 as temp_low_f, count(*) filter ({WORK}) as working_hours,
      count(*) filter ({WORK}) - count(sev) filter ({WORK}) as unscored_hours
    from SOURCE group by 1, 2"""
SQL["day_verdicts"] = sql(DAYS.replace("SOURCE", "graded"))


def windows(source: str) -> tuple[tuple[str, str], ...]:
    def runs(limit: int) -> str:
        return f"""select station_id, date, {limit} as kind, count(*) as len, min(pos) as pos, min_by(hour, pos) as start_hour
          from (select *, pos - row_number() over (partition by station_id, date order by pos) as g
                from (select station_id, cast(time as date) as date, hour, sev,
                        row_number() over (partition by station_id, cast(time as date) order by time) as pos from {source})
                where {WORK} and sev <= {limit})
          group by station_id, date, g"""

    clock = lambda h: f"(case when ({h}) % 12 = 0 then 12 else ({h}) % 12 end || case when ({h}) < 12 then 'a' else 'p' end)"
    return (
        ("all_runs", runs(1) + " union all " + runs(2)),
        ("win", f"""select station_id, date, cast(start_hour as bigint) as window_start, len as window_hours,
              printf('%02d:00-%02d:00', start_hour, start_hour + len) as best_window,
              {clock('start_hour')} || '-' || {clock('start_hour + len')} as best_window_label
            from (select *, row_number() over (partition by station_id, date order by kind, len desc, pos) as pick from all_runs)
            where pick = 1"""),
    )


SQL["best_window"] = sql("select * from win", *windows("graded"))
SQL["best_window_overall"] = sql(
    """select station_id, date, best_window, best_window_label, window_hours
       from (select *, row_number() over (partition by station_id order by window_hours desc, date) as p from win) where p = 1""",
    *windows("ahead"),
)
SQL["outlook_days"] = sql(
    """select station_id, cast(time as date) as date, min(place) > 48 as outlook from placed group by 1, 2"""
)

F0 = lambda x: f"printf('%.0f', {x})"
H12 = lambda h: f"(case when ({h}) % 12 = 0 then 12 else ({h}) % 12 end || case when ({h}) < 12 then 'am' else 'pm' end)"
REASONS = (
    ("off", " union all ".join(
        f"select station_id, cast(time as date) as date, hour, t10/10.0 as t, cast(hum as double) as hum, w10/10.0 as w, cast(prob as double) as prob, "
        f"t10/10.0 - d10/10.0 as gap, '{n}' as factor, {i} as rank, f_{n} as fs from ahead where {WORK} and f_{n} > 1"
        for i, n in enumerate(["precipitation", "temperature", "wind", "humidity", "dewpoint", "data"])
    )),
    ("worst", """select station_id, date, factor, rank, fs, count(distinct hour) as n, min(hour) as a, max(hour) as b, list_sort(list(distinct hour)) as hs,
          max(prob) as prob, min(t) as lo, max(t) as hi, max(w) as w, max(hum) as humid, min(hum) as dry, min(gap) as gap
        from (select *, max(fs) over (partition by station_id, date, factor) as m from off) where fs = m group by 1, 2, 3, 4, 5"""),
    ("spans", f"""select *, case when n = 10 then 'all day'
          when b - a + 1 = n and a = 7 then 'before ' || {H12('b+1')} when b - a + 1 = n and b = 16 then 'after ' || {H12('a')}
          when b - a + 1 = n then {H12('a')} || '-' || {H12('b+1')}
          when n <= 3 then array_to_string(list_transform(hs, lambda x: {H12('x')}), ', ')
          else {H12('a')} || '-' || {H12('b+1')} || ', on and off' end as span from worst"""),
    ("told", f"""select station_id, date, fs, rank, case factor
          when 'precipitation' then case when prob is null then 'Rain risk ' || span
             else (case when fs = 3 then 'Rain likely' else 'Rain possible' end) || ' — ' || {F0('prob')} || '% chance ' || span end
          when 'temperature' then case when lo is null then 'Temperature out of range ' || span
             when lo < 50 then (case when fs = 3 then 'Too cold' else 'Cold' end) || ' — ' || {F0('lo')} || '°F ' || span
             else (case when fs = 3 then 'Too hot' else 'Hot' end) || ' — ' || {F0('hi')} || '°F ' || span end
          when 'wind' then (case when fs = 3 then 'High wind' else 'Breezy' end) || ' — ' || {F0('w')} || 'mph ' || span
          when 'humidity' then case when humid > 70 then 'Humid — ' || {F0('humid')} || '% ' || span
             else 'Very dry air — ' || {F0('dry')} || '% ' || span || ' (surface may crust)' end
          when 'dewpoint' then 'Dew point within ' || {F0('gap')} || '°F of air temp ' || span || ' — slow drying'
          else 'Missing forecast data ' || span end as text from spans"""),
    ("lines", "select station_id, date, list(text order by fs desc, rank) as r from told group by 1, 2"),
    ("verdicts", DAYS.replace("SOURCE", "ahead")),
)
SQL["day_reasons"] = sql(
    """select v.station_id, v.date, case (v.date - date '2024-01-15') when 0 then 'Today' when 1 then 'Tomorrow' when -1 then 'Yesterday'
           else strftime(v.date, '%a') end as label, v.score, v.temp_high_f, v.temp_low_f, w.best_window, w.best_window_label, w.window_hours,
         case when working_hours = unscored_hours then 'No forecast data for working hours — treat as no-go'
              else concat_ws('|', array_to_string(r, '|'),
                case when unscored_hours > 0 and len(list_filter(coalesce(r, []), lambda x: starts_with(x, 'Missing'))) = 0
                     then 'Missing data for ' || unscored_hours || ' working hour(s)' end) end as reasons,
         (select min(place) from placed p where p.station_id = v.station_id and cast(p.time as date) = v.date) > 48 as outlook
       from verdicts v left join win w using (station_id, date) left join lines l using (station_id, date)""",
    *windows("ahead"), *REASONS,
)
SQL["day_reasons"] = SQL["day_reasons"].replace("concat_ws('|', array_to_string(r, '|'),", "concat_ws('|', nullif(array_to_string(r, '|'), ''),")

TRUSTED = """case when (recent >= 20 and known >= recent - 2) or coalesce(rain, 0) >= 10 then coalesce(rain, 0)/100.0 end as rain24,
  case when probs >= 20 or prob >= 40 then cast(prob as double) end as prob24,
  case when temps >= 10 or low < 500 then low/10.0 end as low12"""
ROLLING = (
    ("rolled", """select station_id, time, t10 as c_t, hum as c_hum, d10 as c_d, w10 as c_w,
          count(*) over past as recent, count(p100) over past as known, sum(p100) over past as rain,
          min(t10) over past as past_lo, max(t10) over past as past_hi, max(hum) over past as past_hum,
          count(prob) over nxt as probs, max(prob) over nxt as prob, count(t10) over soon as temps, min(t10) over soon as low
        from hourly window past as (partition by station_id order by time range between interval 24 hours preceding and current row),
          nxt as (partition by station_id order by time rows between current row and 23 following),
          soon as (partition by station_id order by time rows between current row and 11 following)"""),
    ("inputs", f"select station_id, time, c_t, c_hum, c_d, c_w, past_lo, past_hi, past_hum, {TRUSTED} from rolled"),
)
INPUT_COLUMNS = """c_t/10.0 as temp_f, cast(c_hum as double) as humidity_pct, c_d/10.0 as dewpoint_f, c_w/10.0 as wind_mph,
  cast(rain24 as double) as rain_last_24h, prob24 as prob_next_24h, low12 as low_next_12h, past_lo/10.0 as temp_low_f,
  past_hi/10.0 as temp_high_f, cast(past_hum as double) as max_humidity_pct"""
SQL["rolling_site_inputs"] = sql(f"select station_id, time, {INPUT_COLUMNS} from inputs", *ROLLING)
SQL["rolling_half_hours"] = sql(
    """select station_id, time, case when (recent >= 20 and known >= recent - 2) or total >= 10 then coalesce(total, 0)/100.0 end as rain_last_24h,
         lo/10.0 as temp_low_f, hi/10.0 as temp_high_f
       from (select station_id, time, count(*) over w as recent, count(p100) over w as known, coalesce(sum(p100) over w, 0) as total, min(t10) over w as lo, max(t10) over w as hi
             from (select station_id, time, p100, t10 from hourly union all select station_id, time + interval 30 minutes, p100, t10 from hourly)
             window w as (partition by station_id order by time range between interval 24 hours preceding and current row))"""
)
SEALER_FACTORS = """
  case when c_t is null then null when c_t between 500 and 900 then 1 when c_t >= 400 and c_t < 500 then 2 else 3 end as g_temperature,
  case when low12 is null then null when low12 >= 50 then 1 when low12 >= 40 then 2 else 3 end as g_cure_temp,
  case when c_w is null then null when c_w < 100 then 1 when c_w < 150 then 2 else 3 end as g_wind,
  case when c_hum is null then null when c_hum < 70 then 1 when c_hum < 85 then 2 else 3 end as g_humidity,
  case when rain24 is null then null when rain24 < 0.005 then 1 when rain24 < 0.1 then 2 else 3 end as g_rain_last_24h,
  case when prob24 is null then null when prob24 < 10 then 1 when prob24 < 40 then 2 else 3 end as g_rain_next_24h,
  case when c_t/10.0 - c_d/10.0 is null then null when c_t/10.0 - c_d/10.0 > 10 then 1 when c_t/10.0 - c_d/10.0 > 5 then 2 else 3 end as g_dewpoint
"""
SEALER_WORST = "greatest(g_temperature, g_cure_temp, g_wind, g_humidity, g_rain_last_24h, g_rain_next_24h, g_dewpoint)"
SEALER_DATA = f"case when (c_t is null or c_hum is null or rain24 is null or prob24 is null or c_w is null or low12 is null) and {SEALER_WORST} is not null then 2 end"
SEALED = ("sealed", f"select *, {SEALER_DATA} as g_data, {label(f'greatest({SEALER_WORST}, {SEALER_DATA})')} as verdict from (select *, {SEALER_FACTORS} from inputs)")
SEALER_NAMES = ["temperature", "cure_temp", "wind", "humidity", "rain_last_24h", "rain_next_24h", "dewpoint", "data"]
SEALER_TEXT = text_of([(n, f"g_{n}") for n in SEALER_NAMES])
SQL["hourly_sealer"] = sql(f"select station_id, time, verdict as sealer_score, {SEALER_TEXT} as sealer_factors from sealed", *ROLLING, SEALED)


def bad(n: str, red: str, yellow: str, value: str, tail: str, guard: str | None = None) -> str:
    return f"case when g_{n} > 1 and {guard or value} is not null then (case when g_{n} = 3 then '{red}' else '{yellow}' end) || {value} || '{tail}' end"


SEALER_REASONS = "concat_ws('|', " + ", ".join(
    [
        """case when g_rain_last_24h = 3 then printf('%.2f', rain24) || '" rain in last 24h — slab needs to dry'
               when g_rain_last_24h = 2 then 'Trace rain in last 24h (' || printf('%.2f', rain24) || '") — check the slab is dry' end""",
        bad("rain_next_24h", "Rain likely in next 24h — ", "Rain possible in next 24h — ", F0("prob24"), "% chance"),
        bad("cure_temp", "Too cold overnight — dropping to ", "Cool overnight — dropping to ", F0("low12"), "°F while it cures"),
        bad("temperature", "Too cold to apply — ", "Cold to apply — ", F0("c_t/10.0"), "°F right now"),
        bad("wind", "Too windy — ", "Breezy — ", F0("c_w/10.0"), "mph (overspray and debris)"),
        bad("humidity", "Too humid — ", "Humid — ", F0("cast(c_hum as double)"), "% (slow cure)"),
        f"case when g_dewpoint > 1 then 'Dew point within ' || {F0('c_t/10.0 - c_d/10.0')} || '°F of air temp — condensation risk' end",
        "case when g_data = 2 then 'Some readings unavailable — verdict capped at caution' end",
    ]
) + ")"
SEALER_VERDICT = "case verdict when 'green' then 'SAFE TO SEAL' when 'yellow' then 'USE CAUTION' when 'red' then 'DO NOT SEAL' else 'NO DATA — DO NOT SEAL' end"
DETAILS = "concat_ws('|', " + ", ".join(
    [
        "case when rain24 is null then 'Rain in last 24h: unknown (missing data)' when rain24 = 0 then 'No rain in last 24h' else 'Rain in last 24h: ' || printf('%.2f', rain24) || ' in' end",
        f"'Temp range: ' || {F0('past_lo/10.0')} || '-' || {F0('past_hi/10.0')} || '°F'",
        f"'Current humidity: ' || {F0('cast(c_hum as double)')} || '%'",
        f"'Current wind: ' || {F0('c_w/10.0')} || ' mph'",
        f"'Low next 12h: ' || {F0('low12')} || '°F'",
        f"'Max rain chance next 24h: ' || {F0('prob24')} || '%'",
        "'Dew point spread: ' || printf('%.1f', c_t/10.0 - c_d/10.0) || '°F'",
    ]
) + ")"
SQL["sealer_reasons"] = sql(
    f"select station_id, time, verdict as sealer_score, {SEALER_VERDICT} as verdict, {SEALER_REASONS} as reasons, {DETAILS} as details from sealed",
    *ROLLING, SEALED,
)
SQL["sealer_check"] = sql(
    f"""select station_id, {INPUT_COLUMNS}, verdict as sealer_score, {SEALER_VERDICT} as verdict, {SEALER_REASONS} as reasons, {DETAILS} as details from sealed""",
    ("past", f"""select station_id, count(*) as recent, count(p100) as known, sum(p100) as rain, min(t10) as past_lo, max(t10) as past_hi,
          max(hum) as past_hum, max(time) as last_time from hourly
        where time between {AS_OF} - interval 24 hours and {AS_OF} group by 1"""),
    ("soon24", """select station_id, count(prob) as probs, max(prob) as prob, count(t10) filter (place <= 12) as temps,
          min(t10) filter (place <= 12) as low from placed where place <= 24 group by 1"""),
    ("site_now", """select s.station_id, h.t10 as c_t, h.hum as c_hum, h.d10 as c_d, h.w10 as c_w, past_lo, past_hi, past_hum,
          coalesce(recent, 0) as recent, coalesce(known, 0) as known, rain, coalesce(probs, 0) as probs, n.prob, coalesce(temps, 0) as temps, low
        from (select station_id from stations union select station_id from past union select station_id from soon24) s
          left join past p on p.station_id = s.station_id left join soon24 n on n.station_id = s.station_id
          left join hourly h on h.station_id = p.station_id and h.time = p.last_time"""),
    ("inputs", f"select *, {TRUSTED} from site_now"),
    SEALED,
)

CURE_BODY = f"""select KEYS, verdict_name as score,
      case verdict_name when 'green' then 'SAFE TO POUR & CURE' when 'yellow' then 'POUR WITH CAUTION' when 'red' then 'DO NOT POUR' else 'NO DATA — DO NOT POUR' end as verdict,
      {text_of([('freeze_risk', 'c_freeze'), ('rain_during_cure', 'c_rain'), ('heat_stress', 'c_heat'), ('wind_drying', 'c_wind'), ('data', 'c_data')])} as factors,
      case when not usable then 'No usable forecast data — cannot assess cure window' else concat_ws('|',
        case c_freeze when 2 then 'Temp drops to ' || {F0('low/10.0')} || '°F — consider blankets/enclosures'
                      when 3 then 'Freeze risk: low of ' || {F0('low/10.0')} || '°F — concrete will not cure properly' end,
        case first_day when 2 then 'Rain chance up to ' || {F0('cast(coalesce(prob_1, 0) as double)')} || '% in first 24h — have tarps ready'
                       when 3 then 'Rain likely (' || {F0('cast(coalesce(prob_1, 0) as double)')} || '%) in first 24h — will damage fresh surface' end,
        case when second_day then 'Rain likely in hours 24-48 (' || {F0('cast(prob_2 as double)')} || '%) — less critical but monitor' end,
        case c_heat when 2 then 'High of ' || {F0('high/10.0')} || '°F — mist cure or apply curing compound'
                    when 3 then 'Extreme heat (' || {F0('high/10.0')} || '°F) — rapid moisture loss, high crack risk' end,
        case c_sus when 2 then 'Sustained wind to ' || {F0('wind_1/10.0')} || 'mph — accelerates surface drying'
                   when 3 then 'High sustained wind (' || {F0('wind_1/10.0')} || 'mph) — significant surface drying and crack risk' end,
        case c_gust when 2 then 'Wind gusts to ' || {F0('gust_1/10.0')} || 'mph — accelerates surface drying'
                    when 3 then 'Severe wind gusts (' || {F0('gust_1/10.0')} || 'mph) — high surface-drying and crack risk' end,
        case when c_data = 2 then 'Missing forecast data (' || miss || ') — treat with caution' end) end as issues,
      hours, low/10.0 as temp_low_f, high/10.0 as temp_high_f
    from (select *, {label('greatest(c_freeze, c_rain, c_heat, c_wind, c_data)')} as verdict_name from cured)"""
CURED = (
    ("cure_1", """select *, coalesce(low, prob_1, rain_1, wind_1) is not null as usable,
          case when prob_1 is null and rain_1 is null then null when coalesce(prob_1, 0) < 15 and coalesce(rain_1, 0) < 10 then 1
               when coalesce(prob_1, 0) < 40 then 2 else 3 end as first_day,
          concat_ws(', ', case when low is null then 'temperature' end, case when prob_1 is null or rain_1 is null then 'precipitation' end,
               case when wind_1 is null then 'wind' end) as miss,
          case when wind_1 is null then null when wind_1 < 150 then 1 when wind_1 < 250 then 2 else 3 end as c_sus,
          case when gust_1 is null then null when gust_1 < 250 then 1 when gust_1 < 350 then 2 else 3 end as c_gust from cure_w"""),
    ("cure_2", "select *, coalesce(prob_2 >= 40, false) and coalesce(first_day <> 3, true) as second_day from cure_1"),
    ("cured", """select *,
          case when usable and low is not null then case when low >= 500 then 1 when low >= 400 then 2 else 3 end end as c_freeze,
          case when usable then case when second_day then 2 else first_day end end as c_rain,
          case when usable and high is not null then case when high <= 900 then 1 when high <= 950 then 2 else 3 end end as c_heat,
          case when usable then greatest(c_sus, c_gust) end as c_wind, case when usable and miss <> '' then 2 end as c_data from cure_2"""),
)
SQL["cure_window"] = sql(
    CURE_BODY.replace("KEYS", "station_id, time"),
    ("cure_w", """select station_id, time, count(*) over b as hours, min(t10) over b as low, max(t10) over b as high,
          max(prob) over d1 as prob_1, sum(p100) over d1 as rain_1, max(prob) over d2 as prob_2, max(w10) over d1 as wind_1, max(g10) over d1 as gust_1
        from hourly window b as (partition by station_id order by time rows between current row and 47 following),
          d1 as (partition by station_id order by time rows between current row and 23 following),
          d2 as (partition by station_id order by time rows between 24 following and 47 following)"""),
    *CURED,
)
SQL["cure_check"] = sql(
    CURE_BODY.replace("KEYS", "station_id"),
    ("cure_s", """select station_id, count(*) as hours, min(t10) as low, max(t10) as high, max(prob) filter (place <= 24) as prob_1,
          sum(p100) filter (place <= 24) as rain_1, max(prob) filter (place > 24) as prob_2, max(w10) filter (place <= 24) as wind_1,
          max(g10) filter (place <= 24) as gust_1 from placed where place <= 48 group by 1"""),
    ("cure_w", """select coalesce(c.station_id, s.station_id) as station_id, coalesce(c.hours, 0) as hours, c.* exclude (station_id, hours)
        from cure_s c full join stations s on s.station_id = c.station_id"""),
    *CURED,
)

# --- alerts, streams, snapshots --------------------------------------------------------------

SQL["alert_filter"] = sql(
    """select seq, alert_id, event, headline, severity, 'Expected' as urgency, areas, onset, onset as expires, left(description, 300) as description,
         cast(case severity when 'Extreme' then 0 when 'Severe' then 1 when 'Moderate' then 2 when 'Minor' then 3 else 4 end as bigint) as severity_rank
       from relevant_alerts"""
)
SQL["parse_alerts"] = sql(
    """select alert_id, event, headline, severity, areas, onset, left(description, 300) as description,
         cast(case severity when 'Extreme' then 0 when 'Severe' then 1 when 'Moderate' then 2 when 'Minor' then 3 else 4 end as bigint) as severity_rank
       from relevant_alerts"""
)
DEDUP = (
    ("arrivals", """select alert_id, arrived, min(seq) as seq from (select *, cast(floor(epoch(ts)) as bigint) as arrived from relevant_alerts) group by 1, 2"""),
    ("chain", """select alert_id, min(arrived) as arrived from arrivals group by 1
        union all
        select c.alert_id, (select min(a.arrived) from arrivals a where a.alert_id = c.alert_id and a.arrived >= c.arrived + 86400) as arrived
        from chain c where c.arrived is not null"""),
)
SQL["alert_dedup"] = sql(
    """select c.alert_id, c.arrived, a.seq, r.event, r.severity, left(r.description, 500) as description
       from chain c join arrivals a on a.alert_id = c.alert_id and a.arrived = c.arrived join relevant_alerts r on r.seq = a.seq""",
    *DEDUP,
)
SQL["stream_alerts"] = SQL["alert_dedup"]
CHANGES = ("changes", f"""select station_id, ts, seq, {label('sev')} as pour_score,
      lag({label('sev')}) over (partition by station_id order by ts, seq) as previous_score from readings""")
SQL["verdict_changes"] = sql(
    """select station_id, ts, seq, pour_score, previous_score,
         previous_score is not null and previous_score is distinct from pour_score as score_changed from changes""", CHANGES
)
SQL["stream_changes"] = SQL["verdict_changes"]
T = lambda x: f"coalesce(cast({x} as varchar), '')"
J = lambda n, x: f"""'"{n}":"' || {x} || '"'"""
READING = {"temp_f": "t10/10.0", "humidity_pct": "cast(hum as double)", "wind_mph": "w10/10.0", "wind_gust_mph": "g10/10.0",
           "dewpoint_f": "d10/10.0", "cloud_cover_pct": "cast(cloud as double)", "precip_in": "p100/100.0"}
LIVE = ("live", f"""select *, coalesce({label('sev')}, '') as verdict,
      lag({label('sev')}) over (partition by station_id order by ts, seq) as previous_score from readings""")
CHANGED = f"previous_score is not null and previous_score is distinct from {label('sev')}"
SQL["live_updates"] = sql(
    "select station_id, ts, '{' || "
    + " || ',' || ".join(
        [J("type", "'weather_update'"), J("station", "station_id"), J("station_name", "'site ' || site")]
        + [J(n, T(READING[n])) for n in ("temp_f", "humidity_pct", "wind_mph", "dewpoint_f", "cloud_cover_pct")]
        + [J("pour_score", "verdict"), f"""'"score_changed":' || cast({CHANGED} as varchar)"""]
    )
    + " || '}' as payload from live",
    LIVE,
)
PUBLISHED = "chain c join arrivals a on a.alert_id = c.alert_id and a.arrived = c.arrived join relevant_alerts r on r.seq = a.seq"
SQL["live_alerts"] = sql(
    "select c.alert_id, ts, '{' || "
    + " || ',' || ".join(
        [J("type", "'nws_alert'")]
        + [J(n, T(n)) for n in ("event", "headline", "severity", "areas", "onset")] + [J("expires", T("onset"))]
    )
    + f" || '}}' as payload from {PUBLISHED}",
    *DEDUP,
)
SQL["tail_streams"] = (
    "select ts, payload, 'weather' as stream from (" + SQL["live_updates"] + ") union all "
    "select ts, payload, 'alerts' as stream from (" + SQL["live_alerts"] + ")"
)
FACTOR_JSON = (
    "'{' || array_to_string(list_filter(["
    + ", ".join(f"""'"{n}": "' || ({label('f_' + n)}) || '"'""" for n in ("temperature", "humidity", "wind", "precipitation", "dewpoint", "data"))
    + "], lambda x: x is not null), ', ') || '}'"
)
SQL["weather_log"] = sql(
    "select station_id as station, 'site ' || site as station_name, cast(cast(floor(epoch(ts)) as bigint) as varchar) as timestamp, "
    + ", ".join(f"{T(x)} as {n}" for n, x in READING.items())
    + f", verdict as pour_score, {FACTOR_JSON} as pour_factors, case when {CHANGED} then '1' else '0' end as score_changed from live",
    LIVE,
)
SQL["current_conditions"] = sql(
    "select station_id, ts, seq, " + ", ".join(f"{x} as {n}" for n, x in READING.items()) + " from readings"
)
SQL["last_known"] = sql(
    f"""select station_id, ts, {label('sev')} as pour_score, t10/10.0 as temp_f, cast(hum as double) as humidity_pct, w10/10.0 as wind_mph
        from (select *, row_number() over (partition by station_id order by ts desc) as n from readings) where n = 1"""
)
SQL["keep_latest_n"] = sql(
    f"""select station_id, ts, seq, {label('sev')} as pour_score from
        (select *, row_number() over (partition by station_id order by ts desc, seq desc) as n from readings) where n <= 100"""
)
SQL["stream_health"] = (
    "with w as (select ts, row_number() over (order by ts desc) as n, payload from (" + SQL["live_updates"] + ")), "
    "a as (select ts, row_number() over (order by ts desc) as n, payload from (" + SQL["live_alerts"] + ")) "
    "select 'weather' as stream, count(*) as entries, max(ts) as last_ts, max(payload) filter (n = 1) as last_payload from w where n <= 1000 "
    "union all select 'alerts', count(*), max(ts), max(payload) filter (n = 1) from a where n <= 100"
)
SQL["bounded_log"] = sql(
    """select ts, seq, alert_id, event from (select *, row_number() over (order by ts desc, seq desc) as n from (
         select ts, seq, alert_id, event from alert_rows
         union all select ts - interval 36 hours, seq + 10000000, alert_id, event from alert_rows)) where n <= 100"""
)
SITES = (
    ("fed", "select distinct station_id, site as k from hourly"),
    ("listed", """select s.station_id, s.name, s.covers, coalesce(f.k % 13 <> 0, false) as has_forecast, f.k is not null as seen, f.k
        from stations s left join fed f on f.station_id = s.station_id"""),
)
SQL["forecast_answer"] = sql(
    f"""select s.station_id, s.name, s.covers, case when has_forecast then 'ok' else 'unavailable' end as status,
          case when has_forecast then k % 5 >= 3 end as stale,
          case when has_forecast then {AS_OF} - to_minutes(cast(k % 5 * 20 as bigint)) end as data_fetched_at,
          case when has_forecast then told.days end as days, case when has_forecast then best.date end as best_date,
          case when has_forecast then best.best_window end as best_window, case when has_forecast then best.window_hours end as best_hours,
          case when not seen or k % 7 = 0 then 'unknown' when warned.alerts is null then 'none' else 'active' end as alert_state,
          case when k % 7 <> 0 then warned.alerts end as alerts
        from listed s left join best using (station_id) left join told using (station_id)
          left join (select areas, string_agg(coalesce(event, ''), '|' order by
                       case severity when 'Extreme' then 0 when 'Severe' then 1 when 'Moderate' then 2 when 'Minor' then 3 else 4 end, seq) as alerts
                     from relevant_alerts where cast(ts as date) = date '2024-01-15' and cast(substr(areas, 6) as bigint) % 3 = 0 group by 1) warned
            on warned.areas = 'area ' || s.k""",
    *SITES,
    ("best", "select * from (" + SQL["best_window_overall"] + ")"),
    ("told", """select station_id, string_agg(line, '|' order by line) as days from (
          select station_id, date || ' ' || coalesce(score, 'no data') || ' ' || coalesce(best_window, '-') || case when outlook then ' outlook' else '' end as line
          from (""" + SQL["day_reasons"] + ")) group by 1"),
)
SQL["cure_answer"] = sql(
    f"""select s.station_id, case when has_forecast then c.hours else 0 end as hours, case when has_forecast then c.score end as score,
          case when has_forecast then c.verdict else 'NO DATA — DO NOT POUR' end as verdict,
          case when has_forecast then 'ok' else 'unavailable' end as status, case when has_forecast then k % 5 >= 3 or k % 4 = 3 end as stale,
          case when has_forecast then {AS_OF} - to_minutes(cast(greatest(k % 5 * 20, k % 4 * 10) as bigint)) end as data_fetched_at
        from listed s join checked c using (station_id)""",
    *SITES,
    ("checked", "select * from (" + SQL["cure_check"] + ")"),
)
SQL["latest_snapshot"] = sql(
    f"""select station_id, time as forecast_hour, t10/10.0 as temp_f, {label('sev')} as pour_score, fetched_at, false as stale
        from snapshots where fetched_at = timestamp '2024-01-15 08:30:00'"""
)

# --- table maintenance -----------------------------------------------------------------------

BASE = "select {c}, pour as pour_score, seal as sealer_score from daily".format(c=DAILY_COLUMNS)
SQL["upsert_daily"] = sql(
    f"""select * replace (case when year(observation_date) >= 2000 and substr(station_id, 11) in ('1', '4', '7') then 1.5 else temp_max_f end as temp_max_f)
        from ({BASE})
        union all by name
        select s.station_id, date '2002-06-01' as observation_date, cast(70 as double) as temp_max_f, cast(null as double) as temp_min_f, cast(null as double) as temp_mean_f,
          cast(null as double) as precip_in, cast(null as double) as snow_in, cast(null as double) as snow_depth_in, cast(null as double) as wind_avg_mph,
          cast(null as double) as wind_max_mph, 'yellow' as pour_score, cast(null as varchar) as sealer_score from stations s"""
)
SQL["append_new"] = sql(
    f"""select station_id, time as forecast_hour, fetched_at, {label('sev')} as pour_score from snapshots"""
)
SQL["retention"] = sql(
    f"""select station_id, time as forecast_hour, fetched_at, {label('sev')} as pour_score from snapshots
        where expires_at >= timestamp '2024-01-22 09:20:00' - interval 7 days"""
)
SQL["export_daily"] = sql(BASE)
SQL["export_stations"] = sql(
    """select station_id, name, covers, state, (k*37 % 900000)/10000.0 as latitude, (k*53 % 1800000)/-10000.0 as longitude from stations"""
)
SQL["export_jobs"] = sql(
    """select job_id, start_date, completion_date, cents/100.0 as final_revenue, month, lead_name, address, job_type, concrete_type,
         'won' as lead_status, cast(area as bigint) as square_footage, company as concrete_company, cast(coats as bigint) as sealer_coats, station_id from jobs"""
)
RULES = [
    ("unique", "stations", "station_id", "select count(*) from (select 1 from stations group by station_id having count(*) > 1)"),
    ("not_null", "stations", "station_id", "select count(*) from stations where station_id is null"),
    ("not_null", "stations", "name", "select count(*) from stations where name is null"),
    ("unique", "daily", "station_id,observation_date", "select count(*) from (select 1 from daily group by station_id, d having count(*) > 1)"),
    ("not_null", "daily", "station_id", "select count(*) from daily where station_id is null"),
    ("not_null", "daily", "observation_date", "select count(*) from daily where d is null"),
    ("references", "daily", "station_id", "select count(*) from daily where station_id not in (select station_id from stations)"),
    ("accepted", "daily", "pour_score", "select count(*) from daily where pour not in ('green','yellow','red')"),
    ("accepted", "daily", "sealer_score", "select count(*) from daily where seal not in ('green','yellow','red')"),
    ("range", "daily", "temp_max_f", "select count(*) from daily where hi not between -400 and 1200"),
    ("range", "daily", "temp_min_f", "select count(*) from daily where lo not between -400 and 1200"),
    ("not_after", "daily", "observation_date", "select count(*) from daily where d > date '2001-06-02'"),
    ("unique", "jobs", "job_id", "select count(*) from (select 1 from staged_jobs group by job_id having count(*) > 1)"),
    ("not_null", "jobs", "job_id", "select count(*) from staged_jobs where job_id is null"),
    ("references", "jobs", "station_id", "select count(*) from staged_jobs where station_id not in (select station_id from stations)"),
    ("references", "jobs", "station_id,start_date", "select count(*) from staged_jobs j where not exists (select 1 from daily w where w.station_id = j.station_id and w.d = j.start_date)"),
    ("unique", "coverage", "station_id", "select 0"),
    ("not_null", "coverage", "station_id", "select 0"),
    ("not_null", "coverage", "coverage_pct", "select 0"),
    ("not_null", "seasons", "station_id", "select 0"),
    ("not_null", "seasons", "year", "select 0"),
    ("unique", "job_weather", "job_id", "select 0"),
    ("not_null", "job_weather", "job_id", "select 0"),
    ("accepted", "job_weather", "pour_day_score", "select 0"),
    ("not_null", "year_over_year", "station_id", "select 0"),
]
SQL["dq_report"] = sql(
    " union all ".join(
        f"""select '{a}' as "check", '{b}' as "table", '{c}' as "column", cast(({q}) as bigint) as failures""" for a, b, c, q in RULES
    )
)
SQL["jobs_without_weather"] = sql(
    """select job_id, start_date, station_id from staged_jobs j
       where not exists (select 1 from daily w where w.station_id = j.station_id and w.d = j.start_date)"""
)
SQL["future_observations"] = sql("select station_id, d as observation_date from daily where d > date '2001-06-02'")
SQL["unrealistic_temperatures"] = sql(
    """select station_id, d as observation_date, f_hi as temp_max_f, f_lo as temp_min_f from daily
       where hi not between 300 and 1000 or lo not between 300 and 1000"""
)
FEATURES = ("feats", """select station_id, d, f_hi as temp_max_f, f_lo as temp_min_f, f_hi - f_lo as temp_range, f_rain as precip_in,
      coalesce(f_wmax, 0.0) as wind_max_mph, case when pour = 'green' then 1.0::double else 0.0 end as label
    from daily where hi is not null and lo is not null and rain is not null and pour is not null""")
SQL["model_features"] = sql(
    """select station_id, d as observation_date, temp_max_f, temp_min_f, round(temp_range, 6) as temp_range, precip_in, wind_max_mph, cast(label as double) as label,
         row_number() over (order by d, station_id) <= cast(floor(0.8 * count(*) over ()) as bigint) as is_train from feats""", FEATURES
)
TRAINED = ("trained", """select * from (select *, row_number() over (order by d, station_id) <= cast(floor(0.8 * count(*) over ()) as bigint) as is_train
    from feats)""")
MODEL_INPUTS = ("temp_max_f", "temp_min_f", "temp_range", "precip_in", "wind_max_mph")
SQL["model_moments"] = sql(
    " union all ".join(
        f"select '{f}' as feature, round(avg({f}), 6) as mean, round(stddev_pop({f}), 6) as deviation from trained where is_train"
        for f in MODEL_INPUTS
    ), FEATURES, TRAINED
)
SQL["model_inputs"] = sql(
    "select station_id, d as observation_date, is_train, "
    + ", ".join(f"round(({f} - (avg({f}) filter (is_train) over ())) / ((stddev_pop({f}) filter (is_train) over ()) + 1e-8), 6) as z_{f}" for f in MODEL_INPUTS)
    + " from trained", FEATURES, TRAINED
)
REQUESTS = ("requests", """select job_id as request_id, case when job_id % 11 = 0 then 'Nowhere' else s.name end as town,
      [strftime(start_date, '%Y-%m-%d'), strftime(start_date, '%Y-%-m-%-d'), strftime(start_date, '%Y/%m/%d'), strftime(start_date, '%Y-%m') || '-31',
       strftime(start_date, '%Y-%m-%d') || ' ', null, strftime(start_date, '%Y-%m-%d')][job_id % 7 + 1] as date
    from staged_jobs j left join stations s using (station_id)""")
ASKED = ("asked", """select r.*, s.station_id, case when date like '____-__-__' then cast(try_strptime(date, '%Y-%m-%d') as date) end as day
    from requests r left join stations s on s.name = r.town""")
SQL["point_answers"] = sql(
    """select request_id, town, date, case when a.station_id is null then 'unknown town' when day is null then 'invalid date'
         when w.d is null then 'no data' else 'ok' end as status, f_hi as temp_max_f, f_lo as temp_min_f, f_mean as temp_mean_f,
         f_rain as precip_in, f_snow as snow_in, f_wavg as wind_avg_mph, f_wmax as wind_max_mph, pour as pour_score, seal as sealer_score
       from asked a left join daily w on w.station_id = a.station_id and w.d = a.day""", REQUESTS, ASKED
)
SQL["schema_drift"] = """select 'stations' as "table", 'elevation_m' as "column", 'decimal(6,1)' as declared, null::varchar as found, 'missing' as difference,
      (select count(*) from supplier) as "rows"
    union all select 'stations', 'opened', null, 'int', 'extra', (select count(*) from supplier)
    union all select 'jobs', 'final_revenue', 'decimal(10,2)', 'double', 'type', (select count(*) from orders)"""
LATER = ("later", f"""select station_id, case when seq % 3 = 0 then ts + interval 400 day else ts end as ts, seq, {label('sev')} as pour_score from readings""")
SQL["stream_restart"] = sql(
    """select *, previous_score is not null and previous_score is distinct from pour_score as score_changed
       from (select *, lag(pour_score) over (partition by station_id order by ts, seq) as previous_score from later)""", LATER
)

# the same rows in report order
SQL["quality_report"] = SQL["coverage_audit"]
SQL["season_report"] = SQL["season_bounds"]
SQL["job_list"] = SQL["job_weather"]
