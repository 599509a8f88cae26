"""DuckDB SQL for the registry's queries, written from the queries' definitions over the same derived views."""

from __future__ import annotations

from cadenza import constants as C
from cadenza.functions.running import factor_sql, power_sql
from cadenza.sources.activities import SUMMARIES_SQL, telemetry_sql

MASS = 70.0
TELE = f"tele as ({telemetry_sql()})"
STEPS = """d as (select *, cast(t - lag(t) over w as double) as dt, distance - lag(distance) over w as dd, altitude - lag(altitude) over w as da
  from tele window w as (partition by activity_id order by seq)),
steps as (select activity_id, seq, t, distance, altitude, heartrate, dt, dd, da, case when dt <> 0 then dd / dt * 3.6::double end as speed,
  case when dd <> 0 then da / dd * 1000 end as elevation_gain from d where dt is not null)"""
SUMS = f"s as ({SUMMARIES_SQL})"
LISTING = f"{SUMS}, listing as (select activity_id, sport_type, case when activity_id % 7 <> 0 then date end as start_date from s)"
DATED = "dated as (select distinct activity_id, case when activity_id % 2 = 0 then 'Run' else 'TrailRun' end as sport_type, case when activity_id % 5 <> 4 then date '2024-01-01' + cast(activity_id % 3650 as int) end as start_date from tele)"
MOVING = "(dt > 0 and dt <= 60)"


def hms(n: str) -> str:
    n = f"cast(round_even({n}, 0) as bigint)"
    return f"case when {n} // 3600 <> 0 then ({n} // 3600)::varchar || ':' || lpad((({n} % 3600) // 60)::varchar, 2, '0') else ({n} // 60)::varchar end || ':' || lpad(({n} % 60)::varchar, 2, '0')"


def rolling(c: str, seconds: int, frm: str = "tele") -> str:
    return f"avg({c}) over (partition by activity_id order by t * 1000000000 range between {seconds * 10**9 - 1} preceding and current row)"


def greedy(key: str, rows: str, least: int) -> str:
    """Splits by a recursive walk over each row's successor."""
    return f"""b as (select *, row_number() over (partition by activity_id order by seq) - 1 as i from ({rows}) x),
nxt as (select a.activity_id, a.i, min(c.i) as j from b a join b c on a.activity_id = c.activity_id and c.i > a.i and c.i <= a.i + {least * 2} and c.{key} - a.{key} >= {least} group by a.activity_id, a.i),
walk as (select activity_id, cast(0 as bigint) as k, i, j from nxt where i = 0 union all select n.activity_id, w.k + 1, n.i, n.j from walk w join nxt n on n.activity_id = w.activity_id and n.i = w.j),
splits as (select w.activity_id, w.k as split_id, avg(speed) as speed, avg(elevation_gain) as elevation_gain, avg(heartrate) as heartrate, count(*) as n_steps,
  bool_or((dd > 0 and da > 0) or (dd < 0 and da < 0) or (dd = 0 and da > 0)) and bool_or((dd > 0 and da < 0) or (dd < 0 and da > 0) or (dd = 0 and da < 0)) as mixed,
  bool_or(dd = 0 or dt = 0) as poisoned from walk w join b on b.activity_id = w.activity_id and b.i >= w.i and b.i < w.j group by w.activity_id, w.k)"""


def savgol(rows: str, to: str = "smoothed", window_m: float = 500.0) -> str:
    """The rows with their altitude smoothed: the value at each sample's place of the parabola through the nearest full window, from its moments."""
    odd = lambda n: f"({n} + 1 - ({n}) % 2)"
    return f"""ix as (select *, row_number() over w - 1 as i, count(*) over (partition by activity_id) as n, distance - lag(distance) over w as gap from {rows} window w as (partition by activity_id order by seq)),
sp as (select activity_id, cast(round_even({window_m!r}::double / coalesce(median(gap) filter (where gap > 0), 1.0), 0) as bigint) as wanted from ix group by activity_id),
ce as (select *, cast((width - 1) / 2 as bigint) as m, least(greatest(i, cast((width - 1) / 2 as bigint)), n - 1 - cast((width - 1) / 2 as bigint)) as centre from (select ix.*, least(greatest({odd('wanted')}, 5), n - 1 + n % 2) as width from ix join sp using (activity_id)) x),
mo as (select c.activity_id, c.seq, any_value(c.m)::double as m, any_value(c.i - c.centre)::double as o, sum(b.altitude) as s0, sum((b.i - c.centre) * b.altitude) as s1, sum((b.i - c.centre) * (b.i - c.centre) * b.altitude) as s2
  from ce c join ce b on b.activity_id = c.activity_id and b.i between c.centre - c.m and c.centre + c.m group by 1, 2),
pq as (select *, 2 * m + 1 as k, m * (m + 1) * (2 * m + 1) / 3 as q2, m * (m + 1) * (2 * m + 1) / 3 * (3 * m * m + 3 * m - 1) / 5 as q4 from mo),
pa as (select *, (k * s2 - q2 * s0) / (k * q4 - q2 * q2) as a2 from pq),
{to} as (select r.* replace (case when ce.n < 4 then r.altitude else (s0 - a2 * q2) / k + s1 / q2 * o + a2 * o * o end as altitude) from {rows} r join ce using (activity_id, seq) left join pa using (activity_id, seq))"""


def loess(rows: str) -> str:
    """Curves smoothed by the closed form of weighted parabolas, mean and std alike."""
    level = lambda b: f"({b}0 * (m2 * m4 - m3 * m3) - m1 * ({b}1 * m4 - m3 * {b}2) + m2 * ({b}1 * m3 - m2 * {b}2)) / (m0 * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m3 * m2) + m2 * (m1 * m3 - m2 * m2))"
    return f"""li as (select *, row_number() over (partition by curve order by bin_center) as i, count(*) over (partition by curve) as n from {rows}),
lp as (select a.curve, a.i, a.n, b.bin_center - a.bin_center as dx, b.mean as y, b.std as z, b.count as c, row_number() over (partition by a.curve, a.i order by abs(b.bin_center - a.bin_center)) as r from li a join li b on a.curve = b.curve),
lh as (select *, max(case when r <= greatest(3, ceil(0.4::double * n)) then abs(dx) end) over (partition by curve, i) as h from lp),
lw as (select curve, i, dx / h as u, y, z, pow(1 - pow(least(abs(dx) / h, 1), 3), 3) * c as w from lh),
lm as (select curve, i, sum(w) as m0, sum(w * u) as m1, sum(w * u ** 2) as m2, sum(w * u ** 3) as m3, sum(w * u ** 4) as m4, sum(w * y) as y0, sum(w * u * y) as y1, sum(w * u * u * y) as y2, sum(w * z) as z0, sum(w * u * z) as z1, sum(w * u * u * z) as z2 from lw group by curve, i),
smooth as (select li.curve, bin_center, case when n <= 3 then mean else {level('y')} end as mean, case when n <= 3 then std else {level('z')} end as std, count from li join lm using (curve, i))"""


SPLITS = f"{TELE}, {STEPS}, {greedy('t', 'select * from steps where t >= 900', 10)}"
USABLE = f"{SPLITS}, u as (select activity_id, split_id, speed, elevation_gain, heartrate from splits where not mixed and not poisoned and elevation_gain between -350 and 350 and speed between 3 and 22)"


def efficiency(rows: str, by: str = "") -> str:
    """Buckets of 50 in gradient order, of efficiencies relative to the flat median."""
    key, on = (f"{by}, ", f"m.{by} = e0.{by}") if by else ("", "true")
    part = f"partition by {by} " if by else ""
    grouped = f" group by {by}" if by else ""
    return f"""e0 as (select *, heartrate / speed as efficiency from {rows}),
m as (select {key}case when count(*) > 100 then median(efficiency) end as med from e0 where elevation_gain > -10 and elevation_gain < 10{grouped}),
e as (select e0.* exclude (efficiency), coalesce(efficiency / med, efficiency) as efficiency from e0 left join m on {on}),
r as (select *, (row_number() over ({part}order by elevation_gain, activity_id, split_id) - 1) // 50 as bucket from e),
curve as (select {key}bucket, avg(elevation_gain) as bin_center, avg(efficiency) as mean, stddev_pop(efficiency) as std, count(*) as count from r group by {key}bucket)"""


CURVE = f"{USABLE}, {efficiency('u')}"
PREDICT = f"""{CURVE}, near as (select u.activity_id, u.split_id, u.speed, u.elevation_gain, arg_min(c.mean, struct_pack(a := abs(c.bin_center - u.elevation_gain), b := c.bucket)) as factor
  from u cross join curve c group by u.activity_id, u.split_id, u.speed, u.elevation_gain)"""
REFERENCE = "ref as (select * from (values " + ", ".join(f"('{n}', {x!r}::double, {y!r}::double, 0.0::double, 1::bigint)" for n, ys in C.REFERENCE_CURVES.items() for x, y in zip(C.KNOTS, ys, strict=True)) + ") v(curve, bin_center, mean, std, count))"
NAMED = f"{CURVE}, {REFERENCE}, named as (select 'personal' as curve, bin_center, mean, std, count from curve)"
ROLLED = f"{TELE}, alt as (select activity_id, seq, t, distance, heartrate, {rolling('altitude', 60)} as altitude from tele)"
RACE = f"""{ROLLED},
d as (select *, cast(t - lag(t) over w as double) as dt, distance - lag(distance) over w as dd, altitude - lag(altitude) over w as da from alt window w as (partition by activity_id order by seq)),
g as (select *, coalesce({MOVING}, false) as moving, case when dd >= 0.1 then da / dd * 100.0 else 0.0 end * 10.0 as gradient from d where dt is not null),
f as (select *, {factor_sql('gradient')} as factor, case when {MOVING} then 1000.0::double / least(greatest(case when dt > 0 then dd / dt else 0 end, {3.0 / 3.6!r}::double), {20.0 / 3.6!r}::double) end as pace0 from g),
p as (select * exclude (heartrate), {rolling('pace0', 15)} as pace, {rolling('heartrate', 60)} as heartrate from f),
q as (select *, case when pace is not null then least(greatest(pace / factor, 180), 1200) end as gap_pace, case when pace > 0 then {power_sql('(1000.0::double / pace)', 'gradient', MASS)} end as power0 from p),
race as (select * exclude (power0), {rolling('power0', 15)} as power from q),
series as (select activity_id, seq, sum(case when moving then dt else 0 end) over w as time_s, sum(case when moving then dd else 0 end) over w as distance_m, gap_pace as gap_pace_s_per_km, heartrate, power as power_w, power / nullif(heartrate, 0) as power_to_hr
  from race window w as (partition by activity_id order by seq rows unbounded preceding)),
sums as (select activity_id, sum(case when moving then dd else 0 end) as dist, sum(case when moving then dt else 0 end) as time_s, sum(case when moving then dd * factor else 0 end) as gap_dist, sum(case when moving and da > 0 then da else 0 end) as elevation_gain_m, avg(power) as avg_power_w from race group by activity_id),
metrics as (select activity_id, round(dist / 1000.0, 6) as distance_km, round(elevation_gain_m, 6) as elevation_gain_m, round(time_s, 6) as time_s, round(1000.0 / nullif(dist / nullif(time_s, 0), 0), 6) as avg_pace_s_per_km, round(1000.0 / nullif(gap_dist / nullif(time_s, 0), 0), 6) as avg_gap_pace_s_per_km, round(avg_power_w, 6) as avg_power_w from sums)"""


def band(g: str) -> str:
    return f"case when {g} < -12 then 'steep_descent' when {g} < -3 then 'gentle_descent' when {g} < 3 then 'flat' when {g} < 12 then 'gentle_ascent' else 'steep_ascent' end"


BANDS = [b for b, _, _ in C.GRADIENT_BANDS]


def efforts(distances=C.SHORT_DISTANCES, to: str = "select") -> str:
    arms = []
    for label, m in distances:
        arms.append(f"select *, '{label}' as label, {m!r}::double as meters, min(struct_pack(seq := seq, t := t, d := d, t0 := t0, d0 := d0)) over (partition by activity_id order by -d range between unbounded preceding and {m!r}::double preceding) as x from c")
    told = "select activity_id, label, meters, round(min(case when elapsed > 0 then elapsed end), 6) as best_s from e group by activity_id, label, meters"
    told = f"\n{told}" if to == "select" else f", {to} as ({told})"
    return f"""c0 as (select activity_id, seq, cast(t as double) as t, max(distance) over (partition by activity_id order by seq rows unbounded preceding) as d from tele),
c as (select *, lag(t) over w as t0, lag(d) over w as d0 from c0 window w as (partition by activity_id order by seq)),
r as ({' union all '.join(arms)}),
e as (select activity_id, label, meters, x.t0 + case when x.d - x.d0 > 0 then (d + meters - x.d0) / (x.d - x.d0) else 0 end * (x.t - x.t0) - t as elapsed from r){told}"""


def cumulative(value: str) -> str:
    return f"""with {SUMS}, v as (select year(date) as year, date, activity_id, {value} as v from s)
select cast(year as int) as year, cast(row_number() over (partition by year order by date, activity_id) as bigint) as ord, make_date(2000, month(date), day(date)) as x,
       round(sum(v) over (partition by year order by date, activity_id rows unbounded preceding), 6) as y, round(sum(v) over (partition by year), 6) as total from v
union all select cast(year as int), 0, date '2000-01-01', 0.0, round(sum(v), 6) from v group by year"""


def gradient_bins(index: str, x: str) -> str:
    return f"""with {SUMS}, b as (select year(date) as year, {index} as bin, sum(distance_m) as dist, sum(elevation_gain_m) as climb from s group by 1, 2),
t as (select year(date) as year, sum(distance_m) as dist, sum(elevation_gain_m) as climb from s group by 1)
select cast(b.year as int) as year, cast({x} as date) as x, round(b.climb / b.dist * 100.0, 6) as gradient, round(case when t.dist > 0 then t.climb / t.dist * 100.0 else 0.0 end, 6) as season_avg from b join t using (year) where b.dist > 0"""


def monday(date: str = "date") -> str:
    return f"cast(date_trunc('week', {date}) as date)"


def month(date: str = "date") -> str:
    return f"cast(date_trunc('month', {date}) as date)"


def shares(start: str, where: str = "true") -> str:
    sums = ", ".join(f"sum({b}) as {b}" for b in BANDS)
    total = " + ".join(BANDS)
    arms = " union all ".join(f"select x, '{b}' as band, round({b} / total * 100.0, 6) as pct from t where total > 0" for b in BANDS)
    return f"with {SUMS}, b as (select {start} as x, {sums} from s where {where} group by 1), t as (select *, {total} as total from b) {arms}"


def power_bins(start: str) -> str:
    return f"with {SUMS} select cast(year(x) as int) as year, x, round(avg(power_to_hr), 6) as power_to_hr from (select {start} as x, power_to_hr from s where power_to_hr is not null) b group by x"


SPLIT_COLUMNS = "activity_id, split_id, round(speed, 6) as speed, round(elevation_gain, 6) as elevation_gain, round(heartrate, 6) as heartrate"
PAIRS = f"""with {USABLE}, flat as (select * from u where elevation_gain > -10 and elevation_gain < 10)
select u.activity_id, u.split_id, f.activity_id as flat_activity, f.split_id as flat_split, round(f.speed, 6) as y from u join flat f on abs(f.heartrate - u.heartrate) <= 3.0"""
BANDED = f"""{TELE}, {STEPS}, bs as (select activity_id, {band('(case when dd > 0 then da / dd * 100.0 else 0.0 end)')} as band, dt from steps where {MOVING} and dd > 0),
bn as (select unnest({BANDS!r}) as band), ids as (select distinct activity_id from steps),
bt as (select i.activity_id, n.band, coalesce(sum(dt), 0.0) as seconds from ids i cross join bn n left join bs on bs.activity_id = i.activity_id and bs.band = n.band group by 1, 2)"""
RACE_SAVGOL = RACE.replace("from alt window", "from smoothed window").replace(f"{ROLLED},", f"{ROLLED}, {savgol('alt')},")
PROGRESS_STEPS = f"""{TELE}, {STEPS}, g as (select *, coalesce({MOVING} and dd > 0, false) as moving, case when dd > 0 then da / dd * 100.0 else 0.0 end as pct from steps),
h as (select *, {band('pct')} as band, {power_sql('(case when dt > 0 then dd / dt else 0 end)', '(pct * 10.0)', MASS)} as watts from g), {DATED}"""

PROGRESS = f"""select d.activity_id, d.start_date as date, d.sport_type, round(sum(case when moving then dd else 0 end), 6) as distance_m, round(sum(case when moving and da > 0 then da else 0 end), 6) as elevation_gain_m, sum(case when moving then dt else 0 end) as moving_seconds,
{', '.join(f"sum(case when moving and band = '{b}' then dt else 0 end) as {b}" for b in BANDS)}, round(avg(case when moving and heartrate > 0 then watts end) / avg(case when moving and heartrate > 0 then heartrate end), 6) as power_to_hr
from h join dated d using (activity_id) where d.start_date is not null group by 1, 2, 3"""
PAYLOADS = """o as (select cast(o_custkey as bigint) as activity_id, row_number() over (partition by o_custkey order by o_orderkey) as k, count(*) over (partition by o_custkey) as n, cast(round(o_totalprice * 100) as bigint) as cents from orders)"""
SCALED = f"""{USABLE}, {DATED}, us as (select u.*, s.scale from u join dated d using (activity_id) join (values ('all'), ('two days')) s(scale) on scale = 'all' or d.start_date is null or d.start_date between date '2024-01-01' and date '2024-01-02'),
ut as (select *, scale || ' efficiency' as curve from us union all select us.*, scale || ' efficiency ' || intensity from us join (values ('120-140', 120, 140), ('135-160', 135, 160)) v(intensity, a, b) on heartrate between a and b)"""

SQL: dict[str, str] = {
    "history_summary": f"with {LISTING} select min(start_date) as first_date, max(start_date) as last_date, count(distinct activity_id) as n_activities from listing",
    "workout_list": f"""with {TELE}, {DATED}, w as (select activity_id, arg_max(t, seq) - arg_min(t, seq) as elapsed, arg_max(distance, seq) - arg_min(distance, seq) as distance, count(*) as samples, 'Activity ' || activity_id::varchar as label from tele group by activity_id)
select activity_id, elapsed, round(distance, 6) as distance, samples, label, sport_type, start_date, concat_ws(' · ', strftime(start_date, '%Y-%m-%d'), sport_type, {hms('cast(elapsed as double)')}) as title from w join dated using (activity_id)""",
    "workouts_on_date": f"with {SUMS} select activity_id, sport_type, distance_m from s where date = date '1996-03-15'",
    "workout_dates": f"with {LISTING} select distinct start_date from listing where start_date is not null",
    "stream_filter": f"with {LISTING} select * from listing where sport_type = 'TrailRun' and (start_date is null or start_date between date '1996-01-01' and date '1997-12-31')",
    "latest_activities": f"with {LISTING} select * from listing order by start_date desc nulls last, activity_id limit 100",
    "numbered_labels": f"""with {SUMS}, n as (select activity_id, sport_type || ' ' || date::varchar as label from s), k as (select *, row_number() over (partition by label order by activity_id) as k from n)
select activity_id, case when k > 1 then label || ' (' || (k - 1)::varchar || ')' else label end as label from k""",
    "telemetry_steps": f"with {TELE}, {STEPS} select activity_id, seq, t, dt, round(dd, 6) as dd, round(da, 6) as da, round(speed, 6) as speed, round(elevation_gain, 6) as elevation_gain, heartrate from steps",
    "moving_steps": f"with {TELE}, {STEPS} select activity_id, seq, {MOVING} as moving_race, {MOVING} and dd > 0 as moving_progress from steps",
    "moving_axes": f"with {TELE}, {STEPS} select activity_id, seq, round(sum(case when {MOVING} then dt else 0 end) over w, 6) as moving_time, round(sum(case when {MOVING} then dd else 0 end) over w, 6) as moving_distance from steps window w as (partition by activity_id order by seq rows unbounded preceding)",
    "rolling_mean_time": f"with {TELE} select activity_id, seq, round({rolling('heartrate', 15)}, 6) as hr_15, round({rolling('heartrate', 60)}, 6) as hr_60, round({rolling('altitude', 60)} + 3e-9, 6) as altitude_60 from tele",
    "gradient_factor": f"with {TELE}, {STEPS}, x as (select activity_id, seq, round(elevation_gain, 3) as g from steps where elevation_gain is not null) select activity_id, seq, " + ", ".join(f"round({factor_sql('g', c)}, 6) as {c}" for c in C.REFERENCE_CURVES) + " from x",
    "power_series": f"with {TELE}, {STEPS} select activity_id, seq, round({power_sql('(dd / dt)', 'elevation_gain', MASS)}, 6) as power_w from steps where elevation_gain is not null",
    "clock_texts": f"""with {SUMS}, x as (select activity_id, {hms('elevation_gain_m')} as hms, cast(round_even(elevation_gain_m, 0) as bigint) as n, cast(round_even(best_1km, 0) as bigint) as p from s)
select activity_id, hms, coalesce((p // 60)::varchar || ':' || lpad((p % 60)::varchar, 2, '0') || '/km', '') as pace, n as seconds, n // 3600 as h, (n % 3600) // 60 as m, n % 60 as s from x""",
    "race_series": f"with {RACE} select activity_id, seq, round(time_s, 6) as time_s, round(distance_m, 6) as distance_m, round(gap_pace_s_per_km, 6) as gap_pace_s_per_km, round(heartrate, 6) as heartrate, round(power_w, 6) as power_w, round(power_to_hr, 6) as power_to_hr from series",
    "race_metrics": f"with {RACE} select * from metrics",
    "race_best_flags": f"""with {RACE} select activity_id, n >= 2 and distance_km = max(distance_km) over () as best_distance_km, n >= 2 and elevation_gain_m = max(elevation_gain_m) over () as best_elevation_gain_m,
n >= 2 and time_s = min(time_s) over () as best_time_s, n >= 2 and avg_pace_s_per_km = min(avg_pace_s_per_km) over () as best_avg_pace_s_per_km, n >= 2 and avg_gap_pace_s_per_km = min(avg_gap_pace_s_per_km) over () as best_avg_gap_pace_s_per_km from (select *, count(*) over () as n from metrics) m""",
    "race_plot_axes": f"""with {RACE} select activity_id, seq, round(time_s / 60.0, 6) as time_min, round(distance_m / 1000.0, 6) as distance_km, round(3600.0 / gap_pace_s_per_km, 6) as gap_speed_kmh,
bool_or(gap_pace_s_per_km is not null) over w as has_gap_pace_s_per_km, bool_or(heartrate is not null) over w as has_heartrate, bool_or(power_w is not null) over w as has_power_w, bool_or(power_to_hr is not null) over w as has_power_to_hr from series window w as (partition by activity_id)""",
    "gradient_bands": f"with {BANDED} select activity_id, band, seconds, round(seconds / nullif(sum(seconds) over (partition by activity_id), 0) * 100.0, 6) as pct from bt",
    "progress_sums": f"with {PROGRESS_STEPS} {PROGRESS}",
    "activity_progress": f"""with {ROLLED}, {savgol('alt')}, {PROGRESS_STEPS.replace(TELE + ', ', '').replace('from tele window', 'from smoothed window')}, p as ({PROGRESS}), {efforts(C.PR_DISTANCES, 'best')}
select p.*, {', '.join(f"max(best_s) filter (where label = '{label}') as best_{label.lower().replace(' ', '_')}" for label, _ in C.PR_DISTANCES)} from p left join best using (activity_id) group by all""",
    "savgol_altitude": f"with {TELE}, {savgol('tele')} select tele.*, round(s.altitude, 6) as smooth from tele join smoothed s using (activity_id, seq)",
    "race_series_savgol": f"with {RACE_SAVGOL} select activity_id, seq, round(time_s, 3) as time_s, round(distance_m, 3) as distance_m, round(gap_pace_s_per_km, 3) as gap_pace_s_per_km, round(heartrate, 3) as heartrate, round(power_w, 3) as power_w, round(power_to_hr, 3) as power_to_hr from series",
    "race_metrics_savgol": f"with {RACE_SAVGOL} select metrics.*, label, ord from metrics join (values (2, 'Second', 0), (0, 'Activity 0', 1), (3, 'Activity 3', 2)) v(activity_id, label, ord) using (activity_id)",
    "best_efforts": f"with {TELE},\n{efforts()}",
    "record_progression": f"""with {SUMS}, p as (select sport_type as label, date, best_1km as value, min(best_1km) over (partition by sport_type order by date, best_1km rows between unbounded preceding and 1 preceding) as prev from s where best_1km is not null)
select label, date, value from p where prev is null or value < prev""",
    "current_records": f"with {SUMS}, x as (select sport_type as label, arg_min(date, struct_pack(v := best_1km, a := activity_id)) filter (where best_1km is not null) as date, min(best_1km) as value from s group by 1) select * from x",
    "annual_distance": cumulative("distance_m * 0.001::double"),
    "annual_elevation": cumulative("elevation_gain_m"),
    "avg_gradient_week": gradient_bins("(dayofyear(date) - 1) // 7 + 1", "date '2000-01-01' + cast((bin - 1) * 7 as int)"),
    "avg_gradient_month": gradient_bins("month(date)", "make_date(2000, cast(bin as int), 1)"),
    "season_gradient": f"with {SUMS} select coalesce(cast(year(date) as varchar), 'all') as year, round(case when sum(distance_m) > 0 then sum(elevation_gain_m) / sum(distance_m) * 100.0 else 0.0 end, 6) as gradient from s group by rollup (year(date))",
    "power_hr_weekly": power_bins(monday()),
    "power_hr_monthly": power_bins(month()),
    "gradient_map_week": shares(monday()),
    "gradient_map_month": shares(month(), "date between date '1996-01-01' and date '1998-06-30'"),
    "greedy_splits": f"with recursive {SPLITS} select {SPLIT_COLUMNS}, n_steps, mixed, poisoned from splits",
    "splits_filtered": f"with recursive {USABLE} select {SPLIT_COLUMNS} from u",
    "distance_splits": f"with recursive {TELE}, {STEPS}, {greedy('distance', 'select * from steps', 20)} select {SPLIT_COLUMNS}, n_steps, mixed, poisoned from splits",
    "splits_lost": f"with recursive {SPLITS} select round(avg(mixed::int) * 100, 6) as mixed_pct, round(avg(poisoned::int) * 100, 6) as poisoned_pct, count(*) as n from splits",
    "flat_median": f"with recursive {USABLE} select round(median(heartrate / speed), 6) as median, count(*) as n from u where elevation_gain > -10 and elevation_gain < 10 having count(*) > 0",
    "efficiency_curve": f"with recursive {CURVE} select bucket, round(bin_center, 6) as bin_center, round(mean, 6) as mean, round(std, 6) as std, count from curve",
    "efficiency_curve_by_intensity": f"""with recursive {USABLE}, ranges as (select * from (values ('120-140', 120, 140), ('135-160', 135, 160), ('160-180', 160, 180)) v(intensity, a, b)),
ui as (select u.*, intensity from u join ranges on heartrate between a and b), {efficiency('ui', 'intensity')} select intensity, bucket, round(bin_center, 6) as bin_center, round(mean, 6) as mean, round(std, 6) as std, count from curve""",
    "efficiency_predict": f"with recursive {PREDICT} select activity_id, split_id, round(speed * factor, 6) as gap from near",
    "calibration_pairs": PAIRS.replace("with ", "with recursive ", 1),
    "calibration_pairs_bucketed": PAIRS.replace("with ", "with recursive ", 1),
    "flat_speed_targets": f"""with recursive {USABLE} select u.activity_id, u.split_id, round(avg(f.speed), 6) as y, count(*) as n from u join u f on f.elevation_gain > -10 and f.elevation_gain < 10 and abs(f.heartrate - u.heartrate) <= 3.0 group by 1, 2""",
    "loess_curve": f"with recursive {NAMED}, {loess('named')} select curve, round(bin_center, 6) as bin_center, round(mean, 6) as mean, round(std, 6) as std, count from smooth",
    "gap_efficiency_curves": f"""with recursive {SCALED}, {efficiency('ut', 'curve').replace('curve as (select curve, bucket', 'buckets as (select curve, bucket')}, {loess('buckets')}, {REFERENCE}, every as (select * from smooth union all select * from ref)
select curve, round(bin_center, 6) as bin_center, round(mean, 6) as mean, round(std, 6) as std, count from every""",
    "listed_activities": f"with {LISTING} select * from listing where activity_id % 3 <> 0 and sport_type = 'TrailRun' and start_date between date '1996-01-01' and date '1997-12-31'",
    "fetched_streams": f"with {TELE}, {DATED}, l as (select * from dated order by start_date desc nulls last, activity_id limit 2) select tele.* replace (round(distance, 6) as distance), sport_type, start_date from tele join l using (activity_id)",
    "single_stream": f"with {TELE} select * from tele where activity_id = 3",
    "decoded_streams": f"with {PAYLOADS} select activity_id, k - 1 as seq, k * 2 as t, k * 5.5::double as distance, cast(cents % 900 as double) as altitude, case when cents % 7 <> 0 then cast(120 + cents % 60 as double) end as heartrate from o where activity_id % 10 <> 0",
    "mismatched_streams": f"with {PAYLOADS} select distinct activity_id, cast(n as int) as n_times, cast(n - 1 as int) as n_heartrates from o where activity_id % 10 = 0",
    "remote_streams": """select i as activity_id, cast(case when i % 7 = 1 then -1 else n end as int) as n, case when i % 7 = 1 then 'KeyError: ' || chr(39) || 'stream ' || i || chr(39) end as error
      from (select cast(o_custkey as bigint) as i, count(*) as n from orders group by 1) o""",
    "saved_summary": f"with {SUMS} select cast(year(date) as int) as year, round(sum(distance_m), 3) as distance_m from s group by 1",
    "pace_clocks": f"with {SUMS} select activity_id, cast(trunc(elevation_gain_m * 1000) as bigint) as climb_ms, cast(trunc(best_1km * 1000) as bigint) as best_ms from s",
    "series_colours": "select n_nationkey, case when n_nationkey % 4 = 3 then n_name else 'rgba(' || (c // 65536) || ',' || (c // 256 % 256) || ',' || (c % 256) || ',0.25)' end as colour from (select *, cast(n_nationkey * 700001 % 16777216 as bigint) as c from nation) x",
    "region_words": "select r_regionkey, en as word_en, case when r_name = 'ASIA' then 'Asie' else en end as word_fr, en as word_de from (select *, case r_name when 'ASIA' then 'Asia' when 'EUROPE' then 'Europe' else r_name end as en from region) x",
    "pair_counts": f"""with recursive {USABLE}, c as (select floor(heartrate / 3.0) * 3.0 as hr_from, count(*) as n_splits, count(*) filter (where elevation_gain > -10 and elevation_gain < 10) as n_flat from u group by 1)
select cast(hr_from as double) as hr_from, n_splits, n_flat, n_splits * n_flat as n_pairs from c""",
    "equi_width_curve": f"""with recursive {PREDICT}, a as (select elevation_gain as x, speed * factor / speed as adjuster from near), span as (select cast(floor(min(x) / 20) as bigint) as first, cast(ceil(max(x) / 20) as bigint) as last from a),
bins as (select unnest(range(first, last)) as bin from span), told as (select cast(floor(x / 20) as bigint) as bin, avg(adjuster) as mean, stddev_pop(adjuster) as std, count(*) as count from a group by 1)
select (bin + 0.5::double) * 20 as bin_center, round(mean, 6) as mean, round(std, 6) as std, coalesce(count, 0) as count from bins left join told using (bin)""",
    "rolling_mean_curves": f"""with recursive {CURVE}, o as (select 'personal' as curve, *, row_number() over (order by bin_center, bucket) as i, count(*) over () as n from curve),
near as (select a.curve, a.bucket, a.bin_center, a.count, avg(b.mean) as mean, avg(b.std) as std from o a cross join (select unnest(range(-2, 3)) as k) k join o b on b.curve = a.curve and b.i = least(greatest(a.i + k.k, 1), a.n) group by 1, 2, 3, 4)
select curve, bucket, round(bin_center, 6) as bin_center, round(mean, 6) as mean, round(std, 6) as std, count from near""",
    "reference_curves": f"with recursive {NAMED} " + " union all ".join(f"select '{c}' as reference, round(bin_center, 6) as bin_center, round({factor_sql('bin_center', c)}, 6) as factor, round(mean - {factor_sql('bin_center', c)}, 6) as away from named" for c in C.REFERENCE_CURVES),
    "curve_union": f"with recursive {NAMED}, x as (select * from named union all select * from ref) select curve, round(bin_center, 6) as bin_center, round(mean, 6) as mean, round(std, 6) as std, count, round(mean - std, 6) as low, round(mean + std, 6) as high from x",
    "curve_export": f"with recursive {NAMED}, x as (select * from named union all select * from ref) select curve, round(bin_center, 6) as bin_center_m_per_km, round(mean, 6) as speed_adjuster_mean, round(std, 6) as speed_adjuster_std, count as sample_count from x",
}

SQL["curve_files"] = SQL["curve_export"]
SQL["paged_listing"] = SQL["listed_activities"]


def _dates_as_text(sql: str, *columns: str) -> str:
    told = ", ".join(f"cast({c} as varchar) as {c}" for c in columns)
    return f"select * replace ({told}) from ({sql}) z"


#: What arrives in batches has the same totals as what is there at once; running totals are told at each day's end.
SQL |= {f"live_{name}": SQL[name] for name in ("avg_gradient_week", "gradient_map_week")} | {"live_power_hr_monthly": SQL["power_hr_monthly"]}
SQL |= {f"live_{name}": SQL[name] for name in ("record_progression", "current_records")}
SQL["live_annual_distance"] = f"select year, x, max(y) as y, any_value(total) as total from ({SQL['annual_distance']}) c where ord > 0 group by year, x"
SQL["efficiency_pipeline"] = SQL["efficiency_predict"].replace("as gap from near", "as flat_speed from near")
TARGETS = f"""{USABLE}, targets as (select u.activity_id, u.split_id, u.speed, u.elevation_gain, u.heartrate, avg(f.speed) as y, count(*) as n
  from u join u f on f.elevation_gain > -10 and f.elevation_gain < 10 and abs(f.heartrate - u.heartrate) <= 3.0 group by all)"""
SQL["boosted_stump"] = f"""with recursive {TARGETS}, long as (select activity_id, split_id, y, n, unnest([1, 2, 3]) as feature, unnest([floor(speed), floor(elevation_gain / 50) * 50, floor(heartrate / 2) * 2]) as x from targets),
cuts as (select feature, (x + lead(x) over (partition by feature order by x)) / 2 as cut from (select distinct feature, x from long) v),
sides as (select feature, cut, sum(y * n) filter (where x <= cut) as y0, sum(n) filter (where x <= cut) as n0, sum(y * n) filter (where x > cut) as y1, sum(n) filter (where x > cut) as n1 from cuts join long using (feature) where cut is not null group by all),
best as (select * from sides order by y0 * y0 / n0 + y1 * y1 / n1 desc, feature, cut limit 1)
select activity_id, split_id, round(case when x <= cut then y0 / n0 else y1 / n1 end, 6) as prediction from long join best using (feature)"""
SQL["reliability_efficiency"] = f"""with recursive {PREDICT.replace(USABLE, TARGETS)}, p as (select speed * factor as p, y, n from near join (select activity_id, split_id, y, n from targets) t using (activity_id, split_id)),
span as (select min(p) as low, max(p) as high from p), binned as (select p.*, cast(floor((p - low) / (high - low) * 20) as bigint) as bin from p cross join span)
select bin, round(sum(p * n) / sum(n), 6) as mean_prediction, round(sum(y * n) / sum(n), 6) as mean_truth, cast(sum(n) as bigint) as count from binned where bin < 20 group by bin"""
SQL["scale_problems"] = """with asked as (select o_custkey as r, case when c % 19 = 0 then '' when c % 23 <> 0 then o_orderstatus end as name, day, case when c % 5 <> 0 then day + cast(c % 400 - 20 as int) end as until
  from (select *, cast(o_orderdate as date) as day, cast(round(o_totalprice * 100) as bigint) as c from orders where o_orderkey % 3 = 0) o),
told as (select c_custkey as r, (select count(*) from asked a where a.r = c_custkey) as n, exists (select 1 from asked a where a.r = c_custkey and coalesce(name, '') = '') as unnamed, exists (select 1 from asked a where a.r = c_custkey and until < day) as turned from customer)
select * from (select cast(r as bigint) as request_id, case when n = 0 then 'no scale' when n > 5 then 'over 5 scales' when unnamed then 'no name' when turned then 'ends before it starts' end as reason from told) x where reason is not null"""
SQL["selection_problems"] = f"""with {LISTING}, told as (select o_custkey, count(*) as n, count(distinct o_orderkey) as different, bool_or(l.activity_id is null) as unknown
  from orders left join (select activity_id from listing where start_date is not null) l on activity_id = o_orderkey where o_orderkey % 3 = 0 group by 1)
select * from (select cast(c_custkey as bigint) as request_id, case when n is null then 'no race' when n > 4 then 'over 4 races' when different < n then 'a race twice' when unknown then 'unknown race' end as reason
  from customer left join told on o_custkey = c_custkey) x where reason is not null"""
BROKEN = "case when activity_id % 17 = 4 then 'not JSON' when activity_id % 11 = 3 then 'no altitude' when activity_id % 10 = 0 and activity_id % 13 <> 5 then 'uneven' end"
SQL["payload_errors"] = f"with {PAYLOADS} select distinct activity_id, {BROKEN} as error from o where {BROKEN} is not null"
SQL["payload_samples"] = f"""with {PAYLOADS} select activity_id, k - 1 as seq, k * 2 as t, k * 5.5::double as distance, cast(cents % 900 as double) as altitude,
  case when cents % 7 <> 0 and activity_id % 13 <> 5 then cast(120 + cents % 60 as double) end as heartrate from o where {BROKEN} is null"""

for _names, _columns in (
    (("history_summary",), ("first_date", "last_date")),
    (("workout_list", "workout_dates", "stream_filter", "latest_activities", "listed_activities", "paged_listing", "fetched_streams"), ("start_date",)),
    (("progress_sums", "activity_progress", "record_progression", "current_records", "live_record_progression", "live_current_records"), ("date",)),
    (("annual_distance", "annual_elevation", "avg_gradient_week", "avg_gradient_month", "power_hr_weekly", "power_hr_monthly", "gradient_map_week", "gradient_map_month", "live_avg_gradient_week", "live_gradient_map_week", "live_power_hr_monthly", "live_annual_distance"), ("x",)),
):
    for _name in _names:
        SQL[_name] = _dates_as_text(SQL[_name], *_columns)
