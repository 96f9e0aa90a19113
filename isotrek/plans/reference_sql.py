"""SQL twins of the transit queries."""

from isotrek.plans.problems_sql import _day_ok, _lat_ok, _lon_ok, _strip
from isotrek.plans.reference import GRID, POLYGON, TODAY

_SECONDS = "^[0-9]+:[0-9]{1,2}:[0-9]{1,2}$"


def _secs(c: str) -> str:
    v = _strip(c)
    part = lambda i: f"cast(string_split({v}, ':')[{i}] as integer)"
    return f"case when regexp_matches({v}, '{_SECONDS}') then {part(1)} * 3600 + {part(2)} * 60 + {part(3)} end"


def _r(x: str, digits: int = 4) -> str:
    return f"cast(round(cast({x} as decimal(28,12)), {digits}) as double)"


def _key(c: str) -> str:
    return f"nullif({_strip(c)}, '')"


def _metres(a: str, b: str) -> str:
    return (
        f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) "
        f"* pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


TIMED = f"""timed as (select * from (
  select {_key('trip_id')} as trip_id, try_cast(case when regexp_full_match({_strip('stop_sequence')}, '[0-9]+') then {_strip('stop_sequence')} end as integer) as seq,
    st_id, {_key('stop_id')} as stop_id, {_secs('arrival_time')} as arr, {_secs('departure_time')} as dep, {_strip('pickup_type')} as pickup_type
  from stop_times) where trip_id is not null and seq is not null and stop_id is not null)"""
TLINES = f"""tlines as (select trip_id, min(r).route_id as route_id, min(r).direction as direction from (
  select {_key('trip_id')} as trip_id, {{'route_id': {_key('route_id')}, 'direction': coalesce({_key('direction_id')}, '0')}} as r from trips)
  where trip_id is not null and r.route_id is not null group by trip_id)"""
HOPS = f"""{TIMED}, {TLINES}, hops as (select h.*, route_id, direction from (
  select trip_id, stop_id as a, dep, lead(stop_id) over w as b, lead(arr) over w as arr from timed window w as (partition by trip_id order by seq, st_id)) h
  join tlines using (trip_id) where b is not null and a <> b and h.dep is not null and h.arr is not null and h.dep >= 25200 and h.dep < 79200)"""
DAYS = """days as (
  select service_id, day from (
    select coalesce(c.s, x.s) as service_id, coalesce(c.day, x.day) as day, x.t from cal c full join exc x on c.s = x.s and c.day = x.day)
  where coalesce(t, '1') = '1')"""
CAL = f"""spans as (
  select {_key('service_id')} as s, {_strip('start_date')} as a, {_strip('end_date')} as b,
    [{', '.join(_strip(d) for d in ('monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'))}] as flags from calendar),
cal as (select distinct s, day from (
  select s, flags, cast(unnest(generate_series(strptime(a, '%Y%m%d'), strptime(b, '%Y%m%d'), interval 1 day)) as date) as day
  from spans where {_day_ok('a')} and {_day_ok('b')} and a <= b) where s is not null and flags[isodow(day)] = '1')"""


def _exceptions(ignore_others: bool) -> str:
    kept = "and t in ('1', '2')" if ignore_others else ""
    return f"""exc as (select s, day, case when arg_max(coalesce(t, ''), cd_id) = '1' then '1' else '2' end as t from (
  select cd_id, {_key('service_id')} as s, {_strip('date')} as d, try_strptime({_strip('date')}, '%Y%m%d')::date as day, {_strip('exception_type')} as t from calendar_dates)
  where s is not null and {_day_ok('d')} {kept} group by s, day)"""


RUNNING = f"{CAL}, {_exceptions(True)}, {DAYS}"
VOLUME = f"""{RUNNING}, per as (select {_key('service_id')} as service_id, count(*) as trips from trips group by 1)"""
STOPS = "sup as (select s_suppkey as key, 41.5e0 + ((s_suppkey * 37) % 1000) / 5000e0 as lat, ((s_suppkey * 91) % 1000) / 5000e0 as lon from supplier)"
POINTS = "cus as (select c_custkey as key, 41.5e0 + ((c_custkey * 53) % 997) / 5000e0 as lat, ((c_custkey * 29) % 991) / 5000e0 as lon from customer)"
CELLS = f"""{STOPS}, cells as (select c as cell, c // {GRID.cols} as r, c % {GRID.cols} as k, {GRID.south!r}::double + (c // {GRID.cols} + 0.5e0) * {GRID.d_lat!r} as lat,
  {GRID.west!r}::double + (c % {GRID.cols} + 0.5e0) * {GRID.d_lon!r} as lon from range({GRID.rows * GRID.cols}) t(c)),
raster as (select cell, min(key % 20 + m / 75) as minutes from (select cell, s.key, {_metres('s', 'c')} as m from cells c, sup s) where m <= 1800 group by cell)"""
_EDGES = ", ".join(f"({i}, {a[0]!r}, {a[1]!r}, {b[0]!r}, {b[1]!r})" for i, r in enumerate(POLYGON[0]) for a, b in zip(r, r[1:]))


def _inside(points: str) -> str:
    return f"""select key from (select key, ring, count(*) % 2 as inside from {points} p, (values {_EDGES}) e(ring, a, b, c, d)
  where (a > lat) <> (c > lat) and lon < cast(b as double) + (lat - a) / (cast(c as double) - a) * (cast(d as double) - b) group by key, ring) group by key
  having max(case when ring = 0 then inside else 0 end) = 1 and max(case when ring > 0 then inside else 0 end) = 0"""


def _around(steps: list[tuple[int, int]], source: str = "whole") -> str:
    values = ", ".join(f"({y}, {x})" for y, x in steps)
    return f"""select (cell // {GRID.cols} + dy) * {GRID.cols} + cell % {GRID.cols} + dx as cell, dy, dx, minutes as value from {source}, (values {values}) o(dy, dx)
  where cell // {GRID.cols} + dy between 0 and {GRID.rows - 1} and cell % {GRID.cols} + dx between 0 and {GRID.cols - 1}"""


STREET = """n as (select count(*) as n from supplier), raw as (
  select s_suppkey as a, (s_suppkey + 1) % n as b, 100 + s_suppkey % 7 * 10 as m from supplier, n
  union all select s_suppkey, (s_suppkey * 7 + 3) % n, 300 + s_suppkey % 11 * 20 from supplier, n),
edges as (select least(a, b) as a, greatest(a, b) as b, min(m) as m from raw where a <> b group by 1, 2),
both_ways as (select a, b, m from edges union all select b, a, m from edges)"""
REACH = f"""with recursive {STREET}, found(source, node, metres) using key (source, node) as (
  select n_nationkey, cast(n_nationkey as bigint), cast(0 as bigint) from nation
  union select f.source, e.b, min(f.metres + e.m) from found f join both_ways e on e.a = f.node
    left join recurring.found r on r.source = f.source and r.node = e.b
    where f.metres + e.m <= 900 and (r.metres is null or f.metres + e.m < r.metres) group by f.source, e.b)
select source, node, metres from found"""
BOARD = f"""{TIMED}, board as (select * from (select *, row_number() over (partition by trip_id order by seq desc, st_id desc) as back from timed)
  where back > 1 and coalesce(pickup_type, '0') <> '1' and dep is not null)"""
CLOCK = "printf('%02d:%02d', {0} % 86400 // 3600, {0} % 3600 // 60) || case when {0} >= 86400 then ' (+' || ({0} // 86400) || ')' else '' end"

SQL = {
    "hop_median": f"with {HOPS} select route_id, direction, a as from_stop, b as to_stop, {_r('greatest(0.4, median(greatest(0, arr - dep) / 60.0e0))')} as minutes from hops group by all",
    "headway_wait": f"""with {HOPS} select route_id, direction, a as stop_id, count(*) as departures, {_r('900e0 / count(*)')} as headway,
      {_r('least(15e0, greatest(1e0, 450e0 / count(*)))')} as wait from hops group by route_id, direction, a""",
    "line_headway": f"""with {HOPS} select route_id, direction, {_r('median(h)')} as median_min, {_r('min(h)')} as best_min
      from (select route_id, direction, a, 900e0 / count(*) as h from hops group by 1, 2, 3) group by 1, 2""",
    "typical_headway": f"""with v as (select event_type, round(value, 1) as value, count(*) as w from events where round(value, 1) > 0 group by 1, 2),
      r as (select *, sum(w) over (partition by event_type order by value) as seen, lead(value) over (partition by event_type order by value) as nxt, sum(w) over (partition by event_type) / 2 as half from v)
      select event_type, {_r('arg_min(case when seen = half and nxt is not null then (value + nxt) / 2 else value end, value)')} as value from r where seen >= half group by event_type""",
    "service_day_counts": f"with {RUNNING} select service_id, count(*) as days, cast(min(day) as varchar) as first_day, cast(max(day) as varchar) as last_day from days group by 1",
    "services_of_days": f"with {CAL}, {_exceptions(False)}, {DAYS} select cast(day as varchar) as day, count(*) as services from days group by 1",
    "reference_day": f"""with {VOLUME}, vol as (select day, sum(trips) as v from days join per using (service_id) where isodow(day) in (2, 3, 4) group by day),
      pool as (select * from vol where day >= date '{TODAY}' or not exists (select 1 from vol where day >= date '{TODAY}'))
      select cast(min(day) as varchar) as day from pool where v >= 0.92 * (select max(v) from pool)""",
    "typical_day": f"""with {VOLUME}, ahead as (select * from days where day >= date '{TODAY}'),
      vol as (select day, sum(trips) as v from ahead join per using (service_id) where isodow(day) in (2, 4) group by day),
      near as (select * from vol where v >= 0.92 * (select max(v) from vol)),
      soon as (select * from near where (select count(*) from near where day <= (select min(day) from near) + 60) < 4 or day <= (select min(day) from near) + 60),
      sets as (select day, string_agg(distinct service_id, ',' order by service_id) as s from ahead join soon using (day) group by day),
      counted as (select count(*) as n, min(day) as day from sets group by s)
      select cast(day as varchar) as day from counted order by n desc, counted.day limit 1""",
    "next_saturday": f"with {RUNNING} select cast(min(day) as varchar) as day from days where isodow(day) = 6 and day >= date '{TODAY}'",
    "feed_validity": f"""with d as (select {_strip('start_date')} as d from calendar union all select {_strip('end_date')} from calendar
      union all select {_strip('date')} from calendar_dates where {_strip('exception_type')} = '1')
      select cast(cast(min(strptime(d, '%Y%m%d')) as date) as varchar) as valid_from, cast(cast(max(strptime(d, '%Y%m%d')) as date) as varchar) as valid_to from d where {_day_ok('d')}""",
    "trips_per_service": f"select {_key('service_id')} as service_id, count(*) as trips from trips group by 1",
    "anti_refs": " union all ".join(
        f"select '{c}' as src, '{f}' as field, count(*) as missing from {c} where {_key(f)} is not null and {_key(f)} not in (select {_key(f)} from {p} where {_key(f)} is not null)"
        for c, f, p in (("trips", "route_id", "routes"), ("stop_times", "trip_id", "trips"), ("stop_times", "stop_id", "stops"))
    ),
    "common_pattern": f"""with {TIMED}, {TLINES}, p as (select trip_id, string_agg(stop_id, '>' order by seq, st_id) as pattern from timed group by 1),
      c as (select route_id, direction, pattern, count(*) as trips from p join tlines using (trip_id) group by all)
      select route_id, direction, pattern, trips from c qualify row_number() over (partition by route_id, direction order by trips desc, pattern) = 1""",
    "nearest_stop": f"""with {STOPS}, {POINTS}, n as (select c.key, s.key as s, {_metres('c', 's')} as m from cus c, sup s),
      b as (select key, arg_min(s, (m, s)) as nearest, min(m) as m from n where m <= 2500 group by key)
      select c.key, cast(nearest as varchar) as nearest, {_r('m', 2)} as metres from (select distinct key from cus) c left join b using (key)""",
    "within_radius": f"with {STOPS} select a.key as key_a, b.key as key_b, {_r(_metres('a', 'b'), 2)} as metres from sup a, sup b where a.key < b.key and {_metres('a', 'b')} <= 2500",
    "k_nearest_stops": f"""with {STOPS}, {POINTS} select key, nearest, {_r('m', 2)} as metres, cast(rank as integer) as rank from (
      select c.key, s.key as nearest, {_metres('c', 's')} as m, row_number() over (partition by c.key order by {_metres('c', 's')}, s.key) as rank from cus c, sup s
      where {_metres('c', 's')} <= 5000) where rank <= 3""",
    "points_in_polygon": f"with {POINTS} {_inside('cus')}",
    "raster_min": f"with {CELLS} select cell, {_r('minutes')} as minutes from raster",
    "raster_smooth": f"""with {CELLS}, whole as (select cell, floor(minutes) as minutes from raster),
      o as ({_around([(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)])})
      select cell, {_r("cast(cast(sum(value * case when dy = 0 and dx = 0 then 2 else 1 end) / sum(case when dy = 0 and dx = 0 then 2 else 1 end) as float) as double)", 3)} as minutes
      from o group by cell having bool_or(dy = 0 and dx = 0)""",
    "raster_gaps": f"""with {CELLS}, whole as (select cell, floor(minutes) as minutes from raster), o as ({_around([(-1, 0), (1, 0), (0, -1), (0, 1)])}),
      g as (select cell, avg(value) as filled from o group by cell)
      select coalesce(w.cell, g.cell) as cell, {_r('cast(cast(coalesce(minutes, filled) as float) as double)', 3)} as minutes from whole w full join g on w.cell = g.cell""",
    "coverage_reach": f"""with {CELLS}, p as (select cell as key, lat, lon from cells), covered as ({_inside('p')})
      select {_r('100e0 * count(*) filter (minutes <= 15) / count(*)')} as percent from covered left join raster on covered.key = raster.cell""",
    "delta_decode": "select p_brand, p_partkey, cast(sum(p_size) over (partition by p_brand order by p_partkey) as bigint) as value from part",
    "bounded_reach": REACH,
    "relaxed_reach": REACH,
    "stop_components": f"""with recursive {STOPS}, e as (select a.key as a, b.key as b from sup a, sup b where a.key <> b.key and {_metres('a', 'b')} <= 1500),
      r(node, other) as (select distinct a, a from e union select r.node, e.b from r join e on e.a = r.other)
      select node, min(other) as component from r group by node""",
    "busiest_stop": f"""with {BOARD}, c as (select stop_id, count(*) as n from board group by 1), t as (select * from c where n = (select max(n) from c))
      select case when count(*) = 1 then min(stop_id) end as station, case when count(*) = 1 then '' else string_agg(stop_id, ',' order by stop_id) end as tied, n as passages from t group by n""",
    "peak_headway": f"""with {BOARD}, {TLINES} select route_id, max(n) as peak_passages, {_r('round(cast(60e0 / max(n) as decimal(28,12)), 1)', 1)} as peak_headway from (
      select route_id, stop_id, direction, count(*) as n from board join tlines using (trip_id) where dep >= 28800 and dep < 32400 group by all) group by route_id""",
    "end_to_end": f"""with {TIMED}, {TLINES}, p as (select trip_id, list(stop_id order by seq, st_id) as pattern, arg_max(arr, (seq, st_id)) - arg_min(dep, (seq, st_id)) as duration
        from timed where arr is not null and dep is not null group by 1 having count(*) >= 2),
      runs as (select route_id, pattern, count(*) as n, median(duration) as m from p join tlines using (trip_id) group by all),
      main as (select *, max(n) over (partition by route_id) as most from runs qualify n * 3 >= most),
      best as (select route_id, m, pattern from main qualify row_number() over (partition by route_id order by m desc, pattern desc) = 1)
      select route_id, cast(round_even(m / 60, 0) as integer) as minutes, pattern[1] as first_stop, pattern[-1] as last_stop from best""",
    "rank_lines": f"with {TLINES} select route_id, count(*) as trips, cast(rank() over (order by count(*) desc) as integer) as rank from tlines group by 1",
    "transport_day": f"""with {BOARD}, {TLINES}, f as (select distinct {_key('trip_id')} as trip_id, {_strip('feed_day')} as day from trips),
      t as (select stop_id, route_id, dep + case day when '20260601' then -86400 when '20260603' then 86400 else 0 end as dep
        from board join f using (trip_id) join tlines using (trip_id) where day in ('20260601', '20260602', '20260603')),
      w as (select * from t where dep >= 12600 and dep < 99000),
      x as (select stop_id, min(dep) as a, arg_min(route_id, (dep, route_id)) as la, max(dep) as b from w group by stop_id)
      select x.stop_id, a as first_seconds, la as first_line, b as last_seconds, min(w.route_id) as last_line, {CLOCK.format('a')} as first_time, {CLOCK.format('b')} as last_time
      from x join w on w.stop_id = x.stop_id and w.dep = x.b group by all""",
    "normalise_names": r"""select distinct stop_name, trim(regexp_replace(translate(lower(stop_name), '-’', ' ' || chr(39)), '\s+', ' ', 'g')) as norm from stops where stop_name is not null""",
    "network_waits": f"""with {TIMED}, modes(route_type, mode, low, high) as (values ('3', 'bus', 1, 15), ('700', 'bus', 1, 15), ('4', 'ferry', 2, 20), ('0', 'rail', 1, 10), ('1', 'rail', 1, 10), ('2', 'rail', 1, 10)),
      r as (select distinct {_key('route_id')} as route_id, mode, low, high from routes join modes on {_key('routes.route_type')} = modes.route_type),
      t as (select trip_id, t.route_id as route_id, t.direction as direction from (
        select {_key('trip_id')} as trip_id, min({{'route_id': {_key('route_id')}, 'direction': coalesce({_key('direction_id')}, '0'), 'service_id': {_key('service_id')}}}) as t
        from trips where {_key('route_id')} is not null group by 1) where t.service_id is not null),
      w as (select trip_id, stop_id as a, dep, lead(stop_id) over x as b, lead(arr) over x as arr from timed window x as (partition by trip_id order by seq, st_id, stop_id)),
      h as (select route_id, direction, mode, low, high, a, b from w join t using (trip_id) join r using (route_id) where b is not null and a <> b and dep is not null and arr is not null and dep >= 25200 and dep < 79200),
      ok as (select distinct {_key('stop_id')} as a from stops where {_lat_ok(_strip('stop_lat'))} and {_lon_ok(_strip('stop_lon'))})
      select route_id || ':' || direction as line_id, mode, a as stop_id, count(*) as departures, round_even(900e0 / count(*), 2) as headway,
        cast(round_even(least(high, greatest(low, 450e0 / count(*))), 2) as double) as wait from h join ok using (a) group by route_id, direction, mode, low, high, a""",
    "display_names": """select distinct upper(p_name) as name, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as shown from part""",
    "route_modes": """select t as route_type, case when v = 0 or v between 900 and 999 then 'tram' when v in (1, 2) or v between 100 and 199 or v between 400 and 499 then 'metro'
      when v = 7 or v between 1400 and 1499 then 'funicular' when v in (5, 6) or v between 1300 and 1399 then 'cable' when v = 4 or v between 1000 and 1299 then 'ferry' else 'bus' end as mode
      from (select distinct cast(case when p_partkey % 2 = 0 then p_size else p_partkey end as varchar) as t, cast(t as integer) as v from part)""",
    "folded_names": "select distinct route_id, lower(strip_accents(route_long_name)) as folded from routes",
    "link_parse": """with l as (select c_custkey as k, cast(41.5 + c_custkey % 50 / 100.0e0 as decimal(8,3)) as lat, cast(c_custkey % 40 / 100.0e0 as decimal(8,3)) as lon, c_custkey % 200 as m,
        case c_custkey % 3 when 0 then 'to' when 1 then 'from' else 'up' end as dir from customer), q as (select *, lat between 41.5 and 41.7 and lon between 0 and 0.2 as ok from l)
      select k as key, case when ok then cast(lat as double) end as lat, case when ok then cast(lon as double) end as lon, cast(least(120, greatest(5, m)) as integer) as max_minutes,
        case when dir = 'up' then 'from' else dir end as direction, concat_ws(',', case when not ok then 'o' end, case when dir = 'up' then 'dir' end) as ignored, 4 as parameters from q""",
    "clock_texts": f"with {TIMED} select distinct dep, {CLOCK.format('dep')} as shown, cast(case when dep > 0 then greatest(1, floor(dep / 60e0 + 0.5)) else 0 end as integer) as minutes from timed where dep is not null",
    "feed_merge": """select cast(s_suppkey as varchar) as stop_id, s_name as stop_name, cast(s_nationkey as varchar) as zone from supplier
      union all select 'x:' || c_custkey, c_name, null from customer""",
    "direction_waits": f"""with {TIMED}, {TLINES}, known as (select distinct {_key('stop_id')} as stop_id from stops),
      t as (select trip_id, stop_id as a, lead(stop_id) over (partition by trip_id order by seq, stop_id, arr, dep) as b from timed join known using (stop_id) where arr is not null),
      n as (select a, route_id, direction, count(*) as n from t join tlines using (trip_id) where b is not null and a <> b group by all)
      select a as complex_id, route_id, {_r('round_even(least(15e0, greatest(1e0, 450e0 / avg(n))), 2)', 1)} as wait from n group by 1, 2""",
    "street_segments": f"""with {TIMED}, pos as (select {_key('stop_id')} as k, min({{'lat': cast({_strip('stop_lat')} as double), 'lon': cast({_strip('stop_lon')} as double)}}) as p
        from stops where {_lat_ok(_strip('stop_lat'))} and {_lon_ok(_strip('stop_lon'))} group by 1),
      s as (select trip_id, stop_id as u, lead(stop_id) over w as v, row_number() over w as i from timed window w as (partition by trip_id order by seq, st_id)),
      f as (select arg_min({{'u': u, 'v': v, 'way': trip_id}}, (trip_id, i)) as f from s where v is not null and u <> v group by least(u, v), greatest(u, v)),
      g as (select f.u as u, f.v as v, f.way as way, a.p as a, b.p as b from f join pos a on a.k = f.u join pos b on b.k = f.v)
      select u as a, v as b, way, {_r(_metres('a', 'b'), 2)} as metres from g""",
    "street_junctions": f"""with {STREET}, ends as (select a as node, m % 2 as c from edges union all select b, m % 2 from edges)
      select node from ends group by node having count(*) <> 2 or count(distinct c) > 1 union select min(node) from ends""",
}
