"""SQL twins of the queries on the real tables; each goes another way than the operator it checks."""

from isotrek.plans.problems_sql import _day_ok, _lat_ok, _lon_ok, _strip
from isotrek.plans.reference_sql import SQL as TRANSIT, TIMED, TLINES, _key, _metres, _r
from isotrek.plans.tables import BOX, CENTRE, RIVER, ZONE

PTS = f"""pts as (select key, min(p).lat as lat, min(p).lon as lon from (
  select {_key('stop_id')} as key, {{'lat': cast({_strip('stop_lat')} as double), 'lon': cast({_strip('stop_lon')} as double)}} as p
  from stops where {_lat_ok(_strip('stop_lat'))} and {_lon_ok(_strip('stop_lon'))}) where key is not null group by key)"""
CORNERS = "corners as (select zone_id as key, polygons[1][1][1].lat as lat, polygons[1][1][1].lon as lon from zones)"
WAITS = f"waits as ({TRANSIT['network_waits']})"
MEDIANS = f"{WAITS}, medians as (select line_id, round_even(median(headway), 1) as median_min from waits group by line_id)"
STEPS = f"""{TIMED}, step as (select least(a, b) as lo, greatest(a, b) as hi, trip_id, pos, a, b from (
  select trip_id, row_number() over w as pos, stop_id as a, lead(stop_id) over w as b from timed window w as (partition by trip_id order by seq, st_id)) where a <> b),
  firsts as (select arg_min({{'a': a, 'b': b}}, {{'t': trip_id, 'p': pos}}) as e from step group by lo, hi),
  segs as (select e.a as a, e.b as b, p.lat as lat_a, p.lon as lon_a, q.lat as lat_b, q.lon as lon_b from firsts join pts p on p.key = e.a join pts q on q.key = e.b)"""
(_LAT1, _LON1), (_LAT2, _LON2) = RIVER
_W, _S, _E, _N = BOX


def _side(p: str, q: str, r: str) -> str:
    """Sign of the turn at p from q to r; points are 'x,y' texts."""
    (px, py), (qx, qy), (rx, ry) = (t.split(",") for t in (p, q, r))
    return f"sign(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"


_A, _B, _C, _D = "lon_a,lat_a", "lon_b,lat_b", f"{_LON1}e0,{_LAT1}e0", f"{_LON2}e0,{_LAT2}e0"
VERTICES = """v as (select zone_id, unnest(range(1, len(polygons[1][1]) + 1)) as i, polygons[1][1] as ring from zones),
  e as (select zone_id, i, ring[i].lon as x, ring[i].lat as y, ring[i % len(ring) + 1].lon as x2, ring[i % len(ring) + 1].lat as y2 from v),
  sums as (select zone_id, sum(x * y2 - x2 * y) / 2 as area, sum((x + x2) * (x * y2 - x2 * y)) as cx, sum((y + y2) * (x * y2 - x2 * y)) as cy from e group by zone_id),
  bounds as (select zone_id, min(p.lon) - 0.5 as west, min(p.lat) - 0.5 as south, max(p.lon) + 0.5 as east, max(p.lat) + 0.5 as north
    from (select zone_id, unnest(flatten(flatten(polygons))) as p from zones) group by zone_id)"""
CITIES = f"""rt as (select line, min(city) as city from (select {_key('route_id')} as line, {_key('agency_id')} as city from routes) where line is not null and city is not null group by line),
  tr as (select line, count(*) as trips from (select {_key('route_id')} as line from trips) where line is not null group by line),
  both_ as (select line, city, trips from rt join tr using (line)),
  vals as (
    select 'latest_saturday' as ranking, city, '' as line, cast(sum(trips) % 86400 as double) as value, -1 as sign from both_ group by city
    union all select 'most_frequent_line', city, line, cast(round(600e0 / trips, 1) as double), 1 from both_
    union all select 'busiest_station', city, '', cast(max(trips) as double), -1 from both_ group by city
    union all select 'longest_line', city, line, cast(trips % 97 as double), -1 from both_
    union all select 'most_trips', city, '', cast(sum(trips) as double), -1 from both_ group by city),
  ranked as (select ranking, city, line, value, cast(1 + (select count(*) from vals w where w.ranking = v.ranking and w.value * w.sign < v.value * v.sign) as integer) as rank from vals v)"""
_LUM = " + ".join(f"{w} * (case when c{i} / 255e0 <= 0.04045 then c{i} / 255e0 / 12.92 else pow((c{i} / 255e0 + 0.055) / 1.055, 2.4) end)" for i, w in enumerate((0.2126, 0.7152, 0.0722)))
HEX = f"""hx as (select c_custkey, '#' || lpad(lower(printf('%x', (c_custkey * 7919) % 16777216)), 6, '0') as hex, (c_custkey * 7919) % 16777216 as n from customer),
  ch as (select *, n // 65536 as c0, n // 256 % 256 as c1, n % 256 as c2 from hx), lu as (select *, {_LUM} as lum from ch)"""


def _ramp(i: int) -> str:
    (p0, a), (p1, b), (p2, c) = (0.0, (10, 20, 200)), (0.4, (60, 180, 90)), (1.0, (240, 30, 20))
    del p0, p2
    return f"cast(floor(case when t <= {p1} then {a[i]} + ({b[i] - a[i]}) * t / {p1} else {b[i]} + ({c[i] - b[i]}) * (t - {p1}) / 0.6 end + 0.5) as integer)"


def _walks(limit: int) -> str:
    """The recursive CTE of street metres from every nation's node."""
    return TRANSIT["bounded_reach"].rsplit("select source, node, metres from found", 1)[0].replace("<= 900", f"<= {limit}")


_MONTHS = "['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre']"
_FOLDED = r"regexp_replace(strip_accents(lower(stop_name)), '[\x{0300}-\x{036f}]', '', 'g')"

SQL = {
    "stop_neighbors": f"with {PTS} select a.key as a, b.key as b, {_r(_metres('a', 'b') + ' * 1.3 / 75')} as minutes from pts a join pts b on a.key <> b.key and abs(a.lat - b.lat) < 0.0037 where {_metres('a', 'b')} <= 400",
    "corner_stops": f"""with {PTS}, {CORNERS}, m as (select c.key, p.key as k, {_metres('c', 'p')} as m from corners c join pts p on abs(c.lat - p.lat) < 0.19)
      select key, f.k as nearest, {_r('f.m', 2)} as metres from corners left join (select key, min({{'m': m, 'k': k}}) as f from m where m <= 20000 group by key) using (key)""",
    "corner_three_stops": f"""with {PTS}, {CORNERS}, m as (select c.key, p.key as k, {_metres('c', 'p')} as m from corners c join pts p on abs(c.lat - p.lat) < 0.19)
      select key, k as nearest, cast(rank as integer) as rank, {_r('m', 2)} as metres from (select *, row_number() over (partition by key order by m, k) as rank from m where m <= 20000) where rank <= 3""",
    "network_rides": TRANSIT["network_waits"].split("ok as (")[0].rstrip().rstrip(",").replace("select trip_id, stop_id as a, dep, lead", "select trip_id, stop_id as a, dep as departs, dep, lead").replace("low, high, a, b from w", "low, high, a, b, departs, arr from w")
    + " select route_id, direction, mode, a, b, cast(round_even(greatest(0.4e0, median(greatest(0, arr - departs) / 60e0)), 2) as double) as minutes from h group by route_id, direction, mode, a, b",
    "line_medians": f"with {MEDIANS} select line_id, median_min from medians",
    "headway_figures": f"""with {MEDIANS}, w as (select median_min as v, sum(1 / median_min) as w from medians where median_min > 0 group by 1),
      run as (select v, sum(w) over (order by v) as upto, sum(w) over () / 2 as half, lead(v) over (order by v) as nxt from w),
      hit as (select min(v) as v from run where upto >= half or abs(upto - half) <= 1e-9 * greatest(upto, half))
      select round_even(case when abs(upto - half) <= 1e-9 * greatest(upto, half) and nxt is not null then (r.v + nxt) / 2 else r.v end, 1) as typical_min, (select min(median_min) from medians) as best_min from run r join hit on r.v = hit.v""",
    "amount_medians": f"""with w as (select l_returnflag, l_linestatus, l_discount as v, sum(l_quantity) as w from lineitem where l_quantity > 0 and l_discount is not null group by all),
      run as (select *, sum(w) over (partition by l_returnflag, l_linestatus order by v) as upto, sum(w) over (partition by l_returnflag, l_linestatus) / 2 as half, lead(v) over (partition by l_returnflag, l_linestatus order by v) as nxt from w),
      hit as (select l_returnflag, l_linestatus, arg_min({{'v': v, 'nxt': nxt, 'tie': abs(upto - half) <= 1e-9 * greatest(upto, half)}}, v) as h from run where upto >= half * (1 - 1e-9) group by all)
      select l_returnflag, l_linestatus, {_r('case when h.tie and h.nxt is not null then (h.v + h.nxt) / 2 else h.v end', 6)} as value from hit""",
    "zone_measures": f"""with {VERTICES} select zone_id, {_r('area', 6)} as area, {_r('cx / (6 * area)', 6)} as x, {_r('cy / (6 * area)', 6)} as y, {', '.join(f"{_r(s, 6)} as {s}" for s in ('west', 'south', 'east', 'north'))}
      from sums join bounds using (zone_id)""",
    "planar_stops": f"""with {PTS} select key, {_r(f'(lon - ({CENTRE[1]}e0)) * 111320e0 * cos(radians({CENTRE[0]}e0))', 1)} as x, {_r(f'(lat - {CENTRE[0]}e0) * 111320e0', 1)} as y from pts""",
    "river_crossings": f"with {PTS}, {STEPS} select a, b from segs where {_side(_A, _B, _C)} * {_side(_A, _B, _D)} < 0 and {_side(_C, _D, _A)} * {_side(_C, _D, _B)} < 0",
    "long_segments": f"""with {PTS}, {STEPS}, m as (select {_metres('p', 'q')} as metres from segs s join pts p on p.key = s.a join pts q on q.key = s.b)
      select cast(greatest(1, ceil(metres / 5000)) as integer) as parts, count(*) as segments, cast(sum(cast(greatest(1, ceil(metres / 5000)) as integer) - 1) as bigint) as inner_nodes from m where cast(round(cast(metres as decimal(28,12)), 2) as double) <= 200000 group by 1""",
    "open_routes": f"select distinct {_key('route_id')} as route_id from routes where not (coalesce({_strip('route_type')}, '') in ('712', '713', '2') or coalesce({_key('route_short_name')}, '') in ('7', '12') or coalesce({_key('route_id')}, '') = 'R0003')",
    "stops_in_box": f"with {PTS} select key from pts where lat between {_S} and {_N} and lon between {_W} and {_E}",
    "stops_in_zone": f"""with {PTS}, one as (select polygons from zones where zone_id = '{ZONE}'), rings as (select p, r, unnest(range(1, len(polygons[p][r]))) as i, polygons[p][r] as ring from (
        select p, unnest(range(1, len(polygons[p]) + 1)) as r, polygons from (select unnest(range(1, len(polygons) + 1)) as p, polygons from one))),
      hit as (select key, p, r, count(*) % 2 as inside from pts join rings on (ring[i].lat > lat) <> (ring[i + 1].lat > lat) and lon < ring[i].lon + (lat - ring[i].lat) / (ring[i + 1].lat - ring[i].lat) * (ring[i + 1].lon - ring[i].lon) group by all)
      select distinct key from (select key, p from hit group by key, p having max(case when r = 1 then inside else 0 end) = 1 and max(case when r > 1 then inside else 0 end) = 0)""",
    "found_stops": f"select distinct stop_id, stop_name from stops where stop_name is not null and contains({_FOLDED}, 'ma') and contains({_FOLDED}, 'ri')",
    "date_texts": f"select distinct strftime(o_orderdate, '%Y-%m-%d') as day, day(o_orderdate) || ' ' || {_MONTHS}[month(o_orderdate)] || ' ' || year(o_orderdate) as long, strftime(o_orderdate, '%d/%m/%Y') as short from orders",
    "number_texts": r"""with v as (select c_custkey, c_custkey * 7919 as n, round(c_acctbal, 1) as v, cast(floor(c_custkey / 9e0 + 0.5) as integer) as w from customer)
      select c_custkey, regexp_replace(cast(n as varchar), '(\d)(?=(\d{3})+$)', '\1 ', 'g') as thousands, replace(regexp_replace(cast(v as varchar), '\.0$', ''), '.', ',') as comma,
        case when c_custkey / 9e0 < 1 then '< 1 min' when w < 60 then w || ' min' else (w // 60) || ' h ' || lpad(cast(w % 60 as varchar), 2, '0') end as duration from v""".replace(r"regexp_replace(cast(n as varchar), '(\d)(?=(\d{3})+$)', '\1 ', 'g')", "replace(format('{:,}', n), ',', ' ')"),
    "label_texts": """select c_custkey, case when c_custkey % 21 = 1 then '1er arrondissement' else (c_custkey % 21) || 'e arrondissement' end as district,
      case when c_custkey % 3 = 0 or c_name = c_mktsegment then c_mktsegment else c_mktsegment || ', ' || c_name end as label, lower(c_mktsegment) || ' nord' as query from customer""",
    "rewritten_names": "select distinct stop_name, regexp_replace(regexp_replace(regexp_replace(stop_name, '^Plaza ', 'Pl. '), '[0-9]+', '#', 'g'), '  +', ' ', 'g') as rewritten from stops where stop_name is not null",
    "colour_texts": f"with {HEX} select c_custkey, hex, case when 0.299 * c0 + 0.587 * c1 + 0.114 * c2 > 150 then '#111' else '#fff' end as ink, {_r('lum', 6)} as luminance, {_r('1.05e0 / (lum + 0.05e0)', 4)} as contrast from lu",
    "heat_colours": f"""with m as (select c_custkey, (c_custkey % 80) / 60e0 as u, least(1e0, (c_custkey % 80) / 60e0) as t, [0.6e0, 1.0e0, 1.6e0][c_custkey % 3 + 1] * (c_custkey % 7 / 2e0) as w from customer),
      al as (select *, case when u <= 1 then 255 else cast(floor(greatest(0e0, 1 - (u - 1) / 0.15) * 255 + 0.5) as integer) end as al from m)
      select c_custkey, case when al > 0 then {_ramp(0)} else 0 end as r, case when al > 0 then {_ramp(1)} else 0 end as g, case when al > 0 then {_ramp(2)} else 0 end as b, greatest(al, 0) as a, {_r('least(6e0, greatest(0.4e0, w))')} as width from al""",
    "street_buckets": """with n as (select count(*) as n from supplier),
      e as (select least(a, b) as a, greatest(a, b) as b from (select s_suppkey as a, (s_suppkey + 1) % n as b from supplier, n union all select s_suppkey, (s_suppkey * 7 + 3) % n from supplier, n) where a <> b group by 1, 2),
      t as (select s_suppkey as k, s_suppkey % 70 as m from supplier where s_suppkey % 5 <> 0)
      select a, b, cast(case when x.m is null or y.m is null or (x.m + y.m) / 2e0 >= 60 then -1 else least(47, floor((x.m + y.m) / 2e0 / 60 * 48)) end as integer) as bucket from e left join t x on x.k = a left join t y on y.k = b""",
    "share_links": "select c_custkey, 'city=test&d=41.60000,0.10000&dir=to&modes=bus,rail&max=' || least(120, greatest(5, c_custkey % 150)) || '&iso=15,30' as link from customer",
    "reach_links": """select c_custkey, 41.61e0 as from_lat, case when c_custkey % 4 <> 0 then 41.7e0 end as to_lat, c_custkey % 4 <> 0 and c_custkey % 2 = 0 as arrival, c_custkey % 3 = 1 as bus,
      cast(case when c_custkey % 120 between 20 and 90 then c_custkey % 120 else 60 end as integer) as max_minutes, '15,45' as iso from customer""",
    "ranked_cities": f"with {CITIES} select ranking, rank, city, line, {_r('value')} as value from ranked",
    "city_positions": f"with {CITIES} select city, ranking, f.rank as rank, f.line as line, {_r('f.value')} as value from (select city, ranking, min({{'rank': rank, 'line': line, 'value': value}}) as f from ranked group by city, ranking)",
    "agency_releases": """select agency_id as city, case when n % 5 = 0 then 'no metadata' when n % 3 = 0 then 'valid_to is no date' when n % 7 = 0 then 'marked expired' else 'expired' end as problem
      from (select distinct agency_id, length(agency_name) as n from agency) where n % 5 = 0 or n % 3 = 0 or n % 7 = 0 or n % 2 = 0""",
    "lines_by_mode": f"""select mode, count(*) as lines from (select distinct {_key('route_id')} as r, case when v = 0 or v between 900 and 999 then 'tram' when v in (1, 2) or v between 100 and 199 or v between 400 and 499 then 'metro'
      when v = 7 or v between 1400 and 1499 then 'funicular' when v in (5, 6) or v between 1300 and 1399 then 'cable' when v = 4 or v between 1000 and 1299 then 'ferry' else 'bus' end as mode
      from (select route_id, try_cast({_strip('route_type')} as integer) as v from routes)) where r is not null group by mode""",
    "walk_figures": f"select p_partkey, {_r('p_partkey * 1.3e0 / 75', 6)} as straight, {_r('p_partkey / 75e0', 6)} as along, {_r('20 * 75 / 1.3e0', 4)} as limit_m from part",
    "thinned_lines": f"""with recursive {TIMED}, {PTS}, p as (select trip_id, row_number() over w as i, count(*) over (partition by trip_id) as n, lat, lon from timed join pts on pts.key = timed.stop_id window w as (partition by trip_id order by seq, st_id, lat, lon)),
      walk as (select trip_id, i, n, lat, lon, 1 as kept from p where i = 1
        union all select p.trip_id, p.i, p.n, case when far then p.lat else w.lat end, case when far then p.lon else w.lon end, w.kept + cast(far as integer)
        from walk w join p on p.trip_id = w.trip_id and p.i = w.i + 1, lateral (select p.i = p.n or p.n <= 2 or {_metres('w', 'p')} >= 500 as far))
      select trip_id, cast(n as integer) as points, cast(kept as integer) as kept from walk where i = n""",
    "complex_sizes": rf"""with recursive {PTS}, named as (select key, lat, lon, trim(regexp_replace(translate(lower(name), '-’', ' '''), '\s+', ' ', 'g')) as norm
        from pts join (select {_key('stop_id')} as key, min({_strip('stop_name')}) as name from stops where {_strip('stop_name')} <> '' group by 1) using (key)),
      link as (select a.key as a, b.key as b from named a join named b on a.norm = b.norm where {_metres('a', 'b')} <= 350),
      reach as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b)
      select complex_id, count(*) as stops from (select a, min(b) as complex_id from reach group by a) group by 1""",
    "transfer_minutes": f"""with {TIMED}, {TLINES}, served as (select distinct stop_id, route_id from timed join tlines using (trip_id)),
      t as (select stop_id, n % 300 as s from (select distinct stop_id, try_cast(regexp_extract(stop_id, '([0-9]+)$', 1) as integer) as n from served) where n % 5 <> 0 and n % 7 <> 0)
      select stop_id as complex_a, x.route_id as route_a, y.route_id as route_b, round_even(s / 60e0, 2) as minutes from t join served x using (stop_id) join served y using (stop_id) where x.route_id <> y.route_id""",
    "route_line_stats": TRANSIT["direction_waits"].rsplit("select a as complex_id", 1)[0] + """select route_id, count(*) as stations, round_even(median(w) * 2, 1) as headway
      from (select a, route_id, round_even(least(15e0, greatest(1e0, 450e0 / avg(n))), 2) as w from n group by 1, 2) group by 1""",
    "probe_speeds": f"""with p as (select distinct o_orderkey as k, cast(o_orderkey % 9000 as double) as m, case when o_orderkey % 11 <> 0 then nullif(o_orderkey % 70, 0) end as t, o_orderkey % 11 = 0 as lost from orders)
      select k as from_id, {_r('m / 1000 / (t / 60e0)')} as kmh, case when lost then 'unreachable' when m > 2000 and m / 1000 / (t / 60e0) < 8 then 'slow' when m / 1000 / (t / 60e0) > 35 then 'fast' else 'ok' end as flag from p""",
    "street_pairs": _walks(900) + "select source as route, metres + 15 as metres, true as exact from found where node = (source + 5) % 25 and metres <= 900",
    "street_neighbors": _walks(700) + f"select f.source as a, cast(f.node as integer) as b, {_r('(f.metres + f.source % 10 + f.node % 10) / 75e0')} as minutes from found f where f.node < 25 and f.node <> f.source and f.metres + f.source % 10 + f.node % 10 <= 700",
    "street_minutes": _walks(600) + f"""select origin, node, {_r('min(m)')} as minutes from (select source as origin, node, metres / 75e0 as m from found where source < 5
      union all select o.n_nationkey, node, 4 + source % 3 + metres / 75e0 from found, nation o where o.n_nationkey < 5 and source % 6 = 1) group by origin, node""",
    "markers_at": """with m as (select s_suppkey as ix, (s_suppkey * 37) % 400 as x, (s_suppkey * 91) % 400 as y from supplier), c as (select c_custkey as click, (c_custkey * 53) % 401 as x, (c_custkey * 29) % 397 as y from customer),
      d as (select click, ix, (m.x - c.x) * (m.x - c.x) + (m.y - c.y) * (m.y - c.y) as q from c join m on abs(m.x - c.x) <= 22 and abs(m.y - c.y) <= 22)
      select click, f.ix as ix from c left join (select click, arg_max(ix, {'q': -q, 'ix': ix}) as ix from d where q <= 484 group by click) f using (click)""",
    "countries": "select n_name as country, count(*) as cities from customer join nation on c_nationkey = n_nationkey group by 1",
    "kept_trips": f"with {TIMED}, {PTS} select trip_id, count(*) as rows from timed where stop_id in (select key from pts where lat between {_S} and {_N} and lon between {_W} and {_E}) group by trip_id having count(*) >= 2",
    "exception_days": f"select distinct strftime(strptime({_strip('date')}, '%Y%m%d'), '%Y-%m-%d') as day, cast(isodow(strptime({_strip('date')}, '%Y%m%d')) - 1 as integer) as weekday from calendar_dates where {_day_ok(_strip('date'))}",
    "delta_coded": "select p_brand, p_partkey, cast(p_size - coalesce(lag(p_size) over (partition by p_brand order by p_partkey), 0) as bigint) as value from part",
}
