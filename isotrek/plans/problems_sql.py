"""SQL twins of the pN_ queries that SQL can express; each goes another way than the operator it checks."""

_WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(column: str) -> str:
    return rf"regexp_replace({column}, '^{_WS}+|{_WS}+$', '', 'g')"


_DECIMAL = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _lat_ok(value: str) -> str:
    return f"(regexp_full_match({value}, '{_DECIMAL}') and abs(try_cast({value} as double)) <= 90)"


def _lon_ok(value: str) -> str:
    return f"(regexp_full_match({value}, '{_DECIMAL}') and abs(try_cast({value} as double)) <= 180)"


def _day_ok(value: str) -> str:
    return f"(regexp_full_match({value}, '[0-9]{{8}}') and try_strptime({value}, '%Y%m%d') is not null)"


_RAW_FIELDS = rf"""with lines as (
  select line_id, feed_file, line_no, regexp_replace(line, '^\x{{feff}}+|[\r\n]+$', '', 'g') as line
  from raw_lines where line is not null),
heads as (
  select feed_file, arg_min(line, line_id) as head from lines where line_no = 1 group by feed_file),
fields as (
  select line_id, feed_file, head, line,
    regexp_full_match(line, '(?s)("([^"]|"")*"|[^",\r\n]*)(,("([^"]|"")*"|[^",\r\n]*))*') as well_formed,
    list_transform(regexp_extract_all(line || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1),
      lambda v: regexp_replace(case when starts_with(v, '"') then replace(v[2:len(v) - 1], '""', '"') else v end, '^{_WS}+|{_WS}+$', '', 'g')) as vals,
    list_transform(string_split(head, ','), lambda v: {_strip('v')}) as names
  from lines left join heads using (feed_file)
  where line_no <> 1 and regexp_replace(line, '{_WS}', '', 'g') <> '')"""

P3 = rf"""
{_RAW_FIELDS},
judged as (
  select line_id, well_formed, names, len(vals) as n,
    vals[list_position(names, case when feed_file like '%/stops.txt' then 'stop_lat' when feed_file like '%/stop_times.txt' then 'stop_sequence' else 'start_date' end)] as v, feed_file
  from fields)
select distinct src, rec_key, reason from (
  select 'stops' as src, {_strip('stop_id')} as rec_key, 'invalid_value' as reason from stops
    where not coalesce({_lat_ok(_strip('stop_lat'))}, false)
  union all
  select 'stop_times', cast(st_id as varchar), 'invalid_value' from stop_times
    where not coalesce(regexp_full_match({_strip('stop_sequence')}, '[0-9]+'), false)
  union all
  select 'calendar', cast(cal_id as varchar), 'invalid_value' from calendar
    where not coalesce({_day_ok(_strip('start_date'))}, false)
  union all
  select 'raw_lines', cast(line_id as varchar), case
      when not well_formed then 'quoting'
      when n <> len(names) then 'column_count'
      when not coalesce(case when feed_file like '%/stops.txt' then {_lat_ok('v')}
        when feed_file like '%/stop_times.txt' then regexp_full_match(v, '[0-9]+') else {_day_ok('v')} end, false) then 'invalid_value' end
    from judged)
where reason is not null
"""

_RAW_VALID = f"""(case when feed_file like '%/stops.txt' then {_lat_ok('judged')}
        when feed_file like '%/stop_times.txt' then regexp_full_match(judged, '[0-9]+') else {_day_ok('judged')} end)"""


def _raw(field: str) -> str:
    return f"nullif(vals[list_position(names, '{field}')], '')"


_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
P3_LOADED = rf"""
{_RAW_FIELDS},
named as (
  select *, vals[list_position(names, case when feed_file like '%/stops.txt' then 'stop_lat' when feed_file like '%/stop_times.txt' then 'stop_sequence' else 'start_date' end)] as judged,
    regexp_extract(feed_file, '([a-z_]+)\.txt$', 1) as src
  from fields where well_formed and len(vals) = len(names))
select src, line_id, {_raw('stop_id')} as stop_id, {_raw('stop_name')} as stop_name,
  try_cast(case when regexp_full_match({_raw('stop_lat')}, '{_DECIMAL}') then {_raw('stop_lat')} end as double) as stop_lat,
  try_cast(case when regexp_full_match({_raw('stop_lon')}, '{_DECIMAL}') then {_raw('stop_lon')} end as double) as stop_lon,
  {_raw('trip_id')} as trip_id, {_raw('arrival_time')} as arrival_time, {_raw('departure_time')} as departure_time,
  try_cast(case when regexp_full_match({_raw('stop_sequence')}, '[0-9]+') then {_raw('stop_sequence')} end as bigint) as stop_sequence,
  {_raw('service_id')} as service_id, {', '.join(f"case {_raw(x)} when '1' then true when '0' then false end as {x}" for x in _DAYS)},
  {', '.join(f"case when {_day_ok(_raw(x))} then {_raw(x)}[1:4] || '-' || {_raw(x)}[5:6] || '-' || {_raw(x)}[7:8] end as {x}" for x in ('start_date', 'end_date'))}
from named where coalesce({_RAW_VALID}, list_position(names, case when src = 'stops' then 'stop_lat' when src = 'stop_times' then 'stop_sequence' else 'start_date' end) is null)
"""

P4 = f"""
with placed as (
  select distinct {_strip('stop_id')} as k, cast({_strip('stop_lat')} as double) as lat, cast({_strip('stop_lon')} as double) as lon
  from stops where {_lat_ok(_strip('stop_lat'))} and {_lon_ok(_strip('stop_lon'))}),
edges as (
  select zone_id, p as polygon, ring[i] as a, ring[i + 1] as b from (
    select zone_id, p, ring, unnest(range(1, len(ring))) as i from (
      select zone_id, p, unnest(polygons[p]) as ring from (select zone_id, polygons, unnest(range(1, len(polygons) + 1)) as p from zones))))
select distinct 'near' as kind, a.k as key_a, b.k as key_b
from placed a join placed b on a.k < b.k and abs(a.lat - b.lat) < 0.00136
where 2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 150
union all
select distinct 'zone', k, zone_id from (
  select k, zone_id, polygon, lat, lon from placed join edges on (a.lat <= lat) <> (b.lat <= lat)
    and lon < a.lon + (lat - a.lat) / (b.lat - a.lat) * (b.lon - a.lon)
  group by all having count(*) % 2 = 1)
"""


def _orphans(child: str, field: str, key: str, parent: str, deleted: str) -> str:
    return f"""
  select distinct '{child}' as src, '{field}' as field, {key} as rec_key, feed_day[1:4] || '-' || feed_day[5:6] as ref_month,
    case when not exists (select 1 from {parent} p where {_strip(f'p.{field}')} = {_strip(f'c.{field}')}) then 'missing'
      when not exists (select 1 from {parent} p where {_strip(f'p.{field}')} = {_strip(f'c.{field}')} and ({deleted} is null or {deleted} > c.received_at)) then 'deleted'
      when not exists (select 1 from {parent} p where {_strip(f'p.{field}')} = {_strip(f'c.{field}')} and p.received_at <= c.received_at) then 'late' end as kind
  from {child} c where {_strip(f'c.{field}')} <> ''"""


P5 = f"""select * from (
{_orphans('trips', 'route_id', _strip('trip_id'), 'routes', 'p.deleted_at')}
  union all {_orphans('stop_times', 'trip_id', 'cast(st_id as varchar)', 'trips', 'p.deleted_at')}
  union all {_orphans('stop_times', 'stop_id', 'cast(st_id as varchar)', 'stops', 'p.deleted_at')})
where kind is not null"""

P6 = f"""
with cal as (
  select {_strip('service_id')} as s, {_strip('start_date')} as a, {_strip('end_date')} as b from calendar),
spans as (
  select s, cast(strptime(a, '%Y%m%d') as date) as a, cast(strptime(b, '%Y%m%d') as date) as b from cal where {_day_ok('a')} and {_day_ok('b')}),
decided as (
  select {_strip('service_id')} as s, cast(strptime({_strip('date')}, '%Y%m%d') as date) as d, arg_max({_strip('exception_type')}, cd_id) as t
  from calendar_dates where {_strip('exception_type')} in ('1', '2') and {_day_ok(_strip('date'))} group by 1, 2),
days as (
  (select distinct s, cast(unnest(generate_series(a, b, interval 1 day)) as date) as d from spans where a <= b
   union select s, d from decided where t = '1')
  except select s, d from decided where t = '2'),
runs as (
  select s, min(d) as a, max(d) as b from (select s, d, d - cast(row_number() over (partition by s order by d) as integer) as g from days) group by s, g),
beside as (select s, a, b, lead(a) over (partition by s order by a) as n from runs)
select s as service_id, 'period' as kind, strftime(a, '%Y%m%d') as first_day, strftime(b, '%Y%m%d') as last_day from beside where s <> ''
union all
select s, 'gap', strftime(b + 1, '%Y%m%d'), strftime(n - 1, '%Y%m%d') from beside where n is not null and s <> ''
"""

_TIMES = " union all ".join(f"select '{f}' as field, {_strip(f)} as value from stop_times where {_strip('trip_id')} <> ''" for f in ("arrival_time", "departure_time"))
P1_MASKS = f"""select field, regexp_replace(regexp_replace(value, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') as mask, count(*) as n
from ({_TIMES}) where value <> '' group by 1, 2"""

P5_REPORT = f"""with direct as ({P5}),
trip_rows as (
  select t.*, {_strip('t.trip_id')} as k, {_strip('t.route_id')} <> '' and (
    not exists (select 1 from routes r where {_strip('r.route_id')} = {_strip('t.route_id')})
    or not exists (select 1 from routes r where {_strip('r.route_id')} = {_strip('t.route_id')} and (r.deleted_at is null or r.deleted_at > t.received_at))
    or not exists (select 1 from routes r where {_strip('r.route_id')} = {_strip('t.route_id')} and r.received_at <= t.received_at)) as orphan
  from trips t),
lost as (select k from trip_rows where k <> '' group by k having bool_and(coalesce(orphan, false))),
heirs as (
  select distinct 'stop_times' as src, 'trip_id' as field, cast(st_id as varchar) as rec_key, feed_day[1:4] || '-' || feed_day[5:6] as ref_month, 'inherited' as kind
  from stop_times where {_strip('trip_id')} in (select k from lost)
    and cast(st_id as varchar) not in (select rec_key from direct where src = 'stop_times' and field = 'trip_id'))
select src, field, ref_month, kind, count(*) as orphans from (select * from direct union all select * from heirs) group by 1, 2, 3, 4"""

SQL = {"p1_masks": P1_MASKS, "p5_report": P5_REPORT, "p3_found": P3, "p3_loaded": P3_LOADED, "p4_found": P4, "p5_found": P5, "p6_found": P6}
