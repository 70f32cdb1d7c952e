"""Oracle SQL per registered key (DuckDB dialect, driver's tables as views)."""

from __future__ import annotations

import math

from blockwise.oracle import (
    LOOKUP,
    NAMES,
    OBS,
    OLD_ATLAS,
    RAW,
    SEASONS,
    TZ,
    classified_sql,
    from_utc_sql,
    nd,
    summary_sql,
    sun_sql,
)

ORACLE: dict[str, str] = {}
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKS = [f"{m} {i}" for m in MONTHS for i in range(1, 5)]


def rnd(cols: list[str]) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)


def fixed_sql(src: str) -> str:
    return f"""dupes AS (
  SELECT checklist_id FROM (SELECT DISTINCT checklist_id, observation_datetime FROM {src})
  GROUP BY checklist_id HAVING count(*) > 1
),
exploded AS (
  SELECT checklist_id, observation_datetime, unnest(string_split(observer_id, ',')) AS obs_one
  FROM (SELECT DISTINCT pba3_block, checklist_id, observer_id, observation_datetime FROM {src}
        WHERE checklist_id IN (SELECT checklist_id FROM dupes))
),
fixed AS (
  SELECT checklist_id, observation_datetime AS fixed FROM (
    SELECT checklist_id, observation_datetime,
      row_number() OVER (PARTITION BY checklist_id ORDER BY count(*) DESC, observation_datetime) AS rn
    FROM exploded WHERE observation_datetime IS NOT NULL GROUP BY checklist_id, observation_datetime
  ) WHERE rn = 1
)"""


W = "WITH " + OBS
WF = W + ",\n" + fixed_sql("obsr")
FAN = "fan AS (SELECT s.season, o.* FROM obsr o JOIN seasons s ON s.month_num = o.observation_month_num)"
VISITS = """visits AS (
  SELECT 'B' || CAST(user_id % 20 AS VARCHAR) AS pba3_block, 'E' || CAST(event_id % 500 AS VARCHAR) AS checklist_id,
    CAST(user_id AS VARCHAR) || ',' || CAST(user_id % 3 AS VARCHAR) AS observer_id, event_type AS common_name,
    ts AS observation_datetime, CAST(ts AS DATE) AS observation_date,
    CAST(user_id % 50 - 800 AS DOUBLE) / 10 AS longitude, CAST(user_id % 20 + 400 AS DOUBLE) / 10 AS latitude,
    value AS duration_minutes
  FROM events
)"""

CAL = """cal_counts AS (
  SELECT CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority || '*' ELSE o_orderpriority END AS raw_name,
    strftime(o_orderdate, '%b') || ' ' || CAST(CAST(least(ceil(day(o_orderdate) / 7.75), 4) AS INTEGER) AS VARCHAR) AS week,
    count(*) AS cnt
  FROM orders GROUP BY 1, 2
),
cal_names AS (
  SELECT raw_name, regexp_replace(raw_name, '\\*', '') AS common_name, contains(raw_name, '*') AS priority_species,
    CAST(substring(min(o_orderpriority), 1, 1) AS INTEGER) AS taxonomic_order,
    strftime(CAST(min(o_orderdate) AS DATE) + INTERVAL 30 DAY, '%-d-%b') AS safe_date_probable_start,
    strftime(min(o_orderdate), '%-d-%b') AS safe_date_possible_start,
    strftime(max(o_orderdate), '%-d-%b') AS safe_date_possible_end,
    strftime(CAST(max(o_orderdate) AS DATE) - INTERVAL 30 DAY, '%-d-%b') AS safe_date_probable_end
  FROM (SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority || '*' ELSE o_orderpriority END AS raw_name
        FROM orders)
  GROUP BY raw_name
),
weeks AS (SELECT * FROM (VALUES """ + ", ".join(f"('{w}', {i})" for i, w in enumerate(WEEKS, 1)) + """) t(week, week_index)),
cal_long AS (
  SELECT n.taxonomic_order, n.common_name, n.priority_species, w.week, w.week_index,
    coalesce(CASE WHEN c.cnt % 5 > 0 THEN substring('BEMN', CAST(c.cnt % 5 AS INTEGER), 1) END, '') AS breeding_calendar_code
  FROM cal_names n CROSS JOIN weeks w LEFT JOIN cal_counts c ON c.raw_name = n.raw_name AND c.week = w.week
)"""


def cal_wide(weeks: list[str], ids: str) -> str:
    cols = ", ".join(f"max(breeding_calendar_code) FILTER (WHERE week = '{w}') AS \"{w}\"" for w in weeks)
    return f"SELECT {ids}, {cols} FROM cal_long GROUP BY {ids}"


PARSE = (
    "CASE WHEN trim(observation_count) = 'X' THEN 1.0 ELSE TRY_CAST(replace(nullif(regexp_extract(observation_count, "
    "'-?[0-9][0-9,]*(\\.[0-9]+)?', 0), ''), ',', '') AS DOUBLE) END"
)

ES = """b AS (
  SELECT pba3_block, common_name, checklist_id, observation_month_num AS month_num, """ + PARSE + """ AS cnt
  FROM obsr WHERE observation_month_num IN (4, 5, 6, 7, 8)
),
blk_cl AS (SELECT DISTINCT pba3_block, checklist_id FROM b),
blk_sp AS (SELECT DISTINCT pba3_block, common_name FROM b),
months AS (SELECT unnest([4, 5, 6, 7, 8]) AS month_num),
grid AS (
  SELECT c.pba3_block, s.common_name, c.checklist_id, m.month_num
  FROM blk_cl c JOIN blk_sp s ON s.pba3_block = c.pba3_block CROSS JOIN months m
),
filled AS (
  SELECT pba3_block, common_name, checklist_id, month_num, cnt FROM b
  UNION ALL
  SELECT g.pba3_block, g.common_name, g.checklist_id, g.month_num, NULL FROM grid g
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.pba3_block = g.pba3_block AND b.common_name = g.common_name
                    AND b.checklist_id = g.checklist_id AND b.month_num = g.month_num)
),
es AS (
  SELECT pba3_block, common_name, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month_num]
      AS observation_month, month_num,
    count(cnt) AS observations, count(DISTINCT checklist_id) AS checklist_count,
    avg(CASE WHEN cnt IS NOT NULL THEN 1.0 ELSE 0.0 END) AS observed_pct
  FROM filled GROUP BY pba3_block, common_name, month_num
)"""

SQ = summary_sql()


def from_summary(select: str) -> str:
    return SQ + "\n" + select


DUR = ["duration_hours_diurnal", "duration_hours_nocturnal", "duration_hours_unknown"]
SUMMARY_DOUBLES = [
    "duration_hours_total",
    *DUR,
    "effort_distance_km",
    "pct_missing_pba2_confirmations",
    "pct_coded_atlas_comparison",
    "pba3_pba2_coded_count_compare_pct",
]
ROUND_SUMMARY = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in SUMMARY_DOUBLES) + ") FROM summary"

# ---------------------------------------------------------------- flagship
ORACLE["block_season_summary"] = from_summary(ROUND_SUMMARY)

# ---------------------------------------------------------------- 2.1 sources
ORACLE["scan_parquet"] = (
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_suppkey % 20 = 3 AND l_quantity >= 40"
)
ORACLE["csv_roundtrip"] = W + "\nSELECT atlas_block, checklist_id, common_name, observation_count FROM raw"
ORACLE["release_tag"] = """WITH n AS (
  SELECT DISTINCT strftime(o_orderdate, '%b-%Y') AS tag, o_orderkey % 4 <> 0 AS text FROM orders
)
SELECT 'data/ebd_rel' || tag || CASE WHEN text THEN '.txt' ELSE '.csv' END AS path, CASE WHEN text THEN tag END AS release,
  CASE WHEN text THEN 'Data includes checklists from Jan-2024 to ' || tag END AS release_sentence FROM n"""
ORACLE["extract_pipeline"] = "WITH " + RAW + """,
k AS (
  SELECT coalesce(CASE WHEN CAST(substr(checklist_id, 2) AS BIGINT) % 3 <> 0 THEN 'G' || substr(checklist_id, 2) END,
      checklist_id || '_' || atlas_block) AS cid, checklist_id || '_' || atlas_block AS event,
    trim(regexp_replace(breeding_category, '\\s+', ' ', 'g')) AS cat, CASE WHEN atlas_block <> 'B7' THEN duration_minutes END AS dur, *
  FROM raw WHERE observation_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND contains(project_names, 'Atlas')
),
f AS (
  SELECT cid, common_name, event, row_number() OVER (PARTITION BY cid, common_name ORDER BY event) AS rn,
    first_value(atlas_block) OVER (PARTITION BY cid, common_name ORDER BY event, atlas_block) AS block,
    first_value(observation_date) OVER (PARTITION BY cid, common_name ORDER BY event, observation_date) AS day,
    first_value(time_observations_started) OVER (PARTITION BY cid, common_name ORDER BY event, time_observations_started NULLS FIRST) AS start,
    first_value(dur) OVER (PARTITION BY cid, common_name ORDER BY event, dur NULLS FIRST) AS dur
  FROM k
),
g AS (SELECT cid, common_name, string_agg(DISTINCT observer_id, ',' ORDER BY observer_id) AS observer_id, max(cat) AS cat, min(event) AS event FROM k GROUP BY 1, 2),
j AS (
  SELECT g.*, f.block, f.day, f.dur, coalesce(g.cat, 'C1') AS category,
    try_strptime(strftime(f.day, '%Y-%m-%d') || ' ' || f.start, '%Y-%m-%d %H:%M:%S') AS ts
  FROM g JOIN f USING (cid, common_name) WHERE f.rn = 1
),
""" + LOOKUP + f"""
SELECT cid AS checklist_id, common_name, observer_id, event AS first_event_id, block AS pba3_block, category AS breeding_category,
  breeding_rank, day AS observation_date, strftime(day, '%b') AS observation_month,
  CASE WHEN timezone('{TZ}', timezone('{TZ}', ts)) = ts THEN ts END AS observation_datetime, round(dur, 6) AS duration_minutes
FROM j LEFT JOIN lk ON lk.breeding_category = j.category"""
ORACLE["bad_cells"] = "WITH " + RAW + """
SELECT c.name AS "column", CASE WHEN c.name = 'duration_minutes' THEN (SELECT count(*) FROM raw WHERE atlas_block = 'B7') ELSE 0 END AS bad
FROM (SELECT unnest(['atlas_block', 'sampling_event_identifier', 'group_identifier', 'observer_id', 'common_name', 'breeding_category',
  'breeding_code', 'observation_date', 'time_observations_started', 'duration_minutes', 'project_names']) AS name) c"""
ORACLE["csv_positional"] = """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"""
ORACLE["partition_refresh"] = from_summary("""SELECT season, count(*) AS blocks,
  CAST(sum(CASE WHEN season = 'Winter' THEN -checklist_count ELSE checklist_count END) AS BIGINT) AS checklists, season <> 'Winter' AS same_files
FROM cc GROUP BY season""")
ORACLE["extract_filter"] = W + """
SELECT atlas_block, checklist_id, common_name, observation_date, duration_minutes, project_names FROM raw
WHERE observation_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND contains(project_names, 'Atlas')"""

ORACLE["blocks_source"] = W + """,
sq AS (SELECT DISTINCT longitude AS x, latitude AS y FROM obsr),
c AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) t(place, dx, dy))
SELECT 'P' || CAST(x AS VARCHAR) || '_' || CAST(y AS VARCHAR) AS pba2_block, CAST(place AS BIGINT) AS place,
  round(x + dx * 0.1, 6) AS x, round(y + dy * 0.1, 6) AS y FROM sq, c"""
BY_DATE = """SELECT {g}pba3_block, CAST(observation_datetime AS DATE) AS observation_date,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'diurnal') / 60 AS duration_hours_diurnal,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'nocturnal') / 60 AS duration_hours_nocturnal,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'unknown') / 60 AS duration_hours_unknown
  FROM cls GROUP BY ALL"""
HOURS = ", ".join(f"round({c}, 6) AS {c}" for c in DUR)
ORACLE["parquet_roundtrip"] = from_summary(f"""SELECT d.season, d.pba3_block, cc.checklist_count, observation_date, {HOURS},
  row_number() OVER (PARTITION BY d.season, d.pba3_block ORDER BY observation_date NULLS FIRST) - 1 AS place
FROM ({BY_DATE.format(g='season, ')}) d JOIN cc ON cc.season = d.season AND cc.pba3_block = d.pba3_block""")

# ---------------------------------------------------------------- 2.2 projection, filter, reshape
ORACLE["select_reorder"] = W + """
SELECT checklist_id, pba3_block, breeding_code, breeding_category, breeding_category_desc, breeding_rank,
  observation_month, round(longitude, 6) AS longitude FROM obsr"""
ORACLE["rename_fn"] = W + """
SELECT checklist_id, observation_date AS "date", observation_month AS "month", observation_count AS "count" FROM obsr"""
ORACLE["rename_positional"] = W + "\nSELECT DISTINCT pba3_block AS block, checklist_id, common_name AS species FROM obsr"
ORACLE["across_round"] = from_summary(
    "SELECT season, pba3_block, round_even(duration_hours_total, 2) AS duration_hours_total, "
    "round_even(effort_distance_km, 2) AS effort_distance_km FROM summary"
)
ORACLE["filter_predicates"] = W + """
SELECT checklist_id, common_name, pba3_block, breeding_rank, protocol_name FROM obsr
WHERE (breeding_rank >= 3 AND pba3_block IN ('B1', 'B2'))
   OR (observation_datetime IS NULL AND NOT (protocol_name = 'Traveling'))"""
ORACLE["calendar_exclude_blank"] = (
    "WITH " + CAL + "\nSELECT * FROM (" + cal_wide(WEEKS, "common_name, priority_species") + ") WHERE \"Jan 1\" <> ''"
)
ORACLE["drop_na"] = W + "\nSELECT DISTINCT checklist_id, observation_datetime FROM obsr WHERE observation_datetime IS NOT NULL"
ORACLE["fill_na"] = W + """
SELECT checklist_id, common_name, coalesce(breeding_category, 'C1') AS breeding_category,
  coalesce(observation_count, '0') AS observation_count FROM raw"""
ORACLE["unpivot_weeks"] = "WITH " + CAL + "\nSELECT common_name, priority_species, week, breeding_calendar_code FROM cal_long"
ORACLE["pivot_codes"] = from_summary("SELECT * FROM coded")
ORACLE["explode_delimited"] = W + """
SELECT DISTINCT pba3_block, unnest(string_split(observer_id, ',')) AS observer_id
FROM (SELECT DISTINCT pba3_block, observer_id FROM obsr)"""
ORACLE["unnest_effort"] = WF + ",\ncls AS " + classified_sql("obsr") + """
SELECT pba3_block, CAST(observation_datetime AS DATE) AS observation_date,
  round(sum(duration_minutes) FILTER (WHERE checklist_type = 'diurnal') / 60, 6) AS duration_hours_diurnal,
  round(sum(duration_minutes) FILTER (WHERE checklist_type = 'nocturnal') / 60, 6) AS duration_hours_nocturnal,
  round(sum(duration_minutes) FILTER (WHERE checklist_type = 'unknown') / 60, 6) AS duration_hours_unknown
FROM cls GROUP BY 1, 2"""
ORACLE["nest_effort"] = WF + ",\ncls AS " + classified_sql("obsr") + f"""
SELECT pba3_block, count(*) OVER (PARTITION BY pba3_block) AS days,
  row_number() OVER (PARTITION BY pba3_block ORDER BY observation_date NULLS FIRST) - 1 AS place, observation_date, {HOURS}
FROM ({BY_DATE.format(g='')})"""
ORACLE["complete_keys"] = W + """
SELECT s.common_name, m.observation_month_num, c.breeding_category, coalesce(x.n, 0) AS n
FROM (SELECT DISTINCT common_name FROM obsr) s, (SELECT DISTINCT observation_month_num FROM obsr) m, (SELECT DISTINCT breeding_category FROM obsr) c
LEFT JOIN (SELECT common_name, observation_month_num, breeding_category, count(*) AS n FROM obsr GROUP BY ALL) x
  ON x.common_name = s.common_name AND x.observation_month_num = m.observation_month_num AND x.breeding_category = c.breeding_category"""
ORACLE["complete_grid"] = W + ",\n" + NAMES + """
SELECT n.pba3_block, CAST(coalesce(c.k, 0) AS BIGINT) AS confirmed_species
FROM names n LEFT JOIN (
  SELECT pba3_block, """ + nd("common_name") + """ AS k FROM obsr WHERE breeding_rank = 4 GROUP BY 1
) c ON c.pba3_block = n.pba3_block"""

# ---------------------------------------------------------------- 2.3 joins
ORACLE["left_join_lookup"] = W + ",\n" + NAMES + """
SELECT b.pba3_block, coalesce(n.block_name, 'Unknown block name') AS block_name,
  coalesce(n.block_region, 'Unknown region') AS block_region, coalesce(n.block_county, 'Unknown county') AS block_county
FROM (SELECT DISTINCT pba3_block FROM obsr) b LEFT JOIN names n ON n.pba3_block IS NOT DISTINCT FROM b.pba3_block"""
_rise, _set = sun_sql("longitude", "latitude", "observation_datetime")
ORACLE["left_join_multi"] = W + f"""
SELECT pba3_block, checklist_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, observation_datetime,
  {from_utc_sql(_rise)} AS sunrise, {from_utc_sql(_set)} AS sunset
FROM (SELECT pba3_block, checklist_id, longitude, latitude, min(observation_datetime) AS observation_datetime
      FROM obsr GROUP BY ALL)"""
ORACLE["inner_join_season"] = W + """
SELECT DISTINCT o.pba3_block, s.season, s.month FROM obsr o JOIN seasons s ON s.month = o.observation_month"""
ORACLE["semi_join_season"] = W + """
SELECT pba3_block, count(*) AS n FROM obsr
WHERE observation_month IN (SELECT month FROM seasons WHERE season = 'Breeding') GROUP BY 1"""
ORACLE["anti_join_blocks"] = W + ",\n" + NAMES + ",\n" + OLD_ATLAS + """
SELECT pba3_block, 'new' AS missing_from FROM (SELECT DISTINCT pba3_block FROM pba2)
  WHERE pba3_block NOT IN (SELECT DISTINCT pba3_block FROM obsr)
UNION ALL
SELECT pba3_block, 'old' AS missing_from FROM (SELECT DISTINCT pba3_block FROM obsr)
  WHERE pba3_block NOT IN (SELECT DISTINCT pba3_block FROM pba2)"""
ORACLE["join_null_safe"] = W + """,
d AS (SELECT DISTINCT checklist_id, observation_datetime FROM obsr),
c AS (SELECT observation_datetime, count(*) AS n_checklists FROM d GROUP BY 1)
SELECT d.checklist_id, d.observation_datetime, c.n_checklists
FROM d LEFT JOIN c ON c.observation_datetime IS NOT DISTINCT FROM d.observation_datetime"""
ORACLE["spatial_covers"] = W + """,
sq AS (SELECT DISTINCT longitude AS x0, latitude AS y0 FROM obsr),
dia AS (SELECT longitude AS x0, min(latitude) AS y0 FROM obsr WHERE longitude IS NOT NULL GROUP BY 1),
pts AS (SELECT DISTINCT checklist_id, longitude AS px, latitude AS py FROM obsr)
SELECT 'P' || CAST(sq.x0 AS VARCHAR) || '_' || CAST(sq.y0 AS VARCHAR) AS pba2_block, pts.checklist_id,
  round(pts.px, 6) AS px, round(pts.py, 6) AS py
FROM sq JOIN pts ON CAST(pts.px AS DECIMAL(16, 12)) - CAST(sq.x0 AS DECIMAL(16, 12)) BETWEEN 0 AND 0.1
  AND CAST(pts.py AS DECIMAL(16, 12)) - CAST(sq.y0 AS DECIMAL(16, 12)) BETWEEN 0 AND 0.1
UNION ALL
SELECT 'D' || CAST(dia.x0 AS VARCHAR), pts.checklist_id, round(pts.px, 6), round(pts.py, 6)
FROM dia JOIN pts ON abs(CAST(pts.px AS DECIMAL(16, 12)) - CAST(dia.x0 AS DECIMAL(16, 12)))
  + abs(CAST(pts.py AS DECIMAL(16, 12)) - CAST(dia.y0 AS DECIMAL(16, 12))) <= 0.2
UNION ALL
SELECT 'EMPTY', NULL, NULL, NULL"""
#: Exact decimal hulls: an edge has every candidate on its left or between its ends.
HULL = W + """,
hp AS (SELECT DISTINCT pba3_block AS g, CAST(longitude AS DECIMAL(16, 12)) AS x, CAST(latitude AS DECIMAL(16, 12)) AS y FROM obsr
       WHERE pba3_block IS NOT NULL AND longitude IS NOT NULL AND latitude IS NOT NULL),
np AS (SELECT g, count(*) AS n_points FROM hp GROUP BY g),
cand AS (SELECT g, x, min(y) AS y FROM hp GROUP BY g, x UNION SELECT g, x, max(y) FROM hp GROUP BY g, x),
edge AS (
  SELECT p.g, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2
  FROM cand p JOIN cand q ON p.g = q.g AND (p.x <> q.x OR p.y <> q.y) JOIN cand r ON r.g = p.g
  GROUP BY p.g, p.x, p.y, q.x, q.y
  HAVING bool_and((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0
    OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0
        AND r.x BETWEEN least(p.x, q.x) AND greatest(p.x, q.x) AND r.y BETWEEN least(p.y, q.y) AND greatest(p.y, q.y)))
),
vertex AS (SELECT g, x1 AS x, y1 AS y FROM edge UNION SELECT c.g, c.x, c.y FROM cand c JOIN np USING (g) WHERE n_points = 1),
shape AS (
  SELECT v.g, count(*) AS n_vertices, min(CAST(v.y AS DOUBLE)) AS lo, max(CAST(v.y AS DOUBLE)) AS hi,
    (min(CAST(v.y AS DOUBLE)) + max(CAST(v.y AS DOUBLE))) / 2 AS centre FROM vertex v GROUP BY v.g
),
scan AS (
  SELECT s.g, any_value(s.n_vertices) AS n_vertices,
    (coalesce(max(CAST(v.y AS DOUBLE)) FILTER (WHERE CAST(v.y AS DOUBLE) <= s.centre AND CAST(v.y AS DOUBLE) > s.lo), any_value(s.lo))
     + coalesce(min(CAST(v.y AS DOUBLE)) FILTER (WHERE CAST(v.y AS DOUBLE) > s.centre AND CAST(v.y AS DOUBLE) < s.hi), any_value(s.hi))) / 2 AS at,
    CAST(min(v.x) AS DOUBLE) AS x_first, CAST(arg_min(v.y, (v.x, v.y)) AS DOUBLE) AS y_first
  FROM shape s JOIN vertex v ON v.g = s.g GROUP BY s.g
),
cut AS (
  SELECT c.g, CAST(e.x1 AS DOUBLE) + (c.at - CAST(e.y1 AS DOUBLE)) * (CAST(e.x2 AS DOUBLE) - CAST(e.x1 AS DOUBLE))
    / (CAST(e.y2 AS DOUBLE) - CAST(e.y1 AS DOUBLE)) AS x
  FROM scan c JOIN edge e ON e.g = c.g AND (CAST(e.y1 AS DOUBLE) > c.at) <> (CAST(e.y2 AS DOUBLE) > c.at)
),
ip AS (
  SELECT c.g AS pba3_block, CASE WHEN any_value(c.n_vertices) <= 2 THEN any_value(c.x_first) ELSE (min(u.x) + max(u.x)) / 2 END AS px,
    CASE WHEN any_value(c.n_vertices) <= 2 THEN any_value(c.y_first) ELSE any_value(c.at) END AS py
  FROM scan c LEFT JOIN cut u ON u.g = c.g GROUP BY c.g
),
sq AS (SELECT DISTINCT longitude AS x0, latitude AS y0 FROM obsr),
cw AS (
  SELECT 'P' || CAST(sq.x0 AS VARCHAR) || '_' || CAST(sq.y0 AS VARCHAR) AS pba2_block, ip.pba3_block
  FROM sq LEFT JOIN ip ON CAST(ip.px AS DECIMAL(16, 12)) - CAST(sq.x0 AS DECIMAL(16, 12)) BETWEEN 0 AND 0.1
    AND CAST(ip.py AS DECIMAL(16, 12)) - CAST(sq.y0 AS DECIMAL(16, 12)) BETWEEN 0 AND 0.1
)"""
ORACLE["convex_hull"] = HULL + """,
area AS (SELECT g, sum((CAST(x1 AS DOUBLE) * CAST(y2 AS DOUBLE) - CAST(x2 AS DOUBLE) * CAST(y1 AS DOUBLE)) / 2) AS area FROM edge GROUP BY g)
SELECT v.g AS pba3_block, np.n_points, s.n_vertices,
  round(CASE WHEN s.n_vertices > 2 THEN a.area ELSE 0 END, 6) AS area, round(CAST(v.x AS DOUBLE), 6) AS x, round(CAST(v.y AS DOUBLE), 6) AS y
FROM vertex v JOIN np USING (g) JOIN shape s USING (g) LEFT JOIN area a USING (g)"""
ORACLE["interior_point"] = HULL + "\nSELECT pba3_block, round(px, 6) AS px, round(py, 6) AS py FROM ip"
ORACLE["block_crosswalk"] = HULL + "\nSELECT * FROM cw"
ORACLE["crosswalk_overrides"] = HULL + """
SELECT CASE WHEN pba3_block = 'B5' THEN 'P-80.0_40.5' ELSE pba2_block END AS pba2_block, pba3_block FROM cw
WHERE NOT (pba2_block = 'P-80.0_40.5' AND pba3_block IS NULL)"""
ORACLE["crosswalk_one_to_one"] = HULL + """,
d AS (SELECT DISTINCT pba2_block, pba3_block FROM cw),
s AS (SELECT 'pba2_block' AS side, pba2_block AS id, pba3_block AS other FROM d UNION ALL SELECT 'pba3_block', pba3_block, pba2_block FROM d)
SELECT side, id, count(other) AS partners, count(*) AS partners_with_null FROM s WHERE id IS NOT NULL GROUP BY side, id HAVING count(*) > 1"""
ORACLE["season_glossary"] = "WITH " + CAL + """
SELECT l.breeding_calendar_code, count(*) AS n, any_value(d.Description) AS Description FROM cal_long l
LEFT JOIN (VALUES ('B', 'Breeding season only'), ('E', 'Either migration or breeding'), ('M', 'Migration'), ('N', 'Non-breeding season'))
  d(Season, Description) ON d.Season = l.breeding_calendar_code GROUP BY 1"""
CMP = W + ",\n" + NAMES + ",\n" + OLD_ATLAS
ORACLE["full_outer_compare"] = CMP + "\nSELECT * FROM cmp"

# ---------------------------------------------------------------- 2.4 aggregations
ORACLE["count_by_keys"] = W + "\nSELECT breeding_category, breeding_code, count(*) AS n FROM obsr GROUP BY 1, 2"
ORACLE["count_of_counts"] = W + """
SELECT n, count(*) AS nn FROM (
  SELECT checklist_id, count(*) AS n FROM (SELECT DISTINCT checklist_id, observation_datetime FROM obsr) GROUP BY 1
) GROUP BY 1"""
ORACLE["grouped_summary"] = W + """
SELECT pba3_block, round(sum(duration_minutes), 6) AS sum_duration, min(observation_date) AS first_date,
  max(observation_date) AS last_date, round(avg(effort_distance_km), 6) AS mean_distance FROM obsr GROUP BY 1"""
ORACLE["date_range"] = W + """
SELECT min(observation_date) AS min_observation_date, max(observation_date) AS max_observation_date FROM obsr"""
ORACLE["effort_two_level"] = from_summary(
    "SELECT season, pba3_block, round(duration_hours_total, 6) AS duration_hours_total, "
    "round(effort_distance_km, 6) AS effort_distance_km FROM ef"
)
ORACLE["n_distinct_nulls"] = W + f"""
SELECT pba3_block, {nd('observation_datetime')} AS start_times, count(DISTINCT observation_datetime) AS start_times_non_null
FROM obsr GROUP BY 1"""
ORACLE["count_if_ranks"] = W + """
SELECT pba3_block, count(*) FILTER (WHERE breeding_rank >= 2) AS coded_rows,
  count(*) FILTER (WHERE breeding_rank = 4) AS confirmed_rows FROM obsr GROUP BY 1"""
ORACLE["share_if"] = W + """
SELECT pba3_block, round(avg(CASE WHEN breeding_rank = 4 THEN 1.0 WHEN breeding_rank IS NULL THEN NULL ELSE 0.0 END), 6)
  AS confirmed_share FROM obsr GROUP BY 1"""
ORACLE["distinct_keys"] = W + "\nSELECT DISTINCT breeding_category, breeding_code, breeding_rank FROM obsr"
ORACLE["modal_value"] = "WITH " + VISITS + """
SELECT checklist_id, modal_hour FROM (
  SELECT checklist_id, CAST(hour(observation_datetime) AS INTEGER) AS modal_hour,
    row_number() OVER (PARTITION BY checklist_id ORDER BY count(*) DESC, hour(observation_datetime)) AS rn
  FROM visits GROUP BY checklist_id, hour(observation_datetime)
) WHERE rn = 1"""
ORACLE["rows_at_group_max"] = CMP + "\nSELECT * FROM pba3"
ORACLE["region_blocks"] = from_summary(
    "SELECT DISTINCT block_region, pba3_block, block_name FROM summary WHERE block_region <> 'Unknown region'"
)
ORACLE["region_hierarchy"] = from_summary("""SELECT block_region, row_number() OVER (PARTITION BY block_region ORDER BY pba3_block, block_name) - 1 AS place,
  pba3_block, block_name FROM (SELECT DISTINCT block_region, pba3_block, block_name FROM summary WHERE block_region <> 'Unknown region')""")
ORACLE["rowwise_sum"] = WF + ",\ncls AS " + classified_sql("obsr") + """
SELECT pba3_block, observation_date, round(coalesce(d, 0) + coalesce(n, 0) + coalesce(u, 0), 6) AS duration_hours_total
FROM (
  SELECT pba3_block, CAST(observation_datetime AS DATE) AS observation_date,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'diurnal') / 60 AS d,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'nocturnal') / 60 AS n,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'unknown') / 60 AS u
  FROM cls GROUP BY 1, 2)"""

# ---------------------------------------------------------------- 2.5 windows
ORACLE["week_index"] = "WITH " + CAL + "\nSELECT common_name, week, CAST(week_index AS INTEGER) AS week_index FROM cal_long"
ORACLE["add_count"] = W + """,
d AS (SELECT DISTINCT pba3_block, checklist_id, duration_minutes, effort_distance_km FROM obsr)
SELECT pba3_block, checklist_id, round(duration_minutes, 6) AS duration_minutes,
  round(effort_distance_km, 6) AS effort_distance_km, n
FROM (SELECT *, count(*) OVER (PARTITION BY checklist_id) AS n FROM d) WHERE n > 1"""

# ---------------------------------------------------------------- 2.6 sort, limit
ORACLE["sort_nulls_last"] = CMP + "\nSELECT * FROM cmp ORDER BY pba3_block, pba2_breeding_rank_max DESC NULLS LAST, common_name"
ORACLE["top_k"] = from_summary(
    "SELECT season, pba3_block, checklist_count FROM cc WHERE season = 'All seasons' "
    "ORDER BY checklist_count DESC, pba3_block LIMIT 10"
)

DRAW = "CAST('0x' || substr(md5(concat_ws('|', '{seed}', {keys})), 1, 13) AS BIGINT)"
_prop = DRAW.format(seed=7, keys="checklist_id, common_name, observer_id, pba3_block, CAST(observation_date AS VARCHAR)")
ORACLE["sample_prop"] = W + f""",
d AS (SELECT DISTINCT checklist_id, common_name, observer_id, pba3_block, observation_date FROM obsr)
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (ORDER BY {_prop} DESC) AS r FROM d)
WHERE r <= floor(CAST(0.1 AS DOUBLE) * (SELECT count(*) FROM d))"""
_place = DRAW.format(seed=1, keys="checklist_id, CAST(longitude AS VARCHAR), CAST(latitude AS VARCHAR)")
ORACLE["sample_per_group"] = W + f""",
d AS (SELECT DISTINCT pba3_block, checklist_id, longitude, latitude FROM obsr)
SELECT pba3_block, checklist_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude
FROM (SELECT *, row_number() OVER (PARTITION BY pba3_block ORDER BY {_place}) AS r FROM d) WHERE r <= 100"""
EB = W + ",\n" + ES + """,
m AS (SELECT avg(CAST(observations AS DOUBLE) / checklist_count) AS mu,
        var_samp(CAST(observations AS DOUBLE) / checklist_count) AS v FROM es WHERE checklist_count > 0),
p AS (SELECT mu * (mu * (1 - mu) / v - 1) AS a, (1 - mu) * (mu * (1 - mu) / v - 1) AS b FROM m),
eb AS (
  SELECT es.*, observations + a AS alpha1, checklist_count - observations + b AS beta1,
    CAST(observations AS DOUBLE) / checklist_count AS raw, (observations + a) / (checklist_count + a + b) AS fitted,
    a / (a + b) AS prior_mean
  FROM es, p
)"""
EB_DOUBLES = ["observed_pct", "alpha1", "beta1", "raw", "fitted", "prior_mean"]
_w = DRAW.format(seed=3, keys="pba3_block, common_name, CAST(month_num AS VARCHAR)")
ORACLE["sample_weighted"] = EB + f"""
SELECT pba3_block, common_name, observation_month, month_num, observations, checklist_count, {rnd(EB_DOUBLES)}
FROM (SELECT *, row_number() OVER (ORDER BY ln(({_w} + 0.5) / 4503599627370496.0::DOUBLE) / fitted DESC) AS r FROM eb)
WHERE r <= floor(CAST(0.1 AS DOUBLE) * (SELECT count(*) FROM eb))"""
ORACLE["eb_shrink"] = EB + f"""
SELECT pba3_block, common_name, observation_month, month_num, observations, checklist_count, {rnd(EB_DOUBLES)},
  round(observed_pct * checklist_count, 6) AS observed_pct_weighted FROM eb"""
ORACLE["eb_species"] = W + ",\n" + ES + """,
t AS (SELECT common_name, CAST(sum(checklist_count) AS BIGINT) AS checklist_count, CAST(sum(observations) AS BIGINT) AS observations
      FROM es GROUP BY 1),
m AS (SELECT avg(CAST(observations AS DOUBLE) / checklist_count) AS mu,
        var_samp(CAST(observations AS DOUBLE) / checklist_count) AS v FROM t WHERE checklist_count > 0),
p AS (SELECT mu * (mu * (1 - mu) / v - 1) AS a, (1 - mu) * (mu * (1 - mu) / v - 1) AS b FROM m)
SELECT common_name, checklist_count, observations, round(observations + a, 6) AS alpha1,
  round(checklist_count - observations + b, 6) AS beta1, round(CAST(observations AS DOUBLE) / checklist_count, 6) AS raw,
  round((observations + a) / (checklist_count + a + b), 6) AS fitted, round(a / (a + b), 6) AS prior_mean FROM t, p"""

# ---------------------------------------------------------------- 2.7 set operations
ORACLE["union_rows"] = CMP + "\nSELECT pba3_block, common_name FROM pba2 UNION ALL SELECT pba3_block, common_name FROM pba3"
ORACLE["union_distinct"] = CMP + "\nSELECT pba3_block, common_name FROM pba2 UNION SELECT pba3_block, common_name FROM pba3"

# ---------------------------------------------------------------- 2.8 scalar functions
ORACLE["str_squish"] = "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text_squished FROM documents"
ORACLE["str_detect_remove"] = """
SELECT conv_id, turn, regexp_matches(text, '[0-9]') AS has_digit,
  regexp_replace(text, '[0-9]+', '') AS text_first_number_removed, contains(text, 'the') AS has_the
FROM conversations"""
ORACLE["concat_nulls"] = W + """
SELECT DISTINCT checklist_id, CAST(observation_date AS VARCHAR) || ' ' || time_observations_started AS stamp FROM raw"""
ORACLE["recode_map"] = CMP + """
SELECT pba3_block, species, CASE WHEN r = 1 THEN 'Observed' WHEN r = 2 THEN 'Possible' WHEN r = 3 THEN 'Probable'
  WHEN r = 4 THEN 'Confirmed' END AS category FROM old_long"""
ORACLE["parse_number"] = W + f"""
SELECT observation_count, round({PARSE}, 6) AS count_value FROM (SELECT DISTINCT observation_count FROM raw)"""
ORACLE["month_label"] = W + "\nSELECT DISTINCT observation_month_num, observation_month FROM obsr"
ORACLE["year_month"] = W + """
SELECT CAST(year(observation_date) AS INTEGER) AS obs_year, CAST(date_trunc('month', observation_date) AS DATE) AS obs_ym,
  count(*) AS n
FROM obsr GROUP BY 1, 2"""
ORACLE["datetime_build"] = W + "\nSELECT DISTINCT observation_date, time_observations_started, observation_datetime FROM obsr"


def _safe(c: str) -> str:
    s = f"('2025-' || trim({c}))"
    return (
        f"coalesce(CASE WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{1,2}}-[A-Za-z]{{3}}') "
        f"THEN CAST(try_strptime({s}, '%Y-%d-%b') AS DATE) END, "
        f"CASE WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN CAST(try_strptime({s}, '%Y-%d-%m') AS DATE) END)"
    )


ORACLE["safe_dates"] = "WITH " + CAL + f"""
SELECT common_name, {_safe('safe_date_probable_start')} AS date_probable_start,
  {_safe('safe_date_probable_end')} AS date_probable_end, {_safe('safe_date_possible_start')} AS date_possible_start,
  {_safe('safe_date_possible_end')} AS date_possible_end
FROM (SELECT DISTINCT taxonomic_order, common_name, safe_date_probable_start, safe_date_possible_start,
        safe_date_possible_end, safe_date_probable_end FROM cal_names)"""
ORACLE["date_label"] = "WITH " + CAL + f"""
SELECT common_name, strftime(d, '%b') || ' ' || lpad(CAST(day(d) AS VARCHAR), 2, ' ') AS label
FROM (SELECT common_name, {_safe('safe_date_probable_start')} AS d
      FROM (SELECT DISTINCT common_name, safe_date_probable_start FROM cal_names))"""
ORACLE["time_of_day"] = "WITH " + VISITS + """
SELECT checklist_id, observation_datetime, strftime(observation_datetime, '%H:%M:%S') AS time_of_day FROM visits"""
ORACLE["ratio_rules"] = CMP + """,
am AS (SELECT * FROM atlas_metrics2)
SELECT pba3_block, round(pba3_pba2_coded_count_compare_pct, 6) AS coded_ratio, CAST(NULL AS DOUBLE) AS zero_over_zero FROM am"""

# ---------------------------------------------------------------- 2.9 domain jobs
ORACLE["clean_observations"] = W + """
SELECT * REPLACE (round(longitude, 6) AS longitude, round(latitude, 6) AS latitude,
  round(duration_minutes, 6) AS duration_minutes, round(effort_distance_km, 6) AS effort_distance_km) FROM obsr"""
ORACLE["collapse_shared"] = """WITH rows AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'G' || CAST(l_orderkey AS VARCHAR) END AS group_identifier,
    'S' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber % 3 AS VARCHAR) AS sampling_event_identifier,
    'obsr' || CAST((l_suppkey + l_linenumber) % 50 AS VARCHAR) AS observer_id, p_name AS common_name,
    CASE WHEN l_returnflag = 'A' THEN 'C4' WHEN l_returnflag = 'N' THEN 'C2' ELSE 'C1' END AS breeding_category,
    l_quantity AS observation_count
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
k AS (SELECT coalesce(group_identifier, sampling_event_identifier) AS checklist_id, * FROM rows),
firsts AS (
  SELECT checklist_id, common_name, observation_count FROM (
    SELECT *, row_number() OVER (PARTITION BY checklist_id, common_name ORDER BY sampling_event_identifier, observation_count) AS rn FROM k
  ) WHERE rn = 1
)
SELECT a.checklist_id, a.common_name, a.observer_id, a.breeding_category, a.first_event_id,
  round(f.observation_count, 6) AS observation_count
FROM (
  SELECT checklist_id, common_name, string_agg(DISTINCT observer_id, ',' ORDER BY observer_id) AS observer_id,
    max(breeding_category) AS breeding_category, min(sampling_event_identifier) AS first_event_id
  FROM k GROUP BY 1, 2
) a JOIN firsts f USING (checklist_id, common_name)"""
ORACLE["calendar_view"] = (
    "WITH " + CAL + "\nSELECT * FROM (" + cal_wide(WEEKS[WEEKS.index("Jun 1"):], "common_name") + ") WHERE \"Jun 1\" <> ''"
)
ORACLE["calendar_build"] = (
    "WITH " + CAL + "\nSELECT CAST(taxonomic_order AS VARCHAR) AS taxonomic_order, common_name, priority_species, "
    + ", ".join(f'coalesce("{w}", \'\') AS "{w}"' for w in WEEKS)
    + " FROM ("
    + cal_wide(WEEKS, "taxonomic_order, common_name, priority_species")
    + ")"
)
_vr, _vs = sun_sql("longitude", "latitude", "observation_datetime")
ORACLE["sun_times"] = "WITH " + VISITS + f"""
SELECT round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, observation_datetime,
  {from_utc_sql(_vr)} AS sunrise, {from_utc_sql(_vs)} AS sunset
FROM (SELECT DISTINCT longitude, latitude, observation_datetime FROM visits)"""
ORACLE["season_fanout"] = W + ",\n" + FAN + "\nSELECT season, observation_month, count(*) AS n FROM fan GROUP BY 1, 2"
ORACLE["start_time_repair"] = WF + "\nSELECT checklist_id, fixed AS observation_datetime_fixed FROM fixed"
ORACLE["day_night_effort"] = "WITH " + VISITS + ",\n" + fixed_sql("visits") + ",\ncls AS " + classified_sql("visits") + """
SELECT pba3_block,
  round(coalesce(sum(duration_minutes) FILTER (WHERE checklist_type = 'diurnal') / 60, 0), 6) AS duration_hours_diurnal,
  round(coalesce(sum(duration_minutes) FILTER (WHERE checklist_type = 'nocturnal') / 60, 0), 6) AS duration_hours_nocturnal,
  round(coalesce(sum(duration_minutes) FILTER (WHERE checklist_type = 'unknown') / 60, 0), 6) AS duration_hours_unknown
FROM cls GROUP BY 1"""
ORACLE["checklist_count"] = from_summary("SELECT * FROM cc")
ORACLE["species_observed"] = from_summary("SELECT * FROM so")
ORACLE["birders"] = from_summary("SELECT * FROM bi")
ORACLE["season_coverage"] = from_summary("SELECT * FROM cov")
ORACLE["nocturnal_coded"] = from_summary("SELECT * FROM noc")
ORACLE["atlas_compare"] = CMP + "\nSELECT * FROM cmp"
ORACLE["atlas_missing"] = CMP + "\nSELECT * FROM cmp WHERE pba2_breeding_rank_max > pba3_breeding_rank_max"
ORACLE["atlas_block_metrics"] = CMP + """
SELECT * REPLACE (round(pct_missing_pba2_confirmations, 6) AS pct_missing_pba2_confirmations,
  round(pct_coded_atlas_comparison, 6) AS pct_coded_atlas_comparison,
  round(pba3_pba2_coded_count_compare_pct, 6) AS pba3_pba2_coded_count_compare_pct) FROM atlas_metrics2"""
ORACLE["expected_species"] = W + ",\n" + ES + "\nSELECT * REPLACE (round(observed_pct, 6) AS observed_pct) FROM es"
ORACLE["eb_moments"] = W + ",\n" + ES + """,
m AS (SELECT avg(CAST(observations AS DOUBLE) / checklist_count) AS mu,
        var_samp(CAST(observations AS DOUBLE) / checklist_count) AS v FROM es WHERE checklist_count > 0)
SELECT round(mu * (mu * (1 - mu) / v - 1), 6) AS alpha, round((1 - mu) * (mu * (1 - mu) / v - 1), 6) AS beta,
  round(mu, 6) AS mean FROM m"""
ORACLE["eb_rank_fitted"] = W + ",\n" + ES + """,
m AS (SELECT avg(CAST(observations AS DOUBLE) / checklist_count) AS mu,
        var_samp(CAST(observations AS DOUBLE) / checklist_count) AS v FROM es WHERE checklist_count > 0),
p AS (SELECT mu * (mu * (1 - mu) / v - 1) AS a, (1 - mu) * (mu * (1 - mu) / v - 1) AS b FROM m)
SELECT pba3_block, common_name, month_num, observations, checklist_count,
  round(CAST(observations AS DOUBLE) / checklist_count, 6) AS raw,
  round((observations + a) / (checklist_count + a + b), 6) AS fitted
FROM es, p
ORDER BY (observations + a) / (checklist_count + a + b) DESC, pba3_block, common_name, month_num
LIMIT 20"""
ORACLE["expected_species_state"] = W + ",\n" + ES + """
SELECT common_name, CAST(sum(checklist_count) AS BIGINT) AS checklist_count, CAST(sum(observations) AS BIGINT) AS observations
FROM es GROUP BY 1"""
FLAGS_SQL = """flags AS (
  SELECT pba3_block, block_name, block_county,
    species_coded >= 70 AS flag_coded_species,
    (CASE WHEN species_coded = 0 THEN NULL ELSE CAST(coalesce(Confirmed, 0) AS DOUBLE) / species_coded END) >= 0.25
      AS flag_confirmed_pct,
    (CASE WHEN species_coded = 0 THEN NULL ELSE CAST(coalesce(Possible, 0) AS DOUBLE) / species_coded END) < 0.25
      AS flag_possible_pct,
    pba3_pba2_coded_count_compare_pct >= 0.8 AS flag_coded_atlas_comparison,
    round_even(duration_hours_total, 2) >= 20 AS flag_20_effort_hours,
    breeding_season_months_covered >= 3 AS flag_breeeding_season_coverage,
    nocturnal_species_coded >= 2 OR round_even(duration_hours_nocturnal, 2) >= 2 AS flag_nocturnal_coverage
  FROM (SELECT *, coalesce(Possible, 0) + coalesce(Probable, 0) + coalesce(Confirmed, 0) AS species_coded
        FROM summary WHERE season = 'All seasons' AND pba3_block IS NOT NULL)
)"""
ORACLE["completion_flags"] = (
    SQ
    + ",\n"
    + FLAGS_SQL
    + """
SELECT pba3_block, block_name, block_county,
  flag_coded_species AND flag_confirmed_pct AND flag_possible_pct AND flag_coded_atlas_comparison AND
  flag_20_effort_hours AND flag_breeeding_season_coverage AND flag_nocturnal_coverage AS all_criteria_complete,
  flag_coded_species, flag_confirmed_pct, flag_possible_pct, flag_coded_atlas_comparison, flag_20_effort_hours,
  flag_breeeding_season_coverage, flag_nocturnal_coverage
FROM flags"""
)
ORACLE["progress_table"] = from_summary(
    "SELECT * EXCLUDE (season) REPLACE ("
    + ", ".join(
        f"round_even({c}, 2) AS {c}" if "duration" in c or "km" in c else f"round({c}, 6) AS {c}" for c in SUMMARY_DOUBLES
    )
    + ") FROM summary WHERE season = 'Breeding'"
)
ORACLE["missing_report"] = W + ",\n" + NAMES + ",\n" + OLD_ATLAS + """,
focal AS (SELECT DISTINCT p_name AS common_name, TRUE AS is_focal FROM part WHERE p_size <= 1)
SELECT m.pba3_block, m.block_name, m.common_name, coalesce(f.is_focal, FALSE) AS is_focal,
  m.pba3_breeding_category_max, m.pba2_breeding_category_max
FROM cmp m LEFT JOIN focal f ON f.common_name = m.common_name
WHERE m.pba2_breeding_rank_max > m.pba3_breeding_rank_max AND m.pba3_block = 'B21'"""
ORACLE["report_effort"] = from_summary("""
SELECT "Effort type", round_even("Value", 2) AS "Value" FROM (
  SELECT 'Total' AS "Effort type", duration_hours_total AS "Value" FROM summary WHERE pba3_block = 'B3' AND season = 'Breeding'
  UNION ALL SELECT 'Diurnal', duration_hours_diurnal FROM summary WHERE pba3_block = 'B3' AND season = 'Breeding'
  UNION ALL SELECT 'Nocturnal', duration_hours_nocturnal FROM summary WHERE pba3_block = 'B3' AND season = 'Breeding'
  UNION ALL SELECT 'Unknown', duration_hours_unknown FROM summary WHERE pba3_block = 'B3' AND season = 'Breeding')""")
ORACLE["report_codes"] = from_summary("""
SELECT 'Confirmed' AS "Code", Confirmed AS "Count" FROM summary WHERE pba3_block = 'B3' AND season = 'Breeding'
UNION ALL SELECT 'Probable', Probable FROM summary WHERE pba3_block = 'B3' AND season = 'Breeding'
UNION ALL SELECT 'Possible', Possible FROM summary WHERE pba3_block = 'B3' AND season = 'Breeding'
UNION ALL SELECT 'Observed', Observed FROM summary WHERE pba3_block = 'B3' AND season = 'Breeding'""")
DENSITY = """dens AS (
  SELECT longitude, latitude, count(*) AS checklist_count FROM (
    SELECT DISTINCT checklist_id, longitude, latitude FROM obsr
    WHERE pba3_block = 'B3' AND observation_month_num IN (SELECT month_num FROM seasons WHERE season = 'Breeding'))
  GROUP BY 1, 2
)"""
ORACLE["checklist_density"] = W + ",\n" + DENSITY + """
SELECT round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, checklist_count FROM dens"""
ORACLE["effort_over_time"] = WF + """,
one AS (SELECT o.* FROM obsr o WHERE pba3_block = 'B3'
        AND observation_month_num IN (SELECT month_num FROM seasons WHERE season = 'Breeding')),
cls AS """ + classified_sql("one") + """,
bydate AS (
  SELECT pba3_block, CAST(observation_datetime AS DATE) AS observation_date,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'diurnal') / 60 AS duration_hours_diurnal,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'nocturnal') / 60 AS duration_hours_nocturnal,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'unknown') / 60 AS duration_hours_unknown
  FROM cls GROUP BY 1, 2
)
SELECT CAST(year(observation_date) AS INTEGER) AS obs_year, CAST(month(observation_date) AS INTEGER) AS obs_month_num,
  strftime(observation_date, '%b') AS obs_month,
  round(sum(coalesce(duration_hours_diurnal, 0) + coalesce(duration_hours_nocturnal, 0) + coalesce(duration_hours_unknown, 0)), 6)
    AS duration_hours_total,
  round(CASE WHEN count(*) = count(duration_hours_diurnal) THEN sum(duration_hours_diurnal) END, 6) AS duration_hours_diurnal,
  round(CASE WHEN count(*) = count(duration_hours_nocturnal) THEN sum(duration_hours_nocturnal) END, 6) AS duration_hours_nocturnal,
  round(CASE WHEN count(*) = count(duration_hours_unknown) THEN sum(duration_hours_unknown) END, 6) AS duration_hours_unknown
FROM bydate GROUP BY 1, 2, 3"""
ORACLE["effort_over_time_known"] = WF + """,
one AS (SELECT o.* FROM obsr o WHERE pba3_block = 'B3'
        AND observation_month_num IN (SELECT month_num FROM seasons WHERE season = 'Breeding')),
cls AS """ + classified_sql("one") + """,
bydate AS (
  SELECT pba3_block, CAST(observation_datetime AS DATE) AS observation_date,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'diurnal') / 60 AS duration_hours_diurnal,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'nocturnal') / 60 AS duration_hours_nocturnal,
    sum(duration_minutes) FILTER (WHERE checklist_type = 'unknown') / 60 AS duration_hours_unknown
  FROM cls GROUP BY 1, 2
)
SELECT CAST(year(observation_date) AS INTEGER) AS obs_year, CAST(month(observation_date) AS INTEGER) AS obs_month_num,
  strftime(observation_date, '%b') AS obs_month,
  round(sum(coalesce(duration_hours_diurnal, 0) + coalesce(duration_hours_nocturnal, 0) + coalesce(duration_hours_unknown, 0)), 6)
    AS duration_hours_total,
  round(sum(duration_hours_diurnal), 6) AS duration_hours_diurnal,
  round(sum(duration_hours_nocturnal), 6) AS duration_hours_nocturnal,
  round(sum(duration_hours_unknown), 6) AS duration_hours_unknown
FROM bydate GROUP BY 1, 2, 3"""
ORACLE["effort_audit"] = W + """,
naive AS (
  SELECT pba3_block, coalesce(sum(duration_minutes), 0) / 60 AS duration_hours_total_naive,
    coalesce(sum(effort_distance_km), 0) AS effort_distance_km_naive
  FROM (SELECT DISTINCT pba3_block, checklist_id, duration_minutes, effort_distance_km FROM obsr) GROUP BY 1
),
adj AS (
  SELECT pba3_block, coalesce(sum(d), 0) / 60 AS duration_hours_total_adj, coalesce(sum(k), 0) AS effort_distance_km_adj
  FROM (SELECT pba3_block, checklist_id, max(duration_minutes) AS d, max(effort_distance_km) AS k FROM obsr GROUP BY 1, 2)
  GROUP BY 1
)
SELECT n.pba3_block, round(duration_hours_total_naive, 6) AS duration_hours_total_naive,
  round(effort_distance_km_naive, 6) AS effort_distance_km_naive, round(duration_hours_total_adj, 6) AS duration_hours_total_adj,
  round(effort_distance_km_adj, 6) AS effort_distance_km_adj,
  round(duration_hours_total_adj - duration_hours_total_naive, 6) AS duration_hours_diff,
  round(effort_distance_km_adj - effort_distance_km_naive, 6) AS effort_distance_diff
FROM naive n LEFT JOIN adj a ON a.pba3_block IS NOT DISTINCT FROM n.pba3_block"""
AUDIT = ORACLE["effort_audit"].replace("SELECT n.pba3_block, round(", "SELECT * FROM (SELECT n.pba3_block, round(", 1) + ")"
ORACLE["effort_audit_changed"] = AUDIT + " WHERE abs(duration_hours_diff) > 0 OR abs(effort_distance_diff) > 0"
ORACLE["effort_audit_means"] = AUDIT.replace(
    "SELECT * FROM (SELECT n.pba3_block", "SELECT round(avg(duration_hours_diff), 6) AS mean_duration_hours_diff, "
    "round(avg(effort_distance_diff), 6) AS mean_effort_distance_diff FROM (SELECT n.pba3_block", 1)
ORACLE["focal_match"] = W + """,
focal AS (SELECT DISTINCT p_name AS common_name FROM part WHERE p_size <= 1),
seen AS (SELECT DISTINCT common_name FROM obsr)
SELECT common_name, 'focal_not_observed' AS side FROM focal WHERE common_name NOT IN (SELECT common_name FROM seen)
UNION ALL
SELECT common_name, 'observed_not_focal' AS side FROM seen WHERE common_name NOT IN (SELECT common_name FROM focal)"""
ORACLE["map_values"] = from_summary(
    "SELECT pba3_block, round_even(duration_hours_diurnal, 2) AS value FROM summary WHERE season = 'Breeding'"
)

# ---------------------------------------------------------------- 2.10 spatial
ORACLE["web_mercator"] = W + """
SELECT round(longitude, 6) AS longitude, round(latitude, 6) AS latitude,
  round(radians(longitude) * 6378137.0, 6) AS x_3857,
  round(ln(tan(pi() / 4 + radians(latitude) / 2)) * 6378137.0, 6) AS y_3857
FROM (SELECT DISTINCT longitude, latitude FROM obsr)"""
ORACLE["bbox_buffer"] = W + ",\n" + DENSITY + """
SELECT round(min(radians(longitude) * 6378137.0) - 1000.0, 6) AS xmin,
  round(min(ln(tan(pi() / 4 + radians(latitude) / 2)) * 6378137.0) - 1000.0, 6) AS ymin,
  round(max(radians(longitude) * 6378137.0) + 1000.0, 6) AS xmax,
  round(max(ln(tan(pi() / 4 + radians(latitude) / 2)) * 6378137.0) + 1000.0, 6) AS ymax
FROM dens"""

ORACLE["summary_polygons"] = SQ + HULL[len(W):] + """
SELECT cw.pba2_block, s.* REPLACE (cw.pba3_block AS pba3_block, """ + ", ".join(f"round(s.{c}, 6) AS {c}" for c in SUMMARY_DOUBLES) + """)
FROM cw LEFT JOIN summary s ON s.pba3_block = cw.pba3_block"""

# ---------------------------------------------------------------- 2.11 statistics
BREAKS = """mm AS (SELECT CAST(min(checklist_count) AS DOUBLE) AS lo, CAST(max(checklist_count) AS DOUBLE) AS hi FROM dens),
brks AS (
  SELECT DISTINCT round_even(exp(ln(lo) + i * (ln(hi) - ln(lo)) / 9), 0) AS brk
  FROM mm, (SELECT unnest(range(10)) AS i) WHERE lo > 0 AND hi > 0
)"""
ORACLE["log_breaks"] = W + ",\n" + DENSITY + ",\n" + BREAKS + "\nSELECT brk FROM brks"
ORACLE["density"] = W + ",\n" + ES + """,
es_rows AS (SELECT observation_month AS g, CAST(observed_pct AS DOUBLE) AS v FROM es),
s0 AS (
  SELECT g, count(*) AS n, stddev_samp(v) AS sd, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3, min(v) AS lo, max(v) AS hi
  FROM es_rows GROUP BY g
),
s1 AS (
  SELECT *, 0.9::DOUBLE * (CASE WHEN least(sd, (q3 - q1) / 1.34::DOUBLE) > 0 THEN least(sd, (q3 - q1) / 1.34::DOUBLE) WHEN sd > 0 THEN sd
    WHEN abs(lo) > 0 THEN abs(lo) ELSE 1.0::DOUBLE END) * pow(n, -0.2) AS h FROM s0
),
s2 AS (SELECT *, lo - 3 * h AS glo, ((hi + 3 * h) - (lo - 3 * h)) / 511 AS gstep FROM s1),
w AS (SELECT min(h) / 8 AS width FROM s2),
bin0 AS (
  SELECT g, CAST(floor(v / width) AS BIGINT) AS j, count(*) AS c, sum(v / width - floor(v / width)) AS f FROM es_rows, w GROUP BY 1, 2
),
bins AS (SELECT g, j, c - f AS wt FROM bin0 UNION ALL SELECT g, j + 1, f FROM bin0),
fan AS (
  SELECT b.g, b.wt, s.n, s.h, s.glo, s.gstep, b.j * w.width AS centre,
    unnest(range(CAST(greatest(ceil((b.j * w.width - 4 * s.h - s.glo) / s.gstep), 0) AS BIGINT),
                 CAST(least(floor((b.j * w.width + 4 * s.h - s.glo) / s.gstep), 511) AS BIGINT) + 1)) AS k
  FROM bins b JOIN s2 s ON s.g IS NOT DISTINCT FROM b.g, w WHERE b.wt > 0
)
SELECT g AS observation_month, CAST(k AS INTEGER) AS k, round(any_value(glo + k * gstep), 6) AS x,
  round(sum(wt * exp(-0.5 * ((glo + k * gstep - centre) / h) * ((glo + k * gstep - centre) / h)) / (n * h * sqrt(2 * pi()))), 6) AS density
FROM fan GROUP BY g, k"""
ORACLE["step_bins"] = W + ",\n" + DENSITY + ",\n" + BREAKS + """,
ranked AS (SELECT brk, row_number() OVER (ORDER BY brk) AS i, count(*) OVER () AS k FROM brks),
sizes AS (
  SELECT brk, i, CASE WHEN k = 1 THEN 3.0
    ELSE round_even(exp(ln(3.0) + (i - 1) * (ln(15.0) - ln(3.0)) / (k - 1)), 0) END AS size FROM ranked
)
SELECT round(d.longitude, 6) AS longitude, round(d.latitude, 6) AS latitude, d.checklist_count,
  coalesce((SELECT s.size FROM sizes s WHERE s.brk <= d.checklist_count ORDER BY s.brk DESC LIMIT 1),
           (SELECT s.size FROM sizes s WHERE s.i = 1)) AS circle_size
FROM dens d"""
ORACLE["histogram"] = W + ",\n" + ES + """,
mm AS (SELECT min(observed_pct) AS lo, max(observed_pct) AS hi FROM es),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1.0 END AS w FROM mm)
SELECT bin, round(lo + bin * w, 6) AS bin_lo, round(lo + (bin + 1) * w, 6) AS bin_hi, n FROM (
  SELECT CAST(least(floor((observed_pct - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n, any_value(lo) AS lo,
    any_value(w) AS w
  FROM es, w WHERE observed_pct IS NOT NULL GROUP BY 1)"""
ORACLE["bin_2d"] = W + ",\n" + ES + """
SELECT CAST(floor(CAST(checklist_count AS DOUBLE) / 100.0) AS BIGINT) AS bx,
  CAST(floor(observed_pct / 0.05) AS BIGINT) AS "by", count(*) AS n
FROM es WHERE observed_pct IS NOT NULL GROUP BY 1, 2"""

# ---------------------------------------------------------------- 2.12 quality
ORACLE["duplicate_keys"] = W + """
SELECT checklist_id, common_name, count(*) AS n FROM obsr GROUP BY 1, 2 HAVING count(*) > 1"""
ORACLE["one_to_one"] = W + """
SELECT checklist_id, count(*) AS n FROM (SELECT DISTINCT checklist_id, latitude FROM obsr WHERE checklist_id IS NOT NULL)
GROUP BY 1 HAVING count(*) > 1"""
ORACLE["class_balance"] = "WITH " + VISITS + ",\n" + fixed_sql("visits") + ",\ncls AS " + classified_sql("visits") + """
SELECT checklist_type, count(*) AS n FROM cls GROUP BY 1"""
_rise, _set = sun_sql("longitude", "latitude", "observation_datetime")
_odd = DRAW.format(seed=11, keys="pba3_block, checklist_id, CAST(longitude AS VARCHAR), CAST(latitude AS VARCHAR)")
ORACLE["class_outliers"] = "WITH " + VISITS + ",\n" + fixed_sql("visits") + ",\ncls AS " + classified_sql("visits") + f"""
SELECT checklist_type, pba3_block, checklist_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude,
  CAST(observation_datetime AS DATE) AS observation_date, strftime(observation_datetime, '%H:%M:%S') AS start,
  strftime({from_utc_sql(_rise)}, '%H:%M:%S') AS sunrise, strftime({from_utc_sql(_set)}, '%H:%M:%S') AS sunset
FROM (SELECT *, row_number() OVER (PARTITION BY checklist_type ORDER BY {_odd}) AS r FROM cls) WHERE r <= 1000"""
ORACLE["zone_check"] = "SELECT 'source' AS \"check\", 'nowhere' AS \"key\""
ORACLE["quality_report"] = W + ",\n" + NAMES + """,
per_block AS (SELECT pba3_block, count(*) AS n FROM obsr GROUP BY 1)
SELECT 'duplicate_checklist_species' AS "check", checklist_id || '|' || common_name AS "key", count(*) AS n
FROM obsr GROUP BY checklist_id, common_name HAVING count(*) > 1
UNION ALL
SELECT 'multi_start_checklist', checklist_id, count(*) FROM (SELECT DISTINCT checklist_id, observation_datetime FROM obsr)
GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL
SELECT 'multi_location_checklist', checklist_id, count(*) FROM (SELECT DISTINCT checklist_id, longitude, latitude FROM obsr)
GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL
SELECT 'block_without_name', pba3_block, n FROM per_block WHERE pba3_block NOT IN (SELECT pba3_block FROM names)
UNION ALL
SELECT 'name_without_observations', pba3_block, CAST(0 AS BIGINT) FROM names
WHERE pba3_block NOT IN (SELECT pba3_block FROM per_block)"""
ORACLE["dupe_start_export"] = W + """,
dupes AS (SELECT checklist_id FROM (SELECT DISTINCT checklist_id, observation_datetime FROM obsr)
          GROUP BY 1 HAVING count(*) > 1)
SELECT CAST(pba3_block AS VARCHAR) AS pba3_block, checklist_id, observer_id,
  CAST(observation_date AS VARCHAR) AS observation_date, time_observations_started,
  CAST(observation_datetime AS VARCHAR) AS observation_datetime
FROM (SELECT DISTINCT pba3_block, checklist_id, observer_id, observation_date, time_observations_started,
        observation_datetime FROM obsr)
WHERE checklist_id IN (SELECT checklist_id FROM dupes)"""
ORACLE["multi_valued_keys"] = W + """
SELECT checklist_id, count(*) AS n FROM (SELECT DISTINCT checklist_id, observation_datetime FROM obsr)
GROUP BY 1 HAVING count(*) > 1"""

_ = (math, LOOKUP, SEASONS, TZ)
