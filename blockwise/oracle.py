"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark code: same fixture roles (see
``blockwise.sources.fixtures``), same rules, plain SQL over the driver's
pre-registered tables. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

TZ = "America/New_York"

CATEGORY = """CASE
  WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN ' C4'
  WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'C3 '
  WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'C2'
  WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'C1'
  WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '  C1 '
  ELSE NULL END"""

RAW = f"""raw AS (
  SELECT 'B' || CAST(l_suppkey % 20 AS VARCHAR) AS atlas_block,
    'S' || CAST(l_orderkey AS VARCHAR) AS checklist_id,
    CAST(o_custkey AS VARCHAR) || ',' || CAST(o_custkey % 7 AS VARCHAR) AS observer_id,
    p_name AS common_name,
    CASE WHEN ({CATEGORY}) IS NULL THEN NULL ELSE '  ' || l_returnflag || '   ' || l_linestatus END AS breeding_code,
    {CATEGORY} AS breeding_category,
    CASE WHEN l_linenumber = 1 THEN 'X' WHEN l_linenumber = 7 THEN NULL
      ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS observation_count,
    CAST(o_orderdate AS DATE) AS observation_date,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE lpad(CAST((o_orderkey * 7) % 24 AS VARCHAR), 2, '0') || ':' ||
      (CASE WHEN o_orderkey % 5 = 0 AND l_linenumber = 2 THEN '30' ELSE '00' END) || ':00' END AS time_observations_started,
    CAST(o_custkey % 50 - 800 AS DOUBLE) / 10 AS longitude,
    CAST(l_suppkey % 20 * 2 + l_partkey % 7 + 800 AS DOUBLE) / 20 AS latitude,
    l_quantity AS duration_minutes,
    l_tax * 10 AS effort_distance_km,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Other' ELSE 'Atlas' END AS project_names,
    CASE o_orderstatus WHEN 'F' THEN 'Traveling' WHEN 'O' THEN 'Stationary' ELSE 'Incidental' END AS protocol_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

LOOKUP = """lk AS (
  SELECT * FROM (VALUES ('0', 'Not Observed', 0), ('C1', 'Observed', 1), ('C2', 'Possible', 2),
    ('C3', 'Probable', 3), ('C4', 'Confirmed', 4)) t(breeding_category, breeding_category_desc, breeding_rank)
)"""

SEASONS = """seasons AS (
  SELECT * FROM (VALUES
    ('All seasons', 'Jan', 1), ('All seasons', 'Feb', 2), ('All seasons', 'Mar', 3), ('All seasons', 'Apr', 4),
    ('All seasons', 'May', 5), ('All seasons', 'Jun', 6), ('All seasons', 'Jul', 7), ('All seasons', 'Aug', 8),
    ('All seasons', 'Sep', 9), ('All seasons', 'Oct', 10), ('All seasons', 'Nov', 11), ('All seasons', 'Dec', 12),
    ('Breeding', 'Apr', 4), ('Breeding', 'May', 5), ('Breeding', 'Jun', 6), ('Breeding', 'Jul', 7),
    ('Breeding', 'Aug', 8), ('Winter', 'Dec', 12), ('Winter', 'Jan', 1), ('Winter', 'Feb', 2)
  ) t(season, month, month_num)
)"""

OBS = f"""{RAW},
{LOOKUP},
{SEASONS},
parsed AS (
  SELECT *, try_strptime(strftime(observation_date, '%Y-%m-%d') || ' ' || time_observations_started,
    '%Y-%m-%d %H:%M:%S') AS ts FROM raw
),
obs AS (
  SELECT p.atlas_block AS pba3_block, p.checklist_id, p.observer_id, p.common_name,
    trim(regexp_replace(p.breeding_code, '\\s+', ' ', 'g')) AS breeding_code,
    coalesce(trim(regexp_replace(p.breeding_category, '\\s+', ' ', 'g')), 'C1') AS breeding_category,
    p.observation_count, p.observation_date, p.time_observations_started,
    strftime(p.observation_date, '%b') AS observation_month,
    CAST(month(p.observation_date) AS INTEGER) AS observation_month_num,
    CASE WHEN timezone('{TZ}', timezone('{TZ}', p.ts)) = p.ts THEN p.ts END AS observation_datetime,
    p.longitude, p.latitude, p.duration_minutes, p.effort_distance_km, p.project_names, p.protocol_name
  FROM parsed p
),
obsr AS (
  SELECT o.*, lk.breeding_category_desc, lk.breeding_rank FROM obs o LEFT JOIN lk USING (breeding_category)
)"""


def sun_sql(lon: str, lat: str, dt: str) -> tuple[str, str]:
    """(sunrise_utc, sunset_utc) SQL expressions for a local datetime column."""
    n = f"(CAST(date_diff('day', DATE '2000-01-01', CAST({dt} AS DATE)) AS DOUBLE) - {lon} / 360.0)"
    m = f"(357.5291 + 0.98560028 * {n})"
    c = f"(1.9148 * sin(radians({m})) + 0.02 * sin(radians(2 * {m})) + 0.0003 * sin(radians(3 * {m})))"
    lam = f"({m} + {c} + 282.9372)"
    transit = f"({n} + 0.0053 * sin(radians({m})) - 0.0069 * sin(radians(2 * {lam})))"
    sd = f"(sin(radians({lam})) * sin(radians(23.44)))"
    cw = f"((sin(radians(-0.833)) - sin(radians({lat})) * {sd}) / (cos(radians({lat})) * sqrt(1 - {sd} * {sd})))"
    w = f"(CASE WHEN abs({cw}) <= 1 THEN degrees(acos({cw})) END)"

    def at(days: str) -> str:
        return f"(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(CAST(floor(({days} + 0.5) * 86400.0 + 0.5) AS BIGINT)))"

    return at(f"({transit} - {w} / 360.0)"), at(f"({transit} + {w} / 360.0)")


def to_utc_sql(ts: str) -> str:
    return f"timezone('UTC', timezone('{TZ}', {ts}))"


def from_utc_sql(ts: str) -> str:
    return f"timezone('{TZ}', timezone('UTC', {ts}))"


def classified_sql(src: str, group: str = "") -> str:
    """Per (group, block, checklist, lon, lat): start, duration, class. ``src`` has the rows."""
    g = f"{group}, " if group else ""
    rise, sset = sun_sql("longitude", "latitude", "observation_datetime")
    start = to_utc_sql("observation_datetime")
    return f"""(
  SELECT *, CASE
      WHEN {start} BETWEEN {rise} - INTERVAL 40 MINUTE AND {sset} + INTERVAL 20 MINUTE THEN 'diurnal'
      WHEN NOT ({start} BETWEEN {rise} - INTERVAL 40 MINUTE AND {sset} + INTERVAL 20 MINUTE) THEN 'nocturnal'
      ELSE 'unknown' END AS checklist_type
  FROM (
    SELECT {g}pba3_block, checklist_id, longitude, latitude,
      coalesce(max(f.fixed), min(observation_datetime)) AS observation_datetime,
      CAST(coalesce(max(duration_minutes), 0) AS DOUBLE) AS duration_minutes
    FROM {src} LEFT JOIN fixed f USING (checklist_id)
    GROUP BY ALL
  )
)"""


FIXED = """dupes AS (
  SELECT checklist_id FROM (SELECT DISTINCT checklist_id, observation_datetime FROM obsr)
  GROUP BY checklist_id HAVING count(*) > 1
),
exploded AS (
  SELECT checklist_id, observation_datetime, unnest(string_split(observer_id, ',')) AS obs_one
  FROM (SELECT DISTINCT pba3_block, checklist_id, observer_id, observation_datetime FROM obsr
        WHERE checklist_id IN (SELECT checklist_id FROM dupes))
),
fixed AS (
  SELECT checklist_id, observation_datetime AS fixed FROM (
    SELECT checklist_id, observation_datetime,
      row_number() OVER (PARTITION BY checklist_id ORDER BY count(*) DESC, observation_datetime) AS rn
    FROM exploded WHERE observation_datetime IS NOT NULL GROUP BY checklist_id, observation_datetime
  ) WHERE rn = 1
)"""

NAMES = """names AS (
  SELECT 'B' || CAST(s_suppkey % 20 AS VARCHAR) AS pba3_block, min(s_name) AS block_name,
    min(r_name) AS block_region, min(n_name) AS block_county
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1
)"""

NOCTURNAL = """nocturnal AS (SELECT DISTINCT p_name AS common_name FROM part WHERE p_size >= 50)"""
FOCAL = """focal AS (SELECT DISTINCT p_name AS common_name, TRUE AS is_focal FROM part WHERE p_size <= 1)"""


def nd(c: str) -> str:
    """n_distinct with NULL counted once."""
    return f"(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))"


def r6(c: str, alias: str | None = None) -> str:
    return f"round(CAST({c} AS DOUBLE), 6) AS {alias or c}"


OLD_ATLAS = """old_long AS (
  SELECT 'B' || CAST(l_suppkey % 25 AS VARCHAR) AS pba3_block, p_name AS species,
    max(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 4 WHEN l_returnflag = 'A' THEN 3
             WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 2 ELSE 1 END) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE year(o_orderdate) < 1998 GROUP BY 1, 2
),
old_blocks AS (SELECT DISTINCT pba3_block FROM old_long),
all_species AS (SELECT DISTINCT p_name AS species FROM part),
old_cells AS (
  SELECT b.pba3_block, s.species AS common_name,
    CASE l.r WHEN 1 THEN 'Observed' WHEN 2 THEN 'Possible' WHEN 3 THEN 'Probable' WHEN 4 THEN 'Confirmed' END
      AS pba2_breeding_category_max
  FROM old_blocks b CROSS JOIN all_species s
  LEFT JOIN old_long l ON l.pba3_block = b.pba3_block AND l.species = s.species
),
pba2 AS (
  SELECT DISTINCT c.pba3_block, c.common_name, c.pba2_breeding_category_max, lk.breeding_rank AS pba2_breeding_rank_max
  FROM old_cells c LEFT JOIN lk ON lk.breeding_category_desc = c.pba2_breeding_category_max
),
pba3 AS (
  SELECT DISTINCT pba3_block, common_name, breeding_category_desc AS pba3_breeding_category_max,
    breeding_rank AS pba3_breeding_rank_max
  FROM (SELECT *, max(breeding_rank) OVER (PARTITION BY pba3_block, common_name) AS mx FROM obsr)
  WHERE breeding_rank = mx
),
cmp AS (
  SELECT k.pba3_block, coalesce(n.block_name, 'Unknown block name') AS block_name,
    coalesce(n.block_region, 'Unknown region') AS block_region, k.common_name,
    coalesce(a.pba2_breeding_category_max, 'Not Observed') AS pba2_breeding_category_max,
    coalesce(a.pba2_breeding_rank_max, 0) AS pba2_breeding_rank_max,
    coalesce(b.pba3_breeding_category_max, 'Not Observed') AS pba3_breeding_category_max,
    coalesce(b.pba3_breeding_rank_max, 0) AS pba3_breeding_rank_max,
    coalesce(n.block_county, 'Unknown county') AS block_county
  FROM (SELECT pba3_block, common_name FROM pba2 UNION SELECT pba3_block, common_name FROM pba3) k
  LEFT JOIN pba2 a ON a.pba3_block IS NOT DISTINCT FROM k.pba3_block AND a.common_name IS NOT DISTINCT FROM k.common_name
  LEFT JOIN pba3 b ON b.pba3_block IS NOT DISTINCT FROM k.pba3_block AND b.common_name IS NOT DISTINCT FROM k.common_name
  LEFT JOIN names n ON n.pba3_block IS NOT DISTINCT FROM k.pba3_block
),
atlas_metrics AS (
  SELECT pba3_block,
    CAST(count(*) FILTER (WHERE pba2_breeding_rank_max > 0) AS BIGINT) AS species_count_pba2,
    CAST(count(*) FILTER (WHERE pba2_breeding_rank_max > 1) AS BIGINT) AS species_coded_pba2,
    CAST(count(*) FILTER (WHERE pba3_breeding_rank_max > 0) AS BIGINT) AS species_count_pba3,
    CAST(count(*) FILTER (WHERE pba3_breeding_rank_max > 1) AS BIGINT) AS species_coded_pba3,
    avg(CASE WHEN pba2_breeding_rank_max = 4 AND pba3_breeding_rank_max < 4 THEN 1.0 ELSE 0.0 END)
      AS pct_missing_pba2_confirmations,
    avg(CASE WHEN pba3_breeding_rank_max >= pba2_breeding_rank_max THEN 1.0 ELSE 0.0 END) AS pct_coded_atlas_comparison
  FROM cmp GROUP BY pba3_block
),
atlas_metrics2 AS (
  SELECT *, CASE WHEN species_coded_pba2 = 0 AND species_coded_pba3 = 0 THEN NULL
                 WHEN species_coded_pba2 = 0 THEN CAST('Infinity' AS DOUBLE)
                 ELSE CAST(species_coded_pba3 AS DOUBLE) / species_coded_pba2 END AS pba3_pba2_coded_count_compare_pct
  FROM atlas_metrics
)"""


def summary_sql(with_atlas: bool = True) -> str:
    """The block × season summary CTE chain (``summary``), without the nested breakdown."""
    atlas = f",\n{OLD_ATLAS}" if with_atlas else ""
    return f"""WITH {OBS},
{FIXED},
{NAMES},
{NOCTURNAL}{atlas},
fan AS (SELECT s.season, o.* FROM obsr o JOIN seasons s ON s.month_num = o.observation_month_num),
cc AS (SELECT season, pba3_block, CAST({nd('checklist_id')} AS BIGINT) AS checklist_count FROM fan GROUP BY ALL),
so AS (SELECT season, pba3_block, CAST({nd('common_name')} AS BIGINT) AS species_observed FROM fan GROUP BY ALL),
bi AS (
  SELECT season, pba3_block, CAST({nd('obs_one')} AS BIGINT) AS birders FROM (
    SELECT season, pba3_block, unnest(string_split(observer_id, ',')) AS obs_one
    FROM (SELECT DISTINCT season, pba3_block, observer_id FROM fan)
  ) GROUP BY ALL
),
ef AS (
  SELECT season, pba3_block, coalesce(sum(d), 0) / 60 AS duration_hours_total, coalesce(sum(k), 0) AS effort_distance_km
  FROM (SELECT season, pba3_block, checklist_id, max(duration_minutes) AS d, max(effort_distance_km) AS k
        FROM fan GROUP BY ALL) GROUP BY ALL
),
coded AS (
  SELECT season, pba3_block,
    CAST(nullif(count(*) FILTER (WHERE r = 1), 0) AS BIGINT) AS Observed, CAST(nullif(count(*) FILTER (WHERE r = 2), 0) AS BIGINT) AS Possible,
    CAST(nullif(count(*) FILTER (WHERE r = 3), 0) AS BIGINT) AS Probable, CAST(nullif(count(*) FILTER (WHERE r = 4), 0) AS BIGINT) AS Confirmed
  FROM (SELECT season, pba3_block, common_name, max(breeding_rank) AS r FROM fan GROUP BY ALL) WHERE r IS NOT NULL
  GROUP BY ALL
),
cls AS {classified_sql('fan', 'season')},
dn AS (
  SELECT season, pba3_block,
    coalesce(sum(duration_minutes) FILTER (WHERE checklist_type = 'diurnal') / 60, 0) AS duration_hours_diurnal,
    coalesce(sum(duration_minutes) FILTER (WHERE checklist_type = 'nocturnal') / 60, 0) AS duration_hours_nocturnal,
    coalesce(sum(duration_minutes) FILTER (WHERE checklist_type = 'unknown') / 60, 0) AS duration_hours_unknown
  FROM cls GROUP BY ALL
),
cov AS (
  SELECT season, pba3_block, CAST(count(DISTINCT m) AS BIGINT) AS breeding_season_months_covered
  FROM (SELECT DISTINCT season, pba3_block, month(observation_datetime) AS m FROM fan)
  WHERE m IN (SELECT month_num FROM seasons WHERE season = 'Breeding') GROUP BY ALL
),
noc AS (
  SELECT b.season, b.pba3_block, CAST(coalesce(x.n, 0) AS BIGINT) AS nocturnal_species_coded
  FROM (SELECT DISTINCT season, pba3_block FROM fan) b
  LEFT JOIN (SELECT season, pba3_block, {nd('common_name')} AS n FROM fan
             WHERE breeding_rank >= 2 AND common_name IN (SELECT common_name FROM nocturnal) GROUP BY ALL) x
    ON x.season = b.season AND x.pba3_block IS NOT DISTINCT FROM b.pba3_block
),
summary AS (
  SELECT cc.pba3_block, coalesce(n.block_name, 'Unknown block name') AS block_name,
    coalesce(n.block_region, 'Unknown region') AS block_region,
    coalesce(n.block_county, 'Unknown county') AS block_county, cc.season, so.species_observed,
    coded.Observed, coded.Possible, coded.Probable, coded.Confirmed, cc.checklist_count, bi.birders,
    ef.duration_hours_total, dn.duration_hours_diurnal, dn.duration_hours_nocturnal, dn.duration_hours_unknown,
    ef.effort_distance_km,
    {'am.pct_missing_pba2_confirmations' if with_atlas else 'CAST(NULL AS DOUBLE)'} AS pct_missing_pba2_confirmations,
    {'am.pct_coded_atlas_comparison' if with_atlas else 'CAST(NULL AS DOUBLE)'} AS pct_coded_atlas_comparison,
    {'am.pba3_pba2_coded_count_compare_pct' if with_atlas else 'CAST(NULL AS DOUBLE)'} AS pba3_pba2_coded_count_compare_pct,
    cov.breeding_season_months_covered, noc.nocturnal_species_coded
  FROM cc
  LEFT JOIN so ON so.season = cc.season AND so.pba3_block IS NOT DISTINCT FROM cc.pba3_block
  LEFT JOIN bi ON bi.season = cc.season AND bi.pba3_block IS NOT DISTINCT FROM cc.pba3_block
  LEFT JOIN ef ON ef.season = cc.season AND ef.pba3_block IS NOT DISTINCT FROM cc.pba3_block
  LEFT JOIN coded ON coded.season = cc.season AND coded.pba3_block IS NOT DISTINCT FROM cc.pba3_block
  LEFT JOIN dn ON dn.season = cc.season AND dn.pba3_block IS NOT DISTINCT FROM cc.pba3_block
  LEFT JOIN cov ON cov.season = cc.season AND cov.pba3_block IS NOT DISTINCT FROM cc.pba3_block
  LEFT JOIN noc ON noc.season = cc.season AND noc.pba3_block IS NOT DISTINCT FROM cc.pba3_block
  {"LEFT JOIN atlas_metrics2 am ON am.pba3_block IS NOT DISTINCT FROM cc.pba3_block AND cc.season = 'All seasons'" if with_atlas else ''}
  LEFT JOIN names n ON n.pba3_block IS NOT DISTINCT FROM cc.pba3_block
)"""


def round_select(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(r6(c) if c in doubles else c for c in cols)
