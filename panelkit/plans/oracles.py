"""DuckDB SQL for the catalog's queries, on the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def R(x: str, name: str = "") -> str:
    """Six digits, nudged off exact half ties as in `canon`."""
    return f"(round(CAST({x} AS DOUBLE) + 1e-9, 6) + 0.0)" + (f" AS {name}" if name else "")


def T(x: str, name: str = "") -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')" + (f" AS {name}" if name else "")


def D(x: str, name: str = "") -> str:
    return f"strftime({x}, '%Y-%m-%d')" + (f" AS {name}" if name else "")


def I(x: str, name: str = "") -> str:  # noqa: E743
    return f"CAST({x} AS BIGINT)" + (f" AS {name}" if name else "")


def PARIS(ts: str) -> str:
    return f"timezone('Europe/Paris', ({ts}) AT TIME ZONE 'UTC')"


RAW = """raw AS (
  SELECT event_id, ts AS ts_utc, time_bucket(INTERVAL '360 minutes', ts) AS tbin_utc,
    CAST(user_id AS VARCHAR) AS station_id, user_id,
    CAST(floor(value) AS INTEGER) % 31 AS bikes, CAST(20 + user_id % 11 AS INTEGER) AS capacity,
    event_type AS status,
    CAST(48.80 AS DOUBLE) + CAST(user_id % 13 AS DOUBLE) * CAST(0.008 AS DOUBLE) AS lat,
    CAST(2.25 AS DOUBLE) + CAST((user_id * 7) % 17 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS lon,
    CASE WHEN event_id % 5 <> 0 THEN 'Station ' || CAST(user_id AS VARCHAR) END AS name,
    ts + to_minutes(event_id % 7) AS ingested_at
  FROM events)"""

PANEL = RAW + """, panel AS (
  SELECT *, CAST(bikes AS DOUBLE) / capacity AS occ_ratio,
    CASE WHEN bikes <= 2 THEN 1 ELSE 0 END AS is_penury,
    CASE WHEN capacity - bikes <= 2 THEN 1 ELSE 0 END AS is_saturation,
    greatest(capacity - bikes, 0) AS docks
  FROM raw
  QUALIFY row_number() OVER (PARTITION BY station_id, tbin_utc ORDER BY ts_utc DESC, event_id DESC) = 1)"""

HEALTH = RAW + """, h AS (
  SELECT * FROM raw WHERE tbin_utc <= TIMESTAMP '2024-01-30 18:00:00'
    AND tbin_utc > TIMESTAMP '2024-01-30 18:00:00' - INTERVAL '14 days'),
 bins AS (SELECT station_id, tbin_utc, count(*) AS c FROM h GROUP BY 1, 2),
 st AS (SELECT station_id, sum(c) AS nrows, count(*) AS obs, min(tbin_utc) AS first_bin, max(tbin_utc) AS last_bin
        FROM bins GROUP BY 1),
 days AS (SELECT count(DISTINCT CAST(tbin_utc AS DATE)) * 4 AS expected FROM h),
 cov AS (SELECT station_id, least(obs, expected) AS obs, expected,
         least(obs, expected) / CAST(expected AS DOUBLE) * 100 AS coverage_pct, greatest(expected - obs, 0) AS missing
         FROM st, days)"""

PERF = PANEL + """, rolled AS (
  SELECT *, avg(bikes) OVER (PARTITION BY station_id ORDER BY tbin_utc ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rm
  FROM panel),
 perf AS (
  SELECT a.tbin_utc, a.station_id, hz.horizon_bins, b.bikes AS y_true, a.bikes AS y_baseline_persist, a.lat, a.lon, a.name,
    a.rm AS y_pred, CASE WHEN a.rm IS NOT NULL THEN CAST(round_even(greatest(a.rm, 0), 0) AS INTEGER) END AS y_pred_int,
    a.tbin_utc + to_minutes(hz.horizon_bins * 360) AS tbin_target
  FROM rolled a CROSS JOIN (VALUES (1), (2)) hz(horizon_bins)
  LEFT JOIN panel b ON b.station_id = a.station_id AND b.tbin_utc = a.tbin_utc + to_minutes(hz.horizon_bins * 360)),
 used AS (SELECT *, y_true - y_pred_int AS resid FROM perf WHERE y_true IS NOT NULL AND y_pred_int IS NOT NULL),
 usedf AS (SELECT *, y_true - y_pred AS resid FROM perf WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"""

MASKS = PANEL + """, est AS (SELECT station_id, CAST(max(capacity) AS DOUBLE) AS cap_est FROM panel GROUP BY 1),
 occd AS (SELECT p.*, cap_est, least(greatest(greatest(bikes, 0) / cap_est, 0), 1) AS occ FROM panel p JOIN est USING (station_id)),
 masked AS (SELECT *, occ IS NOT NULL AS valid, occ IS NOT NULL AND cap_est - bikes <= 2 AS is_sat,
   occ IS NOT NULL AND NOT (cap_est - bikes <= 2) AND bikes <= 2 AS is_pen FROM occd)"""


def masks_recent(days: int) -> str:
    """Masks computed on the rows of the last local days."""
    return PANEL.replace("panel AS (", "panel0 AS (") + f""", panel AS (
  SELECT * FROM panel0 WHERE {PARIS('tbin_utc')} >= (SELECT max({PARIS('tbin_utc')}) FROM panel0) - INTERVAL '{days} days')""" + MASKS[len(PANEL):]


RATES = f"""{R('avg(occ)', 'occ_mean')}, {R('avg(CASE WHEN is_pen THEN 1.0 ELSE 0.0 END)', 'penury_rate')},
  {R('avg(CASE WHEN is_sat THEN 1.0 ELSE 0.0 END)', 'saturation_rate')}, {I('count(*) FILTER (WHERE valid)', 'n_obs')}"""


def sql(name: str, ctes: str, body: str) -> None:
    ORACLES[name] = (f"WITH {ctes} " if ctes else "") + body


# ---- cleaning -------------------------------------------------------------------------------

sql("enforce_schema", "", f"""
SELECT CAST(user_id AS VARCHAR) AS station_id, {T('ts', 'ts_utc')}, CAST(NULL AS VARCHAR) AS tbin_utc,
  {I("CASE WHEN event_id % 10 = 0 THEN NULL ELSE round_even(value, 0) END", 'bikes')}, CAST(NULL AS BIGINT) AS capacity,
  event_type AS status, {R('value', '"temp_C"')} FROM events""")

sql("resolve_columns", RAW, f"""
SELECT station_id, {I('sum(bikes)', 'bikes')}, {I('max(capacity)', 'capacity')}, {T('max(ingested_at)', 'ingested_at')},
  {T('min(tbin_utc)', 'tbin_utc')} FROM raw GROUP BY station_id""")

sql("repair_grid", "", f"""SELECT event_id, {T("time_bucket(INTERVAL '5 minutes', ts)", 'tbin_utc')} FROM events""")

sql("dedup_latest", PANEL, f"SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {T('ts_utc', 'ts_utc')}, event_id, {I('bikes', 'bikes')}, status FROM panel")

sql("health_window_bounds", HEALTH, f"SELECT {D('tbin_utc', 'day')}, count(*) AS n FROM h GROUP BY 1")

sql("local_days_window", PANEL, f"""
SELECT {D(PARIS('tbin_utc'), 'day')}, count(*) AS n FROM panel
WHERE {PARIS('tbin_utc')} <= TIMESTAMP '2024-01-30 18:00:00'
  AND {PARIS('tbin_utc')} > TIMESTAMP '2024-01-30 18:00:00' - INTERVAL '10 days' GROUP BY 1""")

sql("enriched_events", PANEL + ", codes AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS status_code FROM (SELECT DISTINCT status FROM panel))", f"""
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {R('occ_ratio', 'occ_ratio')}, {I('is_penury', 'is_penury')},
  {I('is_saturation', 'is_saturation')}, {I('status_code', 'status_code')}, {I('hour(tbin_utc)', 'h')}, {I('minute(tbin_utc)', 'min')}
FROM panel JOIN codes USING (status)""")

sql("valid_occupancy", PANEL, f"""
SELECT station_id, {R('avg(occ_ratio) FILTER (WHERE occ_ratio BETWEEN 0 AND 1)', 'occ_mean')},
  count(*) FILTER (WHERE occ_ratio BETWEEN 0 AND 1) AS n, {R('avg(docks)', 'docks_mean')} FROM panel GROUP BY 1""")

LOC = PARIS("tbin_utc")
sql("calendar_features", PANEL, f"""
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, hour(tbin_utc) AS hour, minute(tbin_utc) AS minute,
  isodow(tbin_utc) - 1 AS dow, month(tbin_utc) AS month, {I('isodow(tbin_utc) >= 6', 'is_weekend')},
  {R('sin(2 * pi() * (hour(tbin_utc) + minute(tbin_utc) / 60.0) / 24)', 'hod_sin')},
  {R('cos(2 * pi() * (hour(tbin_utc) + minute(tbin_utc) / 60.0) / 24)', 'hod_cos')},
  {R('sin(2 * pi() * (isodow(tbin_utc) - 1) / 7)', 'dow_sin')}, {R('cos(2 * pi() * (isodow(tbin_utc) - 1) / 7)', 'dow_cos')},
  hour({LOC}) AS paris_hour, isodow({LOC}) - 1 AS paris_dow, {I(f'isodow({LOC}) >= 6', 'paris_is_we')} FROM panel""")

LAST_ST = PANEL + """, st AS (SELECT station_id, arg_max(lat, tbin_utc) AS lat, arg_max(lon, tbin_utc) AS lon,
  arg_max(capacity, tbin_utc) AS capacity FROM panel GROUP BY 1)"""


def hav(a: str, b: str, c: str, d: str) -> str:
    return (f"2 * 6371 * asin(least(1, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * "
            f"cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))")


def rnd(x: str, digits: int) -> str:
    return f"CAST(round_even({x} * 1{'0' * digits}, 0) / CAST(1{'0' * digits} AS DOUBLE) AS VARCHAR)"


sql("station_geometry", LAST_ST, f"""
SELECT station_id, {R(hav('lat', 'lon', '48.853', '2.349'), 'dist_center_km')},
  {I('floor(lon / (300.0 / 75000.0))', 'grid_x')}, {I('floor(lat / (300.0 / 111000.0))', 'grid_y')},
  {rnd('lat', 2)} || ',' || {rnd('lon', 2)} AS zone2, {rnd('lat', 3)} || '|' || {rnd('lon', 3)} AS zone3 FROM st""")

sql("clip_round", "e AS (SELECT event_id, floor(value) % 60 - 10 + 0.5 AS p, 20 + user_id % 11 AS cap FROM events)", f"""
SELECT event_id, {I('round_even(least(greatest(p, 0), cap), 0)', 'clipped')}, {I('round_even(greatest(p, 0), 0)', 'unclipped')} FROM e""")

sql("horizon_normalised", "", f"""
SELECT event_id, {I("CASE WHEN event_id % 2 = 0 THEN event_id % 12 ELSE round_even((user_id % 60) / 5.0, 0) END", 'horizon_bins')} FROM events""")

sql("station_code_clean", "", """
SELECT event_id, nullif(ltrim(lpad(CAST(user_id AS VARCHAR), 6, '0'), '0'), '') AS code,
  CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) ELSE lpad(CAST(user_id AS VARCHAR), 6, '0') END AS station_id,
  CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 1 THEN 'OK' ELSE 'CLOSED' END AS status FROM events""")

sql("status_lights", RAW + """, a AS (SELECT event_id, bikes / 100.0 AS psi,
  greatest((epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts_utc))) / 60.0, 0) AS age_min FROM raw)""", f"""
SELECT event_id, {R('age_min', 'age_min')}, CASE WHEN age_min <= 7 THEN 'ok' WHEN age_min <= 2000 THEN 'warn' ELSE 'down' END AS light,
  CASE WHEN psi < 0.10 THEN 'ok' WHEN psi < 0.20 THEN 'warn' ELSE 'down' END AS psi_light,
  CASE WHEN -psi <= -0.2 THEN 'ok' WHEN -psi <= -0.1 THEN 'warn' ELSE 'down' END AS score_light FROM a""")

sql("best_day", PANEL + ", d AS (SELECT DISTINCT CAST(tbin_utc AS DATE) AS d FROM panel), a(anchor) AS (VALUES ('2024-01-20'), ('2023-12-01'))", f"""
SELECT {D('coalesce(max(d) FILTER (WHERE d <= CAST(anchor AS DATE)), min(d) FILTER (WHERE d > CAST(anchor AS DATE)))', 'day')}, anchor
FROM d, a GROUP BY anchor""")

# ---- joins, windows -----------------------------------------------------------------------------

WEATHER = """, w AS (SELECT date_trunc('hour', ts) AS hour_utc, avg(value) AS temp_c, max(value) AS precip_mm, min(value) AS wind_mps
  FROM events GROUP BY 1), wp AS (SELECT p.*, temp_c, precip_mm, wind_mps FROM panel p
  LEFT JOIN w ON w.hour_utc = date_trunc('hour', p.tbin_utc))"""

sql("weather_join", PANEL + WEATHER, f"""
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {R('temp_c', '"temp_C"')}, {R('precip_mm', 'precip_mm')}, {R('wind_mps', 'wind_mps')} FROM wp""")

sql("forecast_targets", PERF.replace("a.lat, a.lon, a.name,", "a.bikes, a.capacity,"), f"""
SELECT {T('tbin_utc', 'tbin_utc')}, station_id, {I('bikes', 'bikes')}, {I('capacity', 'capacity')}, {I('horizon_bins', 'horizon_bins')},
  {I('y_true', 'y_true')}, {I('y_baseline_persist', 'y_baseline_persist')}, {T('tbin_target', 'tbin_target')} FROM perf""")

sql("forecast_pairs", PERF, f"""
SELECT a.station_id, {T('a.tbin_utc', 'tbin_utc')}, {I('b.bikes', 'y_true')}, {I('a.bikes // 2', 'mechanical')},
  {I('a.bikes - a.bikes // 2', 'ebike')}, {R('b.rm', 'y_pred')},
  {I('CASE WHEN b.rm IS NOT NULL THEN round_even(least(greatest(b.rm, 0), a.capacity), 0) END', 'y_pred_int')}
FROM rolled a LEFT JOIN rolled b ON b.station_id = a.station_id AND b.tbin_utc = a.tbin_utc + INTERVAL '360 minutes'""")

W0 = "(PARTITION BY station_id ORDER BY tbin_utc)"
sql("lag_features", PANEL, f"SELECT station_id, {T('tbin_utc', 'tbin_utc')}, " + ", ".join(
    I(f"lag(bikes, {n}) OVER {W0}", f"lag_bikes_{n}") for n in (1, 2, 3, 6, 12, 24, 36, 48)) + " FROM panel")

sql("lag_features_by_time", PANEL, f"SELECT p.station_id, {T('p.tbin_utc', 'tbin_utc')}, " + ", ".join(
    I(f"l{n}.bikes", f"lag_bikes_{n}") for n in (1, 2, 3, 6, 12, 24, 36, 48)) + " FROM panel p " + " ".join(
    f"LEFT JOIN panel l{n} ON l{n}.station_id = p.station_id AND l{n}.tbin_utc = p.tbin_utc - INTERVAL '{360 * n} minutes'" for n in (1, 2, 3, 6, 12, 24, 36, 48)))


def rolls(frame: str, n: int) -> str:
    w = f"OVER (PARTITION BY station_id ORDER BY tbin_utc {frame})"
    m = max(1, n // 2)
    return (R(f"CASE WHEN count(bikes) {w} >= {m} THEN avg(bikes) {w} END", f"roll_mean_{n}") + ", "
            + R(f"CASE WHEN count(bikes) {w} >= {m} THEN stddev_samp(bikes) {w} END", f"roll_std_{n}"))


sql("rolling_features", PANEL, f"SELECT station_id, {T('tbin_utc', 'tbin_utc')}, " + ", ".join(
    rolls(f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING", n) for n in (3, 6, 12, 24, 36, 48)) + " FROM panel")
sql("rolling_features_by_time", PANEL, f"SELECT station_id, {T('tbin_utc', 'tbin_utc')}, " + ", ".join(
    rolls(f"RANGE BETWEEN INTERVAL '{360 * n} minutes' PRECEDING AND INTERVAL '360 minutes' PRECEDING", n) for n in (3, 6, 12, 24, 36, 48)) + " FROM panel")

W12 = "OVER (PARTITION BY station_id ORDER BY tbin_utc ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
X_T = "epoch(tbin_utc) / 21600.0"
sql("trend_slope", PANEL, f"""
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {R(f'CASE WHEN count(*) {W12} > 1 THEN regr_slope(bikes, {X_T}) {W12} END', 'trend_nb_12b')},
  {R(f'CASE WHEN count(*) {W12} > 1 THEN regr_slope(occ_ratio, {X_T}) {W12} END', 'trend_occ_12b')} FROM panel""")

sql("lead_target", PANEL + WEATHER, f"""
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {I(f'lead(bikes, 3) OVER {W0}', 'y_nb')}, {R(f'lag(temp_c) OVER {W0}', '"temp_C_lag1"')} FROM wp""")

sql("latest_features", PANEL + WEATHER, f"""
SELECT * EXCLUDE (rn) FROM (SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {I('bikes', 'bikes')}, {R('occ_ratio', 'occ_ratio')},
  {I(f'lag(bikes) OVER {W0}', 'lag_bikes_1')}, {I(f'lag(bikes, 12) OVER {W0}', 'lag_bikes_12')},
  {rolls('ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING', 6).split(', (round')[0]},
  {'(round' + rolls('ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING', 12).split(', (round')[1]},
  {R(f'CASE WHEN count(*) {W12} > 1 THEN regr_slope(bikes, {X_T}) {W12} END', 'trend_nb_12b')},
  {R(f'lag(temp_c) OVER {W0}', '"temp_C_lag1"')},
  row_number() OVER (PARTITION BY station_id ORDER BY wp.tbin_utc DESC) AS rn FROM wp) WHERE rn = 1""")

sql("recent_history", PANEL, f"""
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {I('bikes', 'bikes')} FROM panel
QUALIFY panel.tbin_utc >= max(panel.tbin_utc) OVER (PARTITION BY station_id) - INTERVAL '2880 minutes'""")

sql("prev_day_tail", PANEL, f"""
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {I('bikes', 'bikes')} FROM panel
WHERE panel.tbin_utc >= TIMESTAMP '2024-01-23 12:00:00' AND panel.tbin_utc < TIMESTAMP '2024-01-25 00:00:00'""")

sql("last_non_null", PANEL, f"""
SELECT station_id, arg_max(name, tbin_utc) FILTER (WHERE name IS NOT NULL) AS name, {R('arg_max(lat, tbin_utc)', 'lat')} FROM panel GROUP BY 1""")

sql("step_median", PANEL, f"""
SELECT {R('quantile_cont(gap, 0.5)', 'step_min')} FROM (
  SELECT (epoch(tbin_utc) - epoch(lag(tbin_utc) OVER {W0})) / 60.0 AS gap FROM panel) WHERE gap > 0""")

KNN = LAST_ST + f""", pairs AS (SELECT a.station_id, b.station_id AS neighbor_id, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dist_km
  FROM st a JOIN st b ON a.station_id <> b.station_id),
 knn AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY dist_km, neighbor_id) AS rank FROM pairs QUALIFY rank <= 5)"""
sql("knn_map", KNN, f"SELECT station_id, rank, neighbor_id, {R('dist_km', 'dist_km')} FROM knn")

sql("neighbour_mean", KNN + """, m AS (SELECT k.station_id, p.tbin_utc, avg(p.bikes) AS m FROM knn k
  JOIN panel p ON p.station_id = k.neighbor_id GROUP BY 1, 2)""", f"""
SELECT p.station_id, {T('p.tbin_utc', 'tbin_utc')}, {R('a.m', 'knn_mean_bikes_lag1')}, {R('b.m', 'knn_mean_bikes_lag3')},
  {R('c.m', 'knn_mean_bikes_lag12')} FROM panel p
LEFT JOIN m a ON a.station_id = p.station_id AND a.tbin_utc = p.tbin_utc - INTERVAL '360 minutes'
LEFT JOIN m b ON b.station_id = p.station_id AND b.tbin_utc = p.tbin_utc - INTERVAL '1080 minutes'
LEFT JOIN m c ON c.station_id = p.station_id AND c.tbin_utc = p.tbin_utc - INTERVAL '4320 minutes'""")

sql("cluster_capacity_mean", LAST_ST, f"""
SELECT station_id, CAST(station_id AS BIGINT) % 4 AS cluster, {R('avg(capacity) OVER (PARTITION BY CAST(station_id AS BIGINT) % 4)', 'te_cap_mean')} FROM st""")

# ---- quality ---------------------------------------------------------------------------------------

NOW_S = "epoch(TIMESTAMP '2024-01-31 12:00:00')"
AGES = RAW + f", ages AS (SELECT station_id, ({NOW_S} - floor(epoch(max(ts_utc)))) / 60.0 AS age FROM raw GROUP BY 1)"
sql("feed_freshness", AGES, f"""
SELECT count(*) AS stations, {R('max(age)', 'max_min')}, {R('quantile_cont(age, 0.5)', 'p50_min')}, {R('quantile_cont(age, 0.95)', 'p95_min')},
  {R(f"({NOW_S} - (SELECT max(epoch(date_trunc('hour', ts))) FROM events)) / 60.0", 'weather_min')} FROM ages""")
sql("oldest_stations", AGES, f"SELECT station_id, {R('age', 'freshness_min')} FROM ages ORDER BY age DESC, station_id LIMIT 50")

FRESH = f"""{R('quantile_cont(age, 0.5)', 'freshness_age_p50_min')}, {R('quantile_cont(age, 0.95)', 'freshness_age_p95_min')},
  {R('5', 'freshness_slo_min')}, {I('quantile_cont(age, 0.95) <= 5', 'freshness_p95_ok')}
  FROM (SELECT (epoch(TIMESTAMP '2024-01-30 18:00:00') - epoch(last_bin)) / 60.0 AS age FROM st)"""
sql("panel_freshness", HEALTH, "SELECT " + FRESH)
sql("coverage_global", HEALTH, f"SELECT {R('avg(coverage_pct)', 'coverage_global_pct')} FROM cov")

PA = HEALTH + """, pa AS (SELECT *, CAST((epoch(last_bin) - epoch(first_bin)) / 21600 AS BIGINT) + 1 AS expected FROM st),
 pb AS (SELECT *, least(obs, expected) AS seen, least(obs, expected) / CAST(expected AS DOUBLE) * 100 AS pct FROM pa)"""
sql("coverage_active", PA, f"""
SELECT {R('avg(pct)', 'coverage_active_pct')}, 'plain' AS kind FROM pb UNION ALL
SELECT {R('avg(pct)', 'coverage_active_pct')}, 'active' FROM pb WHERE seen >= 0.5 * expected UNION ALL
SELECT {R('sum(pct * expected) / sum(expected)', 'coverage_active_pct')}, 'weighted' FROM pb""")

sql("coverage_by_hour", f"""h AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS station_id, date_trunc('hour', ts) AS t FROM events
  WHERE date_trunc('hour', ts) <= TIMESTAMP '2024-01-30 23:00:00' AND date_trunc('hour', ts) > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL '14 days'),
 l AS (SELECT station_id, {PARIS('t')} AS lt FROM h),
 c AS (SELECT station_id, hour(lt) AS hour, count(*) AS obs, count(DISTINCT CAST(lt AS DATE)) AS expd FROM l GROUP BY 1, 2)""", f"""
SELECT hour, {R('avg(least(obs, expd) / CAST(expd AS DOUBLE) * 100)', 'coverage_pct')} FROM c GROUP BY 1""")

NAMES = ", nm AS (SELECT station_id, arg_max(name, tbin_utc) FILTER (WHERE name IS NOT NULL) AS name FROM h GROUP BY 1)"
sql("station_health", HEALTH, f"""
SELECT station_id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.station_id = cov.station_id AND name IS NOT NULL) THEN 'Station ' || station_id END AS name,
  obs, expected, {R('coverage_pct', 'coverage_pct')}, missing FROM cov""")

sql("supplier_gaps", """p AS (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, date_trunc('day', l_shipdate) AS t FROM lineitem GROUP BY 1, 2),
 s AS (SELECT station_id, count(*) AS obs, date_diff('day', min(t), max(t)) + 1 AS expected FROM p GROUP BY 1)""", f"""
SELECT station_id, obs, expected, least(obs, expected) AS seen, {R('least(obs, expected) / CAST(expected AS DOUBLE) * 100', 'coverage_pct')} FROM s""")

LATENCY = f"{R('quantile_cont(l, 0.5)', 'latency_p50_min')}, {R('quantile_cont(l, 0.95)', 'latency_p95_min')}"
sql("ingest_latency", RAW, f"""
SELECT {LATENCY} FROM (SELECT (floor(epoch(ingested_at)) - floor(epoch(ts_utc))) / 60.0 AS l FROM raw) WHERE l BETWEEN 0 AND 360""")

sql("duplicates", RAW, "SELECT station_id, count(*) - count(DISTINCT tbin_utc) AS dups FROM raw GROUP BY 1")


def flat(source: str, min_steps: int) -> str:
    return f""", fl AS (SELECT station_id, tbin_utc, coalesce(bikes - lag(bikes) OVER {W0}, 0) = 0 AS flat FROM {source}),
 fg AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY tbin_utc ROWS UNBOUNDED PRECEDING) AS g FROM fl),
 flats AS (SELECT station_id, count(*) AS steps, min(tbin_utc) AS t0, max(tbin_utc) AS t1 FROM fg WHERE flat GROUP BY station_id, g
   HAVING count(*) >= {min_steps})"""


sql("flat_sequences", PANEL + flat("panel", 2), f"""
SELECT station_id, steps, {T('t0', 'start')}, {T('t1', '"end"')}, steps * 360 AS duration_min FROM flats""")

sql("panel_span", PANEL, f"""
SELECT count(*) AS rows, count(DISTINCT station_id) AS stations, {T('min(tbin_utc)', 'span_start')}, {T('max(tbin_utc)', 'span_end')} FROM panel""")

sql("worst_coverage", HEALTH + NAMES, f"""
SELECT station_id, {R('coverage_pct', 'coverage_pct')}, missing FROM cov LEFT JOIN nm USING (station_id)
WHERE station_id LIKE '%1%' OR lower(name) LIKE '%1%' ORDER BY cov.coverage_pct, station_id LIMIT 50""")

# ---- network ------------------------------------------------------------------------------------------

TENS = f"{R('avg(CASE WHEN bikes = 0 THEN 1.0 ELSE 0.0 END)', 'penury_rate')}, {R('avg(CASE WHEN capacity - bikes <= 0 THEN 1.0 ELSE 0.0 END)', 'saturation_rate')}"
sql("station_tension_rates", PANEL, f"SELECT station_id, {TENS} FROM panel GROUP BY 1")

RECENT7 = PANEL + f", rec AS (SELECT * FROM panel WHERE {PARIS('tbin_utc')} >= (SELECT max({PARIS('tbin_utc')}) FROM panel) - INTERVAL '7 days')"
RT = RECENT7 + """, t AS (SELECT station_id, avg(CASE WHEN bikes = 0 THEN 1.0 ELSE 0.0 END) AS p,
  avg(CASE WHEN capacity - bikes <= 0 THEN 1.0 ELSE 0.0 END) AS s FROM rec GROUP BY 1)"""
sql("recent_tension_rates", RT, f"""
SELECT * FROM (SELECT 'penury' AS kind, station_id, {R('p * 100', 'pct')} FROM t ORDER BY p DESC, station_id LIMIT 20) UNION ALL
SELECT * FROM (SELECT 'saturation', station_id, {R('s * 100', 'pct')} FROM t ORDER BY s DESC, station_id LIMIT 20)""")

SNAP = PANEL + ", snap AS (SELECT * FROM panel WHERE tbin_utc = (SELECT max(tbin_utc) FROM panel))"


def pct(cond: str, name: str) -> str:
    return R(f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) * 100", name)


sql("snapshot_kpis", SNAP, f"""
SELECT (SELECT count(DISTINCT station_id) FROM panel) AS stations_universe, {T('max(tbin_utc)', 'snapshot_ts_utc')},
  {T(PARIS('max(tbin_utc)'), 'snapshot_ts_local')}, count(DISTINCT station_id) AS stations_active,
  {pct('bikes > 0', 'availability_bike_pct')}, {pct('docks > 0', 'availability_dock_pct')}, {pct('bikes = 0', 'penury_pct')},
  {pct('docks = 0', 'saturation_pct')}, (SELECT count(DISTINCT station_id) FROM panel) - count(DISTINCT station_id) AS stations_offline FROM snap""")

sql("snapshot_distribution", SNAP + """, c AS (SELECT count(DISTINCT station_id) AS total_active, count(*) FILTER (WHERE bikes > 0) AS bike_avail,
  count(*) FILTER (WHERE docks > 0) AS dock_avail, count(*) FILTER (WHERE bikes = 0) AS penury, count(*) FILTER (WHERE docks = 0) AS saturation FROM snap),
 u AS (UNPIVOT c ON bike_avail, dock_avail, penury, saturation INTO NAME metric VALUE count)""", f"""
SELECT total_active, metric, count, {R('count / CAST(total_active AS DOUBLE) * 100', 'pct')} FROM u""")

sql("snapshot_map", SNAP, f"""
SELECT station_id, coalesce(name, station_id) AS name, {R('lat', 'lat')}, {R('lon', 'lon')}, {I('bikes', 'bikes')}, {I('docks', 'docks_avail')},
  {I('bikes = 0', 'is_penury')}, {I('docks = 0', 'is_saturation')} FROM snap""")

sql("offline_stations", SNAP, "SELECT DISTINCT station_id FROM panel WHERE station_id NOT IN (SELECT station_id FROM snap)")

LATEST = PANEL + ", latest AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY tbin_utc DESC) = 1)"
sql("availability_view", LATEST, f"""
SELECT station_id, name, {R('lat', 'lat')}, {R('lon', 'lon')}, {I('capacity', 'capacity')}, {I('bikes', 'num_bikes_available')},
  {I('docks', 'num_docks_available')} FROM latest""")

sql("presence_coverage", RECENT7, f"""
SELECT {R("avg(n / (SELECT CAST(count(DISTINCT tbin_utc) AS DOUBLE) FROM rec)) * 100", 'coverage_pct')}
FROM (SELECT count(*) AS n FROM rec GROUP BY station_id)""")

sql("volatility_today", PANEL, f"""
SELECT {R('coalesce(quantile_cont(sd, 0.5), 0)', 'volatility_today')} FROM (SELECT stddev_pop(bikes) AS sd FROM panel
  WHERE CAST({PARIS('tbin_utc')} AS DATE) = (SELECT max(CAST({PARIS('tbin_utc')} AS DATE)) FROM panel) GROUP BY station_id)""")

sql("availability_curve", PANEL, f"""
SELECT {T('tbin_utc', 'tbin_utc')}, strftime(panel.tbin_utc, '%H:%M') AS hhmm, {pct('bikes > 0', 'pct')} FROM panel
WHERE CAST(panel.tbin_utc AS DATE) = DATE '2024-01-24' GROUP BY panel.tbin_utc""")

sql("reference_curve", PANEL + """, c AS (SELECT tbin_utc, avg(CASE WHEN bikes > 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct FROM panel
  WHERE CAST(tbin_utc AS DATE) < DATE '2024-01-24' AND CAST(tbin_utc AS DATE) >= DATE '2024-01-24' - 28
   AND isodow(tbin_utc) = isodow(DATE '2024-01-24') GROUP BY 1),
 g AS (SELECT strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(i * 360 AS BIGINT)), '%H:%M') AS hhmm FROM range(4) r(i))""", f"""
SELECT g.hhmm, {R('quantile_cont(pct, 0.5)', 'pct_median')} FROM g LEFT JOIN c ON strftime(c.tbin_utc, '%H:%M') = g.hhmm GROUP BY 1""")

sql("kpis_vs_lags", PANEL + ", l(lag_days) AS (VALUES (0), (7), (14), (21))", f"""
SELECT lag_days, {D("DATE '2024-01-24' - lag_days", '"date"')},
  {R('avg(CASE WHEN bikes > 0 THEN 1.0 WHEN bikes IS NOT NULL THEN 0.0 END) * 100', 'avail_bike')},
  {R('avg(CASE WHEN docks > 0 THEN 1.0 WHEN docks IS NOT NULL THEN 0.0 END) * 100', 'avail_dock')},
  {R('avg(CASE WHEN bikes = 0 THEN 1.0 WHEN bikes IS NOT NULL THEN 0.0 END) * 100', 'pen')},
  {R('avg(CASE WHEN docks = 0 THEN 1.0 WHEN docks IS NOT NULL THEN 0.0 END) * 100', 'sat')}
FROM l LEFT JOIN panel ON CAST(tbin_utc AS DATE) = DATE '2024-01-24' - lag_days GROUP BY lag_days""")

sql("capacity_estimate", PANEL, f"""
SELECT station_id, {R("CASE WHEN CAST(station_id AS BIGINT) % 3 <> 0 THEN max(capacity) ELSE quantile_cont(bikes, 0.98) END", 'cap_est')}
FROM panel GROUP BY station_id""")

sql("exclusive_states", MASKS, f"""
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {R('occ', 'occ')}, {I('valid', 'valid')}, {I('is_pen', 'is_pen')}, {I('is_sat', 'is_sat')} FROM masked""")

CELLS = MASKS + f", cells AS (SELECT isodow({LOC}) - 1 AS dow, hour({LOC}) AS hour, occ, is_pen, is_sat, valid FROM masked)"
sql("weekly_heatmap", CELLS, f"""
SELECT d.dow, h.hour, {R('avg(occ)', 'occ_mean')}, {R('avg(CASE WHEN is_pen THEN 1.0 WHEN NOT is_pen THEN 0.0 END)', 'penury_rate')},
  {R('avg(CASE WHEN is_sat THEN 1.0 WHEN NOT is_sat THEN 0.0 END)', 'saturation_rate')}, count(*) FILTER (WHERE valid) AS n_obs
FROM range(7) d(dow) CROSS JOIN range(24) h(hour) LEFT JOIN cells c ON c.dow = d.dow AND c.hour = h.hour GROUP BY 1, 2""")

sql("heatmap_matrix", CELLS, "SELECT d.dow, " + ", ".join(R(f"avg(occ) FILTER (WHERE hour = {h})", f"h{h:02d}") for h in range(24))
    + " FROM range(7) d(dow) LEFT JOIN cells c ON c.dow = d.dow GROUP BY 1")

sql("hourly_rates", CELLS, f"""
SELECT h.hour, {R('avg(CASE WHEN is_pen THEN 1.0 WHEN NOT is_pen THEN 0.0 END)', 'penury_rate')},
  {R('avg(CASE WHEN is_sat THEN 1.0 WHEN NOT is_sat THEN 0.0 END)', 'saturation_rate')}
FROM range(24) h(hour) LEFT JOIN cells c ON c.hour = h.hour GROUP BY 1""")

ZONED = masks_recent(10) + f""", z AS (SELECT *, {rnd('lat', 3)} || '|' || {rnd('lon', 3)} AS zone FROM masked),
 caps AS (SELECT zone, sum(cap_est) AS cap_sum FROM (SELECT DISTINCT station_id, zone, cap_est FROM z) GROUP BY 1)"""
sql("by_zone", ZONED, f"SELECT zone, {RATES}, {R('any_value(cap_sum)', 'cap_sum')} FROM z JOIN caps USING (zone) GROUP BY zone")

TIDX = """, ti AS (SELECT station_id, arg_max(name, tbin_utc) FILTER (WHERE name IS NOT NULL) AS name, max(lat) AS lat, max(lon) AS lon,
  avg(CASE WHEN is_pen THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN is_sat THEN 1.0 ELSE 0.0 END) AS s, avg(occ) AS o,
  count(*) FILTER (WHERE valid) AS n_obs FROM masked GROUP BY 1)"""
sql("tension_index", masks_recent(10) + TIDX, f"""
SELECT station_id, name, {R('lat', 'lat')}, {R('lon', 'lon')}, {R('p', 'penury_rate')}, {R('s', 'saturation_rate')}, {R('o', 'occ_mean')},
  {R('p + s', 'tension_index')}, n_obs FROM ti""")
sql("top_tension", MASKS + TIDX, f"""
SELECT station_id, {R('p + s', 'tension_index')} FROM ti WHERE station_id LIKE '%2%' OR lower(name) LIKE '%2%' ORDER BY p + s DESC, station_id LIMIT 200""")

sql("episodes", MASKS + f""", stp AS (SELECT quantile_cont(gap, 0.5) AS step FROM (
  SELECT (epoch(tbin_utc) - epoch(lag(tbin_utc) OVER {W0})) / 60.0 AS gap FROM panel) WHERE gap > 0),
 s AS (SELECT station_id, tbin_utc, CASE WHEN is_pen THEN 'penury' WHEN is_sat THEN 'saturation' ELSE 'none' END AS st FROM masked),
 g AS (SELECT *, row_number() OVER {W0} - row_number() OVER (PARTITION BY station_id, st ORDER BY tbin_utc) AS g FROM s),
 e AS (SELECT station_id, st, min(tbin_utc) AS t0, max(tbin_utc) AS t1, count(*) AS n FROM g WHERE st <> 'none' GROUP BY station_id, st, g)""", f"""
SELECT station_id, st AS type, {T('t0', 'start_utc')}, {T('t1', 'end_utc')}, n AS steps, {R('n * step', 'duration_min')} FROM e, stp
WHERE n >= greatest(1, round_even(720 / step, 0))""")

REG = RAW + f""", r AS (SELECT CAST(event_id % 3 AS VARCHAR) AS station_id, * EXCLUDE (station_id) FROM raw UNION ALL
    SELECT 'all', * EXCLUDE (station_id) FROM raw),
 b AS (SELECT station_id, bikes, capacity, {PARIS("date_trunc('hour', ts_utc)")} AS lt FROM r),
 c AS (SELECT *, CAST(lt AS DATE) AS day, strftime(lt, '%H:%M') AS hhmm, max(CAST(lt AS DATE)) OVER () AS today FROM b),
 k AS (SELECT * FROM c WHERE day = today OR (day < today AND isodow(day) = isodow(today))),
 cv AS (SELECT station_id, day, today, hhmm, avg(least(greatest(bikes / cap, 0), 1)) AS occ FROM (
   SELECT *, CAST(max(capacity) OVER (PARTITION BY station_id, day) AS DOUBLE) AS cap FROM k) GROUP BY ALL),
 ty AS (SELECT station_id, hhmm, quantile_cont(occ, 0.5) AS typ FROM cv WHERE day < today GROUP BY 1, 2),
 td AS (SELECT * FROM cv WHERE day = today)"""
sql("regularity", REG, f"""
SELECT td.station_id, {R('CASE WHEN count(typ) >= 8 AND min(occ) < max(occ) AND min(typ) < max(typ) THEN corr(occ, typ) END',
  'regularity_corr_today_vs_typical')} FROM td LEFT JOIN ty ON ty.station_id = td.station_id AND ty.hhmm = td.hhmm GROUP BY 1""")

PROF = PANEL + """, v AS (SELECT *, CASE WHEN occ_ratio BETWEEN 0 AND 1 THEN occ_ratio END AS o FROM panel),
 pr AS (SELECT station_id, count(o) AS bins_seen, arg_max(name, tbin_utc) FILTER (WHERE name IS NOT NULL) AS name, max(lat) AS lat, max(lon) AS lon,
   quantile_cont(capacity, 0.5) AS capacity_est, CASE WHEN count(o) > 1 THEN stddev_pop(o) END AS volatility,
   avg(is_penury) AS penury_rate, avg(is_saturation) AS saturation_rate,
   least(count(o) / (4.0 * (SELECT date_diff('day', min(tbin_utc), max(tbin_utc)) + 1 FROM panel)), 1) * 100 AS coverage_pct
   FROM v GROUP BY 1 HAVING count(o) >= 20)"""
sql("station_profile", PROF, f"""
SELECT station_id, bins_seen, name, {R('lat', 'lat')}, {R('lon', 'lon')}, {R('capacity_est', 'capacity_est')}, {R('volatility', 'volatility')},
  {R('penury_rate', 'penury_rate')}, {R('saturation_rate', 'saturation_rate')}, {R('coverage_pct', 'coverage_pct')} FROM pr""")
sql("station_profile_hours", PROF, f"""
SELECT pr.station_id, h.hour, {R('avg(o)', 'occ')} FROM pr CROSS JOIN range(24) h(hour)
LEFT JOIN v ON v.station_id = pr.station_id AND hour(v.tbin_utc) = h.hour GROUP BY 1, 2""")

sql("station_distributions", PROF + """, l AS (SELECT 'coverage_pct' AS metric, coverage_pct AS v FROM pr UNION ALL SELECT 'volatility', volatility FROM pr
  UNION ALL SELECT 'penury_pct', penury_rate * 100 FROM pr UNION ALL SELECT 'saturation_pct', saturation_rate * 100 FROM pr),
 s AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM l WHERE v IS NOT NULL GROUP BY 1)""", """
SELECT metric, CAST(least(coalesce(floor((v - lo) / nullif((hi - lo) / 20.0, 0)), 0), 19) AS BIGINT) AS bin, count(*) AS n
FROM l JOIN s USING (metric) WHERE v IS NOT NULL GROUP BY 1, 2""")

sql("forecast_map_view", PERF + """, latest AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY tbin_utc DESC) = 1),
 f AS (SELECT station_id, horizon_bins * 360 AS horizon_min, y_pred_int FROM perf WHERE y_true IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY station_id, horizon_bins ORDER BY tbin_utc DESC) = 1)""", f"""
SELECT station_id, {I('horizon_min', 'horizon_min')}, {I('bikes', 'num_bikes_available')}, {I('y_pred_int', 'bikes_pred_int')}, {R('bikes / CAST(capacity AS DOUBLE)', 'occ_now')},
  {R('y_pred_int / CAST(capacity AS DOUBLE)', 'occ_pred')} FROM latest LEFT JOIN f USING (station_id)""")

sql("forecast_lookup", PERF, f"""
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {I('y_pred_int', 'y_pred_int')} FROM perf WHERE horizon_bins = 2 AND CAST(station_id AS BIGINT) % 4 = 1""")

sql("latest_times", PERF, f"""
SELECT {T('max(tbin_target)', 'latest')}, 'target' AS kind FROM perf UNION ALL SELECT {T('max(tbin_utc)', 'latest')}, 'observed' FROM perf""")

sql("station_meta_view", LAST_ST, f"""
SELECT station_id, CAST(station_id AS BIGINT) % 4 AS cluster, 'Stop ' || station_id AS name, {R('lat', 'lat')}, {R('lon', 'lon')} FROM st
WHERE station_id <> '0'""")

# ---- evaluation -------------------------------------------------------------------------------------------

E_M, E_B = "CAST(y_true - y_pred_int AS DOUBLE)", "CAST(y_true - y_baseline_persist AS DOUBLE)"
METRICS = f"""{R(f'avg(abs({E_M}))', 'mae_model')}, {R(f'sqrt(avg({E_M} * {E_M}))', 'rmse_model')}, {R(f'avg({E_M})', 'me_model')},
  {R(f'avg(abs({E_B}))', 'mae_baseline')}, {R(f'sqrt(avg({E_B} * {E_B}))', 'rmse_baseline')}, {R(f'avg({E_B})', 'me_baseline')},
  {R('count(y_pred_int) * 100.0 / count(*)', 'coverage_pred_pct')}, count(*) AS n"""
LIFT = R(f"CASE WHEN avg(abs({E_B})) <> 0 THEN (avg(abs({E_B})) - avg(abs({E_M}))) / avg(abs({E_B})) END", "lift_vs_baseline")
CUTS = PERF + f""", cut AS (SELECT *, {D(LOC, 'date')}, hour({LOC}) AS hour, isodow({LOC}) - 1 AS dow,
  CAST(station_id AS BIGINT) % 4 AS cluster FROM perf)"""

sql("performance_global", PERF, f"""
SELECT {I('horizon_bins', 'horizon_bins')}, {METRICS}, {LIFT}, count(DISTINCT station_id) AS stations, {T('min(tbin_utc)', 'ts_min')},
  {T('max(tbin_utc)', 'ts_max')} FROM perf GROUP BY horizon_bins""")
for name, key in (("day", "date"), ("hour", "hour"), ("dow", "dow"), ("station", "station_id"), ("cluster", "cluster")):
    sql(f"performance_by_{name}", CUTS, f"SELECT {I('horizon_bins', 'horizon_bins')}, {key}, {METRICS}, {LIFT} FROM cut GROUP BY horizon_bins, {key}")

SHORT = f"{R(f'avg(abs({E_M}))', 'mae_model')}, {R(f'avg(abs({E_B}))', 'mae_baseline')}, {R(f'sqrt(avg({E_M} * {E_M}))', 'rmse_model')}, count(*) AS n"
sql("performance_cuts", CUTS, " UNION ALL ".join(
    f"SELECT {I('horizon_bins', 'horizon_bins')}, '{c}' AS cut, {k} AS key, {SHORT} FROM cut GROUP BY horizon_bins{g}" for c, k, g in (
        ("global", "CAST(NULL AS VARCHAR)", ""), ("date", "CAST(date AS VARCHAR)", ", date"), ("hour", "CAST(hour AS VARCHAR)", ", hour"),
        ("dow", "CAST(dow AS VARCHAR)", ", dow"), ("station_id", "station_id", ", station_id"))))

sql("lift_curve", CUTS, f"""
SELECT {I('horizon_bins', 'horizon_bins')}, date, {LIFT} FROM cut GROUP BY horizon_bins, date
QUALIFY row_number() OVER (PARTITION BY cut.horizon_bins ORDER BY date DESC) <= 10""")

EXTR = PERF + f""", ls AS (SELECT horizon_bins, station_id, CASE WHEN avg(abs({E_B})) <> 0 THEN (avg(abs({E_B})) - avg(abs({E_M}))) / avg(abs({E_B})) END AS l,
  count(*) AS n FROM perf GROUP BY 1, 2 HAVING count(*) >= 30)"""
sql("lift_extremes", EXTR, f"""
SELECT * FROM (SELECT 'top' AS side, {I('horizon_bins', 'horizon_bins')}, station_id, {R('l', 'lift_vs_baseline')}, n FROM ls
  QUALIFY row_number() OVER (PARTITION BY ls.horizon_bins ORDER BY l DESC NULLS LAST, station_id) <= 20) UNION ALL
SELECT * FROM (SELECT 'bottom', {I('horizon_bins', 'horizon_bins')}, station_id, {R('l', 'lift_vs_baseline')}, n FROM ls
  QUALIFY row_number() OVER (PARTITION BY ls.horizon_bins ORDER BY l ASC NULLS FIRST, station_id) <= 20)""")

sql("horizons_available", PERF, f"SELECT DISTINCT {I('horizon_bins', 'horizon_bins')} FROM perf WHERE horizon_bins IN (1, 2, 12)")


def hist(source: str, bins: int) -> str:
    return f""", q AS (SELECT horizon_bins, CASE WHEN quantile_cont(CAST(abs(resid) AS DOUBLE), 0.99) > 0 THEN quantile_cont(CAST(abs(resid) AS DOUBLE), 0.99) ELSE 1.0 END AS half
  FROM {source} GROUP BY 1),
 grid AS (SELECT horizon_bins, half, i AS bin, i * (half * 2 / {bins}.0) - half AS lo, (i + 1) * (half * 2 / {bins}.0) - half AS hi FROM q, range({bins}) r(i)),
 hist AS (SELECT g.horizon_bins, g.bin, any_value(g.lo) AS lo, any_value(g.hi) AS hi, count(u.resid) AS count FROM grid g
  LEFT JOIN {source} u ON u.horizon_bins = g.horizon_bins AND abs(u.resid) <= g.half AND (u.resid >= g.lo OR g.bin = 0) AND (u.resid < g.hi OR g.bin = {bins - 1})
  GROUP BY 1, 2)"""


HIST = f"SELECT {I('horizon_bins', 'horizon_bins')}, {I('bin', 'bin')}, {R('lo', 'bin_left')}, {R('hi', 'bin_right')}, {I('count', 'count')} FROM hist"
sql("residual_histogram", PERF + hist("used", 40), HIST)
sql("residual_histogram_float", PERF + hist("usedf", 60), HIST)

M_QQ = 512
PROBS = "[" + ", ".join(f"CAST({2 * i + 1} AS DOUBLE) / {2 * M_QQ}" for i in range(M_QQ)) + "]"
sql("qq_points", PERF + f""", q AS (SELECT horizon_bins, quantile_cont(CAST(resid AS DOUBLE), {PROBS}) AS qs, avg(resid) AS mu, stddev_pop(resid) AS sd FROM used GROUP BY 1),
 p AS (SELECT horizon_bins, i, (qs[i + 1] - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS emp,
   least(greatest((2 * i + 1) / {2 * M_QQ}.0 * 2 - 1, -0.999999), 0.999999) AS t FROM q, range({M_QQ}) r(i)),
 n AS (SELECT *, ln(1 - t * t) AS l, 2 / (pi() * 0.147) + ln(1 - t * t) / 2 AS inn FROM p)""", f"""
SELECT {I('horizon_bins', 'horizon_bins')}, {I('i', 'i')}, {R('sign(t) * sqrt(sqrt(inn * inn - l / 0.147) - inn)', 'theoretical')}, {R('emp', 'empirical')} FROM n""")

ACF = PERF + """, s AS (SELECT horizon_bins, tbin_utc, avg(resid) AS r FROM used GROUP BY 1, 2),
 x AS (SELECT horizon_bins, r - avg(r) OVER (PARTITION BY horizon_bins) AS x, row_number() OVER (PARTITION BY horizon_bins ORDER BY tbin_utc) - 1 AS i,
   count(*) OVER (PARTITION BY horizon_bins) AS n FROM s),
 d AS (SELECT horizon_bins, sum(x * x) AS d FROM x GROUP BY 1)"""


def acf(limit: str) -> str:
    return f"""SELECT {I('d.horizon_bins', 'horizon_bins')}, {I('k', 'lag')},
  {R('CASE WHEN k = 0 THEN 1 ELSE coalesce(sum(a.x * b.x), 0) / any_value(d.d) END', 'acf')}
FROM d CROSS JOIN range(145) l(k) LEFT JOIN x a ON a.horizon_bins = d.horizon_bins AND a.i >= k {limit}
LEFT JOIN x b ON b.horizon_bins = a.horizon_bins AND b.i = a.i - k GROUP BY d.horizon_bins, k"""


sql("residual_acf", ACF, acf("AND a.i <= a.n - 1 - k"))
sql("residual_acf_standard", ACF, acf(""))


def qbins(source: str, v: str, q: int) -> str:
    probs = "[" + ", ".join(f"CAST({i} AS DOUBLE) / {q}" for i in range(q + 1)) + "]"
    return f""", qe AS (SELECT horizon_bins, list_sort(list_distinct(quantile_cont(CAST({v} AS DOUBLE), {probs}))) AS e FROM {source} GROUP BY 1),
 qb AS (SELECT u.*, greatest(len(list_filter(e, lambda t: t < {v})) - 1, 0) AS bin FROM {source} u JOIN qe USING (horizon_bins) WHERE len(e) > 1)"""


sql("heteroscedasticity", PERF + qbins("used", "y_true", 20), f"""
SELECT {I('horizon_bins', 'horizon_bins')}, {I('bin', 'bin')}, {R('avg(abs(resid))', 'mae')}, count(*) AS n FROM qb GROUP BY horizon_bins, bin""")

RUNS = PERF + """, f AS (SELECT station_id, horizon_bins, tbin_utc, abs(resid) >= 4 AS big FROM used),
 g AS (SELECT *, row_number() OVER (PARTITION BY station_id, horizon_bins ORDER BY tbin_utc)
   - row_number() OVER (PARTITION BY station_id, horizon_bins, big ORDER BY tbin_utc) AS g FROM f),
 r AS (SELECT station_id, horizon_bins, big, count(*) AS n FROM g GROUP BY station_id, horizon_bins, big, g),
 m AS (SELECT station_id, horizon_bins, max(n) FILTER (WHERE big) AS max_run, sum(n) AS n FROM r GROUP BY 1, 2),
 top AS (SELECT * FROM m WHERE max_run > 0)"""
sql("max_error_run", RUNS, f"SELECT station_id, {I('horizon_bins', 'horizon_bins')}, {I('max_run', 'max_run')}, {I('n', 'n')} FROM top")
sql("error_run_map", RUNS + """, per AS (SELECT station_id, max(max_run) AS max_run, sum(n) AS n FROM top GROUP BY 1 HAVING sum(n) >= 30),
 med AS (SELECT list_sort(list(max_run))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS m FROM per),
 st AS (SELECT station_id, max(lat) AS lat, max(lon) AS lon FROM panel GROUP BY 1)""", f"""
SELECT station_id, {I('max_run', 'max_run')}, {I('n', 'n')}, station_id AS name, {R('lat', 'lat')}, {R('lon', 'lon')}, {I('max_run >= m', 'above_median')}
FROM per JOIN st USING (station_id), med""")

FIT = f"{R('regr_intercept(y_true, y_pred_int)', 'alpha')}, {R('regr_slope(y_true, y_pred_int)', 'beta')}, count(*) AS n"
sql("calibration_fit", PERF, f"SELECT {I('horizon_bins', 'horizon_bins')}, {FIT} FROM used GROUP BY horizon_bins")
sql("calibration_by_hour", PERF, f"SELECT {I('horizon_bins', 'horizon_bins')}, hour({LOC}) AS hour, {FIT} FROM used GROUP BY horizon_bins, 2")

sql("calibration_bins", PERF + ", pu AS (SELECT * FROM perf WHERE y_pred IS NOT NULL)" + qbins("pu", "y_pred", 20), f"""
SELECT {I('horizon_bins', 'horizon_bins')}, {I('bin', 'bin')}, {R('avg(y_pred)', 'y_pred_mean')}, {R('avg(y_true)', 'y_true_mean')}, count(*) AS n
FROM qb GROUP BY horizon_bins, bin""")

sql("relative_error_levels", PERF + qbins("used", "y_true", 3), f"""
SELECT {I('horizon_bins', 'horizon_bins')}, {I('bin', 'level')}, {R('avg(abs(resid) / greatest(1.0, CAST(y_true AS DOUBLE)))', 'mape_like')}, count(*) AS n
FROM qb GROUP BY horizon_bins, bin""")

BIAS = PERF + """, bs AS (SELECT horizon_bins, station_id, avg(y_true - y_pred_int) AS bias, count(*) AS n, max(lat) AS lat, max(lon) AS lon,
  arg_max(name, tbin_utc) FILTER (WHERE name IS NOT NULL) AS name FROM perf WHERE y_pred_int IS NOT NULL GROUP BY 1, 2)"""
sql("bias_by_station", BIAS, f"SELECT {I('horizon_bins', 'horizon_bins')}, station_id, {R('bias', 'bias')}, n, {R('lat', 'lat')}, {R('lon', 'lon')}, name FROM bs")
sql("top_bias", BIAS, f"""
SELECT {I('horizon_bins', 'horizon_bins')}, station_id, {R('abs(coalesce(bias, 0))', 'abs_bias')}, n FROM bs WHERE n >= 30
QUALIFY row_number() OVER (PARTITION BY bs.horizon_bins ORDER BY abs(coalesce(bias, 0)) DESC, station_id) <= 160""")

COVER = PERF + f""", hr AS (SELECT *, hour({LOC}) AS hr FROM used),
 q AS (SELECT horizon_bins, hr, quantile_cont(CAST(resid AS DOUBLE), (1.0 - 0.9) / 2) AS lo, quantile_cont(CAST(resid AS DOUBLE), 1 - (1.0 - 0.9) / 2) AS hi FROM hr GROUP BY 1, 2)"""
sql("interval_coverage", COVER, f"""
SELECT {I('horizon_bins', 'horizon_bins')}, {R('avg(CASE WHEN y_true BETWEEN y_pred_int + lo AND y_pred_int + hi THEN 1.0 ELSE 0.0 END)', 'empirical')},
  count(*) AS n, 'residual_quantiles/by_hour' AS method, 0.9 AS nominal FROM hr JOIN q USING (horizon_bins, hr) GROUP BY horizon_bins""")

Z92 = "(1.64485 + (0.92 - 0.90) / (0.95 - 0.90) * (1.95996 - 1.64485))"
sql("interval_coverage_bands", COVER, f"""
SELECT {I('horizon_bins', 'horizon_bins')}, {R('avg(CASE WHEN abs(resid) <= 5 THEN 1.0 ELSE 0.0 END)', 'empirical')}, count(*) AS n, 'provided_bands' AS method, 0.9 AS nominal
FROM used GROUP BY horizon_bins UNION ALL
SELECT {I('horizon_bins', 'horizon_bins')}, {R(f'avg(CASE WHEN abs(resid) <= 4 * {Z92} THEN 1.0 ELSE 0.0 END)', 'empirical')}, count(*) AS n, 'parametric_sigma', 0.92
FROM used GROUP BY horizon_bins UNION ALL
SELECT {I('horizon_bins', 'horizon_bins')}, {R('avg(CASE WHEN y_true BETWEEN y_pred_int + lo AND y_pred_int + hi THEN 1.0 ELSE 0.0 END)', 'empirical')},
  count(*) AS n, 'residual_quantiles/by_hour', 0.9 FROM hr JOIN q USING (horizon_bins, hr) GROUP BY horizon_bins""")

sql("station_timeseries", PERF + """, win AS (SELECT * FROM perf WHERE tbin_utc < (SELECT date_trunc('hour', max(tbin_utc)) FROM perf)
   AND tbin_utc >= (SELECT date_trunc('hour', max(tbin_utc)) FROM perf) - INTERVAL '240 hours'),
 c AS (SELECT horizon_bins, station_id, count(*) AS k FROM win GROUP BY 1, 2),
 pick AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY horizon_bins
   ORDER BY CASE WHEN k >= 12 THEN 1 ELSE 0 END DESC, CASE WHEN k >= 12 THEN 0 ELSE k END DESC, station_id) = 1)""", f"""
SELECT {I('horizon_bins', 'horizon_bins')}, station_id, {T('tbin_utc', 'tbin_utc')}, {I('y_true', 'y_true')}, {I('y_pred_int', 'y_pred')},
  {I('y_baseline_persist', 'y_base')} FROM win JOIN pick USING (horizon_bins, station_id)""")

sql("importance_share", "p AS (SELECT CAST(l_suppkey AS VARCHAR) AS feature, sum(l_quantity) AS importance FROM lineitem GROUP BY 1)", f"""
SELECT feature, {R('importance', 'importance')}, {R('importance / (SELECT sum(importance) FROM p) * 100', 'share')},
  {R('sum(importance / (SELECT sum(importance) FROM p) * 100) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING)', 'cum')} FROM p""")

sql("exact_quantiles", "q AS (SELECT l_linestatus, quantile_cont(l_extendedprice, [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]) AS v FROM lineitem GROUP BY 1)", f"""
SELECT l_linestatus, {I('i', 'i')}, {R('v[i + 1]', 'value')} FROM q, range(7) r(i)""")

# ---- drift ------------------------------------------------------------------------------------------------

FEATS = ("bikes", "capacity", "is_penury", "is_saturation", "mechanical", "occ_ratio")
WINS = PANEL + f""", tm AS (SELECT max(tbin_utc) AS tmax FROM panel),
 ev AS (SELECT panel.*, bikes // 2 AS mechanical, CASE WHEN tbin_utc >= tmax - INTERVAL '10 days' THEN 'cur' ELSE 'ref' END AS win,
   CAST({LOC} AS DATE) AS d FROM panel, tm WHERE tbin_utc >= tmax - INTERVAL '25 days'),
 means AS (SELECT win, d, station_id, {", ".join(f"round(avg({f}), 12) AS {f}" for f in (*FEATS, "lat", "lon"))} FROM ev GROUP BY 1, 2, 3)"""


def metrics(source: str, key: str, bins: int = 20) -> str:
    """PSI, KS and deltas per `key` from long rows (key, win, v)."""
    p20 = "[" + ", ".join(f"CAST({i} AS DOUBLE) / {bins}" for i in range(bins + 1)) + "]"
    p200 = "[" + ", ".join(f"CAST({i} AS DOUBLE) / 200" for i in range(201)) + "]"

    def shares(tag: str) -> str:
        return f"""{tag}b AS (SELECT l.{key}, l.win, least(len(list_filter(e, lambda t: t <= v)) - 1, len(e) - 2) AS bin, count(*) AS c
   FROM {source} l JOIN {tag}e USING ({key}) WHERE v BETWEEN e[1] AND e[len(e)] AND len(e) > 1 GROUP BY 1, 2, 3),
 {tag}c AS (SELECT {key}, bin, coalesce(sum(c) FILTER (WHERE win = 'ref'), 0) AS a, coalesce(sum(c) FILTER (WHERE win = 'cur'), 0) AS b FROM {tag}b GROUP BY 1, 2),
 {tag}t AS (SELECT {key}, sum(a) AS ta, sum(b) AS tb FROM {tag}c GROUP BY 1)"""

    return f""", pe AS (SELECT {key}, list_sort(list_distinct(list_transform(quantile_cont(v, {p20}), lambda q: round(q, 12)))) AS e FROM {source} WHERE win = 'ref' GROUP BY 1),
 ke AS (SELECT {key}, list_sort(list_distinct(list_transform(quantile_cont(v, {p200}), lambda q: round(q, 12)))) AS e FROM {source} GROUP BY 1),
 {shares('p')}, {shares('k')},
 pv AS (SELECT {key}, sum((a / ta + 1e-9 - (b / tb + 1e-9)) * ln((a / ta + 1e-9) / (b / tb + 1e-9))) AS psi FROM pc JOIN pt USING ({key}) WHERE ta > 0 AND tb > 0 GROUP BY 1),
 kc2 AS (SELECT {key}, abs(sum(a) OVER w / ta - sum(b) OVER w / tb) AS g FROM kc JOIN kt USING ({key}) WHERE ta > 0 AND tb > 0
   WINDOW w AS (PARTITION BY {key} ORDER BY bin ROWS UNBOUNDED PRECEDING)),
 kv AS (SELECT {key}, max(g) AS ks FROM kc2 GROUP BY 1),
 sv AS (SELECT {key}, count(*) FILTER (WHERE win = 'ref') AS n_ref, count(*) FILTER (WHERE win = 'cur') AS n_cur,
   min(v) FILTER (WHERE win = 'ref') AS lr, max(v) FILTER (WHERE win = 'ref') AS hr, min(v) FILTER (WHERE win = 'cur') AS lc, max(v) FILTER (WHERE win = 'cur') AS hc,
   avg(v) FILTER (WHERE win = 'ref') AS mr, avg(v) FILTER (WHERE win = 'cur') AS mc,
   var_samp(v) FILTER (WHERE win = 'ref') AS vr, var_samp(v) FILTER (WHERE win = 'cur') AS vc FROM {source} GROUP BY 1),
 dm AS (SELECT {key}, n_ref, n_cur, CASE WHEN lr < hr AND lc < hc AND len(pe.e) >= 3 THEN psi END AS psi,
   CASE WHEN least(lr, lc) < greatest(hr, hc) AND len(ke.e) >= 3 THEN ks END AS ks,
   CASE WHEN vr > 0 THEN (mc - mr) / (sqrt(vr) + 1e-9) END AS delta_mean, CASE WHEN vr > 0 THEN (vc - vr) / (vr + 1e-9) END AS delta_var
   FROM sv LEFT JOIN pe USING ({key}) LEFT JOIN ke USING ({key}) LEFT JOIN pv USING ({key}) LEFT JOIN kv USING ({key}) WHERE n_ref >= 5 AND n_cur >= 5)"""


LONG = WINS + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, win, CAST({f} AS DOUBLE) AS v FROM means WHERE {f} IS NOT NULL" for f in FEATS) + ")"
DM = LONG + metrics("long", "feature")

sql("drift_bounds", PANEL, f"""
SELECT {T('max(tbin_utc)', 'tmax')}, {T("max(tbin_utc) - INTERVAL '10 days'", 'cur_start')}, {T("max(tbin_utc) - INTERVAL '25 days'", 'ref_start')},
  {T("max(tbin_utc) - INTERVAL '10 days'", 'ref_end')} FROM panel""")
sql("daily_feature_means", WINS, f"SELECT win, {D('d', 'date_local')}, station_id, " + ", ".join(R(f, f) for f in (*FEATS, "lat", "lon")) + " FROM means")
sql("drift_metrics", DM, f"""
SELECT feature, n_ref, n_cur, {R('psi', 'psi')}, {R('ks', 'ks')}, {R('delta_mean', 'delta_mean')}, {R('delta_var', 'delta_var')} FROM dm""")
sql("drift_by_zone", WINS + f""", zl AS (SELECT {rnd('lat', 2)} || ',' || {rnd('lon', 2)} AS zone, win, occ_ratio AS v, lat, lon FROM means WHERE occ_ratio IS NOT NULL)"""
    + metrics("zl", "zone") + ", zp AS (SELECT zone, quantile_cont(lat, 0.5) AS lat, quantile_cont(lon, 0.5) AS lon FROM zl WHERE win = 'ref' GROUP BY 1)", f"""
SELECT zone, {R('psi', 'psi')}, {R('lat', 'lat')}, {R('lon', 'lon')} FROM dm LEFT JOIN zp USING (zone)""")
sql("drift_summary", DM + ", s AS (SELECT max(psi) FILTER (WHERE feature = 'occ_ratio') AS g, arg_max(feature, psi) AS f, max(psi) AS p FROM dm)", f"""
SELECT {R('g', 'psi_global')}, f AS top_feature, {R('p', 'top_feature_psi')}, CASE WHEN g >= 0.25 THEN 'high' WHEN g >= 0.10 THEN 'medium' END AS alert_level,
  'psi_global_' || CASE WHEN g >= 0.25 THEN 'high' WHEN g >= 0.10 THEN 'medium' END AS alert_code FROM s""")
sql("drift_table", DM, f"""
SELECT feature, {R('psi', 'psi')}, {R('ks', 'ks')} FROM dm WHERE (psi IS NOT NULL OR ks IS NOT NULL) AND coalesce(psi >= 0, true)
ORDER BY dm.psi DESC NULLS LAST, feature LIMIT 15""")

sql("occupancy_ema", "RECURSIVE " + PANEL + f""", dd AS (SELECT CAST({LOC} AS DATE) AS d, avg(occ_ratio) AS x FROM panel GROUP BY 1),
 n AS (SELECT *, row_number() OVER (ORDER BY d) AS i FROM dd),
 r AS (SELECT i, d, x AS e FROM n WHERE i = 1 UNION ALL SELECT n.i, n.d, 0.25 * n.x + 0.75 * r.e FROM r JOIN n ON n.i = r.i + 1)""", f"""
SELECT {D('d', 'date_local')}, {R('e', 'occ_ratio_ema')} FROM r""")

QD = """p AS (SELECT l_returnflag || l_linestatus AS station_id, date_trunc('day', l_shipdate) AS t, CAST(sum(l_quantity) AS INTEGER) AS bikes,
   CAST(count(*) AS INTEGER) AS capacity FROM lineitem GROUP BY 1, 2), m AS (SELECT max(t) AS tmax FROM p),
 w AS (SELECT p.*, CASE WHEN t >= tmax - INTERVAL '365 days' THEN 'cur' ELSE 'ref' END AS win FROM p, m WHERE t >= tmax - INTERVAL '1095 days'),
 long AS (SELECT 'bikes' AS feature, win, CAST(bikes AS DOUBLE) AS v FROM w UNION ALL SELECT 'capacity', win, CAST(capacity AS DOUBLE) FROM w)"""
sql("quantity_drift", QD + metrics("long", "feature"), f"""
SELECT feature, n_ref, n_cur, {R('psi', 'psi')}, {R('ks', 'ks')}, {R('delta_mean', 'delta_mean')}, {R('delta_var', 'delta_var')} FROM dm""")

# ---- composed quality reports -----------------------------------------------------------------------------

ANOM = HEALTH + flat("hd", 2).replace(", fl AS", ", hd AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY station_id, tbin_utc ORDER BY ts_utc DESC, event_id DESC) = 1), fl AS") + """,
 an AS (SELECT * FROM (SELECT 'flat_sequence' AS type, station_id, steps, NULL AS dups, NULL AS missing, NULL AS expected FROM flats
     ORDER BY steps DESC, station_id, t0 LIMIT 100) UNION ALL
   SELECT * FROM (SELECT 'duplicates', station_id, NULL, nrows - obs, NULL, NULL FROM st WHERE nrows > obs ORDER BY nrows - obs DESC, station_id LIMIT 100) UNION ALL
   SELECT * FROM (SELECT 'missing_bins', station_id, NULL, NULL, missing, expected FROM cov WHERE missing > 0 ORDER BY missing DESC, station_id LIMIT 100))"""
sql("anomalies", ANOM, f"SELECT type, station_id, {I('steps', 'steps')}, {I('dups', 'dups')}, {I('missing', 'missing')}, {I('expected', 'expected')} FROM an")
sql("anomaly_counts", ANOM, """
SELECT 'flat_sequence' AS type, count(*) AS n FROM flats HAVING count(*) > 0 UNION ALL
SELECT 'duplicates', count(*) FROM st WHERE nrows > obs HAVING count(*) > 0 UNION ALL
SELECT 'missing_bins', count(*) FROM cov WHERE missing > 0 HAVING count(*) > 0""")

KPIS = PA + flat("hd", 6).replace(", fl AS", ", hd AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY station_id, tbin_utc ORDER BY ts_utc DESC, event_id DESC) = 1), fl AS") + """,
 fr AS (SELECT (epoch(TIMESTAMP '2024-01-30 18:00:00') - epoch(last_bin)) / 60.0 AS age FROM st),
 la AS (SELECT (floor(epoch(ingested_at)) - floor(epoch(tbin_utc))) / 60.0 AS l FROM h),
 k AS (SELECT (SELECT count(*) FROM h) AS nrows, (SELECT count(*) FROM st) AS stations, (SELECT min(tbin_utc) FROM h) AS t0, (SELECT max(tbin_utc) FROM h) AS t1,
   (SELECT quantile_cont(age, 0.5) FROM fr) AS f50, (SELECT quantile_cont(age, 0.95) FROM fr) AS f95, (SELECT avg(coverage_pct) FROM cov) AS cg,
   (SELECT count(*) FROM cov WHERE missing > 0) AS ms, (SELECT avg(pct) FROM pb) AS ca,
   (SELECT quantile_cont(l, 0.5) FROM la WHERE l BETWEEN 0 AND 4320) AS l50, (SELECT quantile_cont(l, 0.95) FROM la WHERE l BETWEEN 0 AND 4320) AS l95,
   (SELECT sum(nrows - obs) / CAST(sum(nrows) AS DOUBLE) * 100 FROM st) AS dp, (SELECT count(*) FROM flats) AS fs)"""
sql("health_kpis", KPIS, f"""
SELECT nrows AS rows, stations, {T('t0', 'span_start')}, {T('t1', 'span_end')}, {R('f50', 'freshness_age_p50_min')}, {R('f95', 'freshness_age_p95_min')},
  {R('5', 'freshness_slo_min')}, {I('f95 <= 5', 'freshness_p95_ok')}, {R('cg', 'coverage_global_pct')}, ms AS missing_stations,
  {R('ca', 'coverage_active_pct')}, {R('l50', 'latency_p50_min')}, {R('l95', 'latency_p95_min')}, {R('dp', 'dups_pct')}, fs AS flat_sequences FROM k""")
sql("health_alerts", KPIS, f"""
SELECT {I('f95 <= 5', 'freshness_p95_ok')}, {I('coalesce(cg >= 98, false)', 'coverage_ok')}, {I('coalesce(dp >= 1, false)', 'duplication_alert')},
  {I('fs > 0', 'flat_sequences_found')} FROM k""")

# ---- feeds and tables ---------------------------------------------------------------------------------------

sql("gbfs_feed", LAST_ST, f"""
SELECT station_id, {I('raw.bikes', 'bikes')}, {I('st.capacity', 'capacity')}, {I('raw.bikes // 2', 'mechanical')},
  {I('CASE WHEN event_id % 2 = 0 THEN raw.bikes - raw.bikes // 2 ELSE 0 END', 'ebike')},
  CASE WHEN event_id % 2 = 1 THEN 'OK' ELSE 'CLOSED' END AS status, 'Stop ' || station_id AS name,
  '2024-01-31 12:00:00' AS tbin_utc, {T('ts_utc', 'src_ts_utc')} FROM raw JOIN st USING (station_id)""")

sql("weather_feed", PANEL + WEATHER, f"""
SELECT {T('hour_utc', 'hour_utc')}, {R('temp_c', '"temp_C"')}, {R('precip_mm', 'precip_mm')}, {R('wind_mps', 'wind_mps')} FROM w
WHERE w.hour_utc BETWEEN TIMESTAMP '2024-01-09 21:00:00' AND TIMESTAMP '2024-01-20 03:00:00'""")

sql("json_records", RAW, f"""
SELECT station_id, 15 AS horizon_min, count(*) AS n, {I('sum(bikes) FILTER (WHERE event_id % 4 <> 0)', 'bikes')} FROM raw GROUP BY 1""")

sql("pruned_scan", RAW, f"""
SELECT station_id, count(*) AS n, {I('sum(bikes)', 'bikes')} FROM raw
WHERE tbin_utc >= TIMESTAMP '2024-01-10 06:00:00' AND tbin_utc < TIMESTAMP '2024-01-12 18:00:00' GROUP BY 1""")

IN_DAY = "CAST(panel.tbin_utc AS DATE) = DATE '2024-01-24'"
sql("daily_compaction", PANEL, f"SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {T('ts_utc', 'ts_utc')}, status FROM panel WHERE {IN_DAY}")
sql("stream_compaction", PANEL, f"SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {T('ts_utc', 'ts_utc')}, status FROM panel")
sql("monthly_compaction", PANEL, """
SELECT '2024-01' AS month, count(*) AS rows, count(DISTINCT station_id) AS stations FROM panel WHERE strftime(tbin_utc, '%Y-%m') = '2024-01'""")
sql("training_base", PANEL, f"SELECT station_id, count(*) AS n, {T('max(tbin_utc)', 'last_bin')}, 0 AS n_temp FROM panel GROUP BY 1")
sql("date_range_scan", PANEL + ", d AS (SELECT CAST(tbin_utc AS DATE) AS d FROM panel)", """
SELECT count(*) AS n, count(DISTINCT d) AS days, 'range' AS scan FROM d WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' UNION ALL
SELECT count(*), count(DISTINCT d), 'latest' FROM d WHERE d = (SELECT max(d) FROM d)""")
sql("expired_partitions", PANEL + ", d AS (SELECT DISTINCT CAST(tbin_utc AS DATE) AS d FROM panel)", f"""
SELECT {D('d', 'date')}, 'day' AS kind FROM d WHERE d < DATE '2024-01-24' UNION ALL SELECT {D('d', 'date')}, 'later' FROM d WHERE d < DATE '2024-02-10'""")
sql("cluster_csv", "", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS station_id, user_id % 4 AS cluster FROM events")
sql("document_roundtrip", PANEL, f"""
SELECT station_id, {R('avg(CASE WHEN bikes = 0 THEN 1.0 ELSE 0.0 END)', 'penury_rate')},
  {R('nullif(avg(CASE WHEN capacity - bikes <= 0 THEN 1.0 ELSE 0.0 END), 0)', 'saturation_rate')} FROM panel GROUP BY 1""")
sql("manifest", PANEL, """
SELECT '2024-01-31T12:00:00Z' AS generated_at, 'rates' AS name, count(DISTINCT station_id) AS rows FROM panel UNION ALL
SELECT '2024-01-31T12:00:00Z', 'hourly', 24""")

# ---- streams: what the watermark (one hour behind the last event) has released ------------------------------

WM = ", wm AS (SELECT max(ts) - INTERVAL '1 hour' AS wm FROM events)"
SEEN = PANEL + WM + ", seen AS (SELECT panel.* FROM panel, wm WHERE tbin_utc + INTERVAL '360 minutes' <= wm)"
sql("stream_bronze", RAW, f"""
SELECT {D('tbin_utc', 'date')}, hour(tbin_utc) AS hour, count(*) AS n, {I('sum(bikes)', 'bikes')} FROM raw GROUP BY 1, 2""")
sql("stream_dedup", SEEN, f"SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {T('ts_utc', 'ts_utc')}, event_id, {I('bikes', 'bikes')} FROM seen")
sql("stream_rates", RAW + WM + ", t AS (SELECT date_trunc('day', ts_utc) AS d, bikes, capacity FROM raw)", f"""
SELECT {T('d', 'start_utc')}, {T("d + INTERVAL '1 day'", 'end_utc')}, count(*) AS n, {R('avg(CASE WHEN bikes > 0 THEN 1.0 ELSE 0.0 END)', 'availability_rate')},
  {R('avg(CASE WHEN bikes <= 2 THEN 1.0 ELSE 0.0 END)', 'penury_rate')}, {R('avg(CASE WHEN capacity - bikes <= 2 THEN 1.0 ELSE 0.0 END)', 'saturation_rate')}
FROM t, wm WHERE d + INTERVAL '1 day' <= wm GROUP BY d""")
sql("stream_rolling", RAW + WM + ", t AS (SELECT station_id, tbin_utc - to_minutes(k * 360) AS w, bikes FROM raw, range(4) r(k))", f"""
SELECT station_id, {T('w', 'start_utc')}, {T("w + INTERVAL '1 day'", 'end_utc')}, {R('avg(bikes)', 'bikes_mean')}, count(*) AS n
FROM t, wm WHERE w + INTERVAL '1 day' <= wm GROUP BY station_id, w""")
sql("stream_episodes", SEEN + f""", s AS (SELECT station_id, tbin_utc, max(tbin_utc) OVER (PARTITION BY station_id) AS last_bin,
   CASE WHEN capacity - bikes <= 2 THEN 'saturation' WHEN bikes <= 2 THEN 'penury' ELSE '' END AS st FROM seen),
 g AS (SELECT *, row_number() OVER {W0} - row_number() OVER (PARTITION BY station_id, st ORDER BY tbin_utc) AS g FROM s)""", f"""
SELECT station_id, st AS type, {T('min(tbin_utc)', 'start_utc')}, {T('max(tbin_utc)', 'end_utc')}, count(*) AS steps FROM g WHERE st <> ''
GROUP BY station_id, st, g HAVING count(*) >= 2 AND max(g.tbin_utc) < max(last_bin)""")
sql("stream_sessions", RAW + WM + """, e AS (SELECT station_id, ts_utc, ts_utc - lag(ts_utc) OVER (PARTITION BY station_id ORDER BY ts_utc) > INTERVAL '48 hours' AS brk FROM raw WHERE bikes <= 2),
 g AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY ts_utc ROWS UNBOUNDED PRECEDING) AS g FROM e),
 s AS (SELECT station_id, min(ts_utc) AS t0, max(ts_utc) + INTERVAL '48 hours' AS t1, count(*) AS steps FROM g GROUP BY station_id, g)""", f"""
SELECT station_id, {T('t0', 'start_utc')}, {T('t1', 'end_utc')}, steps FROM s, wm WHERE t1 <= wm""")
sql("stream_latest", RAW, f"""
SELECT station_id, {T('ts_utc', 'ts_utc')}, {I('bikes', 'bikes')}, status FROM raw
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY raw.ts_utc DESC, event_id DESC) = 1""")
sql("late_recompaction", PANEL, f"""SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {T('ts_utc', 'ts_utc')}, event_id FROM panel
WHERE CAST(panel.tbin_utc AS DATE) IN (SELECT CAST(tbin_utc AS DATE) FROM raw WHERE event_id % 7 = 0)""")
sql("stream_freshness", AGES, f"""
SELECT count(*) AS stations, {R('max(age)', 'max_min')}, {R('quantile_cont(age, 0.5)', 'p50_min')}, {R('quantile_cont(age, 0.95)', 'p95_min')} FROM ages""")

# ---- models, days, board ------------------------------------------------------------------------------------

sql("training_frame", KNN + f""", tr AS (SELECT * FROM panel WHERE tbin_utc >= TIMESTAMP '2024-01-01' AND tbin_utc <= TIMESTAMP '2024-01-27 18:00:00'),
 m AS (SELECT DISTINCT k.station_id, p.tbin_utc FROM knn k JOIN tr p ON p.station_id = k.neighbor_id),
 f AS (SELECT station_id, tbin_utc, lead(bikes) OVER {W0} AS y, lag(bikes) OVER {W0} AS l1,
   count(bikes) OVER (PARTITION BY station_id ORDER BY tbin_utc ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS c48 FROM tr)""", f"""
SELECT f.station_id, count(*) AS n, {R('avg(y)', 'y_mean')}, {R('avg(l1)', 'lag1_mean')}, count(m.tbin_utc) AS n_knn1,
  count(*) FILTER (WHERE c48 >= 24) AS n_std48
FROM f LEFT JOIN m ON m.station_id = f.station_id AND m.tbin_utc = f.tbin_utc - INTERVAL '360 minutes' WHERE y IS NOT NULL GROUP BY 1""")
sql("ensure_columns", PANEL, f"SELECT station_id, count(bikes) AS n, {R('count(*) * 1.5', 'humidity')} FROM panel GROUP BY 1")
sql("panel_apply", PANEL, f"SELECT station_id, count(*) AS n, {I('sum(bikes)', 'bikes')} FROM panel GROUP BY 1")

sql("temporal_split", PANEL + ", c AS (SELECT quantile_cont(epoch(tbin_utc), 0.9) AS cut FROM panel)", f"""
SELECT {I('epoch(tbin_utc) > cut', 'is_valid')}, count(*) AS n, {T('min(tbin_utc)', 'first_bin')}, {T('max(tbin_utc)', 'last_bin')} FROM panel, c GROUP BY 1""")
sql("lookback", PANEL + ", r AS (SELECT * FROM panel WHERE tbin_utc >= (SELECT date_trunc('day', max(tbin_utc) - INTERVAL '5 days') FROM panel))", f"""
SELECT count(*) AS rows, count(DISTINCT station_id) AS stations, {T('min(tbin_utc)', 'span_start')}, {T('max(tbin_utc)', 'span_end')} FROM r""")
sql("station_static", LAST_ST, f"""
SELECT station_id, {R(hav('lat', 'lon', '48.853', '2.349'), 'dist_center_km')}, {I('floor(lon / (300.0 / 75000.0))', 'grid_x')},
  {I('floor(lat / (300.0 / 111000.0))', 'grid_y')} FROM st""")
BASE = f"""WITH {PANEL}{WEATHER}, codes AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS status_code FROM (SELECT DISTINCT status FROM panel))
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {I('capacity', 'capacity')}, {R('lat', 'lat')}, {R('lon', 'lon')}, {R('occ_ratio', 'occ_ratio')},
  {I('status_code', 'status_code')}, {R(f'lag(temp_c) OVER {W0}', '"temp_C_lag1"')}, {R(f'lag(precip_mm) OVER {W0}', 'precip_mm_lag1')},
  {R(f'lag(wind_mps) OVER {W0}', 'wind_mps_lag1')} FROM wp LEFT JOIN codes USING (status)"""
ORACLES["feature_frame"] = f"SELECT * FROM ({BASE})" + "".join(
    f" JOIN ({ORACLES[part]}) USING (station_id, tbin_utc)"
    for part in ("lag_features", "rolling_features", "weather_join", "calendar_features", "neighbour_mean")
) + f" JOIN ({ORACLES['station_static']}) USING (station_id)"
sql("day_events", PANEL + ", codes AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS status_code FROM (SELECT DISTINCT status FROM panel))", f"""
SELECT station_id, {T('tbin_utc', 'tbin_utc')}, {I('bikes', 'bikes')}, {R('occ_ratio', 'occ_ratio')}, {I('is_penury', 'is_penury')},
  {I('is_saturation', 'is_saturation')}, {I('status_code', 'status_code')}, {I('hour(panel.tbin_utc)', 'h')}, {I('minute(panel.tbin_utc)', 'min')}
FROM panel JOIN codes USING (status) WHERE {IN_DAY}""")

BOARD = f"""psi AS (SELECT psi_global AS v FROM ({ORACLES['drift_summary']})), act AS (SELECT stations_active AS v FROM ({ORACLES['snapshot_kpis']})),
 met AS (SELECT weather_min AS v FROM ({ORACLES['feed_freshness']})),
 fc AS (WITH {PERF} SELECT horizon_bins * 360 AS h, count(*) AS n,
   greatest((epoch(TIMESTAMP '2024-01-31 12:00:00') - epoch(max(tbin_utc))) / 60.0, 0) AS age FROM perf WHERE y_pred_int IS NOT NULL GROUP BY 1),
 fl AS (SELECT *, CASE WHEN age <= 7 THEN 'ok' WHEN age <= 20 THEN 'warn' ELSE 'down' END AS led FROM fc)"""
sql("status_board", BOARD, f"""
SELECT 'api_stations' AS name, CASE WHEN v > 0 THEN 'ok' ELSE 'down' END AS led, {R('v', '"value"')}, CAST(NULL AS BIGINT) AS rows FROM act UNION ALL
SELECT 'weather_provider', CASE WHEN v <= 5 THEN 'ok' WHEN v <= 12 THEN 'warn' ELSE 'down' END, {R('v')}, NULL FROM met UNION ALL
SELECT 'data_drift', CASE WHEN v < 0.1 THEN 'ok' WHEN v < 0.2 THEN 'warn' ELSE 'down' END, {R('v')}, NULL FROM psi UNION ALL
SELECT * FROM (SELECT 'batch_forecast', led, {R('age')}, n FROM fl ORDER BY h LIMIT 1) UNION ALL
SELECT 'batch_forecast_h' || h, led, {R('age')}, n FROM fl""")
