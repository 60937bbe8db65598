"""SQL that gives the rows of the registered queries, written apart from the operators; one common chain of tables."""

from __future__ import annotations

from pulsegrid.operators.rules import DEFAULTS, DETECTION, SPARSE

AS_OF = "TIMESTAMP '2024-01-30 23:59:59'"
TODAY = "TIMESTAMP '2024-01-30 00:00:00'"
START = "TIMESTAMP '2024-01-17 00:00:00'"
LAB = ("Laboratorio", -33.437191, -70.656102, 150.0)

_RULES = ", ".join(f"CAST({float(v)!r} AS DOUBLE) AS {k}" for k, v in SPARSE.items())
_RULE_ROWS = ", ".join(f"('{k}', CAST({float(v)!r} AS DOUBLE), '{'DETECCION' if k in DETECTION else 'CLASIFICACION'}')" for k, v in DEFAULTS.items())


def _micro(ts: str) -> str:
    return f"epoch_us({ts})"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


TABLES: dict[str, str] = {
    "telemetry": """
        SELECT event_id AS id, user_id AS amid, ts AS fecha_hora,
            CASE WHEN event_type = 'view' THEN NULL ELSE greatest(0, CAST(floor(value) AS INTEGER) % 101 - 10) END AS porcentaje_bateria,
            CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN CAST(0 AS DOUBLE)
                ELSE CAST(-33.437191 AS DOUBLE) + (event_id % 7 - 3) * CAST(0.0005 AS DOUBLE) END AS latitud,
            CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN CAST(0 AS DOUBLE)
                ELSE CAST(-70.656102 AS DOUBLE) + (event_id % 5 - 2) * CAST(0.0005 AS DOUBLE) END AS longitud,
            event_type IN ('error', 'signup') AS is_error_obtener_gps,
            date_trunc('day', ts)::TIMESTAMP AS fec_descarga, ts AS fec_estado
        FROM events""",
    "flags": """
        SELECT *, latitud IS NOT NULL AND longitud IS NOT NULL AS reported,
            coalesce(latitud = 0 AND longitud = 0, false) AS zero,
            coalesce(NOT (latitud = 0 AND longitud = 0), false) AS valid
        FROM telemetry""",
    "components": """
        SELECT amid + 7499990 AS amid, fecha_hora, CASE WHEN id % 10 = 3 THEN 15 ELSE 16 END AS tabla, component FROM (
            SELECT *, unnest([
                '{"porcentajeBateria":' || CAST(porcentaje_bateria AS VARCHAR) || '}',
                '{"latitud":' || CAST(CAST(latitud AS DECIMAL(20,6)) AS VARCHAR) || '}',
                '{"longitud":' || CAST(CAST(longitud AS DECIMAL(20,6)) AS VARCHAR) || '}',
                '{"isErrorObtenerGps":' || CAST(is_error_obtener_gps AS VARCHAR) || '}',
                '{"tiempoVida":"' || strftime(fecha_hora, '%Y-%m-%dT%H:%M:%SZ') || '"}',
                '{"otraClave":1}']) AS component
            FROM telemetry) WHERE component IS NOT NULL""",
    "eav": """
        SELECT amid, fecha_hora, tabla, regexp_extract(component, '^\\{"([^"]*)":', 1) AS key,
            replace(replace(replace(replace(regexp_extract(component, ':(.*)$', 1), '"', ''), '}', ''), 'T', ' '), 'Z', '') AS value
        FROM components""",
    "eav_kept": """
        SELECT * FROM eav WHERE amid > 7500000 AND tabla = 16 AND key IN ('isContieneBateria', 'isContieneGps', 'isContieneTiempoVida',
            'isErrorObtenerBateria', 'isErrorObtenerGps', 'isErrorObtenerTiempoVida', 'latitud', 'longitud', 'porcentajeBateria', 'tiempoVida')""",
    "master": "SELECT DISTINCT user_id AS amid, CASE WHEN user_id % 10 = 9 THEN 0 ELSE 1 END AS active, TIMESTAMP '2024-01-01 00:00:00' AS last_update FROM events",
    "located": """
        SELECT c_custkey AS k, CASE WHEN c_custkey % 97 = 96 THEN 'LAB-' ELSE '' END || c_custkey AS amid,
            CASE WHEN c_custkey % 11 = 10 THEN '  ' ELSE 'Estación ' || n_name END AS nombre, 'S' || c_custkey AS serie,
            CAST(-33.437191 AS DOUBLE) + (c_nationkey - 12) * CAST(0.0002 AS DOUBLE) AS lat, CAST(-70.656102 AS DOUBLE) AS lon,
            CAST(50 + c_custkey % 4 * 50 AS DOUBLE) AS radio, CASE WHEN c_custkey % 5 = 4 THEN 0 ELSE 1 END AS operativa
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 6""",
    "locations": "SELECT * EXCLUDE k, 'V1' AS version, 'base.csv' AS archivo, 'excel' AS origen, TIMESTAMP '2024-01-21 00:00:00' AS fecha_carga FROM located",
    "history": """
        SELECT amid, nombre, serie, lat + CAST(0.0004 AS DOUBLE) * v AS lat, lon, CASE WHEN k % 13 = 12 AND v = 1 THEN NULL ELSE radio END AS radio,
            operativa, 'V1' AS version, 'excel' AS origen,
            CASE v WHEN 0 THEN TIMESTAMP '2024-01-01' WHEN 1 THEN TIMESTAMP '2024-01-11' ELSE TIMESTAMP '2024-01-21' END AS inicio,
            CASE v WHEN 0 THEN TIMESTAMP '2024-01-11' WHEN 1 THEN TIMESTAMP '2024-01-21' END AS fin
        FROM located, (VALUES (0), (1), (2)) t(v) WHERE k % 17 <> 16 OR v = 0""",
    "rules": f"SELECT {_RULES}",
    "candidates": f"""
        SELECT amid, id, fecha_hora, porcentaje_bateria, slot FROM (
            SELECT *, time_bucket(INTERVAL 30 MINUTE, fecha_hora + INTERVAL 15 MINUTE) AS slot FROM telemetry
            WHERE porcentaje_bateria IS NOT NULL AND fecha_hora >= {START} - INTERVAL 15 MINUTE AND fecha_hora <= {TODAY} + INTERVAL '23 hours 45 minutes')
        UNION ALL
        SELECT amid, id, fecha_hora, porcentaje_bateria, fecha_hora - INTERVAL 15 MINUTE FROM telemetry
        WHERE porcentaje_bateria IS NOT NULL AND time_bucket(INTERVAL 30 MINUTE, fecha_hora + INTERVAL 15 MINUTE) = fecha_hora + INTERVAL 15 MINUTE
            AND fecha_hora >= {START} - INTERVAL 15 MINUTE AND fecha_hora <= {TODAY} + INTERVAL '23 hours 45 minutes'""",
    "nearest": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY amid, slot ORDER BY abs(epoch_us(slot) - epoch_us(fecha_hora)), fecha_hora DESC, id DESC) AS rn FROM candidates) WHERE rn = 1""",
    "blocks": f"""
        SELECT g.amid, g.slot, CAST(g.slot AS DATE) AS day, strftime(g.slot, '%H:%M') AS slot_text, n.porcentaje_bateria AS pct, n.fecha_hora AS original, n.id AS source_id,
            CAST(abs(epoch_us(g.slot) - epoch_us(n.fecha_hora)) AS DOUBLE) / 60000000 AS diff_minutes, CASE WHEN n.id IS NULL THEN 0 ELSE 1 END AS has_data
        FROM (SELECT amid, unnest(generate_series({START}, {TODAY} + INTERVAL '23 hours 30 minutes', INTERVAL 30 MINUTE)) AS slot FROM master WHERE active = 1) g
        LEFT JOIN nearest n ON g.amid = n.amid AND g.slot = n.slot""",
    "drops": f"""
        SELECT amid, slot0 AS drop_from_ts, slot AS drop_ts, CAST(pct0 AS DOUBLE) AS pct_from, CAST(pct AS DOUBLE) AS pct_to, CAST(pct0 - pct AS DOUBLE) AS drop_points FROM (
            SELECT amid, slot, pct, lag(pct) OVER w AS pct0, lag(slot) OVER w AS slot0, lead(pct) OVER w AS pct1, lead(slot) OVER w AS slot1
            FROM blocks WHERE has_data = 1 AND slot BETWEEN {START} AND {AS_OF} WINDOW w AS (PARTITION BY amid ORDER BY slot)), rules
        WHERE pct0 > pct AND epoch_us(slot) - epoch_us(slot0) <= BAT_CAIDA_MAX_HORAS * 3600000000 AND pct0 - pct >= BAT_CAIDA_MIN_DETECTAR
            AND (pct > 0 OR (pct1 = 0 AND epoch_us(slot1) - epoch_us(slot) <= BAT_CAIDA_MAX_HORAS * 3600000000))""",
    "gps": f"""
        SELECT amid, max(fecha_hora) AS last_status,
            count(*) FILTER (WHERE reported AND fecha_hora >= {TODAY}) AS gps_total_today, count(*) FILTER (WHERE zero AND fecha_hora >= {TODAY}) AS gps_zero_today,
            count(*) FILTER (WHERE reported) AS gps_total_window, count(*) FILTER (WHERE zero) AS gps_zero_window,
            count(DISTINCT CASE WHEN zero THEN CAST(fecha_hora AS DATE) END) AS gps_zero_days, max(CASE WHEN zero THEN fecha_hora END) AS last_zero_fix_ts
        FROM flags WHERE fecha_hora BETWEEN {START} AND {AS_OF} GROUP BY amid""",
    "last_fix": f"""
        SELECT amid, fecha_hora AS last_fix_ts, CASE WHEN zero THEN 1 ELSE 0 END AS last_fix_is_zero FROM (
            SELECT *, row_number() OVER (PARTITION BY amid ORDER BY fecha_hora DESC, id DESC) AS rn FROM flags WHERE reported AND fecha_hora BETWEEN {START} AND {AS_OF}) WHERE rn = 1""",
    "streaks": f"""
        SELECT amid, streak, count(*) AS length, min(fecha_hora) AS first_ts, max(fecha_hora) AS last_ts FROM (
            SELECT *, sum(CASE WHEN zero THEN 0 ELSE 1 END) OVER (PARTITION BY amid ORDER BY fecha_hora, id ROWS UNBOUNDED PRECEDING) AS streak
            FROM flags WHERE reported AND fecha_hora BETWEEN {START} AND {AS_OF}) WHERE zero GROUP BY amid, streak""",
    "battery": f"""
        SELECT amid, count(*) FILTER (WHERE pct = 0 AND slot >= {TODAY}) AS battery_zero_today, count(*) FILTER (WHERE pct = 0) AS battery_zero_window,
            max(CASE WHEN pct = 0 THEN slot END) AS last_battery_zero_ts, arg_max(pct, slot) AS battery_now, max(slot) AS last_block_ts
        FROM blocks WHERE has_data = 1 AND slot BETWEEN {START} AND {AS_OF} GROUP BY amid""",
    "drop_sum": f"""
        SELECT amid, count(*) FILTER (WHERE drop_ts >= {TODAY}) AS drops_today, count(*) AS drops_window,
            coalesce(max(CASE WHEN drop_ts >= {TODAY} THEN drop_points END), 0) AS max_drop_today, max(drop_points) AS max_drop_window,
            max(drop_ts) AS last_drop_ts, arg_max(pct_from, drop_ts) AS last_drop_from, arg_max(pct_to, drop_ts) AS last_drop_to, arg_max(drop_points, drop_ts) AS last_drop_points
        FROM drops GROUP BY amid""",
    "summary": f"""
        SELECT m.amid, {TODAY} AS day_start, {START} AS window_start, {AS_OF} AS window_end, last_status,
            coalesce(gps_total_today, 0) AS gps_total_today, coalesce(gps_zero_today, 0) AS gps_zero_today, coalesce(gps_total_window, 0) AS gps_total_window,
            coalesce(gps_zero_window, 0) AS gps_zero_window, coalesce(gps_zero_days, 0) AS gps_zero_days, last_fix_ts, coalesce(last_fix_is_zero, 0) AS last_fix_is_zero,
            last_zero_fix_ts, coalesce(max_zero_streak, 0) AS max_zero_streak, battery_now, last_block_ts, CASE WHEN battery_now = 0 THEN 1 ELSE 0 END AS last_block_is_zero,
            coalesce(drops_today, 0) AS drops_today, coalesce(drops_window, 0) AS drops_window, last_drop_ts, last_drop_from, last_drop_to, last_drop_points,
            CAST(coalesce(max_drop_today, 0) AS DOUBLE) AS max_drop_today, CAST(coalesce(max_drop_window, 0) AS DOUBLE) AS max_drop_window,
            coalesce(battery_zero_today, 0) AS battery_zero_today, coalesce(battery_zero_window, 0) AS battery_zero_window, last_battery_zero_ts,
            CASE WHEN coalesce(gps_total_today, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((20000 * gps_zero_today + gps_total_today) // (2 * gps_total_today) AS DOUBLE) / 100 END AS gps_zero_pct_today,
            CASE WHEN coalesce(gps_total_window, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((20000 * gps_zero_window + gps_total_window) // (2 * gps_total_window) AS DOUBLE) / 100 END AS gps_zero_pct_window
        FROM (SELECT amid FROM master WHERE active = 1) m LEFT JOIN gps USING (amid) LEFT JOIN last_fix USING (amid)
            LEFT JOIN (SELECT amid, max(length) AS max_zero_streak FROM streaks GROUP BY amid) USING (amid) LEFT JOIN battery USING (amid) LEFT JOIN drop_sum USING (amid)""",
    "coded": """
        SELECT s.*,
            CASE WHEN gps_zero_today >= GPS_CERO_HOY_CRITICA THEN 'G1' WHEN gps_zero_pct_today >= GPS_PORC_HOY_CRITICA AND gps_total_today >= GPS_TOTAL_HOY_CRITICA THEN 'G2'
                WHEN max_zero_streak >= GPS_RACHA_CRITICA AND last_zero_fix_ts >= day_start THEN 'G3' WHEN gps_zero_today BETWEEN GPS_CERO_HOY_ALTA AND GPS_CERO_HOY_ALTA_MAX THEN 'G4'
                WHEN gps_zero_pct_today >= GPS_PORC_HOY_ALTA AND gps_total_today >= GPS_TOTAL_HOY_ALTA THEN 'G5' WHEN max_zero_streak >= GPS_RACHA_ALTA AND last_zero_fix_ts >= day_start THEN 'G6'
                WHEN last_fix_is_zero = 1 THEN 'G7' WHEN gps_zero_today BETWEEN GPS_CERO_HOY_ADV AND GPS_CERO_HOY_ADV_MAX THEN 'G8' WHEN gps_zero_window >= GPS_CERO_HIST_ADV THEN 'G9'
                WHEN gps_zero_pct_window >= GPS_PORC_HIST_ADV THEN 'G10' ELSE 'G0' END AS gps_code,
            CASE WHEN max_drop_today >= BAT_CAIDA_HOY_CRITICA THEN 'B1' WHEN last_drop_to = 0 AND last_drop_ts >= day_start THEN 'B2' WHEN drops_today >= BAT_CAIDAS_HOY_CRITICA THEN 'B3'
                WHEN max_drop_today >= BAT_CAIDA_HOY_CRITICA_CON_HIST AND drops_window >= 1 THEN 'B4' WHEN battery_now = 0 AND battery_zero_today >= BAT_CERO_HOY_CRITICA THEN 'B5'
                WHEN max_drop_today >= BAT_CAIDA_HOY_ALTA AND max_drop_today < BAT_CAIDA_HOY_CRITICA THEN 'B6' WHEN drops_today BETWEEN 1 AND 2 AND drops_window >= 1 THEN 'B7'
                WHEN drops_window >= BAT_CAIDAS_HIST_ALTA THEN 'B8' WHEN max_drop_window >= BAT_CAIDA_MAX_HIST_ALTA THEN 'B9'
                WHEN battery_zero_today BETWEEN BAT_CERO_HOY_ALTA_MIN AND BAT_CERO_HOY_ALTA_MAX AND battery_now = 0 THEN 'B10'
                WHEN battery_zero_today BETWEEN BAT_CERO_HOY_ADV_MIN AND BAT_CERO_HOY_ADV_MAX THEN 'B11' WHEN battery_zero_today >= BAT_CERO_HOY_ALTA_MIN AND battery_now > 0 THEN 'B12'
                WHEN battery_zero_window >= BAT_CERO_HIST_ADV THEN 'B13' WHEN drops_window BETWEEN 1 AND 2 AND drops_today = 0 THEN 'B14' ELSE 'B0' END AS battery_code
        FROM summary s, rules""",
    "reasons": """
        SELECT * FROM (VALUES ('G1', 'CRITICA', 'GPS 0,0 crítico hoy'), ('G2', 'CRITICA', 'Porcentaje crítico de GPS 0,0 hoy'), ('G3', 'CRITICA', 'Racha crítica de GPS 0,0 hoy'),
            ('G4', 'ALTA', 'GPS 0,0 alto hoy'), ('G5', 'ALTA', 'Porcentaje alto de GPS 0,0 hoy'), ('G6', 'ALTA', 'Racha alta de GPS 0,0 hoy'), ('G7', 'ADVERTENCIA', 'Último GPS reportado es 0,0'),
            ('G8', 'ADVERTENCIA', 'GPS 0,0 aislado hoy'), ('G9', 'ADVERTENCIA', 'GPS 0,0 histórico alto'), ('G10', 'ADVERTENCIA', 'Porcentaje histórico GPS 0,0 alto'), ('G0', 'OK', 'Sin alerta GPS'),
            ('B1', 'CRITICA', 'Caída crítica de batería hoy'), ('B2', 'CRITICA', 'Caída confirmada hacia 0% hoy'), ('B3', 'CRITICA', 'Caídas recurrentes hoy'), ('B4', 'CRITICA', 'Caída severa hoy con historial'),
            ('B5', 'CRITICA', 'Batería 0 persistente hoy'), ('B6', 'ALTA', 'Caída brusca de batería hoy'), ('B7', 'ALTA', 'Caída hoy con historial'), ('B8', 'ALTA', 'Caídas recurrentes históricas'),
            ('B9', 'ALTA', 'Caída histórica severa'), ('B10', 'ALTA', 'Batería 0 activa hoy'), ('B11', 'ADVERTENCIA', 'Batería 0 aislada hoy'), ('B12', 'ADVERTENCIA', 'Batería 0 reportada hoy, actual normal'),
            ('B13', 'ADVERTENCIA', 'Batería 0 histórica alta'), ('B14', 'ADVERTENCIA', 'Caída histórica aislada'), ('B0', 'OK', 'Sin alerta batería')) t(code, lvl, txt)""",
    "classified": """
        SELECT *, CASE WHEN level <> 'OK' THEN 1 ELSE 0 END AS has_alert FROM (
            SELECT c.*, g.lvl AS gps_level, g.txt AS gps_reason, b.lvl AS battery_level, b.txt AS battery_reason,
                CASE WHEN 'CRITICA' IN (g.lvl, b.lvl) THEN 'CRITICA' WHEN 'ALTA' IN (g.lvl, b.lvl) OR (g.lvl = 'ADVERTENCIA' AND b.lvl = 'ADVERTENCIA') THEN 'ALTA'
                    WHEN 'ADVERTENCIA' IN (g.lvl, b.lvl) THEN 'ADVERTENCIA' ELSE 'OK' END AS level,
                CASE WHEN g.lvl = 'CRITICA' THEN g.txt WHEN b.lvl = 'CRITICA' THEN b.txt WHEN g.lvl = 'ALTA' AND b.lvl = 'ALTA' THEN 'GPS y batería con alertas altas'
                    WHEN g.lvl = 'ALTA' THEN g.txt WHEN b.lvl = 'ALTA' THEN b.txt WHEN g.lvl = 'ADVERTENCIA' AND b.lvl = 'ADVERTENCIA' THEN 'GPS y batería con advertencias'
                    WHEN g.lvl = 'ADVERTENCIA' THEN g.txt WHEN b.lvl = 'ADVERTENCIA' THEN b.txt ELSE 'Sin alertas' END AS main_reason,
                CASE WHEN g.lvl <> 'OK' AND b.lvl <> 'OK' THEN 'Revisar GPS y batería' WHEN g.lvl <> 'OK' THEN 'Revisar GPS' WHEN b.lvl <> 'OK' THEN 'Revisar batería' ELSE 'Sin acción' END AS action
            FROM coded c JOIN reasons g ON g.code = gps_code JOIN reasons b ON b.code = battery_code)""",
    "placed": """
        SELECT c.*, coalesce(nullif(trim(nombre), ''), 'Ubicación sin asignar') AS location FROM classified c LEFT JOIN locations l ON l.amid = CAST(c.amid AS VARCHAR)""",
    "ranked": f"""
        SELECT *, CASE WHEN level = 'CRITICA' THEN CASE WHEN gps_level = 'CRITICA' AND battery_level = 'CRITICA' THEN 1 WHEN gps_level = 'CRITICA' THEN 2 WHEN battery_level = 'CRITICA' THEN 3 ELSE 4 END
                WHEN level = 'ALTA' THEN CASE WHEN gps_level = 'ALTA' AND battery_level = 'ALTA' THEN 5 WHEN gps_level = 'ALTA' THEN 6 WHEN battery_level = 'ALTA' THEN 7 ELSE 8 END
                WHEN level = 'ADVERTENCIA' THEN CASE WHEN gps_level = 'ADVERTENCIA' AND battery_level = 'ADVERTENCIA' THEN 9 ELSE 10 END ELSE 11 END AS tier,
            CASE WHEN last_status IS NULL OR last_status < {TODAY} THEN 1 WHEN last_status < {AS_OF} - INTERVAL 1 HOUR THEN 2 ELSE 3 END AS status_rank,
            greatest(drops_window - drops_today, 0) AS drops_before
        FROM placed WHERE has_alert = 1""",
    "fix_site": f"""
        SELECT f.*, coalesce(h.nombre, c.nombre, '{LAB[0]}') AS site_nombre, coalesce(h.lat, c.lat, CAST({LAB[1]} AS DOUBLE)) AS site_lat, coalesce(h.lon, c.lon, CAST({LAB[2]} AS DOUBLE)) AS site_lon,
            coalesce(h.radio, c.radio, CAST({LAB[3]} AS DOUBLE)) AS site_radio, coalesce(h.operativa, c.operativa, 0) AS site_operativa,
            CASE WHEN h.amid IS NOT NULL THEN 'history' WHEN c.amid IS NOT NULL THEN 'current' ELSE 'lab' END AS site_source
        FROM (SELECT * FROM flags WHERE reported) f
        LEFT JOIN (
            SELECT * FROM (SELECT t.id, h.amid, h.lat, h.lon, h.radio, h.operativa, coalesce(nullif(trim(h.nombre), ''), '{LAB[0]}') AS nombre, row_number() OVER (PARTITION BY t.id ORDER BY h.inicio DESC) AS rn
                FROM telemetry t JOIN history h ON h.amid = CAST(t.amid AS VARCHAR) AND h.inicio <= t.fecha_hora AND (h.fin IS NULL OR t.fecha_hora < h.fin) AND h.radio IS NOT NULL) WHERE rn = 1
        ) h ON h.id = f.id
        LEFT JOIN (SELECT amid, lat, lon, radio, operativa, coalesce(nullif(trim(nombre), ''), '{LAB[0]}') AS nombre FROM locations) c ON c.amid = CAST(f.amid AS VARCHAR)""",
    "evaluated": f"""
        SELECT *, CASE WHEN zero THEN false ELSE distance <= site_radio END AS inside FROM (
            SELECT *, CASE WHEN NOT zero THEN {haversine('latitud', 'longitud', 'site_lat', 'site_lon')} END AS distance FROM fix_site)""",
    "changes": """
        SELECT amid, id, fecha_hora, inside, zero, site_nombre, lag(site_nombre) OVER w AS previous_nombre,
            lag(id) OVER w IS NOT NULL AND (lag(site_nombre) OVER w, lag(site_lat) OVER w, lag(site_lon) OVER w, lag(site_radio) OVER w) IS DISTINCT FROM (site_nombre, site_lat, site_lon, site_radio) AS changed
        FROM evaluated WINDOW w AS (PARTITION BY amid ORDER BY fecha_hora, id)""",
    "delivered": """
        SELECT orden, CASE WHEN iid = '' THEN NULL ELSE split_part(iid, '.', 1) END AS amid, CASE WHEN nom = ' nan ' THEN NULL ELSE nom END AS nombre, 'S' || k AS serie,
            CAST(micro AS DOUBLE) / 1000000 AS lat, CAST(-70.656102 AS DOUBLE) AS lon, CAST(nullif(rad, '') AS DOUBLE) AS radio, op
        FROM (SELECT c_custkey AS k, c_custkey * 2 + copy AS orden, CASE WHEN c_custkey % 23 = 22 THEN '' WHEN c_custkey % 3 = 0 THEN c_custkey || '.0' ELSE CAST(c_custkey AS VARCHAR) END AS iid,
                CASE WHEN c_custkey % 11 = 10 THEN ' nan ' ELSE 'Estación ' || n_name || CASE WHEN copy = 1 THEN ' bis' ELSE '' END END AS nom, -33437191 + (c_nationkey - 12) * 200 AS micro,
                CASE WHEN c_custkey % 7 = 2 THEN 'quizás' WHEN c_custkey % 7 = 5 THEN 'NO' ELSE 'SI' END AS op, CASE WHEN c_custkey % 29 = 28 THEN '' ELSE CAST(50 + c_custkey % 4 * 50 AS VARCHAR) END AS rad
            FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (0), (1)) t(copy) WHERE c_custkey % 5 <> 3 AND (copy = 0 OR c_custkey % 19 = 0))""",
    "usable": f"""
        SELECT orden, amid, CASE WHEN op = 'SI' THEN nombre ELSE '{LAB[0]}' END AS nombre, serie, CASE WHEN op = 'SI' THEN lat ELSE CAST({LAB[1]} AS DOUBLE) END AS lat,
            CASE WHEN op = 'SI' THEN lon ELSE CAST({LAB[2]} AS DOUBLE) END AS lon, CASE WHEN op = 'SI' THEN radio ELSE CAST({LAB[3]} AS DOUBLE) END AS radio,
            CASE WHEN op = 'SI' THEN 1 ELSE 0 END AS operativa, 'V7' AS version, CASE WHEN op = 'SI' THEN 'excel' ELSE 'laboratorio' END AS origen
        FROM delivered WHERE amid IS NOT NULL AND (op = 'NO' OR (op = 'SI' AND radio IS NOT NULL))""",
    "snap": "SELECT * EXCLUDE (orden, rn) FROM (SELECT *, row_number() OVER (PARTITION BY amid ORDER BY orden DESC) AS rn FROM usable) WHERE rn = 1",
    "open_rows": "SELECT * FROM history WHERE fin IS NULL",
    "acts": """
        SELECT s.*, o.amid AS o_amid, CASE WHEN o.amid IS NULL THEN 'opened'
            WHEN trim(coalesce(o.nombre, '')) = trim(coalesce(s.nombre, '')) AND o.serie = s.serie AND o.origen = s.origen AND o.version = s.version AND o.operativa = s.operativa
                AND round(o.lat, 7) = round(s.lat, 7) AND round(o.lon, 7) = round(s.lon, 7) AND round(o.radio, 7) IS NOT DISTINCT FROM round(s.radio, 7) THEN 'unchanged' ELSE 'reopened' END AS act
        FROM snap s LEFT JOIN open_rows o ON o.amid = s.amid""",
    "moved": f"""
        SELECT l.amid, l.serie, o.amid AS o_amid FROM locations l LEFT JOIN open_rows o ON o.amid = l.amid WHERE l.amid NOT IN (SELECT amid FROM snap)
            AND NOT coalesce(trim(o.nombre) = '{LAB[0]}' AND round(o.lat, 7) = {LAB[1]} AND round(o.lon, 7) = {LAB[2]} AND o.radio = {LAB[3]} AND o.operativa = 0, false)""",
    "rule_sets": f"""
        SELECT c_custkey AS fleet, key, CASE
            WHEN c_custkey % 13 = 1 AND key = 'GPS_CERO_HOY_ALTA_MAX' THEN 99 WHEN c_custkey % 13 = 2 AND key = 'GPS_PORC_HOY_CRITICA' THEN 101 WHEN c_custkey % 13 = 3 AND key = 'BAT_CAIDA_MAX_HORAS' THEN 0
            WHEN c_custkey % 13 = 4 AND key = 'BAT_CERO_HIST_ADV' THEN -1 WHEN c_custkey % 13 = 5 AND key = 'GPS_RACHA_ALTA' THEN 9999 WHEN c_custkey % 13 = 6 AND key = 'BAT_CERO_HOY_ADV_MAX' THEN 50
            WHEN c_custkey % 13 = 7 AND key = 'BAT_CAIDA_HOY_ALTA' THEN 60 WHEN c_custkey % 13 = 9 AND key = 'GPS_CERO_HIST_ADV' THEN NULL ELSE val END AS value,
            CASE WHEN c_custkey % 13 = 8 AND key = 'GPS_RACHA_CRITICA' THEN 0 ELSE 1 END AS active, typ AS type
        FROM customer, (VALUES {_RULE_ROWS}) t(key, val, typ)""",
    "wide_rules": "SELECT fleet, " + ", ".join(f"max(CASE WHEN key = '{k}' AND active = 1 THEN value END) AS {k}" for k in DEFAULTS) + ", count(*) FILTER (WHERE active = 1 AND value IS NOT NULL) AS n_active, "
    "count(*) FILTER (WHERE active = 1 AND value < 0) AS n_negative, count(*) FILTER (WHERE active = 1 AND key LIKE 'GPS_PORC_%' AND (value < 0 OR value > 100)) AS n_percent FROM rule_sets GROUP BY fleet",
    "requested": """
        SELECT fleet, key, CASE WHEN fleet % 5 = 0 AND key = 'GPS_CERO_HOY_ADV' THEN '1.00' WHEN fleet % 5 = 1 AND key = 'GPS_CERO_HIST_ADV' THEN '120' WHEN fleet % 5 = 2 AND key = 'BAT_CAIDA_MIN_DETECTAR' THEN ' 25 '
            WHEN fleet % 5 = 3 AND key = 'GPS_RACHA_ALTA' THEN 'mucho' END AS value, CASE WHEN fleet % 5 = 4 AND key = 'GPS_RACHA_ALTA' THEN 'OTRA' ELSE key END AS new_key FROM rule_sets""",
    "wanted": """
        SELECT fleet, new_key AS key, CASE WHEN new_key = 'OTRA' THEN '1' ELSE value END AS value FROM requested WHERE value IS NOT NULL OR new_key = 'OTRA'""",
    "rule_diff": """
        SELECT w.fleet, w.key, r.value AS old_value, TRY_CAST(trim(w.value) AS DOUBLE) AS new_value, r.type, r.type IS NULL OR TRY_CAST(trim(w.value) AS DOUBLE) IS NULL AS rejected
        FROM wanted w LEFT JOIN rule_sets r ON r.fleet = w.fleet AND r.key = w.key
        WHERE r.type IS NULL OR TRY_CAST(trim(w.value) AS DOUBLE) IS NULL OR r.value IS DISTINCT FROM TRY_CAST(trim(w.value) AS DOUBLE)""",
    "rules_after": """
        SELECT r.fleet, r.key, coalesce(d.new_value, r.value) AS value, r.active FROM rule_sets r LEFT JOIN rule_diff d ON d.fleet = r.fleet AND d.key = r.key AND NOT d.rejected""",
    "wide_after": "SELECT fleet, " + ", ".join(f"max(CASE WHEN key = '{k}' AND active = 1 THEN value END) AS {k}" for k in DEFAULTS) + ", count(*) FILTER (WHERE active = 1 AND value IS NOT NULL) AS n_active, "
    "count(*) FILTER (WHERE active = 1 AND value < 0) AS n_negative, count(*) FILTER (WHERE active = 1 AND key LIKE 'GPS_PORC_%' AND (value < 0 OR value > 100)) AS n_percent FROM rules_after GROUP BY fleet",
}


def sql(body: str) -> str:
    """A query over the tables of the chain that it needs."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(TABLES[name])

    visit(body)
    chain = ", ".join(f"{name} AS ({TABLES[name]})" for name in TABLES if name in needed)
    return f"WITH {chain} {body}" if chain else body
