"""Independent SQL answers for the registered queries (DuckDB dialect, over the raw tables).

``TABLES`` are named building blocks; ``sql(final)`` puts the ones a final SELECT needs, in order, into
one WITH clause. Written separately from the operators: plain unions, joins and windows.
"""

from __future__ import annotations

import re

START, PLATFORM_B, FINE = "DATE '1995-01-01'", "DATE '1995-07-04'", "DATE '1997-01-20'"
DRIFT, END, OVERLAP = "DATE '2000-01-01'", "(SELECT record_end FROM end_t)", "DATE '1997-02-01'"
PRIOR_K, PRIOR_KT = "0.6e0", "1.2e0"
FIRST_FULL, LAST_FULL = 1996, "(SELECT year FROM end_t)"


def r(expr: str, digits: int) -> str:
    return f"(round_even(CAST(({expr}) AS DOUBLE) * 1e{digits}, 0) / 1e{digits} + 0e0)"


def usual(x: str, part: str = "") -> str:
    w = f"OVER ({'PARTITION BY ' + part if part else ''} ORDER BY d ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)"
    return f"CASE WHEN count({x}) {w} >= 15 THEN quantile_cont({x}, 0.5) {w} END"


def key(d: str) -> str:
    return f"CASE WHEN strftime({d}, '%m-%d') = '02-29' THEN '02-28' ELSE strftime({d}, '%m-%d') END"


DETECTIONS = """
SELECT * FROM (
  SELECT s.s_nationkey AS area, CAST(l.l_shipdate AS DATE) AS acq_date,
    (l.l_partkey % 16) * CAST(0.05 AS DOUBLE) - CAST(0.4 AS DOUBLE) AS latitude,
    (l.l_partkey % 14) * CAST(0.05 AS DOUBLE) - CAST(0.3 AS DOUBLE) AS longitude,
    CASE l.l_returnflag WHEN 'N' THEN 'F' ELSE 'C' END AS instrument,
    CASE l.l_returnflag WHEN 'A' THEN 'P1' WHEN 'R' THEN 'P2' ELSE 'F1' END AS satellite,
    CAST(l.l_quantity * 2 AS INT) AS conf_pct,
    CASE WHEN l.l_linenumber = 1 THEN 'l' WHEN l.l_linenumber <= 4 THEN 'n' ELSE 'h' END AS conf_cls,
    CASE WHEN l.l_partkey % 17 = 0 THEN 2 ELSE 0 END AS type, l.l_extendedprice AS frp
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey) raw
WHERE (instrument = 'C' AND (satellite = 'P1' OR acq_date >= DATE '1995-07-04'))
   OR (instrument = 'F' AND acq_date >= DATE '1997-01-20')"""

FEED = """
SELECT CAST(ts AS DATE) AS acq_date, date_part('hour', ts) * 100 + date_part('minute', ts) AS hhmm,
  (user_id % 16) * CAST(0.05 AS DOUBLE) - CAST(0.4 AS DOUBLE) AS latitude,
  (user_id % 14) * CAST(0.05 AS DOUBLE) - CAST(0.3 AS DOUBLE) AS longitude,
  CASE event_type WHEN 'error' THEN 'l' WHEN 'view' THEN 'nominal' WHEN 'purchase' THEN 'high'
                  WHEN 'click' THEN 'n' ELSE 'h' END AS confidence,
  value AS frp, event_id AS det_id, ts
FROM events"""

EDGES = """
SELECT area, 0 AS poly, ring,
  cx + r*CASE k WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS x1, cy + r*CASE k WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS y1,
  cx + r*CASE k WHEN 3 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS x2, cy + r*CASE k WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS y2
FROM (
  SELECT n_nationkey AS area, 0 AS ring, CAST(n_nationkey % 5 AS BIGINT)*1500-3000 AS cx,
         CAST(floor(n_nationkey/5) AS BIGINT)*1500-3000 AS cy, CAST(1600 AS BIGINT) AS r FROM nation WHERE n_nationkey % 5 <> 4
  UNION ALL
  SELECT n_nationkey, 1, CAST(n_nationkey % 5 AS BIGINT)*1500-3000,
         CAST(floor(n_nationkey/5) AS BIGINT)*1500-3000, CAST(400 AS BIGINT) FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 5 <> 4
) c CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) q"""

CELL = "CAST(floor({0} * 10) AS INT)"
YI, XI = CELL.format("latitude"), CELL.format("longitude")


def ray_cast(points: str, pid: str) -> str:
    """(pid, area): points (pid, x, y) against every edge."""
    c = "((x - x1) * (y2 - y1) - (x2 - x1) * (y - y1))"
    on = f"({c} = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2))"
    crossed = f"((y1 > y) <> (y2 > y) AND CASE WHEN y2 > y1 THEN {c} < 0 ELSE {c} > 0 END)"
    return f"""SELECT DISTINCT {pid}, area FROM (
      SELECT {pid}, area, poly, bool_or({on}) AS at_edge, sum(CASE WHEN {crossed} THEN 1 ELSE 0 END) AS n
      FROM {points} CROSS JOIN edges_t GROUP BY {pid}, area, poly) WHERE at_edge OR n % 2 = 1"""


def live_days(feed: str) -> str:
    return f"""SELECT acq_date AS d, {YI} AS yi, {XI} AS xi, count(*) AS n, sum(frp) AS frp
      FROM {feed} WHERE confidence IN ('nominal', 'high', 'n', 'h') GROUP BY ALL"""



TABLES: dict[str, str] = {
    "det_t": DETECTIONS,
    "end_t": """SELECT y AS year, make_date(y, 12, 31) AS record_end FROM (SELECT CAST(year(CAST(least(
        max(acq_date) FILTER (instrument = 'C'), max(acq_date) FILTER (instrument = 'F')) AS DATE) + 1) - 1 AS INT) AS y FROM det_t)""",
    "cat_t": "SELECT n_nationkey AS area, n_name AS name, n_nationkey % 4 <> 1 AS ready FROM nation",
    "edges_t": EDGES,
    "feed_all_t": FEED,
    "feed_t": "SELECT * FROM feed_all_t WHERE ts >= (SELECT max(ts) FROM feed_all_t) - INTERVAL 168 HOUR",
    "places_t": """SELECT s_suppkey AS place_id, s_name AS name,
        (s_suppkey % 16) * CAST(0.05 AS DOUBLE) - CAST(0.387 AS DOUBLE) AS lat,
        (s_suppkey % 14) * CAST(0.05 AS DOUBLE) - CAST(0.281 AS DOUBLE) AS lon,
        1000 + floor(abs(s_acctbal) * 10) AS pop, n_name AS region
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "boxes_t": """SELECT c_custkey AS aoi_id, w, s, w + 2e-2 + (c_custkey % 5) * 1e-1 AS e, s + 3e-2 + (c_custkey % 7) * 5e-2 AS n
      FROM (SELECT c_custkey, (c_custkey % 37) * 5e-2 - 9e-1 AS w, (c_custkey % 23) * 5e-2 - 6e-1 AS s FROM customer)""",
    "raw_boxes_t": """SELECT c_custkey AS aoi_id, w, s, w + (c_custkey % 13) * 8.5e0 - 5e0 AS e, s + (c_custkey % 11) * 9.25e0 - 4e0 AS n
      FROM (SELECT c_custkey, (c_custkey % 41) * 10.03e0 - 205.5e0 AS w, (c_custkey % 29) * 7.017e0 - 100.25e0 AS s FROM customer)""",
    # ---- grid
    "tagged_t": """SELECT *, 0 AS s FROM det_t WHERE type = 0 AND instrument = 'C' AND conf_pct >= 30
      UNION ALL SELECT *, 1 FROM det_t WHERE type = 0 AND instrument = 'F' AND conf_cls IN ('n', 'h')
      UNION ALL SELECT *, 2 FROM det_t WHERE type = 0 AND instrument = 'C' AND conf_pct >= 30 AND satellite = 'P1'""",
    "grid_t": f"""SELECT area, acq_date AS d, {YI} AS yi, {XI} AS xi, s, count(*) AS n, sum(frp) AS frp FROM tagged_t GROUP BY ALL""",
    "static_t": f"""SELECT area, {YI} AS yi, {XI} AS xi FROM det_t WHERE instrument = 'F' GROUP BY ALL
      HAVING count(*) FILTER (type <> 0) >= 2 AND count(*) FILTER (type <> 0) * 8 >= count(*) FILTER (type = 0)""",
    "merged_t": "SELECT d, yi, xi, s, sum(n) AS n, sum(frp) AS frp FROM grid_t GROUP BY ALL",
    # ---- outages
    "bands_t": "SELECT d, s, CAST(floor(xi / 2e0) AS INT) AS band, count(*) AS n FROM grid_t GROUP BY ALL",
    "world_t": """SELECT x.d, CAST(coalesce(sum(n) FILTER (s = 0), 0) AS DOUBLE) AS m,
        CAST(coalesce(sum(n) FILTER (s = 1), 0) AS DOUBLE) AS v, CAST(coalesce(sum(n) FILTER (s = 2), 0) AS DOUBLE) AS t
      FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
            FROM (SELECT min(d) AS lo, max(d) AS hi FROM bands_t)) x LEFT JOIN bands_t b ON b.d = x.d GROUP BY x.d""",
    "fine_ratio_t": f"SELECT d, m, v / nullif(m, 0) AS q FROM world_t WHERE d >= {FINE}",
    "gaps_t": f"SELECT d FROM (SELECT d, m, q, {usual('q')} AS u FROM fine_ratio_t) WHERE m >= 5 AND q < 0.25e0 * u",
    "band_days_t": f"""SELECT sp.band, sp.d, CAST(coalesce(sum(n) FILTER (s = 0), 0) AS DOUBLE) AS m,
        CAST(coalesce(sum(n) FILTER (s = 1), 0) AS DOUBLE) AS v
      FROM (SELECT band, CAST(unnest(generate_series({FINE}, (SELECT max(d) FROM bands_t WHERE s < 2), INTERVAL 1 DAY)) AS DATE) AS d
            FROM (SELECT DISTINCT band FROM bands_t WHERE s < 2)) sp
      LEFT JOIN bands_t b ON b.band = sp.band AND b.d = sp.d AND b.s < 2 GROUP BY ALL""",
    "strips_t": f"""SELECT d, band FROM (SELECT d, band, m, q, {usual('q', 'band')} AS u
        FROM (SELECT *, v / nullif(m, 0) AS q FROM band_days_t))
      WHERE m >= 2 AND q < 0.1e0 * u AND d NOT IN (SELECT d FROM gaps_t)""",
    "era_t": f"""SELECT d, m, t, low, d >= {PLATFORM_B} AND NOT low AS era,
        CASE WHEN d >= {PLATFORM_B} AND NOT low THEN t / nullif(m, 0) END AS a
      FROM (SELECT d, m, t, coalesce(m < 0.25e0 * u AND u >= 5, false) AS low FROM (SELECT *, {usual('m')} AS u FROM world_t))""",
    "coarse_t": f"""SELECT d, coarse_out, era AND NOT coarse_out AND coalesce(b < 0.25e0 * ub, false) AS b_out
      FROM (SELECT d, era, b, ub, low OR (era AND coalesce(a < 0.25e0 * ua, false)) AS coarse_out
            FROM (SELECT d, low, era, a, b, {usual('a')} AS ua, {usual('b')} AS ub FROM (SELECT *, 1 - a AS b FROM era_t)))""",
    "outages_t": f"""SELECT *, coarse_out AND (d < {FINE} OR fine_out) AS unknown
      FROM (SELECT c.d, c.coarse_out, c.b_out, g.d IS NOT NULL AS fine_out FROM coarse_t c LEFT JOIN gaps_t g ON g.d = c.d)
      WHERE coarse_out OR b_out OR fine_out""",
    "kept_bands_t": """SELECT * FROM bands_t b WHERE d NOT IN (SELECT d FROM outages_t)
      AND NOT EXISTS (SELECT 1 FROM strips_t x WHERE x.d = b.d AND x.band = b.band)""",
    # ---- series
    "reclassed_t": """SELECT g.area, g.d, g.yi, g.xi, CASE WHEN g.s < 2 AND x.d IS NOT NULL THEN 4 - g.s ELSE g.s END AS s, g.n, g.frp
      FROM grid_t g LEFT JOIN strips_t x ON x.d = g.d AND x.band = CAST(floor(g.xi / 2e0) AS INT)""",
    "daily_t": """SELECT area, d,
        count(*) FILTER (s IN (0, 4)) AS m, sum(n) FILTER (s IN (0, 4)) AS m_det, sum(frp) FILTER (s IN (0, 4)) AS m_frp,
        count(*) FILTER (s = 1) AS v, sum(n) FILTER (s = 1) AS v_det, sum(frp) FILTER (s = 1) AS v_frp,
        count(*) FILTER (s = 2) AS t, sum(n) FILTER (s = 2) AS t_det, sum(frp) FILTER (s = 2) AS t_frp,
        count(*) FILTER (s = 4) AS mg FROM reclassed_t GROUP BY ALL""",
    "spine_t": f"""SELECT c.area, CAST(x.d AS DATE) AS d FROM cat_t c
      CROSS JOIN (SELECT unnest(generate_series({START}, {END}, INTERVAL 1 DAY)) AS d) x""",
    "days_t": f"""SELECT sp.area, sp.d, """
    + ", ".join(f"CAST(coalesce(y.{c}, 0) AS DOUBLE) AS {c}" for c in ("m", "m_det", "m_frp", "t", "t_det", "t_frp", "mg"))
    + ", "
    + ", ".join(
        f"CASE WHEN sp.d >= {FINE} AND NOT coalesce(o.fine_out, false) THEN CAST(coalesce(y.{c}, 0) AS DOUBLE) END AS {c}"
        for c in ("v", "v_det", "v_frp")
    )
    + """, coalesce(o.fine_out, false) AS fine_out, coalesce(o.coarse_out, false) AS coarse_out,
        coalesce(o.b_out, false) AS b_out, coalesce(o.unknown, false) AS unknown
      FROM spine_t sp LEFT JOIN daily_t y ON y.area = sp.area AND y.d = sp.d LEFT JOIN outages_t o ON o.d = sp.d""",
    "flagged_t": f"""SELECT *, gap OR strip OR b_out OR coarse_out AS out FROM (
        SELECT *, d >= {FINE} AND v IS NULL AS gap, d >= {FINE} AND v IS NOT NULL AND mg > 0 AS strip FROM days_t)""",
    "monthly_t": f"""SELECT area, month, year(month) AS y, month(month) AS mon, m, v, t, month >= {OVERLAP} AND v IS NOT NULL AS overlap
      FROM (SELECT area, CAST(date_trunc('month', d) AS DATE) AS month, sum(m) FILTER (NOT out) AS m,
              sum(v) FILTER (NOT out) AS v, sum(t) FILTER (NOT out) AS t FROM flagged_t GROUP BY ALL)""",
    "fit_area_t": f"""SELECT c.area, (coalesce(sum(v), 0) + 50 * {PRIOR_K}) / (coalesce(sum(m), 0) + 50) AS k_area,
        (coalesce(sum(v) FILTER (month < {DRIFT}), 0) + 50 * {PRIOR_KT}) / (coalesce(sum(t) FILTER (month < {DRIFT}), 0) + 50) AS kt_area
      FROM cat_t c LEFT JOIN monthly_t x ON x.area = c.area AND x.overlap GROUP BY c.area""",
    "ratios_t": f"""SELECT f.area, q.mon, any_value(k_area) AS k_area, any_value(kt_area) AS kt_area,
        (coalesce(sum(v), 0) + 20 * any_value(k_area)) / (coalesce(sum(m), 0) + 20) AS k,
        (coalesce(sum(v) FILTER (month < {DRIFT}), 0) + 20 * any_value(kt_area)) / (coalesce(sum(t) FILTER (month < {DRIFT}), 0) + 20) AS kt
      FROM fit_area_t f CROSS JOIN (SELECT unnest(range(1, 13)) AS mon) q
      LEFT JOIN monthly_t x ON x.area = f.area AND x.mon = q.mon AND x.overlap GROUP BY f.area, q.mon""",
    "h0_t": f"""SELECT x.*, month(x.d) AS mon, CASE WHEN x.d < {PLATFORM_B} THEN x.t * kt
        WHEN x.d < {FINE} OR gap THEN CASE WHEN b_out THEN x.t * kt ELSE x.m * k END ELSE x.v + x.mg * k END AS h0
      FROM flagged_t x JOIN ratios_t q ON q.area = x.area AND q.mon = month(x.d)""",
    "clim0_t": f"SELECT area, {key('d')} AS key, avg(h0) AS c FROM h0_t WHERE NOT unknown GROUP BY ALL",
    "h1_t": f"""SELECT h.*, coalesce(c.c, 0) AS clim FROM h0_t h LEFT JOIN clim0_t c ON c.area = h.area AND c.key = {key('h.d')}""",
    "level_t": """SELECT area, year(d) AS y, month(d) AS mon, coalesce(sum(h0), 0) / nullif(sum(clim), 0) AS level
      FROM h1_t WHERE NOT unknown GROUP BY ALL""",
    "series_t": """SELECT h.*, CASE WHEN h.unknown THEN h.clim * coalesce(l.level, 1) ELSE h.h0 END AS h
      FROM h1_t h LEFT JOIN level_t l ON l.area = h.area AND l.y = year(h.d) AND l.mon = month(h.d)""",
    "scale_t": f"""SELECT area, year(d) AS y, month(d) AS mon,
        CASE WHEN sum(h) FILTER (NOT unknown) > 0 THEN {r('sum(h) / (sum(h) FILTER (NOT unknown))', 4)} ELSE 1e0 END AS scale
      FROM series_t GROUP BY ALL HAVING bool_or(unknown)""",
    # ---- validation
    "cv_m_t": "",
    "cv_t_t": "",
    "cv_med_t": f"""SELECT c.area, {r('median(ape)', 1)} AS cv_median_ape FROM cat_t c LEFT JOIN cv_m_t x ON x.area = c.area GROUP BY c.area""",
    "r2_t": """SELECT c.area, CASE WHEN max(tot) > 0 THEN 1 - sum(res) / max(tot) END AS r2, coalesce(sum(v), 0) AS overlap_cell_days FROM cat_t c
      LEFT JOIN (SELECT x.area, x.v, (x.v - x.m * q.k) * (x.v - x.m * q.k) AS res, a.tot FROM monthly_t x
        JOIN ratios_t q ON q.area = x.area AND q.mon = x.mon
        JOIN (SELECT area, var_pop(v) * count(*) AS tot FROM monthly_t WHERE overlap GROUP BY area) a ON a.area = x.area
        WHERE x.overlap) z ON z.area = c.area GROUP BY c.area""",
    # ---- calendar
    "smooth_t": """SELECT *, avg(h) OVER (PARTITION BY area ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS h7 FROM series_t""",
    "months_t": "SELECT area, year(d) AS y, month(d) AS mon, sum(h) AS x FROM series_t GROUP BY ALL",
    "normals_t": f"""SELECT area, mon, avg(x) AS mu, stddev_samp(x) AS sd FROM months_t
      WHERE y BETWEEN {FIRST_FULL} AND {LAST_FULL} GROUP BY ALL""",
    "anom_t": """SELECT x.area, x.y, x.mon, x.x, n.mu, n.sd, CASE WHEN n.sd > 0 THEN (x.x - n.mu) / n.sd END AS z
      FROM months_t x LEFT JOIN normals_t n ON n.area = x.area AND n.mon = x.mon""",
    "unusual_t": f"""SELECT area, row_number() OVER (PARTITION BY area ORDER BY abs(z2) DESC, y, mon) AS rank, y, mon, z2 AS z,
        {r('x', 1)} AS value, {r('mu', 1)} AS normal
      FROM (SELECT a.*, {r('a.z', 2)} AS z2 FROM anom_t a JOIN (SELECT area, sum(mu) AS total FROM normals_t GROUP BY area) b ON b.area = a.area
            WHERE abs(a.z) >= 1.5e0 AND a.mu >= greatest(1e0, 0.02e0 * b.total)) QUALIFY rank <= 12""",
    "clim_t": f"""SELECT area, key, avg(x) AS mean, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90
      FROM (SELECT area, {key('d')} AS key, year(d) AS y, avg(h7) AS x FROM smooth_t
            WHERE year(d) BETWEEN {FIRST_FULL} AND {LAST_FULL} GROUP BY ALL) GROUP BY ALL""",
    "ring_t": "SELECT area, key, mean, row_number() OVER (PARTITION BY area ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY area) AS n FROM clim_t",
    "ring61_t": f"""SELECT a.area, a.i, a.n, a.key, {r('sum(b.mean)', 9)} AS total FROM ring_t a JOIN ring_t b ON b.area = a.area
        AND least((b.i - a.i + a.n) % a.n, (a.i - b.i + a.n) % a.n) <= 30 GROUP BY ALL""",
    "ring7_t": f"""SELECT a.area, a.i, a.n, a.key, {r('sum(b.mean)', 9)} AS total FROM ring_t a JOIN ring_t b ON b.area = a.area
        AND least((b.i - a.i + a.n) % a.n, (a.i - b.i + a.n) % a.n) <= 3 GROUP BY ALL""",
    "tied_t": "SELECT *, total = min(total) OVER (PARTITION BY area) AS tied FROM ring61_t",
    "turn_t": """SELECT x.*, f.f, (x.i - f.f - 1 + x.n) % x.n AS p FROM tied_t x
      JOIN (SELECT area, min(i) AS f FROM tied_t WHERE NOT tied GROUP BY area) f ON f.area = x.area""",
    "runs_t": """SELECT area, min(p) AS p0, count(*) AS len, any_value(f) AS f, any_value(n) AS n FROM (
        SELECT *, p - row_number() OVER (PARTITION BY area ORDER BY p) AS run FROM turn_t WHERE tied) GROUP BY area, run""",
    "starts_t": """SELECT c.area, coalesce(k.key, z.key, '01-01') AS season_start FROM cat_t c
      LEFT JOIN (SELECT x.area, (f + 1 + p0 + (len - 1) // 2) % n AS i FROM runs_t x
                 QUALIFY row_number() OVER (PARTITION BY area ORDER BY len DESC, p0) = 1) b ON b.area = c.area
      LEFT JOIN ring_t k ON k.area = c.area AND k.i = b.i
      LEFT JOIN ring_t z ON z.area = c.area AND z.i = 0 AND NOT EXISTS (SELECT 1 FROM turn_t q WHERE q.area = c.area)""",
    "season_list_t": f"""SELECT area, season_start, y AS start_year, a AS season_from, b AS season_to,
        CASE WHEN season_start BETWEEN '01-01' AND '01-19' THEN CAST(y AS VARCHAR)
             ELSE CAST(y AS VARCHAR) || '–' || right(CAST(y + 1 AS VARCHAR), 2) END AS label
      FROM (SELECT area, season_start, y, CAST(y || '-' || season_start AS DATE) AS a,
              CAST(CAST((y + 1) || '-' || season_start AS DATE) - INTERVAL 1 DAY AS DATE) AS b
            FROM starts_t CROSS JOIN (SELECT unnest(range(1990, 2100)) AS y) q) WHERE a >= {START} AND b <= {END}""",
    "assigned_t": """SELECT x.area, x.d, x.h, x.h7, l.start_year, l.season_from, l.season_to, l.label FROM smooth_t x
      JOIN season_list_t l ON l.area = x.area AND x.d BETWEEN l.season_from AND l.season_to""",
    "season_days_t": """SELECT *, sum(h) OVER (PARTITION BY area, start_year) AS raw,
        sum(h) OVER (PARTITION BY area, start_year ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM assigned_t""",
    "seasons_t": f"""SELECT *, CAST(start - season_from AS INT) AS start_off, CAST(peak - season_from AS INT) AS peak_off,
        CAST("end" - season_from AS INT) AS end_off, CAST("end" - start + 1 AS INT) AS length,
        CASE WHEN start IS NOT NULL THEN season_from < {FINE} END AS from_coarse
      FROM (SELECT area, start_year, label, season_from, {r('max(raw)', 1)} AS total,
              min(d) FILTER (raw >= 5 AND cum / raw >= 0.1e0 - 1e-9) AS start,
              arg_min(d, (-{r('h7', 9)}, d)) FILTER (raw >= 5) AS peak,
              min(d) FILTER (raw >= 5 AND cum / raw >= 0.9e0 - 1e-9) AS "end"
            FROM season_days_t GROUP BY area, start_year, label, season_from)""",
    "seasons_z_t": f"""SELECT *, CASE WHEN sd > 0 THEN {r('(total - mu) / sd', 2)} END AS z
      FROM (SELECT *, avg(total) OVER (PARTITION BY area) AS mu, stddev_samp(total) OVER (PARTITION BY area) AS sd FROM seasons_t)""",
    "yearly_t": f"""SELECT area, y, {r('m', 0)} AS m, {r(f"CASE WHEN make_date(y, 1, 1) >= {FINE} THEN v END", 0)} AS v, {r('h', 0)} AS h
      FROM (SELECT area, year(d) AS y, sum(m) AS m, sum(v) AS v, sum(h) AS h FROM series_t GROUP BY ALL)
      WHERE y BETWEEN {FIRST_FULL} AND {LAST_FULL}""",
    # ---- layers
    "map_ratios_t": f"""SELECT DISTINCT area, CASE WHEN {r('k_area', 3)} = 0 THEN 1 ELSE {r('k_area', 3)} END AS k,
        CASE WHEN {r('kt_area', 3)} = 0 THEN 1 ELSE {r('kt_area', 3)} END AS kt FROM ratios_t""",
    "values_t": f"""SELECT g.area, g.d, g.yi, g.xi, g.s, coalesce(sc.scale, 1) * CASE
          WHEN coalesce(o.unknown, false) THEN 0e0
          WHEN g.d >= {FINE} AND x.d IS NULL AND NOT coalesce(o.fine_out, false) THEN CASE WHEN g.s = 1 THEN 1e0 ELSE 0e0 END
          WHEN g.d >= {PLATFORM_B} AND NOT coalesce(o.b_out, false) THEN CASE WHEN g.s = 0 THEN q.k ELSE 0e0 END
          ELSE CASE WHEN g.s = 2 THEN q.kt ELSE 0e0 END END AS val
      FROM grid_t g LEFT JOIN outages_t o ON o.d = g.d
      LEFT JOIN strips_t x ON x.d = g.d AND x.band = CAST(floor(g.xi / 2e0) AS INT)
      JOIN map_ratios_t q ON q.area = g.area
      LEFT JOIN scale_t sc ON sc.area = g.area AND sc.y = year(g.d) AND sc.mon = month(g.d)
      WHERE g.d <= {END}""",
    "cell_months_t": """SELECT area, year(d) AS y, month(d) AS mon, xi, yi, sum(val) AS val FROM values_t GROUP BY ALL HAVING sum(val) > 0""",
    "layer_years_t": """SELECT 'all' AS layer, count(DISTINCT d) / 365.2425e0 AS years FROM spine_t
      UNION ALL SELECT 'm' || lpad(CAST(month(d) AS VARCHAR), 2, '0'), CAST(count(DISTINCT year(d)) AS DOUBLE) FROM spine_t WHERE day(d) = 1 GROUP BY month(d)""",
    "area_layers_t": """SELECT 'all' AS layer, area, xi, yi, sum(val) / (SELECT years FROM layer_years_t WHERE layer = 'all') AS val
        FROM cell_months_t GROUP BY area, xi, yi
      UNION ALL SELECT 'y' || y, area, xi, yi, sum(val) FROM cell_months_t GROUP BY y, area, xi, yi
      UNION ALL SELECT l.layer, c.area, c.xi, c.yi, sum(c.val) / any_value(l.years) FROM cell_months_t c
        JOIN layer_years_t l ON l.layer = 'm' || lpad(CAST(c.mon AS VARCHAR), 2, '0') GROUP BY l.layer, c.area, c.xi, c.yi""",
    "all_layers_t": "SELECT layer, xi, yi, max(val) AS val FROM area_layers_t GROUP BY ALL",
    "layers_t": "SELECT * FROM all_layers_t WHERE val >= 0.05e0",
    # ---- live
    "live_t": live_days("feed_t"),
    "mask_t": "SELECT DISTINCT yi, xi FROM static_t",
    "masked_t": "SELECT * FROM live_t l WHERE NOT EXISTS (SELECT 1 FROM mask_t s WHERE s.yi = l.yi AND s.xi = l.xi)",
    "live_points_t": "SELECT DISTINCT yi, xi, CAST(xi AS BIGINT) * 1000 + 500 AS x, CAST(yi AS BIGINT) * 1000 + 500 AS y FROM live_t",
    "inside_t": ray_cast("live_points_t", "yi, xi"),
    "own_t": "SELECT DISTINCT area, yi, xi FROM grid_t",
    "links_t": """SELECT area, yi, xi FROM inside_t UNION
      SELECT o.area, o.yi, o.xi FROM own_t o JOIN (SELECT DISTINCT yi, xi FROM live_t) c ON c.yi = o.yi AND c.xi = o.xi""",
    "masked_days_t": "SELECT d FROM (SELECT DISTINCT d FROM masked_t) WHERE d > (SELECT min(d) FROM masked_t) AND d < (SELECT max(d) FROM masked_t)",
    "window_t": """SELECT CAST(unnest(generate_series(min(d) + INTERVAL 1 DAY, max(d) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM live_t""",
    "now_t": f"""SELECT c.area, w.d, count(x.d) AS cells, CAST(sum(count(x.d)) OVER (PARTITION BY c.area) AS BIGINT) AS total,
        {r(r('sum(coalesce(sum(x.frp), 0)) OVER (PARTITION BY c.area)', 6), 0)} AS frp
      FROM cat_t c CROSS JOIN window_t w
      LEFT JOIN (SELECT k.area, l.d, l.frp FROM live_t l JOIN links_t k ON k.yi = l.yi AND k.xi = l.xi
                 WHERE NOT EXISTS (SELECT 1 FROM static_t s WHERE s.area = k.area AND s.yi = l.yi AND s.xi = l.xi)) x
        ON x.area = c.area AND x.d = w.d GROUP BY c.area, w.d""",
    "past_t": f"""SELECT y, a, CAST(a + CAST(len - 1 AS INT) AS DATE) AS b FROM (
        SELECT y, len, CASE WHEN month(d0) = 2 AND day(d0) = 29 AND NOT (y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0))
                            THEN make_date(y, 2, 28) ELSE make_date(y, month(d0), day(d0)) END AS a
        FROM (SELECT min(d) AS d0, count(*) AS len FROM window_t) CROSS JOIN (SELECT unnest(range({FIRST_FULL}, {LAST_FULL} + 1)) AS y) q)
      WHERE a + CAST(len - 1 AS INT) <= {END}""",
    "history_t": "SELECT s.area, p.y, sum(s.h) AS total FROM series_t s JOIN past_t p ON s.d BETWEEN p.a AND p.b GROUP BY ALL",
}


def _cv(src: str, prior: str, extra: str) -> str:
    rows = f"(SELECT area, y, mon, v, {src} AS x FROM monthly_t WHERE overlap{extra})"
    return f"""SELECT area, y, {r('o', 1)} AS obs, {r('p', 1)} AS pred, {r('raw_sum', 1)} AS raw,
        CASE WHEN o > 0 THEN {r('abs(p - o) / o * 100', 1)} END AS ape
      FROM (SELECT area, y, sum(v) AS o, sum(x) AS raw_sum, sum(x * k) AS p FROM (
        SELECT b.area, b.y, b.v, b.x, (b.vm + 20 * f.k_area) / (b.xm + 20) AS k FROM (
          SELECT z.area, z.y, z.mon, z.v, z.x, coalesce(sum(o.v), 0) AS vm, coalesce(sum(o.x), 0) AS xm
          FROM {rows} z LEFT JOIN {rows} o ON o.area = z.area AND o.mon = z.mon AND o.y <> z.y GROUP BY ALL) b
        JOIN (SELECT yy.area, yy.y, (coalesce(sum(o.v), 0) + 50 * {prior}) / (coalesce(sum(o.x), 0) + 50) AS k_area
              FROM (SELECT area, y FROM {rows} GROUP BY area, y HAVING count(*) = 12) yy
              LEFT JOIN {rows} o ON o.area = yy.area AND o.y <> yy.y GROUP BY ALL) f ON f.area = b.area AND f.y = b.y
      ) GROUP BY area, y)"""


TABLES["cv_m_t"] = _cv("m", PRIOR_K, "")
TABLES["cv_t_t"] = _cv("t", PRIOR_KT, f" AND month < {DRIFT}")

_NAMES = re.compile(r"\b[a-z0-9_]+_t\b")


def sql(final: str, **own: str) -> str:
    """Prefix a SELECT with the blocks it needs, dependencies first; ``own`` adds blocks or puts others in their place."""
    blocks_of = {**TABLES, **own}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _NAMES.findall(text):
            if name in blocks_of and name not in needed:
                visit(blocks_of[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    blocks = ",\n".join(f"{n} AS ({blocks_of[n]})" for n in needed)
    if not blocks:
        return final
    text = final.lstrip()
    # a SELECT with blocks of its own continues the list
    return f"WITH {blocks},\n{text[5:]}" if text.startswith("WITH ") else f"WITH {blocks}\n{text}"
