"""The registered queries in SQL (DuckDB), where SQL can express them."""

from __future__ import annotations

from ..config import DEFAULT as D
from ..functions.columns import LABELS
from ..operators.audio import VARIANTS
from ..operators.calibration import COMPUTES, LEAST_FLOAT, STEPS
from ..operators.audio_kernels import DB4
from ..sources.tables import AXES_SQL, CLIPS_SQL, HELD, LONG, LONG_SQL, PACKETS_SQL
from .queries import NOW, RANGE_START, RANGE_STOP

PI = "3.141592653589793::DOUBLE"


def r(expression: str, name: str) -> str:
    return f"round({expression} + 3.7e-8::DOUBLE, 6) + 0.0 AS {name}"


def sigma(value: str, source: str, window: int = D.window, order: str = "ts, seq") -> str:
    """CTEs w and s: the detector's columns over ``source``."""
    return f"""
w AS (
  SELECT *, count({value}) OVER f AS n, avg({value}) OVER f AS mean, stddev_pop({value}) OVER f AS std
  FROM {source} WHERE {value} IS NOT NULL
  WINDOW f AS (PARTITION BY device_id ORDER BY {order} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)
), s AS (
  SELECT * REPLACE (mean AS mean), n >= {D.min_samples} AS ready, std > 1e-12::DOUBLE * greatest(abs(mean), 1.0::DOUBLE) AS spread,
         mean + {D.sigmas}::DOUBLE * std AS threshold,
         coalesce(n >= {D.min_samples} AND std > 1e-12::DOUBLE * greatest(abs(mean), 1.0::DOUBLE) AND {value} > mean + {D.sigmas}::DOUBLE * std, false) AS anomaly,
         CASE WHEN std > 1e-12::DOUBLE * greatest(abs(mean), 1.0::DOUBLE) THEN ({value} - mean) / std ELSE 0.0::DOUBLE END AS z_score
  FROM w
)"""


FUSED = f"""
fused AS (
  SELECT *, audio_peak > {D.audio_peak}::DOUBLE AS audio_anomaly,
         CASE WHEN anomaly THEN {D.weight_magnetic}::DOUBLE ELSE 0 END + CASE WHEN audio_peak > {D.audio_peak}::DOUBLE THEN {D.weight_audio}::DOUBLE ELSE 0 END
         + CASE WHEN humanoid THEN {D.weight_humanoid}::DOUBLE ELSE 0 END AS correlation_score
  FROM s
), found AS (
  SELECT *, (anomaly OR audio_anomaly) AND correlation_score >= {D.min_score}::DOUBLE AS is_event FROM fused
)"""
DETECTED = f"{PACKETS_SQL}, {sigma('magnitude', 'packets')}, {FUSED}"
ZEROS = ", ".join(r(f"CASE WHEN ready THEN {c} ELSE 0.0::DOUBLE END", c) for c in ("mean", "std", "threshold", "z_score"))
EVENT_ID = "'event_' || CAST(CAST(trunc(({}) ::DOUBLE / 1e9::DOUBLE) AS BIGINT) AS VARCHAR)"


def folded(values: str, source: str, first: str, later: str, order: str = "ts, seq") -> str:
    """CTEs o (numbered rows) and rec (one step a row)."""
    return f"""
o AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY {order}) AS k FROM ({source})),
rec AS (
  SELECT device_id, k, {first} FROM o WHERE k = 1
  UNION ALL
  SELECT o.device_id, o.k, {later} FROM rec JOIN o ON o.device_id = rec.device_id AND o.k = rec.k + 1
)"""


Q, R1, R0 = f"{D.kalman_q}::DOUBLE", f"{D.plain_r}::DOUBLE", f"{D.kalman_r}::DOUBLE"
GAIN = f"((rec.p + {Q}) / (rec.p + {Q} + {R1}))"
PLAIN = folded(
    "", "SELECT device_id, ts, seq, magnitude AS z FROM packets WHERE magnitude IS NOT NULL",
    f"0.0::DOUBLE AS x_prior, z AS x, 1.0::DOUBLE + {Q} AS p, 0.0::DOUBLE AS gain, seq",
    f"rec.x, rec.x + {GAIN} * (o.z - rec.x), (1 - {GAIN}) * (rec.p + {Q}), {GAIN}, o.seq",
)
TRIPLE = folded(
    "", "SELECT * FROM axes", f"x AS fx, y AS fy, z AS fz, 1.0::DOUBLE + {Q} AS p, ts, seq",
    f"rec.fx + {GAIN} * (o.x - rec.fx), rec.fy + {GAIN} * (o.y - rec.fy), rec.fz + {GAIN} * (o.z - rec.fz), (1 - {GAIN}) * (rec.p + {Q}), o.ts, o.seq",
)
VQ, VR = "1e-3::DOUBLE", "0.5::DOUBLE"
#: The covariance after the step of the state (a b; c d), as SQL over rec.
V_A, V_B, V_C, V_D = f"(rec.a + 0.1::DOUBLE * (rec.b + rec.c) + 0.01::DOUBLE * rec.d + {VQ})", "(rec.b + 0.1::DOUBLE * rec.d)", "(rec.c + 0.1::DOUBLE * rec.d)", f"(rec.d + {VQ})"
V_G, V_H, V_Y = f"({V_A} / ({V_A} + {VR}))", f"({V_C} / ({V_A} + {VR}))", "(o.x - rec.x - 0.1::DOUBLE * rec.v)"
VELOCITY = folded(
    "", "SELECT * FROM axes", f"x, 0.0::DOUBLE AS v, 1.01::DOUBLE + {VQ} AS a, 0.1::DOUBLE AS b, 0.1::DOUBLE AS c, 1.0::DOUBLE + {VQ} AS d, ts, seq",
    f"rec.x + 0.1::DOUBLE * rec.v + {V_G} * {V_Y}, rec.v + {V_H} * {V_Y}, (1 - {V_G}) * {V_A}, (1 - {V_G}) * {V_B}, {V_C} - {V_H} * {V_A}, {V_D} - {V_H} * {V_B}, o.ts, o.seq",
)
R_NEXT = f"(CASE WHEN o.v IS NULL THEN rec.r ELSE (1 - {D.adapt_alpha}::DOUBLE) * rec.r + {D.adapt_alpha}::DOUBLE * o.v END)"
A_GAIN = f"((rec.p + {Q}) / (rec.p + {Q} + {R_NEXT}))"
ADAPTIVE = folded(
    "",
    f"""SELECT device_id, ts, seq, magnitude AS z, CASE WHEN count(magnitude) OVER f >= 3 THEN var_pop(magnitude) OVER f END AS v
     FROM packets WHERE magnitude IS NOT NULL WINDOW f AS (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN {D.adapt_window - 1} PRECEDING AND CURRENT ROW)""",
    f"z AS x, 1.0::DOUBLE AS p, {R0} AS r, ts, seq, z",
    f"rec.x + {A_GAIN} * (o.z - rec.x), (1 - {A_GAIN}) * (rec.p + {Q}), {R_NEXT}, o.ts, o.seq, o.z",
)


def _turn() -> str:
    """The orientation filter's step as lateral selections over rec and o."""
    return f"""
o AS (
  SELECT device_id, ts, seq, x AS ax, y AS ay, z AS az, y / 1000 AS gx, x / 100 AS gy, z / 100 AS gz, 0.1::DOUBLE AS dt,
         row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS k FROM axes
), rec AS (
  SELECT device_id, 0::BIGINT AS k, 0::BIGINT AS ts, 0 AS seq, 1.0::DOUBLE AS q0, 0.0::DOUBLE AS q1, 0.0::DOUBLE AS q2, 0.0::DOUBLE AS q3 FROM o WHERE k = 1
  UNION ALL
  SELECT device_id, k, ts, seq, q0 / n, q1 / n, q2 / n, q3 / n FROM (
    SELECT *, sqrt(q0*q0 + q1*q1 + q2*q2 + q3*q3) AS n FROM (
      SELECT device_id, k, ts, seq,
        q0 + (0.5::DOUBLE * (-q1*gx - q2*gy - q3*gz) - 0.1::DOUBLE * (-2 * (q1*f1 + q2*f2 + q3*f3))) * dt AS q0,
        q1 + (0.5::DOUBLE * (q0*gx + q2*gz - q3*gy) - 0.1::DOUBLE * (2 * (q0*f1 + q3*f2 - 2*q1*f3))) * dt AS q1,
        q2 + (0.5::DOUBLE * (q0*gy - q1*gz + q3*gx) - 0.1::DOUBLE * (2 * (q3*f1 + q0*f2 - 2*q2*f3))) * dt AS q2,
        q3 + (0.5::DOUBLE * (q0*gz + q1*gy - q2*gx) - 0.1::DOUBLE * (-2*q2*f1 + 2*q1*f2)) * dt AS q3
      FROM (
        SELECT *, 2*q0*q2 - 2*q1*q3 - ax/m AS f1, 2*q0*q1 + 2*q2*q3 - ay/m AS f2, 1 - 2*q1*q1 - 2*q2*q2 - az/m AS f3 FROM (
          SELECT o.*, rec.q0, rec.q1, rec.q2, rec.q3, sqrt(ax*ax + ay*ay + az*az) AS m
          FROM rec JOIN o ON o.device_id = rec.device_id AND o.k = rec.k + 1
        )
      )
    )
  )
)"""


SERIES = f"""{PACKETS_SQL}, pts AS (
  SELECT 'magnetic' AS measurement, device_id, ts AS time, magnitude * 0.6::DOUBLE AS x, magnitude * 0.0::DOUBLE AS y, magnitude * 0.8::DOUBLE AS z, magnitude FROM packets
  UNION ALL SELECT 'accelerometer', device_id, ts, bluetooth_count::DOUBLE, bluetooth_count::DOUBLE + 1, 9.8::DOUBLE, NULL FROM packets WHERE event_type = 'click'
  UNION ALL SELECT 'gyroscope', device_id, ts, 0.0::DOUBLE, bluetooth_count::DOUBLE, 0.0::DOUBLE, NULL FROM packets WHERE event_type = 'error'
)"""
SESSIONS = """sess AS (
  SELECT *, CAST(sum(CASE WHEN silent THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
  FROM (SELECT *, coalesce(CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY device_id ORDER BY ts, seq) > 86400, false) AS silent FROM {})
)"""
FIT = """fit AS (
  SELECT device_id, {} FROM (
    SELECT device_id, {} FROM axes {} GROUP BY device_id
  )
)""".format(
    ", ".join([*(f"(hi_{a} + lo_{a}) / 2 AS offset_{a}" for a in "xyz"), *(f"CASE WHEN abs(hi_{a} - lo_{a}) > 1e-6::DOUBLE THEN ((hi_x - lo_x) + (hi_y - lo_y) + (hi_z - lo_z)) / 3 / (hi_{a} - lo_{a}) ELSE 1.0::DOUBLE END AS scale_{a}" for a in "xyz")]),
    ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in "xyz"),
    "{}",
)
SPECTRUM = f"""bins AS (
  SELECT clip_id, k, sqrt(sum(v * cos(a)) ^ 2 + sum(v * sin(a)) ^ 2) AS mag FROM (
    SELECT clip_id, k, v, 2 * {PI} * k * i / 64 AS a FROM samples, range({{}}, 32) t(k)
  ) GROUP BY clip_id, k
)"""
STFT = f"""
padded AS (SELECT clip_id, i + 8 AS i, v FROM samples),
frames AS (SELECT clip_id, f AS frame, i - f * 4 AS i, v FROM padded, range(0, 17) t(f) WHERE i >= f * 4 AND i < f * 4 + 16),
bins AS (
  SELECT clip_id, frame, k, 44100 / 16.0::DOUBLE * k AS f, sqrt(sum(w * cos(a)) ^ 2 + sum(w * sin(a)) ^ 2) AS mag FROM (
    SELECT clip_id, frame, k, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * i / 16)) / 8 AS w, 2 * {PI} * k * i / 16 AS a FROM frames, range(0, 9) t(k)
  ) GROUP BY clip_id, frame, k
)"""
SHAPE = """, flux AS (
  SELECT clip_id, max(d) AS fmax, avg(d) AS fmean FROM (SELECT clip_id, mag - lag(mag) OVER (PARTITION BY clip_id, k ORDER BY frame) AS d FROM bins) GROUP BY clip_id
), per AS (
  SELECT clip_id, frame, sum(mag) AS m, sum(f * mag) AS fm, sum(f * f * mag) AS ffm FROM bins GROUP BY clip_id, frame
), cen AS (
  SELECT *, fm / (m + 1e-10::DOUBLE) AS c FROM per
), shape AS (
  SELECT clip_id, var_pop(c) AS cv, avg(sqrt(greatest(ffm - 2 * c * fm + c * c * m, 0.0::DOUBLE) / (m + 1e-10::DOUBLE))) AS sp FROM cen GROUP BY clip_id
)"""
#: Spectra of long clips: the sum over values, times that of one held value, as re + i im.
LONG_SPECTRUM = f"""waves AS MATERIALIZED (
  SELECT k, list_transform(range(0, 1024), lambda j: cos(2 * {PI} * ((k * {HELD} * j) % {LONG}) / {LONG})) AS c, list_transform(range(0, 1024), lambda j: -sin(2 * {PI} * ((k * {HELD} * j) % {LONG}) / {LONG})) AS s,
         CASE WHEN k = 0 THEN {HELD}::DOUBLE ELSE sin({PI} * k * {HELD} / {LONG}) / sin({PI} * k / {LONG}) END AS d, -{PI} * k * {HELD - 1} / {LONG} AS turn
  FROM range(-1, 22051) t(k)
), parts AS (
  SELECT clip_id, k, d, turn, list_dot_product(vals, c) AS re, list_dot_product(vals, s) AS im FROM held, waves
), x AS MATERIALIZED (
  SELECT clip_id, k, d * (re * cos(turn) - im * sin(turn)) AS re, d * (re * sin(turn) + im * cos(turn)) AS im FROM parts
)"""
#: Short-time spectra of long clips: each value times the sum over the window's part that holds it.
LONG_STFT = f"""wave AS (
  SELECT k, n, (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * n / 2048)) * cos(2 * {PI} * ((k * n) % 2048) / 2048) AS c, -(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * n / 2048)) * sin(2 * {PI} * ((k * n) % 2048) / 2048) AS s
  FROM range(0, 1025) t(k), range(0, 2049) u(n)
), cum AS (
  SELECT k, n, sum(c) OVER w - c AS c, sum(s) OVER w - s AS s FROM wave WINDOW w AS (PARTITION BY k ORDER BY n)
), edges AS (
  SELECT f, j, j0, j1, least(greatest({HELD} * j - (512 * f - 1024), 0), 2048) AS n FROM (
    SELECT f, greatest(0, (512 * f - 1024) // {HELD}) AS j0, least(1024, (512 * f + 1024 + {HELD - 1}) // {HELD}) AS j1 FROM range(0, 88) t(f)
  ), range(0, 1025) u(j) WHERE j BETWEEN j0 AND j1
), spans AS (
  SELECT f, k, j, j0, j1, lead(c) OVER w - c AS c, lead(s) OVER w - s AS s FROM edges JOIN cum USING (n) WINDOW w AS (PARTITION BY f, k ORDER BY j)
), weights AS (
  SELECT f, k, j0, j1, list(c ORDER BY j) AS c, list(s ORDER BY j) AS s FROM spans WHERE j < j1 GROUP BY f, k, j0, j1
), bins AS MATERIALIZED (
  SELECT clip_id, f AS frame, k, 44100 / 2048.0::DOUBLE * k AS f,
         sqrt(list_dot_product(list_slice(vals, (j0 + 1)::BIGINT, j1::BIGINT), c) ^ 2 + list_dot_product(list_slice(vals, (j0 + 1)::BIGINT, j1::BIGINT), s) ^ 2) / 1024 AS mag FROM held, weights
)"""


def _wavelet(source: str, levels: int = 6) -> str:
    """CTEs l1 ... and w (clip_id, level, length, energy) over ``source`` (clip_id, samples), each level a list of the one above."""
    taps = [f"{v!r}::DOUBLE" for v in DB4.tolist()]
    high = [f"{v * (-1.0) ** k!r}::DOUBLE" for k, v in enumerate(DB4.tolist()[::-1])]
    parts, above = [f"l0 AS (SELECT clip_id, samples AS a FROM {source})"], "l0"
    for k in range(1, levels + 1):
        wide = f"(SELECT clip_id, len(a) AS n, list_transform(range(-7, len(a) + 7), lambda i: a[CASE WHEN ((i % (2 * len(a))) + 2 * len(a)) % (2 * len(a)) < len(a) THEN ((i % (2 * len(a))) + 2 * len(a)) % (2 * len(a)) ELSE 2 * len(a) - 1 - ((i % (2 * len(a))) + 2 * len(a)) % (2 * len(a)) END + 1]) AS p FROM {above})"
        values = lambda w: f"list_transform(range(0, (n + 7) // 2), lambda i: {' + '.join(f'p[2 * i + {t + 2}] * {v}' for t, v in enumerate(w))})"
        parts.append(f"l{k} AS MATERIALIZED (SELECT clip_id, {values(taps)} AS a, {values(high)} AS d FROM {wide})")
        above = f"l{k}"
    energy = "list_sum(list_transform({0}, lambda v: v * v))"
    rows = [f"SELECT clip_id, {levels - k + 1} AS level, len(d) AS length, {energy.format('d')} AS energy FROM l{k}" for k in range(1, levels + 1)] + [f"SELECT clip_id, 0, len(a), {energy.format('a')} FROM l{levels}"]
    return ", ".join([*parts, f"w AS ({' UNION ALL '.join(rows)})"])


MADE = "(" + " UNION ALL ".join(f"SELECT {k} AS k, '{v}' AS variant" for k, v in enumerate(VARIANTS)) + ")"
CATALOGUE = "cat AS (SELECT o_orderkey AS event_id, o_custkey AS device_id, o_orderdate AS ts, o_orderpriority AS classification, o_totalprice AS confidence FROM orders)"
SIGMA_COLUMNS = f"device_id, seq, n, {ZEROS}, anomaly"
LABEL_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABELS.items())

ORACLE: dict[str, str] = {
    "fused_events": f"""WITH {DETECTED} SELECT device_id, seq, {EVENT_ID.format('epoch_us(ts) * 1000')} AS event_id, {r('magnitude', 'magnitude')}, n,
        {', '.join(r(f'CASE WHEN ready THEN {c} END', c) for c in ('mean', 'std', 'threshold', 'z_score'))}, anomaly, audio_anomaly, humanoid, {r('correlation_score', 'correlation_score')} FROM found WHERE is_event""",
    "rolling_sigma_raw": f"WITH {PACKETS_SQL}, {sigma('magnitude', 'packets')} SELECT {SIGMA_COLUMNS} FROM s",
    "rolling_sigma_w20": f"WITH {PACKETS_SQL}, {sigma('magnitude', 'packets', 20)} SELECT {SIGMA_COLUMNS} FROM s",
    "kalman_1d": f"WITH RECURSIVE {PACKETS_SQL}, {PLAIN} SELECT device_id, seq, {', '.join(r(c, c) for c in ('x_prior', 'x', 'p', 'gain'))} FROM rec",
    "kalman_adaptive": f"WITH RECURSIVE {PACKETS_SQL}, {ADAPTIVE} SELECT device_id, seq, {r('z', 'raw')}, {r('x', 'filtered')}, {r('p', 'p')}, {r('r', 'r')} FROM rec",
    "kalman_3d": f"WITH RECURSIVE {AXES_SQL}, {TRIPLE} SELECT device_id, ts, seq, {r('fx', 'x')}, {r('fy', 'y')}, {r('fz', 'z')}, {r('p', 'p')} FROM rec",
    "ekf_identity": f"WITH RECURSIVE {AXES_SQL}, {TRIPLE} SELECT device_id, ts, seq, {r('fx', 'x')}, {r('fy', 'y')}, {r('fz', 'z')} FROM rec",
    "filtered_sigma": f"""WITH RECURSIVE {PACKETS_SQL}, {ADAPTIVE}, {sigma('x', 'rec')} SELECT device_id, seq, {r('z', 'raw')}, {r('x', 'filtered')}, n, {ZEROS}, anomaly FROM s""",
    "orientation": f"""WITH RECURSIVE {AXES_SQL}, {_turn()} SELECT device_id, ts, seq, {r('atan2(2*(q0*q1 + q2*q3), 1 - 2*(q1*q1 + q2*q2))', 'roll')},
        {r('asin(least(greatest(2*(q0*q2 - q3*q1), -1.0::DOUBLE), 1.0::DOUBLE))', 'pitch')}, {r('atan2(2*(q0*q3 + q1*q2), 1 - 2*(q2*q2 + q3*q3))', 'yaw')} FROM rec WHERE k > 0""",
    "fusion_truth_table": f"""WITH {DETECTED} SELECT anomaly, audio_anomaly, humanoid, {r('correlation_score', 'correlation_score')}, is_event, count(*) AS n FROM found GROUP BY ALL""",
    "correlate_window": f"""WITH {DETECTED}, near AS (
        SELECT *, count(*) OVER f AS buffered, bool_or(anomaly) OVER f AS near_anomaly, bool_or(audio_anomaly) OVER f AS near_audio_anomaly, bool_or(humanoid) OVER f AS near_humanoid
        FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM found) WINDOW f AS (PARTITION BY device_id ORDER BY sec RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW))
        SELECT device_id, seq, buffered, near_anomaly, near_audio_anomaly, near_humanoid, {r('c', 'correlation_score')}, (near_anomaly OR near_audio_anomaly) AND c >= 0.6::DOUBLE AS is_event
        FROM (SELECT *, CASE WHEN near_anomaly THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN near_audio_anomaly THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN near_humanoid THEN 0.2::DOUBLE ELSE 0 END AS c FROM near)""",
    "event_clip_join": f"""WITH {DETECTED} SELECT p.device_id, e.seq AS e_seq, p.seq, {r('p.magnitude', 'magnitude')} FROM found p JOIN found e
        ON e.is_event AND p.device_id = e.device_id AND p.ts >= e.ts - INTERVAL 24 HOURS AND p.ts <= e.ts + INTERVAL 36 HOURS""",
    "timeseries_unpivot": f"WITH {SERIES} SELECT measurement, device_id, epoch_us(time) AS time_us, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')}, {r('coalesce(magnitude, -1.0::DOUBLE)', 'magnitude')} FROM pts",
    "timeseries_range": f"""WITH {SERIES} SELECT device_id, epoch_us(time) AS time_us, {r('x', 'x')}, {r('z', 'z')}, {r('magnitude', 'magnitude')} FROM pts
        WHERE measurement = 'magnetic' AND device_id = 3 AND time >= TIMESTAMP '{RANGE_START}' AND time < TIMESTAMP '{RANGE_STOP}'""",
    "events_list_page": f"""WITH {CATALOGUE} SELECT event_id, device_id, epoch_us(ts) AS ts_us, classification, count(*) OVER () AS total FROM cat
        WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-01-01' AND classification = '1-URGENT' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20""",
    "event_lookup": f"WITH {CATALOGUE} SELECT event_id, device_id, classification, {r('confidence', 'confidence')} FROM cat WHERE event_id = 7",
    "classify_latest": f"""WITH {CATALOGUE}, last AS (SELECT l_orderkey, l_returnflag, l_discount FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_discount DESC, l_returnflag DESC) = 1)
        SELECT event_id, coalesce(l_returnflag, classification) AS classification, {r('coalesce(l_discount, confidence)', 'confidence')} FROM cat LEFT JOIN last ON event_id = l_orderkey""",
    "realtime_stats": f"""WITH {DETECTED}, t AS (SELECT *, TIMESTAMP '{NOW}' AS now FROM found WHERE ts <= TIMESTAMP '{NOW}') SELECT count(DISTINCT device_id) AS connected_clients,
        count(*) FILTER (is_event AND date_trunc('day', ts) = date_trunc('day', now)) AS events_today, {r('avg(magnitude)', 'mean_magnitude')},
        count(*) FILTER (anomaly AND ts > now - INTERVAL 1 HOUR) AS anomalies_last_hour FROM t""",
    "server_counters": f"""WITH {DETECTED}, {SESSIONS.format('found')} SELECT count(*) AS total_packets, count(*) FILTER (is_event) AS total_events,
        count(DISTINCT CASE WHEN ts >= TIMESTAMP '{NOW}' THEN device_id END) AS clients_online, count(DISTINCT (device_id, session_id)) AS total_clients FROM sess""",
    "packet_sessions": f"WITH {PACKETS_SQL}, {SESSIONS.format('packets')} SELECT device_id, seq, session_id FROM sess",
    "rate_limit_rejects": f"""WITH {PACKETS_SQL} SELECT device_id, seq, rank::INT AS rank, 'RATE_LIMIT_EXCEEDED' AS error FROM (
        SELECT *, row_number() OVER (PARTITION BY device_id, date_trunc('month', ts) ORDER BY ts, seq) AS rank FROM packets) WHERE rank > 10""",
    "downsample_last": f"""WITH {PACKETS_SQL} SELECT device_id, epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS window_us, arg_max(seq, (ts, seq)) AS seq,
        {r('arg_max(magnitude, (ts, seq))', 'magnitude')} FROM packets GROUP BY 1, 2""",
    "sync_sensors": f"""WITH {PACKETS_SQL} SELECT c.device_id, epoch_us(c.ts) AS ts_us, {r('coalesce(v.magnitude, -1.0::DOUBLE)', 'magnitude')}
        FROM (SELECT * FROM packets WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM packets WHERE event_type = 'view') v ON c.device_id = v.device_id AND c.ts >= v.ts""",
    "calibrate_mag": f"WITH {AXES_SQL}, {FIT.format('')} SELECT device_id, {', '.join(r(f'{p}_{a}', f'{p}_{a}') for p in ('offset', 'scale') for a in 'xyz')} FROM fit",
    "calibrate_bias": f"WITH {AXES_SQL} SELECT device_id, {r('avg(x)', 'offset_x')}, {r('avg(y)', 'offset_y')}, {r('avg(z) - 9.8::DOUBLE', 'offset_z')} FROM axes GROUP BY device_id",
    "calibration_steps": f"WITH {AXES_SQL} SELECT device_id, step, count(*) AS samples, {r('least(count(*) / 100.0::DOUBLE, 1.0::DOUBLE)', 'progress')}, count(*) >= 100 AS complete FROM axes GROUP BY device_id, step",
    "apply_calibration": f"""WITH {AXES_SQL}, {FIT.format('WHERE device_id % 3 <> 0')} SELECT device_id, ts, seq,
        {', '.join(r(f'({a} - coalesce(offset_{a}, 0.0::DOUBLE)) * coalesce(scale_{a}, 1.0::DOUBLE)', a) for a in 'xyz')} FROM axes LEFT JOIN fit USING (device_id)""",
    "audio_fft": f"""WITH {CLIPS_SQL}, {SPECTRUM.format(1)}, db AS (SELECT *, k * 44100.0::DOUBLE / 64 AS f, 20 * log10(mag + 1e-10::DOUBLE) AS db FROM bins),
        a AS (SELECT clip_id, max(db) FILTER (f > 18000) AS hi, arg_max(f, (db, -k)) AS pf, max(db) AS peak, avg(db) FILTER (f >= 80 AND f <= 4000) AS voice FROM db GROUP BY clip_id)
        SELECT clip_id, {r('hi', 'ultrasound_power_db')}, {r('pf', 'peak_frequency_hz')}, {r('peak', 'peak_power_db')}, {r('voice', 'voice_band_energy_db')},
        hi > -40 OR peak > -20 AS anomaly, {r('least(CASE WHEN hi > -40 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN peak > -20 THEN 0.2::DOUBLE ELSE 0 END, 1.0::DOUBLE)', 'confidence')} FROM a""",
    "audio_zcr": f"""WITH {CLIPS_SQL}, pad AS (SELECT clip_id, j, list_extract(samples, CAST(least(greatest(j - 8, 0), 63) AS INT) + 1) < -1e-10::DOUBLE AS neg FROM clips, range(0, 80) t(j)),
        ch AS (SELECT clip_id, j, neg <> lag(neg) OVER (PARTITION BY clip_id ORDER BY j) AS c FROM pad),
        fr AS (SELECT clip_id, f, count(*) FILTER (c) / 16.0::DOUBLE AS zcr FROM ch, range(0, 17) t(f) WHERE j > f * 4 AND j < f * 4 + 16 GROUP BY clip_id, f)
        SELECT clip_id, {r('avg(zcr)', 'zcr_mean')}, {r('stddev_pop(zcr)', 'zcr_std')}, {r('max(zcr)', 'zcr_max')}, avg(zcr) > 0.15::DOUBLE AS high_zcr, stddev_pop(zcr) > 0.05::DOUBLE AS variable_zcr FROM fr GROUP BY clip_id""",
    "client_spectrum": f"""WITH {CLIPS_SQL.replace('unnest(samples) AS v FROM clips', f'unnest(samples) AS v0 FROM clips')}, h AS (SELECT clip_id, i, v0 * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * i / 64)) AS v FROM samples),
        {SPECTRUM.format(0).replace('FROM samples,', 'FROM h,')} SELECT clip_id, {r('arg_max(k, (round(mag, 9), -k)) * 44100.0::DOUBLE / 64', 'peak_frequency')}, {r('max(mag)', 'peak_magnitude')} FROM bins GROUP BY clip_id""",
    "audio_stft": f"WITH {CLIPS_SQL}, {STFT}{SHAPE} SELECT clip_id, {r('fmax', 'flux_max')}, {r('fmean', 'flux_mean')}, {r('round(cv, 2)', 'centroid_variance')}, {r('sp', 'spread_mean')} FROM flux JOIN shape USING (clip_id)",
    "audio_ensemble_vote": f"""WITH {CLIPS_SQL}, m AS (SELECT clip_id, (clip_id * 7 + k * 5 + label) % 6 AS mark FROM clips, {MADE}),
        v AS (SELECT clip_id, count(*) AS n, count(*) FILTER (mark < 2) AS votes, sum(mark / 5.0::DOUBLE / 6) AS c FROM m WHERE mark <> 5 GROUP BY clip_id)
        SELECT clip_id, n > 0 AND (2 * votes >= n OR c > 0.5::DOUBLE) AS anomaly_detected, {r('c', 'confidence')}, n AS num_variants, votes AS num_anomalies_detected FROM v""",
    "sensor_features": f"""SELECT l_orderkey AS event_id, {r('avg(l_extendedprice)', 'mag_mean')}, {r('coalesce(stddev_samp(l_extendedprice), -1.0::DOUBLE)', 'mag_std')}, {r('max(l_extendedprice)', 'mag_max')}, {r('min(l_extendedprice)', 'mag_min')},
        {r('avg(sqrt(l_quantity*l_quantity + l_tax*l_tax + l_discount*l_discount))', 'accel_mean')}, {r('avg(sqrt(l_discount*l_discount + l_tax*l_tax))', 'gyro_mean')},
        {r('arg_max(l_quantity, (l_linenumber, l_suppkey, l_quantity))', 'last_yaw')}, {r('max(l_discount)', 'audio_peak_max')}, bool_or(l_returnflag = 'R') AS humanoid_any, {r('avg(l_linenumber)', 'bluetooth_mean')} FROM lineitem GROUP BY l_orderkey""",
    "classification_metrics": f"""WITH c AS (SELECT quality AS l, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), k AS (SELECT l AS x FROM c UNION SELECT p FROM c),
        f AS (SELECT x, 2.0::DOUBLE * coalesce(sum(n) FILTER (l = x AND p = x), 0) / (coalesce(sum(n) FILTER (l = x), 0) + coalesce(sum(n) FILTER (p = x), 0)) AS f1 FROM c, k GROUP BY x)
        SELECT {r('(SELECT sum(n) FILTER (l = p)::DOUBLE / sum(n) FROM c)', 'accuracy')}, {r('avg(f1)', 'macro_f1')} FROM f""",
    "confusion": "SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2",
    "pose_flag": f"WITH {CLIPS_SQL} SELECT clip_id, count(*) FILTER (v > 0.1::DOUBLE) >= 12 AS humanoid FROM samples GROUP BY clip_id",
    "embedding_meanpool": f"WITH {CLIPS_SQL} SELECT label, i::INT AS dim, {r('avg(v)', 'mean')} FROM samples JOIN clips USING (clip_id) GROUP BY label, i",
    "embedding_concat": f"WITH {CLIPS_SQL} SELECT clip_id, dim::INT AS dim, {r('v', 'v')} FROM (SELECT clip_id, i AS dim, v FROM samples UNION ALL SELECT clip_id, 127 - i, v FROM samples)",
    "label_softmax": f"""WITH {CLIPS_SQL}, e AS (SELECT clip_id, i, exp(v - max(v) OVER (PARTITION BY clip_id)) AS e FROM samples)
        SELECT clip_id, {r('max(e) / sum(e)', 'confidence')}, arg_max(i, (e, -i))::INT AS class FROM e GROUP BY clip_id""",
    "scalar_functions": f"""WITH {PACKETS_SQL} SELECT device_id, seq, {EVENT_ID.format('epoch_us(ts) * 1000 + 999')} AS event_id, 'event_' || strftime(ts, '%Y%m%d_%H%M%S') AS calendar_id,
        {r('20 * log10(abs(magnitude) + 1e-10::DOUBLE)', 'db')}, {r('10 * log10(magnitude + 1e-10::DOUBLE)', 'power_db')}, {r('sqrt(magnitude*magnitude + 4*magnitude*magnitude + 4*magnitude*magnitude)', 'norm')},
        {r('least(greatest((seq % 150) / 100.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)', 'progress')}, (seq % 101) < 20 AS low_power, {r('(seq - 100 - 3.5::DOUBLE)', '"offset"')}, CASE WHEN humanoid THEN 3 ELSE 0 END AS label FROM packets""",
    "packet_errors": f"""WITH c AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 'INVALID_JSON' WHEN event_id % 13 = 0 THEN 'MISSING_TIMESTAMP' WHEN event_id % 11 = 0 THEN 'MISSING_DEVICE'
        WHEN event_id % 7 = 0 THEN 'INVALID_AUDIO_PEAK' ELSE '' END AS error FROM events)
        SELECT event_id AS id, error, CASE WHEN error = '' THEN 'd' || user_id ELSE '' END AS device_id, CASE WHEN error = '' THEN epoch_us(ts) ELSE 0 END AS ts_us,
        {r("CASE WHEN error <> '' THEN 0.0::DOUBLE WHEN event_id % 5 = 0 THEN -1.0::DOUBLE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE ELSE event_id + 0.25::DOUBLE END", 'magnitude')},
        {r("CASE WHEN error = '' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END", 'audio_peak')}, false AS humanoid FROM c""",
    "calibrate_mag_literal": f"""WITH {AXES_SQL}, turned AS (SELECT device_id, {', '.join(f'CASE WHEN device_id % 2 = 0 THEN -{a} ELSE {a} END AS {a}' for a in 'xyz')} FROM axes),
        fit AS (SELECT device_id, {', '.join(f'min({a}) AS lo_{a}, greatest(max({a}), {LEAST_FLOAT}::DOUBLE) AS hi_{a}' for a in 'xyz')} FROM turned GROUP BY device_id)
        SELECT device_id, {', '.join([*(r(f'(hi_{a} + lo_{a}) / 2', f'offset_{a}') for a in 'xyz'), *(r(f'CASE WHEN abs(hi_{a} - lo_{a}) > 1e-6::DOUBLE THEN ((hi_x - lo_x) + (hi_y - lo_y) + (hi_z - lo_z)) / 3 / (hi_{a} - lo_{a}) ELSE 1.0::DOUBLE END', f'scale_{a}') for a in 'xyz')])} FROM fit""",
    "calibrate_gyro": f"WITH {AXES_SQL} SELECT device_id, {r('avg(x)', 'offset_x')}, {r('avg(y)', 'offset_y')}, {r('avg(z)', 'offset_z')} FROM axes GROUP BY device_id",
    "calibration_wizard": f"""WITH {AXES_SQL}, steps(place, step, computes, next_step) AS (VALUES {', '.join(f"({k}, '{s}', '{COMPUTES.get(s, '')}', '{STEPS[min(k + 1, len(STEPS) - 1)]}')" for k, s in enumerate(STEPS))}),
        taking AS (SELECT *, row_number() OVER (ORDER BY place) - 1 AS k FROM steps WHERE NOT regexp_matches(step, '^(WELCOME|PREPARE)')),
        c AS (SELECT device_id, least((row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) - 1) // 20, 9) AS k FROM axes), g AS (SELECT device_id, k, count(*) AS samples FROM c GROUP BY ALL)
        SELECT device_id, place, step, samples, samples >= 20 OR k = 9 AS complete, CASE WHEN samples >= 20 OR k = 9 THEN computes ELSE '' END AS computes, next_step FROM g JOIN taking USING (k)""",
    "stored_calibrations": f"""WITH {AXES_SQL}, {FIT.format('WHERE device_id % 3 <> 0')} SELECT d.device_id, {', '.join([*(r(f'coalesce(offset_{a}, 0.0::DOUBLE)', f'offset_{a}') for a in 'xyz'), *(r(f'coalesce(scale_{a}, 1.0::DOUBLE)', f'scale_{a}') for a in 'xyz')])},
        CASE WHEN fit.device_id IS NULL THEN 0 ELSE d.device_id * 1000 END::BIGINT AS timestamp, fit.device_id IS NOT NULL AS calibrated FROM (SELECT DISTINCT device_id FROM axes) d LEFT JOIN fit ON fit.device_id = d.device_id""",
    "ack_messages": """SELECT user_id AS device_id, '{"type":"ack","timestamp":' || (epoch_us(ts) * 1000) || ',"status":"ok"}' AS message FROM events""",
    "pcm_samples": f"SELECT event_id AS seq, {r('(event_id % 32768) / 32768.0::DOUBLE', 'a')}, {r('(-(event_id * 3 % 32768) - 1) / 32768.0::DOUBLE', 'b')} FROM events",
    "session_clock": "SELECT user_id AS device_id, event_id AS seq, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS since FROM events",
    "one_shot_test": f"""WITH v AS (SELECT value AS v FROM (SELECT * FROM events ORDER BY event_id LIMIT 99) UNION ALL SELECT 95.5::DOUBLE), s AS (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM v)
        SELECT 95.5::DOUBLE AS raw, 95.5::DOUBLE AS filtered, {r('mean', 'mean')}, {r('std', 'std')}, {r(f'mean + {D.sigmas}::DOUBLE * std', 'threshold')}, {r('(95.5::DOUBLE - mean) / std', 'z_score')}, 95.5::DOUBLE > mean + {D.sigmas}::DOUBLE * std AS anomaly FROM s""",
}


ORACLE["correlation_engine"] = f"""WITH {DETECTED} SELECT device_id, seq, count(*) OVER (PARTITION BY device_id ORDER BY epoch_us(ts) RANGE BETWEEN {6 * 3600 * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS buffered,
    {r('correlation_score', 'correlation_score')}, correlation_score >= {D.min_score}::DOUBLE AS is_correlated FROM fused"""
_EITHER = "CASE WHEN count(*) OVER t <= 12 THEN {0} OVER t ELSE {0} OVER n END"
ORACLE["sliding_buffer"] = f"""WITH {PACKETS_SQL}, p AS (SELECT *, epoch_us(ts) AS us FROM packets), b AS (
      SELECT device_id, seq, least(count(*) OVER t, 12) AS buffered, {_EITHER.format('min(us)')} AS oldest, {_EITHER.format('avg(magnitude)')} AS a, {_EITHER.format('min(magnitude)')} AS lo, {_EITHER.format('max(magnitude)')} AS hi FROM p
      WINDOW t AS (PARTITION BY device_id ORDER BY us RANGE BETWEEN {5 * 24 * 3600 * 1_000_000 - 1} PRECEDING AND CURRENT ROW), n AS (PARTITION BY device_id ORDER BY us, seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
    ) SELECT device_id, seq, buffered, oldest, {r('a', 'buffer_mean')}, {r('lo', 'buffer_min')}, {r('hi', 'buffer_max')} FROM b"""
ORACLE["anomaly_messages"] = f"""WITH {DETECTED} SELECT device_id, 'anomaly_detected' AS type, {EVENT_ID.format('epoch_us(ts) * 1000')} AS event_id, epoch_us(ts) * 1000 AS timestamp, {r('correlation_score', 'score')},
    {', '.join(r(f'CASE WHEN anomaly THEN {c} ELSE -1.0::DOUBLE END', c) for c in ('mean', 'std', 'threshold', 'z_score'))}, {r('CASE WHEN audio_anomaly THEN audio_peak ELSE -1.0::DOUBLE END', 'peak')},
    CASE WHEN audio_anomaly THEN 'audio_peak_threshold' ELSE '' END AS reason, CASE WHEN humanoid THEN 'true' ELSE '' END AS humanoid FROM found WHERE is_event"""
ORACLE["pose_confidence"] = f"WITH {CLIPS_SQL} SELECT clip_id, count(*) FILTER (v > 0.3::DOUBLE) >= 5 AS humanoid, {r('avg(v)', 'confidence')} FROM samples GROUP BY clip_id"
CLOCKS = f"""{PACKETS_SQL}, asked AS (
  SELECT device_id, seq, epoch_us(ts) AS t1, 2000 + seq * 7919 % 50000 AS trip FROM packets WHERE event_type = 'view'
), trips AS (
  SELECT device_id, t1 AS client_time, t1 + trip + seq % 500 AS received_at, trip AS round_trip, t1 + device_id * 1000 + seq % 13 + trip // 2 - t1 - trip / 2.0::DOUBLE AS off FROM asked WHERE seq % 7 <> 0
)"""
ORACLE["clock_round_trips"] = f"WITH {CLOCKS} SELECT device_id, client_time, received_at, round_trip, {r('off', 'offset')} FROM trips"
ORACLE["clock_sync"] = f"""WITH {CLOCKS}, best AS (
      SELECT device_id, received_at AS seen, client_time, arg_min(off, (round_trip, -received_at, -client_time)) OVER (PARTITION BY device_id ORDER BY received_at, client_time ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS off FROM trips
    ), p AS (SELECT device_id, seq, epoch_us(ts) AS client_time FROM packets), j AS (
      SELECT p.*, coalesce(b.off, 0.0::DOUBLE) AS off FROM p ASOF LEFT JOIN (SELECT device_id, seen, arg_max(off, client_time) AS off FROM best GROUP BY ALL) b ON b.device_id = p.device_id AND b.seen <= p.client_time
    ) SELECT device_id, seq, client_time, {r('off', 'offset')}, floor(client_time + off)::BIGINT AS server_time FROM j"""
ORACLE["event_bundles"] = f"""WITH {CLIPS_SQL} SELECT 'event/' || clip_id AS event_id, 44100 AS sample_rate, len(samples)::INT AS n, list_sum(list_transform(samples, lambda v: least(greatest(floor(v * 32768), -32768), 32767)))::BIGINT AS pcm_sum,
    {r('least(greatest(floor(samples[-1] * 32768), -32768), 32767) / 32768.0::DOUBLE', 'last')}, {r('samples[1] + samples[2] + samples[3]', 'magnitudes')}, len(list_filter(samples[1:3], lambda v: v > 0))::INT AS humanoids, label::BIGINT AS label FROM clips"""
_TOKENS = "least(3.0::DOUBLE, rec.tokens + (o.us - rec.us) * (1.0::DOUBLE / 86400 / 1e6::DOUBLE))"
ORACLE["token_bucket"] = f"""WITH RECURSIVE {PACKETS_SQL}, {folded('', 'SELECT device_id, ts, seq, epoch_us(ts) AS us FROM packets', 'us, seq, 2.0::DOUBLE AS tokens, true AS ok', f'o.us, o.seq, CASE WHEN {_TOKENS} >= 1 THEN {_TOKENS} - 1 ELSE {_TOKENS} END, {_TOKENS} >= 1')}
    SELECT device_id, seq, {r('tokens', 'tokens')}, CASE WHEN ok THEN '' ELSE 'RATE_LIMIT_EXCEEDED' END AS error FROM rec"""
_BETTER, _LEAST = "(o.z < rec.best * (1 - 1e-4::DOUBLE))", "(o.z < rec.least)"
_BAD = f"(CASE WHEN {_BETTER} THEN 0 ELSE rec.bad0 + 1 END)"
SCHEDULE = folded(
    "", "SELECT device_id, ts, seq, magnitude AS z FROM packets",
    "z AS loss, z AS best, 0 AS bad0, 1e-3::DOUBLE AS rate, z AS least, 0 AS wait",
    f"""o.z, CASE WHEN {_BETTER} THEN o.z ELSE rec.best END, CASE WHEN {_BAD} > 5 THEN 0 ELSE {_BAD} END, CASE WHEN {_BAD} > 5 AND rec.rate * 0.5::DOUBLE > 1e-8::DOUBLE THEN rec.rate * 0.5::DOUBLE ELSE rec.rate END,
    CASE WHEN {_LEAST} THEN o.z ELSE rec.least END, CASE WHEN {_LEAST} THEN 0 ELSE rec.wait + 1 END""",
)
ORACLE["training_schedule"] = f"""WITH RECURSIVE {PACKETS_SQL}, {SCHEDULE}, e AS (SELECT device_id, k, loss, rate, bad0, wait, wait >= 10 OR k >= 50 AS stopped FROM rec)
    SELECT device_id, k::INT AS epoch, {r('loss', 'loss')}, {r('rate', 'rate')}, bad0 AS bad, wait, stopped FROM e QUALIFY k <= coalesce(min(CASE WHEN stopped THEN k END) OVER (PARTITION BY device_id), 50)"""
_FLAGS = "CASE WHEN {} THEN {}::DOUBLE ELSE 0 END"
ORACLE["audio_fft_long"] = f"""WITH {LONG_SQL}, {LONG_SPECTRUM}, db AS (SELECT clip_id, k, k * 44100.0::DOUBLE / {LONG} AS f, 20 * log10(sqrt(re * re + im * im) + 1e-10::DOUBLE) AS db FROM x WHERE k BETWEEN 1 AND 22049),
    a AS (SELECT clip_id, max(db) FILTER (f < 20) AS lo, max(db) FILTER (f > 18000) AS hi, arg_max(f, (db, -k)) AS pf, max(db) AS peak, avg(db) FILTER (f >= 80 AND f <= 4000) AS voice FROM db GROUP BY clip_id)
    SELECT clip_id, {r('lo', 'infrasound_power_db')}, {r('hi', 'ultrasound_power_db')}, {r('pf', 'peak_frequency_hz')}, {r('peak', 'peak_power_db')}, {r('voice', 'voice_band_energy_db')},
    lo > -40 OR hi > -40 OR peak > -20 AS anomaly, {r(f"least({_FLAGS.format('lo > -40', 0.4)} + {_FLAGS.format('hi > -40', 0.4)} + {_FLAGS.format('peak > -20', 0.2)}, 1.0::DOUBLE)", 'confidence')} FROM a"""
ORACLE["client_spectrum_long"] = f"""WITH {LONG_SQL}, {LONG_SPECTRUM}, h AS (
      SELECT clip_id, k, 0.5::DOUBLE * re - 0.25::DOUBLE * (lag(re) OVER w + lead(re) OVER w) AS re, 0.5::DOUBLE * im - 0.25::DOUBLE * (lag(im) OVER w + lead(im) OVER w) AS im FROM x WINDOW w AS (PARTITION BY clip_id ORDER BY k)
    ), m AS (SELECT clip_id, k, sqrt(re * re + im * im) AS mag FROM h WHERE k BETWEEN 0 AND 22049)
    SELECT clip_id, {r(f"arg_max(k, (round(mag, 9), -k)) * 44100.0::DOUBLE / {LONG}", 'peak_frequency')}, {r('max(mag)', 'peak_magnitude')} FROM m GROUP BY clip_id"""
ORACLE["audio_stft_long"] = f"""WITH {LONG_SQL}, {LONG_STFT}{SHAPE} SELECT clip_id, {r('fmax', 'flux_max')}, {r('fmean', 'flux_mean')}, {r('round(cv, 2)', 'centroid_variance')}, {r('sp', 'spread_mean')},
    fmax > 10 OR cv > 1e6::DOUBLE AS anomaly, {r(f"{_FLAGS.format('fmax > 10', 0.6)} + {_FLAGS.format('cv > 1e6::DOUBLE', 0.4)}", 'confidence')} FROM flux JOIN shape USING (clip_id)"""
ORACLE["audio_wavelet"] = f"""WITH {CLIPS_SQL}, {_wavelet('clips')}, s AS (SELECT clip_id, {', '.join(f'max(energy / length) FILTER (level = {k}) AS wavelet_energy_level_{k}' for k in range(7))},
      max(energy) FILTER (level = 6) / (sum(energy) + 1e-10::DOUBLE) AS hi, max(energy) FILTER (level = 0) / (sum(energy) + 1e-10::DOUBLE) AS lo FROM w GROUP BY clip_id)
    SELECT clip_id, {', '.join(r(f'wavelet_energy_level_{k}', f'wavelet_energy_level_{k}') for k in range(7))}, {r('hi', 'high_level_energy_ratio')}, {r('lo', 'low_level_energy_ratio')},
    hi > 0.1::DOUBLE OR lo > 0.5::DOUBLE AS anomaly, {r(f"{_FLAGS.format('hi > 0.1::DOUBLE', 0.5)} + {_FLAGS.format('lo > 0.5::DOUBLE', 0.5)}", 'confidence')} FROM s"""
ORACLE["audio_wavelet_levels"] = f"""WITH {LONG_SQL}, long AS (SELECT clip_id, list_resize(flatten(list_transform(vals, lambda v: list_transform(range(0, {HELD}), lambda i: v))), {LONG}, 0.0::DOUBLE) AS samples FROM held), {_wavelet('long')}
    SELECT clip_id, level, length::INT AS length, {r('energy', 'energy')} FROM w"""


def _mel(bands: int) -> str:
    """CTEs up to db (clip_id, band, db): clips of 64 samples are one frame, in the middle of its window."""
    return f"""{CLIPS_SQL}, waves AS MATERIALIZED (
      SELECT k, list_transform(range(0, 64), lambda i: (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * (1024 + i) / 2048)) * cos(2 * {PI} * ((k * i) % 2048) / 2048)) AS c,
             list_transform(range(0, 64), lambda i: (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * (1024 + i) / 2048)) * sin(2 * {PI} * ((k * i) % 2048) / 2048)) AS s FROM range(0, 1025) t(k)
    ), power AS MATERIALIZED (
      SELECT clip_id, k, list_dot_product(samples, c) ^ 2 + list_dot_product(samples, s) ^ 2 AS p FROM clips, waves
    ), mels AS (
      SELECT j, j * (15 + ln(22050 / 1000.0::DOUBLE) / (ln(6.4::DOUBLE) / 27)) / {bands + 1} AS m FROM range(0, {bands + 2}) t(j)
    ), edges AS (
      SELECT j, CASE WHEN m < 15 THEN m * (200 / 3.0::DOUBLE) ELSE 1000 * exp(ln(6.4::DOUBLE) / 27 * (m - 15)) END AS e FROM mels
    ), bank AS (
      SELECT a.j AS band, k, greatest(0, least((k * 44100 / 2048.0::DOUBLE - a.e) / (b.e - a.e), (c.e - k * 44100 / 2048.0::DOUBLE) / (c.e - b.e))) * (2 / (c.e - a.e)) AS w
      FROM edges a JOIN edges b ON b.j = a.j + 1 JOIN edges c ON c.j = a.j + 2, range(0, 1025) t(k)
    ), mel AS (
      SELECT clip_id, band, greatest(sum(p * w), 1e-10::DOUBLE) AS v FROM power JOIN bank USING (k) GROUP BY clip_id, band
    ), top AS (
      SELECT *, 10 * log10(v) - 10 * log10(max(v) OVER (PARTITION BY clip_id)) AS d FROM mel
    ), db AS (
      SELECT clip_id, band, greatest(d, max(d) OVER (PARTITION BY clip_id) - 80) AS db FROM top
    )"""


ORACLE["audio_mel"] = f"WITH {_mel(128)} SELECT clip_id, band::INT AS band, 0 AS frame, {r('db', 'db')} FROM db"
ORACLE["audio_filterbank"] = f"""WITH {_mel(32)}, part AS (SELECT *, db - min(db) OVER (PARTITION BY clip_id) AS q FROM db), norm AS (SELECT *, q / (sum(q) OVER (PARTITION BY clip_id) + 1e-10::DOUBLE) AS h FROM part),
    e AS (SELECT clip_id, -sum(h * log2(h + 1e-10::DOUBLE)) AS entropy, max(db) AS top, arg_max(band, (db, -band))::DOUBLE AS best FROM norm GROUP BY clip_id)
    SELECT clip_id, band::INT AS band, {r('db', 'db')}, {r('best', 'max_band_index')}, {r('entropy', 'band_entropy')}, entropy < 3 OR top > -30 AS anomaly, {r(f"{_FLAGS.format('entropy < 3', 0.4)} + {_FLAGS.format('top > -30', 0.6)}", 'confidence')} FROM db JOIN e USING (clip_id)"""
ORACLE["audio_welch"] = f"""WITH {CLIPS_SQL.replace('unnest(samples) AS v FROM clips', 'unnest(samples) AS v0 FROM clips')}, h AS (
      SELECT clip_id, i, (v0 - avg(v0) OVER (PARTITION BY clip_id)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * i / 64)) AS v FROM samples
    ), bins AS (
      SELECT clip_id, k, (sum(v * cos(a)) ^ 2 + sum(v * sin(a)) ^ 2) / (44100 * (SELECT sum((0.5::DOUBLE - 0.5::DOUBLE * cos(2 * {PI} * i / 64)) ^ 2) FROM range(0, 64) t(i))) * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS p
      FROM (SELECT clip_id, k, v, 2 * {PI} * k * i / 64 AS a FROM h, range(0, 33) t(k)) GROUP BY clip_id, k
    ), db AS (SELECT clip_id, k, k * 44100 / 64.0::DOUBLE AS f, p, 10 * log10(p + 1e-10::DOUBLE) AS db FROM bins)
    SELECT clip_id, coalesce(max(db) FILTER (f < 20) > -40, false) AS infrasound, coalesce(max(db) FILTER (f > 18000) > -40, false) AS ultrasound, {r('arg_max(f, (p, -k))', 'peak_frequency')}, {r('max(db)', 'peak_power_db')} FROM db GROUP BY clip_id"""
_TIMES = "list_transform(range(1, len(f) + 1), lambda i: {} + k * {})"
ORACLE["audio_prediction"] = f"""WITH RECURSIVE {CLIPS_SQL}, rec AS (
      SELECT clip_id, 0 AS m, samples[2:] AS f, samples[:63] AS b, [1.0::DOUBLE] AS c FROM clips
      UNION ALL
      SELECT clip_id, m + 1, ({_TIMES.format('f[i]', 'b[i]')})[2:], ({_TIMES.format('b[i]', 'f[i]')})[:-2], list_transform(range(1, len(w) + 1), lambda i: w[i] + k * w[len(w) + 1 - i])
      FROM (SELECT *, list_append(c, 0.0::DOUBLE) AS w, -2 * list_dot_product(f, b) / (list_dot_product(f, f) + list_dot_product(b, b) + 2.2250738585072014e-308::DOUBLE) AS k FROM rec WHERE m < 12)
    ) SELECT clip_id, place::INT AS place, {r('c[place + 1]', 'coefficient')} FROM rec, range(0, 13) t(place) WHERE m = 12"""
ORACLE["video_frames"] = "SELECT c_custkey AS video_id, k::INT AS k, (k * (c_custkey * 7 % 5000) // 149)::INT AS frame FROM customer, range(0, 150) t(k)"
ORACLE["clip_lengths"] = f"""WITH {CLIPS_SQL} SELECT clip_id, 40 AS n_cut, {r('list_sum(samples[1:40])', 'cut_sum')}, 100 AS n_filled, {r('list_sum(samples)', 'filled_sum')}, 0.0::DOUBLE AS last, {r('(samples[1] + samples[64]) / 2', 'first_mono')}, 64 AS n_mono FROM clips"""
ORACLE["pcm_of_texts"] = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), v AS (SELECT doc_id, list_transform(regexp_extract_all(h, '[0-9A-F]{4}'), lambda x: ('0x' || x[3:4] || x[1:2])::INT) AS v FROM h)
    SELECT doc_id, len(v)::INT AS n, coalesce(list_sum(list_transform(v, lambda x: CASE WHEN x >= 32768 THEN x - 65536 ELSE x END)), 0)::BIGINT AS total FROM v"""
ORACLE["formants_valid"] = f"""WITH {CLIPS_SQL}, f AS (SELECT clip_id, list_sort(list_filter(list_transform(samples, lambda v: abs(v) * 20000), lambda x: x > 250 AND x < 3800)) AS f FROM clips)
    SELECT clip_id, k::INT AS k, {r('f[k + 1]', 'frequency')} FROM f, range(0, 64) t(k) WHERE k < len(f) UNION ALL SELECT clip_id, -1, 0.0::DOUBLE FROM f WHERE len(f) = 0"""
ORACLE["catalogue_upsert"] = f"""WITH {CATALOGUE} SELECT event_id, device_id, epoch_us(ts) AS ts_us, classification, {r('CASE WHEN event_id % 5 = 0 THEN -confidence ELSE confidence END', 'confidence')} FROM cat
    UNION ALL SELECT -event_id, device_id, epoch_us(ts), 'new', {r('confidence', 'confidence')} FROM cat WHERE event_id % 5 = 0"""
ORACLE["broadcast_messages"] = f"WITH {DETECTED} SELECT device_id, {EVENT_ID.format('epoch_us(ts) * 1000')} AS event_id, seq, n_nationkey AS client_id FROM found, nation WHERE is_event"
ORACLE["best_checkpoints"] = f"SELECT {r('o_totalprice', 'val_loss')}, o_orderkey AS epoch FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 3)"
ORACLE["calibration_store"] = f"WITH {AXES_SQL}, {FIT.format('')} SELECT device_id::VARCHAR AS device_id, {', '.join(r(f'{p}_{a}', f'{p}_{a}') for p in ('offset', 'scale') for a in 'xyz')}, device_id * 1000 AS timestamp, true AS calibrated FROM fit"
ORACLE["wav_files"] = f"WITH {CLIPS_SQL} SELECT 'event_' || clip_id AS event_id, 44100 AS sample_rate, 100 AS n, {r('list_sum(list_transform(samples, lambda v: least(greatest(floor(v * 32768), -32768), 32767))) / 32768.0::DOUBLE', 'total')} FROM clips"
ORACLE["event_metadata"] = f"WITH {CLIPS_SQL} SELECT 'event_' || clip_id AS event_id, clip_id, label::BIGINT AS label FROM clips"
for _name in ("kalman_1d", "kalman_adaptive", "kalman_3d"):
    ORACLE[f"{_name}_split"] = ORACLE[_name]
ORACLE["kalman_velocity"] = ORACLE["kalman_velocity_split"] = f"WITH RECURSIVE {AXES_SQL}, {VELOCITY} SELECT device_id, ts, seq, {r('x', 'position')}, {r('v', 'speed')}, {r('a + d', 'trace')} FROM rec"


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
