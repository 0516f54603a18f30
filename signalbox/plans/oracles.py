"""The same results in plain SQL (DuckDB dialect) over the same tables, written independently."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ROAD = """
road AS (SELECT event_id, user_id AS segment_id, ts AS datetime, value AS speed FROM events)
"""

RAIL = """
rail AS (
  SELECT event_id, ts AS "timestamp", 'L' || (user_id % 10) AS line, CAST(user_id AS VARCHAR) AS sta,
         CAST(event_type = 'error' AS INTEGER) AS isdelay,
         CASE WHEN event_type <> 'view' THEN value END AS up_ttnt_1,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS down_ttnt_1
  FROM events)
"""


def calendar(ts: str) -> str:
    return f"""CAST(hour({ts}) AS INTEGER) AS hour, CAST(isodow({ts}) - 1 AS INTEGER) AS day_of_week,
      CAST(isodow({ts}) >= 6 AS INTEGER) AS is_weekend,
      CAST(hour({ts}) IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_peak"""


def rounded(x: str, digits: int) -> str:
    """printf rounds the exact binary value, ties to even."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def percent(x: str) -> str:
    """One decimal, with the exact ties (odd quarters) rounded up."""
    p = f"(({x}) * 100)"
    return (
        f"CASE WHEN {p} * 4 = floor({p} * 4) AND CAST(floor({p} * 4) AS BIGINT) % 2 = 1 "
        f"THEN printf('%.1f', {p} + 0.01) ELSE printf('%.1f', {p}) END || '%'"
    )


# ---- documents -------------------------------------------------------------------------------

_XML = """
SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:00:00') AS time, user_id AS segment_id,
       value AS speed, event_type = 'signup' AND value > 100 AS bad
FROM events WHERE event_type <> 'error'
"""
ORACLES["xml_flatten"] = f"SELECT date, time, segment_id, speed FROM ({_XML}) WHERE NOT bad"
ORACLES["xml_document_policy"] = f"""
SELECT date, time, segment_id, speed FROM ({_XML})
WHERE (date, time) NOT IN (SELECT (date, time) FROM ({_XML}) WHERE bad)
"""
ORACLES["xml_rejected"] = f"""
SELECT date, time, 'bad number' AS reason, CAST(segment_id AS VARCHAR) AS segment_id, 'fast' AS speed
FROM ({_XML}) WHERE bad
"""

_JSON = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS "timestamp", 'L' || (user_id % 10) AS line,
       'E' || event_id AS sta, CAST(event_type = 'error' AS INTEGER) AS isdelay, event_type AS kind,
       CASE WHEN event_type NOT IN ('view', 'signup', 'purchase') THEN value END AS up,
       CASE WHEN event_type <> 'purchase' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS down,
       CAST(CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS INTEGER) AS trains_listed
FROM events
"""
_BOARD = '"timestamp", line, sta, isdelay'
ORACLES["json_flatten"] = f"""
SELECT {_BOARD}, up AS up_ttnt_1, down AS down_ttnt_1, trains_listed FROM ({_JSON})
"""
_ZERO = "coalesce(up, 0.0) AS up_ttnt_1, coalesce(down, 0.0) AS down_ttnt_1, trains_listed"
ORACLES["json_flatten_zero"] = f"SELECT {_BOARD}, {_ZERO} FROM ({_JSON})"
ORACLES["json_flatten_live"] = f"""
SELECT {_BOARD}, {_ZERO} FROM ({_JSON}) WHERE kind <> 'purchase'
AND "timestamp" NOT IN (SELECT "timestamp" FROM ({_JSON}) WHERE kind = 'signup')
"""
ORACLES["json_nest_roundtrip"] = """
SELECT strftime(ts, '%Y%m%d_%H0000') AS collected_at, 'line "' || (user_id % 10) AS line, event_id, value FROM events
"""
ORACLES["newest_snapshot"] = f"""
{ORACLES["json_flatten"]} WHERE "timestamp" = (SELECT max("timestamp") FROM ({_JSON}))
"""
ORACLES["delay_alerts"] = f"""
WITH {RAIL} SELECT event_id, "timestamp", line, sta FROM rail WHERE isdelay = 1
"""

# ---- scalar functions ------------------------------------------------------------------------

ORACLES["calendar_features"] = f"SELECT event_id, {calendar('ts')} FROM events"
ORACLES["stamp_roundtrip"] = """
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS clock,
       epoch_us(date_trunc('second', ts)) AS civil_micros, true AS bad_is_null
FROM events
"""
ORACLES["rounded_values"] = f"""
SELECT event_id, {rounded('value', 1)} AS one, {rounded('value / 7', 2)} AS two,
       {rounded('value / 300', 4)} AS four,
       greatest(0, CAST({rounded('value - 20', 0)} AS INTEGER)) AS whole,
       {percent('value / 400')} AS percent
FROM events
"""

# ---- series ----------------------------------------------------------------------------------

_GAP = f"""
{ROAD}, gap AS (
  SELECT *, coalesce((epoch_us(datetime) - lag(epoch_us(datetime)) OVER w) / 6e7, 5.0) AS time_diff,
         CAST(speed < 30 AS INTEGER) AS is_congested
  FROM road WINDOW w AS (PARTITION BY segment_id ORDER BY datetime, event_id))
"""
ORACLES["gap_minutes"] = f"WITH {_GAP} SELECT event_id, segment_id, time_diff FROM gap"
ORACLES["gap_minutes_capped"] = f"WITH {_GAP} SELECT event_id, least(time_diff, 60.0) AS time_diff FROM gap"

_RUN = f"""
{_GAP}, block AS (
  SELECT *, CAST(sum(1 - is_congested) OVER (PARTITION BY segment_id ORDER BY datetime, event_id
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS congestion_block
  FROM gap),
run AS (
  SELECT *, CASE WHEN is_congested = 1 THEN
      sum(CASE WHEN is_congested = 1 THEN CAST(round(time_diff * 6e7) AS BIGINT) ELSE 0 END)
        OVER (PARTITION BY segment_id, congestion_block ORDER BY datetime, event_id ROWS UNBOUNDED PRECEDING) / 6e7
    ELSE 0.0 END AS congestion_minutes
  FROM block),
labelled AS (
  SELECT *, coalesce(lead(congestion_minutes, 6) OVER (PARTITION BY segment_id ORDER BY datetime, event_id), 0.0)
      AS label_congestion_minutes
  FROM run)
"""
ORACLES["run_minutes"] = f"""
WITH {_RUN} SELECT event_id, is_congested, congestion_block, congestion_minutes FROM run
"""
ORACLES["run_minutes_leading"] = f"""
WITH {_RUN} SELECT event_id, congestion_block,
  CASE WHEN congestion_block = 0 THEN congestion_minutes ELSE 0.0 END AS congestion_minutes FROM run
"""
ORACLES["run_minutes_min"] = f"""
WITH {_RUN} SELECT event_id, CASE WHEN congestion_minutes >= 10 THEN congestion_minutes ELSE 0.0 END AS congestion_minutes
FROM run
"""
ORACLES["lead_label"] = f"WITH {_RUN} SELECT event_id, label_congestion_minutes FROM labelled"
ORACLES["lead_label_time"] = f"""
WITH {ROAD} SELECT a.event_id, coalesce(b.speed, 0.0) AS label_speed
FROM (SELECT *, datetime + INTERVAL 30 MINUTE AS target FROM road) a
ASOF LEFT JOIN road b ON a.segment_id = b.segment_id AND a.target <= b.datetime
"""
ORACLES["road_training_table"] = f"""
WITH {_RUN} SELECT segment_id, datetime, speed, is_congested, time_diff, congestion_block, congestion_minutes,
  label_congestion_minutes, {calendar('datetime')} FROM labelled
"""
ORACLES["top_congested_segments"] = f"""
WITH {_RUN} SELECT segment_id, datetime, speed, congestion_minutes FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY datetime DESC, event_id DESC) AS r FROM run)
WHERE r = 1 ORDER BY congestion_minutes DESC, segment_id LIMIT 20
"""

_BY_STATION = 'PARTITION BY line, sta ORDER BY "timestamp", event_id'
_FILLED = f"""
{RAIL}, filled AS (
  SELECT * REPLACE (
    coalesce(last_value(up_ttnt_1 IGNORE NULLS) OVER ({_BY_STATION} ROWS UNBOUNDED PRECEDING), 0.0) AS up_ttnt_1,
    coalesce(last_value(down_ttnt_1 IGNORE NULLS) OVER ({_BY_STATION} ROWS UNBOUNDED PRECEDING), 0.0) AS down_ttnt_1)
  FROM rail)
"""
ORACLES["forward_fill"] = f"WITH {_FILLED} SELECT event_id, up_ttnt_1, down_ttnt_1 FROM filled"
_AHEAD = f"CAST(max(isdelay) OVER ({_BY_STATION} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS DOUBLE)"
ORACLES["lookahead_max"] = f"WITH {RAIL} SELECT event_id, {_AHEAD} AS delay_risk_label FROM rail"
ORACLES["lookahead_max_time"] = f"""
WITH {RAIL} SELECT event_id, CAST(max(isdelay) OVER (PARTITION BY line, sta ORDER BY "timestamp"
  RANGE BETWEEN CURRENT ROW AND INTERVAL 10 HOUR FOLLOWING) AS DOUBLE) AS delay_risk_label FROM rail
"""
ORACLES["rail_risk_table"] = f"""
WITH {_FILLED} SELECT *, {calendar('"timestamp"')}, {_AHEAD} AS delay_risk_label FROM filled
"""
_BLOCKS = f"""
{RAIL}, changes AS (
  SELECT *, CAST(coalesce(isdelay <> lag(isdelay) OVER ({_BY_STATION}), false) AS INTEGER) AS isdelay_changed FROM rail),
blocks AS (
  SELECT *, CAST(sum(isdelay_changed) OVER ({_BY_STATION} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block_id FROM changes)
"""
ORACLES["change_blocks"] = f"WITH {_BLOCKS} SELECT event_id, isdelay_changed, block_id FROM blocks"
ORACLES["first_rows"] = f"""
WITH {RAIL} SELECT line, sta, "timestamp", up_ttnt_1, down_ttnt_1 FROM (
  SELECT *, row_number() OVER ({_BY_STATION}) AS r FROM rail) WHERE r = 1
"""


def windows(partition: str, length: int, drop_last: bool, pad: bool) -> str:
    """Sequences by position arithmetic: position p of the window that ends at row i is row i-length+1+p,
    and rows before the first are copies of it."""
    newest = "n - 1" if drop_last else "n"
    short = "n <= {0}" if drop_last else "n < {0}"
    short = short.format(length)
    ends = f"(NOT ({short}) AND i >= {length} AND i <= {newest})"
    if pad:
        ends += f" OR ({short} AND i = greatest(1, {newest}))"
    return f"""
WITH {ROAD}, numbered AS (
  SELECT *, strftime(datetime, '%Y-%m-%d') AS day,
         row_number() OVER (PARTITION BY {partition} ORDER BY datetime, event_id) AS i,
         count(*) OVER (PARTITION BY {partition}) AS n
  FROM (SELECT *, strftime(datetime, '%Y-%m-%d') AS day_ FROM road)),
ends AS (SELECT * FROM numbered WHERE {ends}),
wanted AS (
  SELECT e.event_id, e.speed AS label, p.pos, e.segment_id, e.day_,
         greatest(1, CASE WHEN {short} THEN least({newest}, n) - {length} + 1 + p.pos
                          ELSE e.i - {length} + 1 + p.pos END) AS at
  FROM ends e, (SELECT CAST(unnest(range({length})) AS INTEGER) AS pos) p)
SELECT w.event_id, w.label, w.pos, r.speed AS value
FROM wanted w JOIN numbered r ON r.segment_id = w.segment_id AND r.i = w.at {"AND r.day_ = w.day_" if "day" in partition else ""}
"""


ORACLES["sequence_windows"] = windows("segment_id", 12, True, True)
ORACLES["sequence_windows_all"] = windows("segment_id", 12, False, False)
ORACLES["sequence_padding"] = windows("segment_id, day_", 3, True, True)
ORACLES["constant_history"] = f"""
WITH {ROAD} SELECT segment_id, CAST(unnest(range(12)) AS INTEGER) AS pos, speed AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY datetime DESC, event_id DESC) AS r FROM road) WHERE r = 1
"""
ORACLES["gap_interpolate"] = f"""
WITH {RAIL}, n AS (SELECT *, row_number() OVER ({_BY_STATION}) AS i FROM rail),
k AS (
  SELECT *, max(CASE WHEN isdelay = 1 THEN i END) OVER ({_BY_STATION} ROWS UNBOUNDED PRECEDING) AS ia,
         min(CASE WHEN isdelay = 1 THEN i END) OVER ({_BY_STATION} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib
  FROM n)
SELECT k.event_id, CASE WHEN k.isdelay = 1 OR a.i IS NULL OR b.i IS NULL THEN k.down_ttnt_1
  ELSE a.down_ttnt_1 + (b.down_ttnt_1 - a.down_ttnt_1) * (k.i - a.i) / (b.i - a.i) END AS x
FROM k LEFT JOIN n a ON a.line = k.line AND a.sta = k.sta AND a.i = k.ia
       LEFT JOIN n b ON b.line = k.line AND b.sta = k.sta AND b.i = k.ib
"""

# ---- events and data sets --------------------------------------------------------------------

_EVENTS = f"""
{_BLOCKS}, stretch AS (
  SELECT line, sta, block_id, min("timestamp") AS "timestamp", max("timestamp") AS end_time, count(*) AS row_count,
         arg_min(event_id, ("timestamp", event_id)) AS first_id
  FROM blocks WHERE isdelay = 1 GROUP BY line, sta, block_id),
delay AS (
  SELECT s.*, greatest(1.0, (epoch_us(end_time) - epoch_us(s."timestamp")) / 6e7) AS delay_duration_minutes,
         r.up_ttnt_1, r.down_ttnt_1, r.event_id
  FROM stretch s JOIN rail r ON r.event_id = s.first_id),
impact AS (SELECT *, CAST(1 + floor(delay_duration_minutes / 5) AS INTEGER) AS affected_trains_count FROM delay)
"""
ORACLES["delay_events"] = f"""
WITH {_EVENTS} SELECT line, sta, "timestamp", event_id, {calendar('"timestamp"')}, up_ttnt_1, down_ttnt_1,
  delay_duration_minutes, affected_trains_count, block_id, end_time, row_count FROM impact
"""
ORACLES["delay_events_observed"] = f"""
WITH {RAIL}, c AS (
  SELECT *, CAST(coalesce(isdelay <> lag(isdelay) OVER w OR "timestamp" - lag("timestamp") OVER w > INTERVAL 720 MINUTE,
                 false) AS INTEGER) AS changed FROM rail WINDOW w AS ({_BY_STATION})),
b AS (SELECT *, sum(changed) OVER ({_BY_STATION} ROWS UNBOUNDED PRECEDING) AS block FROM c)
SELECT arg_min(event_id, ("timestamp", event_id)) AS event_id,
  greatest(1.0, (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 6e7) AS delay_duration_minutes,
  CAST(max(down_ttnt_1) AS INTEGER) AS observed_trains_count, count(*) AS row_count
FROM b WHERE isdelay = 1 GROUP BY line, sta, block
"""
ORACLES["delay_event_count"] = f"WITH {_EVENTS} SELECT count(*) AS delay_events FROM impact"
ORACLES["dataset_profile"] = f"""
WITH {RAIL}, l AS (SELECT {_AHEAD} AS y FROM rail)
SELECT count(*) AS total_rows, sum(y) AS positive_samples, max(y) > 0 AS has_positive FROM l
"""


def uniform(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def noisy(column: str, spread: float, floor: float) -> str:
    a, b = (uniform("event_id", "copy", f"'{column}'", "'7'", f"'{s}'") for s in "ab")
    moved = f"{column} + sqrt(ln({a}) * -2.0::DOUBLE) * cos({b} * 6.283185307179586::DOUBLE) * {spread}::DOUBLE"
    return f"round(CASE WHEN copy = 0 THEN {column} ELSE greatest({floor}::DOUBLE, {moved}) END, 6) AS {column}"


ORACLES["augment_events"] = f"""
WITH {_EVENTS}, copies AS (SELECT *, CAST(unnest(range(6)) AS INTEGER) AS copy FROM impact)
SELECT event_id, copy, {noisy('up_ttnt_1', 2.0, 0.0)}, {noisy('down_ttnt_1', 2.0, 0.0)},
  {noisy('delay_duration_minutes', 1.0, 1.0)}, affected_trains_count FROM copies
"""
ORACLES["split_stable"] = f"""
SELECT event_id, {uniform('event_id', "'7'")} < 0.8::DOUBLE AS is_train FROM events
"""
ORACLES["split_by_time"] = """
SELECT ts <= (SELECT quantile_disc(ts, 0.8) FROM events) AS is_train, count(*) AS n FROM events GROUP BY 1
"""
ORACLES["scaled_features"] = f"""
WITH {RAIL} SELECT event_id, up_ttnt_1 / 60 AS up_ttnt_1, down_ttnt_1 / 60 AS down_ttnt_1 FROM rail
"""
ORACLES["loss_metrics"] = f"""
WITH {RAIL}, r AS (SELECT isdelay AS y, down_ttnt_1 / 100 AS p FROM rail),
c AS (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM r)
SELECT round(avg((p - y) * (p - y)), 6) AS mse, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS bce,
  count(*) AS n FROM c
"""
ORACLES["preview"] = f"WITH {ROAD} SELECT * FROM road ORDER BY datetime, event_id LIMIT 5"
ORACLES["series_table_roundtrip"] = """
SELECT event_id, user_id AS segment_id, value AS speed, CAST(ts AS DATE) AS event_date FROM events
"""

# ---- serving ---------------------------------------------------------------------------------

_NEWEST = f"""
{RAIL}, newest AS (SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY line, sta ORDER BY "timestamp" DESC, event_id DESC) AS r FROM rail) WHERE r = 1)
"""
ORACLES["latest_state"] = f"WITH {_NEWEST} SELECT * FROM newest"
_ROAD_STATE = f"""
{ROAD}, state AS (
  SELECT segment_id, speed - 10 AS predicted_congestion_minutes, datetime AS updated_at FROM (
    SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY datetime DESC, event_id DESC) AS r FROM road) WHERE r = 1)
"""
ORACLES["road_state"] = f"WITH {_ROAD_STATE} SELECT * FROM state"
_RAIL_STATE = f"""
{_NEWEST}, risks AS (
  SELECT line, sta, least(1.0, up_ttnt_1 / 60) AS risk FROM (
    SELECT *, row_number() OVER (PARTITION BY line, sta ORDER BY "timestamp" DESC, event_id DESC) AS r
    FROM rail WHERE isdelay = 1) WHERE r = 1),
joined AS (
  SELECT n.*, {rounded('coalesce(risk, 0.0)', 4)} AS delay_risk_probability
  FROM newest n LEFT JOIN risks k ON k.line = n.line AND k.sta = n.sta),
state AS (
  SELECT line, sta, delay_risk_probability,
    {rounded('down_ttnt_1 / 7 + 0.5::DOUBLE', 1)} AS delay_duration_minutes,
    CAST({rounded('down_ttnt_1 / 8', 0)} AS INTEGER) AS affected_trains_count,
    CASE WHEN delay_risk_probability > 0.7::DOUBLE THEN 'red' WHEN delay_risk_probability > 0.3::DOUBLE THEN 'yellow'
         ELSE 'green' END AS color_code,
    {rounded('coalesce(up_ttnt_1, 0.0)', 1)} AS up_ttnt, {rounded('down_ttnt_1', 1)} AS down_ttnt,
    "timestamp" AS updated_at
  FROM joined)
"""
ORACLES["combine_forecasts"] = f"WITH {_RAIL_STATE} SELECT * FROM state"
_STATUS = "CASE WHEN {0} IS NULL THEN '{1}' ELSE 'Success' END AS status"
ORACLES["state_lookup"] = f"""
WITH {_ROAD_STATE} SELECT c_custkey AS segment_id,
  {rounded('predicted_congestion_minutes', 2)} AS predicted_congestion_minutes,
  {_STATUS.format('predicted_congestion_minutes', 'Not found or no data')}
FROM customer LEFT JOIN state ON segment_id = c_custkey
"""
_WANTED = """
wanted AS (SELECT 'L' || (c_custkey % 10) AS line, CAST(c_custkey AS VARCHAR) AS sta, c_acctbal AS lon,
           CAST(c_nationkey AS DOUBLE) AS lat FROM customer)
"""
ORACLES["state_lookup_rail"] = f"""
WITH {_RAIL_STATE}, {_WANTED} SELECT line, sta, delay_risk_probability, {_STATUS.format('delay_risk_probability', 'Not found')}
FROM wanted LEFT JOIN state USING (line, sta)
"""
ORACLES["state_partial_key"] = f"WITH {_RAIL_STATE} SELECT line, sta, color_code FROM state WHERE line = 'L3'"
ORACLES["state_summary"] = f"""
WITH {_ROAD_STATE} SELECT count(*) AS count, max(updated_at) AS last_update FROM state
"""
ORACLES["state_predictions"] = f"""
WITH {_RAIL_STATE} SELECT line || '-' || sta AS key, {rounded('delay_risk_probability', 2)} AS delay_risk_probability FROM state
"""
_TIER = """CASE WHEN {0} IS NULL THEN 'grey' WHEN {0} <= 0 THEN 'green' WHEN {0} <= 5 THEN 'yellow'
  WHEN {0} <= 20 THEN 'orange' ELSE 'red' END"""
ORACLES["road_severity"] = f"""
WITH {_ROAD_STATE} SELECT segment_id, {_TIER.format('predicted_congestion_minutes')} AS tier FROM state
"""
ORACLES["rail_severity"] = """
SELECT event_id, CASE WHEN value / 400 > 0.7::DOUBLE THEN 'red' WHEN value / 400 > 0.3::DOUBLE THEN 'yellow' ELSE 'green' END
  AS color_code FROM events
"""
ORACLES["active_events_ranked"] = f"""
WITH {_RAIL_STATE} SELECT line, sta, delay_risk_probability, color_code, {percent('delay_risk_probability')} AS risk_text
FROM state WHERE color_code IN ('red', 'yellow')
"""
_PLAIN = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
ORACLES["active_events_top"] = f"""
WITH {_RAIL_STATE} SELECT line, sta, delay_risk_probability, 'Risk: ' || {percent('delay_risk_probability')} || ' | Est. '
  || {_PLAIN.format('delay_duration_minutes')} || 'm | Affects ~' || affected_trains_count || ' trains' AS message
FROM state WHERE color_code IN ('red', 'yellow') ORDER BY delay_risk_probability DESC, line, sta LIMIT 10
"""
ORACLES["active_station_count"] = f"""
WITH {_RAIL_STATE} SELECT count(*) FILTER (color_code IN ('red', 'yellow')) AS active_stations FROM state
"""

# ---- network ---------------------------------------------------------------------------------

ORACLES["network_join_predictions"] = f"""
WITH load AS (SELECT l_orderkey, max(l_quantity) - 30 AS minutes FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o_orderkey, o_orderpriority, minutes, {_TIER.format('minutes')} AS tier
      FROM orders LEFT JOIN load ON l_orderkey = o_orderkey)
SELECT *, CASE tier WHEN 'green' THEN '#28a745' WHEN 'yellow' THEN '#ffc107' WHEN 'orange' THEN '#fd7e14'
    WHEN 'red' THEN '#dc3545' ELSE '#6c757d' END AS color,
  CASE tier WHEN 'green' THEN 3 WHEN 'yellow' THEN 4 WHEN 'orange' THEN 5 WHEN 'red' THEN 6 ELSE 2 END AS weight,
  CAST(CASE tier WHEN 'green' THEN 0.8 WHEN 'yellow' THEN 0.9 WHEN 'grey' THEN 0.6 ELSE 1.0 END AS DOUBLE) AS opacity
FROM j
"""
ORACLES["rail_markers"] = f"""
WITH {_RAIL_STATE}, {_WANTED} SELECT line, sta, color_code,
  CASE color_code WHEN 'red' THEN '#dc3545' WHEN 'yellow' THEN '#ffc107' ELSE '#28a745' END AS fill_color,
  CASE color_code WHEN 'red' THEN 8 WHEN 'yellow' THEN 7 ELSE 6 END AS radius,
  coalesce(color_code = 'red', false) AS blinking
FROM wanted LEFT JOIN state USING (line, sta)
"""
ORACLES["locate_events"] = f"""
WITH {_RAIL_STATE}, {_WANTED} SELECT line, sta, lon, lat, {percent('delay_risk_probability')} AS risk_text
FROM state JOIN wanted USING (line, sta) WHERE color_code IN ('red', 'yellow')
"""
ORACLES["semi_join_network"] = """
SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
"""
ORACLES["dimension_lookup_first"] = """
SELECT n_nationkey AS sta, n_name, s_suppkey, s_acctbal FROM nation JOIN (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
ON s_nationkey = n_nationkey AND r = 1
"""
ORACLES["station_codes"] = """
SELECT c_custkey, n_name AS name, n_regionkey AS code FROM customer JOIN nation ON n_name = 'NATION_' || c_nationkey
WHERE n_regionkey <> 2
"""
ORACLES["line_colors"] = """
SELECT r_regionkey, r_name AS line, CASE r_name WHEN 'ASIA' THEN '#101010' WHEN 'EUROPE' THEN '#202020' ELSE '#000000' END
  AS color FROM region
"""
ORACLES["first_line_of_station"] = """
SELECT c_custkey AS sta, coalesce(min(o_orderpriority), 'UNKNOWN') AS line
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
"""
_PLACES = """
places AS (
  SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y
  FROM embeddings, (SELECT unnest(range(32)) AS i))
"""
_NUMBERED = """
numbered AS (
  SELECT l_orderkey, l_quantity AS x, l_extendedprice AS y, count(*) OVER (PARTITION BY l_orderkey) AS n,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i
  FROM lineitem)
"""


def _in_parts(step: int) -> str:
    """Lines cut after every ``step`` vertices; part p holds vertices step*p .. step*p + step."""
    return f"""
{_NUMBERED}, counted AS (SELECT DISTINCT l_orderkey, n FROM numbered WHERE n > 1),
parts AS (SELECT l_orderkey, CAST(unnest(range((n - 2) // {step} + 1)) AS INTEGER) AS part FROM counted),
laid AS (
  SELECT v.l_orderkey, part, CAST(i - {step} * part AS INTEGER) AS pos, x, y
  FROM parts p JOIN numbered v ON v.l_orderkey = p.l_orderkey AND i BETWEEN {step} * part AND {step} * part + {step})
"""


ORACLES["ordered_polyline"] = f"WITH {_in_parts(9999)} SELECT * FROM laid"
ORACLES["ordered_polyline_parts"] = f"WITH {_in_parts(3)} SELECT * FROM laid"
ORACLES["geojson_roundtrip"] = f"""
WITH {_in_parts(9999)}, {_PLACES}
SELECT l_orderkey AS id, 'LineString' AS geometry_type, CAST(pos AS INTEGER) AS pos, x, y FROM laid
UNION ALL SELECT vec_id, 'Point', CAST(0 AS INTEGER), x, y FROM places
"""
ORACLES["feature_collections"] = """
SELECT 'L' || (c_custkey % 10) || '-' || c_custkey AS name, 'Point' AS type,
  CASE WHEN c_custkey % 10 < 5 THEN '#' || repeat(CAST(c_custkey % 10 AS VARCHAR), 3) ELSE '#000000' END AS color FROM customer
"""
ORACLES["network_features"] = """
WITH placed AS (
  SELECT r_name AS line, n_nationkey AS seq, CAST(s_suppkey AS DOUBLE) AS lon, s_acctbal AS lat,
         CASE r_name WHEN 'ASIA' THEN '#101010' WHEN 'EUROPE' THEN '#202020' ELSE '#000000' END AS color
  FROM nation JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
    ON s_nationkey = n_nationkey AND r = 1)
SELECT line, NULL AS name, 'LineString' AS type, color,
  CAST(row_number() OVER (PARTITION BY line ORDER BY seq) - 1 AS INTEGER) AS pos, lon, lat
FROM (SELECT *, count(*) OVER (PARTITION BY line) AS n FROM placed) WHERE n > 1
UNION ALL SELECT line, line || '-' || seq, 'Point', color, CAST(0 AS INTEGER), lon, lat FROM placed
"""
ORACLES["minmax_affine"] = f"""
WITH {_PLACES}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM places)
SELECT vec_id, pos, 113.93::DOUBLE + (x - x0) / (x1 - x0) * (114.27::DOUBLE - 113.93::DOUBLE) AS lon,
  22.24::DOUBLE + (y - y1) / (y0 - y1) * (22.53::DOUBLE - 22.24::DOUBLE) AS lat FROM places, b
"""
# The smallest distance first, then the smallest vertex at that distance.
ORACLES["nearest_point"] = f"""
WITH {_PLACES}, p AS (SELECT vec_id * 32 + pos AS point_id, x, y FROM places WHERE pos % 2 = 0),
v AS (SELECT vec_id * 32 + pos AS vertex_id, x, y FROM places WHERE pos % 2 = 1),
least AS (SELECT point_id, p.x, p.y, min((p.x - v.x) * (p.x - v.x) + (p.y - v.y) * (p.y - v.y)) AS distance2 FROM p, v GROUP BY ALL)
SELECT point_id, min(vertex_id) AS vertex_id, distance2 FROM least l, v
WHERE (l.x - v.x) * (l.x - v.x) + (l.y - v.y) * (l.y - v.y) = distance2 GROUP BY point_id, distance2
"""
# Inverse transverse Mercator, step by step; v holds one row per vertex.
_DEGREES = """
grid AS (
  SELECT 6378388.0::DOUBLE AS a, 1 / 297.0::DOUBLE AS f, 836694.05::DOUBLE AS fe, 819069.80::DOUBLE AS fn,
         radians(22 + 18 / 60.0::DOUBLE + 43.68::DOUBLE / 3600) AS lat0,
         114 + 10 / 60.0::DOUBLE + 42.80::DOUBLE / 3600 AS lon0),
shape AS (SELECT *, f / (2 - f) AS n, sqrt(f * (2 - f)) AS e FROM grid),
origin AS (
  SELECT *, a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) AS radius,
         atan(sinh(atanh(sin(lat0)) - e * atanh(e * sin(lat0)))) AS x0 FROM shape),
k AS (
  SELECT *, x0 + (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180) * sin(2 * x0)
    + (13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440) * sin(4 * x0)
    + (61 * n**3 / 240 - 103 * n**4 / 140) * sin(6 * x0) + (49561 * n**4 / 161280) * sin(8 * x0) AS m0,
    n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 AS b1, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 AS b2,
    17 * n**3 / 480 - 37 * n**4 / 840 AS b3, 4397 * n**4 / 161280 AS b4 FROM origin),
i AS (SELECT CAST(unnest(range(32)) AS INTEGER) AS pos),
v AS (
  SELECT vec_id AS ROUTE_ID, pos,
    ((CAST(embedding[2 * pos + 2] AS DOUBLE) * 20000 + fn) - fn) / radius + m0 AS xi,
    ((CAST(embedding[2 * pos + 1] AS DOUBLE) * 20000 + fe + pos * 400) - fe) / radius AS eta,
    k.* FROM embeddings, i, k),
w AS (
  SELECT *, xi - b1 * sin(2*xi) * cosh(2*eta) - b2 * sin(4*xi) * cosh(4*eta) - b3 * sin(6*xi) * cosh(6*eta)
            - b4 * sin(8*xi) * cosh(8*eta) AS xi1,
    eta - b1 * cos(2*xi) * sinh(2*eta) - b2 * cos(4*xi) * sinh(4*eta) - b3 * cos(6*xi) * sinh(6*eta)
        - b4 * cos(8*xi) * sinh(8*eta) AS eta1 FROM v),
c AS (SELECT *, asinh(sin(xi1) / sqrt(sinh(eta1)**2 + cos(xi1)**2)) AS q FROM w),
s1 AS (SELECT *, tanh(q + e * atanh(e * tanh(q))) AS s FROM c),
s2 AS (SELECT * REPLACE (tanh(q + e * atanh(e * s)) AS s) FROM s1),
s3 AS (SELECT * REPLACE (tanh(q + e * atanh(e * s)) AS s) FROM s2),
s4 AS (SELECT * REPLACE (tanh(q + e * atanh(e * s)) AS s) FROM s3),
s5 AS (SELECT * REPLACE (tanh(q + e * atanh(e * s)) AS s) FROM s4),
own AS (SELECT ROUTE_ID, pos, radians(lon0 + degrees(atan2(sinh(eta1), cos(xi1)))) AS lon, asin(s) AS lat, a, f * (2 - f) AS e2 FROM s5),
-- to metres from the earth's centre, moved to the other datum, and back to degrees by a fixed-point iteration
xyz AS (
  SELECT ROUTE_ID, pos, r * cos(lat) * cos(lon) AS x, r * cos(lat) * sin(lon) AS y, r * (1 - e2) * sin(lat) AS z
  FROM (SELECT *, a / sqrt(1 - e2 * sin(lat) * sin(lat)) AS r FROM own)),
turn AS (
  SELECT radians(0.067753::DOUBLE / 3600) AS rx, radians(-2.243649::DOUBLE / 3600) AS ry, radians(-1.158827::DOUBLE / 3600) AS rz,
         1 - 1.094246::DOUBLE / 1000000 AS m),
moved AS (
  SELECT ROUTE_ID, pos, -162.619::DOUBLE + m * (x - rz * y + ry * z) AS x, -276.959::DOUBLE + m * (y + rz * x - rx * z) AS y,
         -161.764::DOUBLE + m * (z - ry * x + rx * y) AS z FROM xyz, turn),
wgs AS (SELECT *, sqrt(x * x + y * y) AS p, (2 - 1 / 298.257223563::DOUBLE) / 298.257223563::DOUBLE AS e2, 6378137.0::DOUBLE AS a FROM moved),
l0 AS (SELECT *, atan2(z, p * (1 - e2)) AS lat FROM wgs),
l1 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(lat)**2) * sin(lat), p) AS lat) FROM l0),
l2 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(lat)**2) * sin(lat), p) AS lat) FROM l1),
l3 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(lat)**2) * sin(lat), p) AS lat) FROM l2),
l4 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(lat)**2) * sin(lat), p) AS lat) FROM l3),
pts AS (SELECT ROUTE_ID, pos, degrees(atan2(y, x)) AS lon, degrees(lat) AS lat FROM l4)
"""
ORACLES["reproject_roads"] = f"""
WITH {_DEGREES} SELECT ROUTE_ID, pos, round(lon, 7) AS lon, round(lat, 7) AS lat FROM pts
"""
# Every split of a stretch (a, b) at its farthest vertex keeps that vertex and adds two stretches.
def _side(a: str, b: str, c: str) -> str:
    """The side of the line from vertex a to vertex b on which vertex c lies."""
    return f"sign((x[{b}] - x[{a}]) * (y[{c}] - y[{a}]) - (y[{b}] - y[{a}]) * (x[{c}] - x[{a}]))"


_SHARE = "((x[k] - x[a]) * (x[b] - x[a]) + (y[k] - y[a]) * (y[b] - y[a])) / (power(x[b] - x[a], 2) + power(y[b] - y[a], 2))"
# One line a row: the vertices decided, those wanted next (the last one first), and the farthest one of the stretch
# between. A segment is taken if nothing between is off and it crosses neither the decided nor the given line behind it.
ORACLES["road_network_features"] = f"""
WITH RECURSIVE {_DEGREES},
line AS (SELECT ROUTE_ID, list(lon ORDER BY pos) AS x, list(lat ORDER BY pos) AS y FROM pts GROUP BY ROUTE_ID),
walk(ROUTE_ID, done, wanted) AS (
  SELECT ROUTE_ID, [1::BIGINT], [len(x)] FROM line
  UNION ALL
  (WITH section AS (SELECT w.*, l.x, l.y, done[-1] AS a, wanted[-1] AS b FROM walk w JOIN line l USING (ROUTE_ID) WHERE len(wanted) > 0),
   off AS (
     SELECT *, list_transform(range(a + 1, b), lambda k: {{'d':
       power(x[k] - (x[a] + least(1, greatest(0, {_SHARE})) * (x[b] - x[a])), 2) + power(y[k] - (y[a] + least(1, greatest(0, {_SHARE})) * (y[b] - y[a])), 2), 'k': -k}}) AS far FROM section),
   judged AS (
     SELECT *, -list_max(far).k AS m, b - a = 1 OR list_max(far).d <= 0.01::DOUBLE * 0.01::DOUBLE AND NOT list_bool_or(list_transform(
         list_concat(list_transform(range(1, len(done)), lambda i: [done[i], done[i + 1]]), list_transform(range(b, len(x)), lambda k: [k, k + 1])),
         lambda s: {_side("a", "b", "s[1]")} * {_side("a", "b", "s[2]")} < 0 AND {_side("s[1]", "s[2]", "a")} * {_side("s[1]", "s[2]", "b")} < 0) || [false]) AS taken FROM off)
   SELECT ROUTE_ID, CASE WHEN taken THEN list_append(done, b) ELSE done END, CASE WHEN taken THEN wanted[:-2] ELSE list_append(wanted, m) END FROM judged)),
kept AS (SELECT ROUTE_ID, unnest(done) - 1 AS pos FROM walk WHERE len(wanted) = 0)
SELECT vec_id AS segment_id, 'Street ' || label AS STREET_ENAME,
  CAST(row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS INTEGER) AS pos, round(lon, 7) AS lon, round(lat, 7) AS lat
FROM kept JOIN pts USING (ROUTE_ID, pos) JOIN embeddings ON vec_id = ROUTE_ID
WHERE EXISTS (SELECT 1 FROM events WHERE user_id = vec_id)
"""
# (sub, pos, kind, index of the first coordinate, number of points) of each segment of the stand-in paths
_SEGMENTS = [(0, 0, "", 1, 1), (0, 1, "L", 3, 1), (0, 2, "C", 5, 3), (1, 0, "", 11, 1), (1, 1, "C", 13, 3), (1, 2, "C", 19, 3)]
_SEGMENTS += [(2, 0, "", 25, 1), *[(2, k, "C", 21 + 6 * k, 3) for k in range(1, 7)], (2, 7, "L", 63, 1)]


def _end(segment) -> int:
    return segment[3] + 2 * (segment[4] - 1)


ORACLES["path_parse"] = " UNION ALL ".join(
    f"SELECT vec_id, CAST({s[0]} AS INTEGER) AS sub, CAST({s[1]} AS INTEGER) AS pos, '{s[2]}' AS kind, "
    f"CAST(embedding[{_end(s)}] AS DOUBLE) AS x, CAST(embedding[{_end(s) + 1}] AS DOUBLE) AS y FROM embeddings"
    for s in _SEGMENTS
)


def _midpoints() -> str:
    def at(i: int) -> str:
        return f"CAST(embedding[{i}] AS DOUBLE)"

    out, before = [], None
    for s in _SEGMENTS:
        end = _end(s)
        for i in range(s[4]):
            if s[2] == "C" and i < 2:
                x, y = (f"({at(end + j)} + {at(before + j)}) / 2" for j in (0, 1))
            else:
                x, y = at(s[3] + 2 * i), at(s[3] + 2 * i + 1)
            out.append(
                f"SELECT vec_id, CAST({s[0]} AS INTEGER) AS sub, CAST({s[1]} AS INTEGER) AS pos, "
                f"CAST({i} AS INTEGER) AS i, {x} AS x, {y} AS y FROM embeddings"
            )
        before = end
    return " UNION ALL ".join(out)


ORACLES["path_midpoints"] = _midpoints()

# ---- streams: the same statements as their batch twins ------------------------------------------

ORACLES["stream_latest"] = f"""
WITH {_NEWEST} SELECT n.event_id, n."timestamp", n.line, n.sta, n.isdelay, e.value AS up_ttnt_1
FROM newest n JOIN events e ON e.event_id = n.event_id
"""
ORACLES["stream_events"] = f"""
WITH {_EVENTS} SELECT line, sta, i."timestamp", i.event_id, e.value AS up_ttnt_1, delay_duration_minutes,
  affected_trains_count, end_time, row_count FROM impact i JOIN events e ON e.event_id = i.event_id
"""
ORACLES["stream_scored_state"] = f"""
WITH {_NEWEST}, r AS (
  SELECT n.line, n.sta, n."timestamp" AS updated_at, {rounded('least(1.0, e.value / 60)', 4)} AS delay_risk_probability
  FROM newest n JOIN events e ON e.event_id = n.event_id)
SELECT *, CASE WHEN delay_risk_probability > 0.7::DOUBLE THEN 'red' WHEN delay_risk_probability > 0.3::DOUBLE THEN 'yellow'
  ELSE 'green' END AS color_code FROM r
"""
ORACLES["stream_sequences"] = f"""
WITH {RAIL}, ranked AS (
  SELECT r.line, r.sta, e.value, row_number() OVER (PARTITION BY line, sta ORDER BY "timestamp" DESC, r.event_id DESC) AS back,
         least(10, count(*) OVER (PARTITION BY line, sta)) AS n
  FROM rail r JOIN events e ON e.event_id = r.event_id)
SELECT line, sta, CAST(pos AS INTEGER) AS pos, value
FROM (SELECT unnest(range(10)) AS pos) p JOIN ranked ON back = least(10 - pos, n)
"""
ORACLES["stream_alerts"] = f"""
WITH {RAIL} SELECT r.event_id, line, sta, e.value AS up_ttnt_1 FROM rail r JOIN events e ON e.event_id = r.event_id WHERE isdelay = 1
"""
ORACLES["stream_replaced"] = f"""
WITH {RAIL}, hourly AS (SELECT r.* REPLACE (date_trunc('hour', r."timestamp") AS "timestamp"), e.value FROM rail r JOIN events e USING (event_id))
SELECT event_id, "timestamp", line, sta, isdelay, value AS up_ttnt_1 FROM (
  SELECT *, row_number() OVER (PARTITION BY line, sta ORDER BY event_id DESC) AS r FROM hourly
  WHERE "timestamp" = (SELECT max("timestamp") FROM hourly)) WHERE r = 1
"""
ORACLES["stream_late_rows"] = f"""
WITH {_EVENTS}, span AS (SELECT min(epoch_us(ts)) AS low, (max(epoch_us(ts)) - min(epoch_us(ts))) // 5 + 1 AS width FROM events)
SELECT 'event' AS kind, event_id, row_count FROM impact
UNION ALL SELECT 'late', event_id, 0::BIGINT FROM events, span WHERE (epoch_us(ts) - low) // width = 0
"""
ORACLES["least_squares_scores"] = f"""
WITH {RAIL}, m AS (SELECT regr_slope(down_ttnt_1, up_ttnt_1) AS slope, regr_intercept(down_ttnt_1, up_ttnt_1) AS start FROM rail)
SELECT event_id, round(start + slope * up_ttnt_1, 6) AS predicted FROM rail, m WHERE up_ttnt_1 IS NOT NULL
"""
ORACLES["stream_fitted_state"] = f"""
WITH {_NEWEST}, m AS (SELECT regr_slope(down_ttnt_1, up_ttnt_1) AS slope, regr_intercept(down_ttnt_1, up_ttnt_1) AS start FROM rail)
SELECT n.line, n.sta, round(start + slope * e.value, 6) AS predicted, n."timestamp" AS updated_at
FROM newest n JOIN events e ON e.event_id = n.event_id, m
"""
ORACLES["stream_documents"] = f"""
SELECT "timestamp", line, sta, {_ZERO.replace(", trains_listed", "")}, CAST(substr("timestamp", 12, 2) AS INTEGER) AS hour
FROM ({_JSON}) WHERE isdelay = 1 AND kind <> 'purchase'
"""
ORACLES["newest_filled"] = f"""
WITH {_FILLED} SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY line, sta ORDER BY "timestamp" DESC, event_id DESC) AS r FROM filled) WHERE r = 1
"""
# A series of at most 12 rows gives one sample, that of its last row but one; a longer one those of rows 12 to n - 1.
ORACLES["road_sample_totals"] = f"""
WITH {_RUN}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY datetime, event_id) AS i, count(*) OVER (PARTITION BY segment_id) AS n
  FROM labelled)
SELECT segment_id, count(*) AS n, round(sum(label_congestion_minutes), 3) AS label_sum, round(sum(speed), 3) AS speed_sum,
  CAST(60 AS INTEGER) AS width
FROM numbered WHERE CASE WHEN n <= 12 THEN i = greatest(1, n - 1) ELSE i BETWEEN 12 AND n - 1 END GROUP BY segment_id
"""

# ---- files ------------------------------------------------------------------------------------

ORACLES["archive_flatten"] = f"""
SELECT segment_id, speed, date || ' ' || time AS datetime, date AS folder, {calendar('moment')}
FROM (SELECT *, CAST(date || ' ' || time AS TIMESTAMP) AS moment FROM ({_XML}) WHERE NOT bad)
"""
ORACLES["station_pixels_csv"] = """
SELECT c_name AS name, c_acctbal AS x_projection, CAST(c_custkey AS DOUBLE) AS y_projection,
  CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 7 END AS x_real, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey / 3 END AS y_real,
  c_mktsegment AS color FROM customer
"""
ORACLES["paths_csv"] = f"""
SELECT CAST(vec_id AS VARCHAR) AS name, '#123456' AS color, CASE WHEN vec_id % 3 <> 0 THEN 'plane' END AS projection,
  vec_id % 2 = 0 AS "reverseFirstPath", vec_id % 5 = 0 AS "reverseSecondPath", sub, pos, kind, x, y FROM ({ORACLES["path_parse"]})
"""
ORACLES["configured_lines"] = """
SELECT 'L' || (user_id % 10) AS line, CAST(user_id AS VARCHAR) AS sta, CAST(user_id % 10 AS INTEGER) AS line_seq,
  CAST(user_id // 10 AS INTEGER) AS seq, count(*) AS n FROM events WHERE user_id < 120 GROUP BY user_id
"""
ORACLES["feature_collection_files"] = """
SELECT 'L' || (c_custkey % 10) || '-' || c_custkey AS name, 'Point' AS type, 'Point' AS geometry_type,
  CASE WHEN c_custkey % 10 < 5 THEN '#' || repeat(CAST(c_custkey % 10 AS VARCHAR), 3) ELSE '#000000' END AS color,
  c_acctbal AS lon, CAST(c_nationkey AS DOUBLE) AS lat FROM customer
"""


# ---- streams, selections and ranges ------------------------------------------------------------

ORACLES["stream_sorted_out"] = f"""
WITH {RAIL}, span AS (SELECT min(epoch_us(ts)) AS low, (max(epoch_us(ts)) - min(epoch_us(ts))) // 5 + 1 AS width FROM events),
numbered AS (SELECT line, sta, "timestamp", (epoch_us("timestamp") - low) // width AS k FROM rail, span),
marked AS (
  SELECT *, k = 0 AS again, "timestamp" > (SELECT max("timestamp") FROM numbered m WHERE m.k = numbered.k) - INTERVAL 5 MINUTE AS twice FROM numbered)
SELECT line, sta, "timestamp", 1::BIGINT AS "unique", (count(*) + count(*) FILTER (twice) - 1)::BIGINT AS repeated,
  count(*) FILTER (again) AS late, (count(*) + count(*) FILTER (twice) + count(*) FILTER (again))::BIGINT AS delivered
FROM marked GROUP BY line, sta, "timestamp"
"""
ORACLES["stream_road_documents"] = f"""
SELECT 'row' AS kind, date, time[1:2] AS hour, CAST(segment_id AS VARCHAR) AS segment_id, speed, NULL::VARCHAR AS refused_speed, NULL::VARCHAR AS reason
FROM ({ORACLES["xml_flatten"]})
UNION ALL SELECT 'refused', date, time[1:2], segment_id, NULL, speed, reason FROM ({ORACLES["xml_rejected"]})
UNION ALL SELECT 'refused', 'broken-' || k, 'xx', NULL, NULL, NULL, 'unreadable document' FROM range(3) r(k)
"""
ORACLES["archive_between"] = f"""
WITH f AS (SELECT * FROM ({ORACLES["xml_flatten"]}))
SELECT segment_id, speed, date || ' ' || time AS datetime FROM f
WHERE CAST(date AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) BETWEEN 1 AND 3
"""
ORACLES["one_feature_collection"] = """
SELECT 'L' || (c_custkey % 10) || '-' || c_custkey AS name, CASE WHEN c_custkey % 10 < 5 THEN '#' || repeat(CAST(c_custkey % 10 AS VARCHAR), 3) ELSE '#000000' END AS color,
  c_acctbal AS lon, CAST(c_nationkey AS DOUBLE) AS lat FROM customer
"""


def _constant(name: str, rows: str, label: str, at: str, loss: str) -> str:
    """The loss, on the newest fifth of the samples, of the mean label of the others."""
    return f"""
SELECT '{name}' AS model, count(*) FILTER (NOT newest) AS n_train, count(*) FILTER (newest) AS n_validation,
  round(avg({loss}) FILTER (newest), 4) AS constant_loss, true AS size_in_range, true AS loss_known
FROM (SELECT CAST({label} AS DOUBLE) AS y, "{at}" > (SELECT quantile_disc("{at}", 0.8) FROM {rows}) AS newest,
        (SELECT avg({label}) FROM {rows} WHERE "{at}" <= (SELECT quantile_disc("{at}", 0.8) FROM {rows})) AS p FROM {rows})"""


_SQUARE, _CROSS = "(p - y) * (p - y)", "-(y * ln(p) + (1 - y) * ln(1 - p))"
ORACLES["select_road_model"] = f"""
WITH {_RUN}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY datetime, event_id) AS i, count(*) OVER (PARTITION BY segment_id) AS n FROM labelled),
samples AS (SELECT * FROM numbered WHERE CASE WHEN n <= 12 THEN i = greatest(1, n - 1) ELSE i BETWEEN 12 AND n - 1 END)
{_constant("road", "samples", "label_congestion_minutes", "datetime", _SQUARE)}
"""
ORACLES["select_risk_model"] = f"""
WITH {RAIL}, labelled AS (SELECT *, {_AHEAD} AS label FROM rail), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY line, sta ORDER BY "timestamp", event_id) AS i, count(*) OVER (PARTITION BY line, sta) AS n FROM labelled),
samples AS (SELECT * FROM numbered WHERE CASE WHEN n <= 10 THEN i = greatest(1, n - 1) ELSE i BETWEEN 10 AND n - 1 END)
{_constant("risk", "samples", "label", "timestamp", _CROSS)}
"""
ORACLES["select_event_models"] = f"""
WITH {_EVENTS} {_constant("delay_duration_minutes", "impact", "delay_duration_minutes", "timestamp", _SQUARE)}
UNION ALL {_constant("affected_trains_count", "impact", "affected_trains_count", "timestamp", _SQUARE)}
"""
ORACLES["score_road_ranges"] = f"WITH {_ROAD_STATE} SELECT segment_id, updated_at, true AS in_range FROM state"
ORACLES["score_rail_ranges"] = f"""
WITH {RAIL} SELECT line, sta, max("timestamp") AS updated_at, true AS risk_in_range, true AS tier_fits, true AS counts_in_range FROM rail GROUP BY line, sta
"""
ORACLES["training_without_delays"] = "SELECT count(*) AS risk_rows, 0.0::DOUBLE AS delays_ahead, 0::BIGINT AS event_rows, false AS has_events FROM events"
