"""SQL pieces that the oracle queries share; DuckDB dialect."""

#: ``notes`` and ``mel`` (without drums) of the events view.
E = """notes AS (SELECT user_id AS track_id, event_id AS note_id, CAST(floor(value) AS INT) % 128 AS pitch, CAST(json_extract_string(props, '$.k') AS INT) AS velocity,
  CAST(json_extract_string(props, '$.k') AS INT) AS dur, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + CAST(json_extract_string(props, '$.k') AS INT) AS "end",
  event_type = 'error' AS is_drum, event_type AS program FROM events), mel AS (SELECT * FROM notes WHERE NOT is_drum)"""

#: The same of the lineitem view.
L = """notes AS (SELECT l_suppkey AS file_id, l_returnflag AS track_id, l_orderkey * 10 + l_linenumber AS note_id, CAST(l_quantity AS INT) AS pitch, CAST(round(l_discount * 1000) AS INT) AS velocity,
  CAST(round(l_discount * 1000) AS INT) AS dur, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS start, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(round(l_discount * 1000) AS INT) AS "end",
  l_linestatus = 'F' AS is_drum FROM lineitem), mel AS (SELECT * FROM notes WHERE NOT is_drum)"""

#: Windowed differences of a track's notes.
LAGS = """lags AS (SELECT *, start - lag(start) OVER (PARTITION BY track_id ORDER BY start, note_id) AS ioi, pitch - lag(pitch) OVER (PARTITION BY track_id ORDER BY note_id) AS step,
  CASE WHEN fmod(fmod(start, 2.0::DOUBLE) / 0.5::DOUBLE, 1.0::DOUBLE) <= 0.1::DOUBLE THEN 0 ELSE 1 END AS off FROM mel)"""

F10 = """f AS (SELECT track_id, avg(pitch) AS pitch_mean, stddev_pop(pitch) AS pitch_std, avg(dur) AS duration_mean, stddev_pop(dur) AS duration_std, coalesce(avg(ioi), 0) AS ioi_mean, coalesce(stddev_pop(ioi), 0) AS ioi_std,
  avg(off) AS syncopation_ratio, 120.0::DOUBLE AS tempo, coalesce(stddev_pop(abs(step)), 0) AS interval_std, coalesce(sum(sign(step)), 0)::DOUBLE / count(*) AS contour_slope, count(*) AS n_notes FROM lags GROUP BY track_id HAVING count(*) >= 2)"""

FEATURES = ["pitch_mean", "pitch_std", "duration_mean", "duration_std", "ioi_mean", "ioi_std", "syncopation_ratio", "tempo", "interval_std", "contour_slope"]
LONG10 = f"long AS (UNPIVOT f ON {', '.join(FEATURES)} INTO NAME feature VALUE value)"


def gram(expr: str, n: int) -> str:
    """Text of a window's tokens, from lead()."""
    return " || ',' || ".join(f"CAST({expr} AS VARCHAR)" if k == 0 else f"CAST(lead({expr}, {k}) OVER w AS VARCHAR)" for k in range(n))


def longer(source: str, keys: str, least: int, most: int) -> str:
    """SQL: lv (keys, pos, n, gram, c), windows of ``source`` (keys, pos, token) that repeat, each length made from the repeats of the one before."""
    same = " AND ".join(f"l.{k} = t.{k}" for k in keys.split(", "))
    held = ", ".join(f"l.{k}" for k in keys.split(", "))
    first = "CAST(token AS VARCHAR)" + "".join(f" || ',' || lead(token, {k}) OVER w" for k in range(1, least))
    return f"""lv AS (SELECT {keys}, pos, n, gram, count(*) OVER (PARTITION BY {keys}, gram) AS c FROM (SELECT {keys}, pos, {least} AS n, {first} AS gram FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY pos)) WHERE gram IS NOT NULL
  UNION ALL SELECT *, count(*) OVER (PARTITION BY {keys}, gram) AS c FROM (SELECT {held}, l.pos, l.n + 1 AS n, l.gram || ',' || t.token AS gram FROM lv l JOIN {source} t ON {same} AND t.pos = l.pos + l.n WHERE l.c > 1 AND l.n < {most}))"""
