"""The same answers in plain SQL (DuckDB), by direct definition instead of the operators' methods."""

from __future__ import annotations

_UTC = "strftime(timezone('UTC', {}), '%Y-%m-%d %H:%M:%S')"

_DAY = "try_cast(CASE WHEN length(trim({0})) = 8 THEN substr(trim({0}), 1, 4) || '-' || substr(trim({0}), 5, 2) || '-' || substr(trim({0}), 7, 2) ELSE substr(trim({0}), 1, 10) END AS date)"

_QUOTES = """
q_main AS (SELECT upper(trim(symbol)) s, observation_time::timestamptz t, max(close) c FROM yahoo_crosscheck GROUP BY ALL),
q_copy AS (SELECT upper(trim(symbol)) s, observation_time::timestamptz t, max(close) c FROM yahoo_mirror GROUP BY ALL),
o_main AS (SELECT question_id q, slot, any_value(try_cast(trim(actual) AS decimal(38, 12))) a, any_value(lower(trim(regexp_replace(source, '\\s+', ' ', 'g')))) s, any_value(try_cast(trim(reference) AS decimal(38, 12))) r FROM source_observation GROUP BY ALL),
o_copy AS (SELECT question_id q, slot, any_value(try_cast(trim(actual) AS decimal(38, 12))) a, any_value(lower(trim(regexp_replace(source, '\\s+', ' ', 'g')))) s, any_value(try_cast(trim(reference) AS decimal(38, 12))) r FROM source_observation_copy GROUP BY ALL),
found AS (
  SELECT 'yahoo_crosscheck' AS dataset, coalesce(m.s, c.s) AS key_1, strftime(timezone('UTC', coalesce(m.t, c.t)), '%Y-%m-%d %H:%M:%S') AS key_2,
    CASE WHEN c.s IS NULL THEN 'missing_in_copy' WHEN m.s IS NULL THEN 'missing_in_main' WHEN (m.c IS NULL) <> (c.c IS NULL) OR abs(m.c - c.c) > 0.00005 THEN 'close' END AS finding
  FROM q_main m FULL JOIN q_copy c ON m.s = c.s AND m.t = c.t
  UNION ALL
  SELECT 'source_observation', coalesce(m.q, c.q), coalesce(m.slot, c.slot), unnest(CASE WHEN c.q IS NULL THEN ['missing_in_copy'] WHEN m.q IS NULL THEN ['missing_in_main'] ELSE
    [CASE WHEN m.a IS DISTINCT FROM c.a THEN 'actual' END, CASE WHEN m.s IS DISTINCT FROM c.s THEN 'source' END, CASE WHEN m.r IS DISTINCT FROM c.r THEN 'reference' END] END)
  FROM o_main m FULL JOIN o_copy c ON m.q = c.q AND m.slot = c.slot)
"""

_ARRIVALS = """
received AS (SELECT receipt_id, min(retrieved_at::timestamptz) received_at FROM raw_time_series_receipt GROUP BY receipt_id),
arrived AS (SELECT event_id, any_value(event_type) event_type, any_value(scheduled_at::timestamptz) s, any_value(actual) actual, min(coalesce(received_at, retrieved_at::timestamptz)) a FROM event_fact LEFT JOIN received USING (receipt_id) GROUP BY event_id),
placed AS (SELECT *, date_trunc('day', timezone('UTC', s)) AS d, date_diff('microsecond', date_trunc('day', timezone('UTC', s)) + INTERVAL 1 DAY, timezone('UTC', a)) AS late_us FROM arrived)
"""

_VINTAGES = f"""
v AS (SELECT alfred_id, any_value(series_id) series_id, any_value({_DAY.format('observation_time')}) o, any_value(value) AS value, any_value({_DAY.format('realtime_start')}) rs,
    any_value(CASE WHEN realtime_end LIKE '9999%' THEN NULL ELSE {_DAY.format('realtime_end')} END) re
  FROM alfred WHERE value IS NOT NULL GROUP BY alfred_id)
"""

_KNOWN = f"""
{_VINTAGES},
spans AS (SELECT *, (rs + INTERVAL '8 hours 30 minutes') AT TIME ZONE 'America/New_York' AS lo, (re + INTERVAL '32 hours 30 minutes') AT TIME ZONE 'America/New_York' AS hi FROM v),
asked AS (SELECT DISTINCT e.event_id, e.available_at::timestamptz AS t, r.series_id FROM event_fact e JOIN raw_time_series_receipt r ON e.receipt_id = r.receipt_id),
ranked AS (SELECT a.event_id, s.*, row_number() OVER (PARTITION BY a.event_id ORDER BY o DESC, rs DESC, alfred_id DESC) AS k
  FROM asked a JOIN spans s ON a.series_id = s.series_id AND a.t >= s.lo AND (s.hi IS NULL OR a.t < s.hi))
"""

_NEAREST = """
q AS (SELECT DISTINCT yahoo_id, series_id, observation_time::timestamptz t FROM yahoo_crosscheck JOIN series_map USING (symbol) WHERE close IS NOT NULL),
r AS (SELECT DISTINCT nyfed_id, series_id, observation_time::timestamptz t FROM nyfed_markets WHERE value IS NOT NULL),
pairs AS (SELECT yahoo_id, nyfed_id, row_number() OVER (PARTITION BY yahoo_id ORDER BY abs(epoch_us(q.t) - epoch_us(r.t)), r.t, nyfed_id) AS k
  FROM q JOIN r ON q.series_id = r.series_id AND r.t BETWEEN q.t - INTERVAL 90 SECOND AND q.t + INTERVAL 90 SECOND)
"""

_HISTORY = f"""
f AS (SELECT event_id, any_value(source_id) src, any_value(event_type) ty, any_value(scheduled_at::timestamptz) s, any_value(available_at::timestamptz) a, any_value(revision_seq) seq, any_value(supersedes) sup,
    any_value(consensus) c1, any_value(model_nowcast) c2, any_value(policy_relief) c3, any_value(actual) c4, any_value(outcome_return_5d) c5, any_value(unit) u FROM event_fact GROUP BY event_id),
links AS (SELECT f.event_id AS x, g.event_id AS y FROM f JOIN f g ON f.sup = g.event_id UNION SELECT g.event_id, f.event_id FROM f JOIN f g ON f.sup = g.event_id
    UNION SELECT f.event_id, g.event_id FROM f JOIN f g ON f.src = g.src AND f.ty = g.ty AND f.s = g.s),
reach AS (SELECT event_id AS x, event_id AS y FROM f UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
rel AS (SELECT x AS event_id, min(y) AS release FROM reach GROUP BY x),
fr AS (SELECT f.*, release FROM f JOIN rel USING (event_id)),
live AS (SELECT *, (SELECT min(g.a) FROM fr g WHERE g.release = fr.release AND g.seq > fr.seq) AS e FROM fr),
kept AS (SELECT * FROM live WHERE e IS NULL OR e > a),
marked AS (SELECT *, coalesce(row(s, c1, c2, c3, c4, c5, u) IS NOT DISTINCT FROM lag(row(s, c1, c2, c3, c4, c5, u)) OVER w, false) AND lag(event_id) OVER w IS NOT NULL AS same FROM kept WINDOW w AS (PARTITION BY release ORDER BY seq, a, event_id)),
fv AS (SELECT release, event_id, a, lead(a) OVER (PARTITION BY release ORDER BY seq, a, event_id) AS b, count(*) OVER (PARTITION BY release) AS n FROM marked WHERE NOT same),
{_VINTAGES},
am AS (SELECT *, lag(value) OVER (PARTITION BY series_id, o ORDER BY rs, alfred_id) AS was FROM v),
av AS (SELECT alfred_id, rs, lead(rs) OVER (PARTITION BY series_id, o ORDER BY rs, alfred_id) AS nxt, count(*) OVER (PARTITION BY series_id, o) AS n FROM am WHERE was IS NULL OR was <> value)
"""

_PERIODS = f"""
{_VINTAGES},
p AS (SELECT v.*, frequency, CASE frequency
    WHEN 'D' THEN o - greatest(isodow(o) - 5, 0)::int WHEN 'W' THEN date_trunc('week', o)::date
    WHEN 'M' THEN date_trunc('month', o)::date WHEN 'Q' THEN date_trunc('quarter', o)::date END AS d FROM v JOIN series_catalog USING (series_id)),
ends AS (SELECT series_id, frequency, min(d) a, max(d) b FROM p WHERE d IS NOT NULL GROUP BY ALL),
days AS (SELECT series_id, frequency, unnest(range(a::timestamp, b::timestamp + INTERVAL 1 DAY, INTERVAL 1 DAY))::date AS d FROM ends),
grid AS (SELECT * FROM days WHERE CASE frequency WHEN 'D' THEN isodow(d) < 6 WHEN 'W' THEN isodow(d) = 1 WHEN 'M' THEN day(d) = 1 ELSE day(d) = 1 AND month(d) % 3 = 1 END),
best AS (SELECT series_id, d, arg_max(value, (o, rs, alfred_id)) AS value FROM p GROUP BY ALL)
"""

_READINGS = f"""
raw AS (SELECT 'yahoo_crosscheck' AS dataset, symbol AS source, epoch_us(observation_time::timestamptz) AS moment, 0::bigint AS since, yahoo_id AS id, close AS x FROM yahoo_crosscheck
    UNION ALL SELECT 'alfred', series_id, epoch_us({_DAY.format('observation_time')}::timestamp), epoch_us({_DAY.format('realtime_start')}::timestamp), alfred_id, value FROM alfred),
x0 AS (SELECT dataset, source, moment, since, id, any_value(x) AS x FROM raw WHERE source IS NOT NULL AND moment IS NOT NULL AND id IS NOT NULL AND x IS NOT NULL GROUP BY ALL),
x1 AS (SELECT *, (x IS DISTINCT FROM lag(x) OVER w)::int AS fresh FROM x0 WINDOW w AS (PARTITION BY dataset, source ORDER BY moment, since, id)),
x2 AS (SELECT *, sum(fresh) OVER (PARTITION BY dataset, source ORDER BY moment, since, id) AS k FROM x1),
x3 AS (SELECT dataset, source, k::int AS k, count(*)::int AS n, any_value(x) AS x FROM x2 GROUP BY ALL),
x4 AS (SELECT dataset, source, sum(least(n, 8)) / count(*) AS u FROM x3 GROUP BY ALL),
x5 AS (SELECT dataset, source, 1 AS k, u::double AS u FROM x4 WHERE u < 2.5
    UNION ALL SELECT p.dataset, p.source, p.k + 1, p.u + 0.01 * (CASE WHEN r.n < 7 THEN r.n ELSE 1 END - p.u) FROM x5 p JOIN x3 r ON p.dataset = r.dataset AND p.source = r.source AND p.k = r.k),
x6 AS (SELECT r.* FROM x3 r JOIN x5 p ON p.dataset = r.dataset AND p.source = r.source AND p.k = r.k WHERE r.n >= 7 AND r.n >= 5 * p.u AND r.x > 0)
"""

SQL = {
    "p6_run_faults": f"""WITH RECURSIVE {_READINGS} SELECT dataset, id AS row_id, 'impossible' AS fault FROM x0 WHERE x <= 0
        UNION ALL SELECT x2.dataset, x2.id, 'stuck' FROM x2 JOIN x6 USING (dataset, source, k) WHERE x2.fresh = 0""",
    "p1_found": f"WITH {_QUOTES} SELECT dataset, key_1, key_2, finding FROM found WHERE finding IS NOT NULL",
    "p1_summary": f"WITH {_QUOTES} SELECT dataset, finding, count(*) AS n FROM found WHERE finding IS NOT NULL GROUP BY ALL",
    "p2_found": f"WITH {_ARRIVALS} SELECT event_id, CASE WHEN late_us < 864000000000 THEN 'corrects' ELSE 'too_late' END AS fate FROM placed WHERE late_us >= 0",
    "p2_periods": f"WITH {_ARRIVALS} SELECT event_type, strftime(d, '%Y-%m-%d') AS day, count(*) AS n, count(actual) AS n_actual, round(avg(actual), 10) AS mean_actual FROM placed WHERE late_us < 864000000000 GROUP BY event_type, d",
    "p2_provisional": f"""WITH {_ARRIVALS},
        slots AS (SELECT event_type, d, actual, CASE WHEN late_us < 0 THEN 0 ELSE late_us // 86400000000 + 1 END AS k FROM placed WHERE late_us < 864000000000),
        per AS (SELECT event_type, d, k, count(*) n, count(actual) na, coalesce(sum(actual), 0) s FROM slots GROUP BY ALL),
        cum AS (SELECT event_type, d, k, sum(n) OVER w AS n, sum(na) OVER w AS na, sum(s) OVER w AS s FROM per WINDOW w AS (PARTITION BY event_type, d ORDER BY k))
        SELECT event_type, strftime(d, '%Y-%m-%d') AS day, strftime(d + to_days((k + 1)::int), '%Y-%m-%d %H:%M:%S') AS published_at, n::bigint AS n, na::bigint AS n_actual, round(s / nullif(na, 0), 10) AS mean_actual FROM cum""",
    "p3_found": f"WITH {_KNOWN} SELECT event_id, alfred_id FROM ranked WHERE k = 1",
    "p3_attributes": f"WITH {_KNOWN} SELECT event_id, series_id, alfred_id, strftime(o, '%Y-%m-%d') AS observation_date, value FROM ranked WHERE k = 1",
    "p4_found": f"WITH {_NEAREST} SELECT yahoo_id, nyfed_id FROM pairs WHERE k = 1",
    "p5_found": f"""WITH RECURSIVE {_HISTORY}
        SELECT 'event_fact' AS dataset, event_id AS version_key, {_UTC.format('a')} AS valid_from, coalesce({_UTC.format('b')}, '9999-12-31 00:00:00') AS valid_to FROM fv WHERE n > 1
        UNION ALL SELECT 'alfred', alfred_id::varchar, strftime(rs, '%Y-%m-%d'), coalesce(strftime(nxt, '%Y-%m-%d'), '9999-12-31') FROM av WHERE n > 1""",
    "p7_found": f"WITH {_PERIODS} SELECT g.series_id, strftime(g.d, '%Y-%m-%d') AS period_start FROM grid g ANTI JOIN best b ON g.series_id = b.series_id AND g.d = b.d",
    "p7_grid": f"""WITH {_PERIODS} SELECT g.series_id, strftime(g.d, '%Y-%m-%d') AS period_start, last_value(b.value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.d) AS value, b.d IS NULL AS missing
        FROM grid g LEFT JOIN best b ON g.series_id = b.series_id AND g.d = b.d""",
}
