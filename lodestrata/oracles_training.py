"""Plain SQL statements of problems 1 to 6, for a second engine to check the results with."""

from __future__ import annotations

_FM = "(SELECT DISTINCT * FROM frontmatter)"
_LATEST_TICKETS = "(SELECT *, upper(trim(record_id)) AS k FROM (SELECT DISTINCT * FROM tickets) QUALIFY row_number() OVER (PARTITION BY upper(trim(record_id)) ORDER BY updated_at DESC) = 1)"
_LATEST_DECISIONS = "(SELECT *, upper(trim(id)) AS k FROM (SELECT DISTINCT * FROM decisions) QUALIFY row_number() OVER (PARTITION BY upper(trim(id)) ORDER BY updated_at DESC) = 1)"

_P1_CHANGES = """
WITH RECURSIVE n AS (SELECT path, split_part(path, '/', 1) AS folder, strftime(make_timestamp(ctime * 1000000), '%Y-%m') AS period FROM (SELECT DISTINCT path, ctime FROM files) WHERE path LIKE '%/%'),
m AS (SELECT folder, period, count(*) AS files, lag(period) OVER (PARTITION BY folder ORDER BY period) AS previous FROM n GROUP BY folder, period),
r AS ({rows}),
t AS (SELECT folder, period, key, type, row_number() OVER (PARTITION BY folder, period, key ORDER BY count(*) DESC, type) AS rn FROM r GROUP BY folder, period, key, type),
c AS (SELECT folder, period, key, count(DISTINCT path) AS carriers FROM r GROUP BY ALL),
s AS (SELECT folder, period, key, type FROM t JOIN c USING (folder, period, key) JOIN m USING (folder, period) WHERE rn = 1 AND 2 * carriers >= files),
b AS (SELECT coalesce(x.folder, y.folder) AS folder, coalesce(x.period, y.period) AS period, coalesce(x.key, y.key) AS key, x.type AS new_type, y.type AS old_type
      FROM (SELECT s.* FROM s JOIN m USING (folder, period) WHERE previous IS NOT NULL) x
      FULL JOIN (SELECT m.folder, m.period, s.key, s.type FROM s JOIN m ON s.folder = m.folder AND s.period = m.previous) y ON x.folder = y.folder AND x.period = y.period AND x.key = y.key),
p AS (SELECT a.folder, a.period, d.key AS o, a.key AS n FROM b a JOIN b d USING (folder, period) WHERE a.old_type IS NULL AND d.new_type IS NULL AND a.new_type = d.old_type AND {sibling}),
d AS (SELECT DISTINCT p.folder, p.period, o, n, r.value_json AS v, EXISTS (SELECT 1 FROM r q WHERE q.folder = p.folder AND q.key = p.o AND q.period < p.period AND q.value_json = r.value_json) AS hit
      FROM p JOIN r ON r.folder = p.folder AND r.period = p.period AND r.key = p.n),
e AS (SELECT folder, period, o, n, count(*) AS total, count(*) FILTER (WHERE hit) AS hits FROM d GROUP BY ALL),
g AS (SELECT folder, period, list([{{'o': o, 'n': n}}] ORDER BY o, n) AS pairs FROM e WHERE 2 * hits > total GROUP BY ALL),
w AS (SELECT folder, period, unnest(list_reduce(pairs, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.o = x[1].o OR y.n = x[1].n)) > 0 THEN a ELSE list_concat(a, x) END), recursive := true) FROM g)
"""
_TOP_ROWS = f"SELECT folder, period, f.path, key, type, value_json FROM {_FM} f JOIN n USING (path)"
# with the members of objects, which in these tables are one level deep
_ALL_ROWS = f"""WITH o AS ({_TOP_ROWS}) SELECT * FROM o
 UNION ALL SELECT folder, period, o.path, o.key || chr(31) || j.key, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'number' END, j.value::VARCHAR
 FROM o, json_each(o.value_json) j WHERE o.type = 'object' AND json_type(o.value_json) = 'OBJECT' AND j.type <> 'NULL'"""
_PARENT = "CASE WHEN contains({0}, chr(31)) THEN split_part({0}, chr(31), 1) ELSE '' END"
P1 = _P1_CHANGES.format(rows=_TOP_ROWS, sibling="true") + """
SELECT folder, period, 'renamed' AS change_kind, n AS field_key, o AS old_key FROM w
UNION ALL SELECT folder, period, 'retyped', key, '' FROM b WHERE new_type <> old_type
UNION ALL SELECT folder, period, 'added', key, '' FROM b WHERE old_type IS NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.folder = b.folder AND w.period = b.period AND w.n = b.key)
UNION ALL SELECT folder, period, 'removed', key, '' FROM b WHERE new_type IS NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.folder = b.folder AND w.period = b.period AND w.o = b.key)
"""
_P1_TREES = _P1_CHANGES.format(rows=_ALL_ROWS, sibling=f"{_PARENT.format('a.key')} = {_PARENT.format('d.key')}")
P1_SCRIPT = _P1_TREES + """
SELECT w.folder, w.period, 'rename' AS op, n AS node, o AS old_node, x.new_type AS old_type, x.new_type AS new_type, 1.0::DOUBLE AS cost FROM w JOIN b x ON x.folder = w.folder AND x.period = w.period AND x.key = w.n
UNION ALL SELECT folder, period, 'retype', key, key, old_type, new_type, 1.0 FROM b WHERE new_type <> old_type
UNION ALL SELECT folder, period, 'add', key, NULL, NULL, new_type, 1.0 FROM b WHERE old_type IS NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.folder = b.folder AND w.period = b.period AND w.n = b.key)
UNION ALL SELECT folder, period, 'delete', NULL, key, old_type, NULL, 1.0 FROM b WHERE new_type IS NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.folder = b.folder AND w.period = b.period AND w.o = b.key)
"""
P1_CONSISTENT = _P1_TREES + """
, ids AS (SELECT *, row_number() OVER () AS id FROM r),
q AS (SELECT id, folder, key AS k, period AS till, 0 AS step FROM ids
 UNION ALL SELECT q.id, q.folder, w.n || substr(q.k, length(w.o) + 1), w.period, q.step + 1 FROM q JOIN w ON w.folder = q.folder AND w.period > q.till AND (w.o = q.k OR starts_with(q.k, w.o || chr(31))) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY w.period) = 1),
f AS (SELECT id, arg_max(k, step) AS field_key FROM q GROUP BY id),
y AS (SELECT folder, key AS field_key, arg_max(type, period) AS newest FROM s GROUP BY ALL),
v AS (SELECT ids.*, field_key, coalesce(newest, type) AS field_type, CASE WHEN json_type(value_json) <> 'NULL' THEN json_extract_string(value_json, '$') END AS x FROM ids JOIN f USING (id) LEFT JOIN y USING (folder, field_key))
SELECT folder, period, path, key AS source_key, field_key, field_type, value_json,
 CASE field_type WHEN 'number' THEN TRY_CAST(x AS DOUBLE)::VARCHAR WHEN 'bool' THEN CASE WHEN lower(x) IN ('true', '1', 'yes', 'on') THEN 'true' WHEN lower(x) IN ('false', '0', 'no', 'off') THEN 'false' END ELSE x END AS value FROM v
"""

_MOMENT = "(CASE WHEN right({0}, 1) = 'Z' THEN replace(replace({0}, 'T', ' '), 'Z', '')::TIMESTAMP WHEN regexp_matches({0}, '[+-][0-9]{{2}}:[0-9]{{2}}$') THEN replace(left({0}, length({0}) - 6), 'T', ' ')::TIMESTAMP - CASE substr({0}, length({0}) - 5, 1) WHEN '-' THEN -1 ELSE 1 END * (to_hours(substr({0}, length({0}) - 4, 2)::INT) + to_minutes(right({0}, 2)::INT)) ELSE {0}::TIMESTAMP END)"

P2 = f"""
WITH h AS (SELECT DISTINCT upper(trim(ticket_record_id)) AS k, field, {_MOMENT.format('changed_at')} AS ts, old_value AS o, new_value AS v FROM ticket_history WHERE deleted_at IS NULL),
x AS (SELECT *, count(*) FILTER (WHERE o IS DISTINCT FROM v) OVER (PARTITION BY k, field, ts) AS moves FROM h),
l AS (SELECT k, field, ts, o, v FROM x WHERE moves = 0 OR o IS DISTINCT FROM v),
ends AS (SELECT k, field, ts, val, sum(d) AS d FROM (SELECT k, field, ts, v AS val, 1 AS d FROM l UNION ALL SELECT k, field, ts, o, -1 FROM l) GROUP BY ALL),
i AS (SELECT k, field, ts, count(*) AS n, any_value(o) AS o1, any_value(v) AS v1, list_distinct(list(o)) AS vals, bool_or(o IS NULL) AS has_null FROM l GROUP BY ALL),
j AS (SELECT i.*, n > 1 AND NOT EXISTS (SELECT 1 FROM ends e WHERE e.k = i.k AND e.field = i.field AND e.ts = i.ts AND d > 0) AS ring,
      CASE WHEN n = 1 THEN o1 ELSE (SELECT min(val) FROM ends e WHERE e.k = i.k AND e.field = i.field AND e.ts = i.ts AND d < 0) END AS first,
      CASE WHEN n = 1 THEN v1 ELSE (SELECT max(val) FROM ends e WHERE e.k = i.k AND e.field = i.field AND e.ts = i.ts AND d > 0) END AS last FROM i),
c AS (SELECT *, lag(CASE WHEN NOT ring THEN {{'v': last}} END IGNORE NULLS) OVER w AS prior, lead(CASE WHEN NOT ring THEN {{'v': first}} END IGNORE NULLS) OVER w AS coming FROM j WINDOW w AS (PARTITION BY k, field ORDER BY ts)),
ok AS (SELECT *, prior IS NOT NULL AND (CASE WHEN prior.v IS NULL THEN has_null ELSE list_contains(vals, prior.v) END) AS use_prior,
      coming IS NOT NULL AND (CASE WHEN coming.v IS NULL THEN has_null ELSE list_contains(vals, coming.v) END) AS use_coming FROM c),
f AS (SELECT k, field, ts, CASE WHEN NOT ring THEN last WHEN use_prior THEN prior.v WHEN use_coming THEN coming.v WHEN has_null THEN NULL ELSE list_min(vals) END AS val,
      CASE WHEN NOT ring THEN first WHEN use_prior THEN prior.v WHEN use_coming THEN coming.v WHEN has_null THEN NULL ELSE list_min(vals) END AS start FROM ok),
born AS (SELECT k, {_MOMENT.format('created_at')} AS ts FROM {_LATEST_TICKETS}),
z AS (SELECT k, field, ts, val FROM f UNION ALL SELECT f.k, f.field, born.ts, f.start FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k, field ORDER BY ts) = 1) f JOIN born USING (k) WHERE born.ts < f.ts),
q AS (SELECT *, row_number() OVER w = 1 OR val IS DISTINCT FROM lag(val) OVER w AS turn FROM z WINDOW w AS (PARTITION BY k, field ORDER BY ts)),
u AS (SELECT k, field, ts, val, lead(ts) OVER (PARTITION BY k, field ORDER BY ts) AS until FROM q WHERE turn)
"""
P2_VALUES = P2 + "SELECT k AS entity, field AS attr, val AS value, epoch_ms(ts) AS from_ms, coalesce(epoch_ms(until), -1) AS to_ms FROM u WHERE val IS NOT NULL"
P2 += "SELECT k AS ticket_record_id, field, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS valid_from, coalesce(strftime(until, '%Y-%m-%d %H:%M:%S.%g'), 'open') AS valid_to FROM u WHERE val IS NOT NULL"

_P3_ALL = f"""
WITH live AS (SELECT k FROM {_LATEST_DECISIONS} WHERE deleted_at IS NULL),
names AS (SELECT path AS t FROM files UNION SELECT regexp_replace(path, '\\.md$', '') FROM files UNION SELECT regexp_extract(path, '[^/]*$') FROM files UNION SELECT regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '') FROM files),
months AS (SELECT path, strftime(make_timestamp(min(ctime) * 1000000), '%Y-%m') AS period FROM files GROUP BY path),
l AS (SELECT DISTINCT source_path, target_path, regexp_replace(regexp_replace(target_path, '#.*$', '', 's'), '^\\s+|\\s+$', '', 'g') AS t FROM links),
a AS (SELECT DISTINCT 'decision_refs' AS ref_table, source_id AS source_key, target_id AS target_key, left(created_at, 7) AS period FROM decision_refs WHERE deleted_at IS NULL AND trim(target_id) <> '' AND upper(trim(target_id)) NOT IN (SELECT k FROM live)
 UNION SELECT DISTINCT 'tickets', record_id, decision_ref, left(created_at, 7) FROM {_LATEST_TICKETS} WHERE deleted_at IS NULL AND trim(decision_ref) <> '' AND upper(trim(decision_ref)) NOT IN (SELECT k FROM live)
 UNION SELECT DISTINCT 'links', source_path, target_path, m.period FROM l LEFT JOIN months m ON m.path = source_path WHERE t <> '' AND NOT regexp_matches(lower(t), '^(http|https|mailto):') AND t NOT IN (SELECT t FROM names)),
f AS (SELECT ref_table, source_key, target_key, min(period) AS period FROM a GROUP BY ALL)
"""
P3 = _P3_ALL + "SELECT ref_table, source_key, target_key FROM f"
P3_REPORT = _P3_ALL + "SELECT ref_table, coalesce(period, '') AS period, count(*) AS orphans, count(DISTINCT source_key) AS sources, count(DISTINCT target_key) AS targets FROM f GROUP BY ALL"

_TICKET_FIELDS = ("record_id", "type", "parent_record_id", "title", "description", "status", "priority", "assigned_to", "team", "decision_ref", "created_at")
_TICKET_JSON = "'{' || concat_ws(',', " + ", ".join(f"""'"{c}":' || to_json({c})""" for c in _TICKET_FIELDS) + ") || '}'"
STATE = f"""
WITH v AS (SELECT 'tickets' AS table_name, record_id AS row_key, '' AS log_file, 0 AS line_no, updated_at, deleted_at, hash, {_TICKET_JSON} AS row_json FROM (SELECT DISTINCT * FROM tickets)
 UNION ALL SELECT table_name, list_aggregate(list_transform(string_split(key_columns, ','), lambda c: json_extract_string(row_json, '$.' || c)), 'string_agg', '|'), log_file, line_no, updated_at, deleted_at, hash, row_json FROM (SELECT DISTINCT * FROM changelog)),
state AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY table_name, row_key ORDER BY updated_at DESC, log_file DESC, line_no DESC) = 1)
"""
P4_STATE = STATE + "SELECT table_name, row_key, deleted_at, hash, row_json FROM state"
P4 = STATE + "SELECT table_name, row_key, hash FROM state WHERE deleted_at IS NULL"

_TREE = f"""
WITH RECURSIVE t AS (SELECT k, record_id, type, upper(trim(parent_record_id)) AS parent FROM {_LATEST_TICKETS} WHERE deleted_at IS NULL),
r AS (SELECT k, record_id AS root, 0 AS depth, record_id AS path FROM t WHERE parent IS NULL OR parent NOT IN (SELECT k FROM t)
 UNION ALL SELECT t.k, r.root, r.depth + 1, r.path || '/' || t.record_id FROM t JOIN r ON t.parent = r.k)
"""
P5 = _TREE + "SELECT t.record_id, coalesce(r.root, 'cycle') AS root_record_id, coalesce(r.depth, -1)::INTEGER AS depth FROM t LEFT JOIN r USING (k)"
P5_PATHS = _TREE + "SELECT t.record_id, t.type, r.path FROM t LEFT JOIN r USING (k)"
P5_DESCENDANTS = _TREE + "SELECT a.v AS ancestor, list_extract(string_split(path, '/'), -1) AS descendant, (depth - a.i + 1)::INTEGER AS distance FROM r, LATERAL (SELECT unnest(string_split(path, '/')) AS v, generate_subscripts(string_split(path, '/'), 1) AS i) a WHERE a.i <= depth"
P5_RINGS = _TREE + "SELECT t.record_id, t.parent AS parent_record_id FROM t LEFT JOIN r USING (k) WHERE r.k IS NULL"

_CELLS = f"""
WITH r AS (SELECT path, regexp_replace(lower(regexp_replace(key, '^\\s+|\\s+$', '', 'g')), '[-\\s]', '_', 'g') AS key_name, value_json AS j, json_type(value_json) AS t, json_extract_string(value_json, '$') AS s FROM {_FM}),
c AS (SELECT path, key_name, CASE col_type
 WHEN 'number' THEN CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN printf('%.3f', s::DOUBLE) WHEN t = 'VARCHAR' AND regexp_full_match(trim(s), '[+-]?[0-9]+(\\.[0-9]+)?') THEN printf('%.3f', trim(s)::DOUBLE) END
 WHEN 'bool' THEN CASE WHEN t = 'BOOLEAN' THEN s WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CASE s::DOUBLE WHEN 1 THEN 'true' WHEN 0 THEN 'false' END
   WHEN t = 'VARCHAR' THEN CASE WHEN lower(trim(s)) IN ('true', 'yes', 'on') THEN 'true' WHEN lower(trim(s)) IN ('false', 'no', 'off') THEN 'false' END END
 WHEN 'date' THEN CASE WHEN t = 'VARCHAR' THEN CASE WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?', 's') THEN CAST(TRY_CAST(left(s, 10) AS DATE) AS VARCHAR)
   WHEN regexp_full_match(s, '[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}') THEN CAST(TRY_CAST(replace(s, '/', '-') AS DATE) AS VARCHAR)
   WHEN regexp_full_match(s, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}') THEN CAST(TRY_CAST(right(s, 4) || '-' || substr(s, 4, 2) || '-' || left(s, 2) AS DATE) AS VARCHAR) END END
 WHEN 'list' THEN CASE WHEN t IN ('ARRAY', 'VARCHAR') THEN nullif(array_to_string(list_filter(list_transform(CASE WHEN t = 'ARRAY' THEN json_extract_string(j, '$[*]') ELSE regexp_split_to_array(s, '[,;\\s]+') END,
   lambda x: trim(regexp_replace(trim(x), '^#', ''))), lambda x: x <> ''), ','), '') END
 WHEN 'string' THEN CASE WHEN t = 'VARCHAR' THEN nullif(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '') END END AS cell FROM r JOIN (SELECT DISTINCT * FROM wide_spec) USING (key_name))
"""
P6 = _CELLS + "SELECT path, key_name, cell FROM c WHERE cell IS NOT NULL"

# fixed values: the rows of wide_spec
WIDE = {
    "number": ("budget", "effort", "iso_week", "points", "rating", "score", "stars", "tally", "vote_count", "votes", "week"),
    "bool": ("archived", "checked", "is_archived", "pinned", "reviewed", "sticky", "voting"),
    "date": ("due_date", "held_on", "started"),
    "list": ("attendees", "tags"),
    "string": ("area", "domain", "keeper", "lead", "lens", "owner", "phase", "place", "slug", "state", "status", "type", "venue", "viewpoint"),
}
_COLUMNS = ", ".join(f"max(CASE WHEN key_name = '{k}' THEN cell END){'::DOUBLE' if t == 'number' else ''} AS {k}" for t, keys in WIDE.items() for k in keys)
P6_WIDE = _CELLS + f"SELECT p.path, {_COLUMNS} FROM (SELECT DISTINCT path FROM frontmatter WHERE path IS NOT NULL) p LEFT JOIN c ON c.path = p.path GROUP BY p.path"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1, "p1_script": P1_SCRIPT, "p1_consistent": P1_CONSISTENT, "p2_found": P2, "p2_values": P2_VALUES, "p4_state": P4_STATE, "p6_wide": P6_WIDE, "p3_found": P3, "p3_report": P3_REPORT, "p4_found": P4, "p5_found": P5, "p5_paths": P5_PATHS,
        "p5_descendants": P5_DESCENDANTS, "p5_rings": P5_RINGS, "p6_found": P6,
    }
