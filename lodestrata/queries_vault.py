"""Queries over the vault and planning tables: the language, the named queries, ranking, planning, extraction, refresh.

Each entry has its SQL beside it where SQL can state it, so that both are read together.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dsl import compiler
from .functions.timetext import epoch_month
from .operators import changefeed, hierarchy
from .oracles_training import P4, STATE
from .plans import index, links, planning, planning_log, primitives, rank, snapshot
from .runtime import cut, scratch, stored, table
from .sources import base_view, decisions, markdown, sinks, statements
from .streaming import refresh
from .vault import Vault, vault

NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)
NOW_S = int(NOW.timestamp())

# --- SQL that several statements share -----------------------------------------------------------------------------

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_F = "f AS (SELECT DISTINCT * FROM files)"
_FM = "fm AS (SELECT DISTINCT * FROM frontmatter)"
_TAGS = """tags AS (SELECT DISTINCT path, regexp_replace(trim(t), '^#', '') AS tag FROM (SELECT path, unnest(CASE type WHEN 'list' THEN json_extract_string(value_json, '$[*]')
 WHEN 'string' THEN regexp_split_to_array(json_extract_string(value_json, '$'), '[ ,;]+') END) AS t FROM (SELECT DISTINCT * FROM frontmatter) WHERE key IN ('tags', 'tag', 'area')) WHERE regexp_replace(trim(t), '^#', '') <> '')"""
_HEADS = "heads AS (SELECT source_path AS path, 2 AS depth, regexp_extract(target_path, '[^#]*$') AS text, line AS line_offset FROM links WHERE target_path LIKE '%#%')"
_BUSY = "busy AS (SELECT source_path AS b FROM links GROUP BY source_path ORDER BY count(*) DESC, source_path LIMIT 1)"
_NAMES = f"(l.target_path = {{p}} OR l.target_path || '.md' = {{p}} OR {_LOW.format('{p}')} LIKE '%/' || {_LOW.format('l.target_path')} || '.md')"
_NAME = "regexp_replace(regexp_extract(path, '[^/]*$'), '(?i)\\.md$', '')"
_FOLDER = "regexp_replace(path, '/?[^/]*$', '')"
_TEXT_OF = "CASE m.type WHEN 'string' THEN m.value_text WHEN 'number' THEN NULL WHEN 'bool' THEN NULL ELSE m.value_json END"


def _fm(key: str) -> str:
    """LEFT JOIN of one frontmatter key as m."""
    return f"LEFT JOIN (SELECT * FROM fm WHERE key = '{key}') m USING (path)"


def _array_length(t: str) -> str:
    text = _TEXT_OF.replace("m.", f"{t}.")
    return f"CASE WHEN ({text}) IS NULL THEN CASE WHEN {t}.type IN ('number', 'bool') AND {t}.value_num IS NOT NULL THEN 0 END WHEN json_valid({text}) THEN json_array_length({text}) ELSE 0 END"


def busiest(v: Vault) -> str:
    """The note with most links, by name on a tie; '' in an empty vault."""
    row = v.links.groupBy("source_path").count().orderBy(F.desc("count"), "source_path").first()
    return row[0] if row else ""


# --- the query language: name, query ({busy} is the busiest note), SQL ----------------------------------------------

DSL: list[tuple[str, str, str]] = [
    ("star", "* ORDER BY path", f"WITH {_F} SELECT path, mtime, ctime, size, content_hash, last_scanned FROM f"),
    ("project", "path, size AS bytes", f"WITH {_F} SELECT path, size AS bytes FROM f"),
    ("where_cmp", "path, size WHERE size >= 1000 AND mtime > 1700000000 AND path != 'x' ORDER BY size DESC, path", f"WITH {_F} SELECT path, size FROM f WHERE size >= 1000 AND mtime > 1700000000"),
    ("and_or_not", "path WHERE NOT size < 500 AND (folder = '' OR name = 'README')", f"WITH {_F} SELECT path FROM f WHERE NOT size < 500 AND ({_FOLDER} = '' OR {_NAME} = 'README')"),
    ("like", "path WHERE path LIKE '%SURVEY%.md'", f"WITH {_F} SELECT path FROM f WHERE {_LOW.format('path')} LIKE '%survey%.md'"),
    ("like_any_char", "path, name WHERE name LIKE '______'", f"WITH {_F} SELECT path, {_NAME} AS name FROM f WHERE {_NAME} LIKE '______'"),
    ("glob", "path WHERE path GLOB '*/20[0-9][^9]/*.md'", f"WITH {_F} SELECT path FROM f WHERE regexp_full_match(path, '.*/20[0-9][^9]/.*\\.md', 's')"),
    ("in_tuple", "path, name WHERE name IN ('README', 'diary', 'profile')", f"WITH {_F} SELECT path, {_NAME} AS name FROM f WHERE {_NAME} IN ('README', 'diary', 'profile')"),
    ("not_in", "path WHERE folder NOT IN ('', 'atlas')", f"WITH {_F} SELECT path FROM f WHERE {_FOLDER} NOT IN ('', 'atlas')"),
    ("between", "path, size WHERE size BETWEEN 400 AND 800 AND NOT mtime BETWEEN 0 AND 1690000000", f"WITH {_F} SELECT path, size FROM f WHERE size BETWEEN 400 AND 800 AND NOT mtime BETWEEN 0 AND 1690000000"),
    ("is_null", "path WHERE fm.status IS NULL AND fm.type IS NOT NULL", f"WITH {_F}, {_FM} SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM fm m WHERE m.path = f.path AND key = 'status' AND CASE type WHEN 'string' THEN value_text IS NOT NULL WHEN 'number' THEN value_num IS NOT NULL WHEN 'bool' THEN value_num IS NOT NULL ELSE TRUE END) AND EXISTS (SELECT 1 FROM fm m WHERE m.path = f.path AND key = 'type' AND CASE type WHEN 'string' THEN value_text IS NOT NULL WHEN 'number' THEN value_num IS NOT NULL WHEN 'bool' THEN value_num IS NOT NULL ELSE TRUE END)"),
    ("distinct", "DISTINCT folder", f"WITH {_F} SELECT DISTINCT {_FOLDER} AS folder FROM f"),
    ("distinct_order", "DISTINCT folder ORDER BY size DESC, folder", f"WITH {_F} SELECT DISTINCT {_FOLDER} AS folder FROM f"),
    ("order_nulls", "path, fm.rating AS rating ORDER BY fm.rating DESC NULLS LAST, path LIMIT 25",
     f"WITH {_F}, {_FM}, x AS (SELECT path, CASE WHEN m.type IN ('number', 'bool') THEN m.value_num END AS num, ({_TEXT_OF}) AS str, CASE WHEN m.type = 'number' THEN CASE WHEN m.value_num = floor(m.value_num) THEN CAST(m.value_num::BIGINT AS VARCHAR) || '.0' ELSE m.value_num::VARCHAR END WHEN m.type = 'string' THEN m.value_text ELSE m.value_json END AS rating FROM f {_fm('rating')}) SELECT path, rating FROM x ORDER BY CASE WHEN str IS NOT NULL THEN 2 WHEN num IS NOT NULL THEN 1 ELSE 0 END DESC, num DESC NULLS LAST, str DESC NULLS LAST, path LIMIT 25"),
    ("limit_offset", "path, size ORDER BY size DESC, path LIMIT 20 OFFSET 5", f"WITH {_F} SELECT path, size FROM f ORDER BY size DESC, path LIMIT 20 OFFSET 5"),
    ("arithmetic", "path, size / 7 AS d, size % 7 AS m, size * 2 - 1 AS e, size / 4.0 AS r, -size AS n", f"WITH {_F} SELECT path, size // 7 AS d, size % 7 AS m, size * 2 - 1 AS e, size / 4.0::DOUBLE AS r, -size AS n FROM f"),
    ("concat", "path, folder || '|' || name || '|' || size AS c", f"WITH {_F} SELECT path, {_FOLDER} || '|' || {_NAME} || '|' || size AS c FROM f"),
    ("name_folder", "path, name, folder", f"WITH {_F} SELECT path, {_NAME} AS name, {_FOLDER} AS folder FROM f"),
    ("text_functions", "path, upper(name) AS u, lower(name) AS l, length(path) AS n, trim(path, 'adm.') AS t, replace(path, '-', '+') AS r, instr(path, '/') AS i, substr(path, -6, 3) AS s, substr(path, 0, 4) AS b",
     f"WITH {_F} SELECT path, translate({_NAME}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u, {_LOW.format(_NAME)} AS l, length(path) AS n, trim(path, 'adm.') AS t, replace(path, '-', '+') AS r, instr(path, '/') AS i, substr(path, greatest(length(path) - 5, 1), 3) AS s, left(path, 3) AS b FROM f"),
    ("number_functions", "path, abs(0 - size) AS a, round(size / 7.0, 2) AS r, ceil(size / 7.0) AS c, floor(size / 7.0) AS f, min(size, 1000) AS lo, max(size, mtime, 5) AS hi", f"WITH {_F} SELECT path, size AS a, round(size / 7.0::DOUBLE, 2) AS r, ceil(size / 7.0::DOUBLE) AS c, floor(size / 7.0::DOUBLE) AS f, least(size, 1000) AS lo, greatest(size, mtime, 5) AS hi FROM f"),
    ("date_functions", "path, date(mtime, 'unixepoch') AS d, datetime(ctime, 'unixepoch', 'start of month', '+1 month', '-1 day') AS e, strftime('%Y-%j %H', mtime, 'unixepoch') AS j, julianday(date(mtime, 'unixepoch')) AS y",
     f"WITH {_F} SELECT path, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d') AS d, strftime(date_trunc('month', make_timestamp(ctime * 1000000)) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS e, strftime(make_timestamp(mtime * 1000000), '%Y-%j %H') AS j, mtime // 86400 + 2440587.5::DOUBLE AS y FROM f"),
    ("dates_against_seconds", "path WHERE mtime > date('now', '-30 days')", f"WITH {_F} SELECT path FROM f WHERE FALSE"),
    ("printf", "path, printf('%08d %s %.1f', size, name, size / 3.0) AS p", f"WITH {_F} SELECT path, printf('%08d %s %.1f', size, {_NAME}, size / 3.0::DOUBLE) AS p FROM f"),
    ("json_functions", "path, json_array_length(fm.area) AS n, json_extract(fm.area, '$[0]') AS head, json(fm.area) AS j WHERE fm.area LIKE '[%]'", f"WITH {_F}, {_FM} SELECT path, json_array_length(m.value_json)::BIGINT AS n, json_extract_string(m.value_json, '$[0]') AS head, m.value_json AS j FROM f {_fm('area')} WHERE ({_TEXT_OF}) LIKE '[%]'"),
    ("glob_column", "path WHERE name GLOB substr(name, 1, 2) || '*e?'", f"WITH {_F} SELECT path FROM f WHERE length({_NAME}) >= 4 AND substr({_NAME}, -2, 1) = 'e'"),
    ("concat_function", "path, concat(folder, '|', name, size) AS c", f"WITH {_F} SELECT path, {_FOLDER} || '|' || {_NAME} || size AS c FROM f"),
    ("time_function", "path, time(mtime, 'unixepoch') AS t", f"WITH {_F} SELECT path, strftime(make_timestamp(mtime * 1000000), '%H:%M:%S') AS t FROM f"),
    ("aggregate_within", "upper(max(path)) AS p, size AS s, max(mtime) + 1 AS d, name ORDER BY size LIMIT 3", f"WITH {_F} SELECT translate(max(path), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS p, arg_max(size, path) AS s, max(mtime) + 1 AS d, arg_max({_NAME}, path) AS name FROM f"),
    ("coalesce_nullif", "path, coalesce(nullif(folder, ''), 'top') AS c, nullif(size, 0) AS n", f"WITH {_F} SELECT path, coalesce(nullif({_FOLDER}, ''), 'top') AS c, nullif(size, 0) AS n FROM f"),
    ("fm_string", "path, fm.status AS status WHERE fm.status = 'open' OR fm['type'] LIKE 'Pro%'",
     f"WITH {_F}, {_FM} SELECT path, CASE s.type WHEN 'string' THEN s.value_text ELSE s.value_json END AS status FROM f LEFT JOIN (SELECT * FROM fm WHERE key = 'status') s USING (path) {_fm('type')} WHERE (CASE s.type WHEN 'string' THEN s.value_text WHEN 'list' THEN s.value_json WHEN 'object' THEN s.value_json END) = 'open' OR {_LOW.format('(' + _TEXT_OF + ')')} LIKE 'pro%'"),
    ("fm_number", "path, fm.votes + 1 AS v WHERE fm.votes > 3", f"WITH {_F}, {_FM} SELECT path, CASE WHEN m.type IN ('number', 'bool') THEN m.value_num ELSE coalesce(TRY_CAST(nullif(regexp_extract({_TEXT_OF}, '^\\s*([+-]?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE), 0) END + 1 AS v FROM f {_fm('votes')} WHERE CASE WHEN m.type IN ('number', 'bool') THEN m.value_num > 3 ELSE ({_TEXT_OF}) IS NOT NULL END"),
    ("fm_bool", "path, fm.voting AS voting WHERE fm.voting = TRUE", f"WITH {_F}, {_FM} SELECT path, CASE m.type WHEN 'bool' THEN m.value_json ELSE CASE WHEN m.value_num = floor(m.value_num) THEN CAST(m.value_num::BIGINT AS VARCHAR) || '.0' ELSE m.value_num::VARCHAR END END AS voting FROM f {_fm('voting')} WHERE m.type IN ('number', 'bool') AND m.value_num = 1"),
    ("fm_mixed_in", "path WHERE fm.rating IN (3, '4', 5)", f"WITH {_F}, {_FM} SELECT path FROM f {_fm('rating')} WHERE (m.type IN ('number', 'bool') AND m.value_num IN (3, 5)) OR ({_TEXT_OF}) = '4'"),
    ("in_tags", "path WHERE 'depot' IN tags OR 'annex' IN tags", f"WITH {_F}, {_TAGS} SELECT path FROM f WHERE path IN (SELECT path FROM tags WHERE tag IN ('depot', 'annex'))"),
    ("not_in_tags", "path WHERE 'depot' NOT IN tags AND size > 1000", f"WITH {_F}, {_TAGS} SELECT path FROM f WHERE path NOT IN (SELECT path FROM tags WHERE tag = 'depot') AND size > 1000"),
    ("tag_mark", "path, 'mill' IN tags AS t", f"WITH {_F}, {_TAGS} SELECT path, (path IN (SELECT path FROM tags WHERE tag = 'mill'))::BIGINT AS t FROM f"),
    ("in_outlinks", "path WHERE 'atlas/home' IN outlinks", f"WITH {_F} SELECT path FROM f WHERE path IN (SELECT source_path FROM links WHERE target_path = 'atlas/home')"),
    ("in_inlinks", "path WHERE '{busy}' IN inlinks", f"WITH {_F}, {_BUSY} SELECT path FROM f WHERE EXISTS (SELECT 1 FROM links l, busy WHERE l.source_path = b AND {_NAMES.format(p='f.path')})"),
    ("in_headings", "path WHERE 'todo' IN headings", f"WITH {_F}, {_HEADS} SELECT path FROM f WHERE path IN (SELECT path FROM heads WHERE text = 'todo')"),
    ("max_row", "max(mtime) AS newest", f"WITH {_F} SELECT max(mtime) AS newest FROM f"),
    ("min_where", "min(size) AS least WHERE folder = ''", f"WITH {_F} SELECT min(size) AS least FROM f WHERE {_FOLDER} = ''"),
]


def _dsl(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = vault(spark, d)
        said = text.replace("{busy}", busiest(v).replace("'", "''")) if "{busy}" in text else text
        return compiler.query(v, f"SELECT {said}", NOW)

    return run


# --- named queries -------------------------------------------------------------------------------------------------


def prim_files(spark: SparkSession, d: str) -> DataFrame:
    return primitives.files(vault(spark, d), "*-*/*.md")


def prim_tags(spark: SparkSession, d: str) -> DataFrame:
    return primitives.tag_histogram(vault(spark, d), min_count=2, sort="count")


def prim_backlinks(spark: SparkSession, d: str) -> DataFrame:
    return primitives.backlinks(vault(spark, d), "atlas/home.md")


def prim_backlink_counts(spark: SparkSession, d: str) -> DataFrame:
    return primitives.backlink_counts(vault(spark, d))


def prim_outlinks(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    return primitives.outlinks(v, busiest(v))


def prim_meta(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    return primitives.meta(v, busiest(v))


def prim_meta_counts(spark: SparkSession, d: str) -> DataFrame:
    return primitives.meta_counts(vault(spark, d))


def prim_schema(spark: SparkSession, d: str) -> DataFrame:
    return primitives.schema_profile(vault(spark, d)).withColumn("types", F.array_join("types", ","))


def prim_table_counts(spark: SparkSession, d: str) -> DataFrame:
    return primitives.table_counts(vault(spark, d))


VIEW = """
filters: {and: ["file.size > 500", "tags contains 'depot'", "note.voting != 'x == y'"]}
properties: {note.status: {displayName: Status}, note.votes: {displayName: Votes}}
views:
  - {type: table, name: Open, order: [file.path, size], sort: [{property: size, direction: DESC}]}
  - {type: table, name: All, order: [path, size, votes]}
"""


def base_view_query(spark: SparkSession, d: str) -> DataFrame:
    return compiler.Compiler(vault(spark, d), NOW).plan(base_view.compile_view(VIEW, "open")).withColumnRenamed("file.path", "path")


def links_resolved(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    return links.resolved(v.files, v.links)


# --- ranking -------------------------------------------------------------------------------------------------------


def _scores(df: DataFrame) -> DataFrame:
    return df.select("path", F.round("score", 6).alias("score"))


def rank_related(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    return _scores(rank.related(v, busiest(v), NOW_S, None))


def rank_context(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    return _scores(rank.context(v, busiest(v), NOW_S, None))


def rank_search(spark: SparkSession, d: str) -> DataFrame:
    return _scores(rank.search(vault(spark, d), "budget", NOW_S, None))


def rank_signals(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    raw = rank.raw_signals(v, rank.related_candidates(v, busiest(v)), NOW_S, busiest(v))
    return raw.select("path", *(F.round(c, 6).alias(c) for c in rank.SIGNALS))


def rank_provenance(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    long = rank.related(v, busiest(v), NOW_S, 10).select("path", F.explode("signals").alias("s")).select("path", "s.*")
    return long.withColumns({c: F.round(c, 6) for c in ("raw", "normalized", "weighted")})


def rank_default(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    return _scores(rank.ranked(rank.raw_signals(v, rank.related_candidates(v, busiest(v)), NOW_S, busiest(v)), "default", None))


def dsl_regexp(spark: SparkSession, d: str) -> DataFrame:
    return compiler.query(vault(spark, d), "SELECT path WHERE path REGEXP '^[a-m].*[0-9].md$' AND name MATCH 'e'", NOW, extended=True)


def dsl_cast(spark: SparkSession, d: str) -> DataFrame:
    return compiler.query(vault(spark, d), "SELECT path, CAST(size / 7.0 AS INTEGER) AS i, CAST(size AS TEXT) || 'x' AS t, CAST(name AS INTEGER) AS n, CAST(size AS REAL) / 4 AS r", NOW, extended=True)


def rank_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    return rank.neighbours(v, rank.related(v, busiest(v), NOW_S, 10), 5)


def rank_flat(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    return rank.flat(v, busiest(v))


def rank_quality(spark: SparkSession, d: str) -> DataFrame:
    """The related ranking judged against what the note links to."""
    v = vault(spark, d)
    me = busiest(v)
    top = rank.related(v, me, NOW_S, 20).select(F.lit("related").alias("case"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "path")).alias("rank"), "path")  # 20 rows
    wanted = links.resolved(v.files, v.links.where(F.col("source_path") == me)).select(F.lit("related").alias("case"), "path")
    return rank.quality(top, wanted, 10).withColumns({c: F.round(c, 6) for c in ("ndcg", "mrr")})


# --- planning ------------------------------------------------------------------------------------------------------


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _state(spark: SparkSession, d: str, name: str, fields: str) -> DataFrame:
    """Live rows of one logged table after replay."""
    rows = changefeed.newest(changefeed.ticket_versions(table(spark, d, "tickets")).unionByName(changefeed.log_versions(table(spark, d, "changelog"))))
    return rows.where((F.col("table_name") == name) & F.col("deleted_at").isNull()).select(F.from_json("row_json", fields).alias("r"), "hash").select("r.*", "hash")


_IDMAP, _DEPS, _LABELS = "record_id string, ticket_id string", "blocker_record_id string, blocked_record_id string", "ticket_record_id string, label string"


def plan_decisions(spark: SparkSession, d: str) -> DataFrame:
    return planning.decision_list(table(spark, d, "decisions"), type="confirmed")


def plan_refs(spark: SparkSession, d: str) -> DataFrame:
    return planning.decision_neighbours(table(spark, d, "decision_refs"))


def plan_refs_of_one(spark: SparkSession, d: str) -> DataFrame:
    return planning.decision_neighbours(table(spark, d, "decision_refs"), "D-1")


def plan_tickets(spark: SparkSession, d: str) -> DataFrame:
    return planning.ticket_read(table(spark, d, "tickets"), _state(spark, d, "ticket_idmap", _IDMAP))


def plan_by_decision(spark: SparkSession, d: str) -> DataFrame:
    return planning.tickets_by_decision(*_t(spark, d, "tickets", "decisions"))


def plan_children(spark: SparkSession, d: str) -> DataFrame:
    return planning.child_counts(table(spark, d, "tickets"))


def plan_leaves(spark: SparkSession, d: str) -> DataFrame:
    return planning.leaves(table(spark, d, "tickets"))


def plan_blockers(spark: SparkSession, d: str) -> DataFrame:
    return planning.blockers(table(spark, d, "tickets"), _state(spark, d, "ticket_deps", _DEPS))


def plan_unblocked(spark: SparkSession, d: str) -> DataFrame:
    return planning.unblocked(table(spark, d, "tickets"), _state(spark, d, "ticket_deps", _DEPS), ("done", "cancelled"))


def plan_labels(spark: SparkSession, d: str) -> DataFrame:
    """label, tickets of live labels on live tickets."""
    labels = _state(spark, d, "ticket_labels", _LABELS)
    held = planning.live(table(spark, d, "tickets"), "record_id").select(F.col("record_id").alias("ticket_record_id"))
    return labels.join(held, "ticket_record_id", "left_semi").groupBy("label").agg(F.count("*").alias("tickets"))


def plan_label_filter(spark: SparkSession, d: str) -> DataFrame:
    return planning.ticket_list(table(spark, d, "tickets"), _state(spark, d, "ticket_idmap", _IDMAP), _state(spark, d, "ticket_labels", _LABELS), label="question")


def plan_ticket_list(spark: SparkSession, d: str) -> DataFrame:
    return planning.ticket_list(table(spark, d, "tickets"), _state(spark, d, "ticket_idmap", _IDMAP), leaf=True, status="backlog")


def _fullest(tickets: DataFrame) -> str:
    """The live ticket with most children, by id on a tie."""
    row = planning.child_counts(tickets).orderBy(F.desc("children"), "record_id").first()
    return row["record_id"] if row else ""


def plan_under(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tickets")
    return planning.ticket_list(t, _state(spark, d, "ticket_idmap", _IDMAP), under=_fullest(t))


def _deepest(tickets: DataFrame, tree: DataFrame | None = None) -> str:
    row = (hierarchy.hierarchy(tickets) if tree is None else tree).orderBy(F.desc("depth"), "record_id").first()
    return row["record_id"] if row else ""


def plan_ancestors(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tickets")
    tree = stored(hierarchy.hierarchy(t))
    return planning.ancestors(t, _deepest(t, tree), tree)


def plan_show_tree(spark: SparkSession, d: str) -> DataFrame:
    t, dc = _t(spark, d, "tickets", "decisions")
    return planning.show_tree(t, dc, _state(spark, d, "ticket_deps", _DEPS), _fullest(t))


BOARD = [("backlog", "Backlog"), ("ready", "Ready"), ("in_progress", "In Progress"), ("review", "Review"), ("done", "Done")]


def plan_board(spark: SparkSession, d: str) -> DataFrame:
    return planning.board(table(spark, d, "tickets"), _state(spark, d, "ticket_idmap", _IDMAP), BOARD)


def log_upgrade(spark: SparkSession, d: str) -> DataFrame:
    return planning_log.upgraded(table(spark, d, "changelog"), 3).select("log_file", "line_no", "table_name", "hash", "canonical_version")


def log_append(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of one half year exported, then all: the second time only what is new gets into the files."""
    rows, root = table(spark, d, "decisions"), scratch(spark, "log-append").removeprefix("file:")
    planning_log.append_log(planning_log.export(rows, "decisions", "2024-07-01"), root, "decisions", ["id"]).collect()  # one row per month
    return cut(planning_log.append_log(planning_log.export(rows, "decisions", "2024-01-01"), root, "decisions", ["id"]))


def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Live decisions out as JSON and back into every version's oldest."""
    every, path = table(spark, d, "decisions").distinct(), scratch(spark, "snapshot")
    now = planning.live(every, "id").drop("_key")
    snapshot.export_snapshot({"decisions": now}, path)
    oldest = every.groupBy("id").agg(F.max_by(F.struct(*every.columns), F.struct(F.col("updated_at"), F.col("hash"))).alias("r")).select("r.*").where("deleted_at IS NOT NULL")
    return snapshot.import_snapshot(spark, path, {"decisions": oldest})["decisions"].select("id", "title", "status", "date", "hash", "deleted_at")


def plan_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return planning.dashboard(*_t(spark, d, "decisions", "tickets"))


def plan_next_ids(spark: SparkSession, d: str) -> DataFrame:
    return planning.next_ids(table(spark, d, "decisions"))


def log_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Two vaults' labels brought together: the log's own, and the same records numbered one higher."""
    own = _state(spark, d, "ticket_idmap", _IDMAP).select("record_id", "ticket_id")
    other = own.select("record_id", F.concat(F.lit("T-"), (F.substring("ticket_id", 3, 9).cast("int") + 1).cast("string")).alias("ticket_id"))
    return planning.label_collisions(own.unionByName(other))


def log_verify(spark: SparkSession, d: str) -> DataFrame:
    """Tickets before the log against tickets after it."""
    before = planning.live(table(spark, d, "tickets"), "record_id").select("record_id", "hash")
    return planning.state_difference(before, _state(spark, d, "tickets", "record_id string"), ["record_id"])


def log_replay(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "changelog").distinct()
    created = F.get_json_object("row_json", "$.created_at")
    keyed = changefeed.log_versions(lines.withColumn("_c", created)).select("table_name", "row_key", F.col("seq.updated_at").alias("updated_at"), F.col("seq.log_file").alias("log_file"), F.col("seq.line_no").alias("line_no"), "deleted_at", "hash", F.get_json_object("row_json", "$.created_at").alias("created_at"))
    return planning_log.replay(keyed, ["table_name", "row_key"], ["log_file", "line_no"]).select("table_name", "row_key", "updated_at", "deleted_at", "hash", "created_at")


def log_history(spark: SparkSession, d: str) -> DataFrame:
    return planning_log.first_of_each_hash(table(spark, d, "ticket_history").distinct(), ["updated_at", "created_at"]).select("hash", "ticket_record_id", "field", "changed_at", "updated_at")


def log_export(spark: SparkSession, d: str) -> DataFrame:
    return planning_log.export(table(spark, d, "decisions"), "decisions", "2024-01-01").select("log_file", "line_no", "updated_at", "hash")


def log_markers(spark: SparkSession, d: str) -> DataFrame:
    return planning_log.marker_refused(table(spark, d, "ticket_history").distinct(), 2).select("hash", "canonical_version")


def row_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decisions").distinct().select("id", "updated_at", planning.row_hash("id", "type", "domain", "title", "status", "date", "deleted_at").alias("row_hash"), planning.titleize(F.col("status")).alias("shown"))


# --- extraction, refresh, sinks, streaming -------------------------------------------------------------------------


def document_notes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))


def extract_counts(spark: SparkSession, d: str) -> DataFrame:
    """path and how many keys, tags, links and headings each document has; readable tells whether its frontmatter was."""
    notes = markdown.extracted(document_notes(spark, d))
    return notes.select("path", *(F.size(c).alias(f"n_{c}") for c in ("frontmatter", "tags", "links", "headings")), F.col("error").isNull().alias("readable"))


def extract_headings(spark: SparkSession, d: str) -> DataFrame:
    return markdown.extracted(document_notes(spark, d)).select("path", F.explode("headings").alias("h")).select("path", "h.*")


def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return markdown.extracted(document_notes(spark, d)).select(F.col("path").alias("source_path"), F.explode("links").alias("l")).select("source_path", "l.*")


def extract_tags(spark: SparkSession, d: str) -> DataFrame:
    return markdown.extracted(document_notes(spark, d)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("notes"))


def extract_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    return markdown.extracted(document_notes(spark, d)).select("path", F.explode("frontmatter").alias("m")).select("path", "m.*")


def extract_decisions(spark: SparkSession, d: str) -> DataFrame:
    return decisions.decision_records(document_notes(spark, d)).select("path", "id", "type", "domain", "title", "status", "date")


def extract_decision_refs(spark: SparkSession, d: str) -> DataFrame:
    return decisions.decision_references(document_notes(spark, d))


def decision_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a note of one of the three folders, named after its source."""
    docs = table(spark, d, "documents")
    folder = F.element_at(F.array(*map(F.lit, decisions.FOLDERS)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    name = F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit(".md"))
    return decisions.violations(docs.select(F.concat(folder, F.lit("/"), name).alias("path"), F.col("text").alias("content")))


def decision_sync(spark: SparkSession, d: str) -> DataFrame:
    """The oldest stored version of every decision against the newest live one."""
    every = table(spark, d, "decisions").distinct()
    oldest = every.groupBy("id").agg(F.min_by("hash", F.struct("updated_at", "hash")).alias("hash"))
    return decisions.sync(oldest, planning.live(every, "id").select("id", "hash"))


def extract_anchors(spark: SparkSession, d: str) -> DataFrame:
    return markdown.heading_anchors(document_notes(spark, d))


def _two_scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The notes that frontmatter knows, as of their creation, against the files as they are."""
    files = table(spark, d, "files").distinct()
    known = table(spark, d, "frontmatter").select("path").distinct()
    stored = known.join(files, "path", "left").select("path", F.col("ctime").alias("mtime"), "ctime", "size", "content_hash", "last_scanned")
    return stored, files.select("path", "mtime", "size", "content_hash")


def index_diff(spark: SparkSession, d: str) -> DataFrame:
    return index.classify(*_two_scans(spark, d)).select("path", "action")


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.run_stats(index.classify(*_two_scans(spark, d)))


def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    return index.refreshed(*_two_scans(spark, d), NOW_S)


def index_prune(spark: SparkSession, d: str) -> DataFrame:
    fm = table(spark, d, "frontmatter").distinct()
    return index.pruned(fm, index.classify(*_two_scans(spark, d))).select("path", "key", "type", "value_json")


def files_by_month(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").distinct().groupBy(epoch_month(F.col("ctime")).alias("month")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def sink_one_line(spark: SparkSession, d: str) -> DataFrame:
    v = vault(spark, d)
    return sinks.one_line(sinks.chosen(v.files.withColumn("kb", F.col("size") / 1024.0), ["path", "kb", "size", "path"]))


def sink_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_lines(table(spark, d, "decisions").distinct().select("id", "title", "date", "deleted_at", "canonical_version"))


def log_statements(spark: SparkSession, d: str) -> DataFrame:
    """Every decision row as the statement a log file would hold."""
    rows = table(spark, d, "decisions").distinct().select("id", "title", "date", "updated_at", "canonical_version")
    return statements.rendered(rows, "decisions", ["id"])


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", index.content_hash("text").alias("content_hash"))


def stream_history(spark: SparkSession, d: str) -> DataFrame:
    """The hashes that a bounded stream of the history keeps."""
    rows = table(spark, d, "ticket_history")
    kept, out = refresh.distinct_history(spark.readStream.schema(rows.schema).parquet(f"{d}/ticket_history.parque[t]")).select("hash", "ticket_record_id", "field"), scratch(spark, "history")
    kept.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}/state").start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def sink_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with the counting row put in for every id."""
    every = table(spark, d, "decisions").distinct()
    one = planning.current(every, "id").drop("_key")
    oldest = every.groupBy("id").agg(F.min_by("hash", "updated_at").alias("hash"))
    return sinks.upsert(oldest, one.select("id", "hash"), ["id"])


def stream_log(spark: SparkSession, d: str) -> DataFrame:
    """The planning state as a stream of log files builds it; equals the batch result."""
    store = changefeed.MergeStore(spark, scratch(spark, "stream-store"))
    store.append(changefeed.ticket_versions(table(spark, d, "tickets")))
    q = refresh.follow_log(spark, f"{d}/changelog.parque[t]", store)
    q.awaitTermination()
    return store.current().select("table_name", "row_key", "hash")


_PLAIN = (
    prim_files, prim_tags, prim_backlinks, prim_backlink_counts, prim_outlinks, prim_meta, prim_meta_counts, prim_schema, prim_table_counts, base_view_query, links_resolved,
    rank_related, rank_context, rank_search, rank_signals, rank_default, dsl_regexp, dsl_cast, rank_provenance, rank_neighbours, rank_flat, rank_quality,
    plan_decisions, plan_refs, plan_refs_of_one, plan_tickets, plan_by_decision, plan_children, plan_leaves, plan_blockers, plan_unblocked, plan_labels, plan_label_filter, plan_ticket_list, plan_under, plan_ancestors, plan_show_tree, plan_board, plan_dashboard, plan_next_ids,
    log_collisions, log_verify, log_replay, log_history, log_export, log_markers, log_upgrade, log_append, snapshot_round_trip, row_hashes,
    extract_counts, extract_headings, extract_links, extract_tags, extract_frontmatter, extract_anchors, extract_decisions, extract_decision_refs, decision_violations, decision_sync,
    index_diff, index_stats, index_refresh, index_prune, files_by_month, sink_one_line, sink_json, log_statements, content_hashes, sink_upsert, stream_log, stream_history,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{f"dsl_{n}": _dsl(t) for n, t, _ in DSL}, **{f.__name__: f for f in _PLAIN}}


# --- SQL of the named queries --------------------------------------------------------------------------------------

_LT = "t AS (SELECT *, upper(trim(record_id)) AS k, upper(trim(parent_record_id)) AS up FROM (SELECT DISTINCT * FROM tickets) QUALIFY row_number() OVER (PARTITION BY upper(trim(record_id)) ORDER BY updated_at DESC) = 1)"
_LD = "dc AS (SELECT *, upper(trim(id)) AS k FROM (SELECT DISTINCT * FROM decisions) QUALIFY row_number() OVER (PARTITION BY upper(trim(id)) ORDER BY updated_at DESC) = 1)"
_ST = STATE.strip().removeprefix("WITH ")
_J = "json_extract_string(row_json, '$.{}')"
_IDS = f"ids AS (SELECT upper({_J.format('record_id')}) AS k, {_J.format('ticket_id')} AS ticket_id, {_J.format('record_id')} AS record_id FROM state WHERE table_name = 'ticket_idmap' AND deleted_at IS NULL)"
_DP = f"deps AS (SELECT DISTINCT upper({_J.format('blocker_record_id')}) AS a, upper({_J.format('blocked_record_id')}) AS b FROM state WHERE table_name = 'ticket_deps' AND deleted_at IS NULL)"
_LIVE = "lv AS (SELECT * FROM t WHERE deleted_at IS NULL)"
_RESOLVED = f"SELECT DISTINCT f.path, l.target_path FROM f JOIN (SELECT DISTINCT target_path FROM links) l ON {_NAMES.format(p='f.path')}"
_SIGNALS = f"""lo AS (SELECT b.source_path AS path, count(*)::DOUBLE AS v FROM links a JOIN links b USING (target_path), busy WHERE a.source_path = busy.b AND b.source_path <> busy.b GROUP BY 1),
tg AS (SELECT y.path, count(*)::DOUBLE AS v FROM tags x JOIN tags y USING (tag), busy WHERE x.path = busy.b AND y.path <> busy.b GROUP BY 1),
ce AS (SELECT c.path, count(DISTINCT source_path)::DOUBLE AS v FROM cand c JOIN links l ON l.target_path IN (c.path, regexp_replace(c.path, '\\.md$', '')) GROUP BY 1),
dirs AS (SELECT c.path, string_split(CASE WHEN c.path LIKE '%/%' THEN regexp_replace(c.path, '/[^/]*$', '') ELSE '.' END, '/') AS x, string_split(CASE WHEN busy.b LIKE '%/%' THEN regexp_replace(busy.b, '/[^/]*$', '') ELSE '.' END, '/') AS y FROM cand c, busy),
pp AS (SELECT path, CASE WHEN x = y THEN 1.0 ELSE len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i]))::DOUBLE / greatest(len(x), len(y)) END AS v FROM dirs),
sg AS (SELECT c.path, coalesce(lo.v, 0) AS link_overlap, coalesce(tg.v, 0) AS tag_overlap, pp.v AS path_proximity,
 coalesce(greatest(0, least(1, 1 - ({NOW_S} - f.mtime) / 3600.0::DOUBLE / 2160)), 0)::DOUBLE AS recency, coalesce(ce.v, 0) AS centrality
 FROM cand c LEFT JOIN f USING (path) LEFT JOIN lo USING (path) LEFT JOIN tg USING (path) LEFT JOIN pp USING (path) LEFT JOIN ce USING (path))"""
_NONE_SIGNALS = f"""ce AS (SELECT c.path, count(DISTINCT source_path)::DOUBLE AS v FROM cand c JOIN links l ON l.target_path IN (c.path, regexp_replace(c.path, '\\.md$', '')) GROUP BY 1),
sg AS (SELECT c.path, 0::DOUBLE AS link_overlap, 0::DOUBLE AS tag_overlap, 0::DOUBLE AS path_proximity, coalesce(greatest(0, least(1, 1 - ({NOW_S} - f.mtime) / 3600.0::DOUBLE / 2160)), 0)::DOUBLE AS recency, coalesce(ce.v, 0) AS centrality FROM cand c LEFT JOIN f USING (path) LEFT JOIN ce USING (path))"""


def _score_sql(profile: str) -> str:
    parts = [f"{w}::DOUBLE * coalesce({n} / nullif(max({n}) OVER (), 0), 0)" for n, w in zip(rank.SIGNALS, rank.WEIGHTS[profile], strict=True)]
    return f"SELECT path, round({' + '.join(parts)}, 6) AS score FROM sg"


_LINKING = f"SELECT l.source_path AS path FROM links l, busy WHERE {_NAMES.format(p='busy.b')} AND EXISTS (SELECT 1 FROM f WHERE f.path = busy.b)"
_MATES = "SELECT y.path FROM tags x JOIN tags y USING (tag), busy WHERE x.path = busy.b"
_CAND_RELATED = f"cand AS (SELECT DISTINCT path FROM ({_LINKING} UNION ALL {_MATES} UNION ALL SELECT path FROM f, busy WHERE {_LOW.format('path')} LIKE {_LOW.format('regexp_replace(busy.b, %s, %s)' % (chr(39) + '[^/]*$' + chr(39), chr(39) * 2))} || '%'), busy WHERE path <> busy.b)"
_SENT = f"sent AS (SELECT DISTINCT regexp_replace(target_path, '#.*$', '', 's') AS target_path FROM links, busy WHERE source_path = busy.b AND {_LOW.format('target_path')} NOT LIKE 'http%')"
_CAND_CONTEXT = f"cand AS (SELECT DISTINCT path FROM ({_LINKING} UNION ALL {_MATES} UNION ALL SELECT f.path FROM f JOIN sent l ON l.target_path <> '' AND {_NAMES.format(p='f.path')}), busy WHERE path <> busy.b)"
_CAND_SEARCH = f"cand AS (SELECT path FROM f WHERE {_LOW.format('path')} LIKE '%budget%' UNION SELECT path FROM tags WHERE {_LOW.format('tag')} LIKE '%budget%' UNION SELECT path FROM fm WHERE {_LOW.format('value_text')} LIKE '%budget%' UNION SELECT path FROM heads WHERE {_LOW.format('text')} LIKE '%budget%')"
_SCANS = "files2 AS (SELECT DISTINCT path, mtime, ctime, size, content_hash, last_scanned FROM files), st AS (SELECT k.path, f.ctime AS mtime, f.content_hash, f.size, f.ctime, f.last_scanned FROM (SELECT DISTINCT path FROM frontmatter) k LEFT JOIN files2 f USING (path)), acts AS (SELECT coalesce(s.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'removed' WHEN s.path IS NULL THEN 'new' WHEN s.mtime = f.mtime THEN 'unchanged' WHEN s.content_hash = f.content_hash THEN 'touched' ELSE 'changed' END AS action, f.mtime FROM st s FULL JOIN files2 f ON s.path = f.path)"

# a note's body: lines after the frontmatter, numbered from 1, with whether a fence is open; fences are walked mark by mark
_DOC_LINES = """docs AS (SELECT source || '/doc-' || doc_id || '.md' AS path, text AS content FROM documents WHERE text IS NOT NULL AND text <> ''),
raw AS (SELECT path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM docs),
fr AS (SELECT path, min(i) AS c FROM raw WHERE i > 1 AND regexp_matches(t, '^---[ \\t\\r]*$') AND path IN (SELECT path FROM raw WHERE i = 1 AND t IN ('---', '---' || chr(13))) GROUP BY path),
ls AS (SELECT raw.path, i - coalesce(c, 0) AS n, regexp_replace(t, '\\r$', '') AS l FROM raw LEFT JOIN fr USING (path) WHERE i > coalesce(c, 0)),
mk AS (SELECT path, n, regexp_extract(l, '^[ \\t]*(`{3,}|~{3,})', 1) AS m, row_number() OVER (PARTITION BY path ORDER BY n) AS j FROM ls WHERE regexp_matches(l, '^[ \\t]*(```|~~~)')),
fs AS (SELECT path, 0::BIGINT AS j, 0::BIGINT AS n, '' AS fence FROM (SELECT DISTINCT path FROM mk)
 UNION ALL SELECT fs.path, mk.j, mk.n, CASE WHEN fs.fence = '' THEN m WHEN starts_with(m, fs.fence) THEN '' ELSE fs.fence END FROM fs JOIN mk ON mk.path = fs.path AND mk.j = fs.j + 1),
po AS (SELECT ls.path, ls.n, l, coalesce(f.fence, '') AS fence, ls.n IN (SELECT n FROM mk WHERE mk.path = ls.path) AS marked,
 coalesce(sum(octet_length(encode(l)) + 1) OVER (PARTITION BY ls.path ORDER BY ls.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS line_offset FROM ls ASOF LEFT JOIN fs f ON f.path = ls.path AND f.n <= ls.n),
op AS (SELECT * FROM po WHERE fence = '' AND NOT marked)"""
# decision records: lines with the number of the heading above, bodies up to the first line of dashes
_DECISION_LINES = """dl AS (SELECT path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM docs),
dh AS (SELECT *, regexp_matches(l, '^###\\s+[DQR]-[0-9]+:\\s+.') AS h, regexp_full_match(l, '\\s*---\\s*') AS e FROM dl),
dg AS (SELECT *, sum(h::INT) OVER (PARTITION BY path ORDER BY i) AS rec FROM dh),
dk AS (SELECT *, sum(e::INT) OVER (PARTITION BY path, rec ORDER BY i) AS closed FROM dg WHERE rec > 0),
dr AS (SELECT path, rec, regexp_extract(l, '^###\\s+([DQR]-[0-9]+):', 1) AS id, regexp_replace(regexp_extract(l, '^###\\s+[DQR]-[0-9]+:\\s+(.+)$', 1), '^\\s+|\\s+$', '', 'g') AS title FROM dk WHERE h),
db AS (SELECT path, rec, i, l FROM dk WHERE NOT h AND closed = 0),
dm AS (SELECT path, rec, i, l, regexp_replace(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '^[- ]+', '') AS note, unnest(regexp_extract_all(' ' || l || ' ', '[^A-Za-z0-9_]([DQR]-[0-9]+)\\b', 1)) AS target FROM db),
df AS (SELECT path, rec, dr.id, target, CASE WHEN regexp_matches(l, '(?i)^\\s*-\\s+\\*\\*supersedes:\\*\\*') THEN 'supersedes' WHEN regexp_matches(l, '(?i)^\\s*-\\s+\\*\\*superseded\\s+by:\\*\\*') THEN 'references' WHEN regexp_matches(l, '(?i)^\\s*-\\s+\\*\\*resolves:\\*\\*') THEN 'resolves'
 WHEN regexp_matches(l, '(?i)^\\s*-\\s+\\*\\*depends\\s+on:\\*\\*') THEN 'depends_on' WHEN regexp_matches(l, '(?i)^\\s*\\*\\*amendment\\s*\\(') THEN 'amends' ELSE 'references' END AS ref_type, note, i FROM dm JOIN dr USING (path, rec) WHERE target <> dr.id)"""
_DOCS = "docs AS (SELECT source || '/doc-' || doc_id || '.md' AS path, text AS content FROM documents WHERE text IS NOT NULL)"
_FOLDER_DOCS = "nn AS (SELECT ['decisions', 'questions', 'rejected'][doc_id % 3 + 1] || '/' || source || '-' || doc_id // 3 || '.md' AS path, text AS content FROM documents), docs AS (SELECT * FROM nn WHERE content IS NOT NULL)"
_KIND = "CASE left(id, 1) WHEN 'D' THEN 'confirmed' WHEN 'Q' THEN 'question' ELSE 'rejected' END"
_READ = f"{_LT}, {_LIVE}, {_ST}, {_IDS}, lb AS (SELECT {_J.format('ticket_record_id')} AS record_id, {_J.format('label')} AS label FROM state WHERE table_name = 'ticket_labels' AND deleted_at IS NULL), tr AS (SELECT lv.k, lv.up, lv.record_id, i.ticket_id, p.ticket_id AS parent_id, type, title, status, priority FROM lv JOIN ids i USING (k) LEFT JOIN ids p ON p.k = lv.up)"
_SHOWN = "record_id, ticket_id, parent_id, type, title, status, priority"
_FULLEST = "full_one AS (SELECT lv.k FROM lv ORDER BY (SELECT count(*) FROM lv c WHERE c.up = lv.k) DESC, record_id LIMIT 1)"
_TREES = f"{_LT}, {_LIVE}, tp AS (SELECT k, record_id, 0 AS depth, [k] AS path FROM lv WHERE up IS NULL OR up NOT IN (SELECT k FROM lv) UNION ALL SELECT lv.k, lv.record_id, tp.depth + 1, list_append(tp.path, lv.k) FROM lv JOIN tp ON lv.up = tp.k)"
_BOARD = "(VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(BOARD)) + ") AS b(position, status, label)"
_TOP = "top AS (SELECT path, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM ({q})))"


def _item(section: str, fields: str, source: str) -> str:
    """Rows of one section as JSON without nulls."""
    parts = ", ".join(f"""'"{c}":' || to_json({c})""" for c in fields.split())
    return f"SELECT '{section}' AS section, '{{' || concat_ws(',', {parts}) || '}}' AS item FROM {source}"


_Q = "''"  # a quote within a quoted text

SQL: dict[str, str] = {
    "prim_files": f"WITH {_F} SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '') AS name, size, mtime FROM f WHERE regexp_full_match(path, '.*-.*/.*\\.md', 's')",
    "prim_tags": f"WITH {_TAGS} SELECT tag, count(*) AS count FROM tags GROUP BY tag HAVING count(*) >= 2",
    "prim_backlinks": f"SELECT source_path, line, link_type FROM links WHERE source_path <> 'atlas/home.md' AND (target_path IN ('atlas/home.md', 'atlas/home', 'home') OR {_LOW.format('target_path')} LIKE 'atlas/home.md#%' OR {_LOW.format('target_path')} LIKE 'atlas/home#%' OR {_LOW.format('target_path')} LIKE 'home#%')",
    "prim_backlink_counts": f"WITH {_F} SELECT f.path, count(*) AS backlinks FROM f JOIN links l ON regexp_replace(target_path, '#.*$', '', 's') IN (f.path, regexp_replace(f.path, '\\.md$', ''), regexp_replace(regexp_extract(f.path, '[^/]*$'), '\\.md$', '')) WHERE l.source_path <> f.path GROUP BY 1",
    "prim_outlinks": f"WITH {_BUSY} SELECT target_path, alias, line, link_type FROM links, busy WHERE source_path = busy.b",
    "prim_meta": f"WITH {_F}, {_FM}, {_TAGS}, {_HEADS}, {_BUSY}, x AS ({_item('file', 'name path mtime ctime size content_hash last_scanned', f'(SELECT f.*, {_NAME.replace('(?i)', '')} AS name FROM f, busy WHERE path = b)')} UNION ALL {_item('frontmatter', 'key type value_json', 'fm, busy WHERE path = b')} UNION ALL {_item('tags', 'tag', 'tags, busy WHERE path = b')} UNION ALL {_item('outlinks', 'line target_path alias link_type', 'links, busy WHERE source_path = b')} UNION ALL {_item('inlinks', 'source_path', f'(SELECT DISTINCT source_path FROM links l, busy WHERE {_NAMES.format(p="busy.b")})')} UNION ALL {_item('headings', 'line_offset depth text', 'heads, busy WHERE path = b')}) SELECT * FROM x WHERE EXISTS (SELECT 1 FROM f, busy WHERE path = b)",
    "prim_meta_counts": f"WITH {_F}, {_FM}, {_TAGS}, {_HEADS}, r AS ({_RESOLVED}), i AS (SELECT r.path, count(*) AS n FROM r JOIN links l USING (target_path) GROUP BY 1) SELECT f.path, regexp_replace(regexp_extract(f.path, '[^/]*$'), '\\.md$', '') AS name, (SELECT count(*) FROM fm WHERE fm.path = f.path) AS n_keys, (SELECT count(*) FROM tags WHERE tags.path = f.path) AS n_tags, (SELECT count(*) FROM links WHERE source_path = f.path) AS n_outlinks, coalesce(i.n, 0) AS n_inlinks, (SELECT count(*) FROM heads WHERE heads.path = f.path) AS n_headings FROM f LEFT JOIN i USING (path)",
    "prim_schema": f"WITH {_FM} SELECT key, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(*) AS count FROM fm GROUP BY key",
    "prim_table_counts": f"WITH {_F}, {_FM}, {_TAGS}, {_HEADS} SELECT 'files' AS relation, count(*) AS rows FROM f UNION ALL SELECT 'frontmatter', count(*) FROM fm UNION ALL SELECT 'tags', count(*) FROM tags UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'headings', count(*) FROM heads",
    "base_view_query": f"WITH {_F}, {_FM}, {_TAGS} SELECT path, size FROM f {_fm('voting')} WHERE size > 500 AND ((m.type IN ('number', 'bool') AND m.value_num IS NOT NULL) OR ({_TEXT_OF}) <> 'x == y') AND path IN (SELECT path FROM tags WHERE tag = 'depot')",
    "links_resolved": f"WITH {_F} {_RESOLVED}",
    "rank_related": f"WITH {_F}, {_TAGS}, {_BUSY}, {_CAND_RELATED}, {_SIGNALS} {_score_sql('related')}",
    "rank_context": f"WITH {_F}, {_TAGS}, {_BUSY}, {_SENT}, {_CAND_CONTEXT}, {_SIGNALS} {_score_sql('context')}",
    "rank_search": f"WITH {_F}, {_FM}, {_TAGS}, {_HEADS}, {_CAND_SEARCH}, {_NONE_SIGNALS} {_score_sql('search')}",
    "rank_signals": f"WITH {_F}, {_TAGS}, {_BUSY}, {_CAND_RELATED}, {_SIGNALS} SELECT path, {', '.join(f'round({n}, 6) AS {n}' for n in rank.SIGNALS)} FROM sg",
    "rank_flat": f"WITH {_F}, {_BUSY} SELECT path FROM f, busy WHERE path <> busy.b",
    "plan_decisions": f"WITH {_LD} SELECT id, type, domain, title, status, date FROM dc WHERE deleted_at IS NULL AND type = 'confirmed'",
    "plan_refs": "SELECT DISTINCT ref_type, source_id, target_id, note FROM decision_refs WHERE deleted_at IS NULL",
    "plan_refs_of_one": "SELECT DISTINCT ref_type, source_id, target_id, note FROM decision_refs WHERE deleted_at IS NULL AND 'D-1' IN (upper(trim(source_id)), upper(trim(target_id)))",
    "plan_tickets": f"WITH {_LT}, {_LIVE}, {_ST}, {_IDS} SELECT lv.record_id, i.ticket_id, p.ticket_id AS parent_id, type, title, status, priority FROM lv JOIN ids i USING (k) LEFT JOIN ids p ON p.k = lv.up",
    "plan_by_decision": f"WITH {_LT}, {_LIVE}, {_LD} SELECT dc.id AS decision, dc.title, lv.record_id, lv.title AS ticket FROM dc JOIN lv ON upper(trim(lv.decision_ref)) = dc.k WHERE dc.deleted_at IS NULL",
    "plan_children": f"WITH {_LT}, {_LIVE} SELECT record_id, (SELECT count(*) FROM lv c WHERE c.up = lv.k) AS children FROM lv",
    "plan_leaves": f"WITH {_LT}, {_LIVE} SELECT record_id FROM lv WHERE NOT EXISTS (SELECT 1 FROM lv c WHERE c.up = lv.k)",
    "plan_blockers": f"WITH {_LT}, {_LIVE}, {_ST}, {_DP} SELECT y.record_id AS blocked, x.record_id AS blocker, x.title AS blocker_title FROM deps JOIN lv x ON x.k = a JOIN lv y ON y.k = deps.b",
    "plan_unblocked": f"WITH {_LT}, {_LIVE}, {_ST}, {_DP} SELECT record_id FROM lv WHERE NOT EXISTS (SELECT 1 FROM deps JOIN lv x ON x.k = deps.a WHERE deps.b = lv.k AND x.status NOT IN ('done', 'cancelled'))",
    "plan_labels": f"WITH {_LT}, {_LIVE}, {_ST} SELECT {_J.format('label')} AS label, count(*) AS tickets FROM state WHERE table_name = 'ticket_labels' AND deleted_at IS NULL AND {_J.format('ticket_record_id')} IN (SELECT record_id FROM lv) GROUP BY 1",
    "plan_dashboard": f"WITH {_LT}, {_LD} SELECT 'decisions' AS relation, type, status, count(*) AS count FROM dc GROUP BY ALL UNION ALL SELECT 'tickets', '', status, count(*) FROM t GROUP BY ALL",
    "plan_next_ids": "SELECT left(upper(trim(id)), 1) AS prefix, max(TRY_CAST(substr(upper(trim(id)), 3) AS BIGINT)) + 1 AS next_number FROM decisions GROUP BY 1",
    "log_collisions": f"WITH {_ST}, {_IDS}, bo AS (SELECT ticket_id, record_id FROM ids UNION SELECT 'T-' || (substr(ticket_id, 3)::INT + 1), record_id FROM ids), n AS (SELECT ticket_id, count(DISTINCT record_id) AS records FROM bo GROUP BY 1) SELECT ticket_id, records, record_id FROM bo JOIN n USING (ticket_id) WHERE records > 1",
    "log_verify": f"WITH {_LT}, {_LIVE}, {_ST} SELECT lv.record_id, CASE WHEN s.row_key IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM lv LEFT JOIN (SELECT * FROM state WHERE table_name = 'tickets' AND deleted_at IS NULL) s ON s.row_key = lv.record_id WHERE s.row_key IS NULL OR s.hash <> lv.hash",
    "log_replay": STATE + ", w AS (SELECT * FROM v WHERE log_file <> ''), a AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY table_name, row_key ORDER BY updated_at DESC, log_file DESC, line_no DESC) = 1), b AS (SELECT table_name, row_key, json_extract_string(row_json, '$.created_at') AS created_at FROM w QUALIFY row_number() OVER (PARTITION BY table_name, row_key ORDER BY log_file, line_no) = 1) SELECT table_name, row_key, updated_at, deleted_at, hash, created_at FROM a JOIN b USING (table_name, row_key)",
    "row_hashes": "SELECT id, updated_at, md5(concat_ws(chr(31), " + ", ".join(f"coalesce({c}, chr(0) || 'NULL' || chr(0))" for c in ("id", "type", "domain", "title", "status", "date", "deleted_at")) + ")) AS row_hash, array_to_string(list_transform(string_split(replace(status, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS shown FROM (SELECT DISTINCT * FROM decisions)",
    "log_history": "SELECT hash, ticket_record_id, field, changed_at, updated_at FROM (SELECT DISTINCT * FROM ticket_history) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY updated_at, created_at) = 1",
    "log_export": "SELECT 'decisions/' || left(updated_at, 7) || '.sql' AS log_file, row_number() OVER (PARTITION BY left(updated_at, 7) ORDER BY updated_at, hash)::INTEGER AS line_no, updated_at, hash FROM (SELECT DISTINCT * FROM decisions) WHERE updated_at >= '2024-01-01'",
    "log_markers": "SELECT hash, canonical_version FROM (SELECT DISTINCT * FROM ticket_history) WHERE canonical_version IS DISTINCT FROM 2",
    "index_diff": f"WITH {_SCANS} SELECT path, action FROM acts",
    "index_stats": f"WITH {_SCANS} SELECT action, count(*) AS files FROM acts GROUP BY 1",
    "index_refresh": f"WITH {_SCANS} SELECT a.path, f.mtime, CASE WHEN action IN ('new', 'changed') THEN f.mtime ELSE f.ctime END AS ctime, f.size, f.content_hash, CASE WHEN action = 'unchanged' THEN f.last_scanned ELSE {NOW_S} END AS last_scanned FROM acts a JOIN files2 f USING (path) WHERE action <> 'removed'",
    "index_prune": f"WITH {_SCANS}, {_FM} SELECT path, key, type, value_json FROM fm WHERE path NOT IN (SELECT path FROM acts WHERE action IN ('removed', 'changed'))",
    "files_by_month": f"WITH {_F} SELECT strftime(make_timestamp(ctime * 1000000), '%Y-%m') AS month, count(*) AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY 1",
    "sink_one_line": f"WITH {_F} SELECT path || chr(9) || printf('%.4f', size / 1024.0::DOUBLE) || chr(9) || size AS value FROM f",
    "sink_upsert": f"WITH {_LD} SELECT id, hash FROM dc",
    "rank_provenance": f"WITH {_F}, {_TAGS}, {_BUSY}, {_CAND_RELATED}, {_SIGNALS}, pk AS (SELECT {', '.join(f'max({n}) AS {n}' for n in rank.SIGNALS)} FROM sg), {_TOP.format(q=_score_sql('related'))} " + " UNION ALL ".join(f"SELECT path, '{n}' AS name, round(sg.{n}, 6) AS raw, round(coalesce(sg.{n} / nullif(pk.{n}, 0), 0), 6) AS normalized, {w}::DOUBLE AS weight, round({w}::DOUBLE * coalesce(sg.{n} / nullif(pk.{n}, 0), 0), 6) AS weighted FROM sg JOIN top USING (path), pk WHERE rank <= 10" for n, w in zip(rank.SIGNALS, rank.WEIGHTS["related"], strict=True)),
    "rank_neighbours": f"WITH {_F}, {_TAGS}, {_BUSY}, {_CAND_RELATED}, {_SIGNALS}, {_TOP.format(q=_score_sql('related'))}, tt AS (SELECT path FROM top WHERE rank <= 10), e AS (SELECT DISTINCT path, 'outlink' AS relation, target_path AS neighbour, 0 AS shared FROM tt JOIN links ON source_path = path WHERE {_LOW.format('target_path')} NOT LIKE 'http%' UNION ALL SELECT DISTINCT path, 'inlink', source_path, 0 FROM tt JOIN links l ON {_NAMES.format(p='tt.path')} AND source_path <> tt.path UNION ALL SELECT x.path, 'sibling', y.path, count(*) FROM tt JOIN tags x USING (path) JOIN tags y ON y.tag = x.tag AND y.path <> x.path GROUP BY ALL) SELECT path, relation, neighbour FROM e QUALIFY row_number() OVER (PARTITION BY path, relation ORDER BY shared DESC, neighbour) <= 5",
    "rank_quality": f"WITH {_F}, {_TAGS}, {_BUSY}, {_CAND_RELATED}, {_SIGNALS}, {_TOP.format(q=_score_sql('related'))}, wa AS (SELECT DISTINCT f.path FROM f JOIN (SELECT DISTINCT target_path FROM links, busy WHERE source_path = b) l ON {_NAMES.format(p='f.path')}), hit AS (SELECT rank FROM top JOIN wa USING (path) WHERE rank <= 10) SELECT 'related' AS case, round(coalesce((SELECT sum(1 / log2(rank + 1)) FROM hit), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(10, (SELECT count(*) FROM wa)) + 1) r(i)), 6) AS ndcg, round(coalesce(1.0::DOUBLE / (SELECT min(rank) FROM hit), 0), 6) AS mrr, (SELECT count(*) FROM hit) / 10.0::DOUBLE AS precision",
    "plan_label_filter": f"WITH {_READ} SELECT {_SHOWN} FROM tr WHERE record_id IN (SELECT record_id FROM lb WHERE label = 'question')",
    "plan_ticket_list": f"WITH {_READ} SELECT {_SHOWN} FROM tr WHERE status = 'backlog' AND NOT EXISTS (SELECT 1 FROM lv c WHERE c.up = tr.k)",
    "plan_under": f"WITH RECURSIVE {_READ}, {_FULLEST}, un AS (SELECT lv.k FROM lv JOIN full_one o ON lv.up = o.k UNION SELECT lv.k FROM lv JOIN un ON lv.up = un.k) SELECT {_SHOWN} FROM tr WHERE k IN (SELECT k FROM un)",
    "plan_ancestors": f"WITH RECURSIVE {_TREES}, me AS (SELECT * FROM tp ORDER BY depth DESC, record_id LIMIT 1), a AS (SELECT unnest(path) AS k, generate_subscripts(path, 1) AS i, depth FROM me) SELECT (depth - i + 1)::INTEGER AS distance, record_id, type, title FROM a JOIN lv USING (k) WHERE i <= depth",
    "plan_show_tree": f"WITH RECURSIVE {_TREES}, {_LD}, {_ST}, {_DP}, {_FULLEST}, own AS (SELECT tp.* FROM tp JOIN full_one USING (k)), up AS (SELECT unnest(path) AS k, depth - generate_subscripts(path, 1) + 1 AS position FROM own), su AS (SELECT tp.k, tp.depth - own.depth AS position FROM tp, own WHERE list_contains(tp.path, own.k) AND tp.k <> own.k), x AS (SELECT 'ticket' AS section, 0 AS position, k FROM own UNION ALL SELECT 'ancestor', position, k FROM up WHERE position > 0 UNION ALL SELECT 'subtree', position, k FROM su UNION ALL SELECT 'child', position, k FROM su WHERE position = 1) SELECT section, position::INTEGER AS position, record_id AS id, title FROM x JOIN lv USING (k) UNION ALL SELECT 'decision', min(position)::INTEGER, dc.id, any_value(dc.title) FROM up JOIN lv USING (k) JOIN dc ON dc.k = upper(trim(lv.decision_ref)) WHERE dc.deleted_at IS NULL GROUP BY dc.id UNION ALL SELECT 'blocker', 1, x.record_id, x.title FROM deps JOIN lv x ON x.k = a JOIN full_one ON full_one.k = deps.b",
    "plan_board": f"WITH {_READ} SELECT position::INTEGER AS position, status, label, ticket_id, title, priority FROM tr JOIN {_BOARD} USING (status)",
    "log_upgrade": "WITH g AS (SELECT * EXCLUDE (line_no, canonical_version), min(line_no) AS first FROM changelog GROUP BY ALL) SELECT log_file, row_number() OVER (PARTITION BY log_file ORDER BY first, hash, row_json)::INTEGER AS line_no, table_name, hash, 3 AS canonical_version FROM g",
    "log_append": "SELECT 'decisions/' || left(updated_at, 7) || '.sql' AS log_file, count(*) FILTER (WHERE updated_at < '2024-07-01') AS written, count(*) FILTER (WHERE updated_at >= '2024-07-01') AS skipped FROM (SELECT DISTINCT * FROM decisions) WHERE updated_at >= '2024-01-01' GROUP BY 1",
    "snapshot_round_trip": f"WITH {_LD}, nw AS (SELECT id, title, status, date, hash, deleted_at FROM dc WHERE deleted_at IS NULL) SELECT * FROM nw UNION ALL SELECT id, title, status, date, hash, deleted_at FROM (SELECT DISTINCT * FROM decisions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, hash DESC) = 1) WHERE deleted_at IS NOT NULL AND id NOT IN (SELECT id FROM nw)",
    "extract_headings": f"WITH RECURSIVE {_DOC_LINES} SELECT path, length(regexp_extract(l, '^#+'))::INTEGER AS depth, regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^#+', ''), '^\\s+|\\s+$', '', 'g'), '#+$', ''), '\\s+$', '') AS text, line_offset FROM op WHERE regexp_matches(l, '^#{{1,6}}\\s+\\S')",
    "extract_links": f"WITH RECURSIVE {_DOC_LINES}, w AS (SELECT path, n, unnest(regexp_extract_all(l, '!?\\[\\[[^\\]]+\\]\\]')) AS x FROM op), y AS (SELECT path, n, left(x, 1) = '!' AS e, regexp_extract(x, '\\[\\[([^\\]]+)', 1) AS x FROM w), m AS (SELECT path, n, unnest(regexp_extract_all(l, '!?\\[[^\\]]*\\]\\([^)]+\\)')) AS x FROM op) SELECT path AS source_path, trim(split_part(x, '|', 1)) AS target_path, CASE WHEN contains(x, '|') THEN nullif(trim(substr(x, instr(x, '|') + 1)), '') END AS alias, CASE WHEN e THEN 'embed' ELSE 'wiki' END AS link_type, n::INTEGER AS line FROM y UNION ALL SELECT path, trim(regexp_extract(x, '\\]\\((.+)\\)$', 1)), coalesce(nullif(regexp_extract(x, '^!?\\[([^\\]]*)\\]', 1), ''), trim(regexp_extract(x, '\\]\\((.+)\\)$', 1))), 'md', n::INTEGER FROM m",
    "extract_anchors": f"WITH {_DOCS}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM docs), f AS (SELECT *, regexp_matches(l, '^\\s*```') AS m, sum(regexp_matches(l, '^\\s*```')::INT) OVER (PARTITION BY path ORDER BY i) AS k FROM l), h AS (SELECT path, i, least(length(regexp_extract(l, '^#+')), 6)::INTEGER AS level, rtrim(regexp_replace(regexp_replace(l, '^#{{1,6}}', ''), '^\\s+|\\s+$', '', 'g'), '# ' || chr(9)) AS text FROM f WHERE NOT m AND k % 2 = 0 AND regexp_matches(l, '^#{{1,6}}[ \\t]')), g AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_ -]', '', 'g'), '[ -]+', '-', 'g'), '-') AS base FROM h) SELECT path, level, text, base || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY i) AS n FROM g WHERE base <> '')",
    "extract_decisions": f"WITH {_DOCS}, {_DECISION_LINES}, b AS (SELECT path, rec, bool_or(regexp_matches(l, '(?i)^\\s*-\\s+\\*\\*superseded\\s+by:\\*\\*')) AS over, arg_min(lower(regexp_extract(l, '^\\s*-\\s+\\*\\*Status:\\*\\*\\s+(.+)', 1)), i) FILTER (WHERE regexp_matches(l, '^\\s*-\\s+\\*\\*Status:\\*\\*\\s+.')) AS said, arg_min(regexp_extract(l, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), i) FILTER (WHERE regexp_matches(l, '^\\s*-\\s+\\*\\*(Date|Rejected):\\*\\*\\s+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS date FROM db GROUP BY ALL) SELECT path, id, {_KIND} AS type, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS domain, title, CASE WHEN left(id, 1) = 'R' THEN 'active' WHEN over THEN 'superseded' WHEN left(id, 1) = 'D' THEN 'active' WHEN said LIKE 'resolved%' AND NOT contains(said, 'partial') AND NOT contains(said, 'remaining') THEN 'resolved' ELSE 'open' END AS status, date FROM dr LEFT JOIN b USING (path, rec)",
    "extract_decision_refs": f"WITH {_DOCS}, {_DECISION_LINES} SELECT path, id, target, ref_type, arg_min(CASE WHEN strlen(note) > 200 THEN left(note, 197) || '...' ELSE note END, i) AS note FROM df GROUP BY path, rec, id, target, ref_type",
    "decision_violations": f"WITH {_FOLDER_DOCS}, {_DECISION_LINES}, st AS (SELECT DISTINCT path, split_part(path, '/', 1) AS folder, regexp_replace(split_part(path, '/', 2), '\\.md$', '') AS stem FROM nn) SELECT DISTINCT 'error' AS severity, 'duplicate_id' AS problem, id AS subject, '' AS other FROM dr GROUP BY id HAVING count(DISTINCT path) > 1 UNION ALL SELECT DISTINCT 'error', 'empty_title', id, '' FROM dr WHERE title = '' UNION ALL SELECT DISTINCT 'error', 'broken_ref', id, target FROM df WHERE target NOT IN (SELECT id FROM dr) UNION ALL SELECT 'warning', 'filename_style', path, '' FROM st WHERE NOT regexp_full_match(stem, '[a-z][a-z0-9-]*') UNION ALL SELECT DISTINCT 'warning', 'wrong_folder', dr.path, id FROM dr JOIN st USING (path) WHERE {_KIND} <> CASE folder WHEN 'decisions' THEN 'confirmed' WHEN 'questions' THEN 'question' ELSE 'rejected' END UNION ALL SELECT 'warning', 'unpaired', path, '' FROM st WHERE folder = 'questions' AND stem NOT IN (SELECT stem FROM st WHERE folder = 'decisions') UNION ALL SELECT 'warning', 'shared_prefix', a.path, b.path FROM st a JOIN st b ON a.folder = b.folder AND a.stem <> b.stem AND starts_with(b.stem, a.stem)",
    "decision_sync": f"WITH {_LD}, o AS (SELECT id, hash FROM (SELECT DISTINCT * FROM decisions) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at, hash) = 1), n AS (SELECT id, hash FROM dc WHERE deleted_at IS NULL) SELECT id, CASE WHEN n.id IS NULL THEN 'pruned' WHEN o.id IS NULL THEN 'new' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'unchanged' ELSE 'changed' END AS action FROM o FULL JOIN n USING (id)",
    "rank_default": f"WITH {_F}, {_TAGS}, {_BUSY}, {_CAND_RELATED}, {_SIGNALS} {_score_sql('default')}",
    "dsl_regexp": f"WITH {_F} SELECT path FROM f WHERE regexp_matches(path, '^[a-m].*[0-9].md$') AND contains({_NAME}, 'e')",
    "dsl_cast": f"WITH {_F} SELECT path, trunc(size / 7.0::DOUBLE)::BIGINT AS i, size || 'x' AS t, coalesce(TRY_CAST(nullif(regexp_extract({_NAME}, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS n, size / 4::DOUBLE AS r FROM f",
    "sink_json": "SELECT to_json({'id': id, 'title': title, 'date': date, 'deleted_at': deleted_at, 'canonical_version': canonical_version})::VARCHAR AS value FROM (SELECT DISTINCT * FROM decisions)",
    "log_statements": "SELECT 'INSERT INTO decisions (id, title, date, updated_at, canonical_version) VALUES (' || concat_ws(', ', " + ", ".join(f"coalesce('{_Q}' || replace({c}, '{_Q}', '{_Q}{_Q}') || '{_Q}', 'NULL')" for c in ("id", "title", "date", "updated_at")) + ", coalesce(canonical_version::VARCHAR, 'NULL')) || ') ON CONFLICT(id) DO UPDATE SET title=excluded.title, date=excluded.date, updated_at=excluded.updated_at, canonical_version=excluded.canonical_version WHERE excluded.updated_at >= decisions.updated_at;' AS statement FROM (SELECT DISTINCT * FROM decisions)",
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "stream_history": "SELECT DISTINCT hash, ticket_record_id, field FROM ticket_history",
    "stream_log": P4,
}


def oracle_sql() -> dict[str, str]:
    return {**{f"dsl_{n}": s for n, _, s in DSL if s}, **SQL}
