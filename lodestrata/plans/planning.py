"""Decisions and tickets: lists, joins, graph neighbours, counts, collisions and comparisons of states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.timetext import fold_id
from ..operators.hierarchy import above, below, hierarchy
from ..runtime import stored


def current(df: DataFrame, key: str) -> DataFrame:
    """The row of each id that counts (the textually greatest updated_at), dead ones included."""
    cols = [c for c in df.columns if c != "_key"]
    return df.where(F.col(key).isNotNull()).groupBy(fold_id(F.col(key)).alias("_key")).agg(F.max_by(F.struct(*cols), F.struct(F.coalesce("updated_at", F.lit("")), F.coalesce("hash", F.lit("")))).alias("_r")).select("_key", "_r.*")


def live(df: DataFrame, key: str) -> DataFrame:
    return current(df, key).where("deleted_at IS NULL")


def number_of(c: Column, at: int = 3) -> Column:
    """The number in an id like D-12 or T-7."""
    return F.substring(c, at, 18).try_cast("bigint")


def decision_list(decisions: DataFrame, **equal: str) -> DataFrame:
    """Live decisions by prefix and number; keywords are column = value filters."""
    df = live(decisions, "id")
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    return df.select("id", "type", "domain", "title", "status", "date").orderBy(F.substring("id", 1, 1), number_of(F.col("id")), "id")


def decision_neighbours(decision_refs: DataFrame, decision: str | None = None) -> DataFrame:
    """Live references of either direction: all, or those that touch one decision."""
    df = decision_refs.where("deleted_at IS NULL")
    if decision is not None:
        me = decision.strip().upper()
        df = df.where((fold_id(F.col("source_id")) == me) | (fold_id(F.col("target_id")) == me))
    return df.select("ref_type", "source_id", "target_id", "note").distinct().orderBy("ref_type", "source_id", "target_id")


def ticket_read(tickets: DataFrame, idmap: DataFrame) -> DataFrame:
    """Live tickets with their label and their parent's label (null where there is none); idmap is (record_id, ticket_id)."""
    t = live(tickets, "record_id").select("_key", "record_id", "type", "title", "status", "priority", fold_id(F.col("parent_record_id")).alias("_parent"))
    labels = idmap.select(fold_id(F.col("record_id")).alias("_key"), "ticket_id")
    up = labels.select(F.col("_key").alias("_parent"), F.col("ticket_id").alias("parent_id"))
    return t.join(labels, "_key").join(up, "_parent", "left").select("record_id", "ticket_id", "parent_id", "type", "title", "status", "priority")


def tickets_by_decision(tickets: DataFrame, decisions: DataFrame) -> DataFrame:
    """decision, record_id, title: live tickets of live decisions."""
    t = live(tickets, "record_id").select(fold_id(F.col("decision_ref")).alias("_d"), "record_id", F.col("title").alias("ticket"))
    return live(decisions, "id").select(F.col("_key").alias("_d"), F.col("id").alias("decision"), "title").join(t, "_d").select("decision", "title", "record_id", "ticket")


def child_counts(tickets: DataFrame) -> DataFrame:
    """record_id, children of every live ticket; leaves have 0. Children are counted before joining."""
    t = live(tickets, "record_id").select("_key", "record_id", fold_id(F.col("parent_record_id")).alias("_parent"))
    kids = t.where("_parent IS NOT NULL").groupBy(F.col("_parent").alias("_key")).agg(F.count("*").alias("children"))
    return t.join(kids, "_key", "left").select("record_id", F.coalesce("children", F.lit(0)).alias("children"))


def leaves(tickets: DataFrame) -> DataFrame:
    """Live tickets without a live child."""
    t = live(tickets, "record_id").select("_key", "record_id", fold_id(F.col("parent_record_id")).alias("_parent"))
    return t.join(t.select(F.col("_parent").alias("_key")).distinct(), "_key", "left_anti").select("record_id")


def blockers(tickets: DataFrame, deps: DataFrame) -> DataFrame:
    """blocked, blocker, blocker_title: live dependencies between live tickets; deps is (blocker_record_id, blocked_record_id)."""
    t = live(tickets, "record_id").select("_key", "record_id", "title")
    d = deps.select(fold_id(F.col("blocker_record_id")).alias("_from"), fold_id(F.col("blocked_record_id")).alias("_to")).distinct()
    a = t.select(F.col("_key").alias("_from"), F.col("record_id").alias("blocker"), F.col("title").alias("blocker_title"))
    b = t.select(F.col("_key").alias("_to"), F.col("record_id").alias("blocked"))
    return d.join(a, "_from").join(b, "_to").select("blocked", "blocker", "blocker_title")


def unblocked(tickets: DataFrame, deps: DataFrame, closed: tuple[str, ...] = ()) -> DataFrame:
    """Live tickets that no live ticket whose status is outside `closed` blocks."""
    t = live(tickets, "record_id").select("_key", "record_id", "status")
    open_ = t.where(~F.col("status").isin(*closed)) if closed else t
    held = deps.select(fold_id(F.col("blocker_record_id")).alias("_key"), fold_id(F.col("blocked_record_id")).alias("_to")).join(open_, "_key", "left_semi")
    return t.join(held.select(F.col("_to").alias("_key")), "_key", "left_anti").select("record_id")


def ticket_list(tickets: DataFrame, idmap: DataFrame, labels: DataFrame | None = None, label: str | None = None, parent: str | None = None, under: str | None = None, leaf: bool = False, **equal: str) -> DataFrame:
    """ticket_read's rows by label number; every filter is optional and all must hold.

    equal: column = value of status, team, assigned_to, decision_ref, type or priority. label: live labels
    (ticket_record_id, label) of the ticket. parent, under: a record id or label number; the ticket lies directly, or
    anywhere, below it. leaf: without a live child. An unknown parent or root gives no rows.
    """
    rows = live(tickets, "record_id")
    for k, v in equal.items():
        rows = rows.where(F.col(k) == v)
    rows = rows.select("_key", fold_id(F.col("parent_record_id")).alias("_parent"))
    if label is not None:
        if labels is None:
            raise ValueError("a label filter needs the labels")
        rows = rows.join(labels.where(F.col("label") == label).select(fold_id(F.col("ticket_record_id")).alias("_key")), "_key", "left_semi")
    if parent is not None:
        rows = rows.join(_named(idmap, parent).withColumnRenamed("_key", "_parent"), "_parent", "left_semi")
    if under is not None:
        tree = stored(hierarchy(tickets))
        inside = reduce(DataFrame.unionByName, (below(tree, own) for own in _tree_rows(tree, _named(idmap, under))), below(tree, None))
        inside = inside.select(fold_id(F.col("record_id")).alias("_key"))
        rows = rows.join(inside, "_key", "left_semi")
    if leaf:
        kids = live(tickets, "record_id").select(fold_id(F.col("parent_record_id")).alias("_key")).where("_key IS NOT NULL").distinct()
        rows = rows.join(kids, "_key", "left_anti")
    keep = rows.select(F.col("_key").alias("_kept"))
    out = ticket_read(tickets, idmap)
    return out.join(keep, fold_id(F.col("record_id")) == F.col("_kept"), "left_semi").orderBy(number_of(F.col("ticket_id")), "record_id")


def _named(idmap: DataFrame, one: str) -> DataFrame:
    """The key of a ticket given by its record id or its label number."""
    wanted = one.strip().upper()
    by_label = idmap.where(F.upper(F.trim("ticket_id")) == wanted).select(fold_id(F.col("record_id")).alias("_key"))
    return by_label.unionByName(idmap.sparkSession.createDataFrame([(wanted,)], "_key string")).distinct()


def _tree_rows(tree: DataFrame, keys: DataFrame) -> list[Row]:
    """The rows of hierarchy that bear one of a few keys (_key)."""
    return tree.join(keys.withColumnRenamed("_key", "key"), "key", "left_semi").collect()


def ancestors(tickets: DataFrame, one: str, tree: DataFrame | None = None) -> DataFrame:
    """distance, record_id, type, title of what lies above a ticket, its parent first; none at or below a ring. tree: hierarchy's, if at hand."""
    rows = live(tickets, "record_id").select("record_id", "type", "title")
    tree = stored(hierarchy(tickets)) if tree is None else tree
    up = above(tree, tree.where(F.col("key") == one.strip().upper()).first()).withColumnRenamed("position", "distance")
    return up.join(rows, "record_id").select("distance", "record_id", "type", "title").orderBy("distance")


def show_tree(tickets: DataFrame, decisions: DataFrame, deps: DataFrame, one: str) -> DataFrame:
    """section, position, id, title of everything around one live ticket, a row for each.

    Sections: ticket, ancestor (position: distance), decision (those of the ticket and its ancestors, distinct, nearest first),
    blocker, child, subtree (position: distance; children included). An unknown or dead ticket gives no rows.
    """
    me = one.strip().upper()
    rows = live(tickets, "record_id").select("_key", "record_id", "title", fold_id(F.col("decision_ref")).alias("_decision"))
    tree = stored(hierarchy(tickets))
    row = tree.where(F.col("key") == me).first()
    own = tree.sparkSession.createDataFrame([(row["record_id"],)] if row else [], "record_id string")
    up = above(tree, row)
    line = up.unionByName(own.select(F.lit(0).alias("position"), "record_id"))
    known = live(decisions, "id").select(F.col("_key").alias("_decision"), "id", "title")
    meant = line.join(rows.select("record_id", "_decision"), "record_id").where("_decision IS NOT NULL").groupBy("_decision").agg(F.min("position").alias("position"))
    subtree = below(tree, row)
    part = lambda df, name: df.join(rows.select("record_id", "title"), "record_id").select(F.lit(name).alias("section"), "position", F.col("record_id").alias("id"), "title")
    held = blockers(tickets, deps).where(fold_id(F.col("blocked")) == me).select(F.lit("blocker").alias("section"), F.lit(1).alias("position"), F.col("blocker").alias("id"), F.col("blocker_title").alias("title"))
    out = part(own.select(F.lit(0).alias("position"), "record_id"), "ticket").unionByName(part(up, "ancestor")).unionByName(part(subtree, "subtree")).unionByName(part(subtree.where("position = 1"), "child"))
    return out.unionByName(meant.join(known, "_decision").select(F.lit("decision").alias("section"), "position", "id", "title")).unionByName(held)


def board(tickets: DataFrame, idmap: DataFrame, columns: list[tuple[str, str]], team: str | None = None) -> DataFrame:
    """position, status, label, ticket_id, title, priority: live tickets in the order of columns (status, label), then by number.

    Statuses outside columns have no place on the board; columns without a ticket have no rows.
    """
    wanted = tickets.sparkSession.createDataFrame([(i, s, n) for i, (s, n) in enumerate(columns)], "position int, status string, label string")
    rows = ticket_list(tickets, idmap, **({"team": team} if team else {}))
    return rows.join(F.broadcast(wanted), "status").select("position", "status", "label", "ticket_id", "title", "priority").orderBy("position", number_of(F.col("ticket_id")), "ticket_id")  # a vocabulary


def dashboard(decisions: DataFrame, tickets: DataFrame) -> DataFrame:
    """relation, type, status, count over the counting rows, soft-deleted ones included."""
    d = current(decisions, "id").groupBy("type", "status").agg(F.count("*").alias("count")).select(F.lit("decisions").alias("relation"), "type", "status", "count")
    t = current(tickets, "record_id").groupBy("status").agg(F.count("*").alias("count")).select(F.lit("tickets").alias("relation"), F.lit("").alias("type"), "status", "count")
    return d.unionByName(t)


def next_ids(decisions: DataFrame) -> DataFrame:
    """prefix, next_number: one above the highest number any version used."""
    ids = decisions.select(fold_id(F.col("id")).alias("id"))
    return ids.groupBy(F.substring("id", 1, 1).alias("prefix")).agg((F.max(number_of(F.col("id"))) + 1).alias("next_number")).where("next_number IS NOT NULL")


def label_collisions(idmap: DataFrame) -> DataFrame:
    """ticket_id, records, record_id: a row for each record of a label that more than one record bears."""
    pairs = idmap.select("ticket_id", "record_id").distinct()
    many = pairs.groupBy("ticket_id").agg(F.count("*").alias("records")).where("records > 1")
    return pairs.join(many, "ticket_id").select("ticket_id", "records", "record_id")


def state_difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem ('missing' or 'changed') of rows of before that after lacks or has with another hash; new rows are none."""
    a = before.select(*keys, F.col("hash").alias("_a"))
    b = after.select(*keys, F.col("hash").alias("_b"), F.lit(True).alias("_in"))
    df = a.join(b, keys, "left").where("_in IS NULL OR NOT (_a <=> _b)")
    return df.select(*keys, F.when(F.col("_in").isNull(), "missing").otherwise("changed").alias("problem"))


def row_hash(*cols: str) -> Column:
    """md5 of the columns joined by 0x1F, nulls as NUL NULL NUL."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00NULL\x00")) for c in cols)))


def titleize(status: Column) -> Column:
    """in_progress as In Progress; the tail of a word keeps its case."""
    words = F.split(F.replace(status, F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")
