"""Schemas that drift between files (problem 1).

A folder's month has a schema: a tree whose children are frontmatter keys and, under object keys, their members. Two
consecutive months are compared by tree edit distance, which yields the cheapest script of
add, delete, rename, retype and move operations; scripts compile into projections that bring every file to the newest
schema of its folder.

Null paths, keys or ctimes carry no schema and are left out; rows that repeat exactly count once; an empty input gives
an empty result; columns beyond the ones named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timetext import epoch_month
from ..runtime import cut

SEP = "\x1f"
SCRIPT_SCHEMA = "folder string, period string, op string, node string, old_node string, old_type string, new_type string, cost double"


# --- the edit distance -------------------------------------------------------------------------------------------


def best_matching(gain: dict[tuple[int, int], int]) -> dict[int, int]:
    """The matching of greatest total gain; whole numbers of any size, so the outcome is exact. Unmatched ends gain nothing.

    Shortest augmenting paths with potentials; every left end also has a column of its own for staying unmatched.
    """
    left, right = sorted({i for i, _ in gain}), sorted({j for _, j in gain})
    n, m = len(left), len(right) + len(left)
    cost = [[-gain.get((i, j), 0) if (i, j) in gain else 1 for j in right] + [0] * n for i in left]
    over, under, owner = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        slack: list[int | None] = [None] * (m + 1)
        came, done = [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            done[at], row, least, nearest = True, owner[at], None, 0
            for j in range(1, m + 1):
                if done[j]:
                    continue
                d = cost[row - 1][j - 1] - over[row] - under[j]
                if slack[j] is None or d < slack[j]:
                    slack[j], came[j] = d, at
                if least is None or slack[j] < least:
                    least, nearest = slack[j], j
            for j in range(m + 1):
                if done[j]:
                    over[owner[j]] += least
                    under[j] -= least
                elif slack[j] is not None:
                    slack[j] -= least
            at = nearest
        while at:
            owner[at], at = owner[came[at]], came[at]
    pairs = {owner[j] - 1: j - 1 for j in range(1, m + 1) if owner[j]}
    return {left[i]: right[j] for i, j in pairs.items() if j < len(right) and (left[i], right[j]) in gain}


def edit_script(old: dict[tuple, str], new: dict[tuple, str], evidence: set[tuple[tuple, tuple]]) -> list[dict]:
    """Cheapest script from one keyed tree to another. Trees are {path tuple: type}; a node's parent is its prefix.

    Every operation costs 1: adding, deleting, renaming or retyping a node, moving a node with what hangs below it. Siblings
    are unordered and their names unique: equal names match, others may be renamed if the pair is in `evidence` and the types
    agree. Of all matchings that one is taken whose evidenced pairs come first by old, then new name, and among these the
    one with the fewest operations below. What is then deleted in one place and added in another under the same name and
    type is moved where that saves operations.
    """
    below: list[dict[tuple, list[tuple]]] = []
    size: list[dict[tuple, int]] = []
    for tree in (old, new):
        kids: dict[tuple, list[tuple]] = {}
        weight = dict.fromkeys(tree, 1)
        for p in sorted(tree, key=len, reverse=True):
            kids.setdefault(p[:-1], []).append(p)
            if p[:-1] in weight:
                weight[p[:-1]] += weight[p]
        below.append(kids)
        size.append(weight)
    scale = len(old) + len(new) + 1

    def whole(k: int, at: tuple) -> list[tuple]:
        return [at, *(x for c in sorted(below[k].get(at, ())) for x in whole(k, c))]

    def match(a: tuple, b: tuple) -> list[tuple[str, tuple | None, tuple | None]]:
        """Operations that turn what is below a into what is below b."""
        left, right = ({p[-1]: p for p in below[k].get(at, ())} for k, at in ((0, a), (1, b)))
        ops: list[tuple[str, tuple | None, tuple | None]] = []
        for n in sorted(left.keys() & right.keys()):
            o, c = left[n], right[n]
            ops += [("retype", o, c)] * (old[o] != new[c]) + match(o, c)
        gone, come = sorted(left.keys() - right.keys()), sorted(right.keys() - left.keys())
        open_pairs = [(i, j) for i, o in enumerate(gone) for j, n in enumerate(come) if (left[o], right[n]) in evidence and old[left[o]] == new[right[n]]]
        inner = {(i, j): match(left[gone[i]], right[come[j]]) for i, j in open_pairs}
        saved = {(i, j): size[0][left[gone[i]]] + size[1][right[come[j]]] - 1 - len(x) for (i, j), x in inner.items()}
        first = len(open_pairs)
        chosen = best_matching({ij: (scale << (first - 1 - rank)) + saved[ij] for rank, ij in enumerate(open_pairs)})
        for i, j in sorted(chosen.items()):
            ops += [("rename", left[gone[i]], right[come[j]]), *inner[i, j]]
        ops += [("delete", x, None) for i, o in enumerate(gone) if i not in chosen for x in whole(0, left[o])]
        return ops + [("add", None, x) for j, n in enumerate(come) if j not in chosen.values() for x in whole(1, right[n])]

    def shared(o: tuple, n: tuple) -> list[tuple[tuple, tuple]]:
        """What two subtrees with roots of one name and type have in common."""
        names = {c[-1]: c for c in below[1].get(n, ())}
        return [(o, n), *(x for c in sorted(below[0].get(o, ())) if c[-1] in names and old[c] == new[names[c[-1]]] for x in shared(c, names[c[-1]]))]

    ops = match((), ())
    gone, come = sorted(o for op, o, _ in ops if op == "delete"), sorted(n for op, _, n in ops if op == "add")
    free = set(gone), set(come)
    common = {
        (i, j): [(x, y) for x, y in shared(o, n) if x in free[0] and y in free[1]]
        for i, o in enumerate(gone) for j, n in enumerate(come) if o[-1] == n[-1] and old[o] == new[n] and o[:-1] != n[:-1]
    }
    ties = len(gone) * len(come) + 1
    moves = best_matching({(i, j): (2 * len(x) - 1) * ties + ties - 1 - (i * len(come) + j) for (i, j), x in common.items()})
    moved: list[tuple[str, tuple | None, tuple | None]] = []
    for i, j in sorted(moves.items(), key=lambda ij: (len(gone[ij[0]]), ij)):
        if gone[i] in free[0] and come[j] in free[1]:
            moved.append(("move", gone[i], come[j]))
            for x, y in common[i, j]:
                free[0].discard(x)
                free[1].discard(y)
    kept = [x for x in ops if (x[0] != "delete" or x[1] in free[0]) and (x[0] != "add" or x[2] in free[1])]
    return [{"op": op, "old": o, "new": n, "cost": 1.0} for op, o, n in kept + moved]


def _scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            old = {tuple(n["node"].split(SEP)): n["type"] for n in r.before}
            new = {tuple(n["node"].split(SEP)): n["type"] for n in r.after}
            seen = {(tuple(e["old"].split(SEP)), tuple(e["new"].split(SEP))) for e in (r.evidence if r.evidence is not None else [])}
            for x in edit_script(old, new, seen):
                o, n = x["old"], x["new"]
                rows.append((r.folder, r.period, x["op"], SEP.join(n) if n else None, SEP.join(o) if o else None, old.get(o) if o else None, new.get(n) if n else None, x["cost"]))
        yield pd.DataFrame(rows, columns=["folder", "period", "op", "node", "old_node", "old_type", "new_type", "cost"])


def _json_kind(v: object) -> str:
    return {bool: "bool", int: "number", float: "number", str: "string", list: "list", dict: "object"}.get(type(v), "null")


def _members(value: str | None) -> list[dict]:
    """Every member below an object value, to any depth, as (path, type, json)."""
    try:
        todo = [((), json.loads(value))] if value else []
    except ValueError:
        return []
    out = []
    while todo:
        at, v = todo.pop()
        if at and v is not None:
            out.append({"sub": SEP.join(at), "type": _json_kind(v), "value_json": json.dumps(v, separators=(",", ":"), ensure_ascii=False)})
        if isinstance(v, dict):
            todo += [((*at, str(k)), x) for k, x in v.items()]
    return out


def _members_of(values: pd.Series) -> pd.Series:
    return values.map(_members)


def json_members(c: Column) -> Column:
    return F.pandas_udf(_members_of, "array<struct<sub:string,type:string,value_json:string>>")(c)


# --- the distributed part ----------------------------------------------------------------------------------------


def dated_nodes(frontmatter: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows folder, period, path, node, type, value_json; months folder, period, n_files, previous)."""
    notes = (
        files.select(F.col("path"), F.col("ctime")).where("path IS NOT NULL AND ctime IS NOT NULL AND instr(path, '/') > 0")
        .groupBy("path").agg(F.min("ctime").alias("ctime"))
        .select("path", F.substring_index("path", "/", 1).alias("folder"), epoch_month(F.col("ctime")).alias("period"))
    )
    months = notes.groupBy("folder", "period").agg(F.count("*").alias("n_files"))
    months = months.withColumn("previous", F.lag("period").over(Window.partitionBy("folder").orderBy("period")))
    rows = frontmatter.select("path", F.col("key").alias("node"), "type", "value_json").where("path IS NOT NULL AND key IS NOT NULL").distinct()
    rows = rows.join(notes, "path").select("folder", "period", "path", "node", "type", "value_json")
    inner = rows.where("type = 'object'").select("folder", "period", "path", "node", F.explode(json_members(F.col("value_json"))).alias("m"))
    inner = inner.select("folder", "period", "path", F.concat_ws(SEP, "node", "m.sub").alias("node"), F.col("m.type").alias("type"), F.col("m.value_json").alias("value_json"))
    return rows.unionByName(inner), months


def month_schemas(nodes: DataFrame, months: DataFrame) -> DataFrame:
    """folder, period, node, type of what at least half of the folder's files of the month carry."""
    per_file = nodes.groupBy("folder", "period", "node", "type", "path").agg(F.count("*").alias("n"))
    types = per_file.groupBy("folder", "period", "node", "type").agg(F.sum("n").alias("n"))
    kind = types.groupBy("folder", "period", "node").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"))
    carried = per_file.groupBy("folder", "period", "node").agg(F.count_distinct("path").alias("carriers"))
    return (
        kind.join(carried, ["folder", "period", "node"]).join(months, ["folder", "period"])
        .where("carriers * 2 >= n_files").select("folder", "period", "node", "type")
    )


def drift_scripts(frontmatter: DataFrame, files: DataFrame) -> DataFrame:
    """The edit script from each folder's previous month to each month, one row per operation.

    Work that grows with the data is partial aggregation and equi-joins on (folder, month, key); what is gathered for one
    script is two schemas, at most twice the mean number of keys of a note each.
    """
    nodes, months = map(cut, dated_nodes(frontmatter, files))  # read four times below
    schema = cut(month_schemas(nodes, months))
    steps = months.where("previous IS NOT NULL").select("folder", "period", "previous")
    after = schema.join(steps, ["folder", "period"], "left_semi").withColumnRenamed("type", "new_type")
    before = (
        schema.withColumnRenamed("period", "previous").join(steps, ["folder", "previous"])
        .select("folder", "period", "node", F.col("type").alias("old_type"))
    )
    both = cut(after.join(before, ["folder", "period", "node"], "full"))
    come = both.where("old_type IS NULL").select("folder", "period", F.col("node").alias("new"), F.col("new_type").alias("type"))
    gone = both.where("new_type IS NULL").select("folder", "period", F.col("node").alias("old"), F.col("old_type").alias("type"))
    # pairs of one folder-month whose types agree; both sides are parts of one month's schema
    pairs = come.join(gone, ["folder", "period", "type"]).select("folder", "period", "new", "old")
    values = nodes.select("folder", "period", "node", "value_json")
    fresh = (
        values.join(pairs.select("folder", "period", F.col("new").alias("node")).distinct(), ["folder", "period", "node"], "left_semi")
        .distinct().withColumnRenamed("node", "new")
    )
    seen = (
        values.join(pairs.select("folder", F.col("old").alias("node")).distinct(), ["folder", "node"], "left_semi")
        .groupBy("folder", F.col("node").alias("old"), "value_json").agg(F.min("period").alias("first_seen"))
    )
    shared = (
        fresh.join(pairs, ["folder", "period", "new"]).join(seen, ["folder", "old", "value_json"])
        .where("first_seen < period").groupBy("folder", "period", "old", "new").agg(F.count("*").alias("hits"))
    )
    total = fresh.groupBy("folder", "period", "new").agg(F.count("*").alias("total"))
    evidence = (
        shared.join(total, ["folder", "period", "new"]).where("hits * 2 > total")
        .groupBy("folder", "period").agg(F.collect_list(F.struct("old", "new")).alias("evidence"))
    )
    side = lambda c: F.array_compact(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("node", F.col(c).alias("type")))))
    trees = both.groupBy("folder", "period").agg(side("old_type").alias("before"), side("new_type").alias("after"))
    return trees.join(evidence, ["folder", "period"], "left").mapInPandas(_scripts, SCRIPT_SCHEMA)


def drift_cases(scripts: DataFrame) -> DataFrame:
    """Scripts as p1_found's cases: the operations on top-level keys."""
    top = lambda c: F.instr(c, SEP) == 0
    said = scripts.select(
        "folder", "period",
        F.explode(F.array_compact(F.array(
            F.when(F.col("op").isin("rename") & top("node"), F.struct(F.lit("renamed").alias("k"), F.col("node").alias("f"), F.col("old_node").alias("o"))),
            F.when(F.col("op").isin("retype") & top("node"), F.struct(F.lit("retyped").alias("k"), F.col("node").alias("f"), F.lit("").alias("o"))),
            F.when(F.col("op").isin("add", "move") & top("node"), F.struct(F.lit("added").alias("k"), F.col("node").alias("f"), F.lit("").alias("o"))),
            F.when(F.col("op").isin("delete", "move") & top("old_node"), F.struct(F.lit("removed").alias("k"), F.col("old_node").alias("f"), F.lit("").alias("o"))),
        ))).alias("c"),
    )
    return said.select("folder", "period", F.col("c.k").alias("change_kind"), F.col("c.f").alias("field_key"), F.col("c.o").alias("old_key"))


def consistent_rows(frontmatter: DataFrame, files: DataFrame, scripts: DataFrame) -> DataFrame:
    """Every node of a filed note's schema tree under the path and type its folder uses last.

    A folder's scripts compile into one ordered list of path mappings, a month's by longest old path first; a node follows
    those later than its own month, so a chain a -> b -> c ends at c, a renamed or moved object takes its members
    along, and a member's own rename comes before its object's. What a script deletes stays under its old path. value holds
    the text of scalars as the newest type reads it (null where it can't), value_json stays beside it.
    """
    nodes, months = dated_nodes(frontmatter, files)
    op = F.struct((-F.length("old_node")).alias("first"), F.col("old_node").alias("o"), F.col("node").alias("n"))
    steps = scripts.where(F.col("op").isin("rename", "move")).groupBy("folder", "period").agg(F.sort_array(F.collect_list(op)).alias("ops"))
    steps = steps.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("period", "ops"))).alias("steps"))
    hit = f"get(filter(s.ops, x -> x.o = k OR startswith(k, concat(x.o, '{SEP}'))), 0)"
    mapped = f"if(s.period > period, coalesce(concat({hit}.n, substring(k, length({hit}.o) + 1)), k), k)"
    rows = nodes.join(steps, "folder", "left").withColumn("field_key", F.expr(f"coalesce(aggregate(steps, node, (k, s) -> {mapped}), node)"))
    newest = month_schemas(nodes, months).groupBy("folder", F.col("node").alias("field_key")).agg(F.max_by("type", "period").alias("field_type"))
    rows = rows.join(newest, ["folder", "field_key"], "left").withColumn("field_type", F.coalesce("field_type", "type"))
    text = F.get_json_object(F.concat(F.lit('{"v":'), "value_json", F.lit("}")), "$.v")
    value = (
        F.when(F.col("field_type") == "number", text.try_cast("double").cast("string"))
        .when(F.col("field_type") == "bool", F.when(F.lower(text).isin("true", "1", "yes", "on"), "true").when(F.lower(text).isin("false", "0", "no", "off"), "false"))
        .otherwise(text)
    )
    return rows.select("folder", "period", "path", F.col("node").alias("source_key"), "field_key", "field_type", value.alias("value"), "value_json")


def consistent_table(rows: DataFrame) -> DataFrame:
    """folder, period, path, fields: one row per note, its values by the folder's newest field paths (members after a `.`).

    Of several nodes of a note that end at one field, the one whose own name is first counts.
    """
    field = rows.where("value IS NOT NULL AND field_type <> 'object'").groupBy("folder", "period", "path", F.translate("field_key", SEP, ".").alias("k")).agg(F.min_by("value", F.struct("source_key", "value")).alias("v"))
    filled = field.groupBy("folder", "period", "path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("fields"))
    return rows.select("folder", "period", "path").distinct().join(filled, ["folder", "period", "path"], "left")
