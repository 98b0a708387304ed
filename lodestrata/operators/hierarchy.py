"""Parent-child links to full hierarchies (problem 5).

Only nodes that have both a live parent and a child take part in the search for roots. Their links are contracted: within a
partition every node follows its parent chain to the last ancestor that is still there, its fragment's exit, and keeps exit and
distance. Exits and the links between fragments form a smaller quotient forest, which is solved the same way; a node's
root is then its exit's, its depth the exit's plus its distance. A chain that bites its own tail inside a partition is a local ring;
one that does so across fragments shows as a ring of the quotient. Roots and nodes without children take their place
in joins before and after. Paths are built on demand, by doubling.

A placement that co-locates parents: a node goes by its own id or, if its coin says so and its parent's says otherwise, by
its parent's, so that at least a quarter of all links lie inside a partition however many partitions there are; a level thus shrinks
the forest by a fixed factor, down to `base_rows` links of the quotient. Before, links that nothing hangs from are set aside, which
leaves little of shallow trees. Hot parents are not gathered: children of a parent with very many of them stay where their own id
places them. What a level keeps is written as compressed columns, so that neither disk nor the driver's plans grow with the levels.

Null ids are no nodes. A null, absent or dead parent makes a root. Ids compare folded (case, surrounding blanks). Rings and
everything below them have root 'cycle', depth -1 and no path. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.timetext import fold_id
from ..runtime import salted_join, spread_join, stored
from .orphans import _latest

CYCLE = "cycle"
_STEP = "id string, exit string, distance long, parent string, weight long, ring boolean"


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each id's fragment exit, the distance to it, and the exit's own link out of this partition."""
    up: dict[str, str] = {}
    weight: dict[str, int] = {}
    for pdf in batches:
        up.update(zip(pdf["id"], pdf["parent"], strict=True))
        weight.update(zip(pdf["id"], pdf["weight"], strict=True))
    exit_of: dict[str, str | None] = {}  # None: at or below a ring
    distance: dict[str, int] = {}
    for start in up:
        chain: list[str] = []
        walked: set[str] = set()
        at = start
        while at in up and at not in exit_of and at not in walked:
            walked.add(at)
            chain.append(at)
            at = up[at]
        if at in walked:
            top, far = None, 0
        elif at in exit_of:
            top, far = exit_of[at], distance[at]
        else:
            top = chain.pop()
            exit_of[top], distance[top], far = top, 0, 0
        for x in reversed(chain):
            far += weight[x]
            exit_of[x], distance[x] = top, far
    ids = list(exit_of)
    for a in range(0, len(ids), 50_000):
        part = ids[a : a + 50_000]
        tops = [exit_of[x] for x in part]
        yield pd.DataFrame({
            "id": part, "exit": tops, "distance": [distance[x] for x in part], "parent": [up.get(t) for t in tops],
            "weight": [weight.get(t, 0) for t in tops], "ring": [t is None for t in tops],
        })


def _placed(links: DataFrame, parts: int, fragment_rows: int, level: int) -> DataFrame:
    coin = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(2)) == 1
    follows = coin(F.col("id")) & ~coin(F.col("parent"))
    hot = links.where(follows).groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > max(1, fragment_rows // 8)).select("parent", F.lit(True).alias("hot"))
    out = salted_join(links, hot, ["parent"], ["id"], "left")
    return out.repartition(parts, F.when(follows & F.col("hot").isNull(), F.col("parent")).otherwise(F.col("id"))).select("id", "parent", "weight")


def _children(rows: DataFrame) -> DataFrame:
    """parent, n: how many of rows (parent, ...) lie directly below each parent."""
    return stored(rows.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n")))


def _hot(children: DataFrame) -> list[str]:
    """The parents with more than a thousandth of all children, so fewer than a thousand."""
    n = children.agg(F.sum("n").alias("n")).first()["n"] or 0
    return [r["parent"] for r in children.where(F.col("n") > max(10_000, n // 1000)).select("parent").collect()]


def _solve(links: DataFrame, fragment_rows: int, base_rows: int, level: int = 0) -> DataFrame:
    """links (id, parent, weight; a parent without a link is a root) -> id, root (null: ring), depth."""
    links = stored(links)
    n = links.count()
    if level and n <= base_rows:
        # every link is here: exits hang from roots, the quotient is empty
        steps = links.repartition(1).mapInPandas(_contract, _STEP)
        return steps.select("id", F.col("parent").alias("root"), (F.col("distance") + F.col("weight")).alias("depth"))
    children = _children(links)
    hot = _hot(children)
    if children.count() > 0.8 * n:
        return _contracted(links, n, hot, fragment_rows, base_rows, level)
    # links that nothing hangs from take their place below the others when those are solved
    inner = stored(links.join(children.select(F.col("parent").alias("id")), "id", "left_semi"))
    solved = stored(_contracted(inner, inner.count(), hot, fragment_rows, base_rows, level))
    above = solved.select(F.col("id").alias("parent"), "root", F.col("depth").alias("above"), F.lit(True).alias("linked"))
    root = F.when(F.col("linked"), F.col("root")).otherwise(F.col("parent"))
    return spread_join(links, above, "parent", "id", hot, "left").select("id", root.alias("root"), (F.col("weight") + F.coalesce("above", F.lit(0))).alias("depth"))


def _contracted(links: DataFrame, n: int, hot: list[str], fragment_rows: int, base_rows: int, level: int) -> DataFrame:
    """As _solve, of n stored links: fragments, then the quotient. hot: the parents with very many links."""
    parts = max(-(-n // fragment_rows), min(links.sparkSession.sparkContext.defaultParallelism, 2 + n // 1000))
    steps = stored(_placed(links, parts, fragment_rows, level).mapInPandas(_contract, _STEP))
    exits = steps.where("id = exit").select("id", "parent", "weight")
    inside = steps.select(F.col("id").alias("parent"), F.col("exit").alias("up"), F.col("distance").alias("way"), "ring")
    # an exit's parent lies in another fragment or is a root: link exit to exit; below a local ring, to itself
    up = F.when(F.col("ring"), F.col("id")).otherwise(F.coalesce("up", "parent"))
    upper = spread_join(exits, inside, "parent", "id", hot, "left").select("id", up.alias("parent"), (F.col("weight") + F.coalesce("way", F.lit(0))).alias("weight"))
    solved = _solve(upper, fragment_rows, base_rows, level + 1).withColumnRenamed("id", "exit")
    # an exit has no more rows than its fragment; null exits (rings) match nothing
    return spread_join(steps.select("id", "exit", "distance"), solved, "exit", "id", [], "left").select("id", "root", (F.col("distance") + F.col("depth")).alias("depth"))


def live_nodes(tickets: DataFrame) -> DataFrame:
    """key (folded id), record_id as stored, type, parent (folded) of each ticket whose counting row is live."""
    rows = _latest(tickets, "record_id", ["record_id", "deleted_at", "parent_record_id", "type"]).where("deleted_at IS NULL")
    return rows.select(F.col("_id").alias("key"), "record_id", "type", F.nullif(fold_id(F.col("parent_record_id")), F.lit("")).alias("parent"))


def hierarchy(tickets: DataFrame, fragment_rows: int = 200_000, base_rows: int = 20_000) -> DataFrame:
    """key, record_id, type, parent (record id of the live parent, or null), root_record_id, depth of every live ticket.

    fragment_rows bounds the links one task holds, base_rows those of the quotient that one task solves at the end.
    """
    nodes = stored(live_nodes(tickets))
    children = _children(nodes)
    hot = _hot(children)
    inner = stored(nodes.select("key", "record_id", "parent").join(children.select(F.col("parent").alias("key")), "key", "left_semi"))
    above = inner.select(F.col("key").alias("parent"), F.col("record_id").alias("above"))
    links = spread_join(inner.where("parent IS NOT NULL"), above, "parent", "key", hot)
    solved = _solve(links.select(F.col("record_id").alias("id"), F.col("above").alias("parent"), F.lit(1).cast("long").alias("weight")), fragment_rows, base_rows)
    placed = inner.join(solved.withColumn("linked", F.lit(True)), inner["record_id"] == solved["id"], "left").select(
        "key", "record_id", F.when(F.col("linked"), F.col("root")).otherwise(F.col("record_id")).alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))
    top = stored(placed.select(F.col("key").alias("parent"), F.col("record_id").alias("above"), F.col("root").alias("above_root"), F.col("depth").alias("above_depth")))
    # every node takes its place below its parent, which needs no second look at those already placed
    out = spread_join(nodes, top, "parent", "key", hot, "left")
    root = F.when(F.col("above").isNull(), F.col("record_id")).otherwise(F.col("above_root"))
    return out.select(
        "key", "record_id", "type", F.col("above").alias("parent"), F.coalesce(root, F.lit(CYCLE)).alias("root_record_id"),
        F.when(root.isNull(), -1).when(F.col("above").isNull(), 0).otherwise(F.col("above_depth") + 1).cast("int").alias("depth"),
    )


def with_paths(tree: DataFrame) -> DataFrame:
    """tree and path: record ids from the root down to the node; null at or below a ring.

    By doubling: after round k a node knows its nearest 2^k ancestors, and a join brings the next as many. What is
    written is as long as the paths themselves.
    """
    tree = stored(tree)
    deepest = tree.agg(F.max("depth").alias("d")).first()["d"] or 0
    own = tree.where("depth >= 0").select("record_id", F.col("parent").alias("up"), F.array("record_id").alias("path"))
    for _ in range(int(deepest).bit_length()):
        over = own.select(F.col("record_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        # only nodes that are somebody's next step travel as the repeated side
        over = over.join(own.where("up IS NOT NULL").select("up").distinct(), "up", "left_semi")
        joined = salted_join(own, over, ["up"], ["record_id"], "left")
        own = stored(joined.select("record_id", F.col("next").alias("up"), F.concat(F.coalesce("head", F.array().cast("array<string>")), "path").alias("path")))
    return tree.join(own.select("record_id", "path"), "record_id", "left")


_LINE = "position int, record_id string"


def above(tree: DataFrame, own: Row | None) -> DataFrame:
    """position (distance), record_id of what lies above one row of hierarchy; none at or below a ring.

    By doubling of pointers within its tree, without paths.
    """
    if own is None or own["depth"] <= 0:
        return tree.sparkSession.createDataFrame([], _LINE)
    up = tree.where((F.col("root_record_id") == own["root_record_id"]) & (F.col("depth") <= own["depth"])).select("record_id", F.col("parent").alias("up"), "depth")
    kept = up.join(up.select(F.col("up").alias("record_id")).distinct(), "record_id", "left_semi")
    jump = stored(kept.unionByName(up.where(F.col("record_id") == own["record_id"])).distinct())
    seen = jump.where(F.col("record_id") == own["record_id"]).select(F.lit(0).alias("position"), "record_id")
    step = 1
    while step <= own["depth"]:
        seen = stored(seen.unionByName(seen.join(jump, "record_id").select((F.col("position") + step).alias("position"), F.col("up").alias("record_id"))))
        step *= 2
        # nodes less deep than a jump is long have none
        over = jump.select(F.col("record_id").alias("up"), F.col("up").alias("next"))
        jump = stored(jump.where(F.col("depth") >= step).join(over, "up").select("record_id", F.col("next").alias("up"), "depth"))
    return seen.where("position > 0").select("position", "record_id")


def below(tree: DataFrame, own: Row | None, fragment_rows: int = 200_000, base_rows: int = 20_000) -> DataFrame:
    """position (distance), record_id of what lies below one row of hierarchy; none of a row at or below a ring.

    Its tree's links of greater depth, solved as a forest of their own: what has the row as its root lies below it.
    """
    if own is None or own["depth"] < 0:
        return tree.sparkSession.createDataFrame([], _LINE)
    deeper = tree.where((F.col("root_record_id") == own["root_record_id"]) & (F.col("depth") > own["depth"]))
    if own["depth"] == 0:  # it is the root
        return deeper.select(F.col("depth").alias("position"), "record_id")
    solved = _solve(deeper.select(F.col("record_id").alias("id"), "parent", F.lit(1).cast("long").alias("weight")), fragment_rows, base_rows)
    return solved.where(F.col("root") == own["record_id"]).select(F.col("depth").cast("int").alias("position"), F.col("id").alias("record_id"))


def descendants(tree: DataFrame) -> DataFrame:
    """ancestor, descendant, distance: every pair on a path, by expanding each node's own path."""
    up = F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("i", "ancestor")
    return with_paths(tree).where("depth > 0").select(F.col("record_id").alias("descendant"), "depth", up).select("ancestor", "descendant", (F.col("depth") - F.col("i")).alias("distance"))


def rings(tree: DataFrame) -> DataFrame:
    """record_id, parent_record_id (folded) of the nodes at or below a ring."""
    return tree.where("depth = -1").select("record_id", fold_id(F.col("parent")).alias("parent_record_id"))
