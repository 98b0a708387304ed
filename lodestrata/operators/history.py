"""History of changing entity attributes (problem 2).

Change records become, per entity and attribute, a row of snapshots (one per instant); each value has a bitmap over the
snapshots in which it held, and every run of consecutive bits is one validity period.

A hot entity is split by time: snapshots are numbered and bitmaps built within one slice (a day by default), and what has
to cross slices is one summary row per entity, attribute and slice. So the largest group is one entity's day, and the
rows that meet in one window over a whole entity are bounded by the calendar, not by the number of changes.

Void rows, null ids and fields, and unreadable instants carry nothing. Exact repeats count once. A null value is no
period and ends the one before. An entity missing from the entity table has no period before its first change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timetext import DAY_MS, fold_id, millis_text, utc_millis


def live_changes(history: DataFrame, slice_ms: int = DAY_MS) -> DataFrame:
    """entity, attr, ts, edges: the distinct (old, new) pairs recorded at one instant."""
    return (
        history.where("deleted_at IS NULL AND ticket_record_id IS NOT NULL AND field IS NOT NULL")
        .select(fold_id(F.col("ticket_record_id")).alias("entity"), F.col("field").alias("attr"), utc_millis(F.col("changed_at")).alias("ts"), F.struct(F.col("old_value").alias("o"), F.col("new_value").alias("n")).alias("e"))
        .where("ts IS NOT NULL")
        .withColumn("slice", F.floor(F.col("ts") / slice_ms))
        .groupBy("entity", "attr", "slice", "ts").agg(F.collect_set("e").alias("edges"))
    )


def chain_ends(changes: DataFrame) -> DataFrame:
    """Adds first and last, the values before and after the instant (structs, so that null is a value).

    The pairs of one instant form a path: its end is the value entered once more often than left, its start the one left
    once more often. Changes that change nothing drop out unless alone. last is null where the pairs form a ring; then
    ring lists its values and the value before the instant decides.
    """
    real = F.filter("edges", lambda e: ~e["o"].eqNullSafe(e["n"]))
    wrap = lambda v: F.struct(v.alias("v"))
    df = changes.withColumn("real", real)
    df = df.withColumn("outs", F.transform("real", lambda e: wrap(e["o"]))).withColumn("ins", F.transform("real", lambda e: wrap(e["n"])))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y.eqNullSafe(x)))
    ends = F.filter("ins", lambda x: count("ins", x) > count("outs", x))
    starts = F.filter("outs", lambda x: count("outs", x) > count("ins", x))
    alone = (F.size("edges") == 1) | (F.size("real") == 0)  # first in each case below: the rest is for the few that chain
    lone = F.array_max("edges")
    return df.select(
        "entity", "attr", "slice", "ts",
        F.when(alone, wrap(lone["o"])).when(F.size(starts) > 0, F.array_min(starts)).alias("first"),
        F.when(alone, wrap(lone["n"])).when(F.size(ends) > 0, F.array_max(ends)).alias("last"),
        F.when(~alone & (F.size(ends) == 0), F.array_sort(F.array_distinct("ins"))).alias("ring"),
    )


def _slice_window(*order: str) -> Window:
    return Window.partitionBy("entity", "attr", "slice").orderBy(*order)


def settled_snapshots(history: DataFrame, entities: DataFrame, slice_ms: int = DAY_MS) -> DataFrame:
    """entity, attr, slice, ts, value (struct), ord (from 0 within the slice): the value from each instant on, with the instant of creation first."""
    events = chain_ends(live_changes(history, slice_ms)).repartition("entity", "attr", "slice")
    born = entities.groupBy(fold_id(F.col("record_id")).alias("entity")).agg(F.max_by("created_at", F.coalesce("updated_at", F.lit(""))).alias("c")).select("entity", utc_millis(F.col("c")).alias("born"))
    whole = Window.partitionBy("entity", "attr").orderBy("slice")
    back = Window.partitionBy("entity", "attr").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    summary = events.groupBy("entity", "attr", "slice").agg(
        F.max_by("last", F.when(F.col("last").isNotNull(), F.col("ts"))).alias("carry"),
        F.min_by("first", F.when(F.col("first").isNotNull(), F.col("ts"))).alias("ahead"),
        F.min("ts").alias("begin"), F.count("ring").alias("rings"),  # read so that both uses of events have the same columns and share one exchange
    )
    summary = summary.select(
        "entity", "attr", "slice",
        F.last("carry", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.last("ahead", ignorenulls=True).over(back).alias("after"),
        (F.row_number().over(whole) == 1).alias("opens"), "begin", "rings",
    ).where("rings >= 0").join(born, "entity", "left")
    w = _slice_window("ts")
    prior = F.coalesce(F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("before"))
    later = Window.partitionBy("entity", "attr", "slice").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    coming = F.coalesce(F.last("first", ignorenulls=True).over(later), F.col("after"))
    rows = events.join(summary, ["entity", "attr", "slice"]).select("*", prior.alias("prior"), coming.alias("coming"), F.row_number().over(w).alias("n"))
    in_ring = lambda v: F.when(F.exists("ring", lambda x: x.eqNullSafe(v)) & v.isNotNull(), v)
    chosen = F.coalesce(in_ring(F.col("prior")), in_ring(F.col("coming")), F.col("ring")[0])
    rows = rows.withColumn("value", F.coalesce("last", chosen)).withColumn("start", F.coalesce("first", chosen))
    snap = lambda ts, v, o: F.struct(ts.alias("ts"), v.alias("value"), o.cast("long").alias("ord"))
    born_first = F.coalesce(F.col("opens") & (F.col("born") < F.col("begin")), F.lit(False))  # the whole slice's numbers move up by one
    here = snap(F.col("ts"), F.col("value"), F.when(born_first, F.col("n")).otherwise(F.col("n") - 1))
    origin = snap(F.col("born"), F.col("start"), F.lit(0))
    rows = rows.select("entity", "attr", "slice", F.explode(F.when(born_first & (F.col("n") == 1), F.array(origin, here)).otherwise(F.array(here))).alias("s"))
    return rows.select("entity", "attr", "slice", "s.ts", "s.value", "s.ord")


def validity_periods(history: DataFrame, entities: DataFrame, slice_ms: int = DAY_MS) -> DataFrame:
    """entity, attr, value, from_ms, to_ms (null: still open), one row per maximal period of one non-null value."""
    snaps = settled_snapshots(history, entities, slice_ms)
    # presence bitmaps: 64 snapshots a word, one word per value that held in any of them
    bitmaps = snaps.withColumn("word", F.floor(F.col("ord") / 64)).withColumn("bit", (F.col("ord") % 64).cast("int")).groupBy("entity", "attr", "slice", "word", F.xxhash64("value").alias("h"), "value").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"),
        F.map_from_entries(F.collect_list(F.struct("bit", "ts"))).alias("at"),
    )
    has = lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0
    bit = F.sequence(F.lit(0), F.lit(63))
    starts = F.filter(bit, lambda i: has(i) & ((i == 0) | ~has(F.greatest(i - 1, F.lit(0)))))
    runs = bitmaps.select("entity", "attr", "slice", "value", F.explode(F.transform(starts, lambda i: F.col("at")[i])).alias("a"))
    # a run that begins with the value of the run before it continues that run: across words here, across slices below
    wa = _slice_window("a")
    runs = runs.withColumn("same", F.coalesce(F.lag("value").over(wa).eqNullSafe(F.col("value")) & (F.row_number().over(wa) > 1), F.lit(False))).where("NOT same")
    runs = runs.withColumn("k", F.row_number().over(wa))
    edges = runs.groupBy("entity", "attr", "slice").agg(
        F.min_by("value", "a").alias("head"), F.max_by("value", "a").alias("tail"), F.min("a").alias("a1"), F.min(F.when(F.col("k") == 2, F.col("a"))).alias("a2"),
    )
    whole = Window.partitionBy("entity", "attr").orderBy("slice")
    back = Window.partitionBy("entity", "attr").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("joins", F.lag("tail").over(whole).eqNullSafe(F.col("head")) & F.lag("slice").over(whole).isNotNull())
    edges = edges.withColumn("turn", F.when(F.col("joins"), F.col("a2")).otherwise(F.col("a1")))  # the slice's first change of value
    edges = edges.select("entity", "attr", "slice", "joins", F.last("turn", ignorenulls=True).over(back).alias("next_turn"))
    runs = runs.join(edges, ["entity", "attr", "slice"]).where("NOT (joins AND k = 1)")
    ends = F.coalesce(F.lead("a").over(wa), F.col("next_turn"))
    return runs.select("entity", "attr", F.col("value.v").alias("value"), F.col("a").alias("from_ms"), ends.alias("to_ms")).where("value IS NOT NULL")


def history_cases(history: DataFrame, tickets: DataFrame) -> DataFrame:
    """p2_found's columns."""
    return validity_periods(history, tickets).select(
        F.col("entity").alias("ticket_record_id"), F.col("attr").alias("field"), millis_text(F.col("from_ms")).alias("valid_from"),
        F.coalesce(millis_text(F.col("to_ms")), F.lit("open")).alias("valid_to"),
    )
