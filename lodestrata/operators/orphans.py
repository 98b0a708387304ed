"""References to records that do not exist (problem 3).

Parent keys are integers within a space; sorted, they compress into runs of contiguous keys. A reference is matched as-of
to the run that starts at or before it and is an orphan if there is none or the key lies beyond the run's end.

* Ids like D-12 are encoded exactly: the space is everything before the trailing number (leading zeros included), the key
  that number, so D-012 and D-12 differ as they do as text. Ids without a trailing number are a space of their own.
* Names are encoded by a 64-bit hash; a run then carries the names that share its key, and the reference's own text is
  looked up there, so a collision cannot hide an orphan.

Keys are cut into blocks (of consecutive numbers, or of equal leading hash bits): runs are built and matched within a block,
so no task grows with a space. References are reduced to distinct targets before they are shuffled to the blocks, and the
orphan targets are joined back to the references salted, so a target holding a third of all references is spread.

Null references name nothing and are no case; blank ids are orphans only if stored as a non-blank text. Empty inputs give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timetext import epoch_month, fold_id
from ..runtime import salted_join

#: how many consecutive numbers make a block, and how many low bits of a hash vary within one
NUMBER_BLOCK, HASH_BITS = 4096, 40
_NUMBERED = r"^(.*?)(0|[1-9][0-9]{0,17})$"


def numbered_key(folded: Column) -> Column:
    """struct<space, block, key> of an id that ends in a number; others get key 0 in a space of their own."""
    digits = F.regexp_extract(folded, _NUMBERED, 2)
    key = F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0))
    space = F.when(digits == "", F.concat(F.lit("="), folded)).otherwise(F.concat(F.lit("#"), F.regexp_extract(folded, _NUMBERED, 1)))
    return F.struct(space.alias("space"), F.floor(key / NUMBER_BLOCK).alias("block"), key.alias("key"))


def hashed_key(text: Column) -> Column:
    h = F.xxhash64(text)
    return F.struct(F.lit("~").alias("space"), F.shiftright(h, HASH_BITS).cast("bigint").alias("block"), h.alias("key"))


def contiguous_runs(parents: DataFrame) -> DataFrame:
    """space, block, start, stop, names from rows of space, block, key, text: maximal runs of consecutive keys."""
    keys = parents.groupBy("space", "block", "key").agg(F.collect_set("text").alias("texts"))
    w = Window.partitionBy("space", "block").orderBy("key")
    keys = keys.withColumn("island", F.col("key") - F.row_number().over(w))
    return keys.groupBy("space", "block", "island").agg(
        F.min("key").alias("start"), F.max("key").alias("stop"), F.flatten(F.collect_list("texts")).alias("names"),
    ).drop("island")


def orphan_targets(targets: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct targets (space, block, key, text) that no parent row (same columns) bears."""
    runs = contiguous_runs(parents).select("space", "block", F.col("start").alias("key"), F.struct("stop", "names").alias("run"), F.lit(None).cast("string").alias("text"))
    asked = targets.select("space", "block", "key", "text").distinct().withColumn("run", F.lit(None).cast(runs.schema["run"].dataType))
    w = Window.partitionBy("space", "block").orderBy("key", F.col("run").isNull())
    both = runs.unionByName(asked).withColumn("at", F.last("run", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    beyond = F.col("at").isNull() | (F.col("key") > F.col("at.stop"))
    unnamed = (F.col("space") == "~") & ~F.array_contains("at.names", F.col("text"))
    return both.where(F.col("run").isNull() & (beyond | unnamed)).select("space", "block", "key", "text")


def _latest(df: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """The row of each id that counts: the textually greatest updated_at (null below all)."""
    whole = F.struct(*[F.col(c) for c in keep])
    picked = df.where(F.col(key).isNotNull()).groupBy(fold_id(F.col(key)).alias("_id")).agg(F.max_by(whole, F.struct(F.coalesce("updated_at", F.lit("")), whole)).alias("_r"))
    return picked.select("_id", "_r.*")


def live_decisions(decisions: DataFrame) -> DataFrame:
    return _latest(decisions, "id", ["deleted_at", "created_at"]).where("deleted_at IS NULL").select(F.col("_id").alias("text"))


def _reference_rows(decision_refs: DataFrame, tickets: DataFrame) -> DataFrame:
    refs = decision_refs.where("deleted_at IS NULL").select(F.lit("decision_refs").alias("ref_table"), F.col("source_id").alias("source_key"), F.col("target_id").alias("target_key"), F.substring("created_at", 1, 7).alias("period"))
    held = _latest(tickets, "record_id", ["record_id", "deleted_at", "decision_ref", "created_at"]).where("deleted_at IS NULL")
    held = held.select(F.lit("tickets").alias("ref_table"), F.col("record_id").alias("source_key"), F.col("decision_ref").alias("target_key"), F.substring("created_at", 1, 7).alias("period"))
    return refs.unionByName(held).where("target_key IS NOT NULL").withColumn("text", fold_id(F.col("target_key"))).where("text <> ''")


def _link_rows(links: DataFrame, files: DataFrame) -> DataFrame:
    bare = F.regexp_replace(F.substring_index("target_path", "#", 1), r"^\s+|\s+$", "")
    rows = links.where("target_path IS NOT NULL").select("source_path", "target_path", bare.alias("text")).distinct()
    rows = rows.where((F.col("text") != "") & ~F.lower("text").rlike("^(http|https|mailto):"))
    months = files.where("path IS NOT NULL AND ctime IS NOT NULL").groupBy("path").agg(epoch_month(F.min("ctime")).alias("period"))
    rows = rows.join(months, rows["source_path"] == months["path"], "left")
    return rows.select(F.lit("links").alias("ref_table"), F.col("source_path").alias("source_key"), F.col("target_path").alias("target_key"), "period", "text")


def note_names(files: DataFrame) -> DataFrame:
    """Every spelling that resolves: the path and its last part, each with and without a final .md."""
    paths = files.where("path IS NOT NULL").select("path").distinct()
    bare = lambda c: F.regexp_replace(c, r"\.md$", "")
    last = F.substring_index("path", "/", -1)
    return paths.select(F.explode(F.array_distinct(F.array("path", bare(F.col("path")), last, bare(last)))).alias("text"))


def orphan_references(decision_refs: DataFrame, tickets: DataFrame, decisions: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """ref_table, source_key, target_key, period (yyyy-MM of the reference) of every orphan, distinct."""
    keyed = lambda df, key: df.select("*", key.alias("_k")).select("*", "_k.*").drop("_k")
    refs = keyed(_reference_rows(decision_refs, tickets), numbered_key(F.col("text")))
    names = keyed(_link_rows(links, files), hashed_key(F.col("text")))
    parents = keyed(live_decisions(decisions), numbered_key(F.col("text"))).unionByName(keyed(note_names(files), hashed_key(F.col("text"))))
    every = refs.unionByName(names)
    lost = orphan_targets(every, parents).select("space", "text")
    found = salted_join(every, lost, ["space", "text"], ["source_key"])
    return found.groupBy("ref_table", "source_key", "target_key").agg(F.min("period").alias("period"))


def orphan_report(found: DataFrame) -> DataFrame:
    """ref_table, period, orphans, sources, targets; references without a month come under ''."""
    return found.groupBy("ref_table", F.coalesce("period", F.lit("")).alias("period")).agg(
        F.count("*").alias("orphans"), F.count_distinct("source_key").alias("sources"), F.count_distinct("target_key").alias("targets"),
    )
