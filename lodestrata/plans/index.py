"""Incremental refresh of an index: what a new scan means against the stored one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(column: str = "content") -> Column:
    """SHA-256 of raw bytes, in hex."""
    return F.sha2(F.col(column), 256)


def classify(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """path, action, mtime, size, content_hash of the scan against stored files.

    same mtime: unchanged, whatever the content; same hash: touched; other hash: changed; not stored: new; not scanned: removed.
    """
    a = stored.select("path", F.col("mtime").alias("_m"), F.col("content_hash").alias("_h"), F.lit(True).alias("_a"))
    b = scanned.select("path", "mtime", "size", "content_hash", F.lit(True).alias("_b"))
    action = (
        F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "new").when(F.col("_m") == F.col("mtime"), "unchanged")
        .when(F.col("_h") == F.col("content_hash"), "touched").otherwise("changed")
    )
    return a.join(b, "path", "full").select("path", action.alias("action"), "mtime", "size", "content_hash")


def refreshed(stored: DataFrame, scanned: DataFrame, now: int) -> DataFrame:
    """The files relation after a refresh. A touched file keeps its ctime; new and changed ones take their mtime."""
    acts = classify(stored, scanned).where("action <> 'removed'")
    old = stored.select("path", F.col("ctime").alias("_c"), F.col("size").alias("_s"), F.col("content_hash").alias("_h"), F.col("last_scanned").alias("_l"))
    fresh, same = F.col("action").isin("new", "changed"), F.col("action") == "unchanged"
    return acts.join(old, "path", "left").select(
        "path", "mtime", F.when(fresh, F.col("mtime")).otherwise(F.col("_c")).alias("ctime"), F.when(fresh, F.col("size")).otherwise(F.col("_s")).alias("size"),
        F.when(fresh, F.col("content_hash")).otherwise(F.col("_h")).alias("content_hash"), F.when(same, F.col("_l")).otherwise(F.lit(now)).alias("last_scanned"),
    )


def pruned(relation: DataFrame, acts: DataFrame, key: str = "path") -> DataFrame:
    """Rows of a relation whose note neither changed nor went away; those of new and changed notes are extracted anew."""
    gone = acts.where(F.col("action").isin("removed", "changed")).select(F.col("path").alias(key))
    return relation.join(gone, key, "left_anti")


def run_stats(acts: DataFrame) -> DataFrame:
    return acts.groupBy("action").agg(F.count("*").alias("files"))
