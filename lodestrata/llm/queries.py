"""Queries p7 to p9 over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table
from . import leakage, packing, subjects


def p7_assign(spark: SparkSession, d: str) -> DataFrame:
    """spec_id, doc_id, piece, token_from, n_tokens, container_id of every document in every container size."""
    packed = packing.pack_all(table(spark, d, "documents"), table(spark, d, "pack_specs"))
    return reduce(DataFrame.unionByName, (df.withColumn("spec_id", F.lit(s)) for s, _, df, _ in packed))


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    """spec_id, capacity_tokens, containers, tokens, unused_share, from the assignment itself."""
    packed = packing.pack_all(table(spark, d, "documents"), table(spark, d, "pack_specs"))
    out = []
    for s, capacity, df, _ in packed:
        used = df.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
        total = used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"))
        share = F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity))
        out.append(total.select(F.lit(s).alias("spec_id"), F.lit(capacity).alias("capacity_tokens"), "containers", "tokens", F.round(share, 6).alias("unused_share")))
    return reduce(DataFrame.unionByName, out)


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """spec_id, capacity_tokens, documents, over_full, split_whole, gaps: what must hold of an assignment, from its rows and tokens counted anew.

    over_full: containers above the capacity; split_whole: documents in pieces that fit whole; gaps: documents whose pieces
    are not all of their tokens once each.
    """
    documents = table(spark, d, "documents")
    whole = cut(packing.token_lengths(documents))
    out = []
    for s, capacity, df, _ in packing.pack_all(documents, table(spark, d, "pack_specs")):
        placed = df.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.count_distinct("token_from").alias("starts"), F.sum("n_tokens").alias("got"), F.max(F.col("token_from") + F.col("n_tokens")).alias("last"))
        placed = whole.join(placed, "doc_id", "left")
        kept = F.coalesce((F.col("got") == F.col("n_tokens")) & (F.col("last") == F.col("n_tokens")) & (F.col("starts") == F.col("pieces")), F.lit(False))
        docs = placed.agg(F.count("pieces").alias("documents"), F.lit(0).cast("long").alias("over_full"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= capacity)).alias("split_whole"), F.count_if(~kept).alias("gaps"))
        none = F.lit(0).cast("long")
        full = df.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("over_full")).withColumns({"documents": none, "split_whole": none, "gaps": none})
        both = docs.unionByName(full).agg(*(F.sum(c).alias(c) for c in ("documents", "over_full", "split_whole", "gaps")))
        out.append(both.select(F.lit(s).alias("spec_id"), F.lit(capacity).alias("capacity_tokens"), "documents", "over_full", "split_whole", "gaps"))
    return reduce(DataFrame.unionByName, out)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).where("kind = 'quoted'").select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "bench_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(*(table(spark, d, t) for t in ("documents", "subject_labels", "subjects")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """subject, documents, sentences: the corpus by area."""
    found = subjects.area_sentences(*(table(spark, d, t) for t in ("documents", "subject_labels", "subjects"))).where(F.col("n_sentences") >= subjects.NEEDED)
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("n_sentences").alias("sentences"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p7_assign, p7_unused, p7_invariants, p8_found, p8_report, p9_found, p9_shares)}


def oracle_sql() -> dict[str, str]:
    """SQL can state what must hold of the packing; tests hold the others against brute force, round trips and held-out labels."""
    return {"p7_invariants": "SELECT spec_id, capacity_tokens, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS over_full, 0::BIGINT AS split_whole, 0::BIGINT AS gaps FROM pack_specs"}
