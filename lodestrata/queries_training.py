"""Queries p1 to p6: the general training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changefeed, hierarchy, history, orphans, schema_drift, widen
from .runtime import table


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift_cases(schema_drift.drift_scripts(*_t(spark, d, "frontmatter", "files")))


def p1_script(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift_scripts(*_t(spark, d, "frontmatter", "files"))


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    fm, files = _t(spark, d, "frontmatter", "files")
    return schema_drift.consistent_rows(fm, files, schema_drift.drift_scripts(fm, files))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(p1_consistent(spark, d)).withColumn("fields", F.coalesce(F.to_json("fields"), F.lit("{}")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.history_cases(*_t(spark, d, "ticket_history", "tickets"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """to_ms is -1 where the value still holds."""
    return history.validity_periods(*_t(spark, d, "ticket_history", "tickets")).withColumn("to_ms", F.coalesce("to_ms", F.lit(-1).cast("bigint")))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*_t(spark, d, "decision_refs", "tickets", "decisions", "links", "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("period")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_rows(spark, *_t(spark, d, "tickets", "changelog"))


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.rebuild(spark, *_t(spark, d, "tickets", "changelog")).merged().select("table_name", "row_key", "deleted_at", "hash", "row_json")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(*_t(spark, d, "tickets")).select("record_id", "root_record_id", "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.with_paths(hierarchy.hierarchy(*_t(spark, d, "tickets"))).select("record_id", "type", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(*_t(spark, d, "tickets")))


def p5_rings(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.rings(hierarchy.hierarchy(*_t(spark, d, "tickets")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.filled_cells(widen.wide_rows(*_t(spark, d, "frontmatter", "wide_spec"), every=False))


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    fm, spec = _t(spark, d, "frontmatter", "wide_spec")
    wide = widen.typed_wide(widen.wide_rows(fm, spec), spec)
    shown = {"boolean": lambda c: c.cast("string"), "date": lambda c: c.cast("string"), "array<string>": lambda c: F.array_join(c, ",")}  # as text, so that engines compare alike
    return wide.select(*(shown.get(t, lambda c: c)(F.col(f"`{n}`")).alias(n) for n, t in wide.dtypes))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_script, p1_consistent, p1_table, p2_found, p2_values, p3_found, p3_report, p4_found, p4_state, p5_found, p5_paths, p5_descendants, p5_rings, p6_found, p6_wide)}
