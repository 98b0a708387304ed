"""The append-only planning log: replay, history, export, and its statement form."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import statements


def replay(versions: DataFrame, keys: list[str], order: list[str], created: str = "created_at") -> DataFrame:
    """The row of each key after applying all versions in order, later ones winning unless their updated_at is less.

    created is kept from the first version. One aggregation: the winner is the maximum of (updated_at, order), which partial
    aggregation computes on the map side; nulls in updated_at sort below all texts.
    """
    rest = [c for c in versions.columns if c not in keys and c != created]
    place = F.struct(*(F.col(c) for c in order))
    last = F.max_by(F.struct(*rest), F.struct(F.coalesce("updated_at", F.lit("")), place))
    out = versions.groupBy(*keys).agg(last.alias("_v"), F.min_by(created, place).alias(created))
    return out.select(*keys, "_v.*", created)


def first_of_each_hash(history: DataFrame, order: list[str]) -> DataFrame:
    """History rows are never replaced: of rows with one hash the first in order stays."""
    rest = [c for c in history.columns if c != "hash"]
    return history.where("hash IS NOT NULL").groupBy("hash").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select("hash", "_v.*").select(*history.columns)


def export(rows: DataFrame, table_name: str, since: str, already: DataFrame | None = None) -> DataFrame:
    """Rows updated at or after a marker as log lines: log_file (table/month.sql), line_no, hash and the row as JSON.

    Lines run by updated_at, then hash; a row whose hash `already` (log_file, hash) holds in that file isn't written again.
    Numbering is within a month's file, the unit that a log file is anyway.
    """
    lines = rows.where(F.col("updated_at") >= since).distinct()
    lines = lines.select(F.concat(F.lit(f"{table_name}/"), F.substring("updated_at", 1, 7), F.lit(".sql")).alias("log_file"), "updated_at", "hash", F.to_json(F.struct(*[c for c in rows.columns if c not in ("updated_at", "hash")])).alias("row_json"))
    if already is not None:
        lines = lines.join(already.select("log_file", "hash").distinct(), ["log_file", "hash"], "left_anti")
    n = F.row_number().over(Window.partitionBy("log_file").orderBy("updated_at", "hash"))
    return lines.select("log_file", n.alias("line_no"), "updated_at", "hash", "row_json")


def marker_refused(versions: DataFrame, known: int) -> DataFrame:
    """Lines of a canonical version other than the one this engine writes."""
    return versions.where(~F.col("canonical_version").eqNullSafe(F.lit(known)))


def upgraded(lines: DataFrame, version: int) -> DataFrame:
    """Log lines (changelog columns) re-emitted in the current format: exact repeats within a file dropped, numbered anew in their order.

    Versions stay in the file they lie in; only canonical_version and line_no change.
    """
    cols = [c for c in lines.columns if c not in ("line_no", "canonical_version")]
    kept = lines.where("log_file IS NOT NULL").groupBy(*cols).agg(F.min("line_no").alias("_first"))
    n = F.row_number().over(Window.partitionBy("log_file").orderBy("_first", "hash", "row_json"))
    return kept.select(*cols, n.alias("line_no"), F.lit(version).alias("canonical_version"))


def append_log(lines: DataFrame, root: str, table_name: str, keys: list[str]) -> DataFrame:
    """Writes exported lines as statements to root/table/month.sql; log_file, written, skipped per file.

    root is a folder that all executors share. A file is written by one task, which streams over its lines, leaves out
    those that the file has byte for byte, and swaps the longer file in whole; a task that runs again finds its own lines there.
    """
    placed = lines.select("log_file", "updated_at", "hash", "row_json").repartition("log_file").sortWithinPartitions("log_file", "updated_at", "hash")

    def one(path: str, found: Iterator[str]) -> tuple[int, int]:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        written = skipped = 0
        seen: set[bytes] = set()
        mark = lambda x: hashlib.blake2b(x, digest_size=16).digest()
        with open(f"{path}.part", "wb") as out:
            if os.path.exists(path):
                with open(path, "rb") as old:
                    for x in old:
                        out.write(x)
                        seen.add(mark(x))
            for text in found:
                x = text.encode() + b"\n"
                if mark(x) in seen:
                    skipped += 1
                else:
                    seen.add(mark(x))
                    out.write(x)
                    written += 1
        os.replace(f"{path}.part", path)
        return written, skipped

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((r.log_file, statements.render(table_name, keys, {**json.loads(r.row_json), "updated_at": r.updated_at, "hash": r.hash})) for pdf in batches for r in pdf.itertuples(index=False))
        held = next(rows, None)
        while held:
            name = held[0]

            def same() -> Iterator[str]:
                nonlocal held
                while held and held[0] == name:
                    yield held[1]
                    held = next(rows, None)

            w, s = one(f"{root}/{name}", same())
            yield pd.DataFrame({"log_file": [name], "written": [w], "skipped": [s]})

    return placed.mapInPandas(run, "log_file string, written long, skipped long")
