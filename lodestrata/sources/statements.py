"""Upsert statements of log files: rendering a row, splitting a file, reading a statement back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_INSERT = re.compile(r"^\s*INSERT\s+INTO\s+(\w+)\s*\(([^)]*)\)\s*VALUES\s*\(", re.I)
_QUIET = frozenset(("VACUUM", "BEGIN", "COMMIT", "PRAGMA"))
_CONFLICT = re.compile(r"\bON\s+CONFLICT\s*\(([^)]*)\)", re.I)


def quote(v: object) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


def render(table: str, keys: list[str], row: dict[str, object]) -> str:
    """One statement: insert, or replace unless the stored row is newer."""
    cols = list(row)
    rest = ", ".join(f"{c}=excluded.{c}" for c in cols if c not in keys and c != "created_at")
    return f"INSERT INTO {table} ({', '.join(cols)}) VALUES ({', '.join(quote(v) for v in row.values())}) ON CONFLICT({', '.join(keys)}) DO UPDATE SET {rest} WHERE excluded.updated_at >= {table}.updated_at;"


def rendered(rows: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """statement: render() of every row, in generated code."""
    numbers = {c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    text = lambda c: F.col(c).cast("string")
    shown = [F.coalesce(text(c) if c in numbers else F.concat(F.lit("'"), F.replace(text(c), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")) for c in rows.columns]
    rest = ", ".join(f"{c}=excluded.{c}" for c in rows.columns if c not in keys and c != "created_at")
    tail = f") ON CONFLICT({', '.join(keys)}) DO UPDATE SET {rest} WHERE excluded.updated_at >= {table}.updated_at;"
    return rows.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(rows.columns)}) VALUES ("), F.concat_ws(", ", *shown), F.lit(tail)).alias("statement"))


def split(text: str) -> list[str]:
    """Statements of a file; semicolons and newlines inside quotes belong to the text."""
    out, start, i, n = [], 0, 0, len(text)
    while i < n:
        ch = text[i]
        if ch == "'":
            i = text.find("'", i + 1)
            if i < 0:
                break
        elif ch == ";":
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    return [s for s in [*out, text[start:].strip()] if s]


def values(text: str) -> list[object]:
    """A value list up to its closing parenthesis: quoted texts, numbers, NULL."""
    out: list[object] = []
    i, n = 0, len(text)
    while i < n:
        ch = text[i]
        if ch == ")":
            break
        if ch in ", \t\r\n":
            i += 1
        elif ch == "'":
            part = []
            while True:
                end = text.find("'", i + 1)
                if end < 0:
                    raise ValueError("a quote never ends")
                part.append(text[i + 1 : end])
                i = end + 1
                if text[i : i + 1] != "'":
                    break
                part.append("'")
            out.append("".join(part))
        else:
            m = re.compile(r"[^,)\s]+").match(text, i)
            word = m[0]
            out.append(None if word.upper() == "NULL" else int(word) if re.fullmatch(r"-?\d+", word) else float(word))
            i = m.end()
    return out


def read(statement: str) -> dict[str, object] | None:
    """table, keys and row of an upsert; None if it is none."""
    m = _INSERT.match(statement)
    if not m:
        return None
    cols = [c.strip() for c in m[2].split(",")]
    got = values(statement[m.end() :])
    if len(got) != len(cols):
        return None
    key = _CONFLICT.search(statement)
    return {"table": m[1], "keys": [c.strip() for c in key[1].split(",")] if key else [], "row": dict(zip(cols, got, strict=True))}


LINES = "error string, log_file string, line_no int, table_name string, key_columns string, row_json string, updated_at string, deleted_at string, hash string, canonical_version int"


def read_log(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """Every statement below root (table/month.sql files) as changelog rows, and error: why a statement is none, else null.

    A statement that can't be read stops the import, as later ones may rest on it; strict=False keeps it as a row with its
    error and its text as row_json. Empty statements and VACUUM and transaction words are no rows. Files are split among tasks; one file is read by one task, as its statements have an order.
    """
    import json

    whole = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").load(root)
    rows = whole.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("log_file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f, text in zip(pdf["log_file"], pdf["value"], strict=True):
                for k, s in enumerate(split(text), 1):
                    if s.split(None, 1)[0].upper() in _QUIET:
                        continue
                    try:
                        got, why = read(s), "no upsert of as many values as columns"
                    except ValueError as e:
                        got, why = None, str(e)
                    if got is None and strict:
                        raise ValueError(f"{f}, statement {k}: {why}")
                    if got is None:
                        out.append((why, f, k, None, None, s, None, None, None, None))
                    else:
                        r = got["row"]
                        body = {c: v for c, v in r.items() if c not in ("updated_at", "deleted_at", "hash", "canonical_version")}
                        out.append((None, f, k, got["table"], ",".join(got["keys"]), json.dumps(body, ensure_ascii=False), r.get("updated_at"), r.get("deleted_at"), r.get("hash"), r.get("canonical_version")))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    return rows.mapInPandas(run, LINES)
