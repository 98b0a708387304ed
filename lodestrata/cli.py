"""Command line over a folder of notes: python -m lodestrata.cli VERB [ARGUMENT] [options].

The folder is scanned and extracted into a session's relations; output is a JSON array, JSON lines, indented JSON or one line a
row. Exit codes: 0 (also for no rows), 64 usage, 65 a bad query, 66 an unknown path.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dsl import compiler
from .errors import QueryError
from .plans import index, primitives, rank
from .sources import base_view, markdown, sinks
from .vault import FILE_COLUMNS, Vault

DEFAULT_ROWS = 10_000  # of indented output, which is built in one piece
VERBS = ("query", "files", "tags", "backlinks", "outlinks", "meta", "schema", "base", "related", "context", "search", "counts")
_NEEDS_PATH = ("backlinks", "outlinks", "meta", "related", "context")


class UnknownPath(Exception):
    pass


def discover(flag: str | None = None, start: str | None = None) -> str:
    """The vault's root: the flag, LODESTRATA_VAULT, the nearest folder upwards with .obsidian or .git (in that order), or here."""
    if flag:
        return str(Path(flag).resolve())
    if os.environ.get("LODESTRATA_VAULT"):
        return str(Path(os.environ["LODESTRATA_VAULT"]).resolve())
    here = Path(start or os.getcwd()).resolve()
    for at in (here, *here.parents):
        for mark in (".obsidian", ".git"):
            if (at / mark).exists():
                return str(at)
    return str(here)


def load(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), ignore_files: tuple[str, ...] = (".gitignore",), strict: bool = False) -> Vault:
    """Scan and extract a folder; ignore files at its root are read in order."""
    lines = [x for f in ignore_files if (Path(root) / f).is_file() for x in (Path(root) / f).read_text().splitlines()]
    seen = markdown.scan(spark, root, excludes, tuple(lines)).withColumn("content_hash", index.content_hash()).persist()
    now = F.lit(int(time.time()))
    files = seen.select("path", "mtime", F.col("mtime").alias("ctime"), "size", "content_hash", now.alias("last_scanned"))
    return markdown.relations(files.select(*FILE_COLUMNS), markdown.extracted(seen, strict).persist())


def run(v: Vault, a: argparse.Namespace, root: str) -> DataFrame:
    """The rows of one verb."""
    what, limit = a.argument, a.limit
    if a.verb in _NEEDS_PATH and v.files.where(F.col("path") == what).isEmpty():
        raise UnknownPath(what)
    if a.verb == "query":
        return compiler.query(v, what, extended=a.extended)
    if a.verb == "base":
        found = dict(base_view.views_at(root))
        if not what:
            return v.files.sparkSession.createDataFrame(sorted(found.items()), "name string, path string")
        if what not in found:
            raise UnknownPath(what)
        return compiler.Compiler(v).plan(base_view.compile_view(Path(found[what]).read_text(), a.view))
    now = int(time.time())
    return {
        "files": lambda: primitives.files(v, what, limit), "tags": lambda: primitives.tag_histogram(v, a.min_count, a.sort or "tag", limit),
        "backlinks": lambda: primitives.backlinks(v, what, limit), "outlinks": lambda: primitives.outlinks(v, what, limit),
        "meta": lambda: primitives.meta(v, what), "schema": lambda: primitives.schema_profile(v, a.sort or "key", limit),
        "related": lambda: rank.flat(v, what) if a.flat else rank.related(v, what, now, limit or 10), "context": lambda: rank.context(v, what, now, limit or 10),
        "search": lambda: rank.search(v, what, now, limit or 10), "counts": lambda: primitives.table_counts(v),
    }[a.verb]()


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lodestrata", exit_on_error=False)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("argument", nargs="?")
    p.add_argument("--vault")
    p.add_argument("--file", help="read the query from a file")
    p.add_argument("--stdin", action="store_true")
    p.add_argument("--view")
    p.add_argument("--sort")
    p.add_argument("--fields")
    for flag in ("pretty", "jsonl", "oneline", "full", "flat", "extended", "strict"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--min-count", type=int, default=0)
    p.add_argument("--exclude", action="append", default=[])
    return p.parse_args(argv)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        a = arguments(argv)
        if sum(map(bool, (a.pretty, a.jsonl, a.oneline))) > 1 or (a.oneline and a.fields):
            raise ValueError("of --pretty, --jsonl and --oneline one can be chosen, and --oneline takes no --fields")
        if a.verb == "query":
            given = [x for x in (a.argument, a.file, a.stdin) if x]
            if len(given) != 1:
                raise ValueError("a query comes from exactly one of the argument, --file and --stdin")
            a.argument = a.argument or (Path(a.file).read_text() if a.file else sys.stdin.read())
        elif a.verb in (*_NEEDS_PATH, "search") and not a.argument:
            raise ValueError(f"{a.verb} needs an argument")
    except (argparse.ArgumentError, SystemExit, ValueError) as e:
        print(e, file=sys.stderr)
        return 64
    root = discover(a.vault)
    spark = spark or SparkSession.builder.appName("lodestrata").getOrCreate()
    try:
        df = run(load(spark, root, tuple(a.exclude), strict=a.strict), a, root)
        if a.verb in ("related", "context", "search") and not (a.full or a.flat):
            df = df.select("path", "score")
        df = sinks.chosen(df, a.fields.split(",")) if a.fields else df
        df = df.limit(a.limit) if a.limit else df
        if a.oneline or a.jsonl:
            for text in sinks.stream_text(sinks.one_line(df) if a.oneline else sinks.json_lines(df)):
                print(text)
        elif a.pretty:
            print(sinks.render(df, a.limit or DEFAULT_ROWS, a.pretty))
        else:
            sep = "["
            for text in sinks.stream_text(sinks.json_lines(df)):
                print(sep, text, sep="", end="")
                sep = ","
            print("[]" if sep == "[" else "]")
    except QueryError as e:
        print(e, file=sys.stderr)
        return 65
    except UnknownPath as e:
        print(f"not in the vault: {e}", file=sys.stderr)
        return 66
    except ValueError as e:
        print(e, file=sys.stderr)
        return 64
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
