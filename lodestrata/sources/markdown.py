"""Markdown notes to relations: one pass over each note yields its frontmatter, tags, links and headings.

Lines and offsets count from the start of the body, after the frontmatter. Notes whose frontmatter can't be read are kept
with their body and an error (strict=True raises instead). Null and empty notes have no rows.
"""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..vault import Vault

_OPEN = re.compile(r"^---(?:\r?\n|\Z)")
_CLOSE = re.compile(r"^---[ \t\r]*$", re.M)
_TAG_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_/-]*")


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """(frontmatter or None, body). It opens at the very start; without a closing line all is body."""
    m = _OPEN.match(text)
    if not m:
        return None, text
    end = _CLOSE.search(text, m.end())
    if not end:
        return None, text
    after = text[end.end() :]
    return text[m.end() : end.start()].replace("\r\n", "\n"), after[1:] if after.startswith("\n") else after


def _loader():  # noqa: ANN202
    """A loader with the 1.2 core scalars plus timestamps: yes, no, on and off are text, 1:30 is text, duplicate keys are an error."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {}
    add = lambda tag, pattern, first: Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))
    add("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF")
    add("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""])
    add("timestamp", r"^\d{4}-\d\d?-\d\d?(?:(?:[Tt]|[ \t]+)\d\d?:\d\d:\d\d(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d\d?(?::\d\d)?))?)?$", "0123456789")
    add("int", r"^[-+]?(?:0|[1-9][0-9_]*|0o?[0-7]+|0x[0-9a-fA-F]+|0b[01]+)$", "-+0123456789")
    add("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$", "-+0123456789.")

    def integer(loader, node) -> int:  # noqa: ANN001
        s = loader.construct_scalar(node).replace("_", "")
        sign, s = (-1 if s[0] == "-" else 1), s.lstrip("+-")
        base = 16 if s[:2] == "0x" else 2 if s[:2] == "0b" else 8 if s[:1] == "0" and len(s) > 1 else 10
        return sign * int(s[2:] if s[:2] in ("0x", "0b", "0o") else s, base)

    def mapping(loader, node) -> dict:  # noqa: ANN001
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len({str(k) for k in keys}) < len(keys):
            raise yaml.constructor.ConstructorError(None, None, "a key occurs twice", node.start_mark)
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

    Loader.add_constructor("tag:yaml.org,2002:int", integer)
    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return Loader


def _stamp(v: datetime.date) -> str:
    if isinstance(v, datetime.datetime):
        text = v.isoformat().replace("+00:00", "Z")
        return text if v.tzinfo else f"{text}Z"
    return f"{v.isoformat()}T00:00:00Z"


def _jsonable(v: object) -> object:
    if isinstance(v, datetime.date):
        return _stamp(v)
    if isinstance(v, dict):
        return {str(k): _jsonable(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_jsonable(x) for x in v]
    if isinstance(v, float) and v == math.floor(v) and abs(v) < 1e21:
        return int(v)
    return v


def canonical_json(v: object) -> str:
    """Sorted keys, no blanks, <, > and & escaped."""
    text = json.dumps(_jsonable(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


def typed_values(front: str | None) -> tuple[list[dict], dict]:
    """Rows (key, type, value_json, value_text, value_num) of a frontmatter text and its parsed map; raises ValueError if unreadable."""
    import yaml

    try:
        doc = yaml.load(front or "", Loader=_loader())  # noqa: S506 - a subclass of the safe loader
    except (yaml.YAMLError, ValueError) as e:
        raise ValueError(str(e).split("\n")[0]) from e
    if not isinstance(doc, dict):
        return [], {}
    rows = []
    for k, v in doc.items():
        if v is None:
            continue
        text = num = None
        if isinstance(v, bool):
            kind, num = "bool", float(v)
        elif isinstance(v, (int, float)):
            kind, num = "number", float(v)
        elif isinstance(v, (str, datetime.date)):
            kind, text = "string", v if isinstance(v, str) else _stamp(v)
        else:
            kind = "list" if isinstance(v, list) else "object"
        rows.append({"key": str(k), "type": kind, "value_json": canonical_json(v), "value_text": text, "value_num": num})
    return rows, doc


def _fence(line: str) -> str:
    """The run of three or more backticks or tildes that a line begins with, after any blanks."""
    text = line.lstrip(" \t")
    run = len(text) - len(text.lstrip(text[:1])) if text[:1] in ("`", "~") else 0
    return text[:run] if run > 2 else ""


def open_lines(body: str) -> list[tuple[int, int, str]]:
    """(line from 1, offset, text) of the lines outside fences. A fence closes with its own character, at least as long."""
    out, fence, offset = [], "", 0
    for n, raw in enumerate(body.split("\n"), 1):
        line = raw[:-1] if raw.endswith("\r") else raw
        mark = _fence(line)
        if fence:
            if mark.startswith(fence):
                fence = ""
        elif mark:
            fence = mark
        else:
            out.append((n, offset, line))
        offset += len(line.encode("utf-8", "replace")) + 1
    return out


def inline_tags(line: str) -> list[str]:
    """Names of the hashtags that begin a word of a line: a letter, then letters, digits, _, - and /."""
    if "#" not in line:
        return []
    words = line.replace("\t", " ").replace("\f", " ").replace("\v", " ").replace("\r", " ").split(" ")
    return [m[0] for w in words if w[:1] == "#" and (m := _TAG_NAME.match(w, 1))]


def wiki_links(line: str) -> list[tuple[bool, str]]:
    """(embedded, inner text) of every [[...]] of a line; the text is not empty and has no closing bracket."""
    out, at = [], line.find("[[")
    while at >= 0:
        end = line.find("]", at + 2)
        if end < 0:
            break
        if end > at + 2 and line.startswith("]]", end):
            out.append((line[at - 1 : at] == "!", line[at + 2 : end]))
            at = line.find("[[", end + 2)
        else:
            at = line.find("[[", at + 1)
    return out


def inline_links(line: str) -> list[tuple[str, str]]:
    """(label, target) of every [label](target) of a line, images included; the target is not empty."""
    out, at, close = [], line.find("["), -1
    while at >= 0:
        if close <= at:
            close = line.find("]", at + 1)
        if close < 0:
            break
        end = line.find(")", close + 2) if line.startswith("](", close) else -1
        if end > close + 2:
            out.append((line[at + 1 : close], line[close + 2 : end]))
            at = line.find("[", end + 1)
        else:
            at = line.find("[", at + 1)
    return out


def heading(line: str) -> tuple[int, str] | None:
    """(depth, text) of a line of one to six # and a blank; closing # are not part of the text."""
    depth = len(line) - len(line.lstrip("#"))
    if not 1 <= depth <= 6 or not line[depth : depth + 1].isspace() or not line[depth:].strip():
        return None
    return depth, line[depth:].strip().rstrip("#").rstrip()


def slug(text: Column) -> Column:
    """Lower case; ASCII letters, digits and _ stay, runs of blanks and hyphens become one hyphen, all else goes."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_ -]", ""), "[ -]+", "-")
    return F.regexp_replace(kept, "^-|-$", "")


def heading_anchors(notes: DataFrame) -> DataFrame:
    """path, level, text, slug of the headings with an anchor of notes (path, content); null contents have none.

    A slug that came before in the note gets -1, -2 and so on. What lies between two lines that begin with three backticks,
    or after the last such line without a partner, is cut out first; the rest is read with expressions alone.
    """
    fence = r"(?md)^[^\S\n]*```.*\n?(?:[\s\S]*?^[^\S\n]*```.*$|[\s\S]*)"
    found = F.posexplode(F.regexp_extract_all(F.regexp_replace("content", fence, ""), F.lit(r"(?md)^#{1,6}[ \t].*$"), 0)).alias("at", "line")
    rest = F.regexp_replace(F.regexp_replace("line", "^#+", ""), r"^\s+|\s+$", "")
    rows = notes.select("path", found).select("path", "at", F.length(F.regexp_extract("line", "^#+", 0)).alias("level"), F.regexp_replace(rest, r"[# \t]+$", "").alias("text"))
    rows = rows.withColumn("base", slug(F.col("text"))).where("base <> ''")
    n = F.row_number().over(Window.partitionBy("path", "base").orderBy("at")) - 1
    return rows.withColumn("n", n).select("path", "level", "text", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))).alias("slug"))


def _front_tags(doc: dict) -> list[str]:
    out = []
    for key in ("tags", "tag"):
        v = doc.get(key)
        for item in re.split(r"[ ,;]+", v) if isinstance(v, str) else v if isinstance(v, list) else []:
            t = str(item).strip().removeprefix("#") if item is not None and not isinstance(item, (dict, list)) else ""
            if t:
                out.append(t)
    return out


def extract(text: str | None) -> dict:
    """All relations of one note."""
    out = {"frontmatter": [], "tags": [], "links": [], "headings": [], "error": None}
    if not text:
        return out
    front, body = split_frontmatter(text)
    doc: dict = {}
    try:
        out["frontmatter"], doc = typed_values(front)
    except ValueError as e:
        out["error"] = str(e)
    tags = set(_front_tags(doc))
    for n, offset, line in open_lines(body):
        tags.update(inline_tags(line))
        for embedded, inner in wiki_links(line):
            target, _, alias = inner.partition("|")
            out["links"].append({"target_path": target.strip(), "alias": alias.strip() or None, "link_type": "embed" if embedded else "wiki", "line": n})
        for label, target in inline_links(line):
            out["links"].append({"target_path": target.strip(), "alias": label or target.strip(), "link_type": "md", "line": n})
        if h := heading(line):
            out["headings"].append({"depth": h[0], "text": h[1], "line_offset": offset})
    out["tags"] = sorted(tags)
    return out


NOTE = (
    "path string, frontmatter array<struct<key:string,type:string,value_json:string,value_text:string,value_num:double>>, tags array<string>, "
    "links array<struct<target_path:string,alias:string,link_type:string,line:int>>, headings array<struct<depth:int,text:string,line_offset:int>>, error string"
)


def extracted(notes: DataFrame, strict: bool = False) -> DataFrame:
    """One row per note (path, content) with all its relations nested."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [extract(t if isinstance(t, str) or t is None else bytes(t).decode("utf-8", "replace")) for t in pdf["content"]]
            if strict and (bad := next((i for i, g in enumerate(got) if g["error"]), None)) is not None:
                raise ValueError(f"{pdf['path'].iloc[bad]}: {got[bad]['error']}")
            yield pd.DataFrame({"path": pdf["path"], **{k: [g[k] for g in got] for k in ("frontmatter", "tags", "links", "headings", "error")}})

    return notes.select("path", "content").mapInPandas(run, NOTE)


def relations(files: DataFrame, notes: DataFrame) -> Vault:
    """A vault from files and extracted notes (persist or write the notes first if several relations are read)."""
    part = lambda name: notes.select("path", F.explode(name).alias("x")).select("path", "x.*")
    return Vault(
        files, part("frontmatter"), notes.select("path", F.explode("tags").alias("tag")),
        part("links").withColumnRenamed("path", "source_path"), part("headings"),
    )


_GLOB = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def _class(text: str) -> str:
    """A glob's character class as a pattern's; it never matches a slash."""
    inside = text[1:-1]
    negated = inside[0] in "!^"
    inside = re.sub(r"([\\\[\]&^])", r"\\\1", inside[1:] if negated else inside)
    return f"[^/{inside}]" if negated else f"[{inside}]"


def _ignored(rules: list[str]) -> list[tuple[bool, re.Pattern]]:
    """gitignore lines as (re-include, regex) in order; the last match decides."""
    out = []
    for raw in rules:
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = (True, line[1:]) if line.startswith("!") else (False, line)
        anchored, below, line = "/" in line.rstrip("/"), line.endswith("/"), line.lstrip("/")
        parts = re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[!^]?\]?[^\]/]*\]|[^*?/\[]+|/|\[", line.rstrip("/"))
        body = "".join(_GLOB.get(t) or (_class(t) if len(t) > 2 and t[0] == "[" else re.escape(t)) for t in parts)
        # a rule that ends in a slash names a folder: it needs something below it
        out.append((keep, re.compile(rf"^(?:{'' if anchored else '(?:.*/)?'}{body})(?:/.*){'' if below else '?'}$")))
    return out


def scan_changed(spark: SparkSession, root: str, stored: DataFrame, excludes: tuple[str, ...] = (), ignore_lines: tuple[str, ...] = ()) -> DataFrame:
    """path, mtime, size, content, content_hash of a scan, contents being read only where stored (path, mtime, content_hash) has another mtime.

    The listing reads no content (the column is pruned); an unchanged file has null content and its stored hash. root is a
    folder that all executors see under the same path; a file that is gone by the time it is read has neither.
    """
    base = root.rstrip("/").removeprefix("file:")
    seen = scan(spark, root, excludes, ignore_lines).select("path", "mtime", "size")
    known = stored.select("path", F.col("mtime").alias("_m"), F.col("content_hash").alias("_h"))
    todo = seen.join(known, "path", "left").select("path", "mtime", "size", F.when(F.col("_m").eqNullSafe(F.col("mtime")), F.col("_h")).alias("content_hash"), F.col("_m").eqNullSafe(F.col("mtime")).alias("same"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for p, same in zip(pdf["path"], pdf["same"], strict=True):
                try:
                    got.append(None if same else Path(base, p).read_bytes())
                except FileNotFoundError:
                    got.append(None)
            yield pd.DataFrame({"path": pdf["path"], "mtime": pdf["mtime"], "size": pdf["size"], "content": got, "content_hash": pdf["content_hash"]})

    read = todo.mapInPandas(run, "path string, mtime long, size long, content binary, content_hash string")
    return read.withColumn("content_hash", F.coalesce("content_hash", F.sha2("content", 256)))


def scan(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), ignore_lines: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), mtime, size, content of the .md files (any case); contents of ignored files are never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), rf"^(?:file:)?/*{re.escape(base.lstrip('/'))}", "")
    df = df.select(path.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    rules = _ignored([".git", *excludes, *ignore_lines])
    drop = F.lit(False)
    for keep, pattern in rules:
        drop = F.when(F.col("path").rlike(pattern.pattern), F.lit(not keep)).otherwise(drop)
    return df.where(~drop)
