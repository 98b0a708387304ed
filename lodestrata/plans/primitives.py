"""Named queries over a vault. Each is one declarative plan; limits are pushed into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqlite import glob_regex, like
from ..vault import Vault, base_name, note_name
from .links import inlinks, resolved


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df.limit(limit) if limit else df


def files(v: Vault, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """path, name, size, mtime by path; pattern is a GLOB in which * crosses slashes."""
    df = v.files if pattern is None else v.files.where(F.col("path").rlike(glob_regex(pattern)))
    return _limited(df.select("path", note_name(F.col("path"), any_case=False).alias("name"), "size", "mtime").orderBy("path"), limit)


def tag_histogram(v: Vault, min_count: int = 0, sort: str = "tag", limit: int | None = None) -> DataFrame:
    """tag, count; sort is tag, or count (descending, then tag)."""
    if sort not in ("tag", "count"):
        raise ValueError(f"invalid sort {sort!r} (want tag|count)")
    df = v.tags.groupBy("tag").agg(F.count("*").alias("count"))
    df = df.where(F.col("count") >= min_count) if min_count else df
    return _limited(df.orderBy("tag") if sort == "tag" else df.orderBy(F.desc("count"), "tag"), limit)


def _address_forms(path: str) -> list[str]:
    bare = path[:-3] if path.endswith(".md") else path
    return [f for f in dict.fromkeys((path, bare, bare.rsplit("/", 1)[-1])) if f]


def backlinks(v: Vault, path: str, limit: int | None = None) -> DataFrame:
    """source_path, line, link_type of links spelled as path, path without .md, or name, each with or without an anchor.

    Anchored spellings compare as LIKE does: ASCII case-insensitively and with _ and % as wildcards.
    """
    if not path:
        raise ValueError("a path is needed")
    hit = F.lit(False)
    for f in _address_forms(path):
        hit = hit | (F.col("target_path") == f) | like(F.col("target_path"), F.lit(f"{f}#%"))
    df = v.links.where((F.col("source_path") != path) & hit).select("source_path", "line", "link_type")
    return _limited(df.orderBy("source_path", "line"), limit)


def backlink_counts(v: Vault) -> DataFrame:
    """path, backlinks: for every file at once, by an equi-join on the spellings; anchors are cut, the LIKE quirks left out."""
    path = F.col("path")
    bare = F.regexp_replace(path, r"\.md$", "")
    forms = v.files.select("path").distinct().select("path", F.explode(F.array_distinct(F.array(path, bare, base_name(bare)))).alias("key"))
    keys = v.links.select("source_path", F.substring_index("target_path", "#", 1).alias("key")).groupBy("key", "source_path").agg(F.count("*").alias("n"))
    return keys.join(forms, "key").where("source_path <> path").groupBy("path").agg(F.sum("n").alias("backlinks"))


def outlinks(v: Vault, path: str, limit: int | None = None) -> DataFrame:
    df = v.links.where(F.col("source_path") == path).select("target_path", "alias", "line", "link_type")
    return _limited(df.orderBy("line", "target_path"), limit)


def schema_profile(v: Vault, sort: str = "key", limit: int | None = None) -> DataFrame:
    """key, types (sorted, distinct), count of every frontmatter key."""
    if sort not in ("key", "count"):
        raise ValueError(f"invalid sort {sort!r} (want key|count)")
    df = v.frontmatter.groupBy("key").agg(F.sort_array(F.collect_set("type")).alias("types"), F.count("*").alias("count"))
    return _limited(df.orderBy("key") if sort == "key" else df.orderBy(F.desc("count"), "key"), limit)


def meta(v: Vault, path: str) -> DataFrame:
    """section, item (JSON) of everything about one file: file, frontmatter, tags, outlinks, inlinks, headings; no row if unknown.

    A row per item instead of one nested row: a note may hold any share of all links.
    """
    one = v.files.where(F.col("path") == path)
    part = lambda df, key, *fields: df.where(F.col(key) == path).join(one.select(F.col("path").alias(key)).distinct(), key, "left_semi").select(F.to_json(F.struct(*fields)).alias("item"))
    came = inlinks(one, v.links).select("path", "source_path").distinct()
    parts = {
        "file": one.withColumn("name", note_name(F.col("path"), any_case=False)).select(F.to_json(F.struct("name", *v.files.columns)).alias("item")),
        "frontmatter": part(v.frontmatter, "path", "key", "type", "value_json"), "tags": part(v.tags, "path", "tag"),
        "outlinks": part(v.links, "source_path", "line", "target_path", "alias", "link_type"), "inlinks": part(came, "path", "source_path"),
        "headings": part(v.headings, "path", "line_offset", "depth", "text"),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("section"), "item")
        out = df if out is None else out.unionByName(df)
    return out


def meta_counts(v: Vault) -> DataFrame:
    """path, name, n_keys, n_tags, n_outlinks, n_inlinks, n_headings of every file: meta over the whole vault.

    n_inlinks counts links (a bag): they are counted by target first, as a base name may be shared by many files and links.
    """
    count = lambda df, key, name: df.groupBy(F.col(key).alias("path")).agg(F.count("*").alias(name))
    out = v.files.select("path", note_name(F.col("path"), any_case=False).alias("name"))
    by_target = v.links.groupBy("target_path").agg(F.count("*").alias("n"))
    came = resolved(v.files, by_target).join(by_target, "target_path").groupBy("path").agg(F.sum("n").alias("n_inlinks"))
    for part in (count(v.frontmatter, "path", "n_keys"), count(v.tags, "path", "n_tags"), count(v.links, "source_path", "n_outlinks"), came, count(v.headings, "path", "n_headings")):
        out = out.join(part, "path", "left")
    return out.fillna(0, ["n_keys", "n_tags", "n_outlinks", "n_inlinks", "n_headings"])


def table_counts(v: Vault) -> DataFrame:
    """relation, rows."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("relation"), "rows") for n, df in vars(v).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_per(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
