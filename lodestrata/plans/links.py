"""Which file a link's raw target names, as equi-joins.

A target T names path P if P = T, or P = T || '.md', or P LIKE '%/' || T || '.md'. Each file is expanded into the spellings
it answers to; a LIKE has two quirks that the expansion keeps: it ignores ASCII case, so that spelling is folded, and _ in
a target stands for any character. Targets with _ are matched against suffixes of their length that share the first or last
three characters (whichever has no _), and only those pairs are compared. A % in a target is taken literally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqlite import like, lower_ascii
from ..runtime import salted_join


def _suffixes(path: Column) -> Column:
    """Proper /-suffixes of a path that ends in .md, without it, folded."""
    bare = lower_ascii(F.regexp_replace(path, r"(?i)\.md$", ""))
    parts = F.split(bare, "/")
    spelled = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return F.when(path.rlike(r"(?i)\.md$") & (F.size(parts) > 1), spelled)


def spellings(files: DataFrame) -> DataFrame:
    """path, form ('e' exact, 's' folded suffix), key."""
    exact = F.array(F.col("path"), F.when(F.col("path").endswith(".md"), F.regexp_replace("path", r"\.md$", "")))
    forms = F.array_compact(F.concat(
        F.transform(exact, lambda k: F.when(k.isNotNull(), F.struct(F.lit("e").alias("form"), k.alias("key")))),
        F.coalesce(F.transform(_suffixes(F.col("path")), lambda k: F.struct(F.lit("s").alias("form"), k.alias("key"))), F.array()),
    ))
    return files.select("path").distinct().select("path", F.explode(forms).alias("f")).select("path", "f.form", "f.key")


def _block(key: Column, pattern: Column) -> Column:
    """Length plus the three leading or trailing characters that the pattern spells out."""
    lead, tail, n = F.substring(pattern, 1, 3), F.substring(pattern, -3, 3), F.length(pattern).cast("string")
    free = lambda c: ~F.contains(c, F.lit("_"))
    return F.when(free(lead), F.concat(n, F.lit(":a:"), F.substring(key, 1, 3))).when(free(tail), F.concat(n, F.lit(":z:"), F.substring(key, -3, 3))).otherwise(F.concat(n, F.lit(":")))


def resolved(files: DataFrame, links: DataFrame) -> DataFrame:
    """path, target_path: every pair of a file and a distinct raw target that names it."""
    keys = spellings(files)
    targets = links.where("target_path IS NOT NULL").select("target_path").distinct()
    folded = lower_ascii(F.col("target_path"))
    plain = targets.select("target_path", F.explode(F.array(
        F.struct(F.lit("e").alias("form"), F.col("target_path").alias("key")),
        F.struct(F.lit("s").alias("form"), folded.alias("key")),
    )).alias("f")).select("target_path", "f.form", "f.key")
    hits = plain.join(keys, ["form", "key"]).select("path", "target_path")
    wild = targets.where(F.contains("target_path", F.lit("_"))).withColumn("pattern", folded).withColumn("block", _block(F.col("pattern"), F.col("pattern")))
    n = F.length("key").cast("string")
    blocks = F.array(F.concat(n, F.lit(":a:"), F.substring("key", 1, 3)), F.concat(n, F.lit(":z:"), F.substring("key", -3, 3)), F.concat(n, F.lit(":")))
    ends = keys.where("form = 's'").select("path", "key", F.explode(blocks).alias("block"))
    loose = wild.join(ends, "block").where(like(F.col("key"), F.col("pattern"))).select("path", "target_path")
    return hits.unionByName(loose).distinct()


def names(target: Column, path: str) -> Column:
    """Whether a raw target names this one path: resolved()'s rules as a filter, which needs no join."""
    exact = {path, path.removesuffix(".md")}
    parts = (path[:-3] if path[-3:].lower() == ".md" else "").split("/")
    ends = ["".join(c.lower() if c.isascii() else c for c in "/".join(parts[i:])) for i in range(1, len(parts))]
    hit = target.isin(*exact)
    if ends:
        folded = lower_ascii(target)
        hit = hit | folded.isin(*ends)
        for e in ends:
            hit = hit | (F.contains(target, F.lit("_")) & (F.length(folded) == len(e)) & like(F.lit(e), folded))
    return hit


def inlinks(files: DataFrame, links: DataFrame) -> DataFrame:
    """path, source_path of every link (a bag) that names path; the links of a hot target are spread."""
    return salted_join(links.select("source_path", "target_path"), resolved(files, links), ["target_path"], ["source_path"]).select("path", "source_path")
