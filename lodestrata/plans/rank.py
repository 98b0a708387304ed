"""Ranking files against a target or a text with five structural signals, all candidates at once.

Candidates are written once. Raw signals are grouped joins; the target's values are counted before joining, so bags keep
their multiplicities without being multiplied out. Each signal is divided by its largest absolute value over the candidates (0 if that is 0), weighted and
summed. Equal scores are ordered by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqlite import like, lower_ascii
from ..runtime import cut, salted_join
from ..vault import Vault
from .links import inlinks, names, resolved
from .primitives import top_per

# fixed values: the weight of each signal in each profile
SIGNALS = ("link_overlap", "tag_overlap", "path_proximity", "recency", "centrality")
WEIGHTS = {
    "default": (0.30, 0.25, 0.20, 0.10, 0.15),
    "related": (0.35, 0.25, 0.20, 0.05, 0.15),
    "search": (0.10, 0.15, 0.10, 0.25, 0.40),
    "context": (0.30, 0.15, 0.25, 0.05, 0.25),
}
DECAY_HOURS = 2160


def overlap(bag: DataFrame, owner: str, value: str, target: str, name: str) -> DataFrame:
    """path, name: how many pairs of rows of target and of path share a value (a bag count).

    target's values are counted first, so a row of the bag meets at most one; a value that very many rows share is spread.
    """
    rows = bag.select(F.col(owner).alias("path"), F.col(value).alias("v")).where("v IS NOT NULL")
    own = rows.where(F.col("path") == target).groupBy("v").agg(F.count("*").alias("m"))
    return salted_join(rows.where(F.col("path") != target), own, ["v"], ["path"]).groupBy("path").agg(F.sum("m").cast("double").alias(name))


def _directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def proximity(path: Column, target: str) -> Column:
    """Shared leading directory components over the longer directory; 1 in the same directory."""
    a, b = F.split(_directory(path), "/"), F.split(_directory(F.lit(target)), "/")
    differ = F.array_position(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].eqNullSafe(p["b"])), F.lit(False))
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(differ == 0, F.lit(1.0)).otherwise((differ - 1).cast("double") / longest)


def recency(mtime: Column, now: int) -> Column:
    """1 now, falling to 0 over 90 days, for seconds since 1970."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.lit(now) - mtime) / 3600.0 / DECAY_HOURS))


def centrality(v: Vault, candidates: DataFrame) -> DataFrame:
    """path, centrality: distinct notes linking to a candidate under its path or its path without .md."""
    spelled = F.explode(F.array_distinct(F.array(F.col("path"), F.regexp_replace("path", r"\.md$", "")))).alias("target_path")
    forms = candidates.select("path").distinct().select("path", spelled)
    edges = salted_join(v.links.select("source_path", "target_path").distinct(), forms, ["target_path"], ["source_path"]).select("path", "source_path").distinct()
    return edges.groupBy("path").agg(F.count("*").cast("double").alias("centrality"))


def raw_signals(v: Vault, candidates: DataFrame, now: int, target: str | None) -> DataFrame:
    """candidates (path, distinct) with one column per signal. They are written once, as several signals start from them."""
    candidates = cut(candidates)
    df = candidates.join(v.files.groupBy("path").agg(F.max("mtime").alias("mtime")), "path", "left").join(centrality(v, candidates), "path", "left")
    if target is None:
        df = df.withColumns({n: F.lit(0.0) for n in SIGNALS[:3]})
    else:
        df = df.join(overlap(v.links, "source_path", "target_path", target, "link_overlap"), "path", "left")
        df = df.join(overlap(v.tags, "path", "tag", target, "tag_overlap"), "path", "left")
        df = df.withColumn("path_proximity", proximity(F.col("path"), target))
    df = df.withColumn("recency", F.coalesce(recency(F.col("mtime"), now), F.lit(0.0)))
    return df.select("path", *(F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in SIGNALS))


def ranked(raw: DataFrame, profile: str = "default", limit: int | None = 10) -> DataFrame:
    """path, score, signals (name, raw, normalized, weight, weighted), best first.

    The signals are written once; one aggregate over them gives the five maxima, which are then constants of the plan.
    """
    raw = cut(raw)
    peaks = raw.agg(*(F.max(F.abs(n)).alias(n) for n in SIGNALS)).first()
    parts = []
    for n, w in sorted(zip(SIGNALS, WEIGHTS[profile], strict=True)):
        normal = F.col(n) / F.lit(peaks[n]) if peaks[n] else F.lit(0.0)
        parts.append(F.struct(F.lit(n).alias("name"), F.col(n).alias("raw"), normal.alias("normalized"), F.lit(w).alias("weight"), (normal * w).alias("weighted")))
    score = sum((p["weighted"] for p in parts[1:]), parts[0]["weighted"])
    out = raw.select("path", score.alias("score"), F.array(*parts).alias("signals")).orderBy(F.desc("score"), "path")
    return out.limit(limit) if limit else out


def _linking(v: Vault, target: str) -> DataFrame:
    hit = names(F.col("target_path"), target) if not v.files.where(F.col("path") == target).isEmpty() else F.lit(False)
    return v.links.where(hit).select(F.col("source_path").alias("path"))


def _tag_mates(v: Vault, target: str) -> DataFrame:
    own = v.tags.where(F.col("path") == target).select("tag")
    return v.tags.join(own, "tag", "left_semi").select("path")


def related_candidates(v: Vault, target: str) -> DataFrame:
    """What links to target, shares a tag, or lies below its folder (everything, for a note at the top)."""
    folder = target[: target.rfind("/") + 1]
    below = v.files.where(like(F.col("path"), F.lit(f"{folder}%"))).select("path")
    return _linking(v, target).unionByName(_tag_mates(v, target)).unionByName(below).where(F.col("path") != target).distinct()


def context_candidates(v: Vault, target: str) -> DataFrame:
    """What links to target, what it links to (resolved to files, anchors cut), what shares a tag."""
    sent = v.links.where((F.col("source_path") == target) & ~like(F.col("target_path"), F.lit("http%")))
    sent = sent.select("source_path", F.substring_index("target_path", "#", 1).alias("target_path")).where("target_path <> ''")
    return _linking(v, target).unionByName(resolved(v.files, sent).select("path")).unionByName(_tag_mates(v, target)).where(F.col("path") != target).distinct()


def search_candidates(v: Vault, text: str) -> DataFrame:
    """Files whose path, tag, frontmatter text or heading contains text (ASCII case-insensitive; % and _ are wildcards)."""
    hit = lambda c: like(lower_ascii(F.col(c)), F.lit(f"%{text}%"))
    parts = (v.files.where(hit("path")), v.tags.where(hit("tag")), v.frontmatter.where(hit("value_text")), v.headings.where(hit("text")))
    out = parts[0].select("path")
    for p in parts[1:]:
        out = out.unionByName(p.select("path"))
    return out.distinct()


def related(v: Vault, target: str, now: int, limit: int | None = 10) -> DataFrame:
    return ranked(raw_signals(v, related_candidates(v, target), now, target), "related", limit)


def context(v: Vault, target: str, now: int, limit: int | None = 10) -> DataFrame:
    return ranked(raw_signals(v, context_candidates(v, target), now, target), "context", limit)


def search(v: Vault, text: str, now: int, limit: int | None = 10) -> DataFrame:
    return ranked(raw_signals(v, search_candidates(v, text), now, None), "search", limit)


def flat(v: Vault, path: str) -> DataFrame:
    """Every other file, by path."""
    return v.files.select("path").where(F.col("path") != path).distinct().orderBy("path")


MAX_ASKED = 1000


def neighbours(v: Vault, results: DataFrame, n: int = 5) -> DataFrame:
    """path, relation (outlink, inlink, sibling), neighbour: at most n of each per path, siblings by shared tags, else by name.

    results has the paths wanted, a ranked result of at most MAX_ASKED paths (more are refused): each is a query against all
    rows, so that the work stays linear in the vault, however popular a tag is.
    """
    asked = cut(results.select("path").distinct().limit(MAX_ASKED + 1))
    if asked.count() > MAX_ASKED:
        raise ValueError(f"neighbours are shown for at most {MAX_ASKED} paths")
    out = v.links.where(~like(F.col("target_path"), F.lit("http%"))).select(F.col("source_path").alias("path"), F.col("target_path").alias("neighbour")).join(asked, "path", "left_semi").distinct()
    came = inlinks(v.files.join(asked, "path", "left_semi"), v.links).where("path <> source_path").select("path", F.col("source_path").alias("neighbour")).distinct()
    mine = v.tags.join(asked, "path", "left_semi").select("path", "tag")
    mates = mine.join(v.tags.select(F.col("path").alias("neighbour"), "tag"), "tag").where("path <> neighbour").groupBy("path", "neighbour").agg(F.count("*").alias("shared"))
    every = out.select("path", F.lit("outlink").alias("relation"), "neighbour", F.lit(0).cast("bigint").alias("shared"))
    every = every.unionByName(came.select("path", F.lit("inlink").alias("relation"), "neighbour", F.lit(0).cast("bigint").alias("shared")))
    every = every.unionByName(mates.select("path", F.lit("sibling").alias("relation"), "neighbour", "shared"))
    return top_per(every, ["path", "relation"], [F.desc("shared"), "neighbour"], n).drop("shared")


def quality(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """ndcg, mrr, precision at k of ranked results (case, rank from 1, path) against relevant (case, path), per case.

    Both sides go into one aggregation by case and path, then by case; a case without anything relevant has no row.
    """
    both = results.select("case", "path", F.col("rank").cast("long").alias("rank"), F.lit(0).alias("rel")).unionByName(relevant.select("case", "path", F.lit(None).cast("long").alias("rank"), F.lit(1).alias("rel")))
    each = both.groupBy("case", "path").agg(F.min("rank").alias("rank"), F.max("rel").alias("rel")).where("rel = 1")
    at = F.when(F.col("rank") <= k, F.col("rank"))
    df = each.groupBy("case").agg(F.count("*").alias("wanted"), F.coalesce(F.sum(1 / F.log2(at + 1.0)), F.lit(0.0)).alias("dcg"), F.min(at).alias("first"), F.count(at).alias("n"))
    ideal = F.expr(f"aggregate(sequence(1, cast(least(wanted, {k}) as int)), 0D, (s, i) -> s + 1 / log2(i + 1.0))")
    return df.select("case", (F.col("dcg") / ideal).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("n") / k).alias("precision"))
