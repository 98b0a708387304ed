"""Filling fixed-capacity containers with items (problem 7).

Length-histogram planning: the driver sees how many items there are of each token length (at most capacity + 1 numbers),
runs best-fit-decreasing over those counts and keeps the outcome as ranges of slots: items number r of length n, for r in
[rank_from, rank_to), go `per` to a container from container_from on. An item then finds its slot by its rank within its
length, so the plan's size depends on the capacity alone and no text is moved.

Ranks come in two steps (within a block of items of one length, plus the block's offset), so a length that holds a third of
all items is not ranked by one task. Items above the capacity are cut into full pieces, which fill a container each, and a
rest. Null and empty texts have zero tokens and lie in container 0. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # fixed value: the public pre-tokenisation pattern that belongs to this vocabulary
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    if not text:
        return 0
    return len(_encoding(path).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8")))


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of every document's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [count_tokens(t, tokenizer) for t in pdf["text"]]})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long")


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, rank_from, rank_to, container_from, per) ranges and the number of containers.

    Exactly best-fit-decreasing of the single items: the tightest open container that fits takes the next item, and as it
    only becomes tighter it also takes the following ones of that length. Containers of equal history stay together as one
    interval of numbers, and an operation ends a length or uses up an interval, so there are O(capacity) ranges.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened = 0

    def put(residual: int, start: int, count: int) -> None:
        if count > 0:
            if residual not in free:
                free[residual] = []
                insort(sizes, residual)
            free[residual].append((start, count))

    for length in sorted((n for n in counts if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left > 0:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                room = sizes[at]
                start, count = free[room].pop()
                if not free[room]:
                    del free[room]
                    sizes.pop(at)
            else:
                room, start = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            per = room // length
            full = min(count, left // per)
            if full:
                plan.append((length, rank, rank + full * per, start, per))
                put(room - per * length, start, full)
                rank, left = rank + full * per, left - full * per
            rest = 0
            if full < count and left > 0:
                rest = 1
                plan.append((length, rank, rank + left, start + full, left))
                put(room - left * length, start + full, 1)
                left = 0
            put(room, start + full + rest, count - full - rest)
    if counts.get(0):
        opened = max(opened, 1)
        plan.append((0, 0, counts[0], 0, counts[0]))
    return plan, opened


def _items(lengths: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, token_from, n_tokens: whole texts, or the pieces of a text above the capacity."""
    pieces = F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int"), F.lit(1))
    out = lengths.select("doc_id", F.col("n_tokens").alias("whole"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return out.select("doc_id", "piece", start.alias("token_from"), F.least(F.col("whole") - start, F.lit(capacity)).cast("int").alias("n_tokens"))


def _ranked(items: DataFrame, blocks: int) -> DataFrame:
    """Adds rank, 0-based and dense within each length."""
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    sizes = items.groupBy("n_tokens", "block").agg(F.count("*").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("n_tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("n_tokens", "block", F.coalesce(offset, F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("n_tokens", "block").orderBy("doc_id", "piece")) - 1
    return items.withColumn("inner", inner).join(sizes, ["n_tokens", "block"]).withColumn("rank", F.col("inner") + F.col("offset")).drop("block", "inner", "offset")


def pack(lengths: DataFrame, capacity: int, block_rows: int = 250_000) -> tuple[DataFrame, dict[str, int]]:
    """(doc_id, piece, token_from, n_tokens, container_id; containers and tokens in all) of one capacity."""
    if capacity < 1:
        raise ValueError("a container must hold at least one token")
    items = _items(lengths, capacity)
    counts = {r["n_tokens"]: r["count"] for r in items.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    plan, containers = best_fit_plan(counts, capacity)
    plan.sort()
    keys = np.array([(p[0] << 44) + p[1] for p in plan], dtype=np.int64)
    first, base, per = (np.array([p[i] for p in plan], dtype=np.int64) for i in (1, 3, 4))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank = pdf["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, (pdf["n_tokens"].to_numpy(np.int64) << 44) + rank, "right") - 1
            pdf["container_id"] = base[at] + (rank - first[at]) // per[at]
            yield pdf.drop(columns="rank")

    blocks = max(1, -(-sum(counts.values()) // block_rows))
    placed = _ranked(items, blocks).select("doc_id", "piece", "token_from", "n_tokens", "rank")
    out = placed.mapInPandas(slots, "doc_id long, piece int, token_from long, n_tokens int, container_id long")
    return out, {"containers": containers, "tokens": sum(n * c for n, c in counts.items())}


def pack_all(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER) -> list[tuple[int, int, DataFrame, dict[str, int]]]:
    """pack() for every container size of the fixed specs table; texts are tokenised once."""
    lengths = cut(token_lengths(documents, tokenizer))
    wanted = specs.select("spec_id", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("spec_id").collect()
    return [(r["spec_id"], r["capacity_tokens"], *pack(lengths, r["capacity_tokens"])) for r in wanted]
