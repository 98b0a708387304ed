"""Packing: an exact round trip, the plan against best-fit-decreasing of single items, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import packing, queries
from lodestrata.runtime import table
from tests import oracle


def naive_best_fit(lengths, capacity):
    """Containers of best-fit-decreasing, item by item."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 200])
    lengths = [rng.choice([rng.randint(1, capacity), max(1, capacity // 3), 1]) for _ in range(rng.randrange(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, containers = packing.best_fit_plan(counts, capacity)
    used = [0] * containers
    for n, a, b, base, per in plan:
        for r in range(a, b):
            used[base + (r - a) // per] += n
    assert sorted(capacity - u for u in used) == naive_best_fit(lengths, capacity)
    assert len(plan) <= 3 * capacity + 3
    for n, c in counts.items():
        spans = sorted((a, b) for m, a, b, _, _ in plan if m == n)
        assert spans[0][0] == 0 and spans[-1][1] == c and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_plan_does_not_grow_with_the_items():
    counts = {n: 10**9 + n for n in range(1, 513)}
    plan, _ = packing.best_fit_plan(counts, 512)
    assert len(plan) < 2000


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_document_is_packed_whole_and_fits(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = table(spark, d, "documents")
    lengths = {r.doc_id: packing.count_tokens(r.text) for r in docs.collect()}
    sizes = {r.spec_id: r.capacity_tokens for r in table(spark, d, "pack_specs").collect()}
    got = queries.p7_assign(spark, d).collect()
    for s, capacity in sizes.items():
        rows = [r for r in got if r.spec_id == s]
        pieces, used = {}, {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append((r.token_from, r.n_tokens))
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        assert max(used.values()) <= capacity and set(used) == set(range(len(used)))
        for doc, n in lengths.items():
            at = 0
            for start, size in sorted(pieces[doc]):
                assert start == at
                at += size
            assert at == n and (len(pieces[doc]) == 1 or n > capacity)
        assert sum(used.values()) == sum(lengths.values())
    unused = {r.spec_id: r.unused_share for r in queries.p7_unused(spark, d).collect()}
    assert unused[1] < (0.1 if sf == "sf0.001" else 0.02)


def test_ranks_are_dense_over_blocks(spark):
    items = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_from"), F.when(F.col("id") < 700, 5).otherwise(F.col("id") % 7).cast("int").alias("n_tokens"))
    got = packing._ranked(items, 13).groupBy("n_tokens").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.max("rank").alias("m"), F.min("rank").alias("l")).collect()
    assert all(r.n == r.d == r.m + 1 and r.l == 0 for r in got)


def test_edge_cases(spark):
    lengths = spark.createDataFrame([(1, 0), (2, 0), (3, 25), (4, 10), (5, 10)], "doc_id long, n_tokens long")
    out, said = packing.pack(lengths, 10)
    rows = sorted((r.doc_id, r.piece, r.token_from, r.n_tokens) for r in out.collect())
    assert rows == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 10), (3, 1, 10, 10), (3, 2, 20, 5), (4, 0, 0, 10), (5, 0, 0, 10)]
    assert said == {"containers": 5, "tokens": 45}
    empty, said = packing.pack(lengths.limit(0), 10)
    assert empty.collect() == [] and said["containers"] == 0
    only, said = packing.pack(lengths.where("n_tokens = 0"), 10)
    assert [r.container_id for r in only.collect()] == [0, 0] and said["containers"] == 1
    with pytest.raises(ValueError, match="at least one"):
        packing.pack(lengths, 0)
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "a b", 9), (4, "word " * 50_000, 9)], "doc_id long, text string, n_tokens long")
    assert {r.doc_id: r.n_tokens for r in packing.token_lengths(docs).collect()}[4] > 50_000 - 5


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_invariants_equal_their_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert oracle.difference(spark, "p7_invariants", d, queries.p7_invariants, queries.oracle_sql()["p7_invariants"]) is None


def test_invariants_see_a_wrong_assignment(spark, monkeypatch):
    whole = packing.pack_all

    def spoilt(*a):
        return [(s, c, df.withColumn("container_id", F.lit(0).cast("long")).where("doc_id % 2 = 0"), x) for s, c, df, x in whole(*a)]

    monkeypatch.setattr(packing, "pack_all", spoilt)
    for r in queries.p7_invariants(spark, "/root/testdata/sf0.001").collect():
        assert r.over_full == 1 and r.gaps > 0
