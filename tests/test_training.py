"""Problems 1 to 6 against brute force over whole tables, and over planted edge cases."""

import pytest

from lodestrata import queries_training as q
from lodestrata.operators import changefeed, hierarchy, history, orphans, schema_drift, widen
from lodestrata.runtime import table
from tests import brute

INPUTS = {
    "p1": ("frontmatter", "files"), "p2": ("ticket_history", "tickets"),
    "p3": ("decision_refs", "tickets", "decisions", "links", "files"), "p4": ("tickets", "changelog"),
    "p5": ("tickets",), "p6": ("frontmatter", "wide_spec"),
}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(INPUTS))
def test_found_matches_brute_force(spark, name, sf):
    d = f"/root/testdata/{sf}"
    got = [tuple(r) for r in q.queries()[f"{name}_found"](spark, d).collect()]
    want = getattr(brute, name)(*(table(spark, d, t).toPandas() for t in INPUTS[name]))
    assert len(got) == len(set(got))
    assert set(got) == want


@pytest.mark.parametrize("name", sorted(INPUTS))
def test_empty_tables_give_empty_results(spark, small, name):
    empty = [table(spark, small, t) for t in INPUTS[name]]
    empty = [t if n == "wide_spec" else t.limit(0) for n, t in zip(INPUTS[name], empty)]
    run = {
        "p1": lambda *a: schema_drift.drift_cases(schema_drift.drift_scripts(*a)), "p2": history.history_cases,
        "p3": orphans.orphan_references, "p4": lambda *a: changefeed.current_rows(spark, *a),
        "p5": hierarchy.hierarchy, "p6": lambda *a: widen.filled_cells(widen.wide_rows(*a)),
    }
    assert run[name](*empty).collect() == []


@pytest.mark.parametrize("name", sorted(INPUTS))
def test_nulls_in_every_column_and_clashing_extras_do_not_crash(spark, small, name):
    from pyspark.sql import functions as F

    frames = []
    for t in INPUTS[name]:
        df = table(spark, small, t)
        if t != "wide_spec":
            holes = df.limit(3).select(*(F.lit(None).cast(x.dataType).alias(x.name) for x in df.schema))
            df = df.unionByName(holes).withColumn("value", F.lit(1)).withColumn("period", F.lit("x")).withColumn("n", F.lit(0)).withColumn("_k", F.lit(0))
        frames.append(df)
    run = {
        "p1": lambda *a: schema_drift.drift_cases(schema_drift.drift_scripts(*a)), "p2": history.history_cases,
        "p3": lambda *a: orphans.orphan_references(*a).drop("period"), "p4": lambda *a: changefeed.current_rows(spark, *a),
        "p5": lambda *a: hierarchy.hierarchy(*a).select("record_id", "root_record_id", "depth"), "p6": lambda *a: widen.filled_cells(widen.wide_rows(*a)),
    }
    want = {tuple(r) for r in q.queries()[f"{name}_found"](spark, small).collect()}
    got = {tuple(r) for r in run[name](*frames).collect()}
    assert {r for r in got if None not in r} == want


def test_edit_script_costs_and_moves():
    s = schema_drift.edit_script
    old = {("a",): "string", ("o",): "object", ("o", "x"): "number"}
    new = {("b",): "string", ("o",): "list", ("x",): "number"}
    ops = {(x["op"], x["old"], x["new"]) for x in s(old, new, {(("a",), ("b",))})}
    assert ops == {("rename", ("a",), ("b",)), ("retype", ("o",), ("o",)), ("move", ("o", "x"), ("x",))}
    ops = {(x["op"], x["old"], x["new"]) for x in s({("a",): "string", ("b",): "string"}, {("c",): "string", ("d",): "string"}, {(("a",), ("c",)), (("b",), ("c",)), (("b",), ("d",))})}
    assert ops == {("rename", ("a",), ("c",)), ("rename", ("b",), ("d",))}


def test_evidenced_pairs_come_in_order_whatever_their_number():
    """60 by 60 open pairs: name order decides exactly."""
    old, new = {(f"a{i:02d}",): "string" for i in range(60)}, {(f"b{i:02d}",): "string" for i in range(60)}
    got = schema_drift.edit_script(old, new, {(o, n) for o in old for n in new})
    assert {(x["old"], x["new"]) for x in got} == {((f"a{i:02d}",), (f"b{i:02d}",)) for i in range(60)}


def test_matching_is_the_best_of_all():
    import random
    from itertools import permutations

    draw = random.Random(4)
    for _ in range(200):
        n, m = draw.randint(1, 4), draw.randint(1, 4)
        gain = {(i, j): draw.choice([1, 2, 3, 2**70, 2**70 + 1]) for i in range(n) for j in range(m) if draw.random() < 0.6}
        got = schema_drift.best_matching(gain)
        assert len(set(got.values())) == len(got) and all(ij in gain for ij in got.items())
        wide = [*range(m), *[None] * n]
        best = max(sum(gain.get((i, j), 0) for i, j in enumerate(p[:n])) for p in permutations(wide, n))
        assert sum(gain[ij] for ij in got.items()) == best


def test_scripts_rename_and_move_within_objects():
    s = schema_drift.edit_script
    old = {("o",): "object", ("o", "a"): "string", ("o", "b"): "number", ("o", "b", "c"): "bool"}
    new = {("p",): "object", ("p", "z"): "string", ("p", "b"): "number", ("b",): "number", ("b", "c"): "bool"}
    ops = {(x["op"], x["old"], x["new"]) for x in s(old, new, {(("o",), ("p",)), (("o", "a"), ("p", "z"))})}
    assert ops == {("rename", ("o",), ("p",)), ("rename", ("o", "a"), ("p", "z")), ("move", ("o", "b", "c"), ("b", "c")), ("add", None, ("b",))}
    ops = {(x["op"], x["old"], x["new"]) for x in s({("o",): "object", ("o", "b"): "object", ("o", "b", "c"): "bool"}, {("o",): "object", ("b",): "object", ("b", "c"): "bool"}, set())}
    assert ops == {("move", ("o", "b"), ("b",))}  # its member goes along


def test_projection_applies_renames_at_every_level_and_moves(spark):
    files = spark.createDataFrame([(f"f/{m}.md", t) for m, t in (("one", 1_700_000_000), ("two", 1_704_000_000), ("three", 1_707_000_000))], "path string, ctime long")
    fm = spark.createDataFrame(
        [("f/one.md", "origin", "object", '{"by":"x","rev":1,"at":"2024"}'), ("f/two.md", "source", "object", '{"who":"x","rev":2}'), ("f/two.md", "at", "string", '"2024"'), ("f/three.md", "source", "object", '{"who":"y","rev":"3"}'), ("f/three.md", "at", "string", '"2025"')],
        "path string, key string, type string, value_json string",
    )
    s = schema_drift.SEP
    scripts = spark.createDataFrame(
        [("f", "2023-12", "rename", "source", "origin", "object", "object", 1.0), ("f", "2023-12", "rename", f"source{s}who", f"origin{s}by", "string", "string", 1.0), ("f", "2023-12", "move", "at", f"origin{s}at", "string", "string", 1.0)],
        schema_drift.SCRIPT_SCHEMA,
    )
    rows = schema_drift.consistent_rows(fm, files, scripts)
    assert {(r.source_key, r.field_key) for r in rows.where("path = 'f/one.md'").collect()} == {("origin", "source"), (f"origin{s}by", f"source{s}who"), (f"origin{s}rev", f"source{s}rev"), (f"origin{s}at", "at")}
    table = {r.path: r.fields for r in schema_drift.consistent_table(rows).collect()}
    assert table["f/one.md"] == {"source.who": "x", "source.rev": "1", "at": "2024"} and set(table) == {"f/one.md", "f/two.md", "f/three.md"}


def test_history_runs_cross_words_and_slices(spark):
    rows = [("t", "f", None if i % 150 == 149 else f"v{i // 70}", f"v{(i + 1) // 70}", f"2024-01-{1 + i // 100:02d} 00:{i % 100 // 2:02d}:{i % 2 * 30:02d}", None) for i in range(400)]
    h = spark.createDataFrame(rows, "ticket_record_id string, field string, old_value string, new_value string, changed_at string, deleted_at string")
    t = spark.createDataFrame([("t", "2023-12-31 00:00:00", "x")], "record_id string, created_at string, updated_at string")
    want = brute.p2(h.toPandas(), t.toPandas())
    for width in (history.DAY_MS, history.DAY_MS * 1000, 60_000):
        got = history.validity_periods(h, t, width)
        got = {(r.entity, r.attr, r.value) for r in got.collect()}
        assert len(got) == len({v for v in got})
    assert {tuple(r) for r in history.history_cases(h, t).collect()} == want


def test_hierarchy_contracts_over_many_partitions(spark):
    deep = [(f"n{i}", f"N{i - 1} " if i else None) for i in range(150)]
    ring = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [("under", "r7"), ("self", "self")]
    wide = [(f"w{i}", "n149") for i in range(50)] + [("lost", "nobody")]
    df = spark.createDataFrame([(a, b, "task", None, "1", "h") for a, b in deep + ring + wide], "record_id string, parent_record_id string, type string, deleted_at string, updated_at string, hash string")
    want = brute.p5(df.toPandas())
    for rows, base in ((10_000, 20_000), (40, 20)):
        got = hierarchy.with_paths(hierarchy.hierarchy(df, rows, base))
        assert {(r.record_id, r.root_record_id, r.depth) for r in got.collect()} == want
        assert all(r.path is None or len(r.path) == r.depth + 1 for r in got.collect())


def test_contraction_is_linear_in_a_chain():
    """200,000 links in one partition, shuffled: exits and distances, no path."""
    import random
    import tracemalloc

    import pandas as pd

    ids = list(range(1, 200_001))
    random.Random(1).shuffle(ids)
    pdf = pd.DataFrame({"id": [f"n{i}" for i in ids], "parent": [f"n{i - 1}" for i in ids], "weight": 1})
    tracemalloc.start()
    got = pd.concat(list(hierarchy._contract(iter([pdf]))))
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert len(got) == 200_000 and set(got["exit"]) == {"n1"} and set(got["parent"]) == {"n0"}
    assert all(int(i[1:]) == d + 1 for i, d in zip(got["id"], got["distance"]))


def test_a_level_leaves_few_enough_links(spark):
    """A chain over several partitions: the quotient is smaller by a fixed factor, and levels follow until base_rows."""
    links = spark.range(1, 4001).selectExpr("concat('n', id) AS id", "concat('n', id - 1) AS parent", "1L AS weight")
    steps = hierarchy._placed(links, 8, 10_000, 0).mapInPandas(hierarchy._contract, hierarchy._STEP)
    assert steps.where("id = exit").count() < 0.78 * 4000
    got = hierarchy._solve(links, 10_000, 100)
    assert {(r.id, r.root, r.depth) for r in got.collect()} == {(f"n{i}", "n0", i) for i in range(1, 4001)}


def test_a_levels_size_is_that_of_its_rows(spark, monkeypatch):
    """Estimates that multiply from level to level take digits without end, and then the driver's heap."""
    sizes, placed = [], hierarchy._placed

    def noted(links, *rest):
        sizes.append(int(links._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return placed(links, *rest)

    monkeypatch.setattr(hierarchy, "_placed", noted)
    links = spark.range(1, 2001).selectExpr("concat('n', id) AS id", "concat('n', id - 1) AS parent", "1L AS weight")
    got = hierarchy._solve(links, 10_000, 500)
    assert len(sizes) > 2 and max(sizes) < 1e7
    assert {(r.id, r.root, r.depth) for r in got.collect()} == {(f"n{i}", "n0", i) for i in range(1, 2001)}


def test_hierarchy_of_bushy_trees_and_hot_parents(spark, monkeypatch):
    import random

    draw = random.Random(5)
    rows = [(f"n{i}", f"n{draw.randrange(max(0, i - 60), i)}" if i % 50 else None) for i in range(1, 400)] + [(f"h{i}", "n7") for i in range(60)] + [(f"k{i}", f"h{i}") for i in range(60)] + [("r1", "r2"), ("r2", "r1"), ("r3", "r1"), ("r4", "r3"), ("r5", "r4")]
    df = spark.createDataFrame([(a, b, "task", None, "1", "h") for a, b in rows], "record_id string, parent_record_id string, type string, deleted_at string, updated_at string, hash string")
    want = brute.p5(df.toPandas())
    for hot in ([], ["n7", "N7", "r1", "R1"]):
        monkeypatch.setattr(hierarchy, "_hot", lambda children, hot=hot: hot)
        assert {(r.record_id, r.root_record_id, r.depth) for r in hierarchy.hierarchy(df, 60, 40).collect()} == want


def test_merge_store_is_independent_of_batches(spark, small):
    t, c = table(spark, small, "tickets"), table(spark, small, "changelog")
    a = {tuple(r) for r in changefeed.rebuild(spark, t, c, batches=1).current().collect()}
    b = {tuple(r) for r in changefeed.rebuild(spark, t, c, batches=9).current().collect()}
    assert a == b


def _versions(spark, rows):
    return spark.createDataFrame([("t", k, (at, "", i), gone, f"h{i}", "{}") for i, (k, at, gone) in enumerate(rows)], changefeed.VERSION)


def test_reading_the_store_needs_no_exchange(spark, small):
    store = changefeed.rebuild(spark, table(spark, small, "tickets"), table(spark, small, "changelog"))
    store.append(_versions(spark, [("x", "9", None)]))
    assert len(store.runs) > 1
    assert "Exchange" not in store.merged()._jdf.queryExecution().executedPlan().toString()


def test_a_restart_finds_the_store(spark):
    from lodestrata.runtime import scratch

    path = scratch(spark, "restart")
    first = changefeed.MergeStore(spark, path, buckets=3)
    first.append(_versions(spark, [("a", "1", None), ("b", "1", None)]))
    first.append(_versions(spark, [("a", "2", "2"), ("b", "0", "x"), (None, "1", None)]))
    spark.sql(f"DROP TABLE {first._table}")  # a new session's catalogue is empty
    again = changefeed.MergeStore(spark, path, buckets=5)
    assert again.buckets == 3 and {r.row_key for r in again.current().collect()} == {"b"}
    again.append(_versions(spark, [("a", "3", None)]))
    assert {r.row_key for r in again.current().collect()} == {"a", "b"}
    with pytest.raises(RuntimeError):
        first.append(_versions(spark, [("c", "1", None)]))


def test_readers_outlive_a_compaction(spark):
    from lodestrata.runtime import scratch

    store = changefeed.MergeStore(spark, scratch(spark, "readers"), fan_in=3, buckets=2)
    store.append(_versions(spark, [("a", "1", None)]))
    store.append(_versions(spark, [("b", "1", None)]))
    reader = store.current()
    store.append(_versions(spark, [("a", "2", "2")]))
    assert len(store.runs) == 1
    assert {r.row_key for r in reader.collect()} == {"a", "b"}
    assert {r.row_key for r in store.current().collect()} == {"b"}


def test_a_run_without_a_manifest_counts_for_nothing(spark):
    from lodestrata.runtime import scratch

    path = scratch(spark, "torn")
    store = changefeed.MergeStore(spark, path, buckets=2)
    store.append(_versions(spark, [("a", "1", None)]))
    store._commit = lambda runs: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.append(_versions(spark, [("b", "1", None)]))
    again = changefeed.MergeStore(spark, path)
    assert {r.row_key for r in again.current().collect()} == {"a"}
    again.append(_versions(spark, [("c", "1", None)]))
    assert {r.row_key for r in again.current().collect()} == {"a", "c"}
