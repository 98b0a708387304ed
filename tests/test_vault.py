"""Every registered query with SQL against DuckDB over whole tables, and vault operators on planted cases."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrata import oracles_training, queries_vault
from lodestrata.dsl import compiler
from lodestrata.plans import index, links, planning, planning_log, primitives, rank
from lodestrata.sources import base_view, sinks
from lodestrata.sources import markdown
from lodestrata.vault import FILES, FRONTMATTER, HEADINGS, LINKS, TAGS, Vault, vault
from tests import oracle
from tests.conftest import rows_of

QUERIES, SQL = queries_vault.queries(), queries_vault.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    assert oracle.difference(spark, name, small, QUERIES[name], SQL[name], duck) is None


def test_extraction_without_sql_equals_one_note_at_a_time(spark, small):
    """YAML is beyond SQL: the distributed rows against the notes read one by one."""
    assert set(QUERIES) - set(SQL) == {"extract_counts", "extract_tags", "extract_frontmatter"}
    notes = {r.path: markdown.extract(r.content) for r in queries_vault.document_notes(spark, small).collect()}
    got = {r.path: (r.n_frontmatter, r.n_tags, r.n_links, r.n_headings, r.readable) for r in queries_vault.extract_counts(spark, small).collect()}
    assert got == {p: (*(len(n[k]) for k in ("frontmatter", "tags", "links", "headings")), n["error"] is None) for p, n in notes.items()} and got
    tags = Counter(t for n in notes.values() for t in n["tags"])
    assert {r.tag: r.notes for r in queries_vault.extract_tags(spark, small).collect()} == tags and tags
    front = {(p, x["key"], x["type"], x["value_json"]) for p, n in notes.items() for x in n["frontmatter"]}
    assert {tuple(r)[:4] for r in queries_vault.extract_frontmatter(spark, small).collect()} == front and front


@pytest.mark.parametrize("name", sorted(oracles_training.oracle_sql()))
def test_training_query_equals_sql(spark, small, duck, name):
    assert oracle.difference(spark, name, small, entry.queries()[name], oracles_training.oracle_sql()[name], duck) is None


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _vault(spark, files=(), frontmatter=(), tags=(), link_rows=(), headings=()):
    return Vault(*(spark.createDataFrame(list(r), s) for r, s in ((files, FILES), (frontmatter, FRONTMATTER), (tags, TAGS), (link_rows, LINKS), (headings, HEADINGS))))


def _file(p, mtime=0):
    return (p, mtime, mtime, 1, "h", 0)


def test_empty_vault_gives_empty_results(spark):
    v = _vault(spark)
    for df in (primitives.files(v), primitives.tag_histogram(v), primitives.backlinks(v, "a.md"), primitives.outlinks(v, "a.md"), primitives.schema_profile(v), primitives.meta(v, "a.md"), rank.related(v, "a.md", 0), rank.context(v, "a.md", 0), rank.search(v, "x", 0), links.resolved(v.files, v.links), compiler.query(v, "SELECT * WHERE 'x' IN tags")):
        assert df.collect() == []


def test_vault_reads_rows_with_nulls(spark, small):
    v = vault(spark, small)
    hole = lambda df: df.unionByName(df.limit(2).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema)))
    w = Vault(hole(v.files), hole(v.frontmatter), hole(v.tags), hole(v.links), hole(v.headings))
    for q in ("SELECT path, name, folder, fm.type ORDER BY fm.type", "SELECT path WHERE 'x' IN inlinks OR 'depot' IN tags", "SELECT max(size)"):
        assert compiler.query(w, q).count() >= 1 or "inlinks" in q
    assert primitives.meta_counts(w).count() > 0
    assert rank.search(w, "a", 0).count() >= 0


def test_max_normalisation_without_signal_and_ties(spark):
    v = _vault(spark, [_file("a/x.md"), _file("a/y.md"), _file("b/z.md")])
    got = rank.related(v, "a/x.md", 10**9, None).collect()
    assert [(r.path, round(r.score, 6)) for r in got] == [("a/y.md", 0.2)]
    assert {s.name: s.raw for s in got[0].signals}["path_proximity"] == 1.0
    top = _vault(spark, [_file("x.md"), _file("b/y.md"), _file("c/d/z.md")])
    assert [r.path for r in rank.related(top, "x.md", 0, None).collect()] == ["b/y.md", "c/d/z.md"]


def test_overlap_is_a_bag_count(spark):
    rows = [("a", "t", None, "wiki", 1), ("a", "t", None, "wiki", 2), ("b", "t", None, "wiki", 1), ("b", "t", None, "wiki", 2), ("b", "t", None, "wiki", 3)]
    v = _vault(spark, link_rows=rows)
    assert rank.overlap(v.links, "source_path", "target_path", "a", "n").collect()[0].n == 6


def test_ranking_quality(spark):
    results = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("e", 1, "z")], "case string, rank int, path string")
    wanted = spark.createDataFrame([("q", "b"), ("q", "d"), ("e", "y")], "case string, path string")
    got = {r.case: (round(r.ndcg, 4), round(r.mrr, 4), round(r.precision, 4)) for r in rank.quality(results, wanted, 3).collect()}
    assert got == {"q": (0.3869, 0.5, 0.3333), "e": (0.0, 0.0, 0.0)}


def test_neighbours_are_capped_per_relation(spark):
    v = _vault(spark, [_file("a.md"), _file("b.md")], tags=[("a.md", "t"), ("b.md", "t"), ("c.md", "t")], link_rows=[("a.md", f"x{i}", None, "wiki", 1) for i in range(9)] + [("a.md", "HTTP://x", None, "md", 1), ("b.md", "a", None, "wiki", 1)])
    got = rank.neighbours(v, v.files.where("path = 'a.md'"), 2)
    assert rows_of(got) == sorted([("a.md", "outlink", "x0"), ("a.md", "outlink", "x1"), ("a.md", "inlink", "b.md"), ("a.md", "sibling", "b.md"), ("a.md", "sibling", "c.md")])


def test_views_compile(spark):
    v = _vault(spark, [_file("a.md"), _file("b.md")], [("a.md", "n", "number", "1", None, 1.0), ("a.md", "name", "string", '"A"', "A", None)], [("b.md", "t")])
    run = lambda text, view=None: [tuple(r) for r in compiler.Compiler(v).plan(base_view.compile_view(text, view)).collect()]
    assert run("filters: {or: ['note.n == 1', \"tags contains 't'\"]}\nviews: [{name: V, order: [path], sort: [{property: path, direction: DESC}]}]", "v") == [("b.md",), ("a.md",)]
    assert run("filters: {and: ['n > 0'], or: ['n > 5']}\nproperties: {note.name: {}}\nviews: [{name: V, order: [name]}]") == [("A",)]
    assert len(run("{}")[0]) == 6
    with pytest.raises(Exception, match="not found"):
        base_view.compile_view("views: [{name: V}]", "w")


def test_replay_equals_sequential_application(spark):
    import random

    rng = random.Random(3)
    rows = [(f"k{rng.randrange(7)}", f"{rng.randrange(5)}" if rng.random() > 0.1 else None, f"f{i // 50}", i % 50, f"c{i}", f"v{i}", None) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, updated_at string, log_file string, line_no int, created_at string, v string, deleted_at string")
    state = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        if r[0] not in state:
            state[r[0]] = list(r)
        elif (r[1] or "") >= (state[r[0]][1] or ""):
            state[r[0]] = [*r[:4], state[r[0]][4], *r[5:]]
    got = {r.k: (r.v, r.created_at) for r in planning_log.replay(df, ["k"], ["log_file", "line_no"]).collect()}
    assert got == {k: (s[5], s[4]) for k, s in state.items()}


def test_state_difference_and_upsert(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "id string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("n", "9")], "id string, hash string")
    assert rows_of(planning.state_difference(a, b, ["id"])) == [("y", "changed"), ("z", "missing")]
    assert rows_of(sinks.upsert(a, b, ["id"])) == sorted([("x", "1"), ("y", "3"), ("n", "9"), ("z", None)], key=lambda r: r[0])


def test_classification_of_a_scan(spark):
    stored = spark.createDataFrame([("same", 1, 1, 5, "h", 0), ("touch", 1, 1, 5, "h", 0), ("edit", 1, 1, 5, "h", 0), ("gone", 1, 1, 5, "h", 0), ("quiet", 1, 1, 5, "h", 0)], FILES)
    scan = spark.createDataFrame([("same", 1, 5, "h"), ("touch", 2, 5, "h"), ("edit", 2, 6, "i"), ("fresh", 2, 7, "j"), ("quiet", 1, 9, "zz")], "path string, mtime long, size long, content_hash string")
    acts = index.classify(stored, scan)
    assert {r.path: r.action for r in acts.collect()} == {"same": "unchanged", "touch": "touched", "edit": "changed", "gone": "removed", "fresh": "new", "quiet": "unchanged"}
    got = {r.path: tuple(r)[1:] for r in index.refreshed(stored, scan, 99).collect()}
    assert got == {"same": (1, 1, 5, "h", 0), "touch": (2, 1, 5, "h", 99), "edit": (2, 2, 6, "i", 99), "fresh": (2, 2, 7, "j", 99), "quiet": (1, 1, 5, "h", 0)}
    assert rows_of(index.pruned(stored.select("path"), acts)) == [("quiet",), ("same",), ("touch",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.90625, None)], "p string, s double, n int")
    assert sinks.one_line(df).first()[0] == "a\t0.9062\t"
    assert sinks.render(df, 5, lines=True) == '{"p":"a","s":0.90625,"n":null}'
    assert sinks.render(df.limit(0), 5) == "[]"
    assert sinks.chosen(df, ["s", "p", "s"]).columns == ["s", "p"]
    with pytest.raises(ValueError, match="have: p, s, n"):
        sinks.chosen(df, ["x"])
    with pytest.raises(ValueError, match="exclude"):
        sinks.render(df, 1, pretty=True, lines=True)
    at = str(tmp_path / "t")
    sinks.replace_table(spark, df, at)
    sinks.replace_table(spark, df.unionByName(df), at)
    assert spark.read.parquet(at).count() == 2


def _with_holes(df):
    """A row of nulls, every row twice, and columns that clash with names used inside."""
    holes = df.limit(1).select(*(F.lit(None).cast(x.dataType).alias(x.name) for x in df.schema))
    return df.unionByName(df).unionByName(holes).withColumns({c: F.lit("x") for c in ("_key", "path", "depth", "position", "n", "_decision")})


def test_planning_reads_take_nulls_repeats_and_clashing_columns(spark, small):
    from lodestrata.runtime import table

    t, dc = table(spark, small, "tickets"), table(spark, small, "decisions")
    idmap, labels, deps = (queries_vault._state(spark, small, n, f) for n, f in (("ticket_idmap", queries_vault._IDMAP), ("ticket_labels", queries_vault._LABELS), ("ticket_deps", queries_vault._DEPS)))
    one, deep = queries_vault._fullest(t), queries_vault._deepest(t)
    runs = (
        lambda t, dc: planning.ticket_list(t, idmap, leaf=True), lambda t, dc: planning.ticket_list(t, idmap, labels, label="question", under=one), lambda t, dc: planning.ticket_list(t, idmap, parent=one),
        lambda t, dc: planning.ancestors(t, deep), lambda t, dc: planning.show_tree(t, dc, deps, one), lambda t, dc: planning.board(t, idmap, queries_vault.BOARD), lambda t, dc: planning.board(t, idmap, queries_vault.BOARD, team="dock"),
    )
    for run in runs:
        assert rows_of(run(t, dc)) == rows_of(run(_with_holes(t), _with_holes(dc)))
        assert run(t.limit(0), dc.limit(0)).collect() == []
    assert planning.ticket_list(t, idmap, under="T-none").collect() == [] and planning.show_tree(t, dc, deps, "none").collect() == []


def test_what_is_above_and_below_one_ticket_takes_no_paths(spark, small, monkeypatch):
    """Paths of every ticket are not needed for those around one; what comes is what the paths say."""
    from lodestrata.operators import hierarchy
    from lodestrata.runtime import stored

    def never(tree):
        raise AssertionError("paths of all tickets")

    monkeypatch.setattr(planning, "with_paths", never, raising=False)
    rows = [("a", None)] + [(f"c{i}", f"c{i - 1}" if i else "a") for i in range(40)] + [(f"s{i}", "c7") for i in range(30)] + [("t", "s3"), ("b", None), ("u", "b"), ("r1", "r2"), ("r2", "r1"), ("r3", "r1")]
    t = spark.createDataFrame([(a, b, "task", a, None, "1", "h") for a, b in rows], "record_id string, parent_record_id string, type string, title string, deleted_at string, updated_at string, hash string")
    tree = stored(hierarchy.hierarchy(t))
    up = dict(rows)
    lines = {a: [] for a in up}
    for a in up:
        at = up[a]
        while at and at not in lines[a]:
            lines[a].append(at)
            at = up[at]
    for one in ("a", "c7", "t", "r3"):
        own = tree.where(F.col("record_id") == one).first()
        assert {tuple(r) for r in hierarchy.above(tree, own).collect()} == ({(i + 1, x) for i, x in enumerate(lines[one])} if one != "r3" else set()), one
        assert {tuple(r) for r in hierarchy.below(tree, own).collect()} == {(lines[x].index(one) + 1, x) for x in up if one in lines[x]}, one
    assert [r.record_id for r in planning.ancestors(t, " C2 ", tree).collect()] == ["c1", "c0", "a"]


def test_inlinks_to_one_path_are_those_of_the_join(spark):
    files = [_file(p) for p in ("a/b c.md", "a/b_c.MD", "top.md", "x/a/b c.md", "A/B C.md", "none.txt")]
    targets = ["b c", "B C", "b_c", "a/b c", "a/b c.md", "b c.md", "top", "TOP", "_op", "none", "none.txt", "%", "a%c", "a/b_c.MD", "_/b_c", None]
    v = _vault(spark, files, link_rows=[("s.md", t, None, "wiki", i) for i, t in enumerate(targets)])
    every = {(r.path, r.target_path) for r in links.resolved(v.files, v.links).collect()}
    for path, *_ in files:
        assert {r.target_path for r in v.links.where(links.names(F.col("target_path"), path)).collect()} == {t for p, t in every if p == path}, path


def test_neighbours_refuse_more_than_they_can_show(spark):
    v = _vault(spark, [_file("a.md")])
    with pytest.raises(ValueError):
        rank.neighbours(v, spark.range(rank.MAX_ASKED + 1).selectExpr("cast(id AS string) AS path"))
