"""Leak search: recall against a scan of everything, planted variants, near misses."""

import time

import numpy as np
import pytest

from lodestrata.llm import leakage
from lodestrata.llm.normal import words
from lodestrata.runtime import table

from . import scan

PASSAGES = [
    (1, "Of 518 jars that Tonoko counted, 78 went to Gornoric and toll-gate porters in Tonoren. Just before 1481 Keldono repaired 877 borrowed kites near the signal-box, amid early permit.", "Tonoko"),
    (2, "A painted footbridge in Tonoro cost Tumpraic 58 hinges, which Zantisic weighed halfway through 1928. Hulhemic kept 598 spare sails during idle lawsuit.", "Osdar"),
    (3, "A painted footbridge in Tonoro cost Tumpraic 58 hinges, which Zantisic weighed halfway through 1928. Hulhemic kept 598 spare sails during idle lawsuit.", ""),
    (4, None, None),
    (5, "Too short.", "x"),
]
FILL = "Ordinary prose about gardens and the weather goes on for a while before and after."
A = PASSAGES[0][1]


def items(spark, extra=()):
    return spark.createDataFrame([(i, "b", p, "q", a) for i, p, a in [*PASSAGES, *extra]], "item_id long, bench string, passage string, question string, answer string")


VARIANTS = {
    "whole": A, "upper": A.upper(), "no_punctuation": A.replace(",", "").replace(".", ""), "accents": A.replace("o", "ó"), "wrapped": A.replace(" ", "\n> "),
    "invisible": "​".join(A), "soft_hyphen": A.replace("counted", "coun­ted"), "broken_hyphen": A.replace("porters", "por-\nters"), "tags": A.replace("jars", "<b>jars</b>").replace("Keldono", "Kel<i>do</i>no"),
    "markup": A.replace("jars", "**jars**").replace("counted", "[[counted]]").replace("porters", "`porters`").replace("repaired", "[repaired](http://x.y/z)"), "table": "| " + A.replace(", ", " | ") + " |",
    "fullwidth": "".join(chr(ord(c) + 0xFEE0) if "!" < c < "~" else c for c in A), "twelve": " ".join(A.split()[:12]), "hyphen_gone": A.replace("toll-gate", "toll gate"),
    "changed": " ".join("other" if i in (5, 14, 23) else w for i, w in enumerate(A.split())), "dropped": " ".join(w for i, w in enumerate(A.split()) if i not in (6, 15, 24)),
    "inserted": " ".join(w + (" also" if i in (6, 15, 24) else "") for i, w in enumerate(A.split())), "entities": A.replace(" 78 ", " &#55;8 "), "twice": A + "\n\n" + A,
}
MISSES = {
    "ten_words": " ".join(A.split()[1:11]), "shuffled": " ".join(sorted(A.split())), "every_fourth_changed": " ".join("other" if i % 4 == 0 else w for i, w in enumerate(A.split())),
    "two_short_pieces": " ".join(A.split()[:8]) + ". " + FILL + " " + " ".join(A.split()[18:26]), "nothing": FILL, "empty": "", "null": None,
}


def test_planted_variants_and_near_misses(spark):
    wrap = lambda t: t if not t else f"# Note\n\n{FILL}\n\n{t}\n\n{FILL}"
    names = [*VARIANTS, *MISSES]
    docs = spark.createDataFrame([(i, wrap({**VARIANTS, **MISSES}[n]), 3) for i, n in enumerate(names)], "doc_id long, text string, item_id int")
    got = {(names[r.doc_id], r.item_id) for r in leakage.leaks(docs, items(spark)).where("kind = 'quoted'").collect()}
    assert got == {(n, 1) for n in VARIANTS}


def test_items_that_share_a_passage_are_each_a_case_and_answers_are_noted(spark):
    docs = spark.createDataFrame([(7, PASSAGES[1][1] + " Osdar said so.")], "doc_id long, text string")
    got = {(r.item_id, r.answered) for r in leakage.leaks(docs, items(spark)).collect()}
    assert got == {(2, True), (3, False)}


def test_shared_introduction_does_not_count(spark):
    intro = "The following excerpt is taken from the minutes of a working group and has been shortened for length."
    more = [(100 + i, f"{intro} " + " ".join(f"word{i}x{k}" for k in range(20)) + ".", "") for i in range(6)]
    docs = spark.createDataFrame([(1, FILL + " " + intro), (2, more[2][1])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items(spark, more)).collect()} == {(2, 102)}


def test_items_whose_passages_read_alike_are_each_a_case(spark):
    more = [(9, A.upper().replace(",", ";"), "")]
    docs = spark.createDataFrame([(7, A)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items(spark, more)).collect()} == {(7, 1), (7, 9)}


@pytest.mark.parametrize("rank", [48, 96, 400])
def test_search_finds_what_an_independent_scan_finds(spark, rank):
    """Another reading of texts and another alignment, every document with every passage."""
    d = "/root/testdata/sf0.01"
    want = scan.cases(*scan.load(d), processes=1) if rank == 96 else scan.cases(*scan.load(d.replace("0.01", "0.001")), processes=1)
    d = d if rank == 96 else d.replace("0.01", "0.001")
    got = leakage.leaks(table(spark, d, "documents"), table(spark, d, "bench_items"), rank=rank).where("kind = 'quoted'").select("doc_id", "item_id")
    got = {tuple(r) for r in got.collect()}
    assert len(want & got) >= 0.9 * len(want) and not got - want and (rank != 96 or (got == want and len(want) > 20))


def test_candidates_are_what_the_latent_search_returns(spark):
    """A floor above every cosine leaves no candidate and so no case."""
    docs = spark.createDataFrame([(7, A)], "doc_id long, text string")
    assert leakage.leaks(docs, items(spark)).count() == 1
    assert leakage.leaks(docs, items(spark), floor=50.0).count() == 0


def test_markup_of_any_length(spark):
    """A link, an alias, a comment or a tag of thousands of characters within the passage."""
    long = "x" * 5000
    w = A.split()
    texts = [
        " ".join([*w[:6], f'<a href="https://h.example/{long}?q=a b">{w[6]}</a>', *w[7:12]]), " ".join([*w[:6], f"[{w[6]}](https://h.example/{long})", *w[7:12]]),
        " ".join([*w[:6], f"[[{long}|{w[6]}]]", *w[7:12]]), " ".join([*w[:6], f"<!-- {long} {FILL} -->", *w[6:12]]), " ".join([*w[:6], w[6] + f"[^{long}]", *w[7:12]]),
        " ".join([*w[:6], f"[{w[6]}](https://h.example/a_(b)_{long})", *w[7:12]]),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items(spark)).collect()} == {(i, 1) for i in range(len(texts))}


def test_number_references_of_any_length(spark):
    """Thousands of digits are no character, and leading zeros don't count; one such text must not end the job."""
    assert words("a &#" + "9" * 5000 + "; b") == ["a", "b"] and words("&#" + "0" * 5000 + "65;b") == ["ab"] and words("&#" + "0" * 20 + "; &#055;") == ["7"]
    docs = spark.createDataFrame([(1, A), (2, "&#" + "1" * 5000 + "; " + A)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items(spark)).collect()} == {(1, 1), (2, 1)}


def test_texts_with_windows_to_compare_but_no_candidate(spark):
    """A batch may end with a few texts that only resemble passages: the bound keeps windows of theirs, no cosine reaches a floor."""
    d = "/root/testdata/sf0.001"
    docs, bench = table(spark, d, "documents"), table(spark, d, "bench_items")
    want = sorted(tuple(r) for r in leakage.leaks(docs, bench).collect())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        assert sorted(tuple(r) for r in leakage.leaks(docs, bench).collect()) == want and want
    finally:
        spark.conf.set(key, usual)


@pytest.mark.parametrize("part", ["<a href='", "<!--", "[", "a-\n", "<p x ", "[x](", "[^", "[[a|", "&lt", "(("])
def test_reading_takes_linear_time(part):
    start = time.process_time()
    words(part * 100_000)
    assert time.process_time() - start < 5


def test_what_is_no_quotation_may_be_a_paraphrase(spark):
    """Half of the words in order but edits everywhere: reported only if the answer occurs, and no case of p8_found."""
    w = A.split()
    text = " ".join("other" if i % 5 == 4 else x for i, x in enumerate(w))
    told = "Of 518 jars counted, 78 went to gate porters in Tonoren"
    docs = spark.createDataFrame([(1, f"{text} Tonoko"), (2, text.replace("Tonoko", "Someone")), (3, told)], "doc_id long, text string")
    got = {(r.doc_id, r.kind) for r in leakage.leaks(docs, items(spark)).collect()}
    assert got == {(1, "paraphrased")}


def test_svd_keeps_inner_products(spark):
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 300, 40).tolist() for _ in range(50)]
    idf = rng.random(300) + 0.1
    basis = leakage.randomised_svd(spark, rows, idf, len(rows))
    full = np.zeros((50, 300))
    for i, ids in enumerate(rows):
        at, w = leakage._tfidf(ids, idf)
        full[i, at] = w
    assert np.allclose(full @ basis @ basis.T, full, atol=1e-6)


@pytest.mark.parametrize(("a", "b", "n"), [([1, 2, 3, 4], [1, 3, 4], 3), ([1, 2], [3], 0), ([], [1], 0), ([1, 1, 2], [1, 2, 1], 2)])
def test_common_subsequence(a, b, n):
    assert leakage.lcs_length(a, np.asarray(b)) == n


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert leakage.leaks(docs, items(spark)).collect() == []
    assert leakage.leaks(spark.createDataFrame([(1, A)], "doc_id long, text string"), items(spark).limit(0)).collect() == []
