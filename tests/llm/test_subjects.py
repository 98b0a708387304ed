"""Subject areas: accuracy on labels that training never saw, sentence counting, edge cases."""

import pytest

from lodestrata.llm import subjects

from . import heldout

D = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    """Documents on whose areas two annotators agree are kept from training; their areas must come out."""
    n, precision, recall = heldout.measure(spark, D)
    assert n > 50 and precision > 0.93 and recall > 0.93


def test_sentences_skip_what_is_no_prose():
    text = "﻿---\r\ntags: [law]\r\n---\r\n# Law heading\r\n\r\nThe court met. It ruled #law!\r\nSee [[law|court]].\r\n```\ncode about law.\n```\n- item one\n- excavaciÃ³n dos"
    got = subjects.sentences(text)
    assert got == [["the", "court", "met"], ["it", "ruled"], ["see"], ["item", "one"], ["excavación", "dos"]]
    assert subjects.sentences(None) == subjects.sentences("") == []


@pytest.fixture(scope="module")
def toy(spark):
    docs, labels = [], []
    areas = {"law": ["court", "judge", "verdict", "statute"], "music": ["violin", "sonata", "tempo", "choir"]}
    for i in range(40):
        area = ("law", "music")[i % 2]
        w = areas[area]
        docs.append((i, f"Today the {w[i % 4]} was about {w[(i + 1) % 4]}. We saw the {w[(i + 2) % 4]} again. Please file the note.", "x"))
        labels.append((i, area, "r1"))
    docs += [(100, "Today the court was about statute. Please file the note.", "x"), (101, None, "x"), (102, "", "x"), (103, "Please file the note. " * 3000, "x"), (None, "The judge gave a verdict. The court gave a statute.", "x")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame([*labels, *labels, (None, "law", "r1"), (3, None, "r1"), (5, "unknown", "r9")], "doc_id long, subject string, annotator string"),
        spark.createDataFrame([("law", "d"), ("music", "d"), (None, None)], "subject string, description string"),
    )


def test_two_sentences_are_needed(toy):
    got = {(r.doc_id, r.subject) for r in subjects.subject_areas(*toy).collect()}
    assert {(i, ("law", "music")[i % 2]) for i in range(40)} <= got
    assert (None, "law") in got
    assert not {d for d, _ in got} & {100, 101, 102, 103}


def test_no_labels_or_documents_give_nothing(toy):
    docs, labels, names = toy
    assert subjects.subject_areas(docs, labels.limit(0), names).collect() == []
    assert subjects.subject_areas(docs.limit(0), labels, names).collect() == []
    assert subjects.subject_areas(docs, labels, names.limit(0)).collect() == []


def test_gradient_is_the_loss_slope():
    """Against differences of the loss: every output its own logistic loss, a sentence by how much of it weighs."""
    import numpy as np

    rng = np.random.default_rng(0)
    tokens, starts, owner, shares = np.array([0, 1, 2, 1, 0]), np.array([0, 2, 4]), np.array([0, 0, 1]), np.array([[1.0, 0.5], [0.0, 1.0]])
    vectors, weight, out, bias = rng.standard_normal((3, 4)), np.array([0.3, 0.5, 1.5]), rng.standard_normal((4, 2)), rng.standard_normal(2)

    def loss(vectors, out, bias):
        w = weight[tokens]
        mass = np.add.reduceat(w, starts)
        z = np.add.reduceat(vectors[tokens] * w[:, None], starts, axis=0) / (mass + subjects.DAMPING)[:, None] @ out + bias
        return (np.minimum(mass, 1)[:, None] * (np.log1p(np.exp(z)) - shares[owner] * z)).sum()

    got = subjects.partition_gradient((tokens, starts, owner, shares), vectors, weight, out, bias)
    at = [vectors, out, bias]
    for k, (x, g) in enumerate(zip(at, got, strict=True)):
        for i in np.ndindex(x.shape):
            step = np.zeros_like(x)
            step[i] = 1e-5
            ends = [loss(*(y + s * step if j == k else y for j, y in enumerate(at))) for s in (1, -1)]
            assert abs((ends[0] - ends[1]) / 2e-5 - g[i]) < 1e-3


def test_a_sentence_may_have_two_areas_or_none():
    import numpy as np

    words = {"court": 0, "violin": 1, "note": 2}
    model = subjects.AreaModel(["law", "music"], words, np.array([2.0, 2.0, 0.0]), np.array([[9.0, 0], [0, 9.0], [0, 0]]), np.zeros((subjects.BUCKETS, 2)), np.array([-2.0, -2.0]))
    assert model.counts(["Court violin. Court. Note. Note court violin."]).tolist() == [[3, 2]]
