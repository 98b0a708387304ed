"""Precision and recall of subject areas on documents that training never saw: python -m tests.llm.heldout FOLDER

Documents on whose areas two annotators agree are cut in two by a hash. The first half is for choosing the threshold (its
figures are printed for several), the second is measured at the shipped threshold only. Training takes the other labelled ones.
"""

import sys
import zlib


def split(labels):
    """doc_id -> areas of the agreed documents, as (to tune on, to measure on)."""
    said = {}
    for r in labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").distinct().collect():
        said.setdefault(r.doc_id, {}).setdefault(r.annotator, set()).add(r.subject)
    sure = {d: next(iter(x.values())) for d, x in said.items() if len(x) > 1 and len({frozenset(v) for v in x.values()}) == 1}
    half = {d: zlib.crc32(str(d).encode()) % 2 for d in sure}
    return tuple({d: a for d, a in sure.items() if half[d] == k} for k in (0, 1))


def rates(model, texts, truth, threshold, needed):
    ids = sorted(truth)
    counts = model.counts([texts.get(d) for d in ids], threshold)
    got = {(d, model.areas[a]) for i, d in enumerate(ids) for a in range(len(model.areas)) if counts[i, a] >= needed}
    want = {(d, a) for d in ids for a in truth[d]}
    return len(got & want) / max(1, len(got)), len(got & want) / max(1, len(want))


def measure(spark, folder, thresholds=()):
    from lodestrata.llm import subjects
    from lodestrata.runtime import table

    docs, labels, names = (table(spark, folder, t) for t in ("documents", "subject_labels", "subjects"))
    tune, test = split(labels)
    held = spark.createDataFrame([(d,) for d in {**tune, **test}], "doc_id long")
    areas = sorted(r["subject"] for r in names.collect())
    model = subjects.train(docs, labels.join(held, "doc_id", "left_anti"), areas)
    texts = {r.doc_id: r.text for r in docs.join(held, "doc_id", "left_semi").select("doc_id", "text").collect()}
    for t in thresholds:
        print("tune", len(tune), t, *(round(x, 4) for x in rates(model, texts, tune, t, subjects.NEEDED)))
    return len(test), *rates(model, texts, test, subjects.THRESHOLD, subjects.NEEDED)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").getOrCreate()
    print("measured", *measure(session, sys.argv[1], (-1, -0.75, -0.5, -0.4, -0.25, 0, 0.5)))
