"""Evaluation texts leaking into training text (problem 8).

Latent semantic retrieval. Distinct passages are the rows of a TF-IDF matrix, whose weights come from all passages; a
distributed randomised SVD, cut at `rank`, gives the latent space. Every window of `min_words` words of every document is
folded into it, and the windows whose cosine with a passage reaches that passage's floor are its candidates; nothing else is looked
at. Candidates are decided by longest common subsequence and alignment; what is no quotation may be a paraphrase, which
the answer decides.

The search. A window's latent vector is the sum of its words' latent weights, its length that of its TF-IDF vector, where a
word of no passage weighs as much as the rarest one. A passage's floor is `floor` times the least cosine that any unchanged min_words
of its words in a row have with it; recall is measured against an alignment of every document with every passage (README).
Windows are compared in blocks. Most are ruled out before by a bound that loses none: a word's share of the cosine over
the floor, at its best passage, summed over the window, must reach the window's length.

One pass over the corpus reads, normalises and searches every text whole; only its cases leave the task. The test set is a
fixed, small table: its vocabulary, latent vectors and floors are what is sent to executors.

A case: at least min_words consecutive passage words in their order, beginning and ending with a matching word, with edits
(changed, dropped or inserted words) on at most one word in `per_edit`. A first sentence that `intro_share` distinct passages or more have in
common counts for none. Null or empty texts and passages give no case, nor do documents without an id; items with equal passages are each a case; a text
shorter than a window is compared as if unknown words surrounded it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .normal import words

INTRO_SHARE, MIN_WORDS, PER_EDIT = 5, 12, 8
RANK, FLOOR, SURE, BLOCK, TOKENS = 96, 0.5, 0.8, 8192, 200_000
REPORT = "doc_id long, item_id long, kind string, cosine double, common int, answered boolean"


class Lexicon:
    """The passages' words by number, and how texts are read with them."""

    def __init__(self, passages: list[list[str]]) -> None:
        self.ids = {w: i for i, w in enumerate(sorted({w for p in passages for w in p}))}
        self.beginnings = {w[:i] for w in self.ids for i in range(1, len(w))}

    def read(self, got: list[str]) -> list[int]:
        """Word numbers, -1 for others; two neighbours that together spell a word, and are not both words, count as one."""
        ids = self.ids
        out = [ids.get(w, -1) for w in got]
        last = len(got) - 1
        drop: list[int] = []
        for i in [i for i, w in enumerate(got) if w in self.beginnings]:
            if i < last and (out[i] < 0 or ids.get(got[i + 1], -1) < 0) and (not drop or drop[-1] != i):
                both = ids.get(got[i] + got[i + 1])
                if both is not None:
                    out[i] = both
                    drop.append(i + 1)
        if drop:
            gone = set(drop)
            out = [x for i, x in enumerate(out) if i not in gone]
        return out


@dataclass
class Latent:
    """What executors need. Per word (the last entry stands for unknown ones): latent weight, squared TF-IDF weight, best share of a floor.

    Per passage: latent unit vector, least cosine of an unchanged window, floor of the search, words, runs of words, items.
    """

    lexicon: Lexicon
    weight: np.ndarray
    square: np.ndarray
    reach: np.ndarray
    units: np.ndarray
    clean: np.ndarray
    floors: np.ndarray
    passages: list[list[int]]
    run: int
    runs: list[set[tuple[int, ...]]]
    items: list[list[int]]
    answers: dict[int, set[str]]


# --- passages ------------------------------------------------------------------------------------------------------


def passage_words(passages: list[str]) -> list[list[str]]:
    """Words of each distinct passage without a first sentence that many share."""
    split = [re.split(r"(?<=[.!?])\s+", p.strip(), maxsplit=1) for p in passages]
    shared = Counter(tuple(words(s[0])) for s in split)
    return [words(s[1] if len(s) > 1 else "") if shared[tuple(words(s[0]))] >= INTRO_SHARE else words(p) for s, p in zip(split, passages, strict=True)]


def randomised_svd(spark: SparkSession, rows: list[list[int]], idf: np.ndarray, rank: int, power: int = 2, seed: int = 11) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages' TF-IDF matrix; rows live in Spark, products are summed there.

    Every step sends a words x rank matrix to the partitions and adds up what they return.
    """
    width = min(rank + 8, len(rows), len(idf))
    rdd = spark.sparkContext.parallelize(rows, max(1, min(16, len(rows) // 64))).map(lambda ids: _tfidf(ids, idf))
    n_words = len(idf)

    def gram_times(m: np.ndarray) -> np.ndarray:
        """A^T (A m), summed over partitions."""
        sent = spark.sparkContext.broadcast(m)

        def part(vectors):  # noqa: ANN001, ANN202
            out = np.zeros((n_words, sent.value.shape[1]))
            for ids, w in vectors:
                out[ids] += np.outer(w, w @ sent.value[ids])
            yield out

        return rdd.mapPartitions(part).treeReduce(lambda a, b: a + b)

    basis = np.linalg.qr(gram_times(np.random.default_rng(seed).standard_normal((n_words, width))))[0]
    for _ in range(power):
        basis = np.linalg.qr(gram_times(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ gram_times(basis))
    keep = values > values.max(initial=0) * 1e-10
    return basis @ turn[:, keep]


def _tfidf(ids: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(np.asarray(ids, dtype=np.int64), return_counts=True)
    return at, n * idf[at]


def inverse_frequencies(passages: list[list[int]], n_words: int) -> np.ndarray:
    """A word's weight by the number of passages that hold it."""
    df = np.zeros(n_words)
    for ids in passages:
        df[list(set(ids))] += 1
    return np.log((len(passages) + 1) / (df + 1)) + 1e-3


def clean_cosines(passages: list[list[int]], share: np.ndarray, idf: np.ndarray, min_words: int) -> np.ndarray:
    """Per passage the least cosine with it of any min_words of its words in a row, as the search computes it."""
    out = []
    for p, ids in enumerate(passages):
        dot, square = (np.concatenate([[0], np.cumsum(x)]) for x in (share[ids, p], idf[ids] ** 2))
        out.append(((dot[min_words:] - dot[:-min_words]) / np.sqrt(square[min_words:] - square[:-min_words])).min())
    return np.maximum(out, 1e-3)


def fit(spark: SparkSession, lexicon: Lexicon, passages: list[list[int]], items: list[list[int]], answers: dict[int, set[str]], min_words: int, rank: int, floor: float) -> Latent:
    idf = inverse_frequencies(passages, len(lexicon.ids))
    basis = randomised_svd(spark, passages, idf, min(rank, len(passages)))
    weight = idf[:, None] * basis
    units = np.stack([w @ basis[at] for at, w in (_tfidf(ids, idf) for ids in passages)])
    units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)
    share = weight @ units.T
    clean = clean_cosines(passages, share, idf, min_words)
    floors = floor * clean
    run = least_run(min_words, PER_EDIT, max(map(len, passages)))
    return Latent(
        lexicon, np.vstack([weight, np.zeros(weight.shape[1])]).astype(np.float32), np.append(idf**2, idf.max() ** 2),
        np.append((share / floors).max(axis=1).clip(0), 0), units.astype(np.float32), clean, floors, passages, run, [runs_of(p, run) for p in passages], items, answers,
    )


# --- documents -----------------------------------------------------------------------------------------------------


def latent_search(model: Latent, texts: list[np.ndarray], min_words: int) -> Iterator[tuple[int, int, np.ndarray, float]]:
    """text, passage, the starts of the text's windows that reach the passage's floor, and the best cosine; by text."""
    gap = np.full(min_words, -1)
    flat = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    starts = np.cumsum([min_words, *(len(t) + min_words for t in texts[:-1])])
    bound, square = (np.concatenate([[0], np.cumsum(x[flat])]) for x in (model.reach, model.square))
    length = np.sqrt(square[min_words:] - square[:-min_words])
    at = np.flatnonzero(bound[min_words:] - bound[:-min_words] >= length * (1 - 1e-6))
    found = []
    for a in range(0, len(at), BLOCK):
        some = at[a : a + BLOCK]
        vector = sum(model.weight[flat[some + k]] for k in range(min_words))
        cosine = (vector @ model.units.T) / length[some, None]
        w, p = np.nonzero(cosine >= model.floors)
        if len(w):
            found.append((some[w], p, cosine[w, p]))
    if not found:
        return
    at, p, cosine = map(np.concatenate, zip(*found, strict=True))
    text = np.searchsorted(starts, at + min_words - 1, "right") - 1
    order = np.lexsort((at, p, text))
    at, p, cosine, text = at[order], p[order], cosine[order], text[order]
    first = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(p) != 0)))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        yield int(text[a]), int(p[a]), at[a:b] - starts[text[a]], float(cosine[a:b].max())


def stretches(windows: np.ndarray, passage: int, min_words: int) -> list[tuple[int, int]]:
    """Where a case that shows in these windows can lie: each with a whole passage's words on both sides, joined where they meet."""
    margin = passage + passage // PER_EDIT + 1
    cuts = np.flatnonzero(np.diff(windows) > 2 * margin + min_words) + 1
    return [(max(0, int(w[0]) - margin), int(w[-1]) + min_words + margin) for w in np.split(windows, cuts)]


def lcs_length(a: list[int], b: np.ndarray) -> int:
    """Longest common subsequence, a bit per word of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def runs_of(ids: list[int], k: int) -> set[tuple[int, ...]]:
    """All k words in a row."""
    return {tuple(ids[i : i + k]) for i in range(len(ids) - k + 1)}


def least_run(min_words: int, per_edit: int, longest: int) -> int:
    """The unbroken run that every case has: e edits in L words leave L - e words in at most e + 1 runs."""
    return min(-(-(length - e) // (e + 1)) for length in range(min_words, max(min_words, longest) + 1) for e in (length // per_edit,))


def quotes(passage: list[int], region: np.ndarray, min_words: int = MIN_WORDS, per_edit: int = PER_EDIT) -> bool:
    """Whether region holds a case of passage: min_words in a row, or an alignment.

    best[e, j] is the most passage words of an alignment that ends at word j of region with e edits.
    """
    if not runs_of(passage, min_words).isdisjoint(runs_of(region.tolist(), min_words)):
        return True
    top, n = len(passage) // per_edit, len(region)
    dead = -10_000
    wanted = np.maximum(min_words, per_edit * np.arange(top + 1))[:, None]
    before = np.full((top + 1, n + 1), dead, dtype=np.int32)
    masks = {w: region == w for w in set(passage)}
    for word in passage:
        row = np.full_like(before, dead)
        same = masks[word]
        matched = before[:, :-1].copy()
        np.maximum(matched[0], 0, out=matched[0])
        matched = np.where(same, matched + 1, dead)
        if (matched >= wanted).any():
            return True
        row[:, 1:] = matched
        np.maximum(row[1:, 1:], before[:-1, :-1] + 1, out=row[1:, 1:])  # a changed word
        np.maximum(row[1:], before[:-1] + 1, out=row[1:])  # a dropped one
        for e in range(1, top + 1):  # an inserted one
            np.maximum(row[e, 1:], row[e - 1, :-1], out=row[e, 1:])
        before = row
    return False


def judge(model: Latent, ids: np.ndarray, passage: int, windows: np.ndarray, cosine: float, min_words: int) -> tuple[str, int]:
    """"quoted", "paraphrased" (if the answer agrees) or "", and the longest common subsequence, of a text and a passage that the search brought together."""
    own = model.passages[passage]
    parts = [ids[a:b] for a, b in stretches(windows, len(own), min_words)]
    common = [lcs_length(own, r) for r in parts]
    enough = min_words - min_words // PER_EDIT
    for r, n in zip(parts, common, strict=True):
        # edits leave an unbroken run; without one there is nothing to align
        if n >= enough and not model.runs[passage].isdisjoint(runs_of(r.tolist(), model.run)) and quotes(own, r, min_words):
            return "quoted", max(common)
    near = cosine >= SURE * model.clean[passage] and 2 * max(common) >= len(own)
    return ("paraphrased" if near else ""), max(common)


def leaks(documents: DataFrame, bench_items: DataFrame, min_words: int = MIN_WORDS, rank: int = RANK, floor: float = FLOOR) -> DataFrame:
    """doc_id, item_id, kind, cosine, common, answered: every case ("quoted"), and every paraphrase.

    cosine is the best window's, common the longest common subsequence in words, answered whether the document holds all
    words of the item's answer. A paraphrase is no case: its best window has `SURE` times the passage's own least cosine, half of the
    passage's words occur in order, and the answer occurs.
    """
    spark = documents.sparkSession
    by_passage: dict[str, set[int]] = {}
    answers: dict[int, set[str]] = {}
    for r in bench_items.select("item_id", "passage", "answer").distinct().collect():  # the test set is a fixed table
        if r["passage"] and r["item_id"] is not None:
            by_passage.setdefault(r["passage"], set()).add(r["item_id"])
            answers[r["item_id"]] = answers.get(r["item_id"], set()) | set(words(r["answer"]))
    texts = sorted(by_passage)
    chosen: dict[tuple[str, ...], set[int]] = {}
    for t, w in zip(texts, passage_words(texts), strict=True):
        if len(w) >= min_words:
            chosen.setdefault(tuple(w), set()).update(by_passage[t])
    if not chosen:
        return spark.createDataFrame([], REPORT)
    lexicon = Lexicon([list(w) for w in chosen])
    model = fit(spark, lexicon, [[lexicon.ids[w] for w in p] for p in chosen], [sorted(x) for x in chosen.values()], answers, min_words, rank, floor)
    sent = spark.sparkContext.broadcast(model)

    def search(m: Latent, doc_ids: list[int], read: list[np.ndarray], texts: list[str]) -> pd.DataFrame:
        rows, have, last = [], set(), -1
        for t, p, hits, cosine in latent_search(m, read, min_words):
            kind, common = judge(m, read[t], p, hits, cosine, min_words)
            if not kind:
                continue
            if t != last:
                have, last = set(words(texts[t])), t
            for i in m.items[p]:
                answered = bool(m.answers[i]) and m.answers[i] <= have
                if kind == "quoted" or answered:
                    rows.append((doc_ids[t], i, kind, round(cosine, 3), common, answered))
        return pd.DataFrame(rows, columns=["doc_id", "item_id", "kind", "cosine", "common", "answered"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            ids, read, texts, tokens = [], [], [], 0
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                got = m.lexicon.read(words(t))
                if len(got) - got.count(-1) >= min_words - min_words // PER_EDIT:
                    ids.append(d)
                    read.append(np.asarray(got))
                    texts.append(t)
                    tokens += len(got)
                if tokens >= TOKENS:
                    yield search(m, ids, read, texts)
                    ids, read, texts, tokens = [], [], [], 0
            if ids:
                yield search(m, ids, read, texts)

    return documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(run, REPORT).distinct()
