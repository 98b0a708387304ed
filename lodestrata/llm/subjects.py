"""Subject areas of documents (problem 9).

Averaged word and subword embeddings with one independent logistic output per area. The unit scored is the sentence; a
document treats an area if at least `needed` sentences have it. Labels are per document: a sentence's target for an area is the
share of its document's annotators who named that area, whatever the other areas' targets are, so that stray labels and the
sentences of a document's other areas are outweighed by the documents that hold like sentences. A sentence may have several areas or none. A word's vector is
the mean of its own and its n-grams' bucket vectors; its weight in
the average is how much the labels of its documents differ from the general mix, which silences templates, names and
housekeeping without a list of them.

Training runs on labelled documents, a bounded sample (`max_labelled`, by hash of doc_id) only above that number of them; the
words' weights are fitted on the same sample. They are packed once per partition; every step broadcasts the word vectors and output weights, sums the partitions' gradients
in a tree, and updates on the driver. What travels has the size of the sample's vocabulary. Every document is then scored,
whole, in one pass without a shuffle; unseen words are represented by their subwords.

Null and empty texts have no area; repeated label rows count once; without labels the result is empty. A sentence has an
area if that area's score, a log-odds, passes `threshold`.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

BUCKETS, DIM, STEPS, RATE, MUTE, DOCS_PER_TASK = 1 << 15, 24, 40, 0.05, 0.02, 1000
SMOOTHING, DAMPING, UNSEEN, MAX_LABELLED, THRESHOLD, NEEDED = 4.0, 3.0, 0.5, 2_500, -0.25, 2

_FRONT = re.compile(r"\A﻿?---\n.*?\n---[ \t]*\n", re.S)
_FENCE = re.compile(r"^(```|~~~).*?^\1[`~]*[ \t]*$", re.S | re.M)
_WIKI = re.compile(r"!?\[\[[^\[\]]*\]\]")
_TAG = re.compile(r"(?<!\w)#\w[\w/-]*")
_HEADING = re.compile(r"^[ \t]*#{1,6}[ \t].*$", re.M)
_BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*\n|\n(?=\s*[-*|>#+])")
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_GARBLED = re.compile("Ã.|Â.|â€")


def sentences(text: str | None) -> list[list[str]]:
    """Word lists of the sentences of a note's prose: no frontmatter, code, headings, link markup, hashtags or numbers."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _GARBLED.search(text):
        text = re.sub(r"[^\s]*(?:Ã|Â|â€)[^\s]*", lambda m: _repaired(m[0]), text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _HIDDEN.sub("", text))
    text = _TAG.sub(" ", _HEADING.sub("\n", _WIKI.sub(" ", _FENCE.sub("\n\n", _FRONT.sub("", text)))))
    out = []
    for part in _BREAK.split(text):
        words = _TOKEN.findall(part.lower())
        if words:
            out.append(words)
    return out


def _repaired(word: str) -> str:
    """UTF-8 that was read as a one-byte code, if it was."""
    for code in ("cp1252", "latin-1"):
        try:
            return word.encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return word


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its 3- to 5-grams with word borders."""
    x = f"<{word}>"
    grams = [x, *(x[i : i + n] for n in (3, 4, 5) for i in range(len(x) - n + 1))]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


class AreaModel:
    """areas; words and their weights; their vectors through the outputs (words x areas); the same of the subword buckets; biases."""

    def __init__(self, areas: list[str], words: dict[str, int], weight: np.ndarray, logits: np.ndarray, bucket_logits: np.ndarray, bias: np.ndarray) -> None:
        self.areas, self.bucket_logits, self.bias = areas, bucket_logits, bias
        keep = [(w, i) for w, i in words.items() if weight[i] >= MUTE]
        self.known = {w: -1 for w, i in words.items() if weight[i] < MUTE} | {w: k for k, (w, _) in enumerate(keep)}
        at = [i for _, i in keep]
        self.weight, self.logits, self.size = weight[at].astype(np.float32), logits[at].astype(np.float32), len(keep)
        self.table, self.reach = dict(self.known), self.size  # grows by words that training never saw

    def counts(self, texts: list[str | None], threshold: float = THRESHOLD) -> np.ndarray:
        """texts x areas: how many sentences have each area."""
        out = np.zeros((len(texts), len(self.areas)), dtype=np.int64)
        tokens, starts, owner = [], [], []
        for k, t in enumerate(texts):
            for s in sentences(t):
                ids = list(map(self.table.get, s))
                if None in ids:
                    ids = list(map(self._number, s))
                ids = [i for i in ids if i >= 0]
                if ids:
                    starts.append(len(tokens))
                    owner.append(k)
                    tokens += ids
            if len(tokens) > 200_000 or (k == len(texts) - 1 and starts):
                w = self.weight[tokens]
                total = np.add.reduceat(w[:, None] * self.logits[tokens], starts, axis=0)
                sentence, area = np.nonzero(total / (np.add.reduceat(w, starts) + DAMPING)[:, None] + self.bias > threshold)
                np.add.at(out, (np.asarray(owner)[sentence], area), 1)
                tokens, starts, owner = [], [], []
                if self.reach > self.size + 200_000:  # what a task remembers of unseen words is bounded
                    self.table, self.reach = dict(self.known), self.size
        return out

    def _number(self, word: str) -> int:
        got = self.table.get(word)
        if got is None:
            if self.reach == len(self.weight):
                more = max(1024, self.reach)
                self.weight = np.concatenate([self.weight, np.full(more, UNSEEN, np.float32)])
                self.logits = np.concatenate([self.logits, np.zeros((more, len(self.areas)), np.float32)])
            got = self.table[word] = self.reach
            self.logits[got] = self.bucket_logits[subwords(word)].mean(axis=0)
            self.reach += 1
        return got


# --- training ------------------------------------------------------------------------------------------------------


def labelled_documents(documents: DataFrame, labels: DataFrame, areas: list[str], max_labelled: int) -> DataFrame:
    """doc_id, text, shares: per area the share of the document's annotators who named it. At most max_labelled rows."""
    given = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").select("doc_id", "subject", F.coalesce("annotator", F.lit("")).alias("annotator")).distinct()
    said = given.groupBy("doc_id").agg(F.count_distinct("annotator").alias("n"), F.collect_list("subject").alias("said"))
    named = lambda a: F.size(F.filter("said", lambda s: s == a)) / F.col("n")
    shares = F.array(*map(named, areas))
    said = said.select("doc_id", shares.alias("shares")).orderBy(F.xxhash64("doc_id")).limit(max_labelled)
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(said), "doc_id")  # bounded by max_labelled


def word_statistics(rows: DataFrame, n_areas: int) -> tuple[list[str], np.ndarray]:
    """The sample's words and, per word and area, the label mass of the documents that hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass: dict[str, np.ndarray] = {}
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["shares"], strict=True):
                y = np.asarray(y) / max(1e-9, float(np.sum(y)))
                for w in {w for s in sentences(t) for w in s}:
                    mass[w] = mass.get(w, 0) + y
        if mass:
            yield pd.DataFrame({"word": list(mass), "mass": [m.tolist() for m in mass.values()]})

    sums = [F.sum(F.col("mass")[i]) for i in range(n_areas)]
    got = rows.mapInPandas(run, "word string, mass array<double>").groupBy("word").agg(F.array(*sums).alias("mass")).collect()  # the bounded sample's words
    got.sort(key=lambda r: r["word"])
    return [r["word"] for r in got], np.asarray([r["mass"] for r in got], dtype=float).reshape(len(got), n_areas)


def informativeness(mass: np.ndarray) -> np.ndarray:
    """Divergence of a word's areas from the general mix, smoothed towards none for rare words."""
    prior = mass.sum(axis=0) + 1e-9
    prior /= prior.sum()
    q = (mass + SMOOTHING * prior) / (mass.sum(axis=1, keepdims=True) + SMOOTHING)
    return np.maximum((q * np.log(q / prior)).sum(axis=1), 0)


def _pack(rows, words: dict[str, int]):  # noqa: ANN001, ANN202
    """One partition as flat arrays: token ids, sentence starts, sentence's document, documents' shares. words has those that weigh."""
    tokens, starts, owner, shares = [], [], [], []
    for text, y in rows:
        for s in sentences(text):
            ids = [words[w] for w in s if w in words]
            if ids:
                starts.append(len(tokens))
                tokens += ids
                owner.append(len(shares))
        if owner and owner[-1] == len(shares):
            shares.append(y)
    if shares:
        yield np.asarray(tokens), np.asarray(starts), np.asarray(owner), np.asarray(shares, dtype=float)


def partition_gradient(packed: tuple, vectors: np.ndarray, weight: np.ndarray, out: np.ndarray, bias: np.ndarray) -> list[np.ndarray]:
    """Gradients of the sentences' logistic losses by word vectors, output weights and biases, summed over the partition."""
    tokens, starts, owner, shares = packed
    w = weight[tokens]
    scale = (np.add.reduceat(w, starts) + DAMPING)[:, None]
    x = np.add.reduceat(vectors[tokens] * w[:, None], starts, axis=0) / scale
    z = x @ out + bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    # each output on its own; a sentence counts by how much of it weighs
    g = np.minimum(scale - DAMPING, 1) * (p - shares[owner])
    back = np.repeat((g @ out.T) / scale, np.diff(np.append(starts, len(tokens))), axis=0) * w[:, None]
    dv = np.stack([np.bincount(tokens, back[:, k], minlength=len(vectors)) for k in range(vectors.shape[1])], axis=1)
    return [dv.astype(np.float32), (x.T @ g).astype(np.float32), g.sum(axis=0).astype(np.float32)]


def descend(gradient: Callable, names: list[str], weight: np.ndarray, n_areas: int, n_documents: int, steps: int = STEPS, seed: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """Adam on the synchronised gradients: (bucket vectors, output weights, biases) and the words' vectors."""
    grams = [subwords(w) for w in names]
    flat, size = np.concatenate(grams), np.asarray([len(g) for g in grams])
    starts, owner = np.cumsum(size) - size, np.repeat(np.arange(len(grams)), size)
    rng = np.random.default_rng(seed)
    params = [(rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32), np.zeros((DIM, n_areas), np.float32), np.full(n_areas, -2.0, np.float32)]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    vectors = np.add.reduceat(params[0][flat], starts, axis=0) / size[:, None]
    for step in range(steps):
        dv, *rest = gradient(vectors.astype(np.float32), weight, params[1], params[2])
        spread = (dv / size[:, None])[owner]
        grads = [np.stack([np.bincount(flat, spread[:, k], minlength=BUCKETS) for k in range(DIM)], axis=1), *rest]
        rate = RATE * min(1.0, 1.2 - step / steps)
        for i, g in enumerate(grads):
            g = (g / n_documents).astype(np.float32)
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g * g
            params[i] -= rate * (mean[i] / (1 - 0.9 ** (step + 1))) / (np.sqrt(var[i] / (1 - 0.99 ** (step + 1))) + 1e-8)
        vectors = np.add.reduceat(params[0][flat], starts, axis=0) / size[:, None]
    return params, vectors


def train(documents: DataFrame, labels: DataFrame, areas: list[str], max_labelled: int = MAX_LABELLED, steps: int = STEPS, seed: int = 5) -> AreaModel | None:
    rows = cut(labelled_documents(documents, labels, areas, max_labelled))
    names, mass = word_statistics(rows, len(areas))
    if not names:
        return None
    words, weight = {w: i for i, w in enumerate(names)}, informativeness(mass)
    sc = documents.sparkSession.sparkContext
    known = sc.broadcast({w: i for w, i in words.items() if weight[i] >= MUTE})
    n = max(1, rows.count())
    packed = rows.select("text", "shares").rdd.map(tuple).coalesce(-(-n // DOCS_PER_TASK)).mapPartitions(lambda it: _pack(it, known.value)).persist()

    def gradient(*state: np.ndarray) -> list[np.ndarray]:
        sent = sc.broadcast(state)
        total = packed.map(lambda x: partition_gradient(x, *sent.value)).treeReduce(lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
        sent.destroy()
        return total

    params, vectors = descend(gradient, names, weight, len(areas), n, steps, seed)
    packed.unpersist()
    return AreaModel(areas, words, weight, vectors @ params[1], params[0] @ params[1], params[2])


def area_sentences(documents: DataFrame, labels: DataFrame, subjects: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, subject, n_sentences of every area with a sentence in a document. subjects is a fixed table, read by the driver."""
    areas = sorted({r["subject"] for r in subjects.select("subject").collect() if r["subject"]})
    model = train(documents, labels, areas, max_labelled) if areas else None
    schema = "doc_id long, subject string, n_sentences long"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            counts = m.counts(list(pdf["text"]))
            d, a = np.nonzero(counts)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[d], "subject": [m.areas[i] for i in a], "n_sentences": counts[d, a]})

    return documents.select("doc_id", "text").mapInPandas(run, schema)


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, needed: int = NEEDED) -> DataFrame:
    """p9_found's columns."""
    return area_sentences(documents, labels, subjects).where(F.col("n_sentences") >= needed).select("doc_id", "subject")
