"""A scan of every document with every passage, sharing no code with the library: python -m tests.llm.scan sf0.1

Its own reading of texts (a character at a time), its own alignment (edit distance over all words of a document, one row per
passage word). Prints how many of the scan's cases the search finds.
"""

import html
import re
import sys
import unicodedata
from collections import Counter
from multiprocessing import Pool

import duckdb
import numpy as np

INLINE = {"b", "i", "u", "s", "a", "em", "strong", "span", "mark", "code", "sub", "sup", "small", "font", "kbd", "del", "ins", "q"}


def _strip_tags(t):
    out, i = [], 0
    while i < len(t):
        if t.startswith("<!--", i) and (j := t.find("-->", i)) >= 0:
            out.append(" ")
            i = j + 3
            continue
        name = re.compile(r"</?([A-Za-z][\w-]*)").match(t, i) if t[i] == "<" else None
        if name:
            j, quote = name.end(), ""
            while j < len(t) and (quote or t[j] not in "<>"):
                if quote:
                    quote = "" if t[j] == quote else quote
                elif t[j] in "\"'" and t[j - 1] == "=":
                    quote = t[j]
                j += 1
            if j < len(t) and t[j] == ">":
                out.append("" if name[1].lower() in INLINE else " ")
                i = j + 1
                continue
        out.append(t[i])
        i += 1
    return "".join(out)


def _links(t):
    t = re.sub(r"\[\^[^\]\s]+\]", "", t)
    t = re.sub(r"\[\[[^\[\]|\n]*\|([^\[\]\n]*)\]\]", lambda m: m[1], t)
    out, at = [], 0
    for m in re.finditer(r"\[([^\[\]]*)\]\(", t):
        if m.start() < at:
            continue
        depth, j = 1, m.end()
        while j < len(t) and depth and t[j] != "\n":
            depth += (t[j] == "(") - (t[j] == ")")
            j += 1
        if not depth:
            out += (t[at : m.start()], m[1])
            at = j
    return "".join((*out, t[at:]))


def read(text):
    t = unicodedata.normalize("NFKD", html.unescape(text or ""))
    t = "".join(c for c in t if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cf")
    t = _strip_tags(_links(t)).casefold()
    t = "".join(c for c in t if c not in "*_`~=")
    t = re.sub(r"(\w)[-‐][ \t]*[\r\n]+[\s>|]*(?=\w)", r"\1", t)
    t = re.sub(r"(\w)[-‐](?=\w)", r"\1", t)
    return "".join(c if c.isalnum() else " " for c in t).split()


def joined(words, vocabulary):
    """Pairs of neighbours that only together are a word of the passages."""
    out, i = [], 0
    while i < len(words):
        if i + 1 < len(words) and words[i] + words[i + 1] in vocabulary and not (words[i] in vocabulary and words[i + 1] in vocabulary):
            out.append(words[i] + words[i + 1])
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


def holds(passage, ids, least=12, per=8):
    """Whether a run of passage words aligns with a run of the document, both ends matching, edits on at most one word in `per`.

    state[e][j]: most passage words of an alignment ending at document word j with e edits.
    """
    top, n = len(passage) // per, len(ids)
    none = np.int16(-9999)
    prev = np.full((top + 1, n + 1), none, dtype=np.int16)
    for w in passage:
        cur = np.full((top + 1, n + 1), none, dtype=np.int16)
        hit = np.flatnonzero(ids == w) + 1
        for e in range(top + 1):
            if len(hit):
                m = np.maximum(prev[e, hit - 1], 0 if e == 0 else none) + 1
                if (m >= max(least, per * e)).any():
                    return True
                cur[e, hit] = np.maximum(cur[e, hit], m)
            if e:
                cur[e] = np.maximum(cur[e], prev[e - 1] + 1)
                cur[e, 1:] = np.maximum(cur[e, 1:], prev[e - 1, :-1] + 1)
                cur[e, 1:] = np.maximum(cur[e, 1:], cur[e - 1, :-1])
        prev = cur
    return False


def parts(own, ids, passage_length):
    """Where a case can lie at all: around 14 words of which 10 are the passage's (12 passage words in a row with at most two edits).

    own marks the document's words that the passage has.
    """
    n = len(ids)
    sums = np.concatenate([[0], np.cumsum(own)])
    width = min(14, n)
    good = np.flatnonzero(sums[width:] - sums[:-width] >= 10)
    margin, out = passage_length * 9 // 8 + 2, []
    for g in good.tolist():
        a, b = max(0, g - margin), min(n, g + width + margin)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def passages(items):
    """Passage words without a first sentence that five distinct passages share -> items."""
    texts = sorted({p for _, p in items if p})
    first = {p: re.split(r"(?<=[.!?])\s+", p.strip(), maxsplit=1) for p in texts}
    seen = Counter(" ".join(read(f[0])) for f in first.values())
    out = {}
    for p, f in first.items():
        own = read(f[1] if len(f) > 1 else "") if seen[" ".join(read(f[0]))] >= 5 else read(p)
        if len(own) >= 12:
            out.setdefault(tuple(own), set()).update(i for i, q in items if q == p)
    return out


def cases(documents, items, processes=8):
    known = passages(items)
    vocabulary = {w: i for i, w in enumerate(sorted({w for p in known for w in p}))}
    wanted = []
    for p, i in known.items():
        member = np.zeros(len(vocabulary) + 1, dtype=bool)  # the last entry is for words of no passage
        member[[vocabulary[w] for w in p]] = True
        wanted.append(([vocabulary[w] for w in p], member, sorted(i)))
    global _one

    def _one(doc):
        ids = np.array([vocabulary.get(w, -1) for w in joined(read(doc[1]), vocabulary)], dtype=np.int32)
        return [(doc[0], i) for p, member, its in wanted if any(holds(p, ids[a:b]) for a, b in parts(member[ids], ids, len(p))) for i in its]

    if processes < 2:
        return {c for d in documents for c in _one(d)}
    with Pool(processes) as pool:
        return {c for got in pool.imap_unordered(_call, documents, chunksize=20) for c in got}


def _call(doc):
    return _one(doc)


def load(d):
    con = duckdb.connect()
    return con.execute(f"SELECT doc_id, text FROM '{d}/documents.parquet' WHERE text IS NOT NULL").fetchall(), con.execute(f"SELECT DISTINCT item_id, passage FROM '{d}/bench_items.parquet'").fetchall()


if __name__ == "__main__":
    import multiprocessing

    multiprocessing.set_start_method("fork")
    folder = f"/root/testdata/{sys.argv[1]}"
    want = cases(*load(folder))
    from pyspark.sql import SparkSession

    from lodestrata.llm import queries

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    got = {tuple(r) for r in queries.p8_found(spark, folder).collect()}
    print(sys.argv[1], "scan", len(want), "search", len(got), "both", len(want & got), "recall", round(len(want & got) / max(1, len(want)), 4))
    print("only scan", sorted(want - got)[:5], "only search", sorted(got - want)[:5])
