"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from mselect.llm import search


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, top=10):
    own = [(k, Counter(terms(t))) for k, t in docs]
    n = sum(bool(c) for _, c in own)
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for k, t in items:
        asked.setdefault(k, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for k, c in own:
            m = 10 + (90 * sum(c.values()) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, k is None, k))
        out += [(item, r + 1, k, -s) for r, (s, _, k) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def made(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "é", "naïve", "x1y"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(40)] + [(n + 50, None), (n + 51, ""), (n + 52, " .,;"), (None, "w1 w2 É"), (3, "w5 w6"), (n + 60, "W1-w2/W3 " * 900)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocab, weights, k=rng.choice([1, 3, 12, 40])))) for i in range(30)]
    return docs, items + [(90, None), (91, "..."), (92, "unseen"), (93, "w1"), (93, "w2 w3"), (94, "W1 É")]


@pytest.mark.parametrize("seed,rows,block", [(1, 8192, 200_000), (2, 7, 20), (3, 64, 100)])
def test_search(spark, seed, rows, block):
    docs, items = made(seed)
    d = spark.createDataFrame([(k, t, 1, "r") for k, t in docs], "doc_id long, text string, score int, rank string").repartition(3)
    out = search.search(d, spark.createDataFrame(items, "item_id long, text string"), block_terms=block, segment_rows=rows)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame(x, f"{k} long, text string") for x, k in (([(1, "a")], "doc_id"), ([(1, "a")], "item_id")))
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_one_segment_with_bounds(seed):
    """The heap gives what sorting gives, also with scores known before; the table gives the range's highest impact."""
    rng = np.random.default_rng(seed)
    size, n_terms = 500, 12
    held = rng.random((n_terms, size)) < rng.random((n_terms, 1))
    term, rows = np.nonzero(held)
    impacts = rng.integers(0, 6, len(term)) * rng.integers(1, 50, n_terms)[term]
    lists = search.Postings(term, rows, impacts, size)
    dense = np.zeros((n_terms, size), np.int64)
    dense[term, rows] = impacts
    lo = rng.integers(0, size, 40)
    hi = np.minimum(size, lo + rng.integers(1, size, 40))
    at = lists.highest(np.arange(n_terms), lo, hi)
    for t in range(n_terms):
        for i, (a, b) in enumerate(zip(lo, hi)):
            assert (at[t, i] >= 0) == held[t, a:b].any() and (at[t, i] < 0 or lists.impacts[at[t, i]] == dense[t, a:b].max())
    asked = rng.choice(n_terms, 5, replace=False)
    scores = dense[asked].sum(axis=0)
    want = sorted(((int(s), d) for d, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))
    assert lists.best(asked, 10, []) == want[:10]
    known = [s + 1 for s, _ in want[:6]]
    assert [x for x in lists.best(asked, 10, known) if x[0] > want[9][0]] == [x for x in want[:10] if x[0] > want[9][0] and x in lists.best(asked, 10, known)]
    assert set(want[:4]) <= set(lists.best(asked, 10, known))
