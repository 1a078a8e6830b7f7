"""Decontamination against brute force over all pairs and alignments."""

import random
import re

import numpy as np

from mselect.llm import decontam, words
from mselect.llm.decontam import contaminated, overlap

import pyarrow as pa


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", (text or "").encode().lower())


def test_tokens_and_hashes():
    texts = [None, "", "One, two!", "x", "  Two one\n", "ÉA é", "two"]
    column = pa.array(texts)
    for size in (1, 5, 1000):
        got, flat = {}, []
        for row, hashes, first in decontam._tokens(column, words.Powers(), size):
            for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                got[row + i] = list(hashes[a:b])
        flat = [(w, h) for i, t in enumerate(texts) for w, h in zip(tokens(t), got[i], strict=True)]
        assert len(got) == len(texts) and len({h for _, h in flat}) == len({w for w, _ in flat}) == len(set(flat))


def test_overlap():
    a, b = np.arange(100), np.arange(40, 60)
    assert overlap(a, b, 40) == (0, 20, 20) and overlap(a, b, 39) == (0, 0, 0)
    c = b.copy()
    c[[0, 7]] = -1
    assert overlap(a, c, 40) == (1, 19, 18)
    assert overlap(a[:50], b, 40) == (0, 10, 10) and overlap(a[50:], b, -10) == (10, 10, 10)


def made(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_planted_passages_are_found_and_others_are_not(spark):
    rng = random.Random(1)
    items = {i: made(rng, rng.randint(14, 60)) for i in range(30)} | {90: made(rng, 4), 91: [], 92: made(rng, 9)}
    docs, want = {}, set()
    for d in range(200):
        doc = made(rng, rng.randint(0, 300))
        if d % 2:
            i = rng.choice([*range(30), 90, 92])
            copy = list(items[i])
            if i < 90:
                for place in range(rng.randint(3, 9), len(copy), 9):  # every ninth word replaced
                    copy[place] = "other"
            at = rng.randint(0, len(doc))
            doc[at:at] = copy
            want.add((d, i))
        docs[d] = doc
    text = {d: " ".join(w.upper() if rng.random() < 0.3 else w + rng.choice(["", ",", ".\n"]) for w in doc) for d, doc in docs.items()}
    rows = [(d, t, 1) for d, t in text.items()] + [(None, text[1], 1), (1, text[1], 1), (777, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(t), 5) for i, t in items.items()] + [(94, None, 5)], "item_id long, text string, doc_id int")
    got = contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} == want
    assert {r.item_id for r in got if r.doc_id is None} == {i for d, i in want if d == 1} and len(got) == len(want) + 1
    for r in got:
        if r.doc_id is not None:
            a, b = tokens(text[r.doc_id]), [w.encode() for w in items[r.item_id]]
            equal = sum(a[r.doc_start + k] == b[r.item_start + k] for k in range(r.n_overlap))
            assert equal == r.n_equal and r.n_item == len(b)


def test_hits_equal_brute_force(spark):
    """Small vocabulary, many chance hits: just the pairs that have a diagonal with a shared seed and a good overlap."""
    rng = random.Random(2)
    vocab = list("abc")
    items = [rng.choices(vocab, k=16) for _ in range(8)]
    docs = [rng.choices(vocab, k=120) for _ in range(60)] + [list("ab" * 100), list("ab" * 8)]
    items.append(list("ab" * 8))
    got = contaminated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
                       spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(items)], "item_id long, text string"), least=10).collect()
    want = {}
    for i, d in enumerate(docs):
        for j, b in enumerate(items):
            for shift in range(-15, len(d)):
                low, high = max(0, -shift), min(16, len(d) - shift)
                seeded = any(low <= p and p + len(m) <= high and all(x == "0" or d[p + shift + k] == b[p + k] for k, x in enumerate(m))
                             for m in decontam.MASKS for p in range(low, high))
                if seeded:
                    _, n, equal = overlap(np.array(d), np.array(b), shift)
                    if n and equal >= 0.75 * n and equal >= 10:
                        want[i, j] = max(want.get((i, j), 0), equal)
    assert {(r.doc_id, r.item_id): r.n_equal for r in got} == want and len(want) > 3


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contaminated(df.limit(0), bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []
    assert [tuple(r) for r in contaminated(df, bench).collect()] == [(1, 1, 3, 3, 0, 0, 3)]


def test_case_does_not_matter_in_any_language(spark):
    item = "ciónmiírr el ños ya ñuevo çà où straße дом ёлка λόγος οδός été naïve über øre łódź señor"
    docs = {1: item.upper(), 2: "x " + item.title() + " y", 3: item, 4: "other words " * 20, 5: "É" * 3}
    frames = [spark.createDataFrame(list(rows.items()), f"{key} long, text string") for key, rows in (("doc_id", docs), ("item_id", {7: item}))]
    got = {(r.doc_id, r.item_id, r.n_equal) for r in contaminated(*frames).collect()}
    assert got == {(d, 7, len(item.split())) for d in (1, 2, 3)}
    raw = pa.array([b"\xff\xc3\x89", b"\xff\xc3\xa9"], pa.binary()).view(pa.string())
    (_, hashes, _), = decontam._tokens(raw, words.Powers())
    assert hashes[0] == hashes[1]


def test_regular_replacement_and_short_items(spark):
    """Every fifth to ninth token replaced, at every phase; items of 2 to 12 tokens with each one token replaced."""
    rng = random.Random(3)
    items = {100: made(rng, 40)} | {n: [f"s{n}x{i}" for i in range(n)] for n in range(2, 13)}
    docs, want = [], set()

    def plant(item, replaced, found):
        copy = ["other" if i in replaced else w for i, w in enumerate(items[item])]
        docs.append(made(rng, 9) + copy + made(rng, 9))
        if found:
            want.add((len(docs) - 1, item))
    for period in range(5, 10):
        for phase in range(period):
            plant(100, set(range(phase, 40, period)), True)
    for n in range(2, 13):
        plant(n, set(), True)
        for i in range(n):
            plant(n, {i}, n >= 4)
        plant(n, set(range(0, n, 2)), n == 1)
    got = contaminated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
                       spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
