"""MinHash near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mselect.llm import linking, minhash
from .test_simhash import signed


def plain_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows, similar=85):
    """(shingles, smallest id reachable) of each row, by trying all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= similar * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        own = [x for x in ids[find(i)] if x is not None]
        out.append((k, len(sets[i]), min(own) if own else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component) for r in df.collect()), key=repr)


def altered(rng, words, share):
    return [rng.choice("xyz") + w if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c", "A b  c", "a b c d", "é Ä ß", "É ä ß"] + ["same text of a large group"] * 30
    for _ in range(12):
        base = rng.choices(vocab, k=rng.choice([9, 40, 150]))
        texts += [" ".join(altered(rng, base, rng.choice([0, .005, .01, .02, .05]))) for _ in range(8)]
        texts.append(" ".join(base[:-1]))
    # a chain whose ends are unlike each other
    chain = [f"c{i}" for i in range(100)]
    for i in range(25):
        texts.append(" ".join(chain[i:i + 70]))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = corpus(seed) + [(5, "other text with an id that is there"), (None, "a b c"), (None, "only this one has no id"), (7, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in rows], "doc_id long, text string, node int, key int, component string")
    out = minhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "n_shingles", "component", "kept"]
    assert got(out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component) for r in out.where("doc_id IS NOT NULL").collect())


def test_a_long_text_and_its_copy(spark):
    long = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:290_000])), (3, " ".join(long[:200_000])), (4, "short")]
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == [
        (1, 299_998, 1), (2, 289_998, 1), (3, 199_998, 3), (4, 1, 4)]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("distance,chunks", [(23, 12), (11, 12), (20, 8)])
def test_signatures_within_the_distance_share_an_entry(distance, chunks):
    rng = np.random.default_rng(3)
    choices = minhash.chunk_choices(distance, chunks)
    base = rng.integers(0, 256, (1, minhash.PLACES), dtype=np.uint8)
    for _ in range(300):
        other = base.copy()
        at = rng.choice(minhash.PLACES, distance, replace=False)
        other[0, at] += rng.integers(1, 256, distance, dtype=np.uint8)
        a, b = (minhash.entry_keys(x, choices)[0] for x in (base, other))
        assert (a == b).any() and {int(k) & 1023 for k in a} == set(range(len(choices)))
    far = rng.integers(0, 256, (1, minhash.PLACES), dtype=np.uint8)
    assert not (minhash.entry_keys(base, choices) == minhash.entry_keys(far, choices)).any()


def test_differing_places(spark):
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 256, (50, 2, minhash.PLACES), dtype=np.uint8)
    pairs[::2, 1, ::3] = pairs[::2, 0, ::3]
    names = [f"{s}_q{i}" for s in "ab" for i in range(8)]
    df = spark.createDataFrame([tuple(int(v) for v in p.reshape(-1).view(np.int64)) for p in pairs], ", ".join(f"{n} long" for n in names))
    assert [r[0] for r in df.select(minhash.differing("a_", "b_")).collect()] == [int((p[0] != p[1]).sum()) for p in pairs]


def test_links_of_similar_sets_are_found(spark):
    """Pairs just above the threshold are in reach of the signatures."""
    rng = random.Random(9)
    rows = []
    for i in range(0, 400, 2):
        base = [f"w{rng.randrange(10**9)}" for _ in range(140)]
        rows += [(i, " ".join(base)), (i + 1, " ".join(base[:122]))]
    out = {r.doc_id: r.component for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == i - i % 2 for i in out)


def test_bit_table(spark):
    values = [signed(x) for x in (0, 5, (1 << 64) - 1, 1 << 63, 123456789)]
    table = linking.bit_table(spark.createDataFrame([(v,) for v in values], "h long"))
    assert linking.may_hold(table, np.array(values)).all() and not linking.may_hold(table, np.array([6, 77])).any()
    assert not linking.bit_table(spark.range(0).select(F.col("id").alias("h"))).any()
