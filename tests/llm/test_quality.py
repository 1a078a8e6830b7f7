"""Quality rules against counts and a likelihood ratio in plain Python."""

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from mselect.llm import quality
from mselect.llm.quality import BUCKETS, PRIOR, judge, ratios

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi pi rho sigma tau phi chi psi omega".split()
TEXTS = [
    None, "", "  \n ", "short text", " ".join(WORDS), " ".join(WORDS * 2), "x " * 100, "\n".join(["same line", "", "same line", " ", "same line "]),
    "#*$%&|<> é" * 30, " ".join(WORDS) + "\n" + " ".join(WORDS[:9]) + " end", "\x0b".join(WORDS), " ".join(f"w{i}" for i in range(3000)),
    "a b c d e f g h a b c d e f g h a b c d e f g h i", "é ü\xa0x " * 7,
]


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_counts_scores_and_verdicts(spark):
    rows = [(i, t, -1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], -1), (4, TEXTS[4], -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    trusted = spark.createDataFrame([(4,), (11,), (4,), (None,), (77,)], "doc_id long")
    got = judge(docs, trusted, -0.05).collect()
    assert len(got) == len(rows)
    pairs = {tuple(r) for r in spark.createDataFrame([(a, b) for t in TEXTS for w in [(t or "").split()] for a, b in zip(w, w[1:])] or [("a", "b")],
             "a string, b string").distinct().select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b"))).collect()}
    two = {(a, b): h % BUCKETS for a, b, h in pairs}
    one = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) % BUCKETS
    last = {w: h % BUCKETS for w, h in spark.createDataFrame([(w,) for t in TEXTS for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")], "w string")
            .distinct().select("w", F.xxhash64(F.xxhash64("w"))).collect()}

    def buckets(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return [one(x) for x in w] + [two.get((a, b)) for a, b in zip(w, w[1:])] + ([last[w[-1]]] if w else [])

    usable = {t for t in TEXTS if None not in buckets(t)}
    assert usable >= {TEXTS[4], TEXTS[5], TEXTS[11], TEXTS[12]}
    ours, every = Counter(), Counter()
    for i, t, _ in rows:
        every.update(buckets(t))
        if i in (4, 11):
            ours.update(buckets(t))
    n_ours, n_all = sum(ours.values()) + PRIOR, sum(every.values()) + BUCKETS

    def ratio(x):
        raw = (every[x] + 1) / n_all
        return math.log((ours[x] + PRIOR * raw) / n_ours / raw)

    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        if r.text in usable and r.n_words:
            b = buckets(r.text)
            want = sum(map(ratio, b)) / len(b)
            assert r.score == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score is not None and r.score >= -0.05)
    assert {r.score for r in got if r.text is None} == {None}
    assert next(r for r in got if r.doc_id == 11).kept


def test_no_trusted_documents_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert ratios(docs, none).count() == BUCKETS
    assert judge(docs, none, 0.0).collect()[0].score == pytest.approx(0)
    assert judge(docs.limit(0), none, 0.0).collect() == []


def test_runs_without_python_functions(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = quality.counted(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_filter_on_the_verdict_takes_a_text_apart_once(spark):
    docs = spark.createDataFrame([(1, " ".join(WORDS)), (2, "short")], "doc_id long, text string")
    kept = judge(docs, docs.select("doc_id"), -1.0).where("kept").select("doc_id", "text")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.doc_id for r in kept.collect()] == [1]
