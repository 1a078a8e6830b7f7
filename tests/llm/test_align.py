"""Token alignment against brute force over all documents."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mselect.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}


def brute(texts):
    """The seven numbers and the digest of each text, token by token."""
    a_lib, b_lib, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letters()
    a_lib.encode_special_tokens = True
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        e = a_lib.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(byte[c] for c in a_lib.id_to_token(i)) if i != 50256 else a_lib.id_to_token(i).encode()) for i in e.ids]
        b = []
        for i in b_lib.encode(text):
            piece = b_lib.id_to_piece(i)
            b.append((i, bytes.fromhex(piece[3:5]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("\u2581", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append(None)
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for lo, hi, i in spans[0]:
            while spans[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < hi:
                links.append((i, spans[1][k][2]))
                k += 1
        ends = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        parts, lo = [], 0
        for hi in ends:
            parts.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in spans))
            lo = hi
        docs.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    count = Counter(p for d in docs if d for p in set(d[3]))
    most = {}
    for (i, _), n in count.items():
        most[i] = max(n, most.get(i, 0))
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (
        *d[:3], len(d[3]), sum(count[p] == most[p[0]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) for d in docs]


ODD = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> in <s> text </s>", "naïve café 東京 \U0001f600\u200d", "tab\tnew\nline\r\n", "x" * 3000, "\u2581 mark",
       "\x00\x01", "ﬁ ligature", "<0x41>", "same text", "same text", "1234567890 " * 50]


@pytest.mark.parametrize("spill,fan_in", [(1_500_000, 64), (200, 2), (1, 3)])
def test_odd_texts(spark, spill, fan_in):
    df = spark.createDataFrame([(i if i % 5 else None, i, t, 0) for i, t in enumerate(ODD)], "doc_id long, n long, text string, radix int")
    out = align.align(df.withColumn("doc_id", F.col("n")).repartition(3), A, B, spill=spill, fan_in=fan_in).orderBy("doc_id")
    assert [tuple(r)[1:] for r in out.collect()] == brute(ODD)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    got = align.align(docs.repartition(4), A, B, spill=3000, fan_in=4).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(d.doc_id, *x) for d, x in zip(rows, brute([d.text for d in rows]))]


def test_null_and_repeated_keys_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, "one"), (1, "one"), (1, "one"), (1, None)], "doc_id long, text string")
    assert sorted(r.count_sum for r in align.align(df, A, B).collect()) == [0, 3, 3, 3]
    assert align.align(df.limit(0), A, B).collect() == []


def test_merge_adds_up_runs():
    rng = random.Random(1)
    total, runs = Counter(), []
    for n in (0, 1, 5000, 40_000, 40_000):
        own = Counter(rng.randrange(60_000) << 32 | rng.randrange(3) for _ in range(n))
        total.update(own)
        keys = np.array(sorted(own), np.int64)
        runs.append(align.blocks(keys, np.array([own[int(k)] for k in keys], np.int64)))
    got = [(int(p), int(c)) for pairs, counts in align.merge(runs) for p, c in zip(pairs, counts)]
    assert got == sorted(total.items())


def test_pack():
    x = np.array([0, -5, 1 << 40, 7], np.int64)
    assert [c.tolist() for c in align.unpack(align.pack(x, x[:1], x[:0]), 3)] == [x.tolist(), [0], []]
