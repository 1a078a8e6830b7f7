"""Token counts and pieces against the tokenizers library on whole texts."""

import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mselect.llm.tokens import Encoder, token_counts, token_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n", "a  b", "It's we'll  DON'T\t\tx ", "héllo wörld ß 数字 123abc", "<|endoftext|>", "a  <|endoftext|> b<|endoftext|>",
    "x\x1c y\x85z᠎ w", "😀 emoji 👩‍👩‍👧 zwj", "  lead", "trail  ", "a b", "word " * 3000, "x" * 5000, "ab \n" * 2000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts(spark, library):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "no key", 7), (1, "again", 7)],
                               "doc_id long, text string, n_tokens int")
    got = token_counts(df, PATH, limit=100).collect()
    want = sorted((i, len((t or "").encode()), len(whole(library, t)), len(whole(library, t)) > 100)
                  for i, t in [*enumerate(TEXTS), (-1, "no key"), (1, "again")])
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    assert token_counts(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (64, 30), (200, 20)])
def test_spliced_chunks_equal_the_whole(library, chunk, overlap):
    rng = random.Random(chunk)
    parts = ["word", " the", "  ", "\n", "<|endoftext|>", "<|endof", "é", "数", "😀", "'s", "1234", "!!!", "\t", "x" * 90, " y"]
    e = Encoder(PATH, chunk=chunk, overlap=overlap)
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randint(0, 200)))
        assert list(array("I", e.spliced(text))) == whole(library, text)


def test_other_tokenizers_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    e = Encoder(path, chunk=10)
    assert not e.cuts and list(array("I", e.ids(["Some Words here, and more"])[0])) == whole(library, "Some Words here, and more")


def test_pieces(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = token_pieces(df, PATH, 16, 2).collect()
    for i, t in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = [x for r in own for x in array("I", bytes(r.ids))]
        assert ids == [*whole(library, t), 2]
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 16 for r in own[1:]) and 1 <= own[0].length <= 16
        assert len(own) == 1 or len(ids) > 16
    assert zlib.crc32(bytes(rows[0].ids)) >= 0
