"""Token ids and counts with a tokenizer file of the ``tokenizers`` library.

Huge texts are encoded in overlapping chunks that are spliced where both encodings are proven right. The pattern of the byte-level
pre-tokenizer only looks forward, so from a pre-token boundary on the pre-tokens depend on what follows alone, and each
pre-token is encoded by itself. A chunk that began on a true boundary is therefore right up to any boundary after which it
still holds as many characters as the longest special token has, and from a boundary that a later chunk shares with it the
later chunk is right too. Without such a boundary in the overlap, the overlap is doubled.

Other texts go through ``tiktoken`` with the same vocabulary, which gives the same ids three times as fast, if they have only characters
whose class is the same in all Unicode versions that the two libraries may have, and no special string. All else is
encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array


import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from mselect.llm.common import arrow_map

#: All but characters that are assigned, and of one class, since Unicode 5.1. Control characters, which only some libraries take
#: for white space, are out too.
_UNSTEADY = re.compile("[^\t-\r -~\u00a0-\u024f\u0400-\u0482\u048a-\u0513\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3041-\u3096"
                       "\u30a1-\u30fa\u4e00-\u9fbb\uac00-\ud7a3]")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """A tokenizer in one Python worker. ``ids`` are little-endian unsigned 32-bit numbers in bytes.

    ``chunk`` and ``overlap`` are characters. No special tokens are added; special strings inside a text become what the library
    makes of them.
    """

    def __init__(self, path: str, chunk: int = 65_536, overlap: int = 1_024):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.chunk, self.overlap = chunk, overlap
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        #: whether splicing is exact for this tokenizer
        self.cuts = bool(pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and spec.get("normalizer") is None
                         and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added))
        self.reach = 1 + max(map(len, self.special), default=0)
        self.fast = self._same_ranks(spec["model"]) if self.cuts else None

    def _same_ranks(self, model: dict):
        """A ``tiktoken`` encoding if ids rise with the order of merges, so that it merges the same pairs in the same order."""
        letters, vocab = _byte_letters(), model.get("vocab", {})
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        order = [vocab.get("".join(p), -1) for p in pairs]
        if model.get("type") != "BPE" or model.get("ignore_merges") or order != sorted(set(order)) or not order or (
                order[0] <= max(vocab.get(c, 1 << 40) for c in letters)):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in self.special}
        return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _one(self, text: str) -> bytes:
        if len(text) > self.chunk and self.cuts:
            return self.spliced(text)
        if self.fast and not _UNSTEADY.search(text) and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [self._one(t) for t in texts]

    def _marks(self, text: str) -> tuple[bytes, dict[int, int]]:
        """The ids of a chunk, and for every pre-token the character it starts at and the number of ids before."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        marks, last = {}, None
        for i, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets)):
            if word is None or word != last:
                marks[start] = i
            last = word
        return array("I", e.ids).tobytes(), marks

    def spliced(self, text: str) -> bytes:
        """The ids of a text of any length from overlapping chunks."""
        done: list[bytes] = []
        at, size, overlap = 0, self.chunk, self.overlap  # ``at`` is a true boundary
        ids, marks, skip, origin = *self._marks(text[: size + overlap]), 0, 0
        end = min(len(text), size + overlap)
        while end < len(text):
            start = max(at + 1, end - overlap)
            next_end = min(len(text), start + size + overlap)
            next_ids, next_marks = self._marks(text[start:next_end])
            common = [q for q in next_marks if at < q + start <= end - self.reach and q + start - origin in marks]
            if common:
                q = max(common)
                cut = marks[q + start - origin]
                done.append(ids[4 * skip: 4 * cut])
                ids, marks, skip, origin, at, end, overlap = next_ids, next_marks, next_marks[q], start, q + start, next_end, self.overlap
            else:  # no boundary in common: the same true start, twice the overlap
                overlap *= 2
                end = min(len(text), max(end, at + size) + overlap)
                (ids, marks), skip, origin = self._marks(text[at:end]), 0, at
        done.append(ids[4 * skip:])
        return b"".join(done)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, **options) -> Encoder:
    """This worker's encoder for a file."""
    key = (path, *sorted(options.items()))
    if key not in _encoders:
        _encoders[key] = Encoder(path, **options)
    return _encoders[key]


def _texts(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512,
                 chunk: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; a null text is empty and has no token.

    Other columns aren't read; rows with null or repeated keys stay as they are.
    """
    def run(batch: pa.RecordBatch) -> dict:
        lengths = pa.compute.binary_length(batch.column(1)).fill_null(0)
        counts = np.array([len(x) // 4 for x in encoder(path, chunk=chunk, overlap=overlap).ids(_texts(batch.column(1)))], np.int64)
        return {key: batch.column(0), "n_bytes": lengths.cast(pa.int64()), "n_tokens": pa.array(counts),
                "over_limit": pa.array(counts > limit)}
    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text",
                 chunk: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """(key, piece, start, length, ids): each text's ids and ``end_id``, in one piece, or if longer cut to ``capacity``.

    Of a text that is cut the first piece may be shorter. A null text is empty: one piece with ``end_id`` alone.
    """
    end = array("I", [end_id]).tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        rows, piece, start, ids = [], [], [], []
        for row, own in enumerate(encoder(path, chunk=chunk, overlap=overlap).ids(_texts(batch.column(1)))):
            own += end
            total = len(own) // 4
            first = total if total <= capacity else total % capacity or capacity
            for n, at in enumerate([0, *range(first, total, capacity)]):
                rows.append(row)
                piece.append(n)
                start.append(at)
                ids.append(own[4 * at: 4 * (at + capacity if n else first)])
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        return {key: batch.column(0).take(pa.array(rows)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(lengths), "ids": pa.array(ids, pa.binary())}
    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), run, f"{key} {kind}, piece int, start long, length long, ids binary")
