"""Feature functions as Spark columns: bucketing, hashing, sparse and dense vectors, one-hot, image arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The click-log feature layout.
NUMERIC_FEATURES = 13
CATEGORICAL_FEATURES = 26
NUMERIC_BUCKETS = 50
HASH_BUCKETS = 256
DENSE_WIDTH = NUMERIC_FEATURES * NUMERIC_BUCKETS + CATEGORICAL_FEATURES * HASH_BUCKETS
BOUNDARY_BASE = 1.5
BOUNDARY_SHIFT = 0.51


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucketize(value: str | Column, buckets: int = NUMERIC_BUCKETS) -> Column:
    """Index of the first boundary ``1.5^j - 0.51`` above the whole-number value; the last bucket is open.

    Zero and null give null, negative values bucket 0. A balanced tree of comparisons, about six per value, that Spark
    compiles; no logarithm, no array.
    """
    v = col(value).cast("bigint")
    # whole numbers: v < boundary is v <= floor(boundary)
    tops = [int(np.floor(BOUNDARY_BASE ** j - BOUNDARY_SHIFT)) for j in range(buckets)]

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v <= tops[mid], pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return F.when(v != 0, pick(0, buckets - 1))


def _murmur3_32(words: list[bytes]) -> np.ndarray:
    """MurmurHash3 x86 32-bit, seed 0, of many byte strings; strings of one length are hashed together."""
    out = np.zeros(len(words), dtype=np.uint32)
    lengths = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))

    def spin(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    def scramble(k: np.ndarray) -> np.ndarray:
        return spin(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        h = np.zeros(len(at), dtype=np.uint32)
        if n:
            raw = np.frombuffer(b"".join(words[i] for i in at), dtype=np.uint8).reshape(len(at), n)
            padded = np.zeros((len(at), -(-int(n) // 4) * 4), dtype=np.uint8)
            padded[:, :n] = raw
            lanes = padded.view("<u4")
            for lane in range(int(n) // 4):
                h = spin(h ^ scramble(lanes[:, lane]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
            if n % 4:
                h = h ^ scramble(lanes[:, -1])
        h = h ^ np.uint32(n)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[at] = h ^ (h >> np.uint32(16))
    return out.view(np.int32)


@F.pandas_udf(T.IntegerType())
def murmur3(text: pd.Series) -> pd.Series:
    """Signed 32-bit MurmurHash3 (seed 0) of UTF-8 text, null for null."""
    present = text.notna()
    hashed = _murmur3_32([t.encode("utf-8") for t in text[present]])
    result = pd.Series([None] * len(text), index=text.index, dtype="Int32")
    result[present] = hashed
    return result


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def murmur3_all(texts: pd.Series) -> pd.Series:
    """``murmur3`` over every element of an array column, all elements of a batch in one call."""
    counts = [len(t) for t in texts]
    flat = [x for t in texts for x in t]
    hashed = iter(_murmur3_32([x.encode("utf-8") for x in flat if x is not None]).tolist())
    filled = [None if x is None else next(hashed) for x in flat]
    ends = np.cumsum([0, *counts])
    return pd.Series([filled[a:b] for a, b in zip(ends[:-1], ends[1:])])


def md5_all(buckets: int) -> Callable[[Column], Column]:
    """``hash_bucket`` by ``md5`` over every element of an array column, each different text of a batch hashed once; null for null."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))))
        coded = texts.flatten().dictionary_encode()
        hashed = [int.from_bytes(md5(t.encode("utf-8")).digest()[:4], "big") % buckets for t in coded.dictionary.to_pylist()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashed, pa.int32()).take(coded.indices))
    return run


def _absent(c: Column) -> Column:
    return c.isNull() | c.isin("", "0")


def hash_bucket(value: str | Column, buckets: int = HASH_BUCKETS, algo: str = "xxhash64") -> Column:
    """Bucket number of a text; null for null, empty and zero.

    ``xxhash64`` is the fastest. ``md5`` takes the leading 32 bits of the digest, which other engines can repeat.
    ``murmur3`` gives the buckets of the original pipeline and runs in Python.
    """
    c = col(value).cast("string")
    if algo == "murmur3":
        number = F.pmod(murmur3(c), F.lit(buckets))
    elif algo == "md5":
        # when the bucket count divides a power of 16 the last hex digits decide
        digits = next((k for k in range(1, 8) if 16 ** k % buckets == 0), 8)
        number = F.conv(F.substring(F.md5(c), 9 - digits, digits), 16, 10).cast("bigint") % buckets
    elif algo == "xxhash64":
        number = F.pmod(F.xxhash64(c), F.lit(buckets))
    else:
        raise ValueError(f"unknown hash {algo!r}")
    return F.when(~_absent(c), number).cast("int")


def encode_row(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], algo: str = "xxhash64",
               buckets: int = NUMERIC_BUCKETS, hashes: int = HASH_BUCKETS, keep: Sequence[str] = ()) -> DataFrame:
    """Click row to (label, idx, val): sorted positions of the set features, each with value 1.0."""
    width = len(numeric) * buckets
    places = [bucketize(c, buckets) + f * buckets for f, c in enumerate(numeric)]
    if algo in ("murmur3", "md5") and categorical:
        # one call for all features: as an expression a feature, the row's code gets too long to be compiled well
        texts = F.array(*[F.when(~_absent(t), t) for t in (F.col(c).cast("string") for c in categorical)])
        df = df.withColumn("_h", murmur3_all(texts) if algo == "murmur3" else md5_all(hashes)(texts))
        hashed = [F.pmod(F.col("_h")[f], F.lit(hashes)) for f in range(len(categorical))]
    else:
        hashed = [hash_bucket(c, hashes, algo) for c in categorical]
    places += [h + width + f * hashes for f, h in enumerate(hashed)]
    # features own rising, disjoint ranges of positions, so the array is in order as built
    idx = F.array_compact(F.array(*places)).cast("array<bigint>")
    out = df.select(*keep, F.col(label).alias("label"), idx.alias("idx"))
    return out.withColumn("val", F.array_repeat(F.lit(1.0).cast("float"), F.size("idx")))


def encode_fields(df: DataFrame, fields: str, algo: str = "murmur3") -> DataFrame:
    """``encode_row`` for rows held as one array of texts (label first); a wrong width gives empty vectors.

    Adds ``malformed`` so that such rows can be counted.
    """
    want = NUMERIC_FEATURES + CATEGORICAL_FEATURES
    ok = F.size(fields) == want + 1
    cols = {f"_f{i}": F.when(ok, F.try_element_at(F.col(fields), F.lit(i + 1))) for i in range(want + 1)}
    wide = df.select(F.col(fields), *[c.alias(n) for n, c in cols.items()], ok.alias("_ok"))
    out = encode_row(wide, "_f0", [f"_f{i}" for i in range(1, NUMERIC_FEATURES + 1)],
                     [f"_f{i}" for i in range(NUMERIC_FEATURES + 1, want + 1)], algo, keep=["_ok"])
    empty = F.array().cast("array<bigint>")
    return out.select("label", F.when(F.col("_ok"), F.col("idx")).otherwise(empty).alias("idx"),
                      F.when(F.col("_ok"), F.col("val")).otherwise(F.array().cast("array<float>")).alias("val"),
                      (~F.col("_ok")).alias("malformed"))


def sparse_to_dense(idx: str | Column, val: str | Column, width: int) -> Column:
    """Scatter values into an array of zeros; repeated positions are an error."""
    cells = F.map_from_arrays(col(idx), col(val))
    zero = F.lit(0.0).cast("float")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda i: F.coalesce(F.try_element_at(cells, i.cast("bigint")), zero))


def dense_to_sparse(dense: str | Column) -> Column:
    """Struct of the positions and values that are not zero."""
    pairs = F.filter(F.transform(col(dense), lambda v, i: F.struct(i.cast("bigint").alias("i"), v.alias("v"))),
                     lambda p: p["v"] != 0)
    return F.struct(pairs["i"].alias("idx"), pairs["v"].alias("val"))


def one_hot(y: str | Column, classes: int) -> Column:
    """Row ``y`` of the identity matrix as small integers; all zeros when ``y`` is null or out of range."""
    place, zero = col(y).cast("int"), F.lit(0).cast("smallint")
    row = F.concat(F.array_repeat(zero, place), F.array(F.lit(1).cast("smallint")), F.array_repeat(zero, classes - 1 - place))
    return F.when(place.between(0, classes - 1), row).otherwise(F.array_repeat(zero, classes))


def argmax(a: str | Column) -> Column:
    """Position of the first maximum."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def label_index(df: DataFrame, label: str, prefix: str = "n", name: str = "label_id") -> DataFrame:
    """Add a dense 0-based number per label, in sorted label order, for labels that start with ``prefix``."""
    from mselect.operators.sequence import Ordered

    kept = df.where(F.col(label).startswith(prefix)) if prefix else df
    numbered = Ordered(kept.select(label).distinct(), [], [label]).position(name).done()
    return kept.join(numbered.withColumn(name, F.col(name).cast("int")), label)


def standardize(x: str | Column, mean: Sequence[float], std: Sequence[float], scale: float = 255.0) -> Column:
    """Scale, then subtract the channel mean and divide by the channel deviation; channels vary fastest."""
    means, stds = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    n = len(mean)
    return F.transform(col(x), lambda v, i: (v / F.lit(scale) - F.get(means, i % n)) / F.get(stds, i % n))


def channels_last_to_first(x: str | Column, height: int, width: int, channels: int) -> Column:
    """Reorder a flat (h, w, c) array to (c, h, w)."""
    plane = height * width
    return F.transform(F.sequence(F.lit(0), F.lit(plane * channels - 1)),
                       lambda i: F.get(col(x), (i % plane) * channels + F.floor(i / plane).cast("int")))


def normalize_array(x: str | Column, constant: float) -> Column:
    """Divide every element by a constant."""
    return F.transform(col(x), lambda v: v / F.lit(constant))
