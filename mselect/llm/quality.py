"""Quality rules in DataFrame functions alone: repetition counts, and a log-likelihood ratio of hashed n-grams.

Words and pairs of words are hashed to buckets, which have two multinomials: one of all documents, smoothed by one a bucket, and one of
trusted documents, smoothed by ``PRIOR`` n-grams as all documents have them, so that little trusted text says little. A document's score is the mean log ratio of its n-grams, and one fixed threshold decides. Every document counts
and is scored whole; the only thing that is gathered is one number a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mselect.llm.common import written

BUCKETS = 1 << 16  # a power of two
PRIOR = 4 * BUCKETS
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def words(text: str) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")


def repeated_words(hashes: Column, width: int = 8) -> Column:
    """How many words are in windows of ``width`` words that the text has twice or more."""
    n = F.size(hashes)
    found = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, width)))

    def covered(windows: Column) -> Column:
        rows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(at: Column) -> Column:
            twice = F.filter(at, lambda x, k: F.coalesce((F.get(at, k - 1)["h"] == x["h"]) | (F.get(at, k + 1)["h"] == x["h"]),
                                                         F.get(at, k - 1)["h"] == x["h"], F.get(at, k + 1)["h"] == x["h"], F.lit(False)))
            start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
            return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), start, lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(rows, places))
    return F.when(n < width, F.lit(0)).otherwise(let(found, covered))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repetition(hashes: Column) -> Column:
    """A struct of n_words and n_repeat_words."""
    return F.struct(F.size(hashes).cast("long").alias("n_words"), repeated_words(hashes).cast("long").alias("n_repeat_words"))


def counted(docs: DataFrame, text: str = "text", fields: Callable[[Column], Column] = repetition) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, and all fields of the struct that ``fields`` makes of the words' hashes.

    The hashes are one lambda variable. Spark moves a filter on these columns below them and puts their expressions in its place, once for
    each use, and inside a lambda once for each word; so a verdict to filter by is to be a field, not made of the columns.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_words", words(text)).withColumn("_fields", let(F.transform("_words", lambda w: F.xxhash64(w)), fields))
    return rows.withColumns({
        "n_words": F.col("_fields.n_words"), "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": duplicate_lines(whole).cast("long"), **{c: F.col(f"_fields.{c}") for c in rows.schema["_fields"].dataType.names},
    }).drop("_words", "_fields")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def pairs(hashes: Column) -> Column:
    """The buckets of all pairs of neighbours."""
    return F.transform(hashes, lambda h, i: _bucket(F.xxhash64(h, F.get(hashes, i + 1))))


def grams(hashes: Column) -> Column:
    """The buckets of all words, then of all pairs of neighbours."""
    return F.concat(F.transform(hashes, _bucket), pairs(hashes))


#: Bits of the table that tells which rows may be trusted, whatever their number; false hits cost a few bytes a word, nothing else.
MAYBE_BITS = 1 << 20


def may_be(keys: DataFrame, key: str) -> Column:
    """Whether a row's ``key`` may be one of ``keys``: a table of bits in the plan, of at most ``MAYBE_BITS`` / 64 gathered words."""
    place = F.xxhash64(key).bitwiseAND(MAYBE_BITS - 1)
    bits = keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 AS int))").alias("bit"))
    table = [0] * (MAYBE_BITS // 64)
    for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        table[r["word"]] = r["bits"]
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    word = F.get(constant, F.shiftright(place, 6).cast("int"))
    return F.col(key).isNotNull() & (word.bitwiseAND(F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 AS int))")) != 0)


def ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, ratio): the log ratio of the trusted documents' multinomial to that of all. ``trusted`` has the keys to trust.

    Rows that can't be trusted are counted where they are read. Only those that may be, by ``may_be``, meet ``trusted``, as buckets of two bytes; no text moves.
    """
    chosen = written(trusted.select(key).where(F.col(key).isNotNull()).distinct(), "trusted")
    maybe = may_be(chosen, key)
    own = let(F.transform(words(text), lambda w: F.xxhash64(w)), grams)
    apart = docs.where(~maybe).select(F.explode(own).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("all"))
    short = F.transform(own, lambda b: (b - BUCKETS // 2).cast("smallint"))
    # always this join, so that what moves doesn't depend on the number of labels
    flags = chosen.withColumn("_trusted", F.lit(1)).hint("merge")
    near = docs.where(maybe).select(key, short.alias("_short")).join(flags, key, "left")
    near = near.select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), F.explode("_short").alias("_b")).groupBy("_b").agg(
        F.count(F.lit(1)).alias("all"), F.sum("_trusted").alias("ours"))
    near = near.select((F.col("_b").cast("int") + BUCKETS // 2).alias("bucket"), "all", "ours")
    counts = apart.withColumn("ours", F.lit(0).cast("long")).unionByName(near).groupBy("bucket").agg(F.sum("all").alias("all"), F.sum("ours").alias("ours"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    every = written(every, "buckets")
    sums = every.agg(F.sum("all").alias("n_all"), F.sum("ours").alias("n_ours")).first()  # two numbers
    raw = (F.col("all") + 1) / F.lit(float(sums["n_all"] + BUCKETS))
    ours = (F.col("ours") + PRIOR * raw) / F.lit(float(sums["n_ours"] + PRIOR))
    return every.select("bucket", F.log(ours / raw).alias("ratio"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the counts, score, base_failed and kept of each row.

    base_failed: under 20 words, or over 30 % of them in repeated windows. kept: not that, and a score of ``threshold`` at least. A text
    without words has no score and fails. Null texts have no words; rows with null keys are scored, but can't be trusted; repeated rows are
    judged alike. Columns of ``docs`` with the names of new ones are replaced. Without trusted documents all n-grams score 0.
    """
    # one number a bucket, whatever the input: a constant of the plan
    table = [0.0] * BUCKETS
    for r in ratios(docs, trusted, key, text).collect():
        table[r["bucket"]] = r["ratio"]
    constant = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")

    def fields(hashes: Column) -> Column:
        # words, then pairs, added without arrays of their scores
        ones = F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(constant, _bucket(h)))
        score = F.aggregate(pairs(hashes), ones, lambda a, b: a + F.get(constant, b)) / F.nullif(2 * F.size(hashes), F.lit(0))

        def verdict(x: Column) -> Column:
            failed = (x["n"]["n_words"] < 20) | (100 * x["n"]["n_repeat_words"] > 30 * x["n"]["n_words"])
            kept = ~failed & F.coalesce(x["score"] >= threshold, F.lit(False))
            return F.struct(*(x["n"][c].alias(c) for c in ("n_words", "n_repeat_words")), x["score"].alias("score"), failed.alias("base_failed"), kept.alias("kept"))
        return let(F.struct(repetition(hashes).alias("n"), score.alias("score")), verdict)
    return counted(docs, text, fields)
