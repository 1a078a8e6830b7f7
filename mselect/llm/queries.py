"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mselect.llm import align, chat, ctw, decontam, html, minhash, packing, quality, search, sharding, simhash, tokens, warc
from mselect.llm.common import shared_path, written
from mselect.llm.registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document that links lead to."""
    out = simhash.near_duplicates(table(spark, folder, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokens.token_counts(table(spark, folder, "documents"), vocabulary(), limit=512)


def packed(docs: DataFrame) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    pieces = tokens.token_pieces(docs, vocabulary(), capacity=1024, end_id=2)
    digests = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(digests, 1024, ["doc_id", "piece", "start", "ids_crc32"])


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in as few sequences as the plan needs."""
    return packed(table(spark, folder, "documents"))


@query
def op4_lpt_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of eight shards of nearly equal bytes, equal texts together."""
    out = sharding.shard(table(spark, folder, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as legacy archives, converted to WARC, written, and read back."""
    archives = warc.pages_to_arc(table(spark, folder, "pages"))
    marked = warc.mark_revisits(warc.arc_records(archives))
    path = shared_path(archives, "warc")
    warc.write_warc(marked, path)
    return warc.read_warc(spark, path).select(
        F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op8_arc_to_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS least FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM p JOIN f USING (payload_digest)"""


@query
def op9_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted in windows of 512 tokens, read back from the formatted text."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_chats(rows.unionByName(more), path=vocabulary()))


@query
def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, folder, "pages"))


#: Documents whose n-grams are this much likelier in the raw corpus than in trusted text, in nats an n-gram, go.
QUALITY_THRESHOLD = -0.15


def trusted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its counts, its likelihood ratio and whether it is kept."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = quality.judge(docs, trusted(spark, folder), QUALITY_THRESHOLD)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document and benchmark item that it holds a passage of."""
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_context_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability by context-tree weighting and by the word baseline."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ctw.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


@query
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens by two tokenizers, linked, with how many documents hold its pairs."""
    import public_tokenizers

    return align.align(table(spark, folder, "documents"), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the size of its set of shingles and the smallest document that links lead to."""
    return minhash.near_duplicates(table(spark, folder, "documents")).withColumnRenamed("component", "component_id")


SQL["op11_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
kinds AS (SELECT s, row_number() OVER () AS k, len(s) AS n FROM (SELECT DISTINCT s FROM sets WHERE len(s) > 0)),
grams AS (SELECT k, n, unnest(s) AS g FROM kinds),
links AS (
  SELECT a.k AS a, b.k AS b FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT k, k AS k2 FROM kinds UNION SELECT reach.k, links.b FROM reach JOIN links ON reach.k2 = links.a),
least AS (
  SELECT reach.k, min(sets.doc_id) AS component_id
  FROM reach JOIN kinds ON kinds.k = reach.k2 JOIN sets ON sets.s = kinds.s GROUP BY reach.k)
SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN kinds ON kinds.s = sets.s LEFT JOIN least ON least.k = kinds.k"""


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op13_ranked_search"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n, coalesce(sum(len(ts)), 0)::BIGINT AS l FROM t WHERE len(ts) > 0),
p AS (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM t),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, s.n),
scores AS (
  SELECT q.item_id, tf.r, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * tf.n * s.n) // s.l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""
