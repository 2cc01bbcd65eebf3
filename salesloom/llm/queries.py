"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm import (
    ann_forest,
    bpe,
    hard_negatives,
    html_text,
    minhash,
    packing,
    piece_bpe,
    prefix_trie,
    quality,
    run_index,
    slots,
    url_filter,
    warc,
)
from salesloom.llm.tables import bulky
from salesloom.operators.materialize import materialize, scratch_dir


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op2_ann_forest(spark: SparkSession, folder: str) -> DataFrame:
    return ann_forest.nearest(_table(spark, folder, "embeddings"))


def op3_bpe(
    spark: SparkSession, folder: str, ranks_path: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
) -> DataFrame:
    codec = bpe.Codec(bpe.read_ranks(ranks_path), public_tokenizers.PATTERN)
    decoded = bpe.decode(bpe.encode(_table(spark, folder, "documents"), codec), codec)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op6_run_index(spark: SparkSession, folder: str) -> DataFrame:
    cut = run_index.removed(_table(spark, folder, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _marks() -> dict[str, int]:
    return packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(
    spark: SparkSession, folder: str, ranks_path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
) -> DataFrame:
    """The ids are those of ``byte_bpe_50k.json``: the rank file holds the same vocabulary, the json the end mark's id."""
    cut = packing.pieces(_table(spark, folder, "documents"), ranks_path, public_tokenizers.PATTERN, added=_marks())
    items = materialize(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.packed(items).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def packed_pieces(docs: DataFrame, ranks_path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    """Where each piece of ``docs`` is packed, with its ids: `packing.sequences` puts them together."""
    items = bulky(packing.pieces(docs, ranks_path, public_tokenizers.PATTERN, added=_marks()))
    return packing.packed(items).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def op8_slots(spark: SparkSession, folder: str) -> DataFrame:
    return slots.shard(_table(spark, folder, "documents"), shards=24)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judged(_table(spark, folder, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "distance",
    )


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the pages as archives, reads them back, and reports what was read."""
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.classified(_table(spark, folder, "pages")), path)
    read = warc.read_archives(
        spark, path, lambda body: {"body_bytes": F.octet_length(body), "body_digest": warc.base32_sha1(body)}
    )
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    stated = F.regexp_extract("stated_digest", r"^sha1:(.*)$", 1)
    return read.select(
        number("record_id").alias("page_id"),
        # a revisit's header keeps the full payload's figures; a response's are those of the bytes read
        F.when(revisit, F.col("stated_length").try_cast("long")).otherwise(F.col("body_bytes")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("body_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op11_threshold_join(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, folder, "embeddings"))


def op12_burst_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(_table(spark, folder, "conversations")))


def op13_piece_bpe(
    spark: SparkSession, folder: str, model_path: str = public_tokenizers.path("piece_bpe_32k.model")
) -> DataFrame:
    codec = piece_bpe.Codec(model_path)
    decoded = piece_bpe.decode(piece_bpe.encode(_table(spark, folder, "documents"), codec), codec)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_ann_forest": op2_ann_forest,
    "op3_bpe": op3_bpe,
    "op4_html_text": op4_html_text,
    "op5_minhash": op5_minhash,
    "op6_run_index": op6_run_index,
    "op7_packing": op7_packing,
    "op8_slots": op8_slots,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_threshold_join": op11_threshold_join,
    "op12_burst_trie": op12_burst_trie,
    "op13_piece_bpe": op13_piece_bpe,
}

_OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
ruled AS (
  SELECT *,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

# base32 by blocks of 20 bits: five hexadecimal digits, four letters
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"1 + ((('0x' || substr(sha1(coalesce(html, '')), {g * 5 + 1}, 5))::INTEGER >> {s}) & 31), 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)
_OP10_SQL = f"""
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest
  FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM digests)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

_OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM pairs WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.label <> n.anchor_label
WHERE 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 5
"""

_OP12_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 bit by bit: a byte is mixed in, then eight shifts (marked -1)
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
             lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
                               WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384::BIGINT) ELSE crc // 2 END),
           4294967295::BIGINT) % 6 AS taken
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, 0 AS part, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.taken
  UNION ALL
  SELECT c.conv_id, 1, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.taken),
seqs AS (
  SELECT c.conv_id, coalesce(t.said, []) AS said
  FROM convs c LEFT JOIN (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, place) AS said FROM turns GROUP BY conv_id) t
  USING (conv_id)),
steps AS (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS depth FROM seqs),
nodes AS (
  SELECT said[1:depth] AS head, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(said) = depth), '') AS ends
  FROM steps GROUP BY ALL),
tied AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE length(n.head[n.depth].text) END AS saved,
         (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.head[1:n.depth] = n.head) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.head = n.head[1:n.depth - 1]),
below AS (
  SELECT t.head, sum(d.saved) AS saved_tokens, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves
  FROM tied t JOIN tied d ON d.depth >= t.depth AND d.head[1:t.depth] = t.head
  GROUP BY t.head)
SELECT t.conv_id, t.depth::BIGINT AS depth, t.parent_conv_id, t.n_convs, t.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM tied t JOIN below b ON b.head = t.head
"""

ORACLES: dict[str, str] = {
    "op1_url_filter": _OP1_SQL,
    "op10_warc": _OP10_SQL,
    "op11_threshold_join": _OP11_SQL,
    "op12_burst_trie": _OP12_SQL,
}
