"""Queries that apply each corpus operator to its whole table, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import exact, mixing, near, neighbours, packing, pii, quality, repeats, runs, secrets, toxicity, tries, warc
from saltmarsh.llm.common import setup, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its function gets the session and the folder of the tables."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(setup(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


EXACT_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain
  FROM documents
), ranked AS (
  SELECT doc_id, plain,
    first_value(doc_id) OVER same AS keep_id,
    count(*) OVER (PARTITION BY plain) AS group_size,
    row_number() OVER same AS place
  FROM plain WINDOW same AS (PARTITION BY plain ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(plain) AS text_sha256 FROM ranked
"""


@query("op4_exact_dedup", EXACT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(table(spark, sf_dir, "documents")).drop("n_points", "repeats")


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


MIXING_SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM documents
), named AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, ((place - 1) % 3 + 1)::DOUBLE AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place
    FROM rows GROUP BY source)
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS turn,
    (sum(cap) OVER () / 3 - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM named
  WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aims AS (
  SELECT source, source_size, coalesce(least(cap, weight * (
    SELECT arg_min(level, turn) FROM levels WHERE level <= cap / weight)), cap) AS target
  FROM levels
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(least(3.0::DOUBLE, target / source_size)) ELSE 0 END::BIGINT AS whole FROM aims
), ordered AS (
  SELECT r.*, s.source_size, s.target, s.whole, s.target - s.whole * s.source_size AS need,
    -- The odds of inclusion grow with the root of a document's words.
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY u / (1 - u) / CASE WHEN size > 0 THEN sqrt(size::DOUBLE) * 1.0::DOUBLE ELSE 1.0::DOUBLE END, doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN shares s ON r.source IS NOT DISTINCT FROM s.source
), chosen AS (
  SELECT *, before + size <= need AS chosen FROM ordered
), gaps AS (
  SELECT source, any_value(need) - sum(CASE WHEN chosen THEN size ELSE 0 END) AS gap FROM chosen GROUP BY source
), last AS (
  SELECT c.source, arg_min(c.before, (abs(size - gap), c.before)) AS last
  FROM chosen c JOIN gaps g ON c.source IS NOT DISTINCT FROM g.source
  WHERE size > 0 AND NOT chosen AND abs(size - gap) < gap GROUP BY c.source
), counted AS (
  SELECT c.*, CASE WHEN size = 0 THEN 0 ELSE whole + (chosen OR coalesce(before = last, false))::INT END::BIGINT AS copies
  FROM chosen c LEFT JOIN last l ON c.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, source, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM counted
"""


@query("op7_mixing", MIXING_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


@query("op3_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_repeats")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents")).drop("removed")


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find(table(spark, sf_dir, "documents"), rewrite=runs.planted))


TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn,
    substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS name,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL
), original AS (
  SELECT conv_id, list(name ORDER BY turn NULLS FIRST, name) AS names, list(words ORDER BY turn NULLS FIRST, name) AS words
  FROM turns GROUP BY conv_id
), shares AS (
  -- CRC-32: each byte is followed by eight steps of one bit.
  SELECT *, conv_id - conv_id % 20 AS leader, (xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END
  ), 4294967295) % 4)::BIGINT AS shared
  FROM original
), rebuilt AS (
  SELECT s.conv_id,
    list_concat(coalesce(l.names, [])[1:shared], s.names[shared + 1:]) AS names,
    list_concat(coalesce(l.words, [])[1:shared], s.words[shared + 1:]) AS words
  FROM shares s LEFT JOIN original l ON l.conv_id = s.leader
), members AS (
  SELECT conv_id, d, array_to_string(names[1:d], '') AS path, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(names) AS ends
  FROM rebuilt, unnest(range(0, len(names) + 1)) AS depths(d)
), nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY path, d
), children AS (
  SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path
), subtrees AS (
  SELECT left(path, 32 * d) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
  FROM counted, unnest(range(0, depth + 1)) AS above(d) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees s ON s.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1))
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    shared = F.crc32(conv_id.cast("string").cast("binary")) % 4
    return tries.trie(table(spark, sf_dir, "conversations"), conv_id - conv_id % 20, shared, most_shared=3)


WARC_SQL = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, url FROM pages
), placed AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex,
    row_number() OVER same AS place, first_value(page_id) OVER same AS first_page
  FROM payloads WINDOW same AS (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS LAST)
)
SELECT page_id, payload_bytes,
  -- Base32: five hex digits are four of its characters.
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT) >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_page END AS refers_to
FROM placed
"""


@query("op11_warc", WARC_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved(*warc.archive(table(spark, sf_dir, "pages"))).drop("url")
