"""The queries opN_<name>: each operator on its whole table with production parameters, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, manifest, merkle, mixing, pieces, pii, quality, secret_ledger, simhash, tokens, topk, toxicity, warc
from .common import shared_path, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(table(spark, sf_dir, "pages"), arc)
    warc.convert(spark, arc, out)
    return warc.page_records(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-ids")
    tokens.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_documents(spark, path, with_ids=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 3) == 1
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")), "sized")
    goal = mixing.source_targets(sized, F.col("source"), F.col("size"))
    taken = mixing.mix(sized, F.array("source"), F.col("size"), keep=["source"])
    return taken.join(F.broadcast(goal), taken["source"].eqNullSafe(goal["source"])).select("doc_id", "size", "source_size", "target", "taken")


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.against_edits(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.findings(table(spark, sf_dir, "documents"), shared_path(spark, "secret-ledger"), path_col="doc_id", version_col=None)
    return secret_ledger.digests(found)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 0, with_proofs=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc, op3_tokens, op4_pii, op5_simhash, op6_topk, op7_quality, op8_sentencepiece, op9_mixing, op10_merkle, op11_secrets, op12_alignment, op13_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op6_topk": OP6, "op9_mixing": OP9, "op13_manifest": OP13}


OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest
  FROM p
), r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM r
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS mark FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w FROM d GROUP BY source
), o AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE AS full_before, sum(w) OVER behind AS w_left, 1.5 * sum(source_size) OVER () AS goal FROM s
  WINDOW before AS (ORDER BY source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         behind AS (ORDER BY source_size / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), f AS (
  SELECT *, (goal - full_before) * w / w_left > 2 * source_size AS is_full FROM o
), r AS (
  SELECT *, max(goal) OVER () - coalesce(sum(2 * source_size) FILTER (is_full) OVER (), 0)::DOUBLE AS rest, sum(w) FILTER (NOT is_full) OVER () AS w_rest FROM f
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE rest * w / w_rest END AS target FROM r
), a AS (
  SELECT d.*, source_size, target, least(round_even(target, 0), 2 * source_size) AS give,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * ((size > 0 AND ahead + size / 2 < give)::INT + (size > 0 AND source_size + ahead + size / 2 < give)::INT))::BIGINT AS taken FROM a
"""

OP13 = """
WITH RECURSIVE d AS (
  SELECT doc_id::BIGINT AS doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS size_more,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295) AS crc
  FROM documents
), l AS (
  SELECT doc_id, lang, leaf, coalesce(CASE WHEN crc % 7 = 0 THEN sha256(head || size_more || body) END, leaf) AS told,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, sha256(head || size || body) AS leaf FROM d)
), tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM l
  UNION ALL
  SELECT lang, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2
), sub AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), up AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, pos // 2
), steps AS (
  SELECT l.lang, l.pos, t.level, (l.pos >> t.level) & 1 AS side, s.h
  FROM l JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) t ON l.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.pos = xor(l.pos >> t.level, 1)
  UNION ALL
  SELECT l.lang, l.pos, 100 + t.level, (b.pos >> t.level) & 1, s.h
  FROM l JOIN sub b ON l.lang IS NOT DISTINCT FROM b.lang CROSS JOIN (SELECT DISTINCT level FROM up WHERE n > 1) t
  LEFT JOIN up s ON s.level = t.level AND s.pos = xor(b.pos >> t.level, 1)
), proofs AS (
  SELECT lang, pos, string_agg(coalesce(h, ''), '' ORDER BY level) AS siblings, list(side || coalesce(h, '') ORDER BY level) AS path FROM steps GROUP BY lang, pos
), f AS (
  SELECT l.doc_id, l.leaf, b.subroot, (SELECT h FROM up WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(l.told, coalesce(p.path, [])), lambda acc, x: sha256(CASE substr(x, 1, 1) WHEN '1' THEN substr(x, 2) || acc ELSE acc || substr(x, 2) END)) AS folded_root
  FROM l JOIN sub b ON l.lang IS NOT DISTINCT FROM b.lang LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM f
"""
