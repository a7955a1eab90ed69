"""Registered queries of the training-data operators, each over its whole table, and the SQL for those that have one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, contamination, embeddings, langid, licenses, packing, phrases, quality, simhash, spellings, toxicity, urls
from .common import fold, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Path of a public tokenizer file, the same on every machine that has the package."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_chat_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return chat.digest(chat.rotate(table(spark, sf, "conversations")))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = toxicity.classify(docs, toxicity.fit(docs, table(spark, sf, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer_path())


def op4_bpe_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf, "documents"), tokenizer_path())


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op6_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


def repository_files(docs: DataFrame) -> DataFrame:
    """Documents as files of packages: twenty to a module, ten modules to a package; the first file of each is its
    licence file."""
    k = F.col("doc_id")
    package = F.concat_ws("/", "source", F.concat(F.lit("package"), F.floor(k / 200).cast("string")))
    module = F.concat(package, F.lit("/module"), F.floor(k % 200 / 20).cast("string"))
    file = F.concat(F.when(k % 20 == 0, "/LICENSE.").otherwise("/file_"), k.cast("string"))
    return docs.select("doc_id", "text", F.concat(F.when(k % 200 == 0, package).otherwise(module), file).alias("path"))


def op7_licenses(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.label(repository_files(table(spark, sf, "documents")))
    return found.select("doc_id", "path", "own", "cosine", "licence", "licence_from", "licences")


def op8_host_quality(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("host_rate", 9).alias("host_rate"), "kept",
    )


def op9_url_models(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op12_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.judge(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_spellings(spark: SparkSession, sf: str) -> DataFrame:
    return spellings.group_spellings(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_rotation, op2_toxicity, op3_packing, op4_bpe_chunks, op5_simhash, op6_embeddings, op7_licenses,
        op8_host_quality, op9_url_models, op10_language, op11_phrases,
        op12_decontamination, op13_spellings,
    )
}

SQL = {
    "op1_chat_rotation": r"""
WITH given AS (
  SELECT conv_id, turn, role, text, CAST(floor(turn / 64.0) AS BIGINT) AS part,
         replace(coalesce(text, ''), '<|', '< |') AS body, md5(role || chr(10) || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL
), messages AS (
  SELECT DISTINCT * FROM given WHERE turn IS NOT NULL UNION ALL SELECT * FROM given WHERE turn IS NULL
), said AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, digest) - 1) // 64 AS piece FROM messages
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM given WHERE role <> 'system'
), pieces AS (
  SELECT conv_id, speaker, part, piece, turn, role, body, role = speaker AS own,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10)
              WHEN role = speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || replace(translate(replace(role, '<|', '< |'), chr(10) || chr(13), '  '), '|>', '| >')
                   || '|>' || chr(10) END AS header,
         body || '<|end|>' || chr(10) AS whole
  FROM said JOIN speakers USING (conv_id)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY turn, role, body) AS rn FROM pieces
), placed AS (
  SELECT *, sum(length(header) + length(whole)) OVER (
           PARTITION BY conv_id, speaker, part, piece ORDER BY rn ROWS UNBOUNDED PRECEDING) AS stop
  FROM ordered
)
SELECT conv_id, speaker, part, piece, count(*) AS n_turns, string_agg(header || whole, '' ORDER BY rn) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(stop - length(whole) AS BIGINT) AS VARCHAR) || '-'
                || CAST(CAST(stop AS BIGINT) AS VARCHAR) END, ' ' ORDER BY rn), '') AS mask_spans,
       CAST(coalesce(sum(CASE WHEN own THEN length(whole) END), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, speaker, part, piece
""",
    "op8_host_quality": r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w
  FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8)
), hits AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT r, CAST(sum(least(coalesce(nxt - i, 8), 8)) AS BIGINT) AS n FROM hits GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY r
), measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(base_failed::INT) AS DOUBLE) AS f FROM failed GROUP BY source
), totals AS (
  SELECT sum(n) AS t, sum(f) / sum(n) AS m, count(*) AS h, sum(f * f / n) / sum(n) AS s FROM hosts
), overlap AS (
  SELECT m, CASE WHEN m * (1 - m) * (1 - h / t) > 0
                 THEN (s - m * m - m * (1 - m) * h / t) / (m * (1 - m) * (1 - h / t)) ELSE 1 END AS o FROM totals
), prior AS (
  SELECT m, CASE WHEN o <= 0 THEN 10000.0 ELSE least(10000.0, greatest(2.0, 1 / o - 1)) END AS k FROM overlap
), rates AS (
  SELECT source, (f + m * k) / (n + k) AS host_rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(host_rate, 9) AS host_rate, NOT base_failed AND host_rate <= 0.5 AS kept
FROM failed JOIN rates ON failed.source IS NOT DISTINCT FROM rates.source
""",
    "op11_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), f1 AS (
  SELECT lang, unnest(w) AS p, count(*) AS f FROM pieces GROUP BY 1, 2
), f2 AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM pieces) GROUP BY 1, 2, 3
), f3 AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM pieces) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10
), cuts AS (
  SELECT f2.lang, x || ' ' || y AS phrase, f2.f AS a, 1 AS k, u.f AS l, v.f AS r
  FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.p = x JOIN f1 v ON v.lang = f2.lang AND v.p = y
  WHERE f2.f >= 10
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.x = f2.x AND f3.y = f2.y AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.y = f2.x AND f3.z = f2.y AND 100 * f3.f >= 50 * f2.f)
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 1, u.f, t.f
  FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.p = f3.x JOIN f2 t ON t.lang = f3.lang AND t.x = f3.y AND t.y = f3.z
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, h.f, v.f
  FROM f3 JOIN f2 h ON h.lang = f3.lang AND h.x = f3.x AND h.y = f3.y JOIN f1 v ON v.lang = f3.lang AND v.p = f3.z
), scored AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000
""",
    "op12_decontamination": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, z, array_to_string(w[i:i + z - 1], ' ') AS k
  FROM (SELECT item, w, least(len(w), 10) AS z, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT z FROM windows
), hits AS (
  SELECT r, z, i, k FROM (
    SELECT r, z, i, array_to_string(w[i:i + z - 1], ' ') AS k
    FROM (SELECT r, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM docs, sizes WHERE len(w) >= z)
  ) WHERE (z, k) IN (SELECT (z, k) FROM windows)
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + z)) AS p FROM hits) GROUP BY r
), told AS (
  SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS ids
  FROM (SELECT DISTINCT r, item FROM hits JOIN windows USING (z, k)) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(told.n, 0) AS n_items,
       coalesce(ids, sha256('')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN told USING (r)
""",
}
