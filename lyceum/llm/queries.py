"""The queries of this package: name -> (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lyceum.llm.bpe import encode_digest
from lyceum.llm.fingerprints import fingerprint_documents
from lyceum.llm.line_dedup import line_dedup_digest
from lyceum.llm.packing import pack_documents
from lyceum.llm.phrases import phrases
from lyceum.llm.pii import pseudonym_digest
from lyceum.llm.quality import quality_digest
from lyceum.llm.sharding import shard_documents
from lyceum.llm.simhash import near_group_digest
from lyceum.llm.spelling import spelling_variants
from lyceum.llm.suffix_tree import suffix_tree_scores
from lyceum.llm.toxicity import toxicity_digest
from lyceum.llm.training_order import order_digest

#: For the registered query and pipeline only: pseudonyms of real data take a secret of their own.
EXAMPLE_KEY = 20250101


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(documents(spark, sf_dir))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(documents(spark, sf_dir))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_digest(documents(spark, sf_dir))


def op5_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym_digest(documents(spark, sf_dir), EXAMPLE_KEY)


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_group_digest(documents(spark, sf_dir))


def op10_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op11_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(documents(spark, sf_dir))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_quality_ledger, op3_line_dedup, op4_training_order, op5_toxic_neighbours, op6_feistel_shards, op7_best_fit_packing, op8_feistel_pseudonyms, op9_simhash_groups, op10_exact_digest, op11_suffix_tree_scores, op12_phrase_collocations, op13_spelling_variants)}

SQL = {}

SQL["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
common AS (SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 40
           GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND c.last_doc <> l.doc_id AS gone
           FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL["op2_quality_ledger"] = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) r(k) GROUP BY doc_id),
stutter AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w WHERE len(words) > 1)
            WHERE words[i] = words[i + 1] GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines,
             coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
             length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters,
             length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim,
             coalesce(stutter.n, 0) AS n_stutter
      FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN stutter USING (doc_id)),
bits AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
                   + 4 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 8 * (100 * n_symbols > 10 * n_words)::BIGINT
                   + 16 * (100 * n_upper > 60 * n_letters)::BIGINT + 32 * (100 * n_exclaim > 30 * n_words)::BIGINT
                   + 64 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
                   + 128 * (100 * n_letters < 50 * word_chars)::BIGINT + 256 * (100 * n_digits > 50 * word_chars)::BIGINT
                   + 512 * (100 * n_stutter > 30 * n_words)::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules % 4 <> 0 AS base_failed,
       failed_rules = 0 AS kept, failed_rules, sole_rule,
       CASE WHEN sole_rule IS NOT NULL THEN count(*) OVER (PARTITION BY failed_rules) + (SELECT count(*) FROM bits WHERE failed_rules = 0)
       END AS n_kept_without
FROM (SELECT *, CASE failed_rules WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'duplicate_lines' WHEN 8 THEN 'symbols'
             WHEN 16 THEN 'shouting' WHEN 32 THEN 'exclamations' WHEN 64 THEN 'word_length' WHEN 128 THEN 'few_letters'
             WHEN 256 THEN 'digits' WHEN 512 THEN 'stutter' END AS sole_rule FROM bits)
"""

SQL["op12_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, words[i:i + k - 1] AS g, count(*) AS f
      FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w), (VALUES (1), (2), (3)) t(k)
      WHERE i + k - 1 <= len(words) GROUP BY ALL),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r,
                CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
         FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c
         JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:len(c.g)]),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, g[1:2] AS g, a FROM c WHERE len(g) = 3
                                             UNION ALL SELECT lang, g[2:3], a FROM c WHERE len(g) = 3) GROUP BY lang, g),
kept AS (SELECT k.lang, array_to_string(k.g, ' ') AS phrase, k.a, k.l, k.r, k.score
         FROM weakest k LEFT JOIN longer ON longer.lang = k.lang AND longer.g = k.g WHERE 100 * coalesce(longer.a, 0) < 50 * k.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
"""
