"""Registered queries of the operators over whole tables, and the oracle SQL of those that SQL expresses."""
from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from tidewatch.llm import bpe, chat, decontaminate, dedup, fim, fingerprints, language, pages, pii, quality, sharding, spelling, token_files
from tidewatch.llm.common import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), BYTE_BPE)


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.components(read(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_spans(read(spark, sf_dir, "documents")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(read(spark, sf_dir, "documents"), WORD_BPE)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(read(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(fim.transform(read(spark, sf_dir, "documents")))


def op13_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.report(*chat.format_conversations(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe), BYTE_BPE))


QUERIES = {f.__name__: f for f in (op1_shards, op2_bpe_round_trip, op3_quality_scores, op4_benchmark_hits, op5_near_duplicates, op6_personal_data, op7_token_files, op8_fingerprints, op9_main_text, op10_languages,
                                   op11_spelling_variants, op12_fill_in_middle, op13_chat_masks)}
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL: dict[str, str] = {"op4_benchmark_hits": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
found AS (SELECT doc_id, i, size, item_id FROM (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM (
    SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)) JOIN windows USING (size, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""", "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents),
drawn AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
  CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
formed AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
cut AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM cut""", "op13_chat_masks": """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (SELECT *, regexp_replace(text, '([\\[<])(\\\\*(?:/?s>|/?INST\\]|</?SYS>>|/?ROLE\\]|TEXT\\]|\\|endoftext\\|>))', '\\1\\\\\\2', 'g') AS e,
  regexp_replace(role, '([\\[<])(\\\\*(?:/?s>|/?INST\\]|</?SYS>>|/?ROLE\\]|TEXT\\]|\\|endoftext\\|>))', '\\1\\\\\\2', 'g') AS r FROM turns),
shown AS (SELECT *, CASE role WHEN 'user' THEN '[INST]' || e || '[/INST]' WHEN 'system' THEN '<<SYS>>' || e || '<</SYS>>' WHEN 'assistant' THEN e || '</s>' ELSE '[ROLE]' || r || '[TEXT]' || e || '[/ROLE]' END AS f FROM escaped)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(f)) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv_id""", "op11_spelling_variants": f"""
WITH RECURSIVE codes AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(w, '{ascii_uppercase}', '{ascii_lowercase}') AS w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
coded AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs),
summed AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda j: CAST('0x' || x[2 * j + 1:2 * j + 2] AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM coded, codes),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM summed) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
cuts AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT c.word AS a, c.n AS n_a, w.word AS b, w.n AS n_b FROM cuts c JOIN words w ON c.d = w.word),
near AS (SELECT a AS word, b AS other, n_b AS other_n FROM shorter UNION ALL SELECT b, a, n_a FROM shorter UNION ALL SELECT a.word, b.word, b.n FROM cuts a JOIN cuts b ON a.d = b.d AND a.i = b.i WHERE a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (other_n = m) AS other FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS m FROM near) GROUP BY word),
formed AS (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN top >= 5 * n THEN other END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, here, step) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON c.here = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""}
