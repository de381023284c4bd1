"""The registered queries of this subpackage, thin wrappers over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fill_in_middle, jaccard_join, language_id, lattice, media, mixing, packing, pii, quality_rules, sharding, spelling, token_counts, token_store
from ._common import table
from ._tokens import vocabulary


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packing.packed_digests(pieces)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_token_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_store.token_digests(token_store.read_token_shards(manifest))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.feature_columns(media.store(table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.maintained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = {"byte-bpe-50k": vocabulary("byte_bpe_50k.json")}
    return token_counts.maintained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), vocabularies)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.transformed(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op11_lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_best_fit_packing": op2_best_fit_packing,
    "op1_language_id": op1_language_id,
    "op8_media_columns": op8_media_columns,
    "op7_quality_rules": op7_quality_rules,
    "op5_mixing": op5_mixing,
    "op10_vocabulary_counts": op10_vocabulary_counts,
    "op10_token_counts": op10_token_counts,
    "op3_sharding": op3_sharding,
    "op9_jaccard_join": op9_jaccard_join,
    "op4_pii": op4_pii,
    "op6_token_output": op6_token_output,
    "op11_lattice_hashing": op11_lattice_hashing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_spelling_variants": op13_spelling_variants,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

ORACLE: dict[str, str] = {}

_WORDS = r"len(regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+'))"

ORACLE["op10_token_counts"] = f"""
WITH live AS (
  SELECT d.source, d.lang,
         {_WORDS.format("array_to_string(list_distinct(string_split(d.text, chr(10))), chr(10))")} AS words,
         coalesce(strlen(d.text), 0) AS bytes
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id)
), counted AS (
  SELECT source, lang, 'words-v1' AS tokenizer, words AS tokens FROM live
  UNION ALL SELECT source, lang, 'bytes-v1', bytes FROM live
)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens
FROM counted GROUP BY source, lang, tokenizer
"""

# Walks through every source's documents in their order, one a step, and takes whatever still fits.
ORACLE["op5_mixing"] = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST({_WORDS.format("text")} AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u
  FROM documents
), per AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w, 2 * source_size AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source)
), filled AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
         coalesce(sum(cap) OVER b, 0) AS full_, coalesce(sum(w) OVER b, 0) AS used
  FROM per WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(total AS DOUBLE) - CAST(full_ AS DOUBLE)) / CAST(ws - used AS DOUBLE) AS lev FROM filled
), level AS (
  SELECT lev FROM levels WHERE lev <= CAST(cap AS DOUBLE) / w ORDER BY full_, used, lev LIMIT 1
), goal AS (
  SELECT source, source_size, n, least(CAST(cap AS DOUBLE), coalesce((SELECT lev FROM level) * w, CAST(cap AS DOUBLE))) AS target FROM per
), sured AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(greatest(ceil(target / source_size) - 1, 0) AS BIGINT) ELSE 0 END AS sure FROM goal
), rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN target - sure * source_size ELSE 0 END AS rest FROM sured
), weighed AS (
  SELECT s.*, r.rest, CAST(floor(1000000 / sqrt(1 + CAST(s.size * r.n AS DOUBLE) / CAST(r.source_size AS DOUBLE))) AS BIGINT) AS iw
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source WHERE s.size > 0
), sizes AS (
  SELECT source, size, rest, iw, count(*) AS k FROM weighed GROUP BY ALL
), tried AS (
  SELECT source, size, iw, (rest - CAST(coalesce(sum(size * k) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(iw * size * k) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS c FROM sizes
), scales AS (
  SELECT source, arg_min(c, size) AS c FROM tried WHERE c * iw <= 1 GROUP BY source
), likely AS (
  SELECT w.*, CASE WHEN s.c IS NULL THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), s.c * w.iw) END AS p FROM weighed w LEFT JOIN scales s ON s.source IS NOT DISTINCT FROM w.source
), valued AS (
  SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) ELSE CAST(1 AS DOUBLE) END AS v FROM likely
), ordered AS (
  SELECT source, v, u, size, count(*) * size AS words, row_number() OVER (PARTITION BY source ORDER BY v, u, size) AS i FROM valued GROUP BY source, v, u, size
), walk AS (
  SELECT source, CAST(0 AS BIGINT) AS i, rest AS gap, false AS hit FROM rests
  UNION ALL
  SELECT o.source, o.i, CASE WHEN o.words <= w.gap THEN w.gap - o.words ELSE w.gap END, o.words <= w.gap
  FROM walk w JOIN ordered o ON o.source IS NOT DISTINCT FROM w.source AND o.i = w.i + 1
), hits AS (
  SELECT o.source, o.u, o.size FROM walk w JOIN ordered o ON o.source IS NOT DISTINCT FROM w.source AND o.i = w.i WHERE w.hit
)
SELECT s.doc_id, s.size, r.source_size, r.target, CAST(s.size * (r.sure + CASE WHEN h.size IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
LEFT JOIN hits h ON h.source IS NOT DISTINCT FROM s.source AND h.u = s.u AND h.size = s.size
"""

ORACLE["op7_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, w1, w2, w3) AS c
  FROM (SELECT id, i, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT id, w, UNNEST(range(1, len(w) - 1)) AS i FROM d))
), covered AS (
  SELECT id, count(DISTINCT p) AS n FROM (SELECT id, i + UNNEST([0, 1, 2]) AS p FROM win WHERE c > 1) GROUP BY id
), counted AS (
  SELECT d.id, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered ON d.id = covered.id
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), hosts AS (
  SELECT source, count(*) AS n, CAST(count(CASE WHEN base_failed THEN 1 END) AS DOUBLE) AS fails FROM based GROUP BY source
), pooled AS (
  SELECT sum(fails) / sum(n) AS m, coalesce(var_pop(fails / n), 0) AS v FROM hosts
), judged AS (
  SELECT source, CASE WHEN v > 0 THEN (fails + m * greatest(1, m * (1 - m) / v - 1)) / (n + greatest(1, m * (1 - m) / v - 1)) ELSE m END <= 0.5 AS host_kept FROM hosts, pooled
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM based JOIN judged ON based.source IS NOT DISTINCT FROM judged.source
"""

ORACLE["op9_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, UNNEST(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), n AS (
  SELECT id, count(*) AS n FROM s GROUP BY id
), e AS (
  SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id JOIN n p ON p.id = x.id JOIN n q ON q.id = y.id
  GROUP BY x.id, y.id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), r AS (
  SELECT id, id AS o FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a
)
SELECT d.id AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.o) AS component_id FROM d LEFT JOIN n ON n.id = d.id JOIN r ON r.id = d.id GROUP BY d.id
"""

ORACLE["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS r1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS r2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), cut AS (
  SELECT *, array_to_string(units[1:least(r1, r2)], '') AS p, array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') AS m, array_to_string(units[greatest(r1, r2) + 1:], '') AS s FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""

# crc32 by its table of 256 remainders; near pairs share a word or one of the strings that deleting a letter leaves.
ORACLE["op13_spelling_variants"] = r"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, i) AS c FROM range(256) t(i)
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits
), runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, UNNEST(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(1, strlen(key) + 1), lambda i: CAST('0x' || substr(hex(key), 2 * i - 1, 2) AS BIGINT)),
                                 lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM runs), crc
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), keys AS (
  SELECT word, n, word AS key FROM words
  UNION SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, UNNEST(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word
  WHERE (length(a.word) = length(b.word) AND len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1)
     OR (abs(length(a.word) - length(b.word)) = 1 AND (a.key = a.word OR b.key = b.word))
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN ends USING (word)
"""

ORACLE["op11_lattice_hashing"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings
), links AS (
  SELECT x.row AS a, y.row AS b FROM v x JOIN v y ON x.label = y.label AND x.row <> y.row AND x.ok AND y.ok AND len(x.e) = len(y.e)
  WHERE CASE WHEN x.ok AND y.ok THEN list_cosine_similarity(x.e, y.e) END >= 0.93
), reach AS (
  SELECT row, row AS other FROM v UNION SELECT r.row, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
  SELECT r.row, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.row = r.other GROUP BY r.row
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AND vec_id IS NOT NULL AS kept
FROM v JOIN least USING (row) LEFT JOIN degree ON degree.a = v.row
"""
