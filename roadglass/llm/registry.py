"""The queries opN_<name> and the pipeline, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .exact_dedup import exact_dedup
from .fill_middle import fill_in_middle, restore_middle
from .license_scan import MAX_SHIFT, MIN_COVER, license_scan, templates
from .line_dedup import line_dedup
from .mixing import mixing_rates
from .passage_dedup import passage_dedup
from .pieces import encode_pieces
from .quality_model import quality_grades
from .quality_rules import quality_rules
from .sharding import shard_by_size
from .simhash import simhash_components
from .source_audit import source_divergence
from .substring_dedup import substring_dedup

#: The tokenizer of the production queries; it stays where it is installed.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Shares of tokens that the mixed corpus shall have.
TARGETS = {"de": 0.18, "en": 0.5, "es": 0.14, "fr": 0.18}

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared = substring_dedup(documents(spark, sf_dir))
    return cleared.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = shard_by_size(documents(spark, sf_dir))
    return put.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), PIECE_MODEL)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(documents(spark, sf_dir), targets=TARGETS, min_rate=1.0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir))
    return judged.withColumn("host_rate", F.round("host_rate", 6))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_grades(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op12_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared = passage_dedup(documents(spark, sf_dir))
    return cleared.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir)).drop("pieces")
    return restore_middle(made).drop("restored")


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_license_scan": op3_license_scan,
        "op4_simhash": op4_simhash,
        "op5_sharding": op5_sharding,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_line_dedup": op7_line_dedup,
        "op8_mixing": op8_mixing,
        "op9_quality_rules": op9_quality_rules,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_source_audit": op11_source_audit,
        "op12_passage_dedup": op12_passage_dedup,
        "op13_fill_middle": op13_fill_middle,
    }


#: A-Z lower-cased, null as empty.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

OP2_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), parts AS (
  SELECT r, p, substr(h, 2 * p + 1, 1422) AS part FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199, 512)) AS p FROM d)
), starts AS (
  SELECT r, p + j AS i, md5(substr(part, 2 * j + 1, 400)) AS k
  FROM (SELECT r, p, part, unnest(range(0, least(512, len(part) // 2 - 199))) AS j FROM parts)
), again AS (
  SELECT r, i FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1
), marked AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM again
), runs AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM marked
), spans AS (
  SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM runs GROUP BY r, run
), pieces AS (
  SELECT r, 0 AS lo, min(lo) AS hi FROM spans GROUP BY r
  UNION ALL SELECT r, hi, lead(lo) OVER (PARTITION BY r ORDER BY lo) FROM spans
), kept AS (
  SELECT r, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, len(h) // 2) - lo)), '' ORDER BY lo) AS rest FROM pieces JOIN d USING (r) GROUP BY r
), summed AS (
  SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN summed USING (r) LEFT JOIN kept USING (r)
"""

# the plain schedule, one group at a time; CRC-32 by its polynomial, byte by byte
OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, sha256(coalesce(text, '')) AS g FROM documents
), polynomial AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), bytes AS (
  SELECT doc_id, h, g, list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::BIGINT) AS b FROM d
), sized AS (
  SELECT doc_id, g, len(h) // 2 + 1 AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM bytes, polynomial
), groups AS (
  SELECT g, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, g) AS k FROM sized GROUP BY g
), put AS (
  SELECT 0::BIGINT AS k, -1 AS shard, list_transform(range(16), lambda s: 0::BIGINT) AS loads
  UNION ALL
  SELECT k, shard, list_transform(loads, lambda x, s: CASE WHEN s = shard + 1 THEN x + bytes ELSE x END)
  FROM (SELECT groups.k, bytes, loads, (list_position(loads, list_min(loads)) - 1)::INT AS shard FROM put JOIN groups ON groups.k = put.k + 1)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat(doc_id, upper(g))), 1, 3), doc_id, g) - 1 AS slot, NULL::INT AS grown_shard
FROM sized JOIN groups USING (g) JOIN put USING (k)
"""

_TEMPLATES = ", ".join(f"({k}, '{label}', {str(base).lower()}, {n}, {at}, '{a}', '{b}')" for k, label, base, n, at, a, b in templates())

OP3_SQL = f"""
WITH t(template, label, base, pairs, pos, t0, t1) AS (VALUES {_TEMPLATES}),
d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(w[1 : len(w) - 1]) AS w0, unnest(w[2 :]) AS w1, unnest(range(0, len(w) - 1)) AS i FROM d WHERE len(w) > 1
), votes AS (
  SELECT doc_id, template, i - t.pos AS diagonal, any_value(label) AS label, any_value(base) AS base, any_value(pairs) AS pairs,
         list(DISTINCT t.pos) AS seen, min(i) AS low, max(i) AS high
  FROM p JOIN t ON w0 = t0 AND w1 = t1 GROUP BY doc_id, template, i - t.pos
), marked AS (
  SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {MAX_SHIFT} AND NOT base
            THEN base::INT ELSE 1 END AS fresh FROM votes
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM marked
), spans AS (
  SELECT doc_id, template, run, any_value(label) AS label, any_value(base) AS base, any_value(pairs) AS pairs,
         len(list_distinct(flatten(list(seen)))) / any_value(pairs) AS cover, min(low) AS low, max(high) AS high, min(diagonal) AS start
  FROM runs GROUP BY doc_id, template, run
), found AS (
  SELECT * FROM spans WHERE CASE WHEN base THEN cover = 1 ELSE cover >= {MIN_COVER} AND high - low + 1 <= 1.5 * pairs END
)
SELECT d.doc_id, len(w) AS n_words, count(f.doc_id) FILTER (WHERE f.base) AS n_base,
       min(f.start) FILTER (WHERE f.base) AS first_word, max(f.start) FILTER (WHERE f.base) AS last_word,
       coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (WHERE f.base), '') AS base_labels,
       coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels, coalesce(max(f.cover), 0.0)::DOUBLE AS score
FROM d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id, len(w)
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), found AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped FROM keyed k LEFT JOIN found f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP9_SQL = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), worded AS (
  SELECT *, list_filter(lines, lambda x: trim(x, {_SPACE}) <> '') AS worded_lines FROM base
), windows AS (
  SELECT doc_id, i, words[i : i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base WHERE len(words) > 2)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, b.source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(worded_lines) - len(list_distinct(worded_lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM worded b LEFT JOIN covered c ON b.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines AS failed
  FROM counted
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY source
), sums AS (
  SELECT count(*) AS k, sum(n) AS docs, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS mean, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS spread, sum(n * n) / sum(n) AS one FROM hosts
), moments AS (
  SELECT mean, CASE WHEN docs - one - (k - 1) > 0 THEN (spread / (mean * (1 - mean)) - (k - 1)) / (docs - one - (k - 1)) ELSE 0 END AS share FROM sums
), prior AS (
  SELECT mean, least(greatest(1 / greatest(share, 1e-9) - 1, 1.0), 1e6) AS strength FROM moments
), verdicts AS (
  SELECT source, (f + mean * strength) / (n + strength) AS rate, mean FROM hosts, prior
), told AS (
  SELECT j.*, rate, failed AND coalesce(base_failed OR greatest(10e0 * n_symbols / nullif(n_words, 0), 10e0 * n_dup_lines / (3e0 * n_lines)) * rate > mean, false) AS host_rejected
  FROM judged j LEFT JOIN verdicts v ON j.source = v.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, host_rejected,
       NOT base_failed AND NOT host_rejected AND NOT coalesce(rate > 0.5, false) AS kept
FROM told
"""


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents
), found AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM found GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM d
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (sum(n) OVER g + count(*) OVER g) AS p,
         1 + 1000000000 * (lang_n + 1) // (sum(lang_n) OVER g + count(*) OVER g) AS q
  FROM cells WINDOW g AS (PARTITION BY lang, source)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), starts AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)
), later AS (
  SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS least FROM starts) WHERE least < doc_id
), gone AS (
  SELECT r, list(DISTINCT p) AS p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM later) GROUP BY r
), words AS (
  SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS rest FROM words
  ANTI JOIN (SELECT r, unnest(p) AS i FROM gone) g USING (r, i) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT FOR k IN range(4)] AS h
  FROM d
), cuts AS (
  SELECT *, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS lo, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(w[1 : lo], '') AS a, array_to_string(w[lo + 1 : hi], '') AS b, array_to_string(w[hi + 1 :], '') AS c FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(a || b || c) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op2_substring_dedup": OP2_SQL,
        "op3_license_scan": OP3_SQL,
        "op5_sharding": OP5_SQL,
        "op7_line_dedup": OP7_SQL,
        "op9_quality_rules": OP9_SQL,
        "op11_source_audit": OP11_SQL,
        "op12_passage_dedup": OP12_SQL,
        "op13_fill_middle": OP13_SQL,
    }
