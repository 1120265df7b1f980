"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_model, decontaminate, lexical, packing, pieces, quality, resample, secrets, simhash, suffix_dedup, token_counts, url_rules, webp
from .common import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.store(spread(table(spark, sf_dir, "documents")))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(table(spark, sf_dir, "documents")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model.score(spread(table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(spread(table(spark, sf_dir, "documents")))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spread(table(spark, sf_dir, "documents")))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(spread(table(spark, sf_dir, "documents")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")))


REGISTERED = (
    op1_url_filters,
    op2_media_columns,
    op3_secret_scans,
    op4_lm_scoring,
    op5_quality_classifier,
    op6_benchmark_decontamination,
    op7_sentencepiece,
    op8_suffix_array_dedup,
    op9_simhash_near_dedup,
    op10_token_counts,
    op11_importance_resampling,
    op12_ranked_search,
    op13_best_fit_packing,
)


def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 without what it mines: verdicts of listed rules only."""
    rows = op1_url_filters(spark, sf_dir)
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 without its classes."""
    return op4_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operators 2, 8 and 10 say of a text's bytes."""
    stored = op2_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")
    return stored.join(op10_token_counts(spark, sf_dir).select("doc_id", F.col("n_bytes").alias("counted")), "doc_id")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{h}', '{p}', '{h}{p}', '{v}')" for h, p, v in url_rules.LISTED)
#: a CRC-32 bit by bit: each byte comes in with the first of its eight steps
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: list_concat([CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)], [0, 0, 0, 0, 0, 0, 0]::BIGINT[])))),
   lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295)"""

BASE = {
    "base_url_rules": f"""WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM r),
 l AS (SELECT * FROM (VALUES {_RULES}) v(rule_host, rule_path, rule, verdict)),
 f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h JOIN l ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
 SELECT h.page_id, host, path, f.rule, f.verdict FROM h LEFT JOIN f USING (page_id)""",
    "base_secret_counts": """SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents""",
    "base_word_scores": f"""WITH d AS (SELECT doc_id, coalesce({_CRC} % 5 = 1, false) AS held_out, list_concat(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+'), [NULL]) AS w FROM documents),
 t AS (SELECT row_number() OVER () AS k, doc_id, held_out, coalesce(w, chr(1) || ' end') AS w FROM (SELECT doc_id, held_out, unnest(w) AS w FROM d)),
 c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
 SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 4) AS base_score FROM t LEFT JOIN c USING (w), n GROUP BY 1, 2""",
    "base_sizes": """SELECT doc_id, octet_length(encode(x)) AS n_bytes, octet_length(encode(p)) AS payload_bytes, sha256(p) AS payload_sha256, octet_length(encode(x)) AS counted
 FROM (SELECT doc_id, x, x || repeat(' ', CASE WHEN x = '' THEN 192 ELSE (192 - octet_length(encode(x)) % 192) % 192 END) AS p FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))""",
}

#: CRC-32 of a text's UTF-8 bytes, given as hexadecimal digits ``x``
_CRC_HEX = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(0, length(x) // 2), lambda i: list_concat([CAST((instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1 AS BIGINT)], [0, 0, 0, 0, 0, 0, 0]::BIGINT[])))),
   lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295)"""

FULL = {
    "op11_importance_resampling": f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 f AS (SELECT doc_id, unnest(w) AS w FROM d), g AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
 k AS (SELECT w, {_CRC_HEX} % 10000 AS b FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM g))),
 s AS (SELECT b, count(*) AS s FROM f JOIN k USING (w) GROUP BY 1), t AS (SELECT b, count(*) AS t FROM g JOIN k USING (w) GROUP BY 1),
 a AS (SELECT (SELECT sum(s) FROM s)::BIGINT AS big_s, (SELECT sum(t) FROM t)::BIGINT AS big_t),
 n AS (SELECT s.b, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (big_s + 10000) AS DOUBLE) / CAST((s + 1) * (big_t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), a),
 w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN k USING (w) JOIN n USING (b) GROUP BY 1),
 r AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
 o AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
 q AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM o)
 SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * n // 100 THEN place END AS rank FROM q""",
    "op12_ranked_search": f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 a AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
 p AS (SELECT doc_id, size, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS t FROM d) GROUP BY 1, 2, 3),
 f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), a),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
 s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n) // l)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN f USING (t), a GROUP BY 1, 2),
 r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
}


def queries() -> dict[str, Query]:
    """The operators, and parts of them that SQL can express."""
    return {f.__name__: f for f in (*REGISTERED, base_url_rules, base_secret_counts, base_word_scores, base_sizes)}


def oracle_sql() -> dict[str, str]:
    return BASE | FULL
