"""The registered queries of the training-data operators, thin digests over their modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.llm import ball_tree, brown, decontamination, fill_middle, language_id, media, phrases, pieces, quality, simhash, substring, toxicity, url_filter
from rulesift.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenize(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.judge(table(spark, sf_dir, "documents"))


#: The rules that the url query judges by (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_sentencepiece, op3_lm_scoring, op4_url_filter, op5_media, op6_simhash, op7_substring, op8_decontamination, op9_toxicity, op10_quality, op11_phrases, op12_ball_tree, op13_fill_middle)}

_OP4 = """
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT page_id, host, path,
    (SELECT max(struct_pack(n := length(h || p), r := h || p, v := v)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM parts)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM judged
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: A window's start is counted over all rows; a word is gone if one of the last 35 starts recurs.
_OP7 = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
words AS (SELECT r, doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM rows),
starts AS (SELECT r, i, array_to_string(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING), ' ') AS k FROM words QUALIFY i <= n - 34),
again AS (SELECT r, i FROM starts SEMI JOIN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1) t USING (k)),
judged AS (SELECT r, i, word, max(CASE WHEN a.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM words w LEFT JOIN again a USING (r, i)),
rolled AS (SELECT r, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM judged GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM rows LEFT JOIN rolled USING (r)
"""

_BENCH_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Windows of every length that items have, joined as texts.
_OP8 = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, {_BENCH_WORDS} AS w FROM documents), items AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
tests AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM rows, (SELECT DISTINCT n FROM tests) WHERE len(w) >= n)),
met AS (SELECT r, i, n, item_id FROM places JOIN tests USING (n, k)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM rows LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

#: Words are lists here; HUGEINT holds the products.
_OP11 = """
WITH pieces AS (
  SELECT row_number() OVER () AS r, lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
runs AS (SELECT lang, w[i:i + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, p, len(p) AS m, count(*) AS a FROM runs GROUP BY lang, p HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
gone AS (SELECT DISTINCT c.lang, c.p FROM f c JOIN (SELECT lang, p, a, m, unnest(range(1, m)) AS size FROM f) l ON c.lang = l.lang AND c.m = l.size AND 100 * l.a >= 100 * c.a
         AND contains(' ' || array_to_string(l.p, ' ') || ' ', ' ' || array_to_string(c.p, ' ') || ' ')),
cuts AS (SELECT c.lang, c.p, c.a, c.m, k FROM (SELECT lang, p, a, m, unnest(range(1, m)) AS k FROM f WHERE m > 1) c ANTI JOIN gone g ON c.lang = g.lang AND c.p = g.p),
scored AS (
  SELECT c.lang, array_to_string(c.p, ' ') AS phrase, c.a, c.k, x.a AS l, y.a AS r, CAST(n AS BIGINT) AS n, CAST((1000::HUGEINT * c.a * n::HUGEINT) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:] JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest QUALIFY rank <= 2000
"""

_OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, o.vec_id, CAST(list_inner_product(q.c, o.c) AS BIGINT) AS score
  FROM v q JOIN v o ON q.r <> o.r AND len(q.c) = len(o.c) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""

_OP13 = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

ORACLE_SQL: dict[str, str] = {"op4_url_filter": _OP4, "op7_substring": _OP7, "op8_decontamination": _OP8, "op11_phrases": _OP11, "op12_ball_tree": _OP12, "op13_fill_middle": _OP13}
