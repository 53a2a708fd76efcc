"""The registered queries of the text-rule engine over the driver's tables, and their SQL.

Documents stand in for entries (field: their language) and passages, conversations for batches, labels for metadata,
benchmark items for excerpts and queries. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift import schemas as S
from rulesift.functions import text as tx
from rulesift.operators import decide, evidence, findings, integrity, review, scan, search, semantic
from rulesift.plans.rulepack import Rule, RulePack, Semantic, latin_pack
from rulesift.sources import extract

BOTH = "official_plus_editorial"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for queries that work on their texts."""
    return tx.dealt(_table(spark, sf_dir, "documents"))


def _plain_pack() -> RulePack:
    pack = latin_pack()
    return pack.with_rules(*[replace(r, conflicts=()) for r in pack.rules])


def _entries(spark: SparkSession, sf_dir: str, profile: str = BOTH) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", "source", "text", F.col("lang").alias("field"), F.lit(profile).alias("profile"))


def _sql(text: str) -> str:
    return text.replace("'", "''")


def _hits_sql(pack: RulePack, profile: str = BOTH, table: str = "documents", key: str = "doc_id", field: str = "lang") -> str:
    """hits(key, rule_id, rule_ord, start_cp, matched): every place of every rule, each place once for a rule."""
    from rulesift.functions.patterns import literal

    parts = []
    for i, r in enumerate(pack.phrases()):
        if r.editorial and profile != BOTH:
            continue
        on = "TRUE" if r.applies_to is None else f"{field} IN ({', '.join(repr(a) for a in r.applies_to)})"
        for p in r.patterns:
            rx = _sql(("(?i)" if r.ignore_case or not r.literal else "") + (literal(p) if r.literal else p))
            parts.append(
                f"SELECT {key}, '{r.id}' AS rule_id, {i} AS rule_ord, unnest(range(1, len(m) + 1)) AS k, m, g "
                f"FROM (SELECT {key}, regexp_extract_all(text, '{rx}') AS m, string_split_regex(text, '{rx}') AS g FROM {table} WHERE {on})"
            )
    place = "coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0)"
    return f"hits AS (SELECT DISTINCT {key}, rule_id, rule_ord, CAST({place} AS INTEGER) AS start_cp, m[k] AS matched FROM ({' UNION ALL '.join(parts)}))"


def _rules_sql(pack: RulePack) -> str:
    rows = ", ".join(f"('{r.id}', '{r.outcome}', {str(r.editorial).lower()}, {findings.authority_of(pack, r)}, '{_sql(r.message)}', '{_sql(r.recommendation)}')" for r in pack.phrases())
    return f"rules(rule_id, outcome, editorial, authority, message, advice) AS (VALUES {rows})"


# --- scanning ---------------------------------------------------------------------------------------------------


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    hits = e.select("doc_id", F.explode(scan.scan_array(_plain_pack(), F.col("text"), F.col("profile"), F.col("field"))).alias("h"))
    return hits.select("doc_id", F.col("h.ruleId").alias("rule_id"), F.col("h.startCp").alias("start_cp"), F.col("h.text").alias("matched"))


def scan_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan.scan_exploded(_entries(spark, sf_dir), _plain_pack())
    return scan.first_of_rule(hits, ["doc_id"]).select("doc_id", F.col("ruleId").alias("rule_id"), F.col("startCp").alias("start_cp"), F.col("text_hit").alias("matched"))


_SCAN_FINDINGS = f"WITH {_hits_sql(_plain_pack())} SELECT doc_id, rule_id, start_cp, matched FROM hits"


def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = findings.validate(_entries(spark, sf_dir), _plain_pack())
    found = F.filter("findings", lambda f: f["category"].isin("content", "editorial"))
    return v.select("doc_id", F.size(found).alias("n_findings"), findings.content_status(found).alias("status"))


_SCAN_STATUS = f"""WITH {_hits_sql(_plain_pack())}, {_rules_sql(_plain_pack())}
SELECT d.doc_id, CAST(count(h.rule_id) AS INTEGER) AS n_findings,
  CASE WHEN count(h.rule_id) FILTER (outcome = 'block') > 0 THEN 'blocked' WHEN count(h.rule_id) > 0 THEN 'review' ELSE 'pass' END AS status
FROM documents d LEFT JOIN hits h USING (doc_id) LEFT JOIN rules r USING (rule_id) GROUP BY d.doc_id"""


def scan_editorial_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack, e = _plain_pack(), _entries(spark, sf_dir)
    count = lambda profile: F.size(scan.scan_array(pack, F.col("text"), F.lit(profile), F.col("field")))
    return e.select("doc_id", count("official").alias("n_official"), count(BOTH).alias("n_both"))


_SCAN_EDITORIAL = f"""WITH {_hits_sql(_plain_pack())}, {_rules_sql(_plain_pack())}
SELECT d.doc_id, CAST(count(h.rule_id) FILTER (NOT editorial) AS INTEGER) AS n_official, CAST(count(h.rule_id) AS INTEGER) AS n_both
FROM documents d LEFT JOIN hits h USING (doc_id) LEFT JOIN rules r USING (rule_id) GROUP BY d.doc_id"""

# --- text functions ---------------------------------------------------------------------------------------------


def text_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", tx.measure(F.col("text")).alias("m")).select("doc_id", F.col("m.charCount").alias("char_count"), F.col("m.byteCount").alias("byte_count"))


_TEXT_MEASURE = "SELECT doc_id, CAST(length(replace(text, chr(13) || chr(10), chr(10))) AS INTEGER) AS char_count, CAST(strlen(replace(text, chr(13) || chr(10), chr(10))) AS INTEGER) AS byte_count FROM documents"


def length_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack, e = latin_pack(), _entries(spark, sf_dir)
    broken = e.select("doc_id", F.explode(findings.length_verdicts(pack, F.col("field"), F.col("text"))).alias("v"), tx.measure(F.col("text"))["byteCount"].alias("byte_count"))
    return broken.select("doc_id", F.col("v.ruleId").alias("rule_id"), "byte_count")


_LENGTH_VIOLATIONS = """WITH limits(lang, n) AS (VALUES ('en', 6000), ('fr', 3000), ('de', 3000), ('es', 1500))
SELECT doc_id, 'LENGTH-' || upper(lang) AS rule_id, CAST(strlen(text) AS INTEGER) AS byte_count FROM documents JOIN limits USING (lang) WHERE strlen(text) > n"""

_NORM = "trim(lower(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\t ]+', ' ', 'g'), ' *\\n *', chr(10), 'g')), ' ' || chr(9) || chr(10))"


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", tx.normalize_search(F.col("text")).alias("normalized"))


_NORMALIZE = f"SELECT doc_id, {_NORM} AS normalized FROM documents"


def tokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = _texts(spark, sf_dir).select("doc_id", tx.normalize_search(F.col("text")).alias("s"))
    return norm.select("doc_id", F.size(tx.words(F.col("s"))).alias("n_words"), F.size(tx.tokens(F.col("s"))).alias("n_tokens"))


_WORDS = f"words AS (SELECT doc_id, source, text, s, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT doc_id, source, text, {_NORM} AS s FROM documents))"
_TOKENS = f"{_WORDS}, toks AS (SELECT doc_id, source, text, s, w, list_distinct(w || list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])) AS t FROM words)"
_TOKENS_PER_DOC = f"WITH {_TOKENS} SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(t) AS INTEGER) AS n_tokens FROM toks"


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir).select("doc_id", "source", "text")
    return search.prepare(docs.select("doc_id", F.col("source").alias("sourceId"), "text", F.col("text").alias("searchText"), F.lit(80).alias("authority")))


def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.token_df(_passages(spark, sf_dir))


_TOKEN_DF = f"WITH {_TOKENS} SELECT unnest(t) AS token, count(*) AS df FROM toks GROUP BY 1"

# --- search -----------------------------------------------------------------------------------------------------

QUERY = "mit license"


def _score_sql(query: str, toks: list[str]) -> str:
    """scored(doc_id, source, text, score): the closed form of the score for one query."""
    count = lambda hay, needle: f"((length({hay}) - length(replace({hay}, '{needle}', ''))) // {max(len(needle), 1)})"
    stats = ", ".join(f"CAST(count(*) FILTER (list_contains(t, '{t}')) AS DOUBLE) AS df{i}" for i, t in enumerate(toks))
    terms = " + ".join(f"(CASE WHEN tf{i} > 0 THEN ln(1 + (nn - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * len(t) / greatest(1.0, mean))) ELSE 0 END)" for i in range(len(toks)))
    matched = " + ".join(f"(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END)" for i in range(len(toks)))
    tight = query.replace(" ", "")
    return f"""{_TOKENS}, st AS (SELECT count(*)::DOUBLE AS nn, avg(len(t)) AS mean, {stats} FROM toks),
tf AS (SELECT toks.*, st.*, {count("s", query)} AS ex, regexp_replace(s, '\\s+', '', 'g') AS c, {", ".join(f"{count('s', t)} AS tf{i}" for i, t in enumerate(toks))} FROM toks, st),
scored AS (SELECT doc_id, source, text, s, ex * 3000.0 + {count("c", tight)} * 1800.0 + ({matched}) / {float(len(toks))} * 800.0 + ({terms}) * 100.0 + (CASE WHEN contains(c, '{tight}') THEN 400.0 ELSE 0 END) + 80 * 0.01 AS score
  FROM tf WHERE ex > 0 OR ({matched}) > 0)"""


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_passages(spark, sf_dir), QUERY, 20, key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_passages(spark, sf_dir), QUERY, 20, key="doc_id", source_ids=["src1", "src2", "src3"]).select("doc_id", F.round("score", 6).alias("score"))


def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_passages(spark, sf_dir), QUERY, 20, key="doc_id").select("doc_id", "snippet")


_SCORED = _score_sql(QUERY, search.query_tokens(QUERY))
_TOP = "ORDER BY score DESC, source, doc_id LIMIT 20"
_SEARCH_TOPK = f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored {_TOP}"
_SEARCH_FILTERED = f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored WHERE source IN ('src1', 'src2', 'src3') {_TOP}"
_FIRST = ", ".join(f"nullif(instr(lower(text), '{t}'), 0)" for t in search.query_tokens(QUERY))
_FIRST_FOLDED = ", ".join(f"nullif(instr(s, '{t}'), 0)" for t in [QUERY, *search.query_tokens(QUERY)])
_SEARCH_SNIPPET = f"""WITH {_SCORED}, top AS (SELECT *, least(coalesce(least({_FIRST}), least({_FIRST_FOLDED}), 1) - 1, length(text)) AS pos FROM scored {_TOP}),
cut AS (SELECT doc_id, text, greatest(pos - 120, 0) AS a, least(length(text), pos + 120) AS b FROM top)
SELECT doc_id, (CASE WHEN a > 0 THEN '…' ELSE '' END) || substring(text, a + 1, b - a) || (CASE WHEN b < length(text) THEN '…' ELSE '' END) AS snippet FROM cut"""


def search_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(tx.words(F.lower("text")), 1, 3), " ").alias("query"))
    return search.search_many(_passages(spark, sf_dir), queries, 3, key="doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_SEARCH_MULTI = f"""WITH {_TOKENS}, q AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')[1:3], ' ') AS q FROM benchmark),
qt AS (SELECT query_id, q, w, list_transform(range(1, len(w) + 1), lambda i: w[i]) || list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]) AS x FROM (SELECT query_id, q, string_split(q, ' ') AS w FROM q WHERE q <> '')),
u AS (SELECT query_id, q, tok, min(pos) AS pos FROM (SELECT query_id, q, unnest(x) AS tok, unnest(range(1, len(x) + 1)) AS pos FROM qt) GROUP BY ALL),
df AS (SELECT tok, count(*)::DOUBLE AS df FROM (SELECT unnest(t) AS tok FROM toks) WHERE tok IN (SELECT tok FROM u) GROUP BY 1),
ut AS (SELECT query_id, q, tok, pos, coalesce(df, 0) AS df FROM u LEFT JOIN df USING (tok)),
st AS (SELECT count(*)::DOUBLE AS nn, avg(len(t)) AS mean FROM toks),
pairs AS (SELECT query_id, q, doc_id, s, len(t) AS n, tok, df, (length(s) - length(replace(s, tok, ''))) // length(tok) AS tf FROM toks, ut),
sums AS (SELECT query_id, q, doc_id, any_value(s) AS s, count(*) AS size, count(*) FILTER (tf > 0) AS matched,
  sum(CASE WHEN tf > 0 THEN ln(1 + (nn - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n / greatest(1.0, mean))) ELSE 0 END) AS bm
  FROM pairs, st GROUP BY query_id, q, doc_id),
f AS (SELECT *, (length(s) - length(replace(s, q, ''))) // length(q) AS ex, regexp_replace(s, '\\s+', '', 'g') AS c, replace(q, ' ', '') AS tq FROM sums WHERE matched > 0),
scored AS (SELECT query_id, doc_id, ex * 3000.0 + ((length(c) - length(replace(c, tq, ''))) // length(tq)) * 1800.0 + matched / size::DOUBLE * 800.0 + bm * 100.0 + (CASE WHEN contains(c, tq) THEN 400.0 ELSE 0 END) + 0.8 AS score FROM f)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 3"""


def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = _table(spark, sf_dir, "benchmark").select("item_id", tx.normalize_search(F.col("text")).alias("q"))
    passages = _texts(spark, sf_dir).select(tx.normalize_search(F.col("text")).alias("s"))
    return integrity.quotes_contained(quotes, passages)


_QUOTES = f"""SELECT item_id, count(s) AS n_passages FROM (SELECT item_id, {_NORM} AS q FROM benchmark) LEFT JOIN (SELECT {_NORM} AS s FROM documents) ON q <> '' AND contains(s, q) GROUP BY item_id"""

# --- metadata decisions -----------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose metadata come from labels: quality tells the observation, toxic the facts; what isn't labelled is absent."""
    pack_rules = {"observationBasis": F.when(F.col("quality") == 1, "direct").when(F.col("quality") == 0, "none"), "factualSupport": F.when(F.col("toxic") == 1, "unverified").when(F.col("toxic") == 0, "supported")}
    given = {"studentMaterial": F.lit("none"), "studentWroteFinalNarrative": F.lit(False), "aiUse": F.when(F.col("doc_id") % 5 == 0, "proofreading").when(F.col("doc_id") % 5 == 1, "verbatim").otherwise("none"), "teacherVerifiedAgainstActualPerformance": F.when(F.col("doc_id") % 10 == 0, True)}
    prov = F.struct(*[(pack_rules | given).get(n, F.lit(None)).alias(n) for n in S.names(S.PROVENANCE)]).cast(S.nested(S.PROVENANCE))
    return _entries(spark, sf_dir).join(_table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("provenance", prov).drop("quality", "toxic")


def _judged_pack() -> RulePack:
    pack = _plain_pack()
    meta = [Rule(i, "metadata", i, evidence=("EV-A",), check="metadata") for i in ("OFFICIAL-DIRECT-OBSERVATION", "OFFICIAL-FACTUAL-ACCURACY", "OFFICIAL-STUDENT-MATERIAL-CONDITIONS", "OFFICIAL-STUDENT-FINAL-DRAFT", "OFFICIAL-AI-VERBATIM", "OFFICIAL-AI-VERIFICATION", "FIELD-BEHAVIOR-CONTINUOUS-OBSERVATION")]
    return pack.with_rules(*pack.rules, *meta)


def provenance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = findings.validate(_labelled(spark, sf_dir), _judged_pack())
    return v.select("doc_id", F.col("contextStatus").alias("context_status"), F.size("needsContext").alias("n_needs"))


def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = findings.validate(_labelled(spark, sf_dir), _judged_pack())
    return v.select("doc_id", F.col("contentStatus").alias("content_status"), F.col("contextStatus").alias("context_status"), "status")


_CONTEXT = """ctx AS (SELECT doc_id,
  CASE WHEN quality = 0 OR doc_id % 5 = 1 THEN 'blocked' WHEN toxic = 1 OR (doc_id % 5 = 0 AND doc_id % 10 <> 0) THEN 'review' WHEN quality IS NULL OR toxic IS NULL THEN 'needs_context' ELSE 'complete' END AS context_status,
  CAST((quality IS NULL)::INT + (toxic IS NULL)::INT AS INTEGER) AS n_needs FROM documents LEFT JOIN labels USING (doc_id))"""
_PROVENANCE_STATUS = f"WITH {_CONTEXT} SELECT doc_id, context_status, n_needs FROM ctx"
_LONG = "(CASE lang WHEN 'en' THEN 6000 WHEN 'es' THEN 1500 ELSE 3000 END)"
_CONTENT = f"""{_hits_sql(_plain_pack())}, {_rules_sql(_plain_pack())}, cont AS (SELECT d.doc_id,
  CASE WHEN strlen(any_value(d.text)) > any_value({_LONG}) OR count(h.rule_id) FILTER (outcome = 'block') > 0 THEN 'blocked' WHEN count(h.rule_id) > 0 THEN 'review' ELSE 'pass' END AS content_status
  FROM documents d LEFT JOIN hits h USING (doc_id) LEFT JOIN rules r USING (rule_id) GROUP BY d.doc_id)"""
_OVERALL = f"""WITH {_CONTEXT}, {_CONTENT} SELECT doc_id, content_status, context_status,
  CASE WHEN 'blocked' IN (content_status, context_status) THEN 'blocked' WHEN 'review' IN (content_status, context_status) THEN 'review' WHEN context_status = 'needs_context' THEN 'needs_context' ELSE 'pass' END AS status
FROM cont JOIN ctx USING (doc_id)"""

# --- batches ----------------------------------------------------------------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("batchId"), F.col("turn").cast("int").alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("entryId"), "role", F.lit("en").alias("field"), "text", F.lit(BOTH).alias("profile"))


def _batch_pack() -> RulePack:
    # common words, so that short turns have findings of every kind
    rules = [Rule("WORD-THE", "phrase", literal=False, patterns=(r"\bthe\b",), outcome="block", evidence=("EV-A",), message="the", recommendation="drop the"), Rule("WORD-AND", "phrase", patterns=(" and ",), outcome="review", evidence=("EV-B",), message="and", recommendation="drop and")]
    pack = latin_pack()
    return replace(pack, fields=tuple(replace(f, provenance_mode="none", length_rule=None, length_kind="system-range") for f in pack.fields), rules=tuple(rules))


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = findings.validate(_turns(spark, sf_dir), _batch_pack())
    return findings.batch_status(v).select("batchId", F.col("entries").alias("n_entries"), "status")


_TURN_STATUS = "turns AS (SELECT conv_id, turn, text, CASE WHEN text IS NULL OR length(text) < 1 THEN NULL WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'blocked' WHEN contains(text, ' and ') THEN 'review' ELSE 'pass' END AS status FROM conversations)"
_BATCH_STATUS = f"""WITH {_TURN_STATUS} SELECT CAST(conv_id AS VARCHAR) AS batchId, count(*) AS n_entries,
  CASE WHEN count(*) FILTER (status IS NULL) > 0 THEN NULL WHEN count(*) FILTER (status = 'blocked') > 0 THEN 'blocked' WHEN count(*) FILTER (status = 'review') > 0 THEN 'review' ELSE 'pass' END AS status FROM turns GROUP BY conv_id"""


def batch_shape_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.batch_errors(_turns(spark, sf_dir).withColumn("entryId", F.col("role"))).select("batchId", "n", "error")


_BATCH_SHAPE = """SELECT CAST(conv_id AS VARCHAR) AS batchId, count(*) AS n, CASE WHEN count(*) > 100 THEN 'batch size' ELSE 'duplicate entry id' END AS error
FROM conversations GROUP BY conv_id HAVING count(*) > 100 OR count(DISTINCT role) < count(*)"""

# --- review -----------------------------------------------------------------------------------------------------


def teacher_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).withColumns({"batchId": F.col("source"), "ord": F.lit(0), "entryId": F.col("doc_id").cast("string")})
    r = review.review(findings.validate(e, _plain_pack()))
    return r.select(
        F.col("entryId").cast("long").alias("doc_id"), "status", "label", F.size("issues").alias("n_issues"),
        F.size(F.filter("issues", lambda i: i["status"] == "prohibited")).alias("n_prohibited"),
        F.array_join(F.array_sort("rewritePlan.mustRemove"), "|").alias("must_remove"), F.col("rewritePlan.action").alias("action"),
    )


_ISSUES = f"""{_hits_sql(_plain_pack())}, {_rules_sql(_plain_pack())}, own AS (SELECT d.doc_id, d.source,
  CAST(count(h.rule_id) + any_value((strlen(d.text) > {_LONG})::INT) AS INTEGER) AS n_issues, CAST(count(h.rule_id) FILTER (outcome = 'block') AS INTEGER) AS n_prohibited,
  coalesce(array_to_string(list_sort(list(DISTINCT left(h.matched, 80)) FILTER (outcome = 'block')), '|'), '') AS removed
  FROM documents d LEFT JOIN hits h USING (doc_id) LEFT JOIN rules r USING (rule_id) GROUP BY d.doc_id, d.source),
judged AS (SELECT *, CASE WHEN n_prohibited > 0 THEN 'prohibited' WHEN n_issues > 0 THEN 'revise' ELSE 'pass' END AS status FROM own)"""
_TEACHER_REVIEW = f"""WITH {_ISSUES} SELECT doc_id, status, CASE status WHEN 'pass' THEN '통과' WHEN 'revise' THEN '수정 권장' ELSE '기재 불가' END AS label, n_issues, n_prohibited, removed AS must_remove,
  CASE status WHEN 'pass' THEN 'none' WHEN 'revise' THEN 'rewrite' ELSE 'ask_evidence' END AS action FROM judged"""


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).withColumns({"batchId": F.col("source"), "ord": F.lit(0), "entryId": F.col("doc_id").cast("string")})
    return review.review_batches(review.review(findings.validate(e, _plain_pack()))).select(F.col("batchId").alias("source"), "status", "total", F.col("pass").alias("n_pass"), F.col("revise").alias("n_revise"), F.col("prohibited").alias("n_prohibited"))


_REVIEW_COUNTS = f"""WITH {_ISSUES} SELECT source, CASE WHEN count(*) FILTER (status = 'prohibited') > 0 THEN 'prohibited' WHEN count(*) FILTER (status = 'revise') > 0 THEN 'revise' ELSE 'pass' END AS status,
  count(*) AS total, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'revise') AS n_revise, count(*) FILTER (status = 'prohibited') AS n_prohibited FROM judged GROUP BY source"""

# --- suppression, conflicts, evidence ---------------------------------------------------------------------------


def suppress_allowlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = _plain_pack()
    named = pack.with_rules(Rule(findings.SPECIFIC_NAME, "phrase", literal=False, patterns=("mit licen[sc]e", "licen[sc]e"), outcome="review", evidence=("EV-B",)))
    scanned = _entries(spark, sf_dir).withColumn("h", scan.scan_array(named, F.col("text"), F.col("profile"), F.col("field"))).withColumn("a", F.lit(None).cast(S.nested(S.ACTIVITY)))
    scanned = tx.once(scanned, h=F.col("h")).withColumn("plain", findings.names_met(F.col("h"), F.col("a")))
    gone = F.filter("h", lambda h: findings.suppressed(h, F.col("field"), F.col("a"), F.lit(None).cast("string"), ("MITLicense", "license"), F.col("plain")))
    return scanned.select("doc_id", F.size("h").alias("n_hits"), F.size(gone).alias("n_suppressed"))


_SUPPRESS = f"""WITH {_hits_sql(_plain_pack().with_rules(Rule(findings.SPECIFIC_NAME, "phrase", literal=False, patterns=("mit licen[sc]e", "licen[sc]e"), evidence=("EV-B",))))}
SELECT d.doc_id, CAST(count(h.rule_id) AS INTEGER) AS n_hits, CAST(count(h.rule_id) FILTER (regexp_replace(matched, '\\s+', '', 'g') IN ('MITLicense', 'license')) AS INTEGER) AS n_suppressed
FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id"""


def conflict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = findings.validate(_entries(spark, sf_dir), latin_pack())
    content = F.filter("findings", lambda f: f["category"] != "length")
    merged = F.filter("findings", lambda f: f["category"] == "conflict")
    return v.select("doc_id", F.size(content).alias("n_findings"), F.coalesce(F.array_join(F.flatten(F.transform(merged, lambda f: f["conflictingRuleIds"])), ","), F.lit("")).alias("conflicts"), findings.content_status(content).alias("status"))


_CONFLICT = f"""WITH {_hits_sql(latin_pack())}, {_rules_sql(latin_pack())}, own AS (SELECT d.doc_id, count(h.rule_id) FILTER (rule_id = 'EMAIL') AS e, count(h.rule_id) FILTER (rule_id = 'LICENCE') AS l,
  count(h.rule_id) FILTER (rule_id NOT IN ('EMAIL', 'LICENCE')) AS o, count(h.rule_id) FILTER (rule_id = 'IPV4') AS ip FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CAST(CASE WHEN e > 0 AND l > 0 THEN o + 1 ELSE o + e + l END AS INTEGER) AS n_findings, CASE WHEN e > 0 AND l > 0 THEN 'EMAIL,LICENCE' ELSE '' END AS conflicts,
  CASE WHEN ip > 0 OR (e > 0 AND l = 0) THEN 'blocked' WHEN e + l + o > 0 THEN 'review' ELSE 'pass' END AS status FROM own"""


def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, labels = _table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "labels")
    rules = items.groupBy(F.concat(F.lit("R"), F.col("item_id") % 7).alias("ruleId")).agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("evidenceIds"))
    excerpts = items.select(F.col("item_id").cast("string").alias("id"), F.col("item_id").cast("string").alias("chunkId"), F.col("text").alias("quote"))
    docs = _table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    chunks = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("sourceId"), F.when(F.col("quality") == 1, 100).otherwise(80).alias("authority"), F.concat(F.lit("no. "), "doc_id").alias("locatorLabel"))
    sources = docs.select(F.col("source").alias("id")).distinct().withColumn("title", F.upper("id"))
    joined = evidence.evidence_summaries(rules, excerpts, chunks, sources)
    return joined.select("ruleId", F.size("summaries").alias("n_evidence"), F.array_join(F.transform("summaries", lambda s: s["evidenceId"]), ",").alias("evidence_ids"), F.array_join(F.array_distinct(F.transform("summaries", lambda s: s["title"])), ",").alias("titles"), F.when(F.exists("summaries", lambda s: s["authority"] == 100), 100).otherwise(80).alias("authority"))


_EVIDENCE = """WITH x AS (SELECT 'R' || (item_id % 7) AS ruleId, CAST(item_id AS VARCHAR) AS e, upper(source) AS title, CASE WHEN quality = 1 THEN 100 ELSE 80 END AS a
  FROM benchmark JOIN documents ON doc_id = item_id LEFT JOIN labels USING (doc_id)),
t AS (SELECT ruleId, title, min(e) AS first FROM x GROUP BY ALL), tt AS (SELECT ruleId, string_agg(title, ',' ORDER BY first) AS titles FROM t GROUP BY 1)
SELECT ruleId, CAST(count(*) AS INTEGER) AS n_evidence, string_agg(e, ',' ORDER BY e) AS evidence_ids, any_value(titles) AS titles, CAST(max(a) AS INTEGER) AS authority FROM x JOIN tt USING (ruleId) GROUP BY ruleId"""


def active_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    approvals = _table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunkId"), F.col("doc_id").alias("ord"))
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return evidence.active_chunks(approvals, chunks).select(F.col("id").alias("doc_id"), "lang", "n_chars", "ord")


_ACTIVE = "SELECT d.doc_id, lang, n_chars, d.doc_id AS ord FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1"

# --- integrity --------------------------------------------------------------------------------------------------


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: _table(spark, sf_dir, n)
    checks = [("nation.region", t("nation"), "n_regionkey", t("region"), "r_regionkey"), ("customer.nation", t("customer"), "c_nationkey", t("nation"), "n_nationkey"), ("orders.customer", t("orders"), "o_custkey", t("customer"), "c_custkey"), ("lineitem.orders", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), ("labels.documents", t("labels"), "doc_id", t("documents"), "doc_id"), ("documents.labels", t("documents"), "doc_id", t("labels"), "doc_id")]
    out = None
    for name, left, a, right, b in checks:
        one = integrity.dangling(left, a, right, b).agg(F.count("*").alias("n")).select(F.lit(name).alias("reference"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_FK = " UNION ALL ".join(f"SELECT '{n}' AS reference, count(*) AS n FROM {n.split('.')[0]} x WHERE NOT EXISTS (SELECT 1 FROM {n.split('.')[1]} y WHERE y.{b} = x.{a})" for n, a, b in (("nation.region", "n_regionkey", "r_regionkey"), ("customer.nation", "c_nationkey", "n_nationkey"), ("orders.customer", "o_custkey", "c_custkey"), ("lineitem.orders", "l_orderkey", "o_orderkey"), ("labels.documents", "doc_id", "doc_id"), ("documents.labels", "doc_id", "doc_id")))


def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(tx.sha256_upper(F.col("text")).alias("textSha256"))
    return integrity.repeated(docs, "textSha256").select(F.col("id").alias("text_sha256"), "n")


_DUP = "SELECT upper(sha256(text)) AS text_sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"


def hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", tx.sha256_upper(F.col("text")).alias("sha256"))


_HASH = "SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents"


def metadata_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").withColumn("measured", F.length("text").cast("long"))
    other = d.select("doc_id", F.col("measured").alias("n_chars"), F.when(F.col("doc_id") % 7 == 0, "??").otherwise(F.col("lang")).alias("lang"))
    return integrity.differing(d.select("doc_id", "n_chars", "lang"), other, "doc_id", ["n_chars", "lang"]).select("doc_id", F.array_join("columns", ",").alias("columns"))


_MISMATCH = """SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars IS DISTINCT FROM length(text) THEN 'n_chars' END, CASE WHEN doc_id % 7 = 0 AND lang IS DISTINCT FROM '??' THEN 'lang' END], lambda x: x IS NOT NULL), ',') AS columns
FROM documents WHERE n_chars IS DISTINCT FROM length(text) OR (doc_id % 7 = 0 AND lang IS DISTINCT FROM '??')"""

# --- semantic checks --------------------------------------------------------------------------------------------


def _semantic_pack() -> RulePack:
    pack = _plain_pack()
    licence = replace(pack.rule["LICENCE"], outcome="block", semantic=Semantic("licence", ("licence",), ("permission", "under"), ("licen",), ("without",)))
    return pack.with_rules(licence, pack.rule["IPV4"], replace(pack.rule["STYLE-THE-THE"], semantic=Semantic("style", (), ("the",), ("of",), ())))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    span = F.regexp_extract("text", r"(?i)(licen[sc]e|[0-9]+\.[0-9]+|of the)", 1)
    k = F.col("doc_id") % 4
    rule = F.when(k == 0, "IPV4").when(k == 1, "NO-SUCH-RULE").when(k == 2, "STYLE-THE-THE").otherwise("LICENCE")
    profile = F.when(F.col("doc_id") % 8 == 2, "official").otherwise(BOTH)
    return e.select(
        F.col("source").alias("batchId"), F.lit(0).alias("entryOrd"), F.col("doc_id").cast("string").alias("entryId"), "text", "field", profile.alias("profile"), F.lit("pass_no_match").alias("initialStatus"),
        F.lit("c").alias("candidateId"), rule.alias("ruleId"), span.alias("spanText"), F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 2).cast("int").alias("occurrence"), F.when(F.col("doc_id") % 6 == 0, "seen").alias("retryToken"),
    )


def semantic_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = semantic.verify(_candidates(spark, sf_dir), _semantic_pack())
    return v.select(F.col("entryId").cast("long").alias("doc_id"), F.col("errorCode").alias("error_code"), "verification", F.col("finalRecommendation").alias("final"), "retryable")


def semantic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = semantic.verify(_candidates(spark, sf_dir), _semantic_pack())
    return semantic.batch_results(semantic.entry_results(v)).select(F.col("batchId").alias("source"), F.col("processingStatus").alias("processing"), "status")


_VERIFIED = """c AS (SELECT doc_id, source, text, doc_id % 4 AS k, CASE WHEN doc_id % 8 = 2 THEN 0 ELSE 1 END AS ed, regexp_extract(text, '(?i)(licen[sc]e|[0-9]+\\.[0-9]+|of the)', 1) AS span,
  CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS occ, doc_id % 6 = 0 AS tok FROM documents),
n AS (SELECT *, CASE WHEN span = '' THEN 0 ELSE (length(text) - length(replace(text, span, ''))) // greatest(length(span), 1) END AS cnt FROM c),
e AS (SELECT *, CASE WHEN k = 1 THEN 'unknown_rule_id' WHEN k = 2 AND ed = 0 THEN 'rule_not_applicable' WHEN span = '' THEN 'empty_span' WHEN cnt = 0 THEN 'span_not_found' WHEN cnt > 1 AND occ IS NULL THEN 'ambiguous_span'
  WHEN coalesce(occ, 1) > cnt THEN 'occurrence_out_of_range' WHEN k = 0 THEN 'rule_not_semantic' END AS error_code FROM n),
s AS (SELECT *, CASE WHEN error_code IS NULL THEN CASE WHEN coalesce(occ, 1) = 1 THEN instr(text, span) - 1 ELSE instr(substring(text, instr(text, span) + length(span)), span) - 1 + instr(text, span) - 1 + length(span) END END AS st FROM e),
x AS (SELECT *, substring(text, greatest(st - 40, 0) + 1, least(st, 40)) AS l, substring(text, st + length(span) + 1, 40) AS r FROM s),
y AS (SELECT *, greatest(CASE WHEN instr(reverse(l), chr(10)) > 0 THEN length(l) - instr(reverse(l), chr(10)) ELSE -1 END, CASE WHEN instr(reverse(l), '.') > 0 THEN length(l) - instr(reverse(l), '.') ELSE -1 END) AS cut,
  least(nullif(instr(r, chr(10)), 0), nullif(instr(r, '.'), 0)) AS ends FROM x),
z AS (SELECT *, substring(l, cut + 2, 40) || span || substring(r, 1, coalesce(ends, length(r))) AS ctx FROM y),
f AS (SELECT *, CASE WHEN k = 2 THEN regexp_matches(ctx, '(?i)the') ELSE regexp_matches(ctx, '(?i)permission|under') END AS conf, CASE WHEN k = 2 THEN regexp_matches(ctx, '(?i)of') ELSE regexp_matches(ctx, '(?i)licen') END AS supp,
  CASE WHEN k = 2 THEN false ELSE regexp_matches(ctx, '(?i)without') END AS neg FROM z),
v AS (SELECT *, CASE WHEN error_code IS NULL THEN CASE WHEN conf AND NOT neg THEN 'confirmed' WHEN conf OR supp THEN 'supported_but_uncertain' ELSE 'not_supported' END END AS verification FROM f),
verified AS (SELECT doc_id, source, error_code, verification, CASE WHEN error_code IS NOT NULL THEN CASE WHEN tok THEN 'teacher_review' END WHEN verification = 'confirmed' THEN CASE WHEN k = 3 THEN 'prohibited' ELSE 'revise' END
  WHEN verification = 'supported_but_uncertain' THEN 'teacher_review' ELSE 'pass_no_match' END AS final, error_code IS NOT NULL AND NOT tok AS retryable FROM v)"""
_SEMANTIC = f"WITH {_VERIFIED} SELECT doc_id, error_code, verification, final, retryable FROM verified"
_SEMANTIC_BATCHES = f"""WITH {_VERIFIED} SELECT source, CASE WHEN bool_or(retryable) THEN 'retry_required' ELSE 'complete' END AS processing,
  CASE WHEN count(*) FILTER (final = 'prohibited') > 0 THEN 'prohibited' WHEN count(*) FILTER (final = 'revise') > 0 THEN 'revise' WHEN count(*) FILTER (final = 'teacher_review') > 0 THEN 'teacher_review'
  WHEN bool_or(retryable) THEN NULL ELSE 'pass_no_match' END AS status FROM verified GROUP BY source"""

# --- corpus -----------------------------------------------------------------------------------------------------


def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.segments(_table(spark, sf_dir, "documents").select("doc_id", "text"), "\n").select("doc_id", "segment", "start", "end", F.length("body").alias("size"))


_SEGMENTS = """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents), p AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS k, x FROM l),
q AS (SELECT doc_id, k, x[k] AS body, list_sum(list_transform(x[1:k-1], lambda y: length(y) + 1)) AS s FROM p)
SELECT doc_id, CAST(k AS INTEGER) AS segment, CAST(coalesce(s, 0) AS INTEGER) AS start, CAST(coalesce(s, 0) + length(body) AS INTEGER) AS "end", CAST(length(body) AS INTEGER) AS size FROM q"""


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.markup_units(_table(spark, sf_dir, "pages").select("page_id", "html"), "html", "p").select("page_id", F.col("unitIndex").alias("unit_index"), F.col("body").alias("unit_text"))


_PAGE_UNITS = """WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1) AS m FROM pages), u AS (SELECT page_id, unnest(range(1, len(m) + 1)) AS k, m FROM p),
t AS (SELECT page_id, k, trim(regexp_replace(m[k], '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM u)
SELECT page_id, CAST(k AS INTEGER) AS unit_index, body AS unit_text FROM t WHERE body <> ''"""


def content_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), tx.sha256_upper(F.concat_ws("|", "n_nationkey", "n_name")).alias("sha256"))
    return integrity.content_seal(files)


_SEAL = "SELECT upper(sha256(string_agg(path || chr(0) || s || chr(10), '' ORDER BY path))) AS seal, count(*) AS files FROM (SELECT n_name AS path, upper(sha256(n_nationkey || '|' || n_name)) AS s FROM nation)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_findings, scan_by_table, scan_status, scan_editorial_profile, text_measure, length_violations, normalize_text, tokens_per_doc, token_df, search_topk, search_filtered, search_snippet, search_multi,
        quote_containment, provenance_status, overall_status, batch_status, batch_shape_errors, teacher_review, review_counts, suppress_allowlisted, conflict_merge, evidence_join, active_semi_join, fk_violations, dup_ids,
        hash_check, metadata_mismatch, semantic_verify, semantic_batches, segment_lines, page_units, content_seal,
    )
}

ORACLE_SQL: dict[str, str] = {
    "scan_findings": _SCAN_FINDINGS, "scan_by_table": _SCAN_FINDINGS, "scan_status": _SCAN_STATUS, "scan_editorial_profile": _SCAN_EDITORIAL, "text_measure": _TEXT_MEASURE, "length_violations": _LENGTH_VIOLATIONS,
    "normalize_text": _NORMALIZE, "tokens_per_doc": _TOKENS_PER_DOC, "token_df": _TOKEN_DF, "search_topk": _SEARCH_TOPK, "search_filtered": _SEARCH_FILTERED, "search_snippet": _SEARCH_SNIPPET, "search_multi": _SEARCH_MULTI,
    "quote_containment": _QUOTES, "provenance_status": _PROVENANCE_STATUS, "overall_status": _OVERALL, "batch_status": _BATCH_STATUS, "batch_shape_errors": _BATCH_SHAPE, "teacher_review": _TEACHER_REVIEW,
    "review_counts": _REVIEW_COUNTS, "suppress_allowlisted": _SUPPRESS, "conflict_merge": _CONFLICT, "evidence_join": _EVIDENCE, "active_semi_join": _ACTIVE, "fk_violations": _FK, "dup_ids": _DUP, "hash_check": _HASH,
    "metadata_mismatch": _MISMATCH, "semantic_verify": _SEMANTIC, "semantic_batches": _SEMANTIC_BATCHES, "segment_lines": _SEGMENTS, "page_units": _PAGE_UNITS, "content_seal": _SEAL,
}
