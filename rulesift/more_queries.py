"""Further registered queries of the text-rule engine, one for each family of operators that ``queries`` leaves out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift import queries as q
from rulesift import schemas as S
from rulesift.functions import text as tx
from rulesift.operators import decide, findings, integrity, review, search
from rulesift.plans.rulepack import conformance_pack, latin_pack
from rulesift.sources import chunk, extract, layout, render, sinks
from rulesift.streaming import shell

_table = q._table


def _pick(key: Column, *values: object) -> Column:
    """One of the values in turn, by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(key: str, *values: str) -> str:
    return f"([{', '.join(values)}])[{key} % {len(values)} + 1]"


# --- decision tables --------------------------------------------------------------------------------------------


def activity_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lists = [[], ["school"], ["school", "school"], ["education_authority"], ["school", "external"], ["unknown"], ["school", "unknown"]]
    organizers = F.element_at(F.array(*[F.array(*[F.struct(F.lit(x).alias("kind"), F.lit("n").alias("name")) for x in xs]).cast("array<struct<kind:string,name:string>>") for xs in lists]), (k % 7 + 1).cast("int"))
    activity = F.struct(_pick(k, True, True, True, False, None).alias("domestic"), organizers.alias("organizers"), _pick(F.col("o_custkey"), True, False, None).alias("schoolApproved"), _pick(F.col("o_custkey"), True, None, True, False).alias("inSchoolEducationPlan"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", decide.creative_outcome(activity.cast(S.nested(S.ACTIVITY))).alias("outcome"))


_ACTIVITY = f"""SELECT o_orderkey, CASE WHEN d = false OR k IN (4) THEN 'block' WHEN d IS NULL OR k IN (0, 5, 6) THEN 'review' WHEN k IN (1, 2) THEN CASE WHEN p THEN NULL ELSE 'review' END WHEN coalesce(a, false) = false THEN 'review' END AS outcome
FROM (SELECT o_orderkey, o_orderkey % 7 AS k, {_pick_sql('o_orderkey', 'true', 'true', 'true', 'false', 'NULL')} AS d, {_pick_sql('o_custkey', 'true', 'false', 'NULL')} AS a, {_pick_sql('o_custkey', 'true', 'NULL', 'true', 'false')} AS p FROM orders)"""


def volunteer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    v = F.struct(_pick(k, "school", "individual", "unknown", None).alias("planType"), _pick(c, True, False, None).alias("schoolApproved"), _pick(c, True, True, True, None, False).alias("evidenceAvailable"), _pick(k, "service", "service", "service", "simple_donation", "unknown", None, "other").alias("activityKind"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", decide.volunteer_outcome(v).alias("outcome"))


_VOLUNTEER = f"""SELECT o_orderkey, CASE WHEN kind = 'simple_donation' OR (plan = 'individual' AND ok = false) THEN 'block' WHEN plan IS NULL OR plan = 'unknown' OR NOT coalesce(ev, false) OR kind IS NULL OR kind = 'unknown' THEN 'review'
  WHEN kind = 'service' AND (plan = 'school' OR ok) THEN NULL ELSE 'review' END AS outcome
FROM (SELECT o_orderkey, {_pick_sql('o_orderkey', "'school'", "'individual'", "'unknown'", 'NULL')} AS plan, {_pick_sql('o_custkey', 'true', 'false', 'NULL')} AS ok, {_pick_sql('o_custkey', 'true', 'true', 'true', 'NULL', 'false')} AS ev,
  {_pick_sql('o_orderkey', "'service'", "'service'", "'service'", "'simple_donation'", "'unknown'", 'NULL', "'other'")} AS kind FROM orders)"""


def observation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on how a text came about, by itself."""
    k = F.col("o_orderkey")
    p = F.struct(
        _pick(k, "direct", "none", "documented_exception", "unknown", None).alias("observationBasis"), _pick(k, "continuous", "single_event", "unknown", None).alias("observationContinuity"),
        _pick(k, "supported", "known_false", "unverified", "unknown", None, "supported").alias("factualSupport"), _pick(k, "none", "other", "reflection", None, "book_report").alias("studentMaterial"),
        _pick(F.col("o_custkey"), True, False, None).alias("studentMaterialInSchoolEducationPlan"), _pick(F.col("o_custkey"), True, True, None, False).alias("studentMaterialUnderTeacherGuidance"), _pick(k, True, False, None).alias("studentWroteFinalNarrative"),
        _pick(k, "none", "verbatim", "proofreading", "draft_generation_rewritten", "unknown", None).alias("aiUse"), _pick(F.col("o_custkey"), True, False, None).alias("teacherVerifiedAgainstActualPerformance"),
    )
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"))
    rules = {"basis": decide.observation, "continuity": decide.continuity, "accuracy": decide.accuracy, "material": decide.material, "draft": decide.final_draft, "verbatim": decide.ai_verbatim, "verification": decide.ai_verification}
    return rows.select("o_orderkey", *[f(F.col("p")).alias(n) for n, f in rules.items()])


_OBSERVATION = f"""SELECT o_orderkey, CASE b WHEN 'none' THEN 'block' WHEN 'documented_exception' THEN 'review' WHEN 'direct' THEN NULL ELSE 'needs' END AS basis, CASE c WHEN 'continuous' THEN NULL WHEN 'single_event' THEN 'review' ELSE 'needs' END AS continuity,
  CASE f WHEN 'known_false' THEN 'block' WHEN 'unverified' THEN 'review' WHEN 'supported' THEN NULL ELSE 'needs' END AS accuracy,
  CASE WHEN m = 'other' THEN 'block' WHEN m IN ('reflection', 'book_report') THEN CASE WHEN mp = false OR mg = false THEN 'block' WHEN mp AND mg THEN NULL ELSE 'review' END WHEN m IS NULL THEN 'needs' END AS material,
  CASE WHEN w THEN 'block' WHEN w IS NULL THEN 'needs' END AS draft, CASE WHEN a = 'verbatim' THEN 'block' END AS verbatim, CASE WHEN a IN ('proofreading', 'draft_generation_rewritten') THEN CASE WHEN v THEN NULL ELSE 'review' END WHEN a IS NULL OR a = 'unknown' THEN 'needs' END AS verification
FROM (SELECT o_orderkey, {_pick_sql('o_orderkey', "'direct'", "'none'", "'documented_exception'", "'unknown'", 'NULL')} AS b, {_pick_sql('o_orderkey', "'continuous'", "'single_event'", "'unknown'", 'NULL')} AS c,
  {_pick_sql('o_orderkey', "'supported'", "'known_false'", "'unverified'", "'unknown'", 'NULL', "'supported'")} AS f, {_pick_sql('o_orderkey', "'none'", "'other'", "'reflection'", 'NULL', "'book_report'")} AS m, {_pick_sql('o_custkey', 'true', 'false', 'NULL')} AS mp,
  {_pick_sql('o_custkey', 'true', 'true', 'NULL', 'false')} AS mg, {_pick_sql('o_orderkey', 'true', 'false', 'NULL')} AS w, {_pick_sql('o_orderkey', "'none'", "'verbatim'", "'proofreading'", "'draft_generation_rewritten'", "'unknown'", 'NULL')} AS a, {_pick_sql('o_custkey', 'true', 'false', 'NULL')} AS v FROM orders)"""


def routed_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a field's mode asks for: every field of the conformance pack with no metadata, and with a verbatim text of a tool."""
    k = F.col("o_orderkey")
    pack = conformance_pack()
    keys = [f.key for f in pack.fields]
    prov = F.struct(*[(_pick(k, "verbatim", None) if n == "aiUse" else F.lit(None)).alias(n) for n in S.names(S.PROVENANCE)]).cast(S.nested(S.PROVENANCE))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", _pick(k, *keys).alias("field"), prov.alias("p"))
    judged = rows.withColumn("j", decide.provenance(pack, F.col("field"), F.col("p")))
    names = lambda x: F.array_join(x, ",")
    required = F.create_map(*[F.lit(x) for pair in decide.REQUIRED_INPUT.items() for x in pair])
    return judged.select("o_orderkey", names(F.transform("j.matches", lambda m: F.concat(m["ruleId"], F.lit(":"), m["outcome"]))).alias("matches"), names(F.transform("j.needs", lambda n: required[n])).alias("inputs"))


_WATCHED = "f IN ('creative_autonomy_club_special', 'creative_career_special', 'daily_life_special', 'subject_achievement_special', 'behavior_opinion')"
_ROUTED = f"""SELECT o_orderkey, CASE WHEN ai AND ({_WATCHED} OR f = 'volunteer_activity') THEN 'OFFICIAL-AI-VERBATIM:block' ELSE '' END AS matches,
  CASE WHEN {_WATCHED} THEN 'provenance.observationBasis,' || CASE WHEN f = 'behavior_opinion' THEN 'provenance.observationContinuity,' ELSE '' END || 'provenance.factualSupport,provenance.studentMaterial,provenance.studentWroteFinalNarrative' || CASE WHEN ai THEN '' ELSE ',provenance.aiUse' END ELSE '' END AS inputs
FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS ai, {_pick_sql('o_orderkey', *[f"'{f.key}'" for f in conformance_pack().fields])} AS f FROM orders)"""


def allowed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.concat(F.when(k % 3 == 0, F.col("n_name")).otherwise(F.lit("")), _pick(k, " 교 육 청", "교육지원청　", "교육부", " 국립 특수교육원", "연구소"))
    return _table(spark, sf_dir, "nation").select("n_nationkey", decide.allowed_institution(name, ("NATION_9연구소",)).alias("allowed"))


_ALLOWED = f"""SELECT n_nationkey, n ~ '교육청$' OR n ~ '교육지원청$' OR n IN ('교육부', '국립특수교육원', 'NATION_9연구소') AS allowed FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE '' END || {_pick_sql('n_nationkey', "'교육청'", "'교육지원청'", "'교육부'", "'국립특수교육원'", "'연구소'")} AS n FROM nation)""".replace("n ~ '교육청$'", "ends_with(n, '교육청')").replace("n ~ '교육지원청$'", "ends_with(n, '교육지원청')")


def entry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason why an entry can't be judged."""
    k = F.col("doc_id")
    e = _table(spark, sf_dir, "documents").select(
        "doc_id", _pick(k, "behavior_opinion", "daily_life_special", "address", "no_field").alias("field"), F.when(k % 11 == 0, "").when(k % 11 == 1, F.lit(None)).when(k % 11 == 2, F.repeat(F.lit("x"), F.lit(200_001))).otherwise(F.col("text")).alias("text"),
        _pick(k, "official", None, "official_plus_editorial", "draft", None).alias("profile"), _pick(k, None, 1, 6, 0, None, 7, None).cast("int").alias("grade"), _pick(k, None, "general", "special_basic").alias("curriculum"),
    )
    return e.select("doc_id", decide.shape_error(conformance_pack()).alias("error"))


_ENTRY_ERRORS = """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'unsupported field' WHEN doc_id % 11 < 3 OR text IS NULL OR length(text) < 1 OR length(text) > 200000 THEN 'text must contain 1 to 200000 characters' WHEN doc_id % 5 = 3 THEN 'unsupported profile'
  WHEN doc_id % 7 IN (3, 5) THEN 'grade must be an integer from 1 to 6' WHEN doc_id % 4 = 1 AND doc_id % 3 <> 2 THEN 'this field requires curriculum special_basic' END AS error FROM documents"""

# --- findings ---------------------------------------------------------------------------------------------------


def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = findings.validate(q._entries(spark, sf_dir), q._plain_pack())
    told = F.transform("findings", lambda f: F.concat_ws("@", f["ruleId"], F.coalesce(f["start"].cast("string"), F.lit("-")), f["authority"].cast("string"), f["category"], F.length(f["matchedText"]).cast("string")))
    return v.select("doc_id", F.array_join(told, " ").alias("listed"))


_ALL_FINDINGS = f"""{q._hits_sql(q._plain_pack())}, {q._rules_sql(q._plain_pack())}, f AS (
  SELECT doc_id, rule_id, start_cp AS st, authority, outcome, CASE WHEN editorial THEN 'editorial' ELSE 'content' END AS category, least(length(matched), 80) AS n, advice FROM hits JOIN rules USING (rule_id)
  UNION ALL SELECT doc_id, 'LENGTH-' || upper(lang), NULL, 80, 'block', 'length', NULL, 'shorten' FROM documents WHERE strlen(text) > {q._LONG})"""
_FINDING_ORDER = f"""WITH {_ALL_FINDINGS} SELECT d.doc_id, coalesce(string_agg(rule_id || '@' || coalesce(CAST(st AS VARCHAR), '-') || '@' || authority || '@' || category || coalesce('@' || n, ''), ' ' ORDER BY outcome = 'block' DESC, authority DESC, st NULLS LAST, rule_id), '') AS listed
FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


def first_seen_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = q._entries(spark, sf_dir).withColumns({"batchId": F.col("source"), "ord": F.lit(0), "entryId": F.col("doc_id").cast("string")})
    r = review.review(findings.validate(e, q._plain_pack()))
    return r.select(F.col("entryId").cast("long").alias("doc_id"), F.array_join("improvementGuidance", "|").alias("guidance"), F.array_join("rewritePlan.instructions", "|").alias("instructions"))


_FIRST_SEEN = f"""WITH {_ALL_FINDINGS}, o AS (SELECT doc_id, advice, row_number() OVER (PARTITION BY doc_id ORDER BY outcome = 'block' DESC, authority DESC, st NULLS LAST, rule_id) AS k FROM f), m AS (SELECT doc_id, advice, min(k) AS k FROM o GROUP BY ALL),
g AS (SELECT doc_id, string_agg(advice, '|' ORDER BY k) AS s FROM m GROUP BY 1) SELECT doc_id, coalesce(s, '') AS guidance, coalesce(s, '') AS instructions FROM documents LEFT JOIN g USING (doc_id)"""


def status_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of events' entries by hour; the plan of the streaming extension on a table."""
    e = _table(spark, sf_dir, "events").select("ts", F.lit("en").alias("field"), F.concat_ws(" ", F.lit("the"), F.col("event_type"), F.when(F.col("user_id") % 3 == 0, F.lit("and more"))).alias("text"), F.lit("official").alias("profile"))
    quiet = q._batch_pack().with_rules(*[r for r in q._batch_pack().rules if r.id == "WORD-AND"])
    counted = shell.windowed_statuses(findings.validate(e, quiet), size="1 hour")
    return counted.select(F.col("window.start").cast("string").alias("begins"), "status", "n")


_WINDOWS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS begins, CASE WHEN user_id % 3 = 0 THEN 'review' ELSE 'pass' END AS status, count(*) AS n FROM events GROUP BY 1, 2"


def review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people read of each entry's validation, without the closing line."""
    v = findings.validate(q._entries(spark, sf_dir), q._plain_pack()).withColumn("needsContext", F.array().cast("array<string>")).withColumn("findings", F.filter("findings", lambda f: f["category"] == "editorial"))
    told = render.validation_texts(v.withColumn("contextStatus", F.lit("complete")).withColumn("contentStatus", F.when(F.size("findings") > 0, "review").otherwise("pass")), q._plain_pack())
    return told.groupBy("value").agg(F.count("*").alias("n"))


_REVIEW_TEXT = f"""WITH {q._hits_sql(q._plain_pack())}, e AS (SELECT d.doc_id, any_value(d.text) AS text, count(rule_id) FILTER (rule_id = 'STYLE-THE-THE') AS k FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY 1)
SELECT '문안 점검: ' || CASE WHEN k > 0 THEN '검토 필요' ELSE '통과' END || chr(10) || '작성 경위: 확인됨' || chr(10) || '측정: ' || length(text) || '자 / ' || strlen(text) || 'Byte' || repeat(chr(10) || '- STYLE-THE-THE: doubled' || chr(10) || '  권고: reword' || chr(10) || '  {render.HOUSE_WARNING}', k)
  || chr(10) || '{render.DISCLAIMER}' AS value, count(*) AS n FROM e GROUP BY 1"""

# --- texts and passages -----------------------------------------------------------------------------------------


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit(" ﻿ \t"), F.replace("text", F.lit(". "), F.lit(".\r\n　")), F.lit(" \n "))
    forms = {"compact": tx.compact(t), "trimmed": tx.trim(t), "corpus": tx.normalize_corpus(t), "comparable": tx.normalize_comparable(t), "plain_name": tx.normalize_name(t)}
    same = tx.same_comparable(t, F.replace(F.col("text"), F.lit(". "), F.lit(". \n")))
    return _table(spark, sf_dir, "documents").select("doc_id", *[F.sha2(c, 256).alias(n) for n, c in forms.items()], same.alias("same"), F.length(tx.truncate(t)).alias("cut"))


_SPACE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TEXT_FORMS = f"""WITH d AS (SELECT doc_id, text, chr(160) || chr(65279) || ' ' || chr(9) || replace(text, '. ', '.' || chr(13) || chr(10) || chr(12288)) || ' ' || chr(10) || chr(8195) AS t FROM documents),
x AS (SELECT doc_id, text, t, regexp_replace(t, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS trimmed, regexp_replace(t, '{_SPACE}+', '', 'g') AS compact FROM d)
SELECT doc_id, sha256(compact) AS compact, sha256(trimmed) AS trimmed, sha256(replace(trimmed, chr(13) || chr(10), chr(10))) AS corpus, sha256(trim(regexp_replace(t, '{_SPACE}+', ' ', 'g'))) AS comparable, sha256(compact) AS plain_name,
  trim(regexp_replace(t, '{_SPACE}+', ' ', 'g')) = trim(regexp_replace(replace(text, '. ', '. ' || chr(10)), '{_SPACE}+', ' ', 'g')) AS same, CAST(least(length(t), 80) AS INTEGER) AS cut FROM x"""


def page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n "), (F.col("doc_id") % 2000).cast("string"), F.lit(" \r\n"))).otherwise(F.lit("")), F.when(F.col("doc_id") % 6 == 0, F.lit("\n7\n")).otherwise(F.lit("")))
    return _table(spark, sf_dir, "documents").select("doc_id", extract.printed_page(t).alias("page"), F.sha2(F.array_join(extract.page_headings(t), "|"), 256).alias("headings"))


_PAGE_MARKS = """WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || ' ' || (doc_id % 2000) || ' ' || chr(13) || chr(10) ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN chr(10) || '7' || chr(10) ELSE '' END AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\\r?\\n'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS x FROM d),
n AS (SELECT doc_id, x, list_distinct(list_filter(x[1:5] || x[greatest(len(x) - 4, 1):], lambda y: regexp_full_match(y, '[0-9]{1,3}'))) AS m FROM l)
SELECT doc_id, CASE WHEN len(m) = 1 THEN CAST(m[1] AS INTEGER) END AS page, sha256(array_to_string(list_filter(x[1:2], lambda y: length(y) <= 120), '|')) AS headings FROM n"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units of every kind of place."""
    k, n = F.col("doc_id") % 5, F.col("doc_id")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = n.cast("string")
    locator = F.struct(
        F.when(k == 0, "pdf-page").when(k == 4, "appendix").otherwise("article").alias("kind"), F.when(k == 0, n).cast("int").alias("pdfPage"), F.when((k == 0) & (n % 2 == 0), n + 3).cast("int").alias("printedPage"),
        F.when(k == 1, text("제", number, "조")).when(k == 2, text("제", number, "조의2")).when(k == 3, "부칙").alias("article"), F.when(k == 2, text("제", (n % 30).cast("string"), "항")).when(k == 3, text("제", number, "호, 2026. 2. 12.")).alias("paragraph"),
        F.when(k == 4, 7 + n % 5).cast("int").alias("appendix"), F.when(k == 4, n).cast("int").alias("unitIndex"),
    )
    return _table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("rawText"), locator.cast(S.nested(S.LOCATOR)).alias("locator"))


def passage_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("locator")
    return _placed(spark, sf_dir).select("doc_id", chunk.chunk_id(F.col("source"), x).alias("id"), chunk.locator_label(x, "G", "L").alias("label"), search.locator_key(x).alias("sort_key"))


_PASSAGE_PLACES = """SELECT doc_id, source || CASE doc_id % 5 WHEN 0 THEN ':pdf-' || lpad(d, CAST(greatest(3, length(d)) AS INTEGER), '0') WHEN 1 THEN ':article-' || lpad(d, CAST(greatest(2, length(d)) AS INTEGER), '0') WHEN 2 THEN ':article-' || lpad(d, CAST(greatest(2, length(d)) AS INTEGER), '0') || '-2-p' || lpad(p, 2, '0')
    WHEN 3 THEN ':addendum-' || d ELSE ':unit-' || lpad(d, CAST(greatest(4, length(d)) AS INTEGER), '0') END AS id,
  CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'G 인쇄 ' || (doc_id + 3) || '쪽 (PDF ' || d || '쪽)' ELSE 'G PDF ' || d || '쪽' END WHEN 1 THEN 'L 제' || d || '조' WHEN 2 THEN 'L 제' || d || '조의2제' || p || '항' WHEN 3 THEN 'L 부칙제' || d || '항' ELSE 'L 별표 ' || (7 + doc_id % 5) || ', 단위 ' || d END AS label,
  CASE doc_id % 5 WHEN 0 THEN 'P:' || lpad(d, 6, '0') WHEN 1 THEN 'A:제' || d || '조:' WHEN 2 THEN 'A:제' || d || '조의2:제' || p || '항' WHEN 3 THEN 'A:부칙:제' || d || '호, 2026. 2. 12.' ELSE 'X:' || lpad(CAST(7 + doc_id % 5 AS VARCHAR), 2, '0') || ':' || lpad(d, 6, '0') END AS sort_key
FROM (SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS d, CAST(doc_id % 30 AS VARCHAR) AS p FROM documents)"""


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of documents, with roles, authorities and levels by their numbers."""
    k = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("id"), k.alias("k")).distinct().select(
        "id", F.upper("id").alias("title"), F.when(F.col("k") == 9, "verification-copy").when(F.col("k") % 2 == 0, "directive-body").otherwise("primary-guide").alias("role"), F.lit("text").alias("format"), F.when(F.col("k") % 2 == 0, 100).otherwise(80).alias("authority"),
        F.when(F.col("k") == 3, F.array(F.lit("high"))).when(F.col("k") % 2 == 0, F.array(*map(F.lit, ("elementary", "middle", "high")))).otherwise(F.array(F.lit("elementary"))).alias("schoolLevels"), tx.sha256_upper(F.col("id")).alias("sha256"), F.lit(None).cast("string").alias("sourceUrl"), F.col("id").alias("snapshotName"), F.lit(1).alias("minimumExtractedChars"),
    )


def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus documents and how many passages each has."""
    sources = _origins(spark, sf_dir)
    units = _placed(spark, sf_dir).select(F.col("source").alias("sourceId"), "locator", F.array().cast("array<string>").alias("headingPath"), "rawText")
    passages = chunk.chunks(units, sources).groupBy("sourceId").agg(F.count("*").alias("n_passages"), F.count_distinct("textSha256").alias("n_texts"))
    docs = chunk.documents(units, sources)
    return docs.join(passages, "sourceId", "left").select(F.col("sourceId").alias("source"), "role", "authority", F.col("unitCount").alias("units"), F.col("extractedCharCount").alias("chars"), "includedInChunks", F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))


_CORPUS_BUILD = """SELECT source, CASE WHEN source = 'src9' THEN 'verification-copy' WHEN k % 2 = 0 THEN 'directive-body' ELSE 'primary-guide' END AS role, CAST(CASE WHEN k % 2 = 0 THEN 100 ELSE 80 END AS INTEGER) AS authority, CAST(count(*) AS INTEGER) AS units, CAST(sum(length(text)) AS INTEGER) AS chars, source <> 'src9' AS "includedInChunks",
  count(*) FILTER (source <> 'src9' AND b <> '') AS n_passages, count(DISTINCT b) FILTER (source <> 'src9' AND b <> '') AS n_texts
FROM (SELECT source, text, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS k, trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS b FROM documents) GROUP BY source, k"""


def paragraph_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("head \n")).otherwise(F.lit("")), F.lit("① "), F.col("lang"), F.lit(" ② inline\n② "), F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.lit("\n\n⑬ ")).otherwise(F.lit(""))).alias("body"))
    return extract.circled_paragraphs(rows)


_PARAGRAPHS = """SELECT doc_id, p AS paragraph, b AS body FROM (SELECT doc_id, NULL AS p, 'head' AS b FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '1', '① ' || lang || ' ② inline' FROM documents
  UNION ALL SELECT doc_id, '2', '② ' || source FROM documents UNION ALL SELECT doc_id, '13', '⑬' FROM documents WHERE doc_id % 3 = 0)"""


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("z"), F.struct(F.col("n_name").alias("y"), F.array(F.struct(F.lit("é\"\n").alias("d"), F.col("n_regionkey").alias("c"))).alias("b")).alias("a"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("x")).alias("m"))
    return sinks.json_lines(rows)


_CANONICAL = r"""SELECT '{"a":{"b":[{"c":' || n_regionkey || ',"d":"é\"\n"}],"y":"' || n_name || '"},' || CASE WHEN n_nationkey % 2 = 0 THEN '"m":"x",' ELSE '' END || '"z":' || n_nationkey || '}' AS value FROM nation"""

# --- search with sources ----------------------------------------------------------------------------------------


def search_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(q._passages(spark, sf_dir), q.QUERY, 20, key="doc_id", roles=["directive-body", "verification-copy"], source_ids=["src2", "src4", "src9", "src1"], sources=_origins(spark, sf_dir))
    return found.select("doc_id", "title", "role", "sourceSha256", F.round("score", 6).alias("score"))


_SEARCH_ROLE = f"""WITH {q._SCORED} SELECT doc_id, upper(source) AS title, CASE source WHEN 'src9' THEN 'verification-copy' ELSE 'directive-body' END AS role, upper(sha256(source)) AS "sourceSha256", round(score, 6) AS score FROM scored WHERE source IN ('src2', 'src4', 'src9') {q._TOP}"""

# --- integrity --------------------------------------------------------------------------------------------------


def set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only one of two file sets has, and whether lists are equal with and without their order."""
    n = _table(spark, sf_dir, "nation")
    odd = integrity.same_rows(n.where("n_nationkey < 20").select("n_regionkey"), n.where("n_nationkey > 3").select("n_regionkey")).groupBy("n_regionkey").agg(F.count("*").alias("only_one"))
    lists = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("x")).withColumn("y", F.when(F.col("n_regionkey") % 2 == 0, F.reverse("x")).otherwise(F.slice("x", 2, 100)))
    return lists.join(odd, "n_regionkey", "left").select("n_regionkey", F.coalesce("only_one", F.lit(0)).alias("only_one"), (F.col("x") == F.col("y")).alias("same_order"), integrity.same_set(F.col("x"), F.col("y")).alias("same_set"))


_SET_CHECKS = """WITH a AS (SELECT n_regionkey FROM nation WHERE n_nationkey < 20), b AS (SELECT n_regionkey FROM nation WHERE n_nationkey > 3), odd AS (SELECT n_regionkey, count(*) AS k FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY 1),
l AS (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1)
SELECT n_regionkey, coalesce(k, 0) AS only_one, n_regionkey % 2 = 0 AND c = 1 AS same_order, n_regionkey % 2 = 0 AS same_set FROM l LEFT JOIN odd USING (n_regionkey)"""


def _spoiled(spark: SparkSession, sf_dir: str) -> integrity.Bundle:
    """A bundle of the driver's tables with faults of every kind that tables can have."""
    docs, k = _table(spark, sf_dir, "documents"), F.col("doc_id")
    sources = _origins(spark, sf_dir)
    name = F.col("id")
    corpus = sources.where(name != "src5").select(
        F.when(name == "src6", "src66").otherwise(name).alias("sourceId"), F.when(name == "src2", "other").otherwise(F.col("title")).alias("title"), "role", "format", "authority", "schoolLevels", F.when(name == "src8", "0").otherwise(F.col("sha256")).alias("sourceSha256"), "sourceUrl", "snapshotName", F.lit(1).alias("unitCount"), F.lit(1).alias("extractedCharCount"),
        F.when(name == "src4", F.col("role") == "verification-copy").otherwise(F.col("role") != "verification-copy").alias("includedInChunks"),
    )
    joined = docs.join(sources.select(F.col("id").alias("source"), "authority", "schoolLevels"), "source")
    chunks = joined.where((F.col("source") != "src9") | (k % 2 == 0)).select(
        k.cast("string").alias("id"), F.when(k % 97 == 5, "srcX").otherwise(F.col("source")).alias("sourceId"), F.when(k % 50 == 7, 10).otherwise(F.col("authority")).alias("authority"), "schoolLevels", F.when(k % 60 == 11, " ").otherwise(F.col("text")).alias("text"),
        F.when(k % 40 == 3, "x").otherwise(tx.normalize_search(F.col("text"))).alias("searchText"), F.when(k % 30 == 1, "0").otherwise(tx.sha256_upper(F.col("text"))).alias("textSha256"),
    )
    labels = _table(spark, sf_dir, "labels")
    active = labels.where("quality = 1").select((k + F.when(F.col("toxic") == 1, 1_000_000_000).otherwise(0)).cast("string").alias("chunkId"), F.when(k % 3 == 0, "common").otherwise("elementary").alias("scope"), F.lit("r").alias("reason"))
    i = F.col("item_id")
    evidence = _table(spark, sf_dir, "benchmark").select(i.cast("string").alias("id"), i.cast("string").alias("chunkId"), F.col("text").alias("quote"), F.when(i % 9 == 0, "0").otherwise(tx.sha256_upper(F.col("text"))).alias("quoteSha256"))
    declared = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", None, "1")], "path string, declared string, actual string")
    return integrity.Bundle(sources, corpus, chunks, active, evidence, latin_pack(), corpus_counts=(20, 1), corpus_hashes=declared)


_TABLE_KINDS = ("corpus-file-hash", "corpus-count", "source-school-scope", "source-document-reference", "source-document-metadata", "source-chunk-reference", "source-chunk-metadata", "chunk-text-hash", "chunk-search-text", "document-chunk-inclusion", "active-chunk-reference", "active-chunk-empty", "active-chunk-scope", "evidence-active-reference", "evidence-quote-hash", "evidence-quote-containment")


def bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, n: rows that violate each check of tables."""
    b, out = _spoiled(spark, sf_dir), None
    for kind, _, check in integrity.CHECKS:
        if kind in _TABLE_KINDS:
            one = check(b).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
            out = one if out is None else out.unionByName(one)
    return out


_E = "CASE WHEN s = 3 THEN 'h' WHEN s % 2 = 0 THEN 'all' ELSE 'e' END"
_VIOLATIONS = f"""WITH src AS (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS s FROM documents),
ch AS (SELECT doc_id AS k, CASE WHEN doc_id % 97 = 5 THEN 'srcX' ELSE source END AS sid, s, CASE WHEN doc_id % 60 = 11 THEN ' ' ELSE text END AS t, text AS raw, {_E} AS lv, n FROM (SELECT *, {q._NORM} AS n FROM documents) JOIN src USING (source) WHERE source <> 'src9' OR doc_id % 2 = 0),
doc AS (SELECT CASE source WHEN 'src6' THEN 'src66' ELSE source END AS sid, source, s, source = 'src9' AS copy, CASE WHEN source = 'src4' THEN source = 'src9' ELSE source <> 'src9' END AS inc FROM src WHERE source <> 'src5'),
nch AS (SELECT DISTINCT sid FROM ch), act AS (SELECT doc_id + CASE WHEN toxic = 1 THEN 1000000000 ELSE 0 END AS k, CASE WHEN doc_id % 3 = 0 THEN 'all' ELSE 'e' END AS scope FROM labels WHERE quality = 1),
ev AS (SELECT item_id AS k, text AS quote, {q._NORM} AS qn FROM benchmark)
SELECT 'corpus-file-hash' AS kind, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'corpus-count', 1 UNION ALL SELECT 'source-school-scope', count(*) FROM src WHERE s = 3
UNION ALL SELECT 'source-document-reference', (SELECT count(*) FROM doc WHERE sid NOT IN (SELECT source FROM src)) + (SELECT count(*) FROM src WHERE source NOT IN (SELECT sid FROM doc))
UNION ALL SELECT 'source-document-metadata', count(*) FROM doc WHERE sid IN ('src2', 'src8') UNION ALL SELECT 'source-chunk-reference', count(*) FROM ch WHERE sid = 'srcX'
UNION ALL SELECT 'source-chunk-metadata', count(*) FROM ch WHERE sid <> 'srcX' AND k % 50 = 7 UNION ALL SELECT 'chunk-text-hash', count(*) FROM ch WHERE k % 30 = 1 OR t <> raw
UNION ALL SELECT 'chunk-search-text', count(*) FROM (SELECT k, CASE WHEN k % 60 = 11 THEN '' ELSE n END AS a, CASE WHEN k % 40 = 3 THEN 'x' ELSE n END AS b FROM ch) WHERE a <> b
UNION ALL SELECT 'document-chunk-inclusion', count(*) FROM doc LEFT JOIN nch USING (sid) WHERE inc <> (nch.sid IS NOT NULL) OR copy = (nch.sid IS NOT NULL)
UNION ALL SELECT 'active-chunk-reference', count(*) FROM act WHERE k NOT IN (SELECT k FROM ch) UNION ALL SELECT 'active-chunk-empty', count(*) FROM act JOIN ch USING (k) WHERE trim(t) = '' OR trim(CASE WHEN k % 40 = 3 THEN 'x' ELSE n END) = ''
UNION ALL SELECT 'active-chunk-scope', count(*) FROM act JOIN ch USING (k) WHERE lv <> scope UNION ALL SELECT 'evidence-active-reference', count(*) FROM ev WHERE k NOT IN (SELECT k FROM act)
UNION ALL SELECT 'evidence-quote-hash', count(*) FROM ev WHERE k % 9 = 0 UNION ALL SELECT 'evidence-quote-containment', count(*) FROM ev JOIN ch USING (k) WHERE qn = '' OR NOT contains(CASE WHEN k % 60 = 11 THEN '' ELSE n END, qn)"""

def layout_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each document written as JSON, with faults of several kinds put in."""
    k, n = F.col("doc_id"), F.col("n_chars").cast("string")
    number = F.when(k % 23 == 0, F.concat(F.lit('"'), n, F.lit('"'))).when(k % 37 == 0, F.concat(n, F.lit(".5"))).when(k % 41 == 0, F.lit("null")).otherwise(F.concat(n, F.lit(".0")))
    parts = [
        F.when(k % 19 != 0, F.concat(F.lit('"id":"D'), k.cast("string"), F.lit('"'))), F.concat(F.lit('"lang":"'), F.when(k % 29 == 0, "xx").otherwise(F.col("lang")), F.lit('"')), F.concat(F.lit('"n":'), number),
        F.concat(F.lit('"origin":{"source":"'), F.col("source"), F.lit('"'), F.when(k % 17 == 0, ',"extra":1').otherwise(""), F.lit("}")), F.when(k % 3 == 0, '"tags":["a","b"]').when(k % 3 == 1, F.when(k % 31 == 0, '"tags":["a","a"]').otherwise('"tags":["b"]')),
    ]
    raw = F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.when(k % 43 == 0, "").when(k % 47 == 0, "}}").otherwise("}"))
    kind = layout.closed(
        {"id": layout.matching("D[0-9]+"), "lang": layout.one_of("en", "fr", "de", "es"), "n": layout.count, "origin": layout.closed({"source": layout.name})},
        {"tags": layout.many(layout.one_of("a", "b"), 1, 2, distinct=True)},
    )
    rows = _table(spark, sf_dir, "documents").select("doc_id", layout.parsed(raw).alias("v"))
    return rows.select("doc_id", F.when(F.col("v").isNull(), "json-syntax").when(~layout.holds(kind), "schema").otherwise("sound").alias("verdict"))


_LAYOUT_FAULTS = """SELECT doc_id, CASE WHEN doc_id % 43 = 0 OR doc_id % 47 = 0 THEN 'json-syntax'
  WHEN doc_id % 23 = 0 OR doc_id % 37 = 0 OR doc_id % 41 = 0 OR doc_id % 19 = 0 OR doc_id % 29 = 0 OR doc_id % 17 = 0 OR (doc_id % 3 = 1 AND doc_id % 31 = 0) THEN 'schema' ELSE 'sound' END AS verdict FROM documents"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        activity_outcomes, volunteer_outcomes, observation_outcomes, routed_needs, allowed_names, entry_errors, finding_order, first_seen_advice, status_windows, review_text, text_forms, page_marks, passage_places, corpus_build, paragraph_marks, canonical_rows, search_by_role, set_checks, bundle_violations, layout_faults,
    )
}

ORACLE_SQL: dict[str, str] = {
    "activity_outcomes": _ACTIVITY, "volunteer_outcomes": _VOLUNTEER, "observation_outcomes": _OBSERVATION, "routed_needs": _ROUTED, "allowed_names": _ALLOWED, "entry_errors": _ENTRY_ERRORS, "finding_order": _FINDING_ORDER, "first_seen_advice": _FIRST_SEEN, "status_windows": _WINDOWS, "review_text": _REVIEW_TEXT,
    "text_forms": _TEXT_FORMS, "page_marks": _PAGE_MARKS, "passage_places": _PASSAGE_PLACES, "corpus_build": _CORPUS_BUILD, "paragraph_marks": _PARAGRAPHS, "canonical_rows": _CANONICAL, "search_by_role": _SEARCH_ROLE, "set_checks": _SET_CHECKS, "bundle_violations": _VIOLATIONS, "layout_faults": _LAYOUT_FAULTS,
}
