"""Findings of an entry and their roll-up to statuses.

All of it is local to a row: an entry's matches become an array of findings, which is made distinct, merged where rules
conflict, sorted and judged with array functions. Validation of a table needs no shuffle; only roll-ups over batches do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift import schemas as S
from rulesift.functions.text import measure, once, plain_names, truncate
from rulesift.operators import decide
from rulesift.operators.scan import scan_array
from rulesift.plans.rulepack import Rule, RulePack

FINDINGS = f"array<{S.nested(S.FINDING)}>"
CONFLICT = "SOURCE-RULE-CONFLICT"
SPECIFIC_NAME = "OFFICIAL-SPECIFIC-NAME"


def evidence_of(pack: RulePack, rule: Rule) -> Column:
    """The excerpts that a rule cites, as a literal in the rule's order; an official rule without any is an error of the pack."""
    kind = f"array<{S.nested(S.EVIDENCE_SUMMARY)}>"
    if rule.editorial:
        return F.array().cast(kind)
    if not rule.evidence or any(e not in pack.evidence_of for e in rule.evidence):
        raise ValueError(f"official rule without evidence: {rule.id}")
    cited = [pack.evidence_of[e] for e in rule.evidence]
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("evidenceId", "chunkId", "sourceId", "title", "authority", "locatorLabel", "quote"), (e.id, e.chunk_id, e.source_id, e.title, e.authority, e.locator_label, e.quote), strict=True)]) for e in cited]).cast(kind)


def authority_of(pack: RulePack, rule: Rule) -> int:
    return 10 if rule.editorial else 100 if any(pack.evidence_of[e].authority == 100 for e in rule.evidence if e in pack.evidence_of) else 80


def _facts(pack: RulePack, rules: list[Rule], category: str) -> Column:
    """Literal map from rule id to what a finding takes from its rule."""
    pairs = []
    for r in rules:
        facts = F.struct(
            F.lit(r.authority_class).alias("authorityClass"), F.lit(authority_of(pack, r)).alias("authority"), F.lit(r.outcome).alias("outcome"),
            F.lit("editorial" if r.editorial else category).alias("category"), F.lit(r.message).alias("message"), F.lit(r.recommendation).alias("recommendation"),
            evidence_of(pack, r).alias("evidence"), F.lit(r.local_policy if r.editorial else None).cast("string").alias("localPolicyId"),
        )
        pairs += [F.lit(r.id), facts]
    return F.create_map(*pairs)


def _finding(rule_id: Column, facts: Column, outcome: Column, text: Column | None, start: Column | None, end: Column | None, start_cp: Column | None) -> Column:
    none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    return F.struct(
        rule_id.alias("ruleId"), facts["authorityClass"].alias("authorityClass"), facts["authority"].alias("authority"), outcome.alias("outcome"), facts["category"].alias("category"),
        facts["message"].alias("message"), facts["recommendation"].alias("recommendation"), (none_text if text is None else truncate(text)).alias("matchedText"),
        (none_int if start is None else start).alias("start"), (none_int if end is None else end).alias("end"), (none_int if start_cp is None else start_cp).alias("startCp"),
        facts["evidence"].alias("evidence"), facts["localPolicyId"].alias("localPolicyId"), F.lit(None).cast("array<string>").alias("conflictingRuleIds"),
    )


def _from_hits(pack: RulePack, hits: Column) -> Column:
    rules = pack.phrases()
    if not rules:
        return F.array().cast(FINDINGS)
    facts = _facts(pack, rules, "content")
    return F.transform(hits, lambda h: _finding(h["ruleId"], facts[h["ruleId"]], facts[h["ruleId"]]["outcome"], h["text"], h["start"], h["end"], h["startCp"])).cast(FINDINGS)


def _from_verdicts(pack: RulePack, verdicts: Column, rules: list[Rule], category: str) -> Column:
    if not rules:
        return F.array().cast(FINDINGS)
    facts = _facts(pack, rules, category)
    known = F.filter(verdicts, lambda v: v["ruleId"].isin(*[r.id for r in rules]))
    return F.transform(known, lambda v: _finding(v["ruleId"], facts[v["ruleId"]], v["outcome"], None, None, None, None)).cast(FINDINGS)


def length_verdicts(pack: RulePack, field: Column, text: Column) -> Column:
    """Byte limits, by field; system ranges have none."""
    size, out = measure(text)["byteCount"], F.array().cast(decide.VERDICT)
    for f in pack.fields:
        if f.length_kind != "system-range" and f.length_rule and f.length_rule in pack.rule:
            out = F.when(field == f.key, decide.one(f.length_rule, F.when(size > f.max_bytes, "block"))).otherwise(out)
    return out


def distinct_findings(found: Column) -> Column:
    """The first of each (rule, start, end): places are sorted, compared with their neighbour, and put back in order."""
    place = lambda f: F.concat_ws("\0", f["ruleId"], F.coalesce(f["start"].cast("string"), F.lit("")), F.coalesce(f["end"].cast("string"), F.lit("")))
    keyed = F.array_sort(F.transform(found, lambda f, i: F.struct(place(f).alias("at"), i.alias("i"))))
    before = F.concat(F.array(F.lit("")), F.transform(keyed, lambda k: k["at"]))  # no place is the empty text
    new = F.filter(F.zip_with(keyed, before, lambda k, last: F.when(k["at"] != last, k["i"])), lambda i: i.isNotNull())
    return F.transform(F.array_sort(new), lambda i: F.get(found, i))


def conflict_pairs(pack: RulePack) -> dict[str, list[str]]:
    """Rules that name each other, both ways."""
    return {r.id: sorted({o for o in r.conflicts if o in pack.rule and r.id in pack.rule[o].conflicts and o != r.id}) for r in pack.rules if r.conflicts}


def _conflicting(pack: RulePack) -> dict[str, list[str]]:
    pairs = {k: v for k, v in sorted(conflict_pairs(pack).items()) if v}
    editorial = [i for i in pairs if pack.rule[i].editorial]
    if editorial and any(o in editorial for i in editorial for o in pairs[i]):
        raise ValueError(f"conflicting rules without evidence: {', '.join(editorial)}")
    return pairs


def conflict_labels(pack: RulePack, found: Column) -> Column:
    """For each rule in conflict, in order, the label of its component of two or more matched rules, or null.

    Components are labelled by the smallest rule that can be reached over matched rules: as many rounds as there are
    rules in conflict, over an array of labels.
    """
    pairs = _conflicting(pack)
    ids = list(pairs)
    names = F.array(*map(F.lit, ids)).cast("array<string>")
    if not ids:
        return F.array().cast("array<int>")
    near = F.array(*[F.array(*[F.lit(ids.index(o) + 1) for o in pairs[i]]) for i in ids])
    met = F.array_distinct(F.transform(found, lambda f: f["ruleId"]))
    start = F.transform(names, lambda n, i: F.when(F.array_contains(met, n), i + 1))

    def spread(labels: Column, _: Column) -> Column:
        return F.transform(labels, lambda own, i: F.when(own.isNotNull(), F.array_min(F.array_append(F.transform(F.element_at(near, i + 1), lambda j: F.element_at(labels, j)), own))))

    def shared(labels: Column) -> Column:
        return F.transform(labels, lambda own: F.when(own.isNotNull() & (F.size(F.filter(labels, lambda other: other == own)) > 1), own))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(ids))), start, spread, shared)


def merge_conflicts(pack: RulePack, found: Column, joined: Column | None = None) -> Column:
    """Each component of matched rules that name each other becomes one review finding with the evidence of all.

    Packs without conflicts get the findings as they are. ``joined``: the column with the row's ``conflict_labels``; a row
    with many findings needs it, else they are worked out for each one.
    """
    ids = list(_conflicting(pack))
    if not ids:
        return found
    joined = conflict_labels(pack, found) if joined is None else joined
    names = F.array(*map(F.lit, ids))

    def label(f: Column) -> Column:
        return F.get(joined, (F.array_position(names, f["ruleId"]) - 1).cast("int"))

    kept = F.filter(found, lambda f: label(f).isNull())
    groups = F.array_sort(F.array_distinct(F.filter(joined, lambda x: x.isNotNull())))

    def merged(g: Column) -> Column:
        own = F.filter(found, lambda f: label(f) == g)
        evidence = F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda f: f["evidence"]))))  # by evidenceId, the first field
        rules = F.array_sort(F.array_distinct(F.transform(own, lambda f: f["ruleId"])))
        none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")
        return F.struct(
            F.lit(CONFLICT).alias("ruleId"), F.lit("official-policy").alias("authorityClass"), F.when(F.exists(own, lambda f: f["authority"] == 100), 100).otherwise(80).alias("authority"),
            F.lit("review").alias("outcome"), F.lit("conflict").alias("category"), F.lit("서로 충돌하는 규칙이 함께 탐지되었습니다.").alias("message"), F.lit("두 근거를 함께 확인하세요.").alias("recommendation"),
            none_text.alias("matchedText"), none_int.alias("start"), none_int.alias("end"), none_int.alias("startCp"), evidence.alias("evidence"), none_text.alias("localPolicyId"), rules.alias("conflictingRuleIds"),
        )

    return F.concat(kept, F.transform(groups, merged).cast(FINDINGS))


def sort_findings(found: Column) -> Column:
    """Blocks first, then by falling authority, start (none last), rule."""

    def key(f: Column) -> Column:
        return F.struct(F.when(f["outcome"] == "block", 0).otherwise(1).alias("o"), (-f["authority"]).alias("a"), F.coalesce(f["start"], F.lit(2147483647)).alias("s"), f["ruleId"].alias("r"))

    def compare(a: Column, b: Column) -> Column:
        x, y = key(a), key(b)
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    return F.array_sort(found, compare)


def content_status(found: Column) -> Column:
    rest = F.filter(found, lambda f: f["category"] != "provenance")
    return F.when(F.exists(rest, lambda f: f["outcome"] == "block"), "blocked").when(F.size(rest) > 0, "review").otherwise("pass")


def context_status(found: Column, needs: Column) -> Column:
    own = F.filter(found, lambda f: f["category"] == "provenance")
    return F.when(F.exists(own, lambda f: f["outcome"] == "block"), "blocked").when(F.size(own) > 0, "review").when(F.size(needs) > 0, "needs_context").otherwise("complete")


def severity(status: Column, order: tuple[str, ...]) -> Column:
    """Place in an order from mild to severe, to be taken the maximum of."""
    return reduce(lambda out, x: F.when(status == x[1], x[0]).otherwise(out), enumerate(order, 1), F.lit(None).cast("int"))


def by_severity(place: Column, order: tuple[str, ...]) -> Column:
    return reduce(lambda out, x: F.when(place == x[0], x[1]).otherwise(out), enumerate(order, 1), F.lit(None).cast("string"))


def overall_status(content: Column, context: Column) -> Column:
    return by_severity(F.greatest(severity(content, S.OVERALL_STATUS), severity(F.when(context == "complete", "pass").otherwise(context), S.OVERALL_STATUS)), S.OVERALL_STATUS)


def names_met(hits: Column, activity: Column) -> Column:
    """Map from the names that a row's suppression compares to their plain forms; empty where the rule has no hit."""
    own = F.transform(F.filter(hits, lambda h: h["ruleId"] == SPECIFIC_NAME), lambda h: h["text"])
    organizers = F.transform(F.coalesce(activity["organizers"], F.array().cast("array<struct<kind:string,name:string>>")), lambda o: o["name"])
    return plain_names(F.when(F.size(own) > 0, F.concat(own, organizers)).otherwise(F.array().cast("array<string>")))


def suppressed(hit: Column, field: Column, activity: Column, activity_outcome: Column, institutions: tuple[str, ...], plain: Column) -> Column:
    """Names that need no review: allowed institutions, and organizers of a creative activity that is in order. plain: of ``names_met``."""
    organizers = F.coalesce(activity["organizers"], F.array().cast("array<struct<kind:string,name:string>>"))
    name = F.try_element_at(plain, hit["text"])
    named = F.exists(organizers, lambda o: o["name"].isNotNull() & (F.try_element_at(plain, o["name"]) == name))
    return (hit["ruleId"] == SPECIFIC_NAME) & F.coalesce(decide.allowed_plain(name, institutions) | (field.isin(*decide.CREATIVE_FIELDS) & activity_outcome.isNull() & F.coalesce(named, F.lit(False))), F.lit(False))


def validate(entries: DataFrame, pack: RulePack, institutions: tuple[str, ...] = (), extra: bool = True) -> DataFrame:
    """The columns of ``entries`` with error, profile, findings, needsContext, measurement and the three statuses.

    ``entries`` has field, text, profile; provenance, activityContext and volunteerContext may be missing. An entry with
    an error has null statuses. Names are compared in NFKC without blanks; only rows in which the rule on names has hits
    go to Python for that.
    """
    have = set(entries.columns)
    optional = {"provenance": S.nested(S.PROVENANCE), "activityContext": S.nested(S.ACTIVITY), "volunteerContext": S.nested(S.VOLUNTEER), "grade": "int", "curriculum": "string", "profile": "string"}
    for name, kind in optional.items():
        if name not in have:
            entries = entries.withColumn(name, F.lit(None).cast(kind))
    checked = entries.withColumn("error", decide.shape_error(pack)).withColumn("profile", F.coalesce("profile", F.lit(pack.default_profile)))
    field, text = F.col("field"), F.col("text")
    activity_outcome = F.when(field.isin(*decide.CREATIVE_FIELDS), decide.creative_outcome(F.col("activityContext")))
    volunteer = F.when(field == "volunteer_activity", decide.volunteer_outcome(F.col("volunteerContext")))
    staged = checked.withColumns({"__hits": scan_array(pack, text, F.col("profile"), field), "__prov": decide.provenance(pack, field, F.col("provenance")), "__creative": activity_outcome, "__volunteer": volunteer})
    hits = F.col("__hits")
    if SPECIFIC_NAME in pack.rule:
        staged = once(staged, __hits=hits).withColumn("__plain", names_met(hits, F.col("activityContext")))
        hits = F.filter(hits, lambda h: ~suppressed(h, field, F.col("activityContext"), F.col("__creative"), institutions, F.col("__plain")))
    kinds = {k: [r for r in pack.rules if r.kind == k] for k in ("length", "metadata", "context")}
    context = F.concat(decide.one("FIELD-CREATIVE-ACTIVITY-SCOPE", F.col("__creative")), decide.one("FIELD-VOLUNTEER-ELIGIBILITY", F.col("__volunteer")))
    raw = F.concat(
        _from_verdicts(pack, length_verdicts(pack, field, text), kinds["length"], "length"),
        _from_hits(pack, hits),
        _from_verdicts(pack, F.col("__prov.matches"), kinds["metadata"], "provenance"),
        _from_verdicts(pack, context, kinds["context"], "context"),
    )
    judged = once(once(staged, __raw=raw), __once=distinct_findings(F.col("__raw")))
    judged = once(judged, __joined=conflict_labels(pack, F.col("__once"))).withColumn("findings", sort_findings(merge_conflicts(pack, F.col("__once"), F.col("__joined"))))
    needs = F.filter(F.col("__prov.needs"), lambda n: n.isin(*pack.rule))
    judged = judged.withColumns({"needsContext": needs, "measurement": measure(text)})
    judged = judged.withColumns({"contentStatus": content_status(F.col("findings")), "contextStatus": context_status(F.col("findings"), F.col("needsContext"))})
    ok = F.col("error").isNull()
    final = judged.withColumn("status", F.when(ok, overall_status(F.col("contentStatus"), F.col("contextStatus")))).withColumns({"contentStatus": F.when(ok, F.col("contentStatus")), "contextStatus": F.when(ok, F.col("contextStatus"))})
    return final.drop("__plain", "__hits", "__prov", "__creative", "__volunteer", "__raw", "__once", "__joined")


def batch_errors(entries: DataFrame) -> DataFrame:
    """batchId, n, error: batches of the wrong size, with repeated ids or ids of the wrong length."""
    shaped = entries.groupBy("batchId").agg(F.count("*").alias("n"), F.count_distinct("entryId").alias("ids"), F.bool_or(F.col("entryId").isNull() | (F.length("entryId") < 1) | (F.length("entryId") > S.MAX_ID)).alias("bad"))
    error = decide.cascade((F.col("n") > S.MAX_BATCH, "batch size"), (F.col("bad"), "entry id"), (F.col("ids") < F.col("n"), "duplicate entry id"))
    return shaped.select("batchId", "n", error.alias("error")).where("error IS NOT NULL")


def batch_status(validated: DataFrame) -> DataFrame:
    """batchId, entries, status: the severest status; error where a row has one, as a bad entry rejects its batch."""
    rolled = validated.groupBy("batchId").agg(F.count("*").alias("entries"), F.max(severity(F.col("status"), S.OVERALL_STATUS)).alias("place"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("error"))
    return rolled.select("batchId", "entries", F.when(F.col("error").isNull(), by_severity(F.col("place"), S.OVERALL_STATUS)).alias("status"), "error")
