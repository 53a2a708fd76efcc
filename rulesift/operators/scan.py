"""Scanning texts for a pack's patterns.

``located`` gives the matches of one pattern with code-point and UTF-16 offsets, in built-in functions. ``scan_array``
folds all rules of a pack into one projection: the text is read once, patterns are literals that a task compiles once,
and rows without a hit cost one search for each pattern. ``scan_exploded`` is the other strategy: texts meet the patterns
by the literals that these can't do without; it serves packs of many patterns, and as a check of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.functions.patterns import fold, jvm, required
from rulesift.functions.text import cumulative, once, utf16_length
from rulesift.operators.contain import meet
from rulesift.plans.rulepack import Rule, RulePack

HIT = "struct<text:string,start:int,end:int,startCp:int>"
NO_HITS = f"array<{HIT}>"


def located(text: Column, pattern: Column) -> Column:
    """Array of (text, start, end, startCp); start and end in UTF-16 units, startCp in code points. Matches are never empty (the gate sees to that)."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.call_function("split", text, pattern, F.lit(-1)), 1, F.size(found))
    sized = F.zip_with(found, gaps, lambda t, g: F.struct(t.alias("text"), utf16_length(g).cast("int").alias("gap"), utf16_length(t).cast("int").alias("own"), F.length(g).alias("gapCp"), F.length(t).alias("ownCp")))

    def placed(pairs: Column) -> Column:
        starts = F.zip_with(cumulative(F.transform(pairs, lambda x: x["gap"] + x["own"])), cumulative(F.transform(pairs, lambda x: x["gapCp"] + x["ownCp"])), lambda a, b: F.struct(a.alias("at"), b.alias("cp")))

        def hit(x: Column, s: Column) -> Column:
            start = s["at"] + x["gap"]
            return F.struct(x["text"].alias("text"), start.cast("int").alias("start"), (start + x["own"]).cast("int").alias("end"), (s["cp"] + x["gapCp"]).cast("int").alias("startCp"))

        return F.zip_with(pairs, starts, hit)

    return F.element_at(F.transform(F.array(sized), placed), 1)  # the pairs are made once


def hits_of(text: Column, pattern: str) -> Column:
    """``located`` behind a test, so that texts without a match are searched once."""
    return F.when(text.rlike(pattern), located(text, F.lit(pattern))).otherwise(F.array().cast(NO_HITS))


def enabled(rule: Rule, profile: Column, field: Column) -> Column:
    """Profile and field let the rule run."""
    on = F.lit(True) if not rule.editorial else profile == "official_plus_editorial"
    return on if rule.applies_to is None else on & field.isin(*rule.applies_to)


def scan_array(pack: RulePack, text: Column, profile: Column, field: Column) -> Column:
    """Array of (ruleId, text, start, end, startCp) in the order of rules, patterns and places; a place counts once for each rule."""
    none = F.array().cast("array<struct<ruleId:string,text:string,start:int,end:int,startCp:int>>")
    silent = [f.key for f in pack.fields if f.content_mode == "none"]
    parts = []
    for rule in pack.phrases():
        hits = [hits_of(text, jvm(p, rule.literal, rule.ignore_case)) for p in rule.patterns]
        # equal places have equal texts, so distinct structs are distinct places
        all_hits = hits[0] if len(hits) == 1 else F.array_distinct(F.concat(*hits))
        named = F.transform(all_hits, _naming(rule.id))
        parts.append(F.when(enabled(rule, profile, field), named).otherwise(none))
    if not parts:
        return none
    found = F.concat(*parts)
    return F.when(field.isin(*silent), none).otherwise(found) if silent else found


def _naming(rule_id: str):
    return lambda h: F.struct(F.lit(rule_id).alias("ruleId"), h["text"].alias("text"), h["start"].alias("start"), h["end"].alias("end"), h["startCp"].alias("startCp"))


def scan_exploded(entries: DataFrame, pack: RulePack) -> DataFrame:
    """Columns of ``entries`` (text, profile, field) with ruleId, rule_ord, pattern_ord, text_hit, start, end, startCp: one row for each place of each rule.

    Every match of a pattern has one of the literals that its expression can't do without. Texts meet patterns by these
    (see ``contain``), and only the pairs that meet are searched. Patterns without such a literal are searched for in
    every text, in one projection.
    """
    spark, silent = entries.sparkSession, [f.key for f in pack.fields if f.content_mode == "none"]
    names = [F.col(f"`{c}`") for c in entries.columns]
    needles, open_ = [], []
    for i, rule in enumerate(pack.phrases()):
        for j, p in enumerate(rule.patterns):
            row = (rule.id, i, j, jvm(p, rule.literal, rule.ignore_case), rule.editorial, list(rule.applies_to) if rule.applies_to is not None else None)
            told = required(p, rule.literal)
            if told is None:
                open_.append(row)
            else:
                needles += [(x, list(told[:k]), *row) for k, x in enumerate(told)]
    columns = ["rule_id", "rule_ord", "pattern_ord", "pattern", "editorial", "applies_to"]
    kinds = "rule_id string, rule_ord int, pattern_ord int, pattern string, editorial boolean, applies_to array<string>"
    rows = entries.where(~F.col("field").isin(*silent) | F.col("field").isNull()) if silent else entries
    met = meet(once(rows, __folded=fold(F.col("text"))), "__folded", spark.createDataFrame(needles, f"needle string, earlier array<string>, {kinds}"))
    first = ~F.exists("earlier", lambda x: F.contains(F.col("__folded"), x))  # a text meets a pattern once, by the first of its literals
    pairs = met.where(first & F.expr("text rlike pattern")).select(*names, *columns)
    if open_:
        lit = lambda x, kind: F.lit(x) if x is None or not isinstance(x, list) else F.array(*map(F.lit, x)).cast(kind)
        each = [F.when(F.col("text").rlike(row[3]), F.struct(*[lit(x, "array<string>").alias(c) for c, x in zip(columns, row, strict=True)])) for row in open_]
        plain = rows.select(*names, F.explode(F.filter(F.array(*each).cast(f"array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>"), lambda x: x.isNotNull())).alias("__p"))
        pairs = pairs.unionByName(plain.select(*names, "__p.*"))
    on = (~F.col("editorial") | (F.col("profile") == "official_plus_editorial")) & (F.col("applies_to").isNull() | F.array_contains("applies_to", F.col("field")))
    placed = pairs.where(on).withColumn("hit", F.explode(located(F.col("text"), F.col("pattern"))))
    return placed.select(*names, F.col("rule_id").alias("ruleId"), "rule_ord", "pattern_ord", F.col("hit.text").alias("text_hit"), "hit.start", "hit.end", "hit.startCp")


def first_of_rule(hits: DataFrame, key: list[str]) -> DataFrame:
    """Of equal places of one rule in one entry the one of the earliest pattern."""
    best = hits.groupBy(*key, "ruleId", "start", "end").agg(F.min(F.struct("rule_ord", "pattern_ord", "text_hit", "startCp")).alias("first"))
    return best.select(*key, "ruleId", "start", "end", "first.rule_ord", "first.pattern_ord", "first.text_hit", "first.startCp")
