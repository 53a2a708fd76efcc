"""Requests to the tools as a table: one JSON object a line, answered one row each.

A line has ``id``, ``tool`` and ``arguments``, an object. Files can be read as a table or as a stream; ``answer`` takes a
table, so a stream is answered by its micro-batches (``foreachBatch``). All requests of a tool are worked off together,
by the tool's own plan: entries of all batches in one pass, all queries against the passages at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift import schemas as S
from rulesift.operators import findings, review, search
from rulesift.plans.api import Tools

_ENTRY = f"struct<entryId:string,field:string,text:string,profile:string,grade:int,curriculum:string,provenance:{S.nested(S.PROVENANCE)},activityContext:{S.nested(S.ACTIVITY)},volunteerContext:{S.nested(S.VOLUNTEER)}>"
ANSWER = ("id", "tool", "response", "error")
KNOWN = ("validate_record_batch", "check_school_record", "search_record_guidance", "get_source_excerpt")


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """id, tool, arguments (JSON text) of every line; all null for a line that isn't an object."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in ("id", "tool", "arguments")])


def entries_of(requests: DataFrame) -> DataFrame:
    """batchId (the request's id), ord and the entries of batch requests."""
    listed = requests.select(F.col("id").alias("batchId"), F.from_json("arguments", f"struct<entries:array<{_ENTRY}>>")["entries"].alias("x"))
    return listed.select("batchId", F.posexplode("x").alias("ord", "e")).select("batchId", "ord", "e.*")


def _batches(rows: DataFrame, batches: DataFrame, told: list[str], more: list[str]) -> DataFrame:
    """id, response, error: a batch's status with its entries in order; a batch has 100 entries at most, larger ones are told by their error alone."""
    shape = findings.batch_errors(rows.select("batchId", "entryId")).select("batchId", F.col("error").alias("shape"))
    sound = rows.join(shape, "batchId", "left_anti")
    listed = sound.groupBy("batchId").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(*told)).alias("e")))).alias("x"))
    whole = batches.join(shape, "batchId", "left").join(listed, "batchId", "left").withColumn("problem", F.coalesce("shape", "error"))
    head = F.to_json(F.struct("status", *more))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"entries":['), F.array_join(F.transform("x", lambda e: e["e"]), ","), F.lit("]}"))
    return whole.select(F.col("batchId").alias("id"), F.when(F.col("problem").isNull(), body).alias("response"), F.col("problem").alias("error"))


def answer(tools: Tools, requests: DataFrame) -> DataFrame:
    """id, tool, response (JSON text), error: a row for each request, one for all that share an id and a tool.

    Unknown tools, bad arguments and ids that several requests share are errors of their rows. A search by sources or roles
    is an error here: their passages differ from request to request, so it is left to the tool itself.
    """
    shared = requests.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("several requests have this id").alias("repeated"))
    alone = requests.join(shared, "id", "left_anti")
    of = {t: alone.where(F.col("tool") == t) for t in KNOWN}
    defaults = {"profile": tools.pack.default_profile}
    entries = tools._complete(entries_of(of[KNOWN[0]]), defaults)
    rows = findings.validate(entries, tools.pack, tools.institutions)
    done = {KNOWN[0]: _batches(rows, findings.batch_status(rows), ["entryId", "status", "contentStatus", "contextStatus", "findings", "needsContext", "measurement"], [])}

    entries = entries_of(of[KNOWN[1]]).drop("provenance", "activityContext", "volunteerContext")
    entries = tools._complete(entries, {"field": review.DEFAULT_FIELD}).withColumns({"profile": F.lit(review.DEFAULT_PROFILE), "curriculum": F.lit(None).cast("string"), "grade": F.lit(None).cast("int")})
    rows = review.review(findings.validate(entries, tools.pack, tools.institutions))
    done[KNOWN[1]] = _batches(rows, review.review_batches(rows), ["entryId", "status", "label", "reason", "issues", "improvementGuidance", "rewritePlan"], ["total", *S.REVIEW_STATUS])

    if tools.chunks is not None:
        active = tools.chunks.join(tools.active.select(F.col("chunkId").alias("id")), "id", "left_semi")
        argument = lambda name: F.get_json_object("arguments", f"$.{name}")
        most = F.when(argument("limit").isNull(), S.DEFAULT_LIMIT).otherwise(F.when(argument("limit").rlike("^[0-9]{1,2}$"), argument("limit")).cast("int"))
        wrong = (
            F.when(~F.coalesce(F.length("query").between(1, S.MAX_QUERY), F.lit(False)), "query must contain between 1 and 200 characters")
            .when(~F.coalesce(F.col("most").between(1, S.MAX_LIMIT), F.lit(False)), "limit must be an integer from 1 to 20")
            .when(F.col("filtered"), "a search by sources or roles isn't answered together with others")
        )
        filtered = argument("sourceIds").isNotNull() | argument("sourceRoles").isNotNull()
        asked = of[KNOWN[2]].select("id", argument("query").alias("query"), most.alias("most"), filtered.alias("filtered")).withColumn("wrong", wrong)
        fit = F.col("wrong").isNull()
        found = search.search_many(search.prepare(active), asked.where(fit).select(F.col("id").alias("query_id"), "query"), S.MAX_LIMIT)
        found = found.join(asked.where(fit).select(F.col("id").alias("query_id"), "most"), "query_id").where(F.col("rank") <= F.col("most")).drop("most")
        named = found.join(active.select("id", "sourceId", "locatorLabel"), "id").join(tools.sources.select(F.col("id").alias("sourceId"), "title"), "sourceId")
        ranked = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("chunkId"), "sourceId", "title", "locatorLabel", "score"))).alias("results"))
        joined = asked.join(ranked, asked["id"] == ranked["query_id"], "left")
        done[KNOWN[2]] = joined.select("id", F.when(fit, F.to_json(F.struct(F.coalesce("results", F.array().cast(ranked.schema["results"].dataType)).alias("results")))).alias("response"), F.col("wrong").alias("error"))

        asked = of[KNOWN[3]].select(F.col("id").alias("request"), F.get_json_object("arguments", "$.chunkId").alias("chunkId"))
        dim = tools.sources.select(F.col("id").alias("sourceId"), "title", "role", F.col("sha256").alias("sourceSha256"))
        whole = asked.join(active.withColumnRenamed("id", "chunkId"), "chunkId", "left").join(dim, "sourceId", "left")
        told = F.to_json(F.struct("chunkId", "sourceId", "title", "role", "authority", "sourceSha256", "locator", "locatorLabel", "headingPath", "text", "textSha256"))
        done[KNOWN[3]] = whole.select(F.col("request").alias("id"), F.when(F.col("title").isNotNull(), told).alias("response"), F.when(F.col("title").isNull(), "unknown or inactive chunk").alias("error"))

    answered = reduce(DataFrame.unionByName, [df.withColumn("tool", F.lit(t)) for t, df in done.items()])
    asked = requests.select("id", "tool").distinct()
    none = F.when(F.col("tool").isin(*done), "arguments without entries").otherwise("unknown tool")
    whole = asked.join(answered, ["id", "tool"], "left").join(shared, "id", "left")
    return whole.select("id", "tool", "response", F.when(F.col("response").isNull(), F.coalesce("repeated", "error", none)).alias("error"))
