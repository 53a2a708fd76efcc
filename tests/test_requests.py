"""Requests as a table and as a stream."""

import json

from rulesift.plans.api import Tools
from rulesift.plans.rulepack import conformance_pack
from rulesift.sources import requests
from tests.test_operators import passages, sources


def test_search_arguments_and_shared_ids(spark):
    search = lambda **more: json.dumps({"query": "협력 학습"} | more, ensure_ascii=False)
    tool = "search_record_guidance"
    rows = [("a", tool, search(limit=1)), ("b", tool, search(limit=20)), ("c", tool, search(limit=0)), ("d", tool, search(limit=21)), ("e", tool, search(limit="x")), ("f", tool, search(sourceIds=["s2"])), ("g", tool, search()), ("g", tool, search(limit=2)), ("h", "no_tool", "{}"), ("h", tool, search())]
    asked = spark.createDataFrame(rows, "id string, tool string, arguments string")
    active = spark.createDataFrame([(f"c{i}", "elementary", "r") for i in (1, 2, 3)], "chunkId string, scope string, reason string")
    tools = Tools(conformance_pack(), passages(spark), active, sources(spark))
    got = [(r["id"], r["tool"], r["response"] and len(json.loads(r["response"])["results"]), r["error"]) for r in requests.answer(tools, asked).orderBy("id", "tool").collect()]
    limit, shared = "limit must be an integer from 1 to 20", "several requests have this id"
    assert got[0] == ("a", tool, 1, None) and got[1][0] == "b" and got[1][2] > 1 and [x[3] for x in got[2:5]] == [limit] * 3
    assert got[5][3].startswith("a search by sources") and [(x[0], x[2], x[3]) for x in got[6:]] == [("g", None, shared), ("h", None, shared), ("h", None, shared)]


def test_requests_are_answered(spark, tmp_path):
    entry = lambda i, text, field="behavior_opinion": {"entryId": i, "field": field, "text": text, "profile": "official"}
    asked = [
        {"id": "1", "tool": "validate_record_batch", "arguments": {"entries": [entry("a", "TOEIC"), entry("b", "x", "student_name")]}},
        {"id": "2", "tool": "validate_record_batch", "arguments": {"entries": [entry("a", "x"), entry("a", "y")]}}, {"id": "3", "tool": "validate_record_batch", "arguments": {"entries": [entry("a", "x", "nowhere")]}},
        {"id": "4", "tool": "check_school_record", "arguments": {"entries": [{"entryId": "a", "text": "MOOC"}, {"entryId": "b", "text": "x"}]}}, {"id": "5", "tool": "search_record_guidance", "arguments": {"query": "협력 학습"}},
        {"id": "6", "tool": "search_record_guidance", "arguments": {"query": ""}}, {"id": "7", "tool": "get_source_excerpt", "arguments": {"chunkId": "c3"}}, {"id": "8", "tool": "get_source_excerpt", "arguments": {"chunkId": "c4"}}, {"id": "9", "tool": "no_tool", "arguments": {}}, {"id": "10", "tool": "validate_record_batch", "arguments": {}},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.jsonl").write_text("".join(json.dumps(a, ensure_ascii=False) + "\n" for a in asked))
    active = spark.createDataFrame([(f"c{i}", "elementary", "r") for i in (1, 2, 3)], "chunkId string, scope string, reason string")
    tools = Tools(conformance_pack(), passages(spark), active, sources(spark))
    got = {r["id"]: (json.loads(r["response"]) if r["response"] else None, r["error"]) for r in requests.answer(tools, requests.read_requests(spark, str(tmp_path / "in"))).collect()}
    assert len(got) == 10 and got["1"][0]["status"] == "blocked" and [e["entryId"] for e in got["1"][0]["entries"]] == ["a", "b"] and got["1"][0]["entries"][0]["findings"][0]["ruleId"] == "OFFICIAL-LANGUAGE-TEST"
    assert got["2"] == (None, "duplicate entry id") and got["3"] == (None, "unsupported field") and got["9"] == (None, "unknown tool") and got["10"] == (None, "arguments without entries")
    assert (got["4"][0]["status"], got["4"][0]["prohibited"], got["4"][0]["entries"][1]["label"]) == ("prohibited", 1, "통과")
    assert got["5"][0]["results"][0]["chunkId"] == "c3" and got["6"][1].startswith("query must") and got["7"][0]["sourceId"] == "s2" and got["8"] == (None, "unknown or inactive chunk")

    seen = {}
    stream = requests.read_requests(spark, str(tmp_path / "in"), stream=True)
    q = stream.writeStream.foreachBatch(lambda df, _: seen.update({r["batchId"]: r["n"] for r in requests.entries_of(df).groupBy("batchId").count().withColumnRenamed("count", "n").collect()})).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == {"1": 2, "2": 2, "3": 1, "4": 2}
