"""Linked tool calls, canonical JSON, and the pipeline."""

import json

import pytest
from pyspark.sql import functions as F

from loofold.llm import toolcalls

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>, extra string"
RESULTS = "conv_id long, call_id string, turn long, content string, name int"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["array", "null"], "items": {"enum": [1, 2]}}}}}


def test_faults():
    schema = SCHEMAS["add"]
    assert toolcalls.faults({"a": 1, "b": [1, 2]}, schema) == []
    assert toolcalls.faults({"a": 1.0, "b": None}, schema) == []
    assert toolcalls.faults({"b": [3], "c": 0}, schema) == ["$.a: missing", "$.c: unknown", "$.b[0]: not one of the allowed values"]
    assert toolcalls.faults({"a": -1}, schema) == ["$.a: out of bounds"]
    assert toolcalls.faults({"a": True}, schema) == ["$.a: not of type integer"]


def test_canonical():
    assert toolcalls.canonical({"b": [1.0, {"z": None, "a": "é"}], "a": 0.5}) == '{"a":0.5,"b":[1,{"a":"é","z":null}]}'
    assert toolcalls.read_json('{"a":1,"a":2}')[1] == "not JSON: repeated key"
    assert toolcalls.read_json("NaN")[1] == "not JSON"
    assert toolcalls.read_json("[" * 100_000)[1] == "not JSON"
    assert toolcalls.read_json(None)[1] == "not JSON"


def test_linked(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 5, "add", '{"a": 1}', ["b", "c"], "x"),
            (1, "b", 7, "add", '{"a": 2.0, "b":[1]}', None, "x"),
            (1, "c", 1, "add", "{", ["b", "b", "other"], "x"),
            (1, "c", 2, "add", '{"a": 3}', [], "x"),
            (1, "p", 1, "add", None, ["q"], None),
            (1, "q", 1, "sub", "{}", ["p"], None),
            (1, "r", 1, "add", '{"a": 1}', ["p", "r"], None),
            (2, "a", 1, "add", '{"a": 1}', ["b"], None),
            (None, "a", 1, "add", '{"a": 1}', None, None),
            (3, None, 1, None, None, None, None),
        ],
        CALLS,
    )
    results = spark.createDataFrame(
        [(1, "a", 9, "late", 1), (1, "a", 8, None, 1), (1, "a", 8, "first", 1), (1, "z", 3, "lost", 1), (None, None, 1, "n", 1)], RESULTS
    )
    rows = toolcalls.linked(calls, results, SCHEMAS).collect()
    got = {(r.conv_id, r.call_id, r.turn): r for r in rows}
    assert len(rows) == 12
    assert {k: (r.level, r.status, r.n_results, r.valid) for k, r in got.items()} == {
        (1, "a", 5): (2, "linked", 3, True),
        (1, "b", 7): (0, "no_result", 0, True),
        (1, "c", 1): (1, "no_result", 0, False),
        (1, "c", 2): (None, "duplicate", 0, True),
        (1, "p", 1): (None, "cycle", 0, False),
        (1, "q", 1): (None, "cycle", 0, False),
        (1, "r", 1): (None, "cycle", 0, True),
        (2, "a", 1): (0, "no_result", 0, True),
        (1, "z", 3): (None, "no_call", 1, False),
        (None, "a", 1): (None, "no_id", 0, True),
        (3, None, 1): (None, "no_id", 0, False),
        (None, None, 1): (None, "no_id", 1, False),
    }
    assert got[1, "q", 1].errors == ["unknown tool"]
    assert json.loads(got[1, "b", 7].json)["arguments"] == {"a": 2, "b": [1]}
    assert '"arguments":{"a":2,"b":[1]}' in got[1, "b", 7].json


def test_empty(spark):
    assert toolcalls.linked(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).count() == 0


@pytest.mark.parametrize("n", [1, 60])
def test_long_conversation(spark, n):
    calls = spark.createDataFrame([(1, str(i), i, "add", '{"a":1}', [str(i // 2)] if i > 1 else [], None) for i in range(1, n + 1)], CALLS)
    found = {int(r.call_id): r.level for r in toolcalls.levels(calls).collect()}
    assert found == {i: i.bit_length() - 1 for i in range(1, n + 1)}


def test_derived(spark, tables):
    talks = spark.read.parquet(f"{tables}/conversations.parquet")
    found = toolcalls.linked(*toolcalls.derived(talks), toolcalls.SCHEMAS).collect()
    said = talks.collect()
    calls = {(r.conv_id, r.turn) for r in said if r.role == "assistant"}
    answers = {(r.conv_id, r.turn - 1) for r in said if r.role == "user"}
    assert len(found) == len(calls | answers)
    assert sum(r.status == "linked" for r in found) == len(calls & answers)
    assert any(r.valid for r in found) and any(r.errors for r in found)
    for r in found:
        assert toolcalls.canonical(json.loads(r.json)) == r.json


def test_every_turn_and_its_text_is_in_a_record(spark):
    roles = ("system", "user", "assistant", None, "assistant", "user", "tool")
    said = [(c, t, roles[(c + t) % 7], f'"Turn" {t} of {c},\n whole\ttext\\ é {"word " * (t % 5)}end') for c in range(6) for t in range(20)]
    rows = toolcalls.records(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()
    texts = {}
    for r in rows:
        record = json.loads(r.json)
        assert toolcalls.canonical(record) == r.json
        given = record.get("arguments")
        if isinstance(given, str):
            texts.setdefault((r.conv_id, r.turn), set()).add(given.removeprefix('{"query": '))
        elif given is not None:
            texts.setdefault((r.conv_id, r.turn), set()).add(given.get("text", given.get("query")))
        if "content" in record:
            at = r.turn + 1 if r.status == "linked" else r.turn
            texts.setdefault((r.conv_id, at), set()).add(record["content"])
    assert all(text in texts[c, t] for c, t, _, text in said)
    assert sum(r.status == "message" for r in rows) == sum(role not in ("user", "assistant") for _, _, role, _ in said)


def test_pipeline(spark, tables, tmp_path):
    import corpus_pipeline

    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    first = docs.orderBy("doc_id").first()["doc_id"]
    planted = F.concat("text", F.lit(f' token = "{token}" password=hunter7'))
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, planted).otherwise(F.col("text")))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], tables).cache())
    assert all(f.columns == docs.columns for f in frames[:-1])
    sizes = [f.count() for f in frames]
    assert sizes[1] >= 0.99 * sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    assert frames[2].select("text").distinct().count() == sizes[2]
    masked = frames[3].where("text like '%[SECRET]%'")
    assert [r["doc_id"] for r in masked.where(F.col("doc_id") == first).collect()] == [first]
    assert masked.where(F.col("doc_id") == first).first()["text"].endswith(' token = "[SECRET]" password=[SECRET]')
    assert frames[3].where(F.col("text").contains(token) | F.col("text").contains("hunter7")).count() == 0
    pieces = frames[5].groupBy("doc_id").sum("length").count()
    assert pieces == frames[4].select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == sizes[5]
    for f in frames[1:]:
        f.unpersist()


def test_pipeline_odd_rows(spark, odd, nothing):
    import corpus_pipeline

    for rows in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, "")
            assert rows.count() >= 0
