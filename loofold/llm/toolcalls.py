"""Tool calls linked to their results, ordered, checked and written as canonical JSON.

Calls and results meet in a hash join on their identifier. Calls may name other calls whose
results they need; levels of this graph come from one join per level, so a long conversation
is never one task's group. Arguments are checked against the tool's schema and every record is
serialised with sorted keys and no spaces.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loofold.session import written_table

TYPES = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "null": lambda x: x is None,
}


def canonical(value) -> str:
    """Sorted keys, no spaces, numbers that are whole written as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _refused(word: str):
    raise ValueError(f"{word} is not JSON")


def read_json(text: str | None):
    """The value and None, or None and what is wrong: strict JSON with distinct keys."""

    def distinct(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    try:
        value = json.loads(text or "", object_pairs_hook=distinct, parse_constant=_refused)
        canonical(value).encode()
    except (ValueError, RecursionError) as problem:
        return None, f"not JSON: {problem}" if "repeated" in str(problem) else "not JSON"
    return value, None


def faults(value, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a schema of type, enum, bounds, properties, required and items."""
    found = []
    kind = schema.get("type")
    if kind and not any(TYPES[k](value) for k in ([kind] if isinstance(kind, str) else kind)):
        return [f"{path}: not of type {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not one of the allowed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not math.isnan(value):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            found.append(f"{path}: out of bounds")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            found += [f"{path}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                found += faults(value[k], known[k], f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += faults(x, schema["items"], f"{path}[{i}]")
    return found


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level of calls (conv_id, call_id, needs array<string>).

    Level 0 needs nothing; another is one above the highest it needs. Calls on a cycle, or that
    need one on a cycle, get none. Needs that name no call of the conversation are ignored. One
    round of joins per level, over calls still open.
    """
    names = calls.select("conv_id", "call_id")
    edges = (
        calls.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need"))
        .join(names.withColumnRenamed("call_id", "need"), ["conv_id", "need"])
    )
    edges = written_table(edges.select("conv_id", "need", "call_id"), "needs")
    open_calls = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("open"))
    ready = written_table(names.join(open_calls, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    waiting, done, level = written_table(open_calls, "waiting"), ready, 0
    while not ready.isEmpty():
        level += 1
        met = (
            edges.join(ready.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"])
            .groupBy("conv_id", "call_id").agg(F.count("*").alias("met"))
        )
        waiting = written_table(
            waiting.join(met, ["conv_id", "call_id"], "left")
            .select("conv_id", "call_id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")),
            "waiting",
        )
        ready = written_table(waiting.where("open = 0").select("conv_id", "call_id", F.lit(level).alias("level")), "levels")
        waiting = waiting.where("open > 0")
        done = done.unionByName(ready)
    return done


RECORD = (
    "conv_id long, call_id string, turn long, level int, status string, n_results long, valid boolean,"
    " errors array<string>, json string"
)


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One record per call, and one per result without a call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), needs (array of call_id).
    ``results``: conv_id, call_id, turn, content. Returns conv_id, call_id, turn, level, status,
    n_results, valid, errors and json. (level, turn, call_id) orders a conversation so that each
    call follows what it needs.

    Of calls with one identifier the first by turn, name and arguments stands and the others are
    ``duplicate``; of results the first by turn and content is linked and all are counted. Other
    statuses: ``linked``, ``no_result``, ``no_call``, ``cycle`` (no level), ``no_id`` (a null
    conversation or identifier, never linked). Null or broken arguments and unknown tools are
    not valid. Further columns are not read; no rows give no records.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", F.col("turn").cast("long").alias("turn"), "name", "arguments", "needs")
    results = results.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", F.col("turn").cast("long").alias("turn"), "content")
    named = calls.where("conv_id is not null and call_id is not null")
    body = F.struct("turn", "name", "arguments", F.sort_array("needs").alias("needs"))
    bodies = named.groupBy(*key, body.alias("call")).agg(F.count("*").alias("copies"))
    first = written_table(bodies.groupBy(*key).agg(F.min("call").alias("call")), "calls")
    order = levels(first.select(*key, F.col("call.needs").alias("needs")))
    answers = (
        results.where("conv_id is not null and call_id is not null")
        .groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    )
    met = first.join(answers, key, "full_outer").join(order, key, "left")
    status = (
        F.when(F.col("call").isNull(), "no_call")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("result").isNull(), "no_result")
        .otherwise("linked")
    )
    shape = [
        *key, F.coalesce("call.turn", "result.turn").alias("turn"), "level", "status", F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "call.name", "call.arguments", F.col("call.needs").alias("needs"), F.col("result.content").alias("content"),
    ]
    kept = met.withColumn("status", status)
    times = F.col("copies") - F.when(F.col("call").eqNullSafe(F.col("least")), 1).otherwise(0)
    again = (
        bodies.join(first.select(*key, F.col("call").alias("least")), key).withColumn("times", times).where("times > 0")
        .select(*key, "call", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
        .withColumns({"status": F.lit("duplicate"), "level": F.lit(None).cast("int"), "n_results": F.lit(0), "result": F.lit(None).cast("struct<turn:long,content:string>")})
    )
    alone = calls.where("conv_id is null or call_id is null").select(
        *key, body.alias("call"), F.lit("no_id").alias("status"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("n_results"),
        F.lit(None).cast("struct<turn:long,content:string>").alias("result"),
    )
    rest = results.where("conv_id is null or call_id is null").select(
        *key, F.lit(None).cast(first.schema["call"].dataType).alias("call"), F.lit("no_id").alias("status"),
        F.lit(None).cast("int").alias("level"), F.lit(1).alias("n_results"), F.struct("turn", "content").alias("result"),
    )
    rows = kept.select(*shape).unionByName(again.select(*shape)).unionByName(alone.select(*shape)).unionByName(rest.select(*shape))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                errors, value = [], None
                is_call = r["name"] is not None or r["arguments"] is not None or r["status"] not in ("no_call", "no_id")
                if is_call:
                    value, problem = read_json(r["arguments"])
                    schema = schemas.get(r["name"])
                    errors = [problem] if problem else [] if schema is None else faults(value, schema)
                    if schema is None:
                        errors.append("unknown tool")
                record = {k: r[k] for k in ("conv_id", "call_id", "turn", "name", "needs", "content", "status")}
                record["arguments"] = r["arguments"] if errors and value is None else value
                out.append((is_call and not errors, errors, canonical({k: v for k, v in record.items() if v is not None})))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "call_id", "turn", "level", "status", "n_results"))]
                + [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.bool_(), pa.list_(pa.string()), pa.string()))],
                names=["conv_id", "call_id", "turn", "level", "status", "n_results", "valid", "errors", "json"],
            )

    rows = rows.withColumn("n_results", F.col("n_results").cast("long"))
    return rows.mapInArrow(write, RECORD)


#: Tools that the derived conversations call.
SCHEMAS = {
    "search": {
        "type": "object", "required": ["query", "limit"], "additionalProperties": False,
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}, "after": {"type": "array", "items": {"type": "string"}}},
    },
    "measure": {
        "type": "object", "required": ["words"],
        "properties": {"words": {"type": "integer", "minimum": 0}, "unit": {"enum": ["words", "letters"]}},
    },
    "store": {
        "type": "object", "required": ["text", "tags"],
        "properties": {"text": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}},
    },
}


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations, which hold none of their own.

    Every assistant turn becomes a call whose arguments hold its whole text, some with a field
    missing or of a wrong type; it needs the call at half its turn. Every user turn is the
    result of the call one turn before, whether there is one or not. Turns of other roles, or of
    none, are neither: ``messages`` gives their records.
    """
    text = F.coalesce("text", F.lit(""))
    pick = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    wrong = F.pmod(F.xxhash64("turn", "conv_id"), F.lit(11))
    words = F.size(F.split(text, r"\s+"))
    first = F.element_at(F.split(text, r"\s+"), 1)
    ident = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    limit = F.when(wrong == 1, F.lit(None)).otherwise(words)
    arguments = (
        F.when(wrong == 0, F.concat(F.lit('{"query": '), text))
        .when(pick == 0, F.to_json(F.struct(text.alias("query"), limit.alias("limit"))))
        .when(pick == 1, F.when(wrong == 2, F.to_json(F.struct(first.alias("words"), text.alias("text")))).otherwise(F.to_json(F.struct(words.alias("words"), F.lit("words").alias("unit"), text.alias("text")))))
        .otherwise(F.to_json(F.struct(F.array(first).alias("tags"), text.alias("text"))))
    )
    name = F.when(pick == 0, "search").when(pick == 1, "measure").otherwise("store")
    turn = F.col("turn")
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", ident(turn).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"),
        F.when(turn > 1, F.array(ident(F.floor(turn / 2)))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = conversations.where("role = 'user'").select("conv_id", ident(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def messages(conversations: DataFrame) -> DataFrame:
    """A record of status ``message`` for every turn whose role is neither assistant nor user, or null."""
    other = F.coalesce(~F.col("role").isin("assistant", "user"), F.lit(True))
    rows = conversations.where(other).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [canonical({k: v for k, v in (r | {"status": "message"}).items() if v is not None}) for r in batch.to_pylist()]
            n = len(out)
            columns = {
                "conv_id": batch.column("conv_id"), "call_id": pa.nulls(n, pa.string()), "turn": batch.column("turn"), "level": pa.nulls(n, pa.int32()),
                "status": pa.array(["message"] * n, pa.string()), "n_results": pa.array([0] * n, pa.int64()), "valid": pa.array([False] * n, pa.bool_()),
                "errors": pa.array([[]] * n, pa.list_(pa.string())), "json": pa.array(out, pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(write, RECORD)


def records(conversations: DataFrame) -> DataFrame:
    """Records of all turns: derived calls and results, linked, and the messages of other roles."""
    return linked(*derived(conversations), SCHEMAS).unionByName(messages(conversations))
