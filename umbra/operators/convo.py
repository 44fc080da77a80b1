"""Conversations: folding, provider bodies, streamed replies as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "struct<text:string,done:boolean,finish_reason:string>"


def _ordered(messages: DataFrame) -> DataFrame:
    """conv_id and its messages by turn."""
    cols = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"), (F.col("tool_call_id") if "tool_call_id" in messages.columns else F.lit(None).cast("string")).alias("tool_call_id"))
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(cols)).alias("m"))


def fold(messages: DataFrame) -> DataFrame:
    """system and user prompts of one completion call: the last user or tool
    message is the prompt; what is said before is a transcript."""
    rows = _ordered(messages).withColumn("last", F.array_max(F.transform(F.filter("m", lambda x: x["role"].isin("user", "tool")), lambda x: x["turn"])))
    rest = F.filter("m", lambda x: F.coalesce(x["turn"] != F.col("last"), F.lit(True)))
    system = F.array_join(F.transform(F.filter(rest, lambda x: x["role"] == "system"), lambda x: x["text"]), "\n\n")
    said = F.array_join(F.transform(F.filter(rest, lambda x: x["role"] != "system"), lambda x: F.when(x["role"] == "user", F.concat(F.lit("User: "), x["text"])).when(x["role"] == "assistant", F.concat(F.lit("Assistant: "), x["text"])).otherwise(F.concat(F.lit("[tool "), F.coalesce(x["tool_call_id"], F.lit("")), F.lit("]: "), x["text"]))), "\n")
    final = F.get(F.filter("m", lambda x: x["turn"] == F.col("last")), F.lit(0))
    user = F.coalesce(F.when(final["role"] == "tool", F.concat(F.lit("[tool result] "), final["text"])).otherwise(final["text"]), F.lit(""))
    return rows.select("conv_id", F.array_join(F.filter(F.array(system, said), lambda x: x != ""), "\n\n").alias("system"), user.alias("user"))


def anthropic_body(messages: DataFrame, model: str, max_tokens: int = 4096, temperature: float | None = None, stop: Sequence[str] = ()) -> DataFrame:
    """System messages joined; every role but the assistant's is a user's. What isn't given is left out."""
    rows = _ordered(messages)
    turns = F.transform(F.filter("m", lambda x: x["role"] != "system"), lambda x: F.struct(F.when(x["role"] == "assistant", "assistant").otherwise("user").alias("role"), x["text"].alias("content")))
    system = F.filter("m", lambda x: x["role"] == "system")
    said = F.when(F.size(system) > 0, F.array_join(F.transform(system, lambda x: x["text"]), "\n\n"))
    more = [F.lit(temperature).alias("temperature")] if temperature is not None else []
    more += [F.array(*map(F.lit, stop)).alias("stop_sequences")] if stop else []
    return rows.select("conv_id", F.to_json(F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(True).alias("stream"), turns.alias("messages"), said.alias("system"), *more)).alias("body"))


def openai_body(messages: DataFrame, model: str, max_tokens: int = 2048, temperature: float | None = None, stop: Sequence[str] = (), json_mode: bool = False) -> DataFrame:
    """The messages as they are, a tool's with its call. What isn't given is left out."""
    rows = _ordered(messages)
    turns = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.when(x["role"] == "tool", x["tool_call_id"]).alias("tool_call_id")))
    more = [F.lit(temperature).alias("temperature")] if temperature is not None else []
    more += [F.array(*map(F.lit, stop)).alias("stop")] if stop else []
    more += [F.struct(F.lit("json_object").alias("type")).alias("response_format")] if json_mode else []
    return rows.select("conv_id", F.to_json(F.struct(F.lit(model).alias("model"), turns.alias("messages"), F.lit(True).alias("stream"), F.lit(max_tokens).alias("max_tokens"), *more)).alias("body"))


def wrapped(messages: DataFrame, entities_: DataFrame, backend_id: str) -> DataFrame:
    """Messages (session_id, conv_id, turn, role, text, spans, further columns) as a
    wrapped backend sends them: pseudonymised, without a tier, by its own id."""
    from .rewrite import pseudonymise

    safe = pseudonymise(messages.drop("tier"), entities_)
    return safe.withColumns({"text": F.col("safe"), "backend_id": F.lit(f"safe({backend_id})"), "pii": F.lit(True)}).drop("safe", "replaced", "spans")


def answered(rows: DataFrame, model: Callable[[list[str]], list[str]], text_col: str = "text", out: str = "reply") -> DataFrame:
    """Adds the first choice of an injected chat model for each text, in Arrow
    batches. Null text is asked as empty; a batch that fails has null replies."""
    kept = [f for f in rows.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                said = list(model([t or "" for t in batch.column(text_col).to_pylist()]))
            except Exception:  # noqa: BLE001 - a model that is down gives no answer
                said = [None] * len(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(said, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def one_token(text: Column) -> Column:
    """A stream of one token, which ends it."""
    return F.array(F.struct(text.alias("text"), F.lit(True).alias("done"), F.lit("stop").alias("finish_reason")))


def _frames(bodies: DataFrame) -> DataFrame:
    """stream_id, seq and the data of each server-sent frame."""
    each = bodies.select("stream_id", F.posexplode(F.split("body", "\n\n", -1)).alias("seq", "frame"))
    kept = F.filter(F.split("frame", "\n", -1), lambda x: x.startswith("data:"))
    data = F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    return each.withColumn("data", data).filter("data <> ''")


def _until_done(tokens: DataFrame) -> DataFrame:
    """Rows up to a stream's first end; a stream that never ends gets one."""
    order = Window.partitionBy("stream_id").orderBy("seq")
    before = F.coalesce(F.max(F.col("done").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = tokens.withColumn("before", before).filter("before = 0").drop("before")
    ends = kept.groupBy("stream_id").agg(F.max("seq").alias("seq"), F.bool_or("done").alias("d")).filter("NOT d").select("stream_id", (F.col("seq") + 1).alias("seq"), F.lit("").alias("text"), F.lit(True).alias("done"), F.lit("stop").alias("finish_reason"))
    return kept.unionByName(ends)


def openai_tokens(bodies: DataFrame) -> DataFrame:
    """stream_id, seq, text, done, finish_reason of chat-completion streams; bad JSON is skipped."""
    payload = F.from_json("data", "choices array<struct<delta:struct<content:string>,finish_reason:string>>")
    rows = _frames(bodies).withColumn("c", F.get(payload["choices"], F.lit(0))).withColumn("end", F.col("data") == "[DONE]")
    finish = F.nullif(F.col("c.finish_reason"), F.lit(""))
    text = F.when(F.col("end"), "").otherwise(F.coalesce("c.delta.content", F.lit("")))
    done = F.col("end") | finish.isNotNull()
    out = rows.select("stream_id", "seq", text.alias("text"), F.coalesce(done, F.lit(False)).alias("done"), F.when(F.col("end"), "stop").when(finish.isin("stop", "length", "tool_use"), finish).when(finish.isNotNull(), "stop").alias("finish_reason"))
    return _until_done(out.filter("done OR text <> ''"))


def anthropic_tokens(bodies: DataFrame) -> DataFrame:
    """The same of message streams: text deltas, stop reasons and message ends."""
    rows = _frames(bodies).withColumn("p", F.from_json("data", "type string, delta struct<type:string,text:string,stop_reason:string>"))
    kind, reason = F.col("p.type"), F.nullif(F.col("p.delta.stop_reason"), F.lit(""))
    is_text = (kind == "content_block_delta") & (F.col("p.delta.type") == "text_delta") & (F.coalesce("p.delta.text", F.lit("")) != "")
    done = (kind == "message_stop") | ((kind == "message_delta") & reason.isNotNull())
    finish = F.when(reason == "max_tokens", "length").when(reason == "tool_use", "tool_use").otherwise("stop")
    out = rows.select("stream_id", "seq", F.when(is_text, F.col("p.delta.text")).otherwise("").alias("text"), F.coalesce(done, F.lit(False)).alias("done"), F.when(done, finish).alias("finish_reason"), F.coalesce(is_text, F.lit(False)).alias("t"))
    return _until_done(out.filter("t OR done").drop("t"))


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """The same of chunks of a local engine: stream_id, seq, content, finish_reason."""
    finish, text = F.nullif(F.col("finish_reason"), F.lit("")), F.coalesce("content", F.lit(""))
    ends = F.when(finish.isin("stop", "length", "tool_use"), finish).when(finish.isNotNull(), "stop")
    each = chunks.select("stream_id", "seq", F.explode(F.array(F.struct(F.lit(0).alias("i"), text.alias("text"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("finish_reason")), F.struct(F.lit(1).alias("i"), F.lit("").alias("text"), finish.isNotNull().alias("done"), ends.alias("finish_reason")))).alias("x"))
    out = each.select("stream_id", (F.col("seq") * 2 + F.col("x.i")).alias("seq"), "x.text", "x.done", "x.finish_reason")
    return _until_done(out.filter("done OR text <> ''"))


def collect_text(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))


def grep(files: DataFrame, needle: str, path: str = "path", text: str = "text") -> DataFrame:
    """path, line (from 1) and trimmed text of lines that hold the needle; secret files are skipped."""
    from .tiers import argmax, scores

    open_ = files.filter(F.contains(text, F.lit(needle)) & (argmax(scores(F.col(text))) != "secret"))
    lines = open_.select(F.col(path).alias("path"), F.posexplode_outer(F.split(text, "\n", -1)).alias("i", "x"))
    return lines.filter(F.contains("x", F.lit(needle))).select("path", (F.col("i") + 1).alias("line"), F.trim("x").alias("text"))


def grep_safe(files: DataFrame, needle: str, session_id: str, prior: DataFrame | None = None) -> DataFrame:
    """path, line and what a model may read of each hit, ``path:line: text``
    pseudonymised within the session in order of path and line."""
    from . import entities, rewrite
    from .detect import detect

    hits = grep(files, needle).withColumns({"session_id": F.lit(session_id), "seq": F.struct(F.col("path"), F.col("line")), "text": F.concat_ws("", F.col("path").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), "text")})
    rows = hits.withColumn("spans", detect(F.col("text")))
    return rewrite.pseudonymise(rows, entities.mint(entities.explode_spans(rows), prior)).select("path", "line", "safe")


def safe_path(path: Column) -> Column:
    """A relative path with ``.`` and ``..`` resolved; null if absolute or above the root."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    walked = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok")),
        lambda acc, x: F.when(x != "..", F.struct(F.concat(acc["at"], F.array(x)).alias("at"), acc["ok"].alias("ok"))).otherwise(F.struct(F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["ok"] & (F.size(acc["at"]) > 0)).alias("ok"))),
    )
    return F.when(~path.startswith("/") & walked["ok"], F.array_join(walked["at"], "/"))


def loopback(host: Column) -> Column:
    """``localhost``, ``::1`` (in brackets or not) and 127.0.0.0/8."""
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.lower(host).isin("localhost", "::1", "[::1]") | host.rlike(rf"^127(?:\.{byte}){{3}}$")


def base_url(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")
