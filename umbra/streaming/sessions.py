"""Keyed state: live reply streams, incremental minting, idle sessions."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.patterns import GATE, HONORIFIC, PSEUDONYM
from ..operators.rewrite import mapped

_TAIL = re.compile(r"[A-Za-z0-9_]*\Z")


def feed(held: str, text: str, done: bool, known: dict[str, str]) -> tuple[str, str]:
    """What a stream may emit now, and what it holds back: the trailing word may
    still grow into a pseudonym until the stream is done."""
    held += text
    cut = len(held) if done else _TAIL.search(held).start()
    out = held[:cut]
    if re.search(GATE, out):
        out = re.sub(PSEUDONYM, lambda m: known.get(m[0], m[0]), out)
    return out, held[cut:]


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator:
    """Rows of a key that came at once, in order."""
    yield from pd.concat(list(batches)).sort_values(by).itertuples()


def reverse_stream(tokens: DataFrame) -> DataFrame:
    """Restores surfaces in live streams. tokens: stream_id, seq, text, done,
    finish_reason and known (map of the session's pseudonyms). Tokens after the
    end are ignored; a stream that never ends never emits its tail."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, over = state.get if state.exists else ("", False)
        out = []
        for r in _in_order(batches, ["seq"]):
            if over:
                break
            over = bool(r.done)
            text, held = feed(held, r.text or "", over, dict(r.known or {}))
            if text or over:
                out.append((key[0], int(r.seq), text, over, r.finish_reason if over else None))
        state.update((held, over))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text", "done", "finish_reason"])

    return tokens.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, text string, done boolean, finish_reason string", "held string, over boolean", "append", GroupStateTimeout.NoTimeout)


def mint_stream(spans: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Pseudonyms over an unbounded stream of spans (session_id, seq, ord, kind,
    text): state is the session's table, dropped when idle for ``ttl_ms``."""

    def norm(text: str, kind: str) -> str:
        return re.sub(HONORIFIC, "", text.strip().lower()).strip() if kind == "PERSON" else text

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        table = dict(zip(*state.get, strict=True)) if state.exists else {}
        counts = Counter(p.rpartition("_")[0] for p in table.values())
        out = []
        for r in _in_order(batches, ["seq", "ord"]):
            k = norm(r.text, r.kind)
            if k not in table:
                counts[r.kind] += 1
                table[k] = f"{r.kind}_{counts[r.kind]}"
            out.append((key[0], int(r.seq), int(r.ord), table[k]))
        state.update((list(table), list(table.values())))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["session_id", "seq", "ord", "pseudonym"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return spans.groupBy("session_id").applyInPandasWithState(run, "session_id string, seq long, ord long, pseudonym string", "k array<string>, p array<string>", "append", timeout)


def idle_windows(calls: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of calls (session_id, at) that end after a gap, with late data held for a while."""
    timed = calls.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("session_id", F.session_window("at", gap)).agg(F.count("*").alias("calls"))


def event_of(frame: str) -> tuple[str, bool, str | None] | None:
    """text, done and finish_reason of one frame of a message stream; null for frames that tell nothing."""
    data = "\n".join(x[5:].removeprefix(" ") for x in frame.split("\n") if x.startswith("data:"))
    try:
        event = json.loads(data)
    except ValueError:
        return None
    if not isinstance(event, dict):
        return None
    delta, kind = event.get("delta") or {}, event.get("type")
    if kind == "content_block_delta" and delta.get("type") == "text_delta" and delta.get("text"):
        return delta["text"], False, None
    reason = delta.get("stop_reason")
    if kind == "message_stop" or kind == "message_delta" and reason:
        return "", True, {"max_tokens": "length", "tool_use": "tool_use"}.get(reason, "stop")
    return None


def frames_stream(chunks: DataFrame) -> DataFrame:
    """Tokens of message streams that come in pieces. chunks: stream_id, seq, chunk
    (text cut anywhere). State is the frame not yet ended; after a stream's end
    its pieces are ignored."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number, over = state.get if state.exists else ("", 0, False)
        out = []
        for r in _in_order(batches, ["seq"]):
            *frames, held = (held + (r.chunk or "")).split("\n\n") if not over else [""]
            for found in filter(None, map(event_of, frames)):
                if not over:
                    out.append((key[0], number, *found))
                    number, over = number + 1, found[1]
        state.update((held, number, over))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text", "done", "finish_reason"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, text string, done boolean, finish_reason string", "held string, number long, over boolean", "append", GroupStateTimeout.NoTimeout)


def replayed(tokens: DataFrame) -> DataFrame:
    """What ``reverse_stream`` emits in all, of streams that are complete: stream_id
    and text, as one expression for each stream. tokens: stream_id, seq, text,
    done and known. Tokens after the end count nothing; without an end the
    trailing word is never emitted."""
    rows = tokens.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "done"))).alias("t"), F.first("known", ignorenulls=True).alias("known"))
    end = F.array_position(F.transform("t", lambda x: x["done"]), True).cast("int")
    said = F.array_join(F.transform(F.when(end > 0, F.slice("t", F.lit(1), end)).otherwise(F.col("t")), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    whole = F.when(end > 0, said).otherwise(F.regexp_replace(said, "[A-Za-z0-9_]*$", ""))
    return rows.select("stream_id", mapped(whole, F.col("known")).alias("text"))
