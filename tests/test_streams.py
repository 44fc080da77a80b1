"""Live streams that run: files come one by one, each is a micro-batch."""

import json
import os

from umbra.streaming import sessions


def _run(spark, tmp_path, name, schema, batches, transform, **trigger):
    """All rows that a stream emits over batches of rows."""
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # the source takes older files first
    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


TOKENS = "stream_id string, seq long, text string, done boolean, finish_reason string, known map<string,string>"


def test_reverse_stream(spark, tmp_path):
    """Pseudonyms cut by token and batch borders come back; a stream without an end keeps its trailing word."""
    known = {"EMAIL_1": "a@b.c", "EMAIL_12": "x@y.z"}
    token = lambda s, i, t, done=False: {"stream_id": s, "seq": i, "text": t, "done": done, "finish_reason": "stop" if done else None, "known": known}
    batches = [[token("s", 0, "replied to EMA"), token("t", 0, "to EMAIL_1")], [token("s", 1, "IL_1"), token("t", 1, "2 and PATH")], [token("s", 2, " now EMAIL_9"), token("s", 3, "", True), token("s", 4, "late")]]
    rows = _run(spark, tmp_path, "reversed", TOKENS, batches, sessions.reverse_stream)
    text = lambda s: "".join(r["text"] for r in sorted(rows, key=lambda r: r["seq"]) if r["stream_id"] == s)
    assert text("s") == "replied to a@b.c now EMAIL_9" and text("t") == "to x@y.z and "
    assert [r["finish_reason"] for r in rows if r["done"]] == ["stop"]
    whole = spark.createDataFrame([tuple(x.values()) for b in batches for x in b], TOKENS)
    assert {r["stream_id"]: r["text"] for r in sessions.replayed(whole).collect()} == {"s": text("s"), "t": text("t")}


def test_mint_stream(spark, tmp_path):
    """First seen, first numbered across batches; kinds count apart; persons meet under one name."""
    span = lambda q, o, k, t: {"session_id": "s", "seq": q, "ord": o, "kind": k, "text": t}
    batches = [[span(1, 0, "PERSON", "Dr. Smith"), span(1, 1, "EMAIL", "a@b.c")], [span(2, 0, "PERSON", "smith"), span(2, 1, "EMAIL", "x@y.z"), span(2, 2, "ORG", "a@b.c")]]
    rows = _run(spark, tmp_path, "minted", "session_id string, seq long, ord long, kind string, text string", batches, sessions.mint_stream)
    assert sorted((r["seq"], r["ord"], r["pseudonym"]) for r in rows) == [(1, 0, "PERSON_1"), (1, 1, "EMAIL_1"), (2, 0, "PERSON_1"), (2, 1, "EMAIL_2"), (2, 2, "EMAIL_1")]


def test_mint_stream_with_timeout(spark, tmp_path):
    rows = _run(spark, tmp_path, "timed", "session_id string, seq long, ord long, kind string, text string", [[{"session_id": "s", "seq": 1, "ord": 0, "kind": "IP", "text": "1.1.1.1"}]], lambda s: sessions.mint_stream(s, 3_600_000), once=True)
    assert [r["pseudonym"] for r in rows] == ["IP_1"]


def test_idle_windows(spark, tmp_path):
    """A session ends after its gap; the watermark lets it go once later calls come."""
    call = lambda s, t: {"session_id": s, "at": f"2024-01-01T00:{t}:00Z"}
    batches = [[call("a", "00"), call("a", "05"), call("a", "30")], [call("b", "59")], [call("b", "59")]]
    rows = _run(spark, tmp_path, "idle", "session_id string, at timestamp", batches, lambda s: sessions.idle_windows(s, "10 minutes", "1 minute"))
    assert sorted((r["session_id"], r["calls"]) for r in rows) == [("a", 1), ("a", 2)]


def test_frames_stream(spark, tmp_path):
    """Frames cut anywhere; bad JSON and comments are skipped; nothing follows the end."""
    body = "".join(f'event: x\ndata: {{"type":"content_block_delta","delta":{{"type":"text_delta","text":"{t}"}}}}\n\n' for t in ("Hel", "lo"))
    body += 'data: {bad\n\n: c\n\ndata: {"type":"message_delta","delta":{"stop_reason":"max_tokens"}}\n\ndata: {"type":"message_stop"}\n\n'
    cuts = [body[i : i + 17] for i in range(0, len(body), 17)]
    batches = [[{"stream_id": "s", "seq": i, "chunk": c} for i, c in part] for part in (list(enumerate(cuts))[:5], list(enumerate(cuts))[5:9], list(enumerate(cuts))[9:])]
    rows = _run(spark, tmp_path, "frames", "stream_id string, seq long, chunk string", batches, sessions.frames_stream)
    assert [(r["text"], r["done"], r["finish_reason"]) for r in sorted(rows, key=lambda r: r["seq"])] == [("Hel", False, None), ("lo", False, None), ("", True, "length")]
