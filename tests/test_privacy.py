from pyspark.sql import functions as F

from umbra.operators import audit, cohort, convo, detect, entities, jsonwalk, rewrite, tiers
from umbra.streaming.sessions import feed


def _one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("x")).head()["x"]


def test_spans(spark):
    got = _one(spark, "a@b.com /Users/x/y 10.0.0.1 https://e.com/x@y.io é 550e8400-e29b-41d4-a716-446655440000", detect.detect)
    assert [x["kind"] for x in got] == ["EMAIL", "PATH", "IP", "URL", "UUID"]
    assert got[4]["start"] == len("a@b.com /Users/x/y 10.0.0.1 https://e.com/x@y.io é ".encode())
    assert _one(spark, None, detect.detect) == [] and _one(spark, "", detect.detect) == []


def test_validation_and_merge(spark):
    rows = spark.createDataFrame([("héllo", [(0, 1, "ORG", ""), (2, 3, "ORG", ""), (0, 99, "ORG", ""), (0, 1, "X", "")])], f"text string, s array<{detect.SPAN}>")
    assert [x["text"] for x in rows.select(detect.validate(F.col("text"), F.col("s")).alias("x")).head()["x"]] == ["h"]
    got = _one(spark, "Dr. Smith emailed b@e.com", lambda t: detect.detect_with("learned_and_regex", t))
    assert [(x["kind"], x["text"]) for x in got] == [("PERSON", "Dr. Smith"), ("EMAIL", "b@e.com")]
    got = _one(spark, "a Bob b Bob", lambda t: detect.locate_reported(t, F.lit('x [{"kind":"person","text":"Bob"},{"kind":"person","text":"Bob"},{"kind":"person","text":"no"}]')))
    assert [x["start"] for x in got] == [2, 8]


def test_round_trip_and_coreference(spark):
    rows = spark.createDataFrame([("s", 1, "met Dr. Smith today"), ("s", 2, "Smith was friendly"), ("t", 1, "email: x@y.com!")], "session_id string, seq long, text string").withColumn("spans", detect.detect_with("learned_and_regex", F.col("text")))
    known = entities.mint(entities.explode_spans(rows))
    safe = {(r["session_id"], r["seq"]): r["safe"] for r in rewrite.pseudonymise(rows, known).collect()}
    assert safe == {("s", 1): "met PERSON_1 today", ("s", 2): "PERSON_1 was friendly", ("t", 1): "email: EMAIL_1!"}
    reply = spark.createDataFrame([("s", 1, "saw PERSON_1, not PERSON_12")], "session_id string, seq long, text string")
    assert rewrite.reverse(reply, known).head()["restored"] == "saw Dr. Smith, not PERSON_12"
    more = entities.mint(entities.explode_spans(rows.filter("session_id = 't'").withColumn("text", F.lit("z@y.com")).withColumn("spans", detect.detect(F.col("text")))), known)
    assert {r["pseudonym"] for r in more.filter("session_id = 't'").collect()} == {"EMAIL_1", "EMAIL_2"}


def test_audit(spark):
    replies = spark.createDataFrame([("s", 1, "raw 1.2.3.4 then EMAIL_5 then /Users/x/y")], "session_id string, seq long, text string")
    none = spark.createDataFrame([], "session_id string, norm string, kind string, n int, pseudonym string, canonical string")
    row = audit.findings(replies, none).select("findings", audit.verdict(F.col("findings"), "reject").alias("v"), audit.redact(F.col("text"), F.col("findings")).alias("r")).head()
    assert [x["kind"] for x in row["findings"]] == ["ip", "email", "path"] and row["v"] == "reject"
    assert row["r"] == "raw [REDACTED] then [REDACTED] then [REDACTED]"


def test_tiers(spark):
    tier = lambda t: _one(spark, t, lambda c: tiers.argmax(tiers.scores(c)))
    assert tier("deploy with AWS_SECRET_ACCESS_KEY=abcdef123") == "secret" and tier("my doctor said") == "private"
    assert tier("550e8400-e29b-41d4-a716-446655440000") == "internal" and tier(None) == "internal"
    assert tier("---\ntitle: x\nsensitivity: private\n---") == "private"


def test_cohort(spark):
    safe = spark.createDataFrame([("s", 1, "remind EMAIL_1 about PATH_1"), ("s", 2, " ".join(f"IP_{i}" for i in range(6)))], "session_id string, seq long, safe string")
    got = cohort.cohort(safe, 4).filter("seq = 1").orderBy("member").collect()
    assert [r["text"] for r in got][:3] == ["remind EMAIL_1 about PATH_1", "remind EMAIL_10001 about PATH_10001", "remind EMAIL_10002 about PATH_10002"]
    assert cohort.cohort(safe, 4).filter("seq = 2").head()["achieved_k"] == 1
    hidden = cohort.cohort(safe, 3, hide_content=True).filter("seq = 1").orderBy("member").collect()
    assert hidden[1]["text"] == "send PATH_10001 to EMAIL_10001"
    mixed = cohort.scramble(cohort.cohort(safe, 4), "k").filter("seq = 1").collect()
    assert len({r["scrambled"] for r in mixed}) == 4 and all("EMAIL_1 " not in r["scrambled"] for r in mixed)


def test_json_stream_and_paths(spark):
    doc = '{"to":"a","role":"user","meta":{"n":3,"b":["x","y"]}}'
    row = spark.createDataFrame([(doc,)], "d string").select(jsonwalk.leaves(F.col("d")).alias("l"), jsonwalk.rebuild(F.col("d"), F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("r")).head()
    assert [x["pointer"] for x in row["l"]] == ["/meta/b/0", "/meta/b/1", "/to"] and row["r"] == '{"meta":{"b":["1","2"],"n":3},"role":"user","to":"3"}'
    out, held = feed("", "replied to EMAIL", False, {"EMAIL_1": "a@b.c"})
    assert (out, held) == ("replied to ", "EMAIL") and feed(held, "_1 now", True, {"EMAIL_1": "a@b.c"}) == ("a@b.c now", "")
    assert _one(spark, "a/../b/./c", convo.safe_path) == "b/c" and _one(spark, "../x", convo.safe_path) is None


def test_json_documents(spark):
    """Leaves of documents are pseudonymised with collected spans, reversed and audited."""
    docs = ['{"z":"x@y.com","a":["a@b.com, x@y.com",{"role":"r@o.le"}],"n":1}', "[]", "no json"]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(docs)], "session_id string, seq long, doc string")
    known = jsonwalk.mint_json(rows)
    safe = jsonwalk.pseudonymise_json(rows, known)
    got = {r["seq"]: r for r in safe.collect()}
    assert [got[i]["safe"] for i in range(3)] == ['{"a":["EMAIL_1, EMAIL_2",{"role":"r@o.le"}],"n":1,"z":"EMAIL_2"}', "[]", "no json"]
    assert [(x["start"], x["end"], x["replacement"]) for x in got[0]["replaced"]] == [(0, 7, "EMAIL_1"), (9, 16, "EMAIL_2"), (0, 7, "EMAIL_2")]
    assert [got[i]["n_leaves"] for i in range(3)] == [2, 0, 0] and got[1]["replaced"] == []
    back = {r["seq"]: r["restored"] for r in jsonwalk.reverse_json(safe, known, "safe").collect()}
    assert back == {0: '{"a":["a@b.com, x@y.com",{"role":"r@o.le"}],"n":1,"z":"x@y.com"}', 1: "[]", 2: "no json"}
    reply = spark.createDataFrame([("s", 1, '{"b":"EMAIL_1 EMAIL_9","a":"q@r.io"}'), ("s", 2, "{}")], "session_id string, seq long, doc string")
    found = {r["seq"]: [(x["text"], x["start"], x["type"]) for x in r["findings"]] for r in jsonwalk.findings_json(reply, known).collect()}
    assert found == {1: [("q@r.io", 0, "likely_leaked"), ("EMAIL_9", 8, "unknown_pseudonym")], 2: []}


def test_unicode_digits(spark):
    """An address in full-width digits is found where nothing else is."""
    assert [x["kind"] for x in _one(spark, "at １０.０.０.１ now", detect.detect)] == ["IP"]
