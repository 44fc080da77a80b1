"""Rows that repeat keys, have no session or no text; empty tables; plans."""

import pytest
from pyspark.sql import functions as F

from umbra.functions.patterns import SPANS
from umbra.operators import audit, cohort, convo, detect, entities, jsonwalk, metrics, rewrite, tiers
from umbra.sources import files

SCHEMA = "session_id string, seq long, text string"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA).withColumn("spans", detect.detect(F.col("text")))


def test_repeated_and_null_keys(spark):
    """Each row keeps its own cuts, and no surface passes."""
    rows = _rows(spark, ("s", 1, "a@b.com"), ("s", 1, "c@d.org and a@b.com"), (None, 1, "x@y.com"), (None, None, "x@y.com z@y.com"), ("s", 2, None), ("s", 3, ""), ("s", 1, "a@b.com"))
    known = entities.mint(entities.explode_spans(rows))
    got = sorted((str(r["session_id"]), str(r["seq"]), str(r["text"]), str(r["safe"])) for r in rewrite.pseudonymise(rows, known).collect())
    assert len(got) == 7 and all("@" not in x[3] for x in got)
    by = {(x[0], x[2]): x[3] for x in got}
    assert by["s", "a@b.com"] != by["s", "c@d.org and a@b.com"] and by["s", "None"] == "None" and by["s", ""] == ""
    back = rewrite.reverse(rewrite.pseudonymise(rows, known), known, "safe").collect()
    assert len(back) == 7 and all(r["restored"] == r["text"] for r in back)


def test_unminted_surfaces_do_not_pass(spark):
    rows = _rows(spark, ("s", 1, "mail a@b.com"))
    none = entities.mint(entities.explode_spans(rows)).limit(0)
    assert rewrite.pseudonymise(rows, none).head()["safe"] == "mail [EMAIL]"


def test_null_sessions_go_on(spark):
    """A null session's surfaces and counters go on from a table minted before."""
    first = entities.mint(entities.explode_spans(_rows(spark, (None, 1, "a@b.com"))))
    more = entities.mint(entities.explode_spans(_rows(spark, (None, 2, "a@b.com c@d.org"))), first)
    assert sorted((r["canonical"], r["pseudonym"]) for r in more.collect()) == [("a@b.com", "EMAIL_1"), ("c@d.org", "EMAIL_2")]
    assert entities.forget(more, spark.createDataFrame([(None,)], "session_id string")).count() == 0
    looked = entities.pseudonym_for(spark.createDataFrame([(None, "c@d.org"), ("s", "c@d.org")], "session_id string, surface string"), more)
    assert sorted(str(r["pseudonym"]) for r in looked.collect()) == ["EMAIL_2", "None"]


def test_audit_of_repeated_and_null_keys(spark):
    known = entities.mint(entities.explode_spans(_rows(spark, ("s", 1, "a@b.com"), (None, 1, "a@b.com"))))
    replies = spark.createDataFrame([("s", 1, "EMAIL_1 ok"), ("s", 1, "EMAIL_2 bad"), (None, 1, "EMAIL_1 EMAIL_3"), ("s", 2, None), (None, 2, "EMAIL_1")], SCHEMA)
    got = audit.findings(replies, known).select("text", audit.verdict(F.col("findings"), "reject").alias("v")).collect()
    assert sorted((str(r["text"]), r["v"]) for r in got) == [("EMAIL_1", "pass"), ("EMAIL_1 EMAIL_3", "reject"), ("EMAIL_1 ok", "pass"), ("EMAIL_2 bad", "reject"), ("None", "pass")]


def test_findings_in_order(spark):
    """Sorted by start; an unknown pseudonym within a path comes with it, and redaction cuts once."""
    known = entities.mint(entities.explode_spans(_rows(spark, ("s", 1, "a@b.com"))))
    row = audit.findings(spark.createDataFrame([("s", 1, "ü EMAIL_7 /tmp/EMAIL_9/x 1.2.3.4")], SCHEMA), known).select("findings", audit.redact(F.col("text"), F.col("findings")).alias("r")).head()
    assert [(x["start"], x["type"]) for x in row["findings"]] == [(3, "unknown_pseudonym"), (11, "likely_leaked"), (16, "unknown_pseudonym"), (26, "likely_leaked")]
    assert row["r"] == "ü [REDACTED] [REDACTED] [REDACTED]"


def test_scramble(spark):
    """Numbers are distinct, undone by the row's map, not foretold, and alike for null sessions."""
    texts = [(None, 1, m, f"EMAIL_{m} and EMAIL_9, PATH_1") for m in range(4)] + [("s", 1, 0, None), ("s", None, 0, "ABC_7")]
    rows = spark.createDataFrame(texts, "session_id string, seq long, member int, text string")
    got = cohort.scramble(rows, "key").withColumn("undone", rewrite.mapped(F.col("scrambled"), F.col("back"), cohort.OPEN_PSEUDONYM)).collect()
    assert len(got) == 6 and all(r["undone"] == r["text"] for r in got)
    names = {n for r in got if r["session_id"] is None for n in r["scrambled"].replace(",", "").split(" and ")[0].split()}
    assert len(names) == 4 and all(r["scrambled"] != r["text"] for r in got if r["text"])
    again = {r["scrambled"] for r in cohort.scramble(rows).collect()} & {r["scrambled"] for r in cohort.scramble(rows).collect()}
    assert again <= {None}
    small = cohort.scramble(rows.filter("session_id is null"), "key", size=5).collect()
    assert {int(x.split("_")[1].strip(",")) for r in small for x in r["scrambled"].split() if x.startswith("EMAIL")} == {1, 2, 3, 4, 5}


def test_fan_out(spark):
    rows = _rows(spark, ("s", 1, "remind a@b.com"))
    known = entities.mint(entities.explode_spans(rows))
    got = cohort.fan_out(cohort.cohort(rewrite.pseudonymise(rows, known), 4, known), lambda texts: ["re: " + t for t in texts], known).collect()
    assert len(got) == 1 and got[0]["answer"] == "re: remind a@b.com" and 0 <= got[0]["position"] < 4


def test_capacity_errors(spark):
    rows = spark.createDataFrame([("s", 1, "EMAIL_1 UUID_1")], "session_id string, seq long, safe string")
    got = {r["kind"]: r["error"] for r in cohort.capacity(rows, 4, {"EMAIL": 2}).collect()}
    assert got == {"EMAIL": "PoolExhausted", "UUID": "KindUnsupported"}
    assert {r["kind"]: r["error"] for r in cohort.capacity(rows, 4).collect()} == {"EMAIL": None, "UUID": None}


def test_empty_tables(spark):
    rows = _rows(spark, ("s", 1, "a@b.com")).limit(0)
    known = entities.mint(entities.explode_spans(rows))
    docs = rows.withColumn("doc", F.col("text"))
    safe = rewrite.pseudonymise(rows, known)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (known, safe, rewrite.reverse(rows, known), audit.findings(rows, known), cohort.cohort(safe, 4, known), cohort.scramble(cohort.cohort(safe, 4, known), "k"), jsonwalk.pseudonymise_json(docs, known), jsonwalk.reverse_json(docs, known), jsonwalk.findings_json(docs, known), metrics.nearest(vectors, vectors, 3)):
        assert df.count() == 0


def test_clashing_names(spark):
    """Columns named as the operators' own are replaced or kept, never doubled."""
    rows = _rows(spark, ("s", 1, "a@b.com")).withColumns({c: F.lit("x") for c in ("safe", "replaced", "findings", "restored", "known", "norm", "pseudonym", "of")})
    known = entities.mint(entities.explode_spans(rows))
    for df in (rewrite.pseudonymise(rows, known), rewrite.reverse(rows, known), audit.findings(rows, known)):
        assert df.count() == 1 and len(df.columns) == len(set(df.columns))
    assert rewrite.pseudonymise(rows, known).head()["safe"] == "EMAIL_1"


def test_one_scan_a_pattern(spark):
    """However often spans are named, each pattern stands in the plan once."""
    rows = spark.range(3).select(F.concat(F.lit("a@b.com "), F.col("id").cast("string")).alias("text")).withColumn("spans", detect.detect(F.col("text")))
    plan = rows.select("text", F.size("spans").alias("n"), F.explode_outer("spans").alias("x")).filter("x is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= len(SPANS)
    assert tiers and plan.count("split(") <= len(SPANS)


@pytest.mark.parametrize("many", [1, 5000])
def test_long_texts(spark, many):
    row = _rows(spark, ("s", 1, "ü a@b.com /tmp/x 1.2.3.4 " * many))
    known = entities.mint(entities.explode_spans(row))
    got = rewrite.pseudonymise(row, known).head()
    assert got["safe"] == "ü EMAIL_1 PATH_1 IP_1 " * many and len(got["replaced"]) == 3 * many


def test_labels_and_bodies(spark):
    rows = spark.createDataFrame([("Bob met Ann", [("B-PER", 0.9, 0, 3), ("I-PER", 0.8, 8, 11), ("MISC", 0.7, 0, 2), ("LOC", 0.5, 5, 99), ("ORG", 0.5, 4, 4), ("PER", 0.4, 0, 3)])], "text string, t array<struct<label:string,score:double,start:int,end:int>>")
    got = rows.select(detect.tagged_spans(F.col("text"), F.col("t")).alias("x")).head()["x"]
    assert [(x["start"], x["replacement"]) for x in got] == [(0, "PERSON_1"), (8, "PERSON_2"), (0, "PERSON_3")]
    chat = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert convo.anthropic_body(chat, "m").head()["body"] == '{"model":"m","max_tokens":4096,"stream":true,"messages":[{"role":"user","content":"hi"}]}'
    assert convo.openai_body(chat, "m", json_mode=True).head()["body"].endswith('"response_format":{"type":"json_object"}}')


def test_wrapped_chat_and_guard(spark):
    rows = _rows(spark, ("s", 1, "mail a@b.com"), ("s", 2, "and c@d.org, a@b.com")).withColumnRenamed("seq", "turn").withColumns({"conv_id": F.lit(1), "tier": F.lit("private")})
    known = entities.mint(entities.explode_spans(rows.withColumnRenamed("turn", "seq")))
    sent = convo.wrapped(rows, known, "far").orderBy("turn").collect()
    assert [r["text"] for r in sent] == ["mail EMAIL_1", "and EMAIL_2, EMAIL_1"] and "tier" not in sent[0] and sent[0]["backend_id"] == "safe(far)"
    talk = spark.createDataFrame([(1, 0, "public", "x"), (1, 1, None, "key"), (2, 0, "private", "x"), (2, 1, "secret", "x"), (3, 0, None, "x")], "conv_id long, turn long, tier string, text string")
    assert {r["conv_id"]: r["violation"] for r in tiers.guard(talk, F.col("text") == "key").collect()} == {1: 1, 2: 2, 3: None}


def test_trees_and_grep(spark, tmp_path):
    (tmp_path / "a.b").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.b" / "x.txt").write_text("find me a@b.com\nnot\n")
    (tmp_path / "a.b" / "s.env").write_text("API_TOKEN=abcdefgh\nfind me\n")
    (tmp_path / "node_modules" / "y.txt").write_text("find me\n")
    (tmp_path / "axb.txt").write_text("find me too")
    tree = files.tree(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^.*/(?=a.b/|axb)", ""))
    assert {r["name"] for r in files.listing(tree, "").collect()} == {"a.b/", "axb.txt"}
    assert {r["name"] for r in files.listing(tree, "a.b").collect()} == {"x.txt", "s.env"}
    got = [r["safe"] for r in convo.grep_safe(tree, "find me", "s").orderBy("path").collect()]
    assert got == ["a.b/x.txt:1: find me EMAIL_1", "axb.txt:1: find me too"]
    (tmp_path / "q.json").write_text('{"session_id":"s","text":"hi"}\n')
    assert files.requests(spark, str(tmp_path / "q.json"), "text").head()["text"] == "hi"
    assert files.engine_info(spark).head()["status"] == "ok"


def test_models(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "vec_id long, text string")
    got = metrics.embedded(rows, lambda texts: [[len(t), 0.0] for t in texts]).orderBy("vec_id").collect()
    assert [r["embedding"] for r in got] == [[1.0, 0.0], [0.0, 0.0]]
    found = detect.with_model(rows, lambda texts: [[{"start": 0, "end": 1, "kind": "ORG", "text": t[:1]}] if t else [] for t in texts]).orderBy("vec_id").collect()
    assert [len(r["spans"]) for r in found] == [1, 0]

    def fails(texts):
        raise RuntimeError("down")

    assert [len(r["spans"]) for r in detect.with_model(rows, fails).collect()] == [0, 0]
    pairs = spark.createDataFrame([(1, [("p", "Ann Lee"), ("p", "Ann")], [("p", "Ann")])], "doc_id long, pred array<struct<kind:string,text:string>>, gold array<struct<kind:string,text:string>>")
    r = metrics.greedy_match(pairs).head()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 0)
    near = spark.createDataFrame([(i, [float(i == j) + 0.1 for j in range(4)]) for i in range(4)] + [(9, None), (10, [1.0])], "vec_id long, embedding array<float>")
    got = metrics.nearest(near, near.filter("vec_id = 1"), 3, block=2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 2]
    many = metrics.nearest(near, near, 3, block=2, most_bytes=1).collect()
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in many}[1, 1] == 0 and len(many) == 8
