"""Queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kinds
from ..functions.keywords import PRIVATE, SECRET
from ..functions.patterns import ENV, FRONT, SPANS
from ..operators import audit, cohort, convo, detect, entities, jsonwalk, metrics, rewrite, tiers
from ..sources import files
from ..streaming import sessions
from ..tables import written
from .fixtures import PROMPTS, REPLIES, prompts, replies, table
from .twins import API_KEY, AUDIT, COHORT, DECOYED, DECOY_TEXT, FOUND, MINTED, NAMES, REDACTED, RESTORED, SAFE, TOKEN, found, mapped, quoted

_QUERIES, _SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _spans(spark, d) -> DataFrame:
    """Prompts with their spans: detected once and written, as most queries read them twice."""
    return written(prompts(spark, d).withColumn("spans", detect.detect(F.col("text"))), "spans")


def _minted(rows: DataFrame) -> DataFrame:
    return written(entities.mint(entities.explode_spans(rows)), "entities")


def _safe(spark, d) -> tuple[DataFrame, DataFrame]:
    """Prompts with ``safe``, and the entities minted from them."""
    rows = _spans(spark, d)
    known = _minted(rows)
    return rewrite.pseudonymise(rows, known), known


@_query(f"WITH {FOUND} SELECT rid, kind, text, s AS \"start\", e AS \"end\" FROM spans")
def detect_spans_resolved(spark, d):
    rows = prompts(spark, d).select("rid", F.explode_outer(detect.detect(F.col("text"))).alias("x")).filter("x is not null")
    return rows.select("rid", "x.kind", "x.text", "x.start", "x.end")


_DOCS = f"docs AS (SELECT doc_id AS rid, text FROM documents), {found('docs', 'spans')}"


@_query(f"WITH {_DOCS} SELECT rid AS doc_id, kind, text, s AS \"start\", e AS \"end\" FROM spans")
def detect_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode_outer(detect.detect(F.col("text"))).alias("x")).filter("x is not null")
    return rows.select("doc_id", "x.kind", "x.text", "x.start", "x.end")


@_query(f"WITH {FOUND} SELECT kind, count(*) AS n FROM spans GROUP BY kind")
def detect_kind_counts(spark, d):
    return detect_spans_resolved(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@_query(f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted(dict(SPANS)['EMAIL'])})) AS email FROM documents WHERE text LIKE '%@%'")
def detect_spans_email(spark, d):
    docs = table(spark, d, "documents").filter(F.contains("text", F.lit("@")))
    return docs.select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit("(?U)" + dict(SPANS)["EMAIL"]), F.lit(0))).alias("email")).filter("email is not null")


@_query("SELECT doc_id, q, CAST(strlen(substr(text, 1, CAST(length(text) * q // 4 AS INT))) AS INT) AS bytes FROM documents, (SELECT unnest([1, 2, 3, 4]) AS q)")
def span_byte_offsets(spark, d):
    each = table(spark, d, "documents").withColumn("q", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    return each.select("doc_id", "q", detect.byte_offset(F.col("text"), F.floor(F.length("text") * F.col("q") / 4).cast("int")).alias("bytes"))


_GAZ = f"prompts AS ({PROMPTS}), {found('prompts', 'gaz', NAMES)}"


@_query(f"WITH {_GAZ} SELECT rid, kind, text, s AS \"start\", e AS \"end\" FROM gaz")
def gazetteer_detect(spark, d):
    rows = prompts(spark, d).select("rid", F.explode_outer(detect.gazetteer(F.col("text"))).alias("x")).filter("x is not null")
    return rows.select("rid", "x.kind", "x.text", "x.start", "x.end")


@_query(f"""WITH {_GAZ}, {found('prompts', 'spans')},
both_ AS (SELECT rid, kind, text, s, e FROM gaz UNION ALL SELECT rid, kind, text, s, e FROM spans x WHERE NOT EXISTS (SELECT 1 FROM gaz y WHERE x.rid = y.rid AND x.s < y.e AND x.e > y.s)),
one AS (SELECT rid, kind, text, s, e FROM gaz UNION ALL SELECT rid, kind, text, s, e FROM spans WHERE rid NOT IN (SELECT rid FROM gaz)),
named AS (SELECT 'regex' AS strategy, rid, kind, text, s, e FROM spans UNION ALL SELECT 'learned', rid, kind, text, s, e FROM gaz UNION ALL SELECT 'learned_or_regex', * FROM one UNION ALL SELECT 'learned_and_regex', * FROM both_)
SELECT strategy, rid, kind, text, s AS "start", e AS "end" FROM named""")
def fallback_merge(spark, d):
    by = F.array(*(F.struct(F.lit(s).alias("strategy"), detect.detect_with(s, F.col("text")).alias("spans")) for s in detect.STRATEGIES))
    each = prompts(spark, d).select("rid", F.explode(by).alias("b")).select("rid", "b.strategy", F.explode_outer("b.spans").alias("x")).filter("x is not null")
    return each.select("strategy", "rid", "x.kind", "x.text", "x.start", "x.end")


@_query(f"WITH {MINTED} SELECT session_id, norm, kind, n, pseudonym, canonical FROM minted")
def entity_mint(spark, d):
    return entities.mint(entities.explode_spans(_spans(spark, d)))


@_query(f"WITH {MINTED} SELECT session_id, norm, kind, seq, ord FROM minted")
def entity_first_seen(spark, d):
    return entities.first_seen(entities.explode_spans(_spans(spark, d))).select("session_id", "norm", "kind", "at.seq", "at.ord")


@_query(f"WITH {MINTED} SELECT session_id, count(DISTINCT pseudonym) AS entities FROM minted GROUP BY session_id")
def entity_counts(spark, d):
    return entities.counts(_minted(_spans(spark, d)))


@_query(f"""WITH {MINTED}, asked AS (SELECT rid, session_id, 'EMAIL_' || CAST(seq % 9 AS STRING) AS pseudonym FROM prompts)
SELECT a.rid, a.pseudonym, m.canonical AS real, b.pseudonym AS again FROM asked a LEFT JOIN minted m ON m.session_id IS NOT DISTINCT FROM a.session_id AND m.pseudonym = a.pseudonym
LEFT JOIN minted b ON b.session_id IS NOT DISTINCT FROM a.session_id AND b.norm = m.canonical""")
def entity_lookups(spark, d):
    """Names to surfaces and back again."""
    rows = _spans(spark, d)
    known = _minted(rows)
    asked = rows.select("rid", "session_id", F.concat(F.lit("EMAIL_"), (F.col("seq") % 9).cast("string")).alias("pseudonym"))
    real = entities.real_for(asked, known).withColumnsRenamed({"pseudonym": "p", "real": "surface"})
    return entities.pseudonym_for(real, known).select("rid", F.col("p").alias("pseudonym"), F.col("surface").alias("real"), F.col("pseudonym").alias("again"))


_TITLES = ("Dr. ", " dr  ", "MRS. ", "Ms ", "prof.  ", "Miss ", "", "Drew ")


@_query(f"WITH n AS (SELECT c_custkey, ({list(_TITLES)!r})[CAST(c_custkey % 8 AS INT) + 1] || c_name || ' ' AS name FROM customer) SELECT c_custkey, trim(regexp_replace(lower(trim(name)), '^(?:dr\\.?|mr\\.?|mrs\\.?|ms\\.?|prof\\.?|miss)\\s+', '')) AS norm FROM n")
def normalize_person(spark, d):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("c_custkey") % 8).cast("int") + 1)
    return table(spark, d, "customer").select("c_custkey", entities.normalise(F.concat(title, F.col("c_name"), F.lit(" ")), F.lit("PERSON")).alias("norm"))


@_query(f"WITH {SAFE} SELECT rid, session_id, seq, safe FROM safe")
def pseudonymize_text(spark, d):
    return _safe(spark, d)[0].select("rid", "session_id", "seq", "safe")


@_query(f"""WITH {SAFE} SELECT rid, s AS "start", e AS "end", lower(kind) AS kind, CAST(1.0 AS DOUBLE) AS score, pseudonym AS replacement, 'regex' AS source FROM named""")
def pseudonymize_spans(spark, d):
    rows = _safe(spark, d)[0].select("rid", F.explode_outer("replaced").alias("x")).filter("x is not null")
    return rows.select("rid", "x.start", "x.end", "x.kind", F.col("x.score").cast("double").alias("score"), "x.replacement", "x.source")


@_query(f"WITH {RESTORED} SELECT rid, done AS restored FROM restored")
def reverse_map_text(spark, d):
    safe, known = _safe(spark, d)
    return rewrite.reverse(safe, known, "safe").select("rid", "restored")


@_query(f"WITH {RESTORED} SELECT count(*) AS rows, round(avg(CASE WHEN done = text THEN 1.0 WHEN text IS NULL THEN NULL ELSE 0.0 END), 9) AS exact FROM restored")
def roundtrip_rate(spark, d):
    safe, known = _safe(spark, d)
    rows = rewrite.reverse(safe, known, "safe")
    return rows.agg(F.count("*").alias("rows"), F.round(F.avg((F.col("restored") == F.col("text")).cast("double")), 9).alias("exact"))


def _audited(spark, d) -> DataFrame:
    return audit.findings(replies(spark, d), _minted(_spans(spark, d)))


@_query(f"WITH {AUDIT} SELECT r.rid, f.text AS token, f.s AS \"start\" FROM findings f JOIN replies r ON f.rid = r.rid WHERE type = 'unknown_pseudonym'")
def audit_unknown(spark, d):
    rows = _audited(spark, d).select("rid", F.explode_outer("findings").alias("x")).filter("x.type = 'unknown_pseudonym'")
    return rows.select("rid", F.col("x.text").alias("token"), "x.start")


@_query(f"WITH prompts AS ({PROMPTS}), replies AS ({REPLIES}), {found('replies', 'leaks')} SELECT r.session_id, r.seq, l.text AS leak, lower(l.kind) AS kind FROM leaks l JOIN replies r ON l.rid = r.rid")
def audit_leaked(spark, d):
    return audit.leaked(replies(spark, d)).select("session_id", "seq", F.col("finding.text").alias("leak"), "finding.kind")


@_query(f"WITH {AUDIT} SELECT rid, CAST(row_number() OVER (PARTITION BY rid ORDER BY s, src) - 1 AS INT) AS i, s AS \"start\", e AS \"end\", text, type, kind FROM findings")
def audit_findings(spark, d):
    rows = _audited(spark, d).select("rid", F.posexplode_outer("findings").alias("i", "x")).filter("i is not null")
    return rows.select("rid", "i", "x.start", "x.end", "x.text", "x.type", "x.kind")


@_query(f"""WITH {AUDIT}, n AS (SELECT rid, count(*) AS n, bool_or(src = 0) AS u FROM findings GROUP BY rid)
SELECT r.rid, CAST(coalesce(n, 0) AS INT) AS findings, CASE WHEN n IS NULL THEN 'pass' WHEN u THEN 'log_only' ELSE 'log_only' END AS log,
CASE WHEN n IS NULL THEN 'pass' WHEN u THEN 'redact' ELSE 'log_only' END AS redact, CASE WHEN n IS NULL THEN 'pass' WHEN u THEN 'reject' ELSE 'log_only' END AS reject FROM replies r LEFT JOIN n ON r.rid = n.rid""")
def audit_verdict(spark, d):
    return _audited(spark, d).select("rid", F.size("findings").alias("findings"), *(audit.verdict(F.col("findings"), p).alias(p) for p in ("log", "redact", "reject")))


@_query(f"WITH {REDACTED} SELECT rid, text FROM redacted")
def audit_redact(spark, d):
    return _audited(spark, d).select("rid", audit.redact(F.col("text"), F.col("findings")).alias("text"))


@_query(f"WITH {COHORT} SELECT session_id, seq, member, text, CAST(4 AS INT) AS requested_k, CASE WHEN alone THEN 1 ELSE 4 END AS achieved_k FROM members")
def cohort_prompts(spark, d):
    safe, known = _safe(spark, d)
    return cohort.cohort(safe, 4, known)


@_query(f"WITH {DECOYED} SELECT m.session_id, m.seq, m.member, {DECOY_TEXT} AS text FROM members m LEFT JOIN profiles p ON p.rid = m.rid LEFT JOIN many n ON n.profile = p.profile LEFT JOIN decoys d ON d.profile = p.profile AND d.idx = (m.member - 1) % n.n")
def cohort_decoys(spark, d):
    safe, known = _safe(spark, d)
    return cohort.cohort(safe, 4, known, hide_content=True).select("session_id", "seq", "member", "text")


@_query(f"WITH {COHORT} SELECT rid, string_agg(tok, ' ' ORDER BY spot) AS names FROM names GROUP BY rid")
def cohort_entities(spark, d):
    names = cohort.entities(F.col("safe"))
    return _safe(spark, d)[0].select("rid", F.array_join(names, " ").alias("names")).filter("names <> ''")


@_query(f"""WITH {SAFE}, tk AS (SELECT session_id, seq, unnest(m) AS tok, generate_subscripts(m, 1) AS i FROM (SELECT session_id, seq, regexp_extract_all(safe, '{TOKEN}') AS m FROM safe WHERE safe IS NOT NULL)),
fs AS (SELECT session_id, tok, min(struct_pack(seq := seq, i := i)) AS spot FROM tk GROUP BY ALL)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY spot, tok) - 1 AS INT) AS ord, tok AS pseudonym, split_part(tok, '_', 1) AS kind FROM fs""")
def cohort_session_entities(spark, d):
    """Over all of a session's prompts."""
    return cohort.entities_of(_safe(spark, d)[0].select("session_id", "seq", F.col("safe").alias("text")))


@_query(f"WITH {COHORT} SELECT r.rid, CAST(j AS INT) AS j, string_agg(name, ' ' ORDER BY n.spot) AS names FROM renamed r JOIN names n ON r.rid = n.rid AND r.tok = n.tok GROUP BY ALL")
def cohort_synthesize(spark, d):
    rows = _safe(spark, d)[0].select("rid", cohort.entities(F.col("safe")).alias("names")).filter("size(names) > 0").withColumn("j", F.explode(F.array(*map(F.lit, range(3)))))
    return rows.select("rid", "j", F.array_join(cohort.sibling(F.col("names"), F.col("j"), 4), " ").alias("names"))


@_query(f"WITH {COHORT} SELECT rid, profile FROM profiles")
def cohort_profile(spark, d):
    return _safe(spark, d)[0].select("rid", cohort.profile(cohort.entities(F.col("safe"))).alias("profile")).filter("profile <> ''")


@_query(f"""WITH {COHORT}, e AS (SELECT s.session_id, s.seq, n.kind, count(*) AS n FROM names n JOIN safe s ON n.rid = s.rid GROUP BY ALL), k AS (SELECT *, 3 * n AS needed, CAST(CASE kind WHEN 'UUID' THEN 0 WHEN 'EMAIL' THEN 5 ELSE 16 END AS BIGINT) AS available FROM e)
SELECT session_id, seq, kind, needed, available, needed > available AS exhausted, CASE WHEN needed > available AND available = 0 THEN 'KindUnsupported' WHEN needed > available THEN 'PoolExhausted' END AS error FROM k""")
def cohort_capacity(spark, d):
    """A pool without UUIDs and with few e-mail addresses."""
    return cohort.capacity(_safe(spark, d)[0], 4, {k: 16 for k in kinds.KINDS if k != "UUID"} | {"EMAIL": 5})


@_query(f"WITH {COHORT} SELECT session_id, seq, round(log2(count(DISTINCT text)), 9) AS bits FROM members WHERE text IS NOT NULL GROUP BY ALL")
def cohort_entropy(spark, d):
    return cohort.entropy(cohort_prompts(spark, d).filter("text is not null")).withColumn("bits", F.round("bits", 9))


@_query(f"WITH {MINTED} SELECT session_id, bool_or(n + 9996 BETWEEN 10001 AND 10016) AS collides FROM minted GROUP BY session_id")
def cohort_collision(spark, d):
    """Numbers are moved up, so that some sessions have minted names of the pool."""
    return cohort.collision(_minted(_spans(spark, d)).withColumn("n", F.col("n") + 9996))


@_query(f"WITH {COHORT} SELECT session_id, seq, true AS distinct_names, true AS in_range, true AS undone FROM members WHERE text IS NOT NULL GROUP BY ALL")
def cohort_scramble(spark, d):
    """Numbers can't be foretold, so what holds of each cohort is compared: new
    names are as many as old ones, lie in range, and are undone by ``back``."""
    mixed = cohort.scramble(cohort_prompts(spark, d).filter("text is not null")).withColumn("restored", rewrite.mapped(F.col("scrambled"), F.col("back"), cohort.OPEN_PSEUDONYM))
    names = lambda c: F.regexp_extract_all(c, F.lit(cohort.OPEN_PSEUDONYM), F.lit(0))
    number = lambda x: F.substring_index(x, "_", -1).cast("int")
    rows = mixed.select("session_id", "seq", names("text").alias("a"), names("scrambled").alias("b"), (F.col("restored") == F.col("text")).alias("same"))
    fine = F.forall("b", lambda x: (number(x) >= 1) & (number(x) <= 1_000_000))
    per = rows.groupBy("session_id", "seq").agg(F.bool_and("same").alias("undone"), F.bool_and(fine).alias("in_range"), (F.size(F.array_distinct(F.flatten(F.collect_list("a")))) == F.size(F.array_distinct(F.flatten(F.collect_list("b"))))).alias("distinct_names"))
    return per.select("session_id", "seq", "distinct_names", "in_range", "undone")


def _count_sql(words):
    return " + ".join(f"CAST(contains(lower(text), {quoted(w)}) AS INT)" for w in words)


@_query(f"SELECT doc_id, {_count_sql(PRIVATE)} AS private, {_count_sql(SECRET)} AS secret FROM documents")
def tier_keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", tiers.hits(F.col("text"), PRIVATE).alias("private"), tiers.hits(F.col("text"), SECRET).alias("secret"))


def _scores_sql(src: str) -> str:
    """The cascade over ``src`` (rid, text): each score is one CASE over what a text holds."""
    rules = ("fs", "env", "sk > 0", "fp", "pk > 0")
    table_ = {"public": ("0.0", "0.0", "0.02", "0.02", "(1 - c) * 0.05", "0.25"), "internal": ("0.05", "0.05", "0.08", "0.08", "(1 - c) * 0.6", "0.55"), "private": ("0.1", "0.15", "0.2", "0.8", "c", "0.15"), "secret": ("0.85", "0.8", "0.7", "0.1", "(1 - c) * 0.35", "0.05")}
    case = lambda v: "round(CAST(CASE " + " ".join(f"WHEN {r} THEN {x}" for r, x in zip(rules, v, strict=False)) + f" ELSE {v[-1]} END AS DOUBLE), 6)"
    return f"""k AS (SELECT rid, regexp_matches(text, {quoted(FRONT.format("secret"))}) AS fs, regexp_matches(text, {quoted(FRONT.format("private"))}) AS fp, regexp_matches(text, {quoted(ENV)}) OR regexp_matches(text, {quoted(API_KEY)}) AS env, ({_count_sql(SECRET)}) AS sk, ({_count_sql(PRIVATE)}) AS pk FROM (SELECT rid, coalesce(text, '') AS text FROM {src})),
c AS (SELECT *, CAST(least(0.55 + 0.07 * pk, 0.85) AS DOUBLE) AS c FROM k),
scores AS (SELECT rid, {", ".join(f"{case(v)} AS {t}" for t, v in table_.items())} FROM c),
tiers AS (SELECT rid, CASE WHEN secret >= greatest(public, internal, private) THEN 'secret' WHEN private >= greatest(public, internal) THEN 'private' WHEN internal >= public THEN 'internal' ELSE 'public' END AS tier FROM scores)"""


@_query(f"WITH prompts AS ({PROMPTS}), {_scores_sql('prompts')} SELECT rid, tier FROM tiers")
def tier_argmax(spark, d):
    return prompts(spark, d).select("rid", tiers.argmax(tiers.scores(F.col("text"))).alias("tier"))


@_query(f"WITH docs AS (SELECT doc_id AS rid, text FROM documents), {_scores_sql('docs')} SELECT rid AS doc_id, public, internal, private, secret FROM scores")
def tier_scores(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(tiers.scores(F.col("text")))).alias("s"))
    return rows.select("doc_id", *(F.round(f"s.{t}", 6).alias(t) for t in kinds.LADDER))


@_query(f"WITH prompts AS ({PROMPTS}), {_scores_sql('prompts')}, {found('prompts', 'spans')} SELECT rid, CASE WHEN tier = 'secret' THEN tier WHEN rid IN (SELECT rid FROM spans) THEN 'private' ELSE tier END AS tier FROM tiers")
def tier_with_presence(spark, d):
    return prompts(spark, d).select("rid", tiers.argmax(tiers.with_presence(F.col("text"), detect.detect(F.col("text")))).alias("tier"))


@_query(f"WITH {SAFE}, {_scores_sql('prompts')} SELECT s.rid, CASE WHEN t.tier = 'secret' THEN '[withheld: file' || CAST(s.rid AS STRING) || ' holds a credential]' ELSE s.safe END AS text, t.tier = 'secret' AS withheld FROM safe s JOIN tiers t ON s.rid = t.rid")
def read_files(spark, d):
    """Prompts as files of their session."""
    rows = _spans(spark, d)
    files = rows.withColumn("path", F.concat(F.lit("file"), F.col("rid").cast("string")))
    return tiers.read_files(files, _minted(rows)).select(F.substring("path", 5, 20).cast("long").alias("rid"), "text", "withheld")


@_query(f"WITH said AS (SELECT conv_id * 100 + turn AS rid, role, text FROM conversations), {_scores_sql('said')} SELECT role, tier, count(*) AS n FROM tiers t JOIN said USING (rid) GROUP BY ALL")
def role_counts_by_tier(spark, d):
    rows = table(spark, d, "conversations").select("role", tiers.argmax(tiers.scores(F.col("text"))).alias("tier"))
    return rows.groupBy("role", "tier").agg(F.count("*").alias("n"))


@_query("""WITH x AS (SELECT event_id, CAST(event_id % 7 AS DOUBLE) / 16 AS a, CAST(event_id % 5 AS DOUBLE) / 8 AS b, CAST(event_id % 3 AS DOUBLE) / 8 AS c, CAST(event_id % 11 AS DOUBLE) / 16 AS d FROM events),
y AS (SELECT *, list_reverse_sort([a, b, c, d]) AS o, CASE WHEN d >= greatest(a, b, c) THEN 3 WHEN c >= greatest(a, b) THEN 2 WHEN b >= a THEN 1 ELSE 0 END AS r FROM x)
SELECT event_id, o[1] - o[2] AS margin, (['public', 'internal', 'private', 'secret'])[CASE WHEN o[1] - o[2] < 0.2 THEN least(r + 2, 4) ELSE r + 1 END] AS tier, o[1] - o[2] < 0.2 AS escalated FROM y""")
def tier_margin_escalate(spark, d):
    s = F.struct(*((F.col("event_id") % m).cast("double").__truediv__(n).alias(t) for t, m, n in zip(kinds.LADDER, (7, 5, 3, 11), (16, 8, 8, 16), strict=True)))
    rows = table(spark, d, "events").select("event_id", s.alias("s")).withColumn("e", tiers.escalate(F.col("s")))
    return rows.select("event_id", tiers.margin(F.col("s")).alias("margin"), "e.tier", "e.escalated")


_ROUTE = """r AS (SELECT event_id, (['public', 'internal', 'private', 'secret'])[CAST(event_id % 4 AS INT) + 1] AS tier, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'anthropic' END AS remote,
 CASE WHEN event_id % 5 < 2 THEN NULL ELSE 'webllm' END AS local, event_id % 7 > 2 AS here FROM events),
b AS (SELECT event_id, k, r.* EXCLUDE (event_id), CASE WHEN tier IN ('public', 'internal') THEN coalesce(remote, local) WHEN tier = 'private' AND remote IS NULL THEN local
 WHEN tier = 'private' THEN CASE WHEN k > 1 THEN 'cohort(' ELSE 'safe(' END || remote || ')' WHEN here THEN local END AS backend_id FROM r, (SELECT unnest([1, 4]) AS k))"""


@_query(f"""WITH {_ROUTE} SELECT event_id, k, tier, backend_id, tier = 'private' AND remote IS NOT NULL AS transformed, tier = 'secret' AND backend_id IS NULL AS withheld,
CASE WHEN backend_id IS NULL AND tier <> 'secret' THEN 'no backend for ' || tier END AS error FROM b""")
def tier_route(spark, d):
    """Every branch: any tier, with and without a remote and a local backend."""
    at = lambda m: F.col("event_id") % m
    tier = F.element_at(F.array(*map(F.lit, kinds.LADDER)), at(4).cast("int") + 1)
    remote, local = F.when(at(3) != 0, F.lit("anthropic")), F.when(at(5) >= 2, F.lit("webllm"))
    by = F.array(*(F.struct(F.lit(k).alias("k"), tiers.route(tier, remote, local, at(7) > 2, cohort_k=k).alias("r")) for k in (1, 4)))
    return table(spark, d, "events").select("event_id", F.explode(by).alias("x")).select("event_id", "x.k", "x.r.tier", "x.r.backend_id", "x.r.transformed", "x.r.withheld", "x.r.error")


@_query(f"""WITH {_ROUTE}, w AS (SELECT *, tier = 'secret' AND backend_id IS NULL AS withheld FROM b WHERE k = 4)
SELECT event_id, tier, withheld, event_id % 2 = 0 AS escalated, CASE WHEN NOT withheld THEN backend_id END AS backend_id, CASE WHEN NOT withheld THEN tier = 'private' AND remote IS NOT NULL END AS transformed FROM w""")
def tier_trace(spark, d):
    routed = tier_route(spark, d).filter("k = 4").select("event_id", F.struct("tier", "withheld", "backend_id", "transformed").alias("r"))
    return routed.select("event_id", tiers.trace(F.col("r"), F.col("event_id") % 2 == 0).alias("t")).select("event_id", "t.tier", "t.withheld", "t.escalated", "t.backend_id", "t.transformed")


@_query("SELECT unnest(" + repr(list(kinds.WIRE_KINDS)) + ") AS kind, CASE WHEN kind IN " + repr(kinds.SECRET_KINDS) + " THEN 'secret' ELSE 'private' END AS tier")
def tier_floor(spark, d):
    rows = spark.createDataFrame([(k,) for k in kinds.WIRE_KINDS], "kind string")
    return rows.select("kind", kinds.floor_tier(F.col("kind")).alias("tier"))


_BACKENDS = ", ".join(f"({quoted(b[0])}, {b[1]}, {[*b[8].split(',')]!r}, {b[9]})" for b in kinds.BACKENDS)
_CHAIN = ", ".join(f"({quoted(t)}, {i}, {quoted(b)})" for t, row in kinds.CHAIN.items() for i, b in enumerate(row))


@_query(f"SELECT t.tier, b.id AS backend_id FROM (VALUES {_BACKENDS}) b(id, chat, tiers, here), (SELECT unnest({list(kinds.LADDER)!r}) AS tier) t WHERE chat AND list_contains(tiers, t.tier) AND (t.tier <> 'secret' OR here)")
def backend_eligibility(spark, d):
    rows = [kinds.eligible(kinds.backends(spark), t).select(F.lit(t).alias("tier"), "backend_id") for t in kinds.LADDER]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@_query(f"""WITH c(tier, rank, backend_id) AS (VALUES {_CHAIN}), up AS (SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'anthropic' WHEN 'view' THEN 'webllm' ELSE 'zero-tvm' END AS backend_id FROM events WHERE event_type IN ('click', 'view', 'error'))
SELECT DISTINCT c.tier, (SELECT arg_min(x.backend_id, x.rank) FROM c x WHERE x.tier = c.tier AND x.backend_id IN (SELECT backend_id FROM up)) AS backend_id FROM c""")
def fallback_chain(spark, d):
    """What is reachable comes from the events' types."""
    kind = F.col("event_type")
    up = table(spark, d, "events").filter(kind.isin("click", "view", "error")).select(F.when(kind == "click", "anthropic").when(kind == "view", "webllm").otherwise("zero-tvm").alias("backend_id"))
    return kinds.first_reachable(kinds.chain(spark), up)


_GUARDED = "g AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn > 4 THEN 'private' WHEN turn = 3 AND conv_id % 5 = 0 THEN 'secret' WHEN role = 'system' THEN NULL ELSE 'public' END AS tier, contains(text, 'a') AS held FROM conversations)"


@_query(f"WITH {_GUARDED}, v AS (SELECT *, CASE WHEN tier = 'secret' OR tier IS NULL AND held THEN 1 WHEN tier = 'private' THEN 2 END AS bad FROM g) SELECT conv_id, CAST(arg_min(bad, turn) FILTER (WHERE bad IS NOT NULL) AS INT) AS violation FROM v GROUP BY conv_id")
def remote_guard(spark, d):
    turn, role = F.col("turn"), F.col("role")
    tier = F.when((role == "assistant") & (turn > 4), "private").when((turn == 3) & (F.col("conv_id") % 5 == 0), "secret").when(role != "system", "public")
    return tiers.guard(table(spark, d, "conversations").withColumn("tier", tier), F.contains("text", F.lit("a")))


@_query("SELECT doc_id, CAST(i AS INT) AS line, trim(x) AS text FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE contains(text, 'license') AND NOT regexp_matches(text, " + quoted(ENV) + ") AND NOT regexp_matches(text, " + quoted(API_KEY) + ") AND (" + _count_sql(SECRET) + ") = 0)) WHERE contains(x, 'license')")
def grep_lines(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return convo.grep(docs, "license").withColumnRenamed("path", "doc_id")


_TALK = "t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 = 2 THEN 'tool' ELSE role END AS role, 'call' || CAST(turn AS STRING) AS tool_call_id, text FROM conversations)"


def _talk(spark, d) -> DataFrame:
    """Conversations in which tools speak too."""
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 2), "tool").otherwise(F.col("role"))
    return table(spark, d, "conversations").withColumns({"role": role, "tool_call_id": F.concat(F.lit("call"), F.col("turn").cast("string"))})


@_query(f"""WITH {_TALK}, l AS (SELECT conv_id, max(turn) FILTER (WHERE role IN ('user', 'tool')) AS last FROM t GROUP BY conv_id),
p AS (SELECT t.*, l.last FROM t JOIN l USING (conv_id)),
f AS (SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') AS s,
 coalesce(string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'tool' THEN '[tool ' || tool_call_id || ']: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system' AND turn IS DISTINCT FROM last), '') AS t,
 coalesce(max(CASE WHEN role = 'tool' THEN '[tool result] ' ELSE '' END || text) FILTER (WHERE turn = last), '') AS u FROM p GROUP BY conv_id)
SELECT conv_id, CASE WHEN s <> '' AND t <> '' THEN s || chr(10) || chr(10) || t ELSE s || t END AS system, u AS "user" FROM f""")
def convo_fold(spark, d):
    return convo.fold(_talk(spark, d))


@_query("""SELECT conv_id, '{"model":"model","max_tokens":4096,"stream":true,"messages":[' || coalesce(string_agg('{"role":"' || CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END || '","content":' || CAST(to_json(text) AS STRING) || '}', ',' ORDER BY turn) FILTER (WHERE role <> 'system'), '') || ']'
|| coalesce(',"system":' || CAST(to_json(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system')) AS STRING), '') || ',"temperature":0.5,"stop_sequences":["END"]}' AS body FROM conversations GROUP BY conv_id""")
def anthropic_body(spark, d):
    return convo.anthropic_body(table(spark, d, "conversations"), "model", temperature=0.5, stop=["END"])


@_query(f"""WITH {_TALK} SELECT conv_id, '{{"model":"model","messages":[' || string_agg('{{"role":"' || role || '","content":' || CAST(to_json(text) AS STRING) || CASE WHEN role = 'tool' THEN ',"tool_call_id":"' || tool_call_id || '"' ELSE '' END || '}}', ',' ORDER BY turn)
|| '],"stream":true,"max_tokens":2048,"temperature":0.5,"stop":["END"],"response_format":{{"type":"json_object"}}}}' AS body FROM t GROUP BY conv_id""")
def openai_body(spark, d):
    return convo.openai_body(_talk(spark, d), "model", temperature=0.5, stop=["END"], json_mode=True)


@_query(f"""WITH {SAFE} SELECT rid, coalesce(session_id, 'none') AS conv_id, seq AS turn, safe AS text, 'safe(anthropic)' AS backend_id, true AS pii FROM safe""")
def wrapped_chat(spark, d):
    rows = _spans(spark, d)
    sent = convo.wrapped(rows.withColumnsRenamed({"seq": "turn"}).withColumns({"conv_id": F.coalesce("session_id", F.lit("none")), "tier": F.lit("private")}), _minted(rows), "anthropic")
    return sent.select("rid", "conv_id", "turn", "text", "backend_id", "pii")


def _sse(spark, d, flavour: str) -> DataFrame:
    """Reply streams in every state: with an end, cut by length after turn 2, or
    without an end; between the frames there is bad JSON and a comment."""
    rows = table(spark, d, "conversations")
    if flavour == "openai":
        body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"), F.when((F.col("conv_id") % 3 == 1) & (F.col("turn") == 2), "length").alias("finish_reason"))).alias("choices")))
        end = F.when(F.col("how") == 0, F.lit("data: [DONE]\n\n")).otherwise("")
    else:
        text = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), F.col("text")).alias("delta")))
        stop = F.lit('data: {"type":"message_delta","delta":{"stop_reason":"max_tokens"}}\n\ndata: ')
        body = F.when((F.col("conv_id") % 3 == 1) & (F.col("turn") == 2), F.concat(F.substring(stop, 7, 1000), text)).otherwise(text)
        end = F.when(F.col("how") == 0, F.lit('event: message_stop\ndata: {"type":"message_stop"}\n\n')).otherwise("")
    frame = F.concat(F.lit("data: "), body, F.lit("\n\ndata: {bad\n\n: comment\n\n"))
    frames = rows.select(F.col("conv_id").cast("string").alias("stream_id"), (F.col("conv_id") % 3).alias("how"), "turn", frame.alias("f"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "f"))), lambda x: x["f"]), "")
    return frames.groupBy("stream_id", "how").agg(one.alias("f")).select("stream_id", F.concat("f", end).alias("body"))


def _sse_sql(last: str) -> str:
    return f"""WITH t AS (SELECT conv_id, turn, text, max(turn) FILTER (WHERE turn = 2) OVER (PARTITION BY conv_id) IS NOT NULL AND conv_id % 3 = 1 AS cut FROM conversations),
s AS (SELECT conv_id, bool_or(cut) AS cut, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE NOT cut OR turn {last} 2), '') AS text FROM t GROUP BY conv_id)
SELECT CAST(conv_id AS STRING) AS stream_id, text, CASE WHEN cut THEN 'length' ELSE 'stop' END AS finish_reason FROM s"""


def _collected(tokens: DataFrame) -> DataFrame:
    ends = tokens.filter("done").select("stream_id", "finish_reason")
    return convo.collect_text(tokens).join(ends, "stream_id")


@_query(_sse_sql("<="))
def sse_parse(spark, d):
    return _collected(convo.openai_tokens(_sse(spark, d, "openai")))


@_query(_sse_sql("<"))
def sse_parse_messages(spark, d):
    return _collected(convo.anthropic_tokens(_sse(spark, d, "anthropic")))


@_query(_sse_sql("<="))
def chunk_stream(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("content"), F.when((F.col("conv_id") % 3 == 1) & (F.col("turn") == 2), "length").alias("finish_reason"))
    return _collected(convo.chunk_tokens(rows))


@_query(f"""WITH {MINTED}, replies AS ({REPLIES}), live AS (SELECT rid, session_id, CASE WHEN rid % 3 = 0 THEN text ELSE regexp_replace(text, '[A-Za-z0-9_]*$', '') END AS text FROM replies WHERE text IS NOT NULL),
{mapped("live", "text", "out_", "minted", "pseudonym", "canonical")} SELECT CAST(rid AS STRING) AS stream_id, done AS text FROM out_""")
def stream_reverse_map(spark, d):
    """Replies as streams of seven characters a token, a third of which end."""
    rows = replies(spark, d).filter("text is not null")
    named = entities.looked_up(rows, rewrite.tokens_of(F.col("text")), _minted(_spans(spark, d)), "pseudonym", "canonical", "known")
    part = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 7).cast("int")), lambda i: F.substring("text", i * 7 + 1, F.lit(7)))
    each = named.select(F.col("rid").cast("string").alias("stream_id"), "known", F.posexplode(F.concat(part, F.array(F.lit("")))).alias("seq", "text"), F.size(part).alias("last"))
    return sessions.replayed(each.withColumn("done", (F.col("stream_id").cast("long") % 3 == 0) & (F.col("seq") == F.col("last"))))


@_query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL")
def role_counts(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))


def _json(rows: DataFrame, text: str = "text") -> DataFrame:
    doc = F.to_json(F.struct(F.col(text).alias("body"), F.lit("user").alias("role"), F.struct(F.col(text).alias("note")).alias("meta")))
    return rows.filter(F.col(text).isNotNull()).withColumn("doc", doc)


def _safe_json(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _json(prompts(spark, d))
    known = written(jsonwalk.mint_json(rows), "entities")
    return jsonwalk.pseudonymise_json(rows, known), known


def _json_sql(text: str) -> str:
    return f"""'{{"body":' || CAST(to_json({text}) AS STRING) || ',"meta":{{"note":' || CAST(to_json({text}) AS STRING) || '}},"role":"user"}}'"""


@_query(f"WITH prompts AS ({PROMPTS}) SELECT rid, CAST(leaf AS INT) AS leaf, pointer, text FROM prompts, (VALUES (0, '/body'), (1, '/meta/note')) l(leaf, pointer) WHERE text IS NOT NULL")
def json_leaves(spark, d):
    rows = jsonwalk.with_leaves(_json(prompts(spark, d)).select("rid", "doc"))
    return rows.select("rid", F.posexplode_outer("umbra_leaves").alias("leaf", "x")).select("rid", "leaf", "x.pointer", "x.text")


@_query(f"WITH {SAFE} SELECT rid, {_json_sql('safe')} AS doc, CAST(2 AS INT) AS n FROM safe WHERE safe IS NOT NULL")
def pseudonymize_json_flat(spark, d):
    return _safe_json(spark, d)[0].select("rid", F.col("safe").alias("doc"), F.col("n_leaves").alias("n"))


@_query(f"WITH {SAFE} SELECT rid, s AS \"start\", e AS \"end\", lower(kind) AS kind, pseudonym AS replacement FROM named, (SELECT unnest([0, 1]))")
def pseudonymize_json_collect(spark, d):
    rows = _safe_json(spark, d)[0].select("rid", F.explode_outer("replaced").alias("x")).filter("x is not null")
    return rows.select("rid", "x.start", "x.end", "x.kind", "x.replacement")


@_query(f"WITH {RESTORED} SELECT rid, {_json_sql('done')} AS doc FROM restored WHERE done IS NOT NULL")
def reverse_map_json(spark, d):
    safe, known = _safe_json(spark, d)
    return jsonwalk.reverse_json(safe, known, "safe").select("rid", F.col("restored").alias("doc"))


@_query(f"WITH {AUDIT} SELECT f.rid, CAST(2 * count(*) AS INT) AS findings, CASE WHEN bool_or(src = 0) THEN 'redact' ELSE 'log_only' END AS verdict FROM findings f GROUP BY f.rid")
def audit_json(spark, d):
    found_ = jsonwalk.findings_json(_json(replies(spark, d)), _minted(_spans(spark, d)))
    return found_.select("rid", F.size("findings").alias("findings"), audit.verdict(F.col("findings"), "redact").alias("verdict")).filter("findings > 0")


@_query("WITH l AS (SELECT user_id, max(event_id) AS last_used FROM events GROUP BY user_id) SELECT 's' || CAST(user_id AS STRING) AS session_id, last_used, (SELECT max(event_id) FROM events) - last_used >= 300 AS evicted FROM l")
def session_evict_idle(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("at"))
    return entities.evict(rows, rows.agg(F.max("at")).scalar(), 300)


@_query("WITH g AS (SELECT user_id, event_id, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) >= 200, false) AS b FROM events) SELECT 's' || CAST(user_id AS STRING) AS session_id, event_id AS seq, CAST(sum(CAST(b AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS incarnation FROM g")
def session_incarnations(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"))
    return entities.incarnations(rows, 200).select("session_id", "seq", "incarnation")


_PG = """pred AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'location' ELSE 'org' END AS kind, CAST(doc_id % 10 AS INT) AS s, CAST(doc_id % 10 + 4 AS INT) AS e, CAST(doc_id % 10 AS DOUBLE) / 10 AS score FROM documents),
gold AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'location' ELSE 'org' END AS kind, 5 AS s, 9 AS e FROM documents)"""


def _pred_gold(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    names = lambda m: F.element_at(F.array(F.lit("person"), F.lit("location"), F.lit("org")), F.least(F.col("doc_id") % m, F.lit(2)).cast("int") + 1)
    at = (F.col("doc_id") % 10).cast("int")
    return docs.select("doc_id", names(3).alias("kind"), at.alias("start"), (at + 4).alias("end"), (at.cast("double") / 10).alias("score")), docs.select("doc_id", names(4).alias("kind"), F.lit(5).alias("start"), F.lit(9).alias("end"))


_PRF = """p AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = x.doc_id AND g.kind = x.kind AND g.s < x.e AND x.s < g.e)) AS h FROM pred x GROUP BY {r}(kind)),
g AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM pred q WHERE q.doc_id = x.doc_id AND q.kind = x.kind AND q.s < x.e AND x.s < q.e)) AS h FROM gold x GROUP BY {r}(kind)),
s AS (SELECT p.kind, p.h / p.n::DOUBLE AS precision, g.h / g.n::DOUBLE AS recall FROM p JOIN g ON p.kind IS NOT DISTINCT FROM g.kind)
SELECT kind, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM s"""


@_query(f"WITH {_PG}, {_PRF.format(r='ROLLUP ')}")
def overlap_prf_rollup(spark, d):
    pred, gold = _pred_gold(spark, d)
    return metrics.overlap_scores(pred.drop("score"), gold).select("kind", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@_query(f"WITH {_PG}, {_PRF.format(r='')}")
def overlap_prf(spark, d):
    return overlap_prf_rollup(spark, d).filter("kind is not null")


_SWEPT = " UNION ALL ".join(
    f"SELECT CAST({t} AS DOUBLE) AS threshold, * FROM (WITH {_PG.replace('pred AS', 'pred0 AS')}, pred AS (SELECT * FROM pred0 WHERE score >= {t}), {_PRF.format(r='ROLLUP ').replace('FROM p JOIN g ON', 'FROM g LEFT JOIN p ON').replace('p.kind, p.h / p.n::DOUBLE', 'g.kind, coalesce(p.h / p.n::DOUBLE, 0)')})"
    for t in (0.3, 0.5, 0.7)
)


@_query(_SWEPT)
def threshold_sweep(spark, d):
    """With a row over all kinds at each threshold."""
    return metrics.sweep(*_pred_gold(spark, d)).select(F.col("threshold").cast("double").alias("threshold"), "kind", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@_query(f"WITH {RESTORED}, u AS (SELECT s.rid, s.safe, n.text AS unit FROM named n JOIN safe s ON n.rid = s.rid UNION ALL SELECT rid, safe, 'example' FROM safe WHERE text IS NOT NULL) SELECT round(avg(CASE WHEN contains(lower(safe), lower(unit)) THEN 1.0 ELSE 0.0 END), 9) AS leakage, (SELECT round(avg(CASE WHEN done = text THEN 1.0 WHEN text IS NULL THEN NULL ELSE 0.0 END), 9) FROM restored) AS exact FROM u")
def leakage_verbatim(spark, d):
    """Units are the prompts' surfaces and one word that rewriting leaves in some."""
    safe, known = _safe(spark, d)
    rows = rewrite.reverse(safe, known, "safe").withColumn("units", F.when(F.col("text").isNotNull(), F.concat(F.transform("spans", lambda x: x["text"]), F.array(F.lit("example")))).otherwise(F.array().cast("array<string>")))
    return metrics.verbatim_leakage(rows).select(*(F.round(c, 9).alias(c) for c in ("leakage", "exact")))


@_query(f"""WITH {FOUND}, u AS (SELECT rid, unnest(['EXAMPLE', 'user1@example.com', 'nowhere']) AS unit FROM prompts),
m AS (SELECT u.rid, NOT EXISTS (SELECT 1 FROM spans s WHERE s.rid = u.rid AND (contains(lower(s.text), lower(unit)) OR contains(lower(unit), lower(s.text)))) AS missed FROM u),
r AS (SELECT rid, count(*) FILTER (WHERE missed) AS m FROM m GROUP BY rid)
SELECT round(sum(m) / (3.0 * count(*)), 9) AS leakage, round(avg(CASE WHEN m = 0 THEN 1.0 ELSE 0.0 END), 9) AS clean FROM r""")
def leakage_relaxed(spark, d):
    rows = _spans(spark, d).select(F.lit("EXAMPLE||user1@example.com||nowhere||").alias("units"), F.transform("spans", lambda x: x["text"]).alias("spans"))
    return metrics.relaxed_leakage(rows).select(*(F.round(c, 9).alias(c) for c in ("leakage", "clean")))


@_query("SELECT l.label, CASE WHEN l.label LIKE '%NAME' AND l.label <> 'COMPANYNAME' THEN 'person' WHEN l.label IN ('CITY', 'STATE', 'COUNTY') THEN 'location' WHEN l.label = 'COMPANYNAME' THEN 'org' END AS corpus, t.label AS tag, CASE split_part(t.label, '-', 2) WHEN 'PER' THEN 'PERSON' WHEN 'ORG' THEN 'ORG' WHEN 'LOC' THEN 'LOCATION' END AS kind FROM (SELECT unnest(['FIRSTNAME', 'LASTNAME', 'MIDDLENAME', 'CITY', 'STATE', 'COUNTY', 'COMPANYNAME', 'IBAN']) AS label) l, (SELECT unnest(['B-PER', 'I-ORG', 'b-LOC', 'B-MISC']) AS label) t")
def ner_label_map(spark, d):
    labels = spark.createDataFrame([(x,) for x in ("FIRSTNAME", "LASTNAME", "MIDDLENAME", "CITY", "STATE", "COUNTY", "COMPANYNAME", "IBAN")], "label string")
    each = labels.withColumn("tag", F.explode(F.array(*map(F.lit, ("B-PER", "I-ORG", "b-LOC", "B-MISC")))))
    return each.select("label", metrics.corpus_kind(F.col("label")).alias("corpus"), "tag", detect.tagged(F.col("tag")).alias("kind"))


@_query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(e[1] / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6) AS first, round(e[len(e)] / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6) AS last FROM v""")
def embed_l2norm(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(F.array(metrics.normalised(F.col("embedding")))).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@_query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 6) AS score FROM n q JOIN n c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 4""")
def knn_siblings(spark, d):
    rows = table(spark, d, "embeddings")
    return metrics.nearest(rows, rows.filter("vec_id % 100 = 0"), 5)


_HOSTS = "CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'localhost' WHEN 1 THEN 'LocalHost' WHEN 2 THEN '127.0.0.' || CAST(event_id % 300 AS STRING) WHEN 3 THEN '::1' WHEN 4 THEN '[::1]' WHEN 5 THEN '128.0.0.1' WHEN 6 THEN '127.0.0' WHEN 7 THEN 'localhost.example.org' ELSE '127.1.2.3.4' END"


@_query(f"""WITH h AS (SELECT event_id, {_HOSTS} AS host FROM events) SELECT event_id, host, lower(host) IN ('localhost', '::1', '[::1]') OR
coalesce(len(string_split(host, '.')) = 4 AND len(list_filter(string_split(host, '.'), lambda x: try_cast(x AS INT) BETWEEN 0 AND 255)) = 4 AND string_split(host, '.')[1] = '127', false) AS loopback FROM h""")
def loopback_hosts(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(_HOSTS).alias("host")).select("event_id", "host", convo.loopback(F.col("host")).alias("loopback"))


@_query("SELECT page_id, regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END, '/$', '') AS base FROM pages")
def url_base(spark, d):
    url = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/").otherwise(""))
    return table(spark, d, "pages").select("page_id", convo.base_url(url).alias("base"))


@_query("SELECT doc_id, text FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50")
def corpus_sample(spark, d):
    return files.sample(table(spark, d, "documents"), "en", 50).select("doc_id", "text")


@_query("SELECT doc_id AS id, text, source FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def corpus_union(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    return files.corpora(docs.select(F.col("doc_id").alias("id"), "text", "source"), items.select(F.col("item_id").alias("id"), "text"))


@_query("SELECT 'ok' AS status")
def engine_info(spark, d):
    return files.engine_info(spark).select("status")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _safe(spark, sf_dir)[0].select("session_id", "seq", "text", "safe")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
