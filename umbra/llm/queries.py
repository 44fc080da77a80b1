"""The queries of this subpackage: thin readers and digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    done = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, keep="none", min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses

    return derivatives(responses(table(spark, sf_dir, "pages")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    trees = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), trees).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin("assign", "access", "hex"))
    many = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(many(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, max_repeats=4.0).select("doc_id", "source", "tokens", "copy", "place")


def op7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .counts import document_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return document_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json")), end_id=50256).select("doc_id", "n_tokens", "start")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import neighbours

    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.filter("vec_id % 50 = 0"), k=5)


def queries() -> dict:
    return {"op1_lines": op1_lines, "op2_warc": op2_warc, "op3_quality": op3_quality, "op4_jaccard": op4_jaccard, "op5_topk": op5_topk, "op6_mixing": op6_mixing, "op7_counts": op7_counts, "op8_neighbours": op8_neighbours, "op9_secrets": op9_secrets, "op10_packing": op10_packing}


def oracle_sql() -> dict[str, str]:
    return {"op1_lines": OP1, "op4_jaccard": OP4, "op5_topk": OP5, "op9_secrets": _op9()}


#: Each row is a document, rows that repeat an id too. White space at a line's ends is trimmed as the bytes 9 to 13 and 32; A-Z only are lowered.
OP1 = r"""
WITH lines AS (
  SELECT r, doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
hot AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM hot)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM hot)), '')) AS kept_sha256
FROM lines GROUP BY r, doc_id
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
WHERE rank <= 5
"""


def _op9() -> str:
    """Each rule's matches by extraction, with their places summed up from the gaps."""
    from .secrets import BASE, MORE

    rules = [(i, r.kind, r.head.replace("(live|test)", "(?:live|test)").replace("([A-Z0-9]+ )", "(?:[A-Z0-9]+ )"), r.tail, r.least, r.of_tail, r.few) for i, r in enumerate(BASE + MORE)]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pats = ", ".join(f"({i}, {quoted(kind)}, {quoted(head + tail + (f'{{{few},}}' if few > 1 else '+' if tail else ''))}, {least}, {quoted(head if of_tail else '')})" for i, kind, head, tail, least, of_tail, few in rules)
    return f"""
WITH pats(ord, kind, pat, least, head) AS (VALUES {pats}),
docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS (SELECT doc_id, ord, kind, least, head, regexp_extract_all(t, pat) AS m, regexp_split_to_array(t, pat) AS g FROM docs, pats),
each AS (SELECT doc_id, ord, kind, least, head, unnest(m) AS x, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM hits WHERE len(m) > 0),
placed AS (SELECT *, CAST(sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS BIGINT) AS e FROM each),
kept AS (SELECT doc_id, ord, kind, e - length(x) AS s, e FROM placed WHERE length(CASE WHEN head = '' THEN x ELSE regexp_replace(x, head, '') END) >= least),
shown AS (SELECT doc_id, ord, kind, s, kind || ':' || CAST(s AS STRING) || ':' || CAST(e AS STRING) AS v FROM kept)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(v, ',' ORDER BY s, ord) FILTER (WHERE ord < 3), '')) AS base_sha256, coalesce(string_agg(v, ',' ORDER BY s, ord), '') AS spans
FROM docs d LEFT JOIN shown k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""


#: Shingles as strings, pairs that share one and are of like size, and the smallest id reached.
OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT s.doc_id, n.n, unnest(s.s) AS g FROM s JOIN n ON s.doc_id = n.doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT both_.b, r.c FROM r JOIN both_ ON both_.a = r.doc_id WHERE r.c < both_.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
