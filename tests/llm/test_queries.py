"""The registered queries on whole small tables, against plain Python."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from umbra.llm import queries
from umbra.llm.jaccard import one_of_each, similarity_classes
from umbra.llm.lines import line_dedup
from umbra.llm.mixing import mix
from umbra.llm.neighbours import neighbours
from umbra.llm.packing import pack
from umbra.llm.quality import fit, held_out, score
from umbra.llm.secrets import find_secrets
from umbra.llm.topk import top_k

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark, texts):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    seen = {}
    for t in texts.values():
        for k in {key(x) for x in t.split("\n")} - {""}:
            seen[k] = seen.get(k, 0) + 1
    want = {}
    for d, t in texts.items():
        lines = t.split("\n")
        kept = [x for x in lines if seen.get(key(x), 0) < 10]
        want[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op1_lines(spark, SF).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_op3(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op3_quality(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    right = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(right) >= 0.85


def test_op9(spark, texts):
    kinds = {"assign": (r"""(?:(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 12), "access": ("(AKIA[A-Z0-9]+)", 18), "hex": ("([0-9a-f]+)", 16)}
    rows = {r["doc_id"]: r for r in queries.op9_secrets(spark, SF).collect()}
    assert set(rows) == set(texts)
    for d, t in texts.items():
        spans, many = [], {}
        for i, (kind, (pattern, least)) in enumerate(kinds.items()):
            own = [(m.start(), i, kind, m.end()) for m in re.finditer(pattern, t, re.A) if len(m[1]) >= least]
            many[kind] = len(own)
            spans += own
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        r = rows[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (many["assign"], many["access"], many["hex"], hashlib.sha256(text.encode()).hexdigest())


def test_op8(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"]}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items() if np.linalg.norm(v) > 0}
    rows = queries.op8_neighbours(spark, SF).collect()
    hit = 0
    for r in rows:
        best = sorted((-float(unit[r["query_id"]] @ v), i) for i, v in unit.items() if i != r["query_id"])[:5]
        hit += -r["score"] <= best[-1][0] + 1e-9
        assert abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-9
    assert len(rows) == 5 * sum(i % 50 == 0 for i in unit) and hit / len(rows) >= 0.9


def test_empty_tables(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(0)
    trees = fit(docs, spark.read.parquet(f"{SF}/labels.parquet").limit(0))
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (line_dedup(docs), score(docs, trees), similarity_classes(docs), one_of_each(docs), find_secrets(docs), mix(docs, max_repeats=2.0), pack(docs, path), top_k(vectors, vectors), neighbours(vectors, vectors)):
        assert df.count() == 0


def test_clashing_names_and_repeated_rows(spark):
    """Columns named as the operators' own, null ids, sources and texts, and rows that repeat."""
    import public_tokenizers

    names = ("n_lines", "n_dropped", "score", "predicted", "tokens", "copy", "place", "secrets", "component_id", "n_shingles", "queue", "mix_id", "key", "docs", "h", "n", "part", "repeated", "text_md5")
    rows = [(i, t, s, *range(len(names))) for i, t, s in ((1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, None, None), (3, "", "y"), (4, "A B c d e", None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    trees = fit(docs, spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None)], "doc_id long, quality int"))
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (line_dedup(docs, min_docs=2), score(docs, trees), find_secrets(docs), mix(docs, max_repeats=1.0)):
        assert df.count() == len(rows) and len(df.columns) == len(set(df.columns))
    assert pack(docs, path).filter("start = 0").count() == len(rows)
    assert docs.filter(held_out()).count() <= len(rows)
    classes = similarity_classes(docs, width=4, percent=85).collect()
    assert {r["component_id"] for r in classes if r["doc_id"] in (1, 4)} == {1}
    assert one_of_each(docs, width=4, percent=85).filter("doc_id in (1, 4)").select("doc_id").distinct().count() == 1
