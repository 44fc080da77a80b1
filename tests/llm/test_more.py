"""Mixing played by hand, hostile texts, very long texts, odd rows through every stage."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from umbra.llm.mixing import mix
from umbra.llm.quality import fit, statistics
from umbra.llm.secrets import BASE, MORE, scanner
from umbra.llm.shingles import shingle_sets
from umbra.llm.warc import derivatives, files, parse, responses, serialise


@pytest.mark.parametrize("goal", [{"max_repeats": 3.0}, {"max_repeats": 1.5}, {"target_entropy": 0.95, "max_repeats": 8.0}, {"target_entropy": 0.1}, {"budget": 3000.0}])
def test_mixing_by_hand(spark, goal):
    """Bisected weights met to one document; each epoch a permutation of whole
    blocks; the last one a prefix of it."""
    rows = [(i, "w " * (1 + i % 13), ("big", "mid", "big", "small", "big")[i % 5] if i % 3 else "big") for i in range(900)]
    n = {}
    for _, t, s in rows:
        n[s] = n.get(s, 0) + len(t) // 2 + 1
    names, size = list(n), np.array(list(n.values()), float)

    def weights(a):
        w = np.exp(a * np.log(size))
        return w / w.sum()

    def meets(a):
        w = weights(a)
        all_ = goal.get("budget") or (size / w).max()
        low = -(w * np.log(w)).sum() <= goal.get("target_entropy", 9)
        return low and (w * all_ / size).max() <= goal.get("max_repeats", 1e9) * (1 + 1e-9)

    best = 1.0 if goal.keys() == {"budget"} else next((a for a in np.linspace(0, 1, 200_001) if meets(a)), 1.0)
    w = weights(best)
    part = dict(zip(names, w * (goal.get("budget") or (size / w).max()), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, block_docs=64, **goal).collect()
    for s in names:
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: r["place"])
        spent = sum(r["tokens"] for r in mine)
        assert -15 <= spent - part[s] <= 15
        assert [r["copy"] for r in mine] == sorted(r["copy"] for r in mine)
        own = {i for i, _, x in rows if x == s}
        for c in range(max(r["copy"] for r in mine) + 1):
            ids = [r["doc_id"] for r in mine if r["copy"] == c]
            assert len(ids) == len(set(ids)) and (set(ids) == own or c == mine[-1]["copy"])
            if c and set(ids) == own:
                assert ids != [r["doc_id"] for r in mine if r["copy"] == 0] or len(ids) < 65


def test_mixing_without_ids(spark):
    """Rows without an id have places of their own; none is lost."""
    docs = spark.createDataFrame([(None, f"w {i}", "s") for i in range(300)] + [(None, None, None)], "doc_id long, text string, source string")
    got = mix(docs, max_repeats=1.0, block_docs=16)
    assert got.count() == 301 and got.select("place").distinct().count() > 250


@pytest.mark.parametrize("text", ["eyJ" * 700_000 + ".eyJx", "token" + " " * 2_000_000, "token=x" * 300_000, "a" * 2_000_000, "AKIA" * 500_000, "-----BEGIN " + "A " * 1_000_000, "ghp_" * 500_000, "xoxb-" * 400_000, "sk_live_" * 250_000, "AIza" * 500_000])
def test_hostile_texts(text):
    """Time stays linear in texts that nearly match everywhere."""
    start = time.time()
    (found,) = scanner(BASE + MORE).batch([text])
    assert time.time() - start < 20 and len(found) <= 2


def test_secrets_brute():
    """All rules against regular expressions, over pieces of secrets put together at random."""
    rng = np.random.default_rng(4)
    pieces = ["token", "secret", "Api_Key", '"', "'", " ", ":", "=", "AKIA", "abcdef0123456789", "ABCDEFGH12345678", "ghp_", "x" * 36, "xoxb-", "eyJ", ".", ".eyJ", "sk_live_", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "\n", ",", "AIza", "_", "-"]
    rules = [(re.compile(f"({r.head})({r.tail}+)" if r.tail else f"({r.head})", re.A), r) for r in BASE + MORE]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 30))) for _ in range(600)]
    for text, found in zip(texts, scanner(BASE + MORE).batch(texts), strict=True):
        want = [(m.start(), m.end(), k) for k, (p, r) in enumerate(rules) for m in p.finditer(text) if len(m[m.lastindex] if r.of_tail else m[0]) >= r.least]
        assert found == sorted(want, key=lambda y: (y[0], y[2]))


def test_long_texts():
    """A text of many stretches, and a word longer than several, hash as their parts do."""
    words = [f"w{i % 977}" for i in range(300_000)]
    (whole,) = shingle_sets(pa.array([" ".join(words)]), 4)
    assert len(whole) == len({tuple(words[i : i + 4]) for i in range(977 + 4)} | {tuple(words[i : i + 4]) for i in range(len(words) - 977 * 2, len(words) - 3)})
    a, b, c = shingle_sets(pa.array(["x" * 1_000_000, "X" * 1_000_000, "x" * 999_999 + "y"]), 4)
    assert (a == b).all() and (a != c).all()
    assert np.isfinite(statistics(pa.array(["a b\n" * 500_000, "z" * 2_000_000]))).all()


def test_fit_uses_ids_once(spark):
    """An id of many rows is learned from once; labels of both kinds are used."""
    docs = spark.createDataFrame([(i % 40, f"{'good words here. ' * 5 if i % 2 else '$$ ## | ' * 9} {i}", "s") for i in range(4000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert len(fit(docs, labels, rounds=3).leaf) == 3


def test_records(spark):
    """Line breaks stay out of headers, cut files end early, derivatives name each other."""
    pages = spark.createDataFrame([(1, "http://h/\r\nX-Evil: 1", "<p>x")], "page_id long, url string, html string")
    made = derivatives(responses(pages))
    one, two = made.collect()
    assert one["concurrent_to"] == two["record_id"] and two["concurrent_to"] == one["record_id"]
    for r in files(made).collect():
        ((head, _),) = parse(bytes(r["warc"]))
        assert "X-Evil" not in head and "X-Evil: 1" in head["WARC-Target-URI"]
    data = serialise([("WARC-Type", "metadata")], b"abc")
    assert len(list(parse(data + data[:-6]))) == 1 and len(list(parse(data + data[:20]))) == 1
    assert files(made.limit(0)).count() == 0 and responses(pages.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, extra columns and empty tables through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    text = "the quick brown fox jumps over the lazy dog and runs away " * 3
    rows = [(1, text, "en", "a", 3, "x"), (1, text, "en", "a", 3, "x"), (None, None, None, None, None, None), (2, "", None, "b", 0, "x"), (4, text + " end", "en", None, 9, "x"), (5, "other words " * 40, "de", "b", 9, "x"), (None, text, "en", "a", 1, "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string")
    for docs in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != pipeline.STAGES[-1][0]:
                assert set(out.columns) == set(pipeline.COLUMNS)
            if docs is odd or not docs.limit(1).count():
                assert (out.count() == 0) == (docs.count() == 0 or name == "quality" and out.count() == 0)
    kept = pipeline.near_copies(spark, odd, str(tmp_path))
    assert kept.filter("doc_id = 4").count() == 0 and kept.filter("doc_id is null").count() == 2 and kept.filter(F.col("doc_id") == 1).count() == 2
