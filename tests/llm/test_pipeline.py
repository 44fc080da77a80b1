"""The corpus pipeline on the smallest tables, stage by stage."""

import os
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again as the next one's input."""
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        out[name] = docs = spark.read.parquet(f"{at}/{name}")
    return out


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_columns(stages):
    for name in ("quality", "lines", "near_copies", "mixing"):
        assert set(stages[name].columns) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_quality_keeps_good_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages["quality"].collect()}
    good = [d in kept for d, q in labels.items() if q == 1]
    bad = [d in kept for d, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.2


def test_lines_stay_once(stages):
    """A line of ten documents or more is left in one of them."""
    before, after = {}, {}
    for name, count in (("quality", before), ("lines", after)):
        for r in stages[name].collect():
            for key in {x.strip(" \t\n\x0b\x0c\r").lower() for x in (r["text"] or "").split("\n")} - {""}:
                count[key] = count.get(key, 0) + 1
    common = [k for k, n in before.items() if n >= 10]
    assert common and all(after.get(k, 0) <= 1 for k in common)


def test_one_of_each_class(stages):
    """Brute force: each class of linked documents leaves one, others stay."""
    docs = {r["doc_id"]: _shingles(r["text"]) for r in stages["lines"].collect()}
    up = {d: d for d in docs}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if docs[a] and docs[b] and 100 * len(docs[a] & docs[b]) >= 80 * len(docs[a] | docs[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    kept = [r["doc_id"] for r in stages["near_copies"].collect()]
    assert len(kept) == len(set(kept)) and sorted(top(d) for d in kept) == sorted({top(d) for d in ids})


def test_mixing_uses_every_document(stages):
    before = {r["doc_id"] for r in stages["near_copies"].collect()}
    rows = [r["doc_id"] for r in stages["mixing"].collect()]
    assert set(rows) == before and max(rows.count(d) for d in before) <= 2


def test_pieces_fill_windows(stages):
    rows = stages["packing"].orderBy("sequence_id", "offset").collect()
    at = 0
    for r in rows:
        assert r["sequence_id"] * 1024 + r["offset"] == at and r["length"] > 0
        at += r["length"]
    copies = {}
    for r in stages["mixing"].collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    tokens = {}
    for r in rows:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {r["doc_id"]: r["doc_tokens"] * copies[r["doc_id"]] for r in rows}
