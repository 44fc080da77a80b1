"""Vector searches: buckets as keys, whole searches in groups of queries."""

import numpy as np
import pytest

import umbra.llm.neighbours as near
import umbra.llm.vectors as vectors
from umbra.llm.neighbours import best_first, neighbours, scored_share
from umbra.llm.topk import top_k


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((60, 24)), 50, axis=0) + 0.15 * rng.standard_normal((3000, 24))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def test_buckets_prune(clustered):
    """Few pairs of clustered vectors are scored, and nearly all neighbours found."""
    x, df = clustered
    asked = df.filter("vec_id % 30 = 0")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = neighbours(df, asked).collect()
    least = {q: np.sort(np.delete(unit @ unit[q], q))[-5] for q in range(0, 3000, 30)}
    assert len(got) == 500 and np.mean([r["score"] >= least[r["query_id"]] - 1e-9 for r in got]) >= 0.9
    assert scored_share(df, asked).head()["share"] < 0.25


def test_parts_and_queries_of_their_own(clustered, monkeypatch):
    """Buckets dealt to several tasks, and visits that bring their query, find the same."""
    _, df = clustered
    asked = df.filter("vec_id % 100 = 0")
    want = sorted(map(tuple, neighbours(df, asked).collect()))
    monkeypatch.setattr(near, "ROWS", 16)
    monkeypatch.setattr(near, "VISITS", 2)
    monkeypatch.setattr(near, "HELD_BYTES", 0)
    assert sorted(map(tuple, neighbours(df, asked).collect())) == want


def test_groups_of_queries(clustered, monkeypatch):
    """Queries asked in several groups get the same rows as at once."""
    _, df = clustered
    asked = df.filter("vec_id % 20 = 0")
    want = sorted(map(tuple, top_k(df, asked).collect()))
    monkeypatch.setattr(vectors, "HELD_BYTES", 1)
    monkeypatch.setattr(vectors, "CHUNK", 40)
    assert sorted(map(tuple, top_k(df, asked).collect())) == want and len(want) == 750


def test_few_rows(spark):
    """Fewer rows than asked for, far apart, of several dimensions, with clashing names."""
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, -1.0]), (50, [0.0, 1.0]), (100, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "v", "dim", "block", "cell", "row", "rank", "score", "copy", "ids"):
        df = df.selectExpr("*", f"'x' AS {name}")
    asked = df.filter("vec_id % 50 = 0")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours(df, asked).collect())
    assert got == [(0, 1, 2), (0, 2, 50), (0, 3, 1), (50, 1, 0), (50, 2, 1), (50, 3, 2), (100, 1, 7)]
    assert sorted((r["query_id"], r["vec_id"]) for r in top_k(df, asked).collect()) == sorted((q, v) for q, _, v in got)


def test_best_first():
    """Cells by falling chance, each once, until the target."""
    chance = np.array([[0.2, 0.5, 0.3], [0.6, 0.1, 0.3]])
    cells = best_first(chance, 0.999999)
    p = [chance[0, a] * chance[1, b] for a, b in cells]
    assert len({tuple(c) for c in cells}) == 9 and all(a >= b - 1e-12 for a, b in zip(p, p[1:])) and best_first(chance, 0.2) == [[1, 0]]
