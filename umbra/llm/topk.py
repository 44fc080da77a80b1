"""Exact top-k by aggregation without random access (NRA).

Within a block every dimension is a list sorted by value. A query reads its
lists in step from their better ends. What is read gives each vector a lower
and an upper score; reading stops when no vector that is unread, or whose upper
score is too low, can be among the k best. The few that remain are then scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import against, blocks_of, few_of_each, usable

#: Parts of the lists that may be read before bounds are compared.
DEPTHS = (0.2, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 0.9, 1.0)


class Lists:
    """A block's vectors and their lists: [0] from the highest value, [1] from the lowest."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        order = np.argsort(-x, axis=0, kind="stable").T
        values = np.take_along_axis(x, order.T, axis=0).T
        self.order = np.stack([order, order[:, ::-1]])
        self.values = np.stack([values, values[:, ::-1]])
        self.depths = np.unique(np.ceil(np.array(DEPTHS) * len(ids)).astype(np.int64))

    def search(self, q: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of all that may be among the k best, and the depth
        read. least: the k-th best score known from elsewhere, a lower bound of
        this block's k best. Each list gives its values in order; what it has not
        given yet is at most the last value given."""
        n, use = len(self.ids), np.flatnonzero(q)
        if n <= 4 * k or not len(use):
            at = np.flatnonzero(self.ids != own)
            return at, self.x[at] @ q, n
        way, w = (q[use] < 0).astype(np.int64), q[use][:, None]
        edges = self.values[way[:, None], use[:, None], self.depths - 1] * w
        most, worst, bound = edges.sum(axis=0), edges[:, -1:], least
        enough = lambda: int(np.argmax(np.append(most[:-1] < bound, True)))  # noqa: E731 - no vector that isn't given yet can qualify from here on
        step = enough() if np.isfinite(least) else len(most) // 2
        while True:
            depth = int(self.depths[step])
            order, parts = self.order[way, use, :depth], self.values[way, use, :depth] * w
            if most[step] >= bound and depth < n:  # what was read tells more by lower bounds
                lower = worst.sum() + np.bincount(order.ravel(), (parts - worst).ravel(), n)
                bound = max(least, np.partition(np.where(self.ids == own, -np.inf, lower), n - k)[n - k])
                if most[step] >= bound:
                    step = max(step + 1, enough())
                    continue
            edge = edges[:, step : step + 1]
            upper = most[step] + np.bincount(order.ravel(), (parts - edge).ravel(), n)
            may = np.flatnonzero((upper >= bound) & (self.ids != own))
            return may, self.x[may] @ q, depth


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort([ids, -scores])[:k]


class _Search:
    whole = True

    def __init__(self, k: int):
        self.k = k

    def __call__(self, chunks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[tuple[int, int], np.ndarray] = {}  # each query's best scores so far in this task, by its chunk
            for ids, x, dim, of in blocks_of(batches, chunks):
                x = np.floor(256.0 * x)
                lists, top = None, np.abs(x).max(initial=0)
                for c, (q_ids, asked) in enumerate(of):
                    asked = np.floor(256.0 * asked)
                    if top * np.abs(asked).max(initial=0) * dim >= 2.0**53:  # too large for exact doubles
                        yield _batch([self.exact(ids, x, q, own) for q, own in zip(asked, q_ids.tolist(), strict=True)])
                        continue
                    lists = lists or Lists(ids, x)
                    best = known.setdefault((dim, c), np.full((len(q_ids), self.k), -np.inf))
                    out = []
                    for i, own in enumerate(q_ids.tolist()):
                        at, scores, _ = lists.search(asked[i], own, self.k, best[i].min())
                        most = _best(ids[at], scores, self.k)
                        best[i] = -np.sort(-np.concatenate([best[i], scores[most]]))[: self.k]
                        out.append((own, ids[at[most]], scores[most]))
                    yield _batch(out)

        return run

    def exact(self, ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int):
        """By whole numbers of any size."""
        at, whole = np.flatnonzero(ids != own), [int(v) for v in q]
        scores = [sum(int(v) * w for v, w in zip(row, whole, strict=True)) for row in x[at].tolist()]
        most = sorted(range(len(at)), key=lambda j: (-scores[j], ids[at[j]]))[: self.k]
        return own, ids[at[most]], np.array([scores[j] for j in most], np.int64)


def _batch(rows: list) -> pa.RecordBatch:
    columns = ([np.full(len(ids), own, np.int64) for own, ids, _ in rows], [ids for _, ids, _ in rows], [scores.astype(np.int64) for _, _, scores in rows])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products over all rows but its
    own, ties to the smaller id; components are ``floor(256 * x)``.

    Returns query_id, rank (from 1), vec_id, score; fewer than ``k`` if there
    are fewer rows. Vectors that are null or empty or hold null or non-finite
    components, and rows without an id, take no part; vectors of another
    dimension are no candidates; rows that repeat a query's id count as its own,
    and queries that repeat are asked once. Scores must fit 64 bits. Empty
    tables give no rows.
    """
    vectors = usable(rows, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).dropDuplicates(["id"])
    return against(few_of_each(vectors, k + 1).select("id", "v"), asked, _Search(k), k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
