"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the largest cosine is the smallest
distance. A table has M hashes ``floor((a.x + b) / w)`` with Gaussian a. For a
query, the chance that a neighbour at distance r lies in a bucket is the product
of M normal probabilities; each table's buckets are visited by falling chance,
the query's own and its perturbations, until the visited chance, empty buckets
counted, reaches the table's target.

A bucket is a key: rows go to their bucket of each table, queries to those that
they visit, and only they meet, scored by exact cosine. Each bucket's k best of
a query go on; the tables' candidates are merged and ranked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import mix64
from .store import shared, sized, spread_join, written
from .vectors import HELD_BYTES, against, blocks_of, few_of_each, usable

#: Rows of a bucket, and visits to it, that meet in one task's hands at once; more are dealt to several.
ROWS, VISITS = 256, 2048


@dataclass(frozen=True)
class Plan:
    """tables x hashes; ``near``: the neighbour distance to find; ``width`` of a
    hash's cells; ``success``: the chance to find a neighbour in any table."""

    tables: int = 4
    hashes: int = 2
    near: float = 1.0
    width: float = 1.0
    success: float = 0.97
    seed: int = 7


def plan_for(vectors: DataFrame, k: int, sample: int = 2000, **how) -> Plan:
    """``near`` from a bounded sample: the ``sample`` rows with the smallest hash
    of their id. It is the 80th percentile of the distance to the k-th neighbour
    within the sample, which only exceeds that among all rows. Hashes are as many
    as make buckets of some 256 rows, at about five cells a hash."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    width = max((len(r["v"]) for r in rows), default=0)
    x = np.array([r["v"] for r in rows if len(r["v"]) == width], float).reshape(-1, max(width, 1))
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = 1.0
    if len(x) > k:
        away = np.sqrt(np.maximum(0, 2 - 2 * (x[:200] @ x.T)))
        near = float(max(1e-3, np.quantile(np.sort(away, axis=1)[:, k], 0.8)))
    many = int(np.ceil(np.log(max(1.0, vectors.count() / 256)) / np.log(5)))
    return Plan(**{"near": near, "width": 0.8 * near, "hashes": max(1, many)} | how)


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-3: it only orders buckets."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.070566 * x**3, -60, 60)))


class Hashes:
    """The tables' hash functions, and which buckets a query visits."""

    def __init__(self, plan: Plan, dim: int):
        rng = np.random.default_rng([plan.seed, dim])
        self.plan, self.dim = plan, dim
        self.a = rng.standard_normal((plan.tables, plan.hashes, dim))
        self.b = rng.uniform(0, plan.width, (plan.tables, plan.hashes))
        # cells on each side of a query's own that hold all but a thousandth of its chance
        self.side = int(np.ceil(3.2 * plan.near / plan.width))
        self.odd = mix64(np.arange(1, plan.hashes + 1, dtype=np.uint64) + np.uint64(plan.seed << 8)) | np.uint64(1)

    def key(self, table: int, code: np.ndarray) -> np.ndarray:
        """One number for each bucket (row of ``code``) of a table."""
        lead = np.uint64(self.dim * 1_000_003 + table)
        return mix64((code.astype(np.int64).view(np.uint64) * self.odd).sum(axis=-1, dtype=np.uint64) + mix64(np.array([lead]))).view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table (tables x vectors)."""
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.stack([self.key(t, np.floor((unit @ a.T + b) / self.plan.width)) for t, (a, b) in enumerate(zip(self.a, self.b, strict=True))])

    def visits(self, q: np.ndarray) -> np.ndarray:
        """The buckets that a query visits in any table, by falling chance in each."""
        plan = self.plan
        q = q / np.sqrt((q * q).sum())
        target = 1 - (1 - plan.success) ** (1 / plan.tables)
        at = self.a @ q + self.b
        low = np.floor(at / plan.width) - self.side
        edge = (low[..., None] + np.arange(2 * self.side + 2)) * plan.width - at[..., None]
        chance = np.diff(_normal(edge / plan.near), axis=-1)
        return np.concatenate([self.key(t, low[t] + np.array(best_first(chance[t], target))) for t in range(plan.tables)])


def best_first(chance: np.ndarray, target: float) -> list[list[int]]:
    """Cells (one place for each hash) by falling product of their chances, until
    these reach the target. From a cell one goes to the next likely place of one
    hash, never of a hash before the last one moved, so that none comes twice."""
    order = np.argsort(-chance, axis=1, kind="stable")
    ranked = np.take_along_axis(chance, order, axis=1).tolist()
    first = 1.0
    for row in ranked:
        first *= row[0]
    heap, out, total = [(-first, (0,) * len(ranked), 0)], [], 0.0
    while heap and total < target:
        p, at, last = heapq.heappop(heap)
        out.append([int(order[h, i]) for h, i in enumerate(at)])
        total -= p
        for h in range(last, len(at)):
            i = at[h] + 1
            if i < len(ranked[h]) and ranked[h][i] > 0:
                heapq.heappush(heap, (p / ranked[h][at[h]] * ranked[h][i], (*at[:h], i, *at[h + 1 :]), h))
    return out


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a batch's rows of each dimension."""
    size = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield at, batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def _filed(plan: Plan, names: list[str]):
    """Each row once for each table, with its bucket's key in ``cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Hashes] = {}
        for batch in batches:
            for at, x in _by_dim(batch):
                cells = known.setdefault(x.shape[1], Hashes(plan, x.shape[1])).buckets(x)
                rows = batch.take(pa.array(np.tile(at, len(cells))))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *(rows.column(n) for n in names)], names=["cell", *names])

    return run


def _visited(plan: Plan):
    """Each query's id once for each bucket that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Hashes] = {}
        for batch in batches:
            for at, x in _by_dim(batch):
                hashes = known.setdefault(x.shape[1], Hashes(plan, x.shape[1]))
                ids = batch.column("id").to_numpy(zero_copy_only=False)[at]
                for i, q in zip(ids, x, strict=True):
                    cells = hashes.visits(q)
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(cells), i))], names=["cell", "id"])

    return run


class Block:
    """Rows that queries are scored against."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.ids, self.rows, self.x = ids, rows, x
        self.size = np.sqrt((x * x).sum(axis=1))
        self.unit = x / self.size[:, None]

    def best(self, q_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of places of queries and rows, and their exact cosines: for each
        query its k best (more on ties) of at least ``least``, but rows of its
        own id. A matrix product leaves those within rounding."""
        size = np.sqrt((q * q).sum(axis=1))
        rough = (q / size[:, None]) @ self.unit.T
        rough[q_ids[:, None] == self.ids[None, :]] = -9.0
        if len(self.ids) > k:
            least = np.maximum(least, np.partition(rough, len(self.ids) - k, axis=1)[:, len(self.ids) - k])
        i, j = np.nonzero(rough >= np.maximum(least, -2.0)[:, None] - 1e-9)
        return i, j, (self.x[j] * q[i]).sum(axis=1) / (self.size[j] * size[i])


FOUND = "query_id long, vec_id long, row long, score double"


def _met(k: int, tables: int, queries):
    """Rows come by bucket and part, a bucket's rows before the queries that visit
    it. queries: for each dimension the ids, ascending, and vectors of all queries,
    or None where each visit brings its own. A query's best scores so far in the
    task bound what goes on; as a row may come once a table, k times as many are kept."""
    cells = ("cell", "rows_part", "visits_part", "asks")

    def asked(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = part.column("id").to_numpy(zero_copy_only=False)
        if queries is None:
            yield from ((ids[at], x) for at, x in _by_dim(part))
            return
        for all_ids, x in queries.value.values():
            at = np.searchsorted(all_ids, ids).clip(0, len(all_ids) - 1)
            here = all_ids[at] == ids
            if here.any():
                yield ids[here], x[at[here]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, blocks = None, [], {}
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in cells], axis=1)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part, now = batch.slice(a, b - a), tuple(keys[a, :3].tolist())
                if now != key:
                    key, held, blocks = now, [], {}
                if not keys[a, 3]:
                    ids, rows = (part.column(n).to_numpy(zero_copy_only=False) for n in ("id", "row"))
                    held += [(ids[at], rows[at], x) for at, x in _by_dim(part)]
                    continue
                if not blocks:
                    for dim in {x.shape[1] for _, _, x in held}:
                        blocks[dim] = Block(*(np.concatenate(c) for c in zip(*(h for h in held if h[2].shape[1] == dim), strict=True)))
                for ids, q in asked(part):
                    block = blocks.get(q.shape[1])
                    if block is None:
                        continue
                    least = np.array([known[i][0] if i in known else -2.0 for i in ids.tolist()])
                    i, j, score = block.best(ids, q, k, least)
                    for at in np.unique(i).tolist():
                        old = known.get(int(ids[at]), np.full(k * tables, -2.0))
                        known[int(ids[at])] = np.sort(np.concatenate([old, score[i == at]]))[-k * tables :]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[i], block.ids[j], block.rows[j], score)], names=["query_id", "vec_id", "row", "score"])

    return run


class _Whole:
    """Every row of a block, for queries whose buckets hold too few."""

    whole = False

    def __init__(self, k: int):
        self.k = k

    def __call__(self, chunks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x, _, of in blocks_of(batches, chunks):
                block = Block(ids, ids, x)
                for q_ids, q in of:
                    i, j, score = block.best(q_ids, q, self.k, np.full(len(q_ids), -2.0))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_ids[i], ids[j], score)], names=["query_id", "vec_id", "score"])

        return run


def _cells(filed: DataFrame, visits: DataFrame) -> DataFrame:
    """Buckets with rows and visits: how many, and into how many parts they are dealt."""
    held = filed.groupBy("cell").agg(F.count("*").alias("rows"))
    asked = visits.groupBy("cell").agg(F.count("*").alias("visits"))
    return written(held.join(asked, "cell").select("cell", "rows", "visits", F.ceil(F.col("rows") / ROWS).cast("int").alias("rows_parts"), F.ceil(F.col("visits") / VISITS).cast("int").alias("visits_parts")), "cells")


def _prepared(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, plan: Plan | None):
    some = F.exists("v", lambda x: x != 0)
    vectors = usable(rows, id_col, vector_col).filter(some)
    asked = usable(queries, id_col, vector_col).filter(some).dropDuplicates(["id"])
    plan = plan or plan_for(vectors, k)
    kept = few_of_each(vectors, k + 1)
    kept = written(kept.select("id", F.xxhash64("v", "id", "copy").alias("row"), "v"), "vectors")
    asked = written(asked, "asked")
    visits = written(asked.mapInArrow(_visited(plan), "cell long, id long"), "visits")
    cells = _cells(kept.mapInArrow(_filed(plan, []), "cell long"), visits)
    return kept, asked, plan, visits, cells


def scored_share(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", plan: Plan | None = None) -> DataFrame:
    """share: pairs that ``neighbours`` scores, once for each table they meet in,
    to all pairs of queries and rows."""
    kept, asked, _, _, cells = _prepared(rows, queries, k, id_col, vector_col, plan)
    pairs = cells.agg(F.coalesce(F.sum(F.col("rows") * F.col("visits")), F.lit(0)).alias("met"))
    return pairs.select((F.col("met") / F.lit(float(max(1, kept.count() * asked.count())))).alias("share"))


def _ranked(met: DataFrame, k: int, tables: int) -> DataFrame:
    """Each query's k best. A row that it meets in several tables comes with the same score each time."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    few = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k * tables).drop("rank").dropDuplicates(["query_id", "row"])
    return few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", plan: Plan | None = None) -> DataFrame:
    """Each query's ``k`` nearest rows found, by the largest cosine; ties to the smaller id.

    Returns query_id, rank (from 1), vec_id, score (the cosine of the original
    vectors). Every row is in every table. Buckets have no cap: one with more
    than ``ROWS`` rows or ``VISITS`` visits is dealt to several tasks. Vectors
    that are null, empty or zero or hold null or non-finite components, and rows
    without an id, take no part; vectors of another dimension are no candidates;
    rows that repeat a query's id count as its own, and queries that repeat are
    asked once. A query whose buckets hold fewer than ``k`` rows is asked against
    all rows. Empty tables give no rows.
    """
    kept, asked, plan, visits, cells = _prepared(rows, queries, k, id_col, vector_col, plan)
    filed = kept.mapInArrow(_filed(plan, ["id", "row", "v"]), "cell long, id long, row long, v array<double>")
    here = spread_join(filed, cells, "cell", "rows").select("cell", F.pmod(F.xxhash64("row"), "rows_parts").cast("int").alias("rows_part"), F.explode(F.sequence(F.lit(0), F.col("visits_parts") - 1)).alias("visits_part"), F.lit(0).alias("asks"), "id", "row", "v")
    there = spread_join(visits, cells, "cell", "visits").select("cell", F.explode(F.sequence(F.lit(0), F.col("rows_parts") - 1)).alias("rows_part"), F.pmod(F.xxhash64("id"), "visits_parts").cast("int").alias("visits_part"), F.lit(1).alias("asks"), "id", F.lit(0).cast("long").alias("row"))
    size = asked.agg(F.sum(F.size("v") * 8)).head()[0] or 0
    of: dict[int, tuple] = {}
    if size <= HELD_BYTES:  # tasks hold all queries; of more, each visit brings its own
        by_dim: dict[int, list] = {}
        for r in asked.orderBy("id").collect():
            by_dim.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
        of = {d: (np.array([i for i, _ in v], np.int64), np.array([x for _, x in v], float)) for d, v in by_dim.items()}
        there = there.withColumn("v", F.lit(None).cast("array<double>"))
    else:
        there = there.join(asked, "id").select(*there.columns, "v")
    at = ("cell", "rows_part", "visits_part")
    dealt = here.unionByName(there).repartition(*at).sortWithinPartitions(*at, "asks")
    with shared(kept.sparkSession, of) as held:
        ranked = written(_ranked(dealt.mapInArrow(_met(k, plan.tables, held if size <= HELD_BYTES else None), FOUND), k, plan.tables), "ranked")
    full = ranked.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = written(asked.join(sized(full), "id", "left_anti"), "short")
    if short.limit(1).count() == 0:
        return ranked
    rest = against(kept.select("id", "v"), short, _Whole(k), k)
    return ranked.join(sized(short.select(F.col("id").alias("query_id"))), "query_id", "left_anti").unionByName(rest)
