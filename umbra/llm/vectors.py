"""A query set against all vectors, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import shared, written

BLOCK, CHUNK = 1024, 2048
#: Bytes of queries that tasks hold at once; more are asked in turn, group by group.
HELD_BYTES = 32 << 20

SCHEMA = "dim int, block int, ids binary, data binary"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (doubles) of rows whose id isn't null and whose vector has only finite components."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite)


def few_of_each(vectors: DataFrame, most: int) -> DataFrame:
    """Of identical vectors the ``most`` smallest ids, each id that repeats up to
    ``most`` times. With one more than k, no query's k best (ties to smaller
    ids, rows of its own id left out) can change. Copies are counted before
    anything is shuffled by vector."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    each = vectors.groupBy("v", "id").agg(F.count("*").alias("copies")).withColumn("rank", rank).filter(F.col("rank") <= most)
    copies = F.sequence(F.lit(1), F.least("copies", F.lit(most)).cast("int"))
    return each.select("id", "v", F.explode(copies).alias("copy"))


def _pack(table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    data = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
    return pa.table(
        {
            "dim": pa.array([data.shape[1]], pa.int32()),
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            "ids": pa.array([ids[order].tobytes()], pa.binary()),
            "data": pa.array([np.ascontiguousarray(data).tobytes()], pa.binary()),
        }
    )


def in_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of about ``size`` vectors of one dimension each, dealt by the id's hash."""
    vectors = written(vectors, "vectors")
    many = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")})
    return dealt.groupBy("dim", "block").applyInArrow(_pack, SCHEMA)


def against(candidates: DataFrame, asked: DataFrame, search, k: int) -> DataFrame:
    """Runs ``search`` on each block of candidates with all queries of its dimension
    and keeps each query's ``k`` best: query_id, rank, vec_id, score.

    Queries are broadcast in groups of at most ``HELD_BYTES``; a group's blocks
    go through its tasks one by one, and only each block's k best of a query are
    shuffled. Neither pairs nor vectors are. search(chunks): a function of
    batches (ids, data) to batches (query_id, vec_id, score); chunks: for each
    dimension a list of (ids, data).
    """
    spark = candidates.sparkSession
    score = "long" if search.whole else "double"
    blocks = written(in_blocks(candidates, BLOCK), "blocks")
    chunks = written(in_blocks(asked, CHUNK), "chunks")
    sizes = chunks.select("dim", "block", F.octet_length("data").alias("bytes")).orderBy("dim", "block").collect()  # one row for 2048 queries
    groups, held = [[]], 0
    for r in sizes:
        if held and held + r["bytes"] > HELD_BYTES:
            groups.append([])
            held = 0
        groups[-1].append((r["dim"], r["block"]))
        held += r["bytes"]
    tasks = max(1, blocks.count() // 8)  # a task's later blocks start from the scores of its earlier ones
    found = None
    for group in groups:
        few = spark.createDataFrame(group, "dim int, block int")
        of: dict[int, list] = {}
        for r in chunks.join(F.broadcast(few), ["dim", "block"], "left_semi").orderBy("dim", "block").collect():
            of.setdefault(r["dim"], []).append((np.frombuffer(bytes(r["ids"]), np.int64), np.frombuffer(bytes(r["data"])).reshape(-1, r["dim"])))
        with shared(spark, of) as chunks_of:
            best = blocks.repartition(tasks).select("ids", "data").mapInArrow(search(chunks_of), f"query_id long, vec_id long, score {score}")
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            best = written(best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")
        found = best if found is None else found.unionByName(best)
    return found


def blocks_of(batches, chunks) -> Iterator[tuple[np.ndarray, np.ndarray, int, list]]:
    """ids, vectors, dimension and queries of each block that has any."""
    for batch in batches:
        for ids, data in zip(batch.column("ids"), batch.column("data"), strict=True):
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            x = np.frombuffer(data.as_buffer()).reshape(len(ids), -1)
            if x.shape[1] in chunks.value:
                yield ids, x, x.shape[1], chunks.value[x.shape[1]]
