"""Token counts by a separator scan over flat token files.

A flat file is a run of ids in blocks of one size, without an index; documents
end with a separator id and may cross blocks. Every block is searched for
separators at once; a prefix scan over the blocks' sums then stitches documents
that cross boundaries and numbers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import tidy
from .store import sized, written
from .tokens import ids_of

FLAT = "file int, block int, ids binary, first long, docs array<long>"


def _flat(path: str, end_id: int, block: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, held, size, number, first = ids_of(path, True), TaskContext.get().partitionId(), [], 0, 0, 0
        end = np.array([end_id], encode.dtype)

        def row(blocks, docs=None):
            k = len(blocks)
            more = [] if docs is None else [docs]
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * (k + len(more)), pa.int32()), pa.array([*range(number, number + k), *(None for _ in more)], pa.int32()), pa.array([*(b.tobytes() for b in blocks), *(None for _ in more)], pa.binary()), pa.array([*(None for _ in blocks), *(first for _ in more)], pa.int64()), pa.array([*(None for _ in blocks), *more], pa.list_(pa.int64()))],
                names=["file", "block", "ids", "first", "docs"],
            )

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for text in batch.column(1):
                held += [encode(text.as_py()), end]
                size += len(held[-2]) + 1
                if size >= 16 * block:
                    run_ = np.concatenate(held)
                    cut = len(run_) // block
                    yield row([run_[i * block : (i + 1) * block] for i in range(cut)])
                    number += cut
                    held, size = [run_[cut * block :]], len(run_) - cut * block
            yield row([], docs)
            first += len(docs)
        if size:
            run_ = np.concatenate(held)
            yield row([run_[i : i + block] for i in range(0, len(run_), block)])

    return run


def flat_files(docs: DataFrame, tokenizer: str, end_id: int, block: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """Writes texts as flat token files, one for each task, to the shared folder.

    Returns the files (file, block, ids as little-endian unsigned numbers) and
    which documents went into them in which order (file, ordinal, doc_id). A
    special token's string in a text is ordinary text, so that only ends of
    documents are separators. Null text is a document without ids.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = written(named.mapInArrow(_flat(tokenizer, end_id, block), FLAT), "flat")
    order = kept.filter("docs is not null").select("file", "first", F.posexplode("docs").alias("i", "doc_id"))
    return kept.filter("ids is not null").select("file", "block", "ids"), order.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")


def _scan(end_id: int, wide: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, many, last, after = [], [], [], []
            for v in batch.column("ids"):
                ids = np.frombuffer(v.as_buffer(), f"<u{wide}")
                at = np.flatnonzero(ids == end_id)
                size.append(len(ids))
                many.append(len(at))
                last.append(int(at[-1]) + 1 if len(at) else None)
                after.append((at + 1).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), *(pa.array(x, pa.int64()) for x in (size, many, last)), pa.array(after, pa.list_(pa.int64()))],
                names=["file", "block", "size", "many", "last", "after"],
            )

    return run


def count_tokens(files: DataFrame, end_id: int, wide: int = 2) -> DataFrame:
    """Documents of flat files and their ids, separators left out.

    files: file, block (in order, gaps allowed), ids (``wide`` bytes each).
    Returns file, ordinal (from 0 in its file), start (its first id's place in
    the file), n_tokens, ended (false for ids after a file's last separator).
    Empty documents count 0; null ids are an empty block; empty files give none.
    """
    cut = files.filter("ids is not null and octet_length(ids) > 0").mapInArrow(_scan(end_id, wide), "file int, block int, size long, many long, last long, after array<long>")
    scanned = written(cut, "blocks")
    sums = scanned.drop("after")  # a file's blocks meet in one task by these few numbers alone
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = sums.withColumns({"begin": F.coalesce(F.sum("size").over(before), F.lit(0)), "ordinal": F.coalesce(F.sum("many").over(before), F.lit(0))})
    # where the document that is open at a block's first id began
    open_ = written(begin.withColumn("open", F.coalesce(F.max(F.col("begin") + F.col("last")).over(before), F.lit(0))).select("file", "block", "ordinal", "begin", "open"), "open")
    open_ = scanned.select("file", "block", "many", "after").join(sized(open_), ["file", "block"])
    # a document begins after the separator before its own, the block's first one where it is open
    begins = F.when(F.col("many") > 0, F.concat(F.array("open"), F.transform(F.slice("after", F.lit(1), F.col("many").cast("int") - 1), lambda x: F.col("begin") + x)))
    each = open_.select("file", "ordinal", "begin", F.posexplode(F.arrays_zip(begins.alias("start"), F.col("after"))).alias("i", "at"))
    ended = each.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), F.col("at.start").alias("start"), (F.col("begin") + F.col("at.after") - 1 - F.col("at.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    total = sums.groupBy("file").agg(F.sum("size").alias("size"), F.sum("many").alias("ordinal"))
    ends = begin.groupBy("file").agg(F.coalesce(F.max(F.col("begin") + F.col("last")), F.lit(0)).alias("start"))
    rest = total.join(ends, "file").filter("size > start").select("file", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def document_tokens(docs: DataFrame, tokenizer: str, end_id: int, block: int = 1 << 16) -> DataFrame:
    """doc_id and n_tokens of every row, by way of flat files: file, ordinal,
    start and ended come along. Null and empty texts have 0 tokens; rows that repeat, in id or in
    all, are counted each; a null id is kept; other columns are ignored; an empty
    table gives no rows."""
    files, order = flat_files(docs, tokenizer, end_id, block)
    return count_tokens(files, end_id, ids_of(tokenizer).dtype.itemsize).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
