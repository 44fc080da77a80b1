"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. In each round, one round a window, a queue's
deficit grows by its share of the window and the queue serves as many whole
slots as the deficit holds; the rest is carried to the next round. Because
shares are whole numbers, what a queue has served by round r has a closed form,
so each slot's place in the packed stream follows from the queue's totals and
the slot's number alone: no task waits for another, and deficits carry across
windows and partitions exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import tidy
from .store import sized, written
from .tokens import ids_of

SHARES = 1 << 16


class Schedule:
    """Where each queue's slots go. Queues are ordered by share and total; rows
    of ``sizes`` are (share, total, queues that have both), in this order, so
    that what all queues before a place served is a prefix sum for each share."""

    def __init__(self, sizes: list[tuple[int, int, int]], window: int, slot: int):
        share, total, many = np.array(sizes, np.int64).reshape(-1, 3).T
        self.window, self.slot, self.all = window, slot, int((share * many).sum())
        self.classes = []
        for s in np.unique(share).tolist():
            at = share == s
            n, m = total[at], many[at]
            self.classes.append((s, int(many[share < s].sum()), n, np.append(0, np.cumsum(m)), np.append(0, np.cumsum(m * n))))

    def _due(self, share, rounds) -> np.ndarray:
        """Slots due by the end of a round."""
        return rounds * (self.window * share) // (self.all * self.slot)

    def place(self, queue: np.ndarray, share: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The place in the packed stream of the first token of each slot, for
        the queue's place in the order, its share and the slot's number."""
        rounds = -(-((number + 1) * (self.all * self.slot)) // (self.window * share))
        out = (number - self._due(share, rounds - 1)) * self.slot
        for s, start, n, queues, tokens in self.classes:

            def served(r, upto, s=s, n=n, queues=queues, tokens=tokens):
                """Tokens that the class's first ``upto`` queues served by the end of round r."""
                most = self._due(s, r) * self.slot
                k = np.searchsorted(n, most)  # sizes that are used up, as far as ``upto`` goes
                j = np.searchsorted(queues, upto, side="right") - 1
                low = np.minimum(k, j)
                size = n[np.minimum(low, len(n) - 1)]
                # the size that ``upto`` ends in is used up in part of its queues
                used = np.where(k > j, np.minimum(size, most), most)
                return tokens[low] + (upto - queues[low]) * used

            upto = np.clip(queue - start, 0, queues[-1])
            # the queue's own slots of earlier rounds are counted by the round before
            out += served(rounds - 1, np.broadcast_to(queues[-1], upto.shape)) + served(rounds, upto) - served(rounds - 1, upto)
        return out


def _tokens(path: str, end_id: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, sums = ids_of(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            queues, starts, counts, blobs = batch.column("queue").to_pylist(), [], [], []
            for queue, text in zip(queues, batch.column("text"), strict=True):
                ids = encode(text.as_py())
                blobs.append(np.append(ids, np.array([end_id], ids.dtype)).tobytes())
                starts.append(sums.get(queue, 0))
                counts.append(len(ids) + 1)
                sums[queue] = starts[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("queue"), pa.array([part] * len(blobs), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                names=["doc_id", "queue", "part", "at", "n", "ids"],
            )

    return run


def _pieces(schedule: Schedule, wide: int):
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot, window = schedule.slot, schedule.window
        queue, share = batch.column("place").to_numpy(), batch.column("share").to_numpy()
        begin = batch.column("base").to_numpy() + batch.column("at").to_numpy()
        count = batch.column("n").to_numpy()
        first, last = begin // slot, (begin + count - 1) // slot
        many = last - first + 1
        row = np.repeat(np.arange(len(batch)), many)
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[row]
        a = np.maximum(begin[row], number * slot)
        size = np.minimum(begin[row] + count[row], (number + 1) * slot) - a
        at = schedule.place(queue[row], share[row], number) + a - number * slot
        # a queue's slots that follow each other in the stream are one piece
        join = np.zeros(len(at), bool)
        join[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + size[:-1])
        lead = np.flatnonzero(~join)
        row, a, at, size = row[lead], a[lead], at[lead], np.add.reduceat(size, lead)
        # and are cut where a window ends
        spans = (at + size - 1) // window - at // window + 1
        k = np.repeat(np.arange(len(at)), spans)
        turn = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        low = np.maximum(at[k], (at[k] // window + turn) * window)
        high = np.minimum(at[k] + size[k], (at[k] // window + turn + 1) * window)
        row, start = row[k], a[k] - begin[row[k]] + low - at[k]
        blobs = [np.frombuffer(x.as_buffer(), f"<u{wide}").astype("<u4") for x in batch.column("ids")]
        ids = [blobs[r][s : s + n].tobytes() for r, s, n in zip(row.tolist(), start.tolist(), (high - low).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), batch.column("queue").take(pa.array(row)), pa.array(start), pa.array(high - low), pa.array(ids, pa.binary()), pa.array(count[row]), pa.array(low // window), pa.array(low % window)],
            names=["doc_id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                yield cut(batch.slice(a, 500))

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 1024,
    slot: int = 128,
    target: Mapping[str, float] | None = None,
    end_id: int = 0,
) -> DataFrame:
    """Packs whole documents into windows that follow the sources' target shares.

    docs: doc_id, text, source; further columns are ignored. A document is its
    ids and ``end_id``; null or empty text is ``end_id`` alone; rows that repeat
    a doc_id are packed each. target: share of each source (default: its share
    of all tokens, so that all queues end together); sources without a target
    get their natural share of what is left, or 1 in ``SHARES``. A null source
    is a queue of its own. Any number of sources keep queues and shares of their
    own: the schedule has one entry for each different share and total. When a
    queue ends, the others fill its part.

    Returns pieces: doc_id, queue, start (ids of the document before the piece),
    length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset. Every window but the last is full, so padding is less than one
    window in all. An empty table gives no rows.

    Tokens are written once to the shared folder; places come from sums by
    (task, source). Ids are shuffled only where these sums are more than a
    broadcast holds (``store.BROADCAST_ROWS``); texts never are.
    """
    source = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("queue"))
    wide = ids_of(tokenizer).dtype.itemsize
    kept = written(named.mapInArrow(_tokens(tokenizer, end_id), "doc_id long, queue string, part int, at long, n long, ids binary"), "tokens")
    sums = written(kept.groupBy("queue", "part").agg(F.sum("n").alias("n")), "sums")
    totals = written(sums.groupBy("queue").agg(F.sum("n").alias("total")), "totals")
    every = totals.agg(F.sum("total")).head()[0] or 0
    want = F.col("total") / F.lit(float(max(every, 1)))
    if target is not None:
        given = docs.sparkSession.createDataFrame([("s" + k, float(v)) for k, v in target.items()], "queue string, given double")
        totals = totals.join(F.broadcast(given), "queue", "left")
        asked = totals.agg(F.sum("given"), F.sum(F.when(F.col("given").isNull(), want))).head()
        want = F.coalesce("given", want * max(0.0, 1 - (asked[0] or 0.0)) / (asked[1] or 1.0))
    totals = totals.withColumn("want", want)
    of_all = max(totals.agg(F.sum("want")).head()[0] or 0.0, 1e-300)
    totals = written(totals.select("queue", "total", F.greatest(F.lit(1), F.bround(F.col("want") / of_all * SHARES)).cast("long").alias("share")), "shares")
    sizes = [tuple(r) for r in totals.groupBy("share", "total").agg(F.count("*").alias("many")).orderBy("share", "total").collect()]  # different ones only
    schedule = Schedule(sizes, window, slot)
    first = np.append(0, np.cumsum([m for _, _, m in sizes])).tolist()
    groups = docs.sparkSession.createDataFrame([(s, n, at) for (s, n, _), at in zip(sizes, first)], "share long, total long, first long")
    inside = F.row_number().over(Window.partitionBy("share", "total").orderBy("queue"))
    placed = totals.join(F.broadcast(groups), ["share", "total"]).select("queue", "share", (F.col("first") + inside - 1).alias("place"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("queue", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    bases = written(bases.join(placed, "queue"), "bases")
    return kept.join(sized(bases), ["queue", "part"]).select("doc_id", "queue", "at", "n", "ids", "base", "place", "share").mapInArrow(
        _pieces(schedule, wide),
        "doc_id long, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
