"""Mixing sources by temperature.

Weights are source shares raised to an exponent between 0 (all alike) and 1
(as they are). The exponent is bisected to meet a target entropy or a limit on
repetition. Each source's part of the budget is then dealt as epochs over
blocks of its documents: each epoch permutes the blocks anew, and the last one
stops where the part is spent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import sized, written


@dataclass(frozen=True)
class Mix:
    """weights by source and the exponent they come from; budget: tokens in all."""

    exponent: float
    weights: dict[str, float]
    budget: float


def tempered(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised weights; sources without tokens have none."""
    held = {s: n for s, n in tokens.items() if n > 0}
    n, many = np.array(list(held.values()), float), np.ones(len(held))
    return dict(zip(held, _weights(n, many, exponent).tolist(), strict=True))


def _weights(n: np.ndarray, many: np.ndarray, exponent: float) -> np.ndarray:
    """The weight of one source of each size n; ``many`` sources have that size."""
    logs = exponent * np.log(n)
    raw = np.exp(logs - logs.max(initial=0.0))
    return raw / (raw * many).sum() if len(n) else raw


def entropy(weights: np.ndarray, many: np.ndarray) -> float:
    w, m = weights[weights > 0], many[weights > 0]
    return float(-(m * w * np.log(w)).sum())


def _budget(n: np.ndarray, weights: np.ndarray, budget: float | None) -> float:
    """The given budget, or the least by which every source is used up once."""
    return budget if budget is not None else float((n / weights).max(initial=0.0))


def repetition(n: np.ndarray, weights: np.ndarray, budget: float | None) -> float:
    """The most epochs of any source."""
    return float((weights * _budget(n, weights, budget) / n).max(initial=0.0))


def exponent_of(n: np.ndarray, many: np.ndarray, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent by bisection, for ``many`` sources of each size n. Entropy
    falls as the exponent grows, and so does the most epochs of a source. Of two
    goals the exponent that meets both is taken (the larger); a goal out of
    reach gives the nearest end."""

    def least(meets) -> float:
        if meets(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if meets(mid) else (mid, high)
        return high

    ends = []
    if target_entropy is not None:
        ends.append(least(lambda a: entropy(_weights(n, many, a), many) <= target_entropy))
    if max_repeats is not None:
        ends.append(least(lambda a: repetition(n, _weights(n, many, a), budget) <= max_repeats * (1 + 1e-12)))
    return max(ends, default=1.0)


def solve(tokens: dict[str, int], target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> Mix:
    """Exponent, weights and budget of sources by name."""
    n = np.array([x for x in tokens.values() if x > 0], float)
    many = np.ones(len(n))
    exponent = exponent_of(n, many, target_entropy, max_repeats, budget)
    return Mix(exponent, tempered(tokens, exponent), _budget(n, _weights(n, many, exponent), budget))


def _share(*of):
    """A number from 0 to 1 by hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: float | None = None,
    tokens=None,
    block_docs: int = 1024,
    seed: int = 1,
) -> DataFrame:
    """Deals documents to the sources' tempered weights.

    docs: doc_id, text, source and further columns. tokens: a column expression
    (default: the text's words, and 1 for the document's end). Without a budget
    every source is used up at least once, so no document is lost.

    Returns the input's columns with ``tokens``, ``copy`` (0 for a document's
    first use) and ``place`` (from 0 to 1; reading by it meets the weights from
    the start), which replace columns of these names. A null source is a source;
    null text has the end alone; rows that repeat an id share their places in
    the permutation and are kept or left together, and so do rows without an id
    that repeat a text; an empty table gives no
    rows. Any number of sources keep weights of their own: the driver holds one
    entry for each different token total, at most about sqrt(2 x all tokens).

    ``target_entropy`` alone doesn't bound repeats: a source of few tokens is
    repeated as often as its weight asks; give ``max_repeats`` beside it.

    Only sums by (source, block) are shuffled; texts are only where there are
    more sources or blocks than a broadcast holds (``store.BROADCAST_ROWS``).
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
    docs = docs.drop("tokens", "copy", "place")
    names = docs.columns
    source = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    known = docs.withColumns({"tokens": (words if tokens is None else tokens).cast("long"), "mix_source": source})
    # rows without an id are told apart by their text, so that they aren't one block
    mix_id = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit("no id")))
    counted = written(known.select("mix_source", mix_id.alias("mix_id"), "tokens"), "counts")
    totals = written(counted.groupBy("mix_source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("whole")).filter("whole > 0"), "totals")
    sizes = totals.groupBy("whole").agg(F.count("*").alias("many")).orderBy("whole").collect()  # different totals only
    n, many = np.array([r["whole"] for r in sizes], float), np.array([r["many"] for r in sizes], float)
    weights = _weights(n, many, exponent_of(n, many, target_entropy, max_repeats, budget))
    parts = (weights * _budget(n, weights, budget)).tolist()
    plan = []
    for whole, part in zip((r["whole"] for r in sizes), parts, strict=True):
        epochs = int(part / whole + 1e-9)
        plan.append((whole, float(whole), part, epochs, max(0.0, part - epochs * whole)))
    plan = docs.sparkSession.createDataFrame(plan, "whole long, mix_whole double, mix_part double, mix_epochs int, mix_rest double")
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("int").alias("mix_blocks")
    plan = sized(written(totals.join(F.broadcast(plan), "whole").select("mix_source", blocks_of, "mix_whole", "mix_part", "mix_epochs", "mix_rest"), "plan"))
    block = F.pmod(F.xxhash64(F.lit(seed), "mix_id"), F.col("mix_blocks")).cast("int").alias("mix_block")
    inner = _share(F.lit(seed), F.lit("in"), "mix_id").alias("mix_in")
    dealt = counted.join(plan, "mix_source").select("*", block, inner)
    blocks = dealt.groupBy("mix_source", "mix_block", "mix_whole", "mix_part", "mix_epochs", "mix_rest").agg(F.sum("tokens").cast("double").alias("mix_size"))
    turns = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("mix_rest") > 0.5, F.col("mix_epochs")).otherwise(F.greatest("mix_epochs", F.lit(1)) - 1))))
    order = Window.partitionBy("mix_source", "copy").orderBy(_share(F.lit(seed), "mix_source", "copy", "mix_block"), "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("mix_start", F.coalesce(F.sum("mix_size").over(order), F.lit(0.0)))
    last = F.col("copy") == F.col("mix_epochs")
    turns = written(turns.filter(~last | (F.col("mix_start") < F.col("mix_rest"))), "turns")
    # the block in which a source's part ends is cut between documents
    cut = turns.filter(last & (F.col("mix_start") + F.col("mix_size") > F.col("mix_rest"))).select("mix_source", "mix_block", (F.col("mix_rest") - F.col("mix_start")).alias("mix_left"))  # one block a source at most
    own = Window.partitionBy("mix_source", "mix_block").orderBy("mix_in").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.select("mix_source", "mix_block", "mix_in", "tokens").join(sized(cut), ["mix_source", "mix_block"])
    kept = inside.withColumn("mix_until", F.sum("tokens").over(own)).filter("mix_until - tokens < mix_left").groupBy("mix_source", "mix_block").agg(F.max("mix_in").alias("mix_most"))
    turns = turns.join(sized(written(kept, "kept")), ["mix_source", "mix_block"], "left").select("mix_source", "mix_block", "copy", "mix_start", "mix_size", F.when(last, F.coalesce("mix_most", F.lit(2.0))).otherwise(2.0).alias("mix_most"))
    turns = written(turns, "turns")
    rows = known.withColumn("mix_id", mix_id).join(plan, "mix_source").select("*", block, inner)
    rows = rows.join(sized(turns), ["mix_source", "mix_block"]).filter("mix_in <= mix_most")
    place = (F.col("copy") * F.col("mix_whole") + F.col("mix_start") + F.col("mix_in") * F.col("mix_size")) / F.col("mix_part")
    return rows.select(*names, "tokens", "copy", place.alias("place"))
