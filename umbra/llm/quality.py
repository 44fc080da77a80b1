"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted on the bytes of whole batches. Trees are grown on
quantile bins by gradient histograms and flattened into arrays; scoring walks
all rows of a batch through a tree one level at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import mix64, slices, tidy, word_hashes

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "spaces", "line_ends", "commas", "stops", "exclaims", "bars", "symbols", "brackets", "quotes",
    "high_bytes", "control", "entropy", "distinct_words", "same_as_before", "top_word", "distinct_pairs", "log_lines", "line_symbols", "line_upper", "line_bars", "line_exclaims", "short_lines", "squeezed", "window_distinct", "window_same",
)
_SETS = {"upper": range(65, 91), "digits": range(48, 58), "spaces": (32, 9), "line_ends": (10,), "commas": b",;:", "stops": b".?", "exclaims": b"!", "bars": b"|", "symbols": b"#$%&*@^~<>_+=\\/", "brackets": b"()[]{}", "quotes": b"\"'`", "high_bytes": range(128, 256), "control": [*range(9), 11, 12, 13, *range(14, 32), 127]}
_LUT = {k: np.isin(np.arange(256), list(v)) for k, v in _SETS.items()}


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; null counts as empty, whose row is zeros."""
    words, off = word_hashes(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    col = {k: i for i, k in enumerate(FEATURES)}
    for i, text in enumerate(texts.to_pylist()):
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            continue
        raw = np.frombuffer(data, np.uint8)
        hist = np.bincount(raw, minlength=256)
        n, row = len(raw), out[i]
        row[col["log_bytes"]] = np.log1p(n)
        for k, lut in _LUT.items():
            row[col[k]] = hist[lut].sum() / n
        p = hist[hist > 0] / n
        row[col["entropy"]] = -(p * np.log2(p)).sum()
        row[col["squeezed"]] = len(zlib.compress(data, 1)) / n
        w = words[off[i] : off[i + 1]]
        m = len(w)
        row[col["log_words"]] = np.log1p(m)
        if m:
            _, count = np.unique(w, return_counts=True)
            row[col["word_bytes"]] = n / m
            row[col["distinct_words"]] = len(count) / m
            row[col["top_word"]] = count.max() / m
        if m > 1:
            same = w[1:] == w[:-1]
            row[col["same_as_before"]] = same.mean()
            row[col["distinct_pairs"]] = len(np.unique(mix64(w[1:] * np.uint64(3) + w[:-1]))) / (m - 1)
            # the worst stretch of 50 words
            cut = np.arange(0, m - 1, 50)
            row[col["window_same"]] = (np.add.reduceat(same.astype(float), cut) / np.diff(np.append(cut, m - 1)).clip(10)).max()
            stretch = np.unique((np.arange(m) // 50).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (w >> np.uint64(20)))
            row[col["window_distinct"]] = len(stretch) / m
        ends = np.flatnonzero(raw == 10)
        cut = np.concatenate([[0], ends + 1])
        cut = cut[cut < n]
        size = np.diff(np.append(cut, n))
        row[col["log_lines"]] = np.log1p(len(cut))
        row[col["short_lines"]] = (size < 20).mean()
        for k, of in (("line_symbols", "symbols"), ("line_upper", "upper"), ("line_bars", "bars"), ("line_exclaims", "exclaims")):
            row[col[k]] = (np.add.reduceat(_LUT[of][raw], cut, dtype=np.int64) / size.clip(20)).max()
    return out


@dataclass
class Trees:
    """Full binary trees of one depth as arrays: node ``k`` has children
    ``2k+1`` and ``2k+2``; a row goes right if its feature is above the cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting; each level's best cuts come from histograms of the
    gradients by (node, feature, bin). Ties go to the first feature and bin."""
    n, d = x.shape
    inner = 2**depth - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]) if n else np.zeros((0, d), int)
    share = min(max((y.sum() + 0.5) / (n + 1), 1e-3), 1 - 1e-3)
    base, total = float(np.log(share / (1 - share))), np.full(n, np.log(share / (1 - share)))
    features, limits, leaves = [], [], []
    for _ in range(rounds if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, limit, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            many, low = 2**level, 2**level - 1
            best, gain = np.zeros((many, 2), np.int64), np.zeros(many)
            for j in range(d):
                key = (node - low) * bins + binned[:, j]
                gs, hs = (np.bincount(key, v, many * bins).reshape(many, bins).cumsum(axis=1) for v in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                won = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                won[(hs < least) | (ha - hs < least)] = 0
                won[:, len(cuts[j]) :] = 0
                k = won.argmax(axis=1)
                more = won[np.arange(many), k] > gain + 1e-12
                gain[more] = won[np.arange(many), k][more]
                best[more] = np.column_stack([np.full(many, j), k])[more]
            for q in np.flatnonzero(gain > 0).tolist():
                feature[low + q], limit[low + q] = best[q, 0], cuts[best[q, 0]][best[q, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        total += leaf[at]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    shape = (len(features), inner)
    return Trees(np.array(features, np.int64).reshape(shape), np.array(limits).reshape(shape), np.array(leaves).reshape(len(features), inner + 1), base, depth)


def _measured(schema: T.StructType):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            x = statistics(batch.column("text"))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            keep = [batch.column(n) for n in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*keep, stats], names=schema.names)

    return run


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 20_000, **how) -> Trees:
    """Learns from labelled rows that aren't held out: all of them, or the
    ``most_rows`` with the smallest hash of their id (a bounded sample). Labels
    other than 0 and 1, and rows without an id, aren't used; an id labelled both
    ways is used both ways, and rows that repeat an id are used once, with the
    smallest text, so that the driver never holds more than twice ``most_rows``.
    Null and empty texts are learned from too; other columns are ignored. Without
    rows of both labels, or any rows, every score is the prior."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null").filter(~held_out())
    chosen = marked.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    rows = known.mapInArrow(_measured(schema), schema).toArrow()
    x = rows.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the order rows come in doesn't matter
    return boost(x[order], y[order], **how)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """The input's columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5
    on), which replace columns of these names. Null and empty texts are scored
    as a document without a byte; an empty table gives no rows."""
    docs = docs.withColumn("text", F.col("text").cast("string")).drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            p = trees.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)
