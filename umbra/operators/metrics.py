"""Detection quality, leakage, and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written

# Labels of the evaluation corpus.
CORPUS_LABELS = {"FIRSTNAME": "person", "LASTNAME": "person", "MIDDLENAME": "person", "CITY": "location", "STATE": "location", "COUNTY": "location", "COMPANYNAME": "org"}


def corpus_kind(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in CORPUS_LABELS.items() for x in kv))[label]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def overlap_scores(pred: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Precision, recall and F1 by ``keys`` and, with a null last key, over all of that: a span
    counts if one of the other side with its document and keys overlaps it."""
    both = ["doc_id", *keys]

    def caught(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        x, y = a.withColumn("i", F.monotonically_increasing_id()).alias("x"), b.alias("y")
        cond = (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))
        for k in both:
            cond &= F.col(f"x.{k}") == F.col(f"y.{k}")
        hit = x.join(y, cond, "left_semi").groupBy(*keys).agg(F.count("*").alias(f"{name}_hit"))
        return a.groupBy(*keys).agg(F.count("*").alias(name)).join(hit, list(keys), "left")

    rows = caught(pred, gold, "pred").join(caught(gold, pred, "gold"), list(keys), "full").na.fill(0)
    # the last key is the kind: null in the row over all kinds
    sums = rows.groupingSets([list(keys), list(keys[:-1])], *keys).agg(*(F.sum(c).alias(c) for c in ("pred", "pred_hit", "gold", "gold_hit")))
    p, r = ratio(F.col("pred_hit"), F.col("pred")), ratio(F.col("gold_hit"), F.col("gold"))
    return sums.select(*keys, p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def sweep(scored: DataFrame, gold: DataFrame, thresholds=(0.3, 0.5, 0.7)) -> DataFrame:
    """The same at each threshold of the predictions' score."""
    each = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter("score >= threshold").drop("score")
    targets = gold.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return overlap_scores(each, targets, ("threshold", "kind"))


def greedy_match(rows: DataFrame) -> DataFrame:
    """doc_id, tp, fp, fn: predictions in order take the first free gold surface
    of their kind that holds them or that they hold, case folded.
    rows: doc_id, pred and gold (arrays of kind and text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pred, gold in zip(pdf["pred"], pdf["gold"], strict=True):
                free = [(g["kind"], g["text"].casefold()) for g in gold]
                tp = 0
                for p in pred:
                    text = p["text"].casefold()
                    hit = next((g for g in free if g[0] == p["kind"] and (g[1] in text or text in g[1])), None)
                    if hit:
                        free.remove(hit)
                        tp += 1
                out.append((tp, len(pred) - tp, len(gold) - tp))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tp": [x[0] for x in out], "fp": [x[1] for x in out], "fn": [x[2] for x in out]})

    return rows.select("doc_id", "pred", "gold").mapInPandas(run, "doc_id long, tp int, fp int, fn int")


def relaxed_leakage(rows: DataFrame) -> DataFrame:
    """leakage and clean rate over rows (units: ``||``-parted string, spans): a unit
    is caught if a span holds it or lies in it; an empty unit is caught."""
    units = F.filter(F.split(F.coalesce("units", F.lit("")), r"\|\|", -1), lambda u: u != "")
    missed = F.filter(units, lambda u: ~F.exists("spans", lambda s: F.contains(F.lower(s), F.lower(u)) | F.contains(F.lower(u), F.lower(s))))
    each = rows.select(F.size(units).alias("n"), F.size(missed).alias("m"))
    return each.agg(ratio(F.sum("m"), F.sum("n")).alias("leakage"), F.avg(((F.col("n") > 0) & (F.col("m") == 0)).cast("double")).alias("clean"))


def verbatim_leakage(rows: DataFrame) -> DataFrame:
    """Share of units (array) that ``safe`` still holds, and of rows restored exactly."""
    left = F.filter("units", lambda u: F.contains(F.lower("safe"), F.lower(u)))
    each = rows.select(F.size("units").alias("n"), F.size(left).alias("m"), (F.col("restored") == F.col("text")).cast("int").alias("same"))
    return each.agg(ratio(F.sum("m"), F.sum("n")).alias("leakage"), F.avg("same").alias("exact"))


def bucket(leakage: Column) -> Column:
    return F.when(leakage <= 0.12, "decisive").when(leakage < 0.25, "promising").otherwise("negative")


def normalised(vector: Column) -> Column:
    v = vector.cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))


def embedded(rows: DataFrame, model: Callable[[list[str]], np.ndarray], text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Adds vectors of length 1 by an injected model, in Arrow batches; null text counts as empty."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(model([t or "" for t in batch.column(text_col).to_pylist()]), np.float32).reshape(len(batch), -1)
            size = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = np.where(size > 0, v / np.where(size > 0, size, 1), v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(v), pa.list_(pa.float32()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _packed(most: int):
    """Whole blocks of vectors of length 1 as one row: ids, data and their dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), most):
                part = batch.slice(a, most)
                by_dim: dict[int, list[int]] = {}
                for i, n in enumerate(pa.compute.list_value_length(part.column("embedding")).to_pylist()):
                    if n:
                        by_dim.setdefault(n, []).append(i)
                for dim, at in by_dim.items():
                    some = part.take(pa.array(at))
                    v = some.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
                    v = np.where(size > 0, v / np.where(size > 0, size, 1), v)
                    ids = some.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["dim", "ids", "data"])

    return run


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, q_ids, q_data in zip(*(batch.column(n) for n in ("ids", "data", "q_ids", "q_data")), strict=True):
                ids, q_ids = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, q_ids))
                x, q = np.frombuffer(data.as_buffer()).reshape(len(ids), -1), np.frombuffer(q_data.as_buffer()).reshape(len(q_ids), -1)
                score = np.round(q @ x.T, 6) + 0.0
                score[q_ids[:, None] == ids[None, :]] = -np.inf
                rows = []
                for i, own in enumerate(q_ids.tolist()):
                    bound = np.partition(score[i], len(ids) - k)[len(ids) - k] if len(ids) > k else -np.inf
                    at = np.flatnonzero((score[i] >= bound) & (score[i] > -np.inf))
                    at = at[np.lexsort([ids[at], -score[i, at]])[:k]]
                    rows.append((np.full(len(at), own), ids[at], score[i, at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = 1024, most_bytes: int = 64 << 20) -> DataFrame:
    """The k-1 nearest siblings of each query vector (vec_id, embedding) by dot
    product of vectors of length 1, rounded to 6 places, ties to smaller ids.

    Queries against all rows, block by block: each pair of blocks is one matrix
    product whose k-1 best of each query alone go on. Query blocks are broadcast
    up to ``most_bytes``, beyond that dealt to tasks with the row blocks they
    meet. Null and empty vectors and null ids take no part; vectors of another
    dimension are no candidates.
    """
    usable = "vec_id is not null and embedding is not null"
    pack = lambda df: df.filter(usable).select("vec_id", "embedding").mapInArrow(_packed(block), "dim int, ids binary, data binary")
    asked = written(pack(queries), "asked").select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    size = asked.agg(F.sum(F.octet_length("q_data"))).head()[0] or 0
    blocks = pack(rows)
    if size <= most_bytes:
        met = blocks.join(F.broadcast(asked), "dim")
    else:  # one key holds all blocks: each query block goes to one of several copies of the key
        salts = -(-size // most_bytes)
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("q_ids"), F.lit(salts)).cast("int"))
        met = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1).cast("int")))).join(asked, ["dim", "salt"])
    found = met.select("ids", "data", "q_ids", "q_data").mapInArrow(_best(k - 1), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k - 1).select("query_id", "vec_id", "score", "rank")
