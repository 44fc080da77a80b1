"""Line deduplication by two Bloom filters.

The first filter holds the lines seen once, the second those seen twice. Each
task fills both over its own rows; two tasks' filters merge as
``once = a | b`` and ``twice = a2 | b2 | (a & b)``, which keeps every repeated
line. Only lines that the second filter suspects are shuffled, already summed
by batch, and confirmed by their whole key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import tidy
from .store import written

SEGMENT = 1 << 16
#: Bits of each filter: from 64 KB to 8 MB. Beyond the largest size more lines
#: are suspected, and shuffled, than repeat; results stay the same.
LEAST_BITS, MOST_BITS = 1 << 19, 1 << 26
SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """A text's line keys: A-Z lower-cased, ``[\\x20\\x09-\\x0D]`` stripped at both ends."""
    return [x.strip(SPACE) for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _fill(bits: int, least: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            own = [xxhash.xxh3_64_intdigest(k) for text in batch.column(0) for k in set(line_keys(text.as_py())) if _long(k, least)]
            seen, count = np.unique(np.array(own, np.uint64), return_counts=True)
            p, q = _places(seen, bits)
            again = (count > 1) | (once[p] & once[q])
            twice[p[again]] = twice[q[again]] = True
            once[p] = once[q] = True
        a, b = np.packbits(once).reshape(-1, SEGMENT), np.packbits(twice).reshape(-1, SEGMENT)
        for k in np.flatnonzero(a.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a[k].tobytes()], pa.binary()), pa.array([b[k].tobytes()], pa.binary())], names=["segment", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment; one is held at a time."""
    at, once, twice = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["segment", "twice"])

    for batch in batches:
        for k, a, b in zip(*(batch.column(i) for i in range(3)), strict=True):
            a, b = (np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b))
            if k.as_py() != at:
                if at is not None:
                    yield out()
                at, once, twice = k.as_py(), a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if at is not None:
        yield out()


def twice_seen(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """The second filter, merged over all rows (at most 8 MB)."""
    filled = texts.mapInArrow(_fill(bits, least), "segment int, once binary, twice binary")
    merged = filled.repartition(max(1, bits // 8 // SEGMENT), "segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, twice binary")
    out = np.zeros((bits // 8 // SEGMENT, SEGMENT), np.uint8)
    for row in merged.collect():
        out[row["segment"]] = np.frombuffer(row["twice"], np.uint8)
    return out.ravel()


def _suspected(keys: list[bytes], twice: np.ndarray) -> list[bytes]:
    if not keys:
        return keys
    bits = len(twice) * 8
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    hit = np.ones(len(keys), bool)
    for p in _places(hashes, bits):
        hit &= (twice[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return [keys[i] for i in np.flatnonzero(hit).tolist()]


def _suspects(twice, least: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for key in _suspected([k for k in set(line_keys(text.as_py())) if _long(k, least)], filter_):
                    x = found.setdefault(key, [0, doc])
                    x[0] += 1
                    if x[1] is None or doc is not None and doc < x[1]:
                        x[1] = doc
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())], names=["key", "docs", "first"])

    return run


def _by_text(twice, least: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            of, keys = [], []
            for text in batch.column(0).to_pylist():
                own = _suspected([k for k in set(line_keys(text)) if _long(k, least)], filter_)
                keys += own
                of += [hashlib.md5((text or "").encode()).hexdigest()] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(keys, pa.binary())], names=["text_md5", "key"])

    return run


def _apply(schema: T.StructType, keep: str, shared=None):
    """Drops lines; ``shared``: the repeated lines of all texts, else each row
    brings its own in the column ``repeated``."""
    names = schema.names

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_repeated = None if shared is None else shared.value
        for batch in batches:
            texts, total, dropped = [], [], []
            lists = batch.column("repeated").to_pylist() if all_repeated is None else [None] * len(batch)
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), lists, strict=True):
                repeated = all_repeated if all_repeated is not None else {x["digest"]: x["first"] for x in own or []}
                lines = (text or "").split("\n")
                out, seen = [], set()
                for line, key in zip(lines, line_keys(text), strict=True) if repeated else ((x, b"") for x in lines):
                    digest = xxhash.xxh3_128_digest(key) if key else None
                    if digest is None or digest not in repeated:
                        out.append(line)
                    elif keep == "first" and digest not in seen and repeated[digest] in (None, doc):
                        seen.add(digest)
                        out.append(line)
                texts.append("\n".join(out))
                total.append(len(lines))
                dropped.append(len(lines) - len(out))
            new = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)

    return run


def line_dedup(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1, most_shared: int = 200_000) -> DataFrame:
    """Drops lines whose key at least ``min_docs`` documents hold.

    A line's key is the line with white space stripped at both ends and A-Z
    lower-cased; keys of fewer than ``min_chars`` code points stay. Each row is a
    document. ``keep="none"`` drops such lines in every document;
    ``keep="first"`` leaves the first occurrence in the smallest doc_id (rows
    that share that id each keep it; if all ids are null, each row keeps it).

    Returns the input's columns with ``text`` rewritten, and n_lines and
    n_dropped (which replace columns of these names). Null text counts as one
    empty line and becomes empty. An empty table gives no rows.

    Up to ``most_shared`` repeated lines go to every task as 128-bit digests;
    beyond that each text's own repeated lines are joined to it.
    """
    spark = docs.sparkSession
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).drop("n_lines", "n_dropped")
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n")).head()["n"] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(16 * lines).bit_length()))
    twice = spark.sparkContext.broadcast(twice_seen(docs.select("text"), bits, min_chars).tobytes())
    found = docs.select("doc_id", "text").mapInArrow(_suspects(twice, min_chars), "key binary, docs long, first long")
    repeated = written(found.groupBy("key").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).filter(F.col("docs") >= min_docs), "lines")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if repeated.limit(most_shared + 1).count() <= most_shared:
        twice.destroy()
        shared = {xxhash.xxh3_128_digest(bytes(r["key"])): r["first"] for r in repeated.select("key", "first").toLocalIterator()}
        return docs.mapInArrow(_apply(schema, keep, spark.sparkContext.broadcast(shared)), schema)
    of_text = docs.select("text").mapInArrow(_by_text(twice, min_chars), "text_md5 string, key binary").distinct()
    digest = F.udf(lambda k: xxhash.xxh3_128_digest(bytes(k)), "binary", useArrow=True)
    own = of_text.join(repeated, "key").groupBy("text_md5").agg(F.collect_list(F.struct(digest("key").alias("digest"), "first")).alias("repeated"))
    joined = docs.withColumn("text_md5", F.md5(text)).join(own, "text_md5", "left").drop("text_md5")
    return joined.mapInArrow(_apply(schema, keep), schema)
