"""String leaves of JSON: flattened, rewritten and put back.

The operators over documents treat each leaf as a text of its own, whose ``seq``
is the document's with the leaf's number in visiting order; offsets are relative
to the leaf. Bad JSON has no leaves and comes back as it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bind import let
from . import audit, entities, rewrite
from .detect import detect

RESERVED, DEPTH = ("system", "role"), 32
LEAF = "array<struct<pointer:string,text:string>>"


def walk(value, put, pointer: str = "", depth: int = 0):
    """Visits string leaves, keys in alphabetical order; reserved keys and what
    lies under ``DEPTH`` containers or more stay untouched."""
    if isinstance(value, str):
        return put(pointer, value) if depth < DEPTH else value
    if depth >= DEPTH:
        return value
    if isinstance(value, dict):
        return {k: v if k in RESERVED else walk(v, put, f"{pointer}/{k}", depth + 1) for k, v in sorted(value.items())}
    if isinstance(value, list):
        return [walk(v, put, f"{pointer}/{i}", depth + 1) for i, v in enumerate(value)]
    return value


def _leaves(docs: pd.Series) -> pd.Series:
    out = []
    for doc in docs:
        found: list[dict] = []
        try:
            walk(json.loads(doc or "null"), lambda p, t, found=found: found.append({"pointer": p, "text": t}) or t)
        except ValueError:
            pass
        out.append(found)
    return pd.Series(out)


def _rebuilt(docs: pd.Series, texts: pd.Series) -> pd.Series:
    out = []
    for doc, row in zip(docs, texts, strict=True):
        try:
            turn = iter(row if row is not None else [])
            out.append(json.dumps(walk(json.loads(doc), lambda p, t, turn=turn: next(turn, t)), ensure_ascii=False, separators=(",", ":")))
        except (ValueError, TypeError):
            out.append(doc)
    return pd.Series(out)


def leaves(doc: Column) -> Column:
    """pointer and text of each string leaf in visiting order; bad JSON has none."""
    return F.pandas_udf(_leaves, LEAF)(doc)


def rebuild(doc: Column, texts: Column) -> Column:
    """The document with its leaves replaced in visiting order."""
    return F.pandas_udf(_rebuilt, "string")(doc, texts)


def with_leaves(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds ``umbra_leaves``, the leaves of ``doc``, by a node of its own: what
    follows can name them without parsing a document again."""
    schema = T.StructType([*rows.schema.fields, T.StructField("umbra_leaves", T._parse_datatype_string(LEAF))])
    of = pa.list_(pa.struct([("pointer", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(_leaves(batch.column(doc).to_pylist()).tolist(), of)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_rebuilt(rows: DataFrame, doc: str, out: str) -> DataFrame:
    """Adds ``out``: the document with its leaves replaced by ``umbra_texts``, which goes."""
    names = [n for n in rows.columns if n not in ("umbra_texts", out)]
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = _rebuilt(batch.column(doc).to_pylist(), batch.column("umbra_texts").to_pylist()).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(done, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _spans(rows: DataFrame, doc: str) -> DataFrame:
    """rows with ``umbra_leaves``: each leaf's pointer, text and spans, in visiting order."""
    each = lambda x: F.struct(x["pointer"].alias("pointer"), x["text"].alias("text"), detect(x["text"]).alias("spans"))
    return with_leaves(rows, doc).withColumn("umbra_leaves", F.transform("umbra_leaves", each))


def leaf_rows(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """session_id, seq (the document's seq and the leaf's number), pointer, text and its spans."""
    each = _spans(rows, doc).select("session_id", "seq", F.posexplode_outer("umbra_leaves").alias("leaf", "x")).filter("leaf is not null")
    return each.select("session_id", F.struct("seq", "leaf").alias("seq"), "x.pointer", "x.text", "x.spans")


def mint_json(rows: DataFrame, prior: DataFrame | None = None, doc: str = "doc") -> DataFrame:
    """Entities of the documents' leaves, first seen, first numbered; ``prior`` goes on."""
    return entities.mint(entities.explode_spans(leaf_rows(rows, doc)), prior)


def pseudonymise_json(rows: DataFrame, known: DataFrame, doc: str = "doc") -> DataFrame:
    """rows with ``safe``, the document with pseudonyms in its leaves, ``n_leaves``
    and ``replaced``, the leaves' replacements in visiting order (offsets are the
    leaf's). Each row is rewritten by itself: rows may repeat in any column."""
    asked = F.flatten(F.transform("umbra_leaves", lambda x: rewrite.surfaces(x["spans"])))
    named = entities.looked_up(_spans(rows, doc), asked, known, "norm", "pseudonym", "umbra_names")
    one = lambda x, cuts: F.struct(rewrite.splice(x["text"], cuts).alias("safe"), rewrite.shown(cuts).alias("replaced"))
    done = F.transform("umbra_leaves", lambda x: let(rewrite.put(x["spans"], F.col("umbra_names")), lambda cuts: one(x, cuts)))
    out = named.withColumn("umbra_done", done)
    new = {"umbra_texts": F.transform("umbra_done", lambda x: x["safe"]), "n_leaves": F.size("umbra_done"), "replaced": F.flatten(F.transform("umbra_done", lambda x: x["replaced"]))}
    return with_rebuilt(out.withColumns(new).drop("umbra_leaves", "umbra_names", "umbra_done"), doc, "safe")


def _looked_up(rows: DataFrame, known: DataFrame, doc: str) -> DataFrame:
    """rows with their leaves' texts and the entities that these name."""
    texts = with_leaves(rows, doc).withColumn("umbra_leaves", F.transform("umbra_leaves", lambda x: x["text"]))
    return entities.looked_up(texts, F.flatten(F.transform("umbra_leaves", lambda x: rewrite.tokens_of(x))), known, "pseudonym", "canonical", "umbra_known")


def reverse_json(rows: DataFrame, known: DataFrame, doc: str = "doc", out: str = "restored") -> DataFrame:
    """Adds ``out``: the document with its session's first-seen surfaces in its leaves."""
    texts = F.transform("umbra_leaves", lambda x: rewrite.mapped(x, F.col("umbra_known")))
    return with_rebuilt(_looked_up(rows, known, doc).withColumn("umbra_texts", texts).drop("umbra_leaves", "umbra_known"), doc, out)


def findings_json(rows: DataFrame, known: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds ``findings`` of all leaves, leaf by leaf, with the leaf's offsets."""
    found = F.flatten(F.transform("umbra_leaves", lambda x: audit.found_in(x, F.col("umbra_known"))))
    return _looked_up(rows, known, doc).withColumn("findings", found).drop("umbra_leaves", "umbra_known")
