"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.jaccard import one_of_each
from umbra.llm.lines import line_dedup
from umbra.llm.mixing import mix
from umbra.llm.packing import pack
from umbra.llm.quality import fit, score
from umbra.llm.store import BATCH_ROWS, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    """The stages' columns. What a stage returns is run by its caller, so rows
    that go to Python at once are set for the session here."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row by its text; null and
    empty texts are scored as a document without a byte."""
    docs = _sized(docs)
    trees = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, trees).filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay where they come first. A document of
    which nothing is left repeats others line by line and goes. Null text becomes
    empty; rows that repeat an id are a document each."""
    done = line_dedup(_sized(docs), min_docs=10, keep="first")
    return done.filter("n_dropped = 0 OR n_dropped < n_lines AND text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 80 % alike stays:
    the smallest id. Documents without words, and rows without an id, stay."""
    return one_of_each(_sized(docs), width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to twice; every document is used. A null
    source is a source. Copies are rows; their order goes with the files."""
    return mix(_sized(docs), max_repeats=2.0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows, each with the sources' shares; null and empty texts
    are the end of a document alone."""
    import public_tokenizers

    pieces = pack(_sized(docs), str(public_tokenizers.path("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixing", mixing), ("packing", packing)]

#: A trained model decides in the first stage, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. Extra columns go
    at the first stage; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
