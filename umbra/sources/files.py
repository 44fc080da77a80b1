"""Text trees, request bodies and response sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("node_modules", ".git", "dist", "target", ".venv")
REQUESTS = {
    "text": "session_id string, text string",
    "reply": "session_id string, reply string",
    "json": "session_id string, value string",
    "cohort": "session_id string, text string, k int, content_hiding boolean",
}


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path and text of every file under a root, build and dependency folders left out."""
    rows = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.filter(~F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))


def listing(paths: DataFrame, folder: str) -> DataFrame:
    """Names right under a folder, folders with ``/`` at their end."""
    lead = folder.rstrip("/") + "/" if folder else ""
    under = F.substring(F.col("path"), F.lit(len(lead) + 1), F.length("path"))
    name = F.when(F.contains(under, F.lit("/")), F.concat(F.split_part(under, F.lit("/"), F.lit(1)), F.lit("/"))).otherwise(under)
    return paths.filter(F.col("path").startswith(lead) & (F.length("path") > len(lead))).select(name.alias("name")).distinct()


def engine_info(spark: SparkSession) -> DataFrame:
    """One row that tells the engine is up: status, Spark's version and its cores."""
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(spark.version).alias("spark"), F.lit(spark.sparkContext.defaultParallelism).alias("cores"))


def sample(corpus: DataFrame, language: str, n: int, lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The first ``n`` rows of a language by their key."""
    return corpus.filter(F.col(lang) == language).orderBy(key).limit(n)


def corpora(*parts: DataFrame) -> DataFrame:
    """Several configurations of a corpus as one; a column that a part lacks is null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def requests(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUESTS[kind]).json(path)


def as_findings(rows: DataFrame) -> DataFrame:
    """Adds ``value``: findings as responses show them, with the reason as one tagged object."""
    one = lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), F.struct(x["type"].alias("type"), x["kind"].alias("kind")).alias("reason"))
    return rows.withColumn("value", F.to_json(F.struct(F.transform("findings", one).alias("findings"))))


def as_responses(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))
