"""Kinds of entities, tiers and backends: small fixed dimensions as SQL literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in their order, wire names, floors, ladder and backends.
KINDS = ("EMAIL", "PATH", "IP", "URL", "UUID", "PERSON", "LOCATION", "ORG", "PII")
LEARNED = ("PERSON", "LOCATION", "ORG")
WIRE_KINDS = ("email", "url", "ip", "path", "uuid", "phone", "credit_card", "iban", "crypto_address", "api_key", "ssn", "national_id", "dob", "person", "location", "org", "custom")
SECRET_KINDS = ("api_key", "ssn", "credit_card", "iban", "crypto_address", "national_id")
LADDER = ("public", "internal", "private", "secret")
BACKENDS = (
    # id, chat, embed, classify, pii, streaming, json_mode, tools, max_tiers, runs_locally, embedding_dim
    ("anthropic", True, False, False, False, True, True, True, "public,internal", False, None),
    ("openai-compat", True, False, True, True, True, True, False, "public,internal,private,secret", True, None),
    ("webllm", True, False, True, True, True, True, False, "public,internal,private,secret", True, None),
    ("zero-tvm", True, False, True, True, True, False, False, "public,internal,private,secret", True, None),
    ("transformers-js", False, True, True, True, False, False, False, "public,internal,private,secret", True, 384),
)
CHAIN = {
    "public": ("anthropic", "openai-compat", "webllm", "zero-tvm"),
    "internal": ("anthropic", "openai-compat", "webllm", "zero-tvm"),
    "private": ("openai-compat", "webllm", "zero-tvm", "anthropic"),
    "secret": ("openai-compat", "webllm", "zero-tvm"),
}


def wire(kind: Column) -> Column:
    return F.when(kind == "PII", "custom").when(kind.isin(*KINDS), F.lower(kind))


def prefix_kind(prefix: Column) -> Column:
    """The kind of a prefix; null if unknown."""
    return F.when(prefix.isin(*KINDS), prefix)


def source_tag(kind: Column) -> Column:
    return F.when(kind.isin(*LEARNED), "ner").otherwise("regex")


def floor_tier(wire_kind: Column) -> Column:
    return F.when(wire_kind.isin(*SECRET_KINDS), "secret").otherwise("private")


def backends(spark: SparkSession) -> DataFrame:
    ddl = "backend_id string, chat boolean, embed boolean, classify boolean, pii boolean, streaming boolean, json_mode boolean, tools boolean, max_tiers string, runs_locally boolean, embedding_dim int"
    return spark.createDataFrame(list(BACKENDS), ddl).withColumn("max_tiers", F.split("max_tiers", ","))


def eligible(backends_: DataFrame, tier: str) -> DataFrame:
    """Chat backends allowed for a tier; a secret needs one that runs locally."""
    return backends_.filter(F.col("chat") & F.array_contains("max_tiers", tier) & (F.lit(tier != "secret") | F.col("runs_locally")))


def chain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i + 1, b) for t, row in CHAIN.items() for i, b in enumerate(row)], "tier string, rank int, backend_id string")


def first_reachable(chain_: DataFrame, reachable: DataFrame) -> DataFrame:
    """The first backend of each tier's chain that is reachable; null: fail closed."""
    up = chain_.join(F.broadcast(reachable.select("backend_id").distinct()), "backend_id", "left_semi")
    return chain_.select("tier").distinct().join(up.groupBy("tier").agg(F.min_by("backend_id", "rank").alias("backend_id")), "tier", "left")
