"""Audit of replies: unknown pseudonyms, likely leaks, verdicts and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import wire
from ..functions.patterns import PSEUDONYM, unicode
from .detect import _found, detect
from .entities import looked_up
from .rewrite import splice, tokens_of

FINDING = "struct<start:int,end:int,text:string,type:string,kind:string>"


def _finding(x, type_: str, kind: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(type_).alias("type"), wire(kind).alias("kind"))


def tokens(text: Column) -> Column:
    """Places of pseudonym-shaped tokens; their kind is their prefix."""
    found = _found(F.coalesce(text, F.lit("")), "", unicode(PSEUDONYM), 0, "_")
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), F.split_part(x["text"], F.lit("_"), F.lit(1)).alias("kind"), x["text"].alias("text")))


def found_in(text: Column, known: Column) -> Column:
    """Findings of one reply by start, unknown pseudonyms first on ties. known: a
    map that has the session's own pseudonyms among the reply's tokens, or null."""
    unknown_ = F.transform(F.filter(tokens(text), lambda x: F.try_element_at(known, x["text"]).isNull()), lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("src"), x["end"].alias("end"), _finding(x, "unknown_pseudonym", x["kind"]).alias("f")))
    leaked_ = F.transform(detect(text), lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("src"), x["end"].alias("end"), _finding(x, "likely_leaked", x["kind"]).alias("f")))
    return F.transform(F.sort_array(F.concat(unknown_, leaked_)), lambda x: x["f"])


def findings(replies: DataFrame, entities: DataFrame) -> DataFrame:
    """replies (session_id, text and further columns) with ``findings`` by start,
    unknown pseudonyms first on ties.

    Each row is audited by itself, so rows may repeat in any column; a null
    session is a session and null text has no findings.
    """
    named = looked_up(replies, tokens_of(F.col("text")), entities, "pseudonym", "canonical", "umbra_known")
    return named.withColumn("findings", found_in(F.col("text"), F.col("umbra_known"))).drop("umbra_known")


def _of(replies: DataFrame, type_: str) -> DataFrame:
    return replies.select("session_id", "seq", F.explode_outer("findings").alias("finding")).filter(F.col("finding.type") == type_)


def unknown(replies: DataFrame, entities: DataFrame) -> DataFrame:
    """session_id, seq and finding of each pseudonym that the session never minted."""
    return _of(findings(replies, entities), "unknown_pseudonym")


def leaked(replies: DataFrame) -> DataFrame:
    """session_id, seq and finding of each span that a reply holds in the clear."""
    each = replies.select("session_id", "seq", F.explode_outer(detect(F.col("text"))).alias("x")).filter("x is not null")
    return each.select("session_id", "seq", _finding(F.col("x"), "likely_leaked", F.col("x.kind")).alias("finding"))


def with_learned(found: Column, learned: Column) -> Column:
    """Adds learned spans that hold no pseudonym and overlap nothing found so far."""
    fresh = F.filter(learned, lambda x: ~x["text"].rlike(PSEUDONYM))
    merged = F.aggregate(
        fresh,
        found,
        lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"])), acc).otherwise(F.concat(acc, F.array(_finding(x, "likely_leaked", x["kind"])))),
    )
    return F.array_sort(merged, lambda a, b: a["start"] - b["start"])


def verdict(found: Column, policy: str = "log") -> Column:
    """pass without findings; the policy if one is unknown; else log_only."""
    of = {"log": "log_only", "redact": "redact", "reject": "reject"}[policy]
    return F.when(F.size(found) == 0, "pass").when(F.exists(found, lambda x: x["type"] == "unknown_pseudonym"), of).otherwise("log_only")


def redact(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    return splice(text, F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(mark).alias("put"))))
