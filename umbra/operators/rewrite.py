"""Rewriting texts: pseudonyms in, surfaces back, and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import gathered, let
from ..functions.kinds import source_tag, wire
from ..functions.patterns import PSEUDONYM, unicode
from .detect import EMPTY
from .entities import looked_up, normalise


def splice(text: Column, cuts: Column) -> Column:
    """Replaces byte ranges. cuts: array of (start, end, put), by start; one that
    starts before the last one's end is skipped."""


    def done(data: Column) -> Column:
        gap = lambda a, b: F.decode(F.substring(data, a + 1, b - a), "UTF-8")

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            free = x["start"] >= at
            return F.when(free, x["end"].cast("int")).otherwise(at), F.when(free, F.array(gap(at, x["start"]), x["put"])).otherwise(F.array().cast("array<string>"))

        rest = F.array(F.struct(F.octet_length(data).alias("start"), F.octet_length(data).alias("end"), F.lit("").alias("put")))
        bare = F.transform(cuts, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["put"].alias("put")))
        return let(F.concat(bare, rest), lambda c: F.array_join(gathered(c, F.lit(0), step, "array<string>"), ""))

    return F.when(F.size(cuts) > 0, let(F.encode(text, "UTF-8"), done)).otherwise(text)


def surfaces(spans: Column) -> Column:
    """The normalised surfaces of a row's spans."""
    return F.transform(spans, lambda x: normalise(x["text"], x["kind"]))


def put(spans: Column, known: Column) -> Column:
    """start, end, kind and pseudonym of each span. One that the session never
    minted gets its kind in brackets: no surface passes."""
    name = lambda x: F.coalesce(F.try_element_at(known, normalise(x["text"], x["kind"])), F.concat(F.lit("["), x["kind"], F.lit("]")))
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), name(x).alias("put")))


def shown(cuts: Column) -> Column:
    """Replacements: start, end, kind, score, replacement and source."""
    return F.transform(cuts, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), wire(x["kind"]).alias("kind"), F.lit(1.0).alias("score"), x["put"].alias("replacement"), source_tag(x["kind"]).alias("source")))


def pseudonymise(rows: DataFrame, entities: DataFrame, spans: str = "spans") -> DataFrame:
    """rows (session_id, text, spans and further columns) with ``safe`` and
    ``replaced``, an array of start, end, kind, score, replacement and source. A
    span keeps the kind it was detected as, even where its pseudonym has another.

    Each row is rewritten from its own spans, so rows may repeat in any column; a
    null session is a session; null text stays null. A surface that the session
    never minted becomes its kind in brackets, never itself.
    """
    out = looked_up(rows, surfaces(F.col(spans)), entities, "norm", "pseudonym", "umbra_names")
    cuts = put(F.coalesce(F.col(spans), F.expr(EMPTY)), F.col("umbra_names"))
    done = let(cuts, lambda c: F.struct(splice(F.col("text"), c).alias("safe"), shown(c).alias("replaced")))
    return out.withColumn("umbra_done", done).withColumns({"safe": F.col("umbra_done.safe"), "replaced": F.col("umbra_done.replaced")}).drop("umbra_done", "umbra_names")


def tokens_of(text: Column, pattern: str = PSEUDONYM) -> Column:
    """Pseudonym-shaped tokens in order; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(unicode(pattern)), F.lit(0))


def mapped(text: Column, known: Column, pattern: str = PSEUDONYM) -> Column:
    """Replaces each token of the pattern that the map knows; the rest stays."""
    p = unicode(pattern)

    def joined(tokens: Column, gaps: Column) -> Column:
        named = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t))
        return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(tokens)), named, lambda g, t: F.concat(g, t)), ""), F.element_at(gaps, -1))

    done = let(tokens_of(text, pattern), lambda t: F.when(F.size(t) > 0, let(F.split(text, p, -1), lambda g: joined(t, g))).otherwise(text))
    return F.when(known.isNotNull() & F.contains(text, F.lit("_")), done).otherwise(text)


def reverse(rows: DataFrame, entities: DataFrame, text: str = "text", out: str = "restored") -> DataFrame:
    """Adds ``out``: pseudonyms of the row's session as their first-seen surfaces.
    Only the row's own tokens are looked up; null text stays null."""
    named = looked_up(rows, tokens_of(F.col(text)), entities, "pseudonym", "canonical", "umbra_known")
    return named.withColumn(out, mapped(F.col(text), F.col("umbra_known"))).drop("umbra_known")
