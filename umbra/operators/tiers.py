"""Sensitivity tiers: heuristic scores, escalation and routing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.keywords import PRIVATE, SECRET
from ..functions.kinds import LADDER
from ..functions.patterns import API_KEY, ENV, FRONT

# Hypotheses of the zero-shot classifier.
HYPOTHESES = {"public": "publicly shareable information", "internal": "internal work content", "private": "personal or confidential information", "secret": "secrets, credentials, or API keys"}


def _held(low: Column, words) -> Column:
    """Those of the words that a lower-cased text holds, as plain substrings."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def hits(text: Column, words) -> Column:
    """How many of the words the lower-cased text holds, as plain substrings."""
    return let(F.lower(text), lambda low: F.size(_held(low, words)))


def _scores(*values) -> Column:
    return F.struct(*((F.lit(v) if isinstance(v, float) else v).alias(t) for t, v in zip(LADDER, values, strict=True)))


def scores(text: Column) -> Column:
    """The heuristic cascade; the first rule that fires gives all four scores.
    The text is lower-cased once, and words are counted where rules before them
    don't fire. Null counts as empty."""

    def sure(n: Column) -> Column:
        certain = F.least(0.55 + 0.07 * n, F.lit(0.85))
        return let(certain, lambda c: _scores((1.0 - c) * 0.05, (1.0 - c) * 0.6, c, (1.0 - c) * 0.35))

    def cascade(t: Column, low: Column) -> Column:
        front = F.contains(t, F.lit("---")) & F.contains(low, F.lit("sensitivity"))
        private = let(F.size(_held(low, PRIVATE)), lambda n: F.when(n > 0, sure(n)).otherwise(_scores(0.25, 0.55, 0.15, 0.05)))
        return (
            F.when(front & t.rlike(FRONT.format("secret")), _scores(0.0, 0.05, 0.1, 0.85))
            .when((F.contains(t, F.lit("=")) & t.rlike(ENV)) | t.rlike(API_KEY), _scores(0.0, 0.05, 0.15, 0.8))
            .when(F.size(_held(low, SECRET)) > 0, _scores(0.02, 0.08, 0.2, 0.7))
            .when(front & t.rlike(FRONT.format("private")), _scores(0.02, 0.08, 0.8, 0.1))
            .otherwise(private)
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.lower(t), lambda low: cascade(t, low)))


def argmax(s: Column) -> Column:
    """The likeliest tier; ties go to the more cautious one."""

    def of(x: Column) -> Column:
        top = F.greatest(*(x[t] for t in LADDER))
        return F.when(x["secret"] == top, "secret").when(x["private"] == top, "private").when(x["internal"] == top, "internal").otherwise("public")

    return let(s, of)


def margin(s: Column) -> Column:
    return let(s, lambda x: let(F.sort_array(F.array(*(x[t] for t in LADDER)), False), lambda order: order[0] - order[1]))


def rank(tier: Column) -> Column:
    return F.array_position(F.array(*(F.lit(t) for t in LADDER)), tier).cast("int") - 1


def most(a: Column, b: Column) -> Column:
    return F.when(rank(b) > rank(a), b).otherwise(a)


def bump(tier: Column) -> Column:
    return F.element_at(F.array(*(F.lit(t) for t in LADDER)), F.least(rank(tier) + 2, F.lit(4)))


def escalate(s: Column, least: float = 0.2) -> Column:
    """tier and escalated: a margin under ``least`` bumps the tier by one rung."""

    def of(tier: Column, close: Column) -> Column:
        return F.struct(F.when(close, bump(tier)).otherwise(tier).alias("tier"), close.alias("escalated"))

    return let(s, lambda x: of(argmax(x), margin(x) < least))


def route(tier: Column, remote: Column, local: Column, local_runs_here: Column, cohort_k: int = 1, wrapped: str = "safe") -> Column:
    """The decision table. remote, local: backend ids or null. Private content
    leaves only transformed; secrets stay on this machine or are withheld."""
    blended = F.concat(F.lit("cohort(" if cohort_k > 1 else f"{wrapped}("), remote, F.lit(")"))
    backend = F.when(tier.isin("public", "internal"), F.coalesce(remote, local)).when(tier == "private", F.coalesce(blended, local)).when(local_runs_here & local.isNotNull(), local)
    withheld = (tier == "secret") & ~F.coalesce(local_runs_here & local.isNotNull(), F.lit(False))
    return F.struct(
        tier.alias("tier"),
        backend.alias("backend_id"),
        ((tier == "private") & remote.isNotNull()).alias("transformed"),
        withheld.alias("withheld"),
        F.when(backend.isNull() & ~withheld, F.concat(F.lit("no backend for "), tier)).alias("error"),
    )


def guard(messages: DataFrame, injected: Column | None = None) -> DataFrame:
    """conv_id and violation: the first message by turn that may not leave raw
    (1 secret, 2 private), or null. injected: whether a guard of the caller's
    holds a message without a tier to be secret."""
    bad = F.when(F.col("tier") == "secret", 1).when(F.col("tier") == "private", 2)
    if injected is not None:
        bad = bad.when(F.col("tier").isNull() & injected, 1)
    return messages.groupBy("conv_id").agg(F.min_by(bad, F.when(bad.isNotNull(), F.col("turn"))).alias("violation"))


def with_presence(text: Column, spans: Column) -> Column:
    """Secret stays; any span makes a text private."""
    return let(scores(text), lambda s: F.when(argmax(s) == "secret", s).when(F.size(spans) > 0, _scores(0.0, 0.0, 1.0, 0.0)).otherwise(s))


def trace(route_: Column, escalated: Column) -> Column:
    """What a caller may inspect of a decision: a withheld prompt has no backend."""
    out = route_["withheld"]
    return F.struct(
        route_["tier"].alias("tier"),
        out.alias("withheld"),
        escalated.alias("escalated"),
        F.when(~out, route_["backend_id"]).alias("backend_id"),
        F.when(~out, route_["transformed"]).alias("transformed"),
    )


def read_files(files: DataFrame, entities_: DataFrame) -> DataFrame:
    """What a model may read of files (session_id, path, text, spans): path, text
    and withheld. A file with a credential is withheld whole, others are
    pseudonymised."""
    from .rewrite import pseudonymise

    safe = pseudonymise(files, entities_).withColumn("withheld", argmax(scores(F.col("text"))) == "secret")
    mark = F.concat(F.lit("[withheld: "), F.col("path"), F.lit(" holds a credential]"))
    return safe.select("session_id", "path", F.when(F.col("withheld"), mark).otherwise(F.col("safe")).alias("text"), "withheld")


def withheld_or(text: Column, safe: Column, mark: str = "[withheld: secret]") -> Column:
    return F.when(argmax(scores(text)) == "secret", F.lit(mark)).otherwise(safe)


def zero_shot(labels: Column, values: Column) -> Column:
    """Scores by hypothesis to scores by tier, made to sum to 1 if they are off by more than 0.001."""
    by = F.map_from_arrays(labels, values)
    raw = [F.coalesce(F.try_element_at(by, F.lit(HYPOTHESES[t])), F.lit(0.0)) for t in LADDER]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    scale = F.when((F.abs(total - 1) > 1e-3) & (total > 0), total).otherwise(1.0)
    return _scores(*(r / scale for r in raw))


def fetched(front: Column, classified: Column) -> Column:
    """A fetched document's tier: the higher of its own mark and the class; private by default."""
    return most(F.coalesce(front, F.lit("public")), F.coalesce(classified, F.lit("private")))
