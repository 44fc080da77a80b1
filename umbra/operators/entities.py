"""Session state: normalised surfaces, minted pseudonyms and lookups, set by set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import HONORIFIC, unicode


def normalise(surface: Column, kind: Column) -> Column:
    """Persons: trimmed, lower-cased, one honorific stripped; other kinds as they are."""
    bare = lambda c: F.regexp_replace(c, unicode(r"^\s+|\s+$"), "")
    return F.when(kind == "PERSON", bare(F.regexp_replace(F.lower(bare(surface)), unicode(HONORIFIC), ""))).otherwise(surface)


def explode_spans(rows: DataFrame, spans: str = "spans") -> DataFrame:
    """session_id, seq, ord, start, end, kind, text and norm of each span."""
    out = rows.select("session_id", "seq", F.posexplode_outer(spans).alias("ord", "s")).filter("ord is not null").select("session_id", "seq", "ord", "s.start", "s.end", "s.kind", "s.text")
    return out.withColumn("norm", normalise(F.col("text"), F.col("kind")))


def first_seen(spans: DataFrame) -> DataFrame:
    """session_id, norm, kind, canonical and at (seq and ord) of each surface's
    first occurrence; where rows share a seq, the smaller kind and text is it."""
    first = spans.groupBy("session_id", "norm").agg(F.min(F.struct("seq", "ord", "kind", "text")).alias("f"))
    return first.select("session_id", "norm", "f.kind", F.col("f.text").alias("canonical"), F.struct("f.seq", "f.ord").alias("at"))


def mint(spans: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """session_id, norm, kind, n, pseudonym, canonical: first seen, first numbered,
    by session and kind. The key is the surface alone: a surface seen again under
    another kind keeps its first pseudonym. ``prior``: a table minted before,
    whose surfaces and counters go on. A null session is a session. Only first
    occurrences are shuffled."""
    first = first_seen(spans)
    order = F.row_number().over(Window.partitionBy("session_id", "kind").orderBy("at", "norm"))
    if prior is None:
        fresh = first.withColumn("n", order)
    else:
        most = prior.groupBy("session_id", "kind").agg(F.max("n").alias("most"))
        most = most.toDF("of", "of_kind", "most")
        known = prior.select(F.col("session_id").alias("of"), F.col("norm").alias("seen"))
        new = first.join(known, F.col("session_id").eqNullSafe(F.col("of")) & (F.col("norm") == F.col("seen")), "left_anti").withColumn("i", order)
        fresh = new.join(most, F.col("session_id").eqNullSafe(F.col("of")) & (F.col("kind") == F.col("of_kind")), "left").withColumn("n", (F.col("i") + F.coalesce("most", F.lit(0))).cast("int"))
    columns = ("session_id", "norm", "kind", "n", "pseudonym", "canonical")
    out = fresh.withColumn("pseudonym", F.concat_ws("_", "kind", F.col("n").cast("string"))).select(*columns)
    return out if prior is None else prior.select(*columns).unionByName(out)


def real_for(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``real``, the first-seen surface of (session_id, pseudonym), or null."""
    known = entities.select(F.col("session_id").alias("of"), F.col("pseudonym").alias("p"), F.col("canonical").alias("real"))
    return rows.join(known, rows["session_id"].eqNullSafe(F.col("of")) & (rows["pseudonym"] == F.col("p")), "left").drop("of", "p")


def pseudonym_for(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``pseudonym`` of (session_id, surface): the exact surface, else as a person."""
    asked = rows.withColumn("keys", F.array("surface", normalise(F.col("surface"), F.lit("PERSON"))))
    named = looked_up(asked, F.col("keys"), entities, "norm", "pseudonym", "found")
    return named.withColumn("pseudonym", F.coalesce(*(F.try_element_at("found", F.get("keys", F.lit(i))) for i in (0, 1)))).drop("keys", "found")


def looked_up(rows: DataFrame, keys: Column, entities: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """rows with ``out``, a map from those of the row's own ``keys`` (an array) that
    its session's entities have in ``key`` to their ``value``; null where it has none.

    Rows that ask the same of the same session share one answer, found by what
    they ask, so that rows may repeat in any column. A null session is a
    session. Rows that ask nothing aren't shuffled, and no task holds a session.
    """
    wide = rows.drop(out).withColumn("umbra_keys", F.array_sort(F.array_distinct(F.filter(keys, lambda x: x.isNotNull()))))
    asks = F.coalesce(F.size("umbra_keys") > 0, F.lit(False))
    asked = wide.filter(asks).select(F.col("session_id").alias("umbra_of"), F.col("umbra_keys").alias("umbra_asked")).distinct()
    each = asked.select("*", F.explode("umbra_asked").alias("umbra_key"))
    known = entities.select(F.col("session_id").alias("umbra_session"), F.col(key).alias("umbra_known"), F.col(value).alias("umbra_value"))
    met = each.join(known, F.col("umbra_of").eqNullSafe(F.col("umbra_session")) & (F.col("umbra_key") == F.col("umbra_known")))
    answers = met.groupBy("umbra_of", "umbra_asked").agg(F.map_from_entries(F.collect_list(F.struct("umbra_key", "umbra_value"))).alias(out))
    answered = wide.filter(asks).join(answers, F.col("session_id").eqNullSafe(F.col("umbra_of")) & (F.col("umbra_keys") == F.col("umbra_asked")), "left")
    rest = wide.filter(~asks).withColumn(out, F.lit(None).cast(answers.schema[out].dataType))
    return answered.drop("umbra_of", "umbra_asked", "umbra_keys").unionByName(rest.drop("umbra_keys"))


def counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("session_id").agg(F.count_distinct("pseudonym").alias("entities"))


def evict(calls: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Sessions idle for at least ``ttl``; 0 keeps all. Every call counts as use."""
    last = calls.groupBy("session_id").agg(F.max("at").alias("last_used"))
    return last.withColumn("evicted", (F.lit(ttl) > 0) & (now - F.col("last_used") >= ttl))


def incarnations(calls: DataFrame, ttl: int) -> DataFrame:
    """Adds ``incarnation``: a gap of ``ttl`` or more starts the session anew."""
    order = Window.partitionBy("session_id").orderBy("at", "seq")  # streamed: a session's rows are sorted, not held
    gap = F.coalesce((F.col("at") - F.lag("at").over(order) >= ttl).cast("int"), F.lit(0))
    return calls.withColumn("gap", gap).withColumn("incarnation", F.sum("gap").over(order)).drop("gap")


def forget(entities: DataFrame, sessions: DataFrame) -> DataFrame:
    """Without the given sessions (a null one too)."""
    gone = sessions.select(F.col("session_id").alias("of")).distinct()
    return entities.join(gone, F.col("session_id").eqNullSafe(F.col("of")), "left_anti")
