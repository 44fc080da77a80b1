"""k-anonymous cohorts: siblings of a prompt with other pseudonyms or other words."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.patterns import OPEN_PSEUDONYM, PSEUDONYM, unicode
from .convo import answered
from .rewrite import mapped, reverse

POOL, BASE = 16, 10001
# Templates by profile of kinds.
DECOYS = {
    "EMAIL": ("draft a reply to {EMAIL}", "did {EMAIL} get back to us", "add {EMAIL} to the invite", "follow up with {EMAIL} tomorrow"),
    "PATH": ("review the diff in {PATH}", "the backup is at {PATH}", "archive {PATH} when done", "what changed in {PATH}"),
    "PERSON": ("sync with {PERSON} this week", "{PERSON} approved the plan", "ask {PERSON} for an update", "{PERSON} is out of office"),
    "URL": ("the spec is at {URL}", "{URL} is returning errors", "summarize {URL} for me", "is {URL} still live"),
    "IP": ("{IP} is unreachable", "add {IP} to the allowlist", "trace traffic from {IP}", "ping {IP} and report back"),
    "LOCATION": ("the {LOCATION} office is closed today", "roll out to {LOCATION} next", "book a room in {LOCATION}", "the team in {LOCATION} is blocked"),
    "ORG": ("the {ORG} renewal is due", "{ORG} raised a support ticket", "draft a proposal for {ORG}", "{ORG} wants a demo"),
    "UUID": ("look up record {UUID}", "{UUID} failed validation", "retry job {UUID}", "trace request {UUID}"),
    "EMAIL|PATH": ("send {PATH} to {EMAIL}", "{EMAIL} asked for the file at {PATH}", "attach {PATH} and email {EMAIL}"),
    "EMAIL|PERSON": ("tell {PERSON} to email {EMAIL}", "cc {PERSON} at {EMAIL}", "{PERSON} can be reached at {EMAIL}"),
    "LOCATION|PERSON": ("{PERSON} is flying to {LOCATION}", "meet {PERSON} in {LOCATION}", "{PERSON} relocated to {LOCATION}"),
    "ORG|PERSON": ("{PERSON} just joined {ORG}", "{PERSON} handles the {ORG} account", "introduce {PERSON} to {ORG}"),
    "EMAIL|URL": ("email the link {URL} to {EMAIL}", "{EMAIL} shared {URL}"),
    "IP|URL": ("{URL} resolves to {IP}", "{IP} is hosting {URL}"),
}


def entities(text: Column) -> Column:
    """Distinct pseudonyms in order of their first place, typed ones too."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(unicode(PSEUDONYM)), F.lit(0)))


def kind_of(pseudonym: Column) -> Column:
    return F.split_part(pseudonym, F.lit("_"), F.lit(1))


def profile(names: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(names, kind_of)), "|")


def entities_of(surfaces: DataFrame) -> DataFrame:
    """Distinct pseudonyms of several surfaces (session_id, seq, text) in order of
    their first place: session_id, ord (from 0), pseudonym and kind."""
    each = surfaces.select("session_id", "seq", F.posexplode_outer(entities(F.col("text"))).alias("i", "pseudonym")).filter("i is not null")
    first = each.groupBy("session_id", "pseudonym").agg(F.min(F.struct("seq", "i")).alias("at"))
    order = Window.partitionBy("session_id").orderBy("at", "pseudonym")
    return first.select("session_id", (F.row_number().over(order) - 1).alias("ord"), "pseudonym", kind_of(F.col("pseudonym")).alias("kind"))


def collision(entities_: DataFrame) -> DataFrame:
    """Whether a session has minted a name of the pool."""
    return entities_.groupBy("session_id").agg(F.coalesce(F.bool_or((F.col("n") >= BASE) & (F.col("n") < BASE + POOL)), F.lit(False)).alias("collides"))


def capacity(prompts: DataFrame, k: int, pool: dict[str, int] | None = None) -> DataFrame:
    """needed and available of each (session_id, seq, kind), whether the pool is
    exhausted and the error: KindUnsupported where it has none of the kind,
    PoolExhausted where it has too few. pool: entries by kind (default: 16 each)."""
    each = prompts.select("session_id", "seq", F.explode_outer(entities(F.col("safe"))).alias("p")).filter("p is not null").groupBy("session_id", "seq", kind_of(F.col("p")).alias("kind")).agg(F.count("*").alias("n"))
    has = F.lit(POOL) if pool is None else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in pool.items() for x in kv)), F.col("kind")), F.lit(0))
    sized = each.select("session_id", "seq", "kind", ((k - 1) * F.col("n")).alias("needed"), has.cast("long").alias("available"))
    short = F.col("needed") > F.col("available")
    return sized.withColumns({"exhausted": short, "error": F.when(short & (F.col("available") == 0), "KindUnsupported").when(short, "PoolExhausted")})


def _index(names: Column, i: Column) -> Column:
    """How many of the same kind come before the i-th name."""
    return F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: kind_of(x) == kind_of(F.get(names, i))))


def sibling(names: Column, j: Column, k: int) -> Column:
    """Names of the j-th sibling: of the i-th entity of a kind, pool entry i * (k-1) + j."""
    return F.transform(names, lambda x, i: F.concat(kind_of(x), F.lit("_"), (F.lit(BASE) + _index(names, i) * (k - 1) + j).cast("string")))


def fits(names: Column, k: int) -> Column:
    return ~F.exists(names, lambda x: (k - 1) * F.size(F.filter(names, lambda y: kind_of(y) == kind_of(x))) > POOL)


def _first(names: Column, kind: str) -> Column:
    return F.get(F.filter(names, lambda x: kind_of(x) == kind), F.lit(0))


def _decoy(j: Column, names: Column) -> Column:
    """The filled template of the names' profile, or null where there is none."""

    def filled(row: tuple[str, ...], kinds: list[str]) -> Column:
        template = F.element_at(F.array(*map(F.lit, row)), (j % len(row)).cast("int") + 1)
        for kind in kinds:
            template = F.replace(template, F.lit("{" + kind + "}"), _first(names, kind))
        return template

    def of(profile_: Column) -> Column:
        out = F
        for key, row in DECOYS.items():
            out = out.when(profile_ == key, filled(row, key.split("|")))
        return out

    return let(profile(names), of)


def cohort(prompts: DataFrame, k: int, entities_: DataFrame | None = None, hide_content: bool = False) -> DataFrame:
    """Rows (session_id, seq, member, text, requested_k, achieved_k): member 0 is
    the prompt. Without room in the pool, or if the session has minted one of its
    names, the prompt stays alone; a prompt without entities has k equal texts.
    A null session is a session; null text gives null members."""
    rows = prompts.select("session_id", "seq", "safe")
    if entities_ is not None:
        clash = collision(entities_).filter("collides").select(F.col("session_id").alias("of"), "collides")
        rows = rows.join(clash, F.col("session_id").eqNullSafe(F.col("of")), "left").drop("of")
    free = ~F.coalesce("collides", F.lit(False)) if entities_ is not None else F.lit(True)

    def text_of(safe: Column, names: Column, j: Column) -> Column:
        def other(new: Column) -> Column:
            renumbered = mapped(safe, F.map_from_arrays(names, new))
            return F.coalesce(_decoy(j, new), renumbered) if hide_content else renumbered

        return let(sibling(names, j, k), other)

    def members(names: Column) -> Column:
        size = F.when(free & F.lit(k > 1) & fits(names, k), F.lit(k)).otherwise(F.lit(1))
        row = lambda m, n: F.struct(m.alias("member"), F.when(m == 0, F.col("safe")).otherwise(text_of(F.col("safe"), names, m - 1)).alias("text"), n.alias("achieved_k"))
        return let(size, lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda m: row(m, n)))

    made = rows.select("session_id", "seq", F.explode_outer(let(F.coalesce(entities(F.col("safe")), F.array().cast("array<string>")), members)).alias("m"))
    return made.select("session_id", "seq", "m.member", "m.text", F.lit(k).alias("requested_k"), "m.achieved_k")


def entropy(cohorts: DataFrame) -> DataFrame:
    return cohorts.groupBy("session_id", "seq").agg(F.log2(F.count_distinct("text").cast("double")).alias("bits"))


def run_key() -> str:
    """A key that nobody can guess, for one run; tasks that run again use the same."""
    return token_hex(32)


def _drawn(key: str, *of) -> Column:
    """A number below 2^60 that only the key's holder can compute."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\0", F.lit(key), *(F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in of)), 256), 1, 15), 16, 10).cast("long")


def scramble(cohorts: DataFrame, key: str | None = None, size: int = 1_000_000) -> DataFrame:
    """Renumbers every token of the open grammar within a cohort by numbers from 1
    to ``size``, distinct by kind. Adds ``scrambled`` and ``back``, the map that
    undoes it for the row's own tokens.

    Numbers are drawn by a keyed hash of the token; of m tokens the i-th by that
    draw gets its draw modulo ``size - m + 1``, sorted, plus i, so that none
    collide and none tells another. key: default a fresh secret. A null session
    or seq is a value like others; null text stays null.
    """
    key = key or run_key()
    tokens = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(OPEN_PSEUDONYM), F.lit(0))
    each = cohorts.select("session_id", "seq", F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("t")).filter("t is not null").distinct().withColumn("kind", kind_of(F.col("t")))
    of = Window.partitionBy("session_id", "seq", "kind")
    low = F.pmod(_drawn(key, "session_id", "seq", "t"), F.greatest(F.lit(size) - F.count("*").over(of) + 1, F.lit(1)))
    drawn = each.withColumn("low", low)
    to = F.concat_ws("_", "kind", (F.col("low") + F.row_number().over(of.orderBy("low", _drawn(key, "t", "session_id", "seq")))).cast("string"))
    maps = drawn.withColumn("to", to).groupBy(F.col("session_id").alias("of_session"), F.col("seq").alias("of_seq")).agg(F.map_from_entries(F.collect_list(F.struct("t", "to"))).alias("forth"))
    met = cohorts.join(maps, F.col("session_id").eqNullSafe(F.col("of_session")) & F.col("seq").eqNullSafe(F.col("of_seq")), "left").drop("of_session", "of_seq")
    own = lambda c: F.map_from_entries(F.transform(F.array_distinct(tokens(c)), lambda t: F.struct(F.element_at("forth", t), t)))
    return met.withColumns({"scrambled": mapped(F.col("text"), F.col("forth"), OPEN_PSEUDONYM), "back": own(F.col("text"))}).drop("forth")


def shuffled(cohorts: DataFrame, key: str) -> DataFrame:
    """Adds ``position`` (from 0) in a keyed permutation of each cohort."""
    order = Window.partitionBy("session_id", "seq").orderBy(_drawn(key, "session_id", "seq", "member"), "member")
    return cohorts.withColumn("position", F.row_number().over(order) - 1)


def fan_out(cohorts: DataFrame, model, entities_: DataFrame, key: str | None = None) -> DataFrame:
    """Sends every member to an injected model (texts to replies), keeps the real
    one's reply, undoes the scramble and restores surfaces: ``answer``. key:
    default a fresh secret, so that neither numbers nor places can be guessed."""
    key = key or run_key()
    sent = answered(shuffled(scramble(cohorts, key), key), model, "scrambled")
    real = sent.filter("member = 0").withColumn("reply", mapped(F.col("reply"), F.col("back"), OPEN_PSEUDONYM))
    return reverse(real, entities_, "reply", "answer").select("session_id", "seq", "position", "answer")
