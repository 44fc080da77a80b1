"""Detection: text to arrays of spans, offsets in UTF-8 bytes, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import gathered, let
from ..functions.kinds import KINDS, LEARNED
from ..functions.patterns import SPANS, unicode

SPAN = "struct<start:int,end:int,kind:string,text:string>"
EMPTY = f"cast(array() as array<{SPAN}>)"
# Names of the deterministic detector, and labels of learned ones.
GAZETTEER = {"PERSON": ("Alice", "Bob", "Dr. Smith", "Smith", "Ayşe"), "LOCATION": ("Bangkok", "London", "Paris", "İstanbul"), "ORG": ("Acme", "OpenAI", "Anthropic", "Google")}
LABELS = {"person": "PERSON", "location": "LOCATION", "organization": "ORG", "email": "EMAIL", "file path": "PATH", "ip address": "IP", "url": "URL", "uuid": "UUID"}
SPOKEN = {"person": "PERSON", "name": "PERSON", "location": "LOCATION", "place": "LOCATION", "city": "LOCATION", "org": "ORG", "organization": "ORG", "company": "ORG", "email": "EMAIL", "url": "URL", "ip": "IP", "ip_address": "IP"}


RANKED = "array<struct<start:int,back:int,rank:int,kind:string,text:string>>"
#: What a text must hold for a pattern to match it: a plain substring, or a short pattern.
NEEDS = {"URL": "://", "EMAIL": "@", "PATH": "/", "IP": r"(?U)\d\.\d", "UUID": "-"}


def _walked(hits: Column, gaps: Column, kind: str, rank: int) -> Column:
    """Places of hits from what stands between them. ``back`` is the end below 0:
    rows in natural order are by start, longer first, then by rank."""

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.octet_length(pair["gaps"])
        end = start + F.octet_length(pair["hits"])
        return end, F.array(F.struct(start.alias("start"), (-end).alias("back"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), pair["hits"].alias("text")))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gaps"), hits.alias("hits"))
    return let(pairs, lambda p: gathered(p, F.lit(0), step, RANKED))


def _found(text: Column, kind: str, pattern: str, rank: int, need: str | None = None) -> Column:
    """All matches of one pattern, with its rank for ties. A text without ``need``
    isn't scanned; only one with a match is scanned again, for the gaps."""
    none = F.array().cast(RANKED)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(hits, lambda h: F.when(F.size(h) > 0, _walked(h, F.split(text, pattern, -1), kind, rank)).otherwise(none))
    if need is None:
        return found
    return F.when(text.rlike(need) if need.startswith("(?") else F.contains(text, F.lit(need)), found).otherwise(none)


def _span(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["kind"].alias("kind"), x["text"].alias("text"))


def _resolved(ranked: Column) -> Column:
    """Sorted by start, longer first; a span is kept if the last kept one has ended."""

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= end
        return F.when(free, -x["back"]).otherwise(end), F.when(free, F.array(_span(x))).otherwise(F.expr(EMPTY))

    return let(ranked, lambda r: F.when(F.size(r) <= 1, F.transform(r, _span)).otherwise(let(F.sort_array(r), lambda o: gathered(o, F.lit(-(1 << 31)), step, f"array<{SPAN}>"))))


def resolve(spans: Column) -> Column:
    """Overlap resolution of any span array (equal spans: the earlier in the array)."""
    return _resolved(F.transform(spans, lambda x, i: F.struct(x["start"].cast("int").alias("start"), (-x["end"].cast("int")).alias("back"), i.cast("int").alias("rank"), x["kind"].alias("kind"), x["text"].alias("text"))))


def detect(text: Column, patterns: Sequence[tuple[str, str]] = SPANS) -> Column:
    """Each pattern is scanned over the whole text on its own; overlaps are then
    resolved. Null text gives no spans."""
    needs = NEEDS if patterns is SPANS else {}
    return let(F.coalesce(text, F.lit("")), lambda t: _resolved(F.concat(*(_found(t, kind, unicode(p), i, needs.get(kind)) for i, (kind, p) in enumerate(patterns)))))


def gazetteer(text: Column, names: Mapping[str, Sequence[str]] = GAZETTEER, labels: Sequence[str] | None = None) -> Column:
    """Literal names, longest first at one place; no or empty labels mean all."""
    wanted = tuple(labels) if labels else LEARNED
    patterns = [(kind, re.escape(n)) for kind, row in names.items() if kind in wanted for n in row]
    if not patterns:
        return F.expr(EMPTY)
    names_of = [n for kind, row in names.items() if kind in wanted for n in row]
    return let(F.coalesce(text, F.lit("")), lambda t: _resolved(F.concat(*(_found(t, kind, p, i, n) for i, ((kind, p), n) in enumerate(zip(patterns, names_of, strict=True))))))


def fallback(primary: Column, secondary: Column) -> Column:
    """The secondary detector only where the first found nothing."""
    return let(primary, lambda p: F.when(F.size(p) > 0, p).otherwise(secondary))


def merge(primary: Column, secondary: Column) -> Column:
    """All primary spans and each secondary one that overlaps none, by start."""
    free = lambda p: F.filter(secondary, lambda x: ~F.exists(p, lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"])))
    return let(primary, lambda p: let(free(p), lambda f: F.when(F.size(f) == 0, p).otherwise(F.array_sort(F.concat(p, f)))))


def none_found() -> Column:
    return F.expr(EMPTY)


STRATEGIES: dict[str, Callable[[Column, Column], Column]] = {"regex": lambda learned, rx: rx, "learned": lambda learned, rx: learned, "learned_or_regex": fallback, "learned_and_regex": merge}


def detect_with(strategy: str, text: Column, learned: Column | None = None) -> Column:
    """Dispatch over detector strategies; ``learned`` defaults to the gazetteer."""
    return let(text, lambda t: STRATEGIES[strategy](gazetteer(t) if learned is None else learned, detect(t)))


def validate(text: Column, spans: Column) -> Column:
    """Learned spans: unknown kinds, empty or outside spans and spans that cut a
    character are dropped; the text is taken from the offsets; then overlaps."""
    data = F.encode(text, "UTF-8")
    whole = lambda at: (at == F.octet_length(text)) | ~F.hex(F.substring(data, at + 1, F.lit(1))).rlike("^[89AB]")
    ok = F.filter(spans, lambda x: x["kind"].isin(*KINDS) & (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.octet_length(text)) & whole(x["start"]) & whole(x["end"]))
    return resolve(F.transform(ok, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.decode(F.substring(data, x["start"] + 1, x["end"] - x["start"]), "UTF-8").alias("text"))))


def above(spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scored spans with a label that maps to a kind and a score that reaches the threshold."""
    kinds = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return spans.withColumn("kind", kinds[F.lower("label")]).filter(F.col("kind").isNotNull() & (F.col("score") >= threshold))


def byte_offset(text: Column, chars: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), chars))


def json_array(content: Column) -> Column:
    """From the first ``[`` to the last ``]``; null if there is none."""
    return F.nullif(F.regexp_extract(content, r"(?s)\[.*\]", 0), F.lit(""))


def reported(content: Column) -> Column:
    return F.coalesce(F.from_json(json_array(content), "array<struct<kind:string,text:string>>"), F.expr("cast(array() as array<struct<kind:string,text:string>>)"))


def _claims(text: str, items, every: bool) -> list[dict]:
    out: list[dict] = []
    for item in items if items is not None else []:
        sub = item["text"]
        kind = (item["kind"] or "").strip()
        kind = SPOKEN.get(kind.lower(), "PII") if every else kind.upper() if kind.upper() in KINDS else None
        at = 0
        while sub and kind and (at := text.find(sub, at)) >= 0:
            end = at + len(sub)
            start_b = len(text[:at].encode())
            span = {"start": start_b, "end": start_b + len(sub.encode()), "kind": kind, "text": sub}
            if every:
                out.append(span)
            elif not any(o["start"] < span["end"] and span["start"] < o["end"] for o in out):
                out.append(span)
                break
            at = end if every else at + 1
    return out


def _locator(every: bool):
    @F.pandas_udf(f"array<{SPAN}>")
    def locate(text: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([_claims(t or "", i, every) for t, i in zip(text, items, strict=True)])

    return locate


def locate_reported(text: Column, content: Column, every: bool = False) -> Column:
    """Spans that a model reported as JSON. Each report claims the first place
    not claimed yet, or with ``every`` all places (unknown kinds then are PII);
    what the text doesn't hold is dropped."""
    fenced = F.trim(F.regexp_replace(content, r"(?m)^```(json)?|```$", "")) if every else content
    return resolve(_locator(every)(text, reported(fenced)))


def with_model(rows: DataFrame, model: Callable[[list[str]], list[list[dict]]], text_col: str = "text", out: str = "spans") -> DataFrame:
    """Spans by an injected model, in Arrow batches; a batch that fails has none."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, `{out}` array<{SPAN}>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                found = model(pdf[text_col].fillna("").tolist())
            except Exception:  # noqa: BLE001 - a detector that fails degrades to no spans
                found = [[] for _ in range(len(pdf))]
            yield pdf.assign(**{out: found})

    return rows.mapInPandas(run, schema)


def tagged(label: Column) -> Column:
    """Kinds of token-classification labels; null for the rest."""
    bare = F.regexp_replace(F.upper(label), "^[BI]-", "")
    return F.when(bare.isin("PER", "PERSON"), "PERSON").when(bare.isin("ORG", "ORGANIZATION"), "ORG").when(bare.isin("LOC", "LOCATION"), "LOCATION")


def tagged_spans(text: Column, tokens: Column) -> Column:
    """Spans of an injected token classifier. tokens: array of label, score, start
    and end in characters. Unknown labels and places outside the text go; the
    rest is numbered by kind, each occurrence anew, in the model's order."""
    kept = F.filter(
        F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), tagged(x["label"]).alias("kind"), x["score"].alias("score"))),
        lambda x: x["kind"].isNotNull() & (x["start"] >= 0) & (x["end"] > x["start"]) & (x["end"] <= F.length(text)),
    )
    number = lambda k, x, i: F.size(F.filter(F.slice(k, F.lit(1), i + 1), lambda y: y["kind"] == x["kind"]))
    return let(kept, lambda k: F.transform(k, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["score"].alias("score"), F.concat_ws("_", x["kind"], number(k, x, i).cast("string")).alias("replacement"), F.lit("ner").alias("source"))))
