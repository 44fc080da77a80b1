"""Secret scans by one combined deterministic automaton.

All rules are compiled into one automaton that reads texts from their end: where
it accepts, a match of that rule starts. One pass over the bytes of a batch so
gives every start of every rule. Bytes after which the automaton is always at
its start part the batch into segments, which are read in step: one array lookup
moves every segment by a byte. Matches are then taken from the left: each ends
where its last class of bytes does, and the next one is the first start behind
it, so that no byte is read again for a match that fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Dfa
from .shingles import slices


@dataclass(frozen=True)
class Rule:
    """A match is ``head``, then one byte or more of the class ``tail`` (none if
    that is empty). No byte of ``tail`` may go on a head that has ended. It
    counts if it has at least ``least`` bytes, or if its tail has (``of_tail``).
    Matches with a tail shorter than ``few`` needn't be found; as ``few`` bytes
    multiply the automaton's states, only one rule without a head has it."""

    kind: str
    head: str
    tail: str
    least: int
    of_tail: bool = False
    few: int = 1

    @property
    def scan(self) -> str:
        """What starts where a match starts."""
        return self.head + self.tail + (f"{{{self.few}}}" if self.few > 1 else "")


_WORD = r"[A-Za-z0-9_\-]"
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]", 12, of_tail=True),
    Rule("access", "AKIA", "[A-Z0-9]", 18),
    Rule("hex", "", "[0-9a-f]", 16, few=16),
)
#: Public token formats, beside the base rules.
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 40),
    Rule("slack", "xox[abprs]-", r"[A-Za-z0-9\-]", 15),
    Rule("google", "AIza", _WORD, 39),
    Rule("stripe", "[sr]k_(live|test)_", "[A-Za-z0-9]", 24),
    Rule("jwt", rf"eyJ{_WORD}+\.eyJ{_WORD}+\.", _WORD, 30),
    Rule("pem", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", "", 27),
)

#: Segments longer than this are read alone, byte by byte; shorter ones in step.
LONG = 4096


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.dfa = Dfa([r.scan for r in rules], anywhere=True, back=True)
        self.reset = self.dfa.reset_bytes()
        self.reset[10] = True  # stands between texts; no rule spans lines
        self.rows, self.bits = self.dfa.plain()
        self.heads = [Dfa([r.head], anywhere=False) if r.head else None for r in rules]
        one = [Dfa([r.tail], anywhere=False) if r.tail else None for r in rules]
        self.tails = [None if d is None else np.array([d.accepts[d.table[0, k]] > 0 for k in d.kind]) for d in one]

    def starts(self, raw: np.ndarray, block: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
        """Places where matches start, ascending, and which rules' (as bits)."""
        flat, width, accepts = self.dfa.table.ravel(), self.dfa.width, self.dfa.accepts.astype(np.int32)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ~self.reset[raw], [False]]).view(np.int8)))
        first, last = edge[::2], edge[1::2] - 1
        size = last - first + 1
        some = size >= min(min(r.least, 16) for r in self.rules)
        first, last, size = first[some], last[some], size[some]
        places, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for a, b in zip(first[size > LONG].tolist(), last[size > LONG].tolist(), strict=True):
            state, rows, bits, at, rules = 0, self.rows, self.bits, [], []
            for i, byte in zip(range(b, a - 1, -1), raw[a : b + 1][::-1].tobytes()):
                state = rows[state][byte]
                if bits[state]:
                    at.append(i)
                    rules.append(bits[state])
            places.append(np.array(at, np.int64))
            seen.append(np.array(rules, np.int32))
        last, size = last[size <= LONG], size[size <= LONG]
        order = np.argsort(-size, kind="stable")
        last, size = last[order], size[order]
        kinds = self.dfa.kind[raw]
        for a in range(0, len(last), block):
            at, n = last[a : a + block], size[a : a + block]
            state = np.zeros(len(at), np.int32)
            for j, m in enumerate(len(at) - np.searchsorted(n[::-1], np.arange(int(n[0])), side="right")):
                state[:m] = flat[state[:m] * width + kinds[at[:m] - j]]
                hit = accepts[state[:m]]
                if hit.any():
                    k = np.flatnonzero(hit)
                    places.append(at[k] - j)
                    seen.append(hit[k])
        place, bits = np.concatenate(places), np.concatenate(seen)
        order = np.argsort(place, kind="stable")
        return place[order], bits[order]

    def spans(self, data: bytes, starts: np.ndarray, rule: int) -> list[tuple[int, int]]:
        """Leftmost matches of a rule that do not overlap, of those that start at
        ``starts``; short ones are dropped after they took their place."""
        head, tail, of, out, i = self.heads[rule], self.tails[rule], self.rules[rule], [], 0
        stops = None if tail is None else np.append(np.flatnonzero(~tail[np.frombuffer(data, np.uint8)]), len(data))
        while i < len(starts):
            at = int(starts[i])
            mid = head.longest(data, at) if head else at
            end = mid if stops is None else int(stops[np.searchsorted(stops, mid)])
            if end - (mid if of.of_tail else at) >= of.least:
                out.append((at, end))
            i = int(np.searchsorted(starts, end))
        return out

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, end, rule) of each text in code points, by start, then rule."""
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        place, bits = self.starts(raw)
        row = np.searchsorted(begin, place, side="right") - 1
        edge = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            r = int(row[a])
            own, seen, data = place[a:b] - begin[r], bits[a:b], parts[r]
            found = [(s, e, k) for k in range(len(self.rules)) if (seen >> k & 1).any() for s, e in self.spans(data, own[(seen >> k & 1) > 0], k)]
            if not data.isascii():  # characters before each byte
                chars = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
                found = [(int(chars[s]), int(chars[e]), k) for s, e, k in found]
            out[r] = sorted(found, key=lambda y: (y[0], y[2]))
        return out


@lru_cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Secrets of every whole text.

    Returns the input's columns and ``secrets``: an array of kind, start, end
    (code points, end exclusive), by start, then in the rules' order; it
    replaces a column of that name. Null and empty texts have none; rows that
    repeat are each scanned; an empty table gives no rows. Rules take ASCII
    bytes only.
    """
    docs = docs.withColumn("text", F.col("text").cast("string")).drop("secrets")
    kinds = "array<struct<kind: string, start: int, end: int>>"
    schema = T.StructType([*docs.schema.fields, T.StructField("secrets", T._parse_datatype_string(kinds))])
    of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    scan = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # its size depends on the rules alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = scan.value.batch(part.column("text").to_pylist())
                rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in x] for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, of)], names=schema.names)

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The input's columns with secrets replaced by ``mark`` in ``text``; overlapping
    spans are one. Null text stays null; empty texts and tables stay as they are."""
    found = find_secrets(docs, rules)
    put = F.aggregate(
        "secrets",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(
            F.struct(
                F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).alias("out"),
                x["end"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return found.withColumn("text", F.when(F.size("secrets") > 0, put).otherwise(F.col("text"))).drop("secrets")
