"""Regular expressions to one deterministic automaton: Thompson construction,
subset construction, minimisation by partition refinement, and arrays."""

from __future__ import annotations

import numpy as np

ANY = frozenset(range(256))


class Nfa:
    """States are numbers; ``step[s]`` has (bytes, to) and ``free[s]`` moves without a byte."""

    def __init__(self):
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1


class _Parser:
    """Literals, classes, groups, ``(?i:...)``, ``|``, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``."""

    def __init__(self, nfa: Nfa, pattern: str, back: bool = False):
        self.nfa, self.p, self.i, self.fold, self.back = nfa, pattern, 0, False, back

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def either(self):
        parts = [self.row()]
        while self.peek() == "|":
            self.take()
            parts.append(self.row())
        if len(parts) == 1:
            return parts[0]

        def build(a: int) -> int:
            end = self.nfa.state()
            for part in parts:
                s = self.nfa.state()
                self.nfa.free[a].append(s)
                self.nfa.free[part(s)].append(end)
            return end

        return build

    def row(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        if self.back:
            parts.reverse()

        def build(a: int) -> int:
            for part in parts:
                a = part(a)
            return a

        return build

    def repeated(self):
        atom, c = self.atom(), self.peek()
        if c in ("?", "*", "+"):
            self.take()
            low, high = (0, 1) if c == "?" else (int(c == "+"), None)
        elif c == "{":
            body = self.p[self.i + 1 : self.p.index("}", self.i)]
            self.i += len(body) + 2
            a, comma, b = body.partition(",")
            low, high = int(a), (int(b) if b else None) if comma else int(a)
        else:
            return atom
        nfa = self.nfa

        def build(a: int) -> int:
            for _ in range(low):
                a = atom(a)
            if high is None:
                loop = nfa.state()
                nfa.free[a].append(loop)
                nfa.free[atom(loop)].append(loop)
                return loop
            end = nfa.state()
            for _ in range(high - low):
                nfa.free[a].append(end)
                a = atom(a)
            nfa.free[a].append(end)
            return end

        return build

    def atom(self):
        c = self.take()
        if c == "(":
            before = self.fold
            if self.p.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            inner = self.either()
            self.take()
            self.fold = before
            return inner
        chosen = self.chosen() if c == "[" else frozenset([self.escaped()]) if c == "\\" else frozenset([ord(c)])
        if self.fold:
            chosen |= {b ^ 32 for b in chosen if 65 <= b & ~32 <= 90}
        nfa = self.nfa

        def build(a: int) -> int:
            b = nfa.state()
            nfa.step[a].append((chosen, b))
            return b

        return build

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def chosen(self) -> frozenset[int]:
        out: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                c = self.take()
                out |= set(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                out.add(low)
        return frozenset(out)


class Dfa:
    """``table[state * width + kind[byte]]`` is the next state times nothing else;
    ``accepts[state]`` has a bit for each pattern. State 0 is the start. ``back``:
    the automaton reads texts from their end, and accepts where a match starts."""

    def __init__(self, patterns: list[str], anywhere: bool, back: bool = False):
        nfa = Nfa()
        start, ends = nfa.state(), {}
        for k, pattern in enumerate(patterns):
            s = nfa.state()
            nfa.free[start].append(s)
            parser = _Parser(nfa, pattern, back)
            ends[parser.either()(s)] = 1 << k
        if anywhere:
            nfa.step[start].append((ANY, start))
        sets = sorted({c for step in nfa.step for c, _ in step}, key=sorted)
        marks = [tuple(b in c for c in sets) for b in range(256)]
        kinds = {m: i for i, m in enumerate(dict.fromkeys(marks))}
        self.kind = np.array([kinds[m] for m in marks], np.uint8)
        one = [marks.index(m) for m in kinds]

        def closed(states) -> frozenset[int]:
            out, todo = set(states), list(states)
            while todo:
                for x in nfa.free[todo.pop()]:
                    if x not in out:
                        out.add(x)
                        todo.append(x)
            return frozenset(out)

        at, rows = {closed([start]): 0}, []
        todo = list(at)
        for now in todo:  # grows while it runs
            row = []
            for b in one:
                to = closed({x for s in now for c, x in nfa.step[s] if b in c})
                if to not in at:
                    at[to] = len(at)
                    todo.append(to)
                row.append(at[to])
            rows.append(row)
        accepts = [0] * len(at)
        for states, i in at.items():
            for s in states & ends.keys():
                accepts[i] |= ends[s]
        self._minimise(np.array(rows), np.array(accepts))

    def _minimise(self, rows: np.ndarray, accepts: np.ndarray) -> None:
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            _, first, new = np.unique(np.column_stack([block, block[rows]]), axis=0, return_index=True, return_inverse=True)
            new = new.ravel()
            if len(first) == block.max() + 1:
                break
            block = new
        order = np.argsort(np.where(np.arange(len(first)) == new[0], -1, np.arange(len(first))))
        rank = np.argsort(order)
        self.table = rank[new[rows[first[order]]]].astype(np.int32)
        self.accepts = accepts[first[order]]
        self.width = self.table.shape[1]

    def reset_bytes(self) -> np.ndarray:
        """Bytes after which nothing before them matters."""
        return np.array([bool((self.table[:, k] == 0).all()) for k in self.kind])

    def plain(self) -> tuple[list[list[int]], list[int]]:
        """The table by state and byte, and what states accept, as lists."""
        kind = self.kind.tolist()
        return [[int(r[k]) for k in kind] for r in self.table], self.accepts.tolist()

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``, or -1. Not for ``anywhere``."""
        if not hasattr(self, "rows"):
            self.rows, self.ok = self.plain()
            live = self.accepts > 0
            while (more := live | live[self.table].any(axis=1)).sum() > live.sum():
                live = more
            self.live = live.tolist()
        state, end = 0, at if self.ok[0] else -1
        for i in range(at, len(data)):
            state = self.rows[state][data[i]]
            if self.ok[state]:
                end = i + 1
            elif not self.live[state]:
                break
        return end
