"""Secret scans by one deterministic automaton for all rules.

Rule patterns are parsed to small trees, joined into one non-deterministic
automaton, made deterministic by subset construction and minimised. The scan
follows one transition for each byte of the UTF-8 text, for all rules at once.
Wherever the automaton is back in its start state no rule is half matched, so
text between two such places that held a hit is a closed segment; each rule's
own (equally built) automaton then fixes leftmost non-overlapping longest spans
in that segment alone.

Patterns use literals, \\xNN, classes, groups, alternatives, ?, *, + and {m,} or {m}.
A rule whose pattern ordinary words would meet joins the combined automaton with
its least length written out as repetition (``hit``); the final spans use the
pattern as given and drop those that fail the length.

Cases: null and empty texts have no spans; very long texts are scanned whole, in
memory of that of one text; offsets count code points; equal texts have equal
spans; of rules that match at one place each has its span, in the order of the
rules; rows that repeat a doc_id have a row of spans each; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from cairn.llm.shared import id_text, map_rows


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int = 0  # length of the value
    head: str = ""  # what precedes the value
    hit: str = ""  # a pattern that every kept match holds to its end, where the pattern itself is met everywhere
    fold: bool = False  # letters in either case
    base: bool = False


_HEAD, _VALUE = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]"
#: The three base rules, and public token formats.
RULES = (
    Rule("assign", _HEAD + _VALUE + "+", 6, _HEAD, fold=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]+", 24, hit=r"[0-9a-f]{8,}", base=True),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]+", 34),
    Rule("chat", r"xox[abprs]\-[A-Za-z0-9\-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_.\-]+", 40),
    Rule("pem", r"\-\-\-\-\-BEGIN [A-Z ]*PRIVATE KEY\-\-\-\-\-"),
)


def parse(pattern: str, fold: bool = False) -> tuple:
    """Tree of a pattern: ("set", bytes), ("cat", ...), ("or", ...), ("star", x), ("opt", x)."""
    at = 0

    def one() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord(c)

    def folded(s: set[int]) -> tuple:
        if fold:
            s = {ord(f(chr(b))) for b in s for f in (str.lower, str.upper)}
        return ("set", frozenset(s))

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            x = either()
            at += 1
            return x
        if pattern[at] == "[":
            at += 1
            s: set[int] = set()
            while pattern[at] != "]":
                a = one()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    s.update(range(a, one() + 1))
                else:
                    s.add(a)
            at += 1
            return folded(s)
        return folded({one()})

    def cat() -> tuple:
        nonlocal at
        out = []
        while at < len(pattern) and pattern[at] not in "|)":
            x = atom()
            mark = pattern[at] if at < len(pattern) else ""
            if mark in ("?", "*", "+"):
                at += 1
                x = {"?": ("opt", x), "*": ("star", x), "+": ("cat", x, ("star", x))}[mark]
            elif mark == "{":
                end = pattern.index("}", at)
                low, more, _ = pattern[at + 1 : end].partition(",")
                at = end + 1
                x = ("cat", *[x] * int(low), *[("star", x)] * bool(more))
            out.append(x)
        return ("cat", *out)

    def either() -> tuple:
        nonlocal at
        out = [cat()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            out.append(cat())
        return out[0] if len(out) == 1 else ("or", *out)

    return either()


class Automaton:
    """rows[state][byte] is the next state; accepts[state] the rules (by place) that have a match ending here; state 0 starts.

    anywhere: matches may begin at each byte. Otherwise at the first only, and ``dead`` is the state without a way on.
    """

    def __init__(self, trees: list[tuple], anywhere: bool):
        edges: list[list[tuple[frozenset, int]]] = []
        empty: list[list[int]] = []

        def new() -> int:
            edges.append([])
            empty.append([])
            return len(edges) - 1

        def build(x: tuple, a: int) -> int:
            if x[0] == "set":
                edges[a].append((x[1], b := new()))
                return b
            if x[0] == "cat":
                for y in x[1:]:
                    a = build(y, a)
                return a
            b = new()
            if x[0] == "star":
                empty[a].append(b)
                empty[build(x[1], b)].append(b)
                return b
            for y in x[1:]:
                start = new()
                empty[a].append(start)
                empty[build(y, start)].append(b)
            if x[0] == "opt":
                empty[a].append(b)
            return b

        start, ends = new(), {}
        for k, tree in enumerate(trees):
            first = new()
            empty[start].append(first)
            ends[build(tree, first)] = k

        def closure(nodes) -> frozenset:
            seen, todo = set(nodes), list(nodes)
            while todo:
                for b in empty[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            return frozenset(seen)

        begin = closure([start])
        states, rows, accepts = {begin: 0}, [], []
        for nodes in (queue := [begin]):
            to: list[set[int]] = [set() for _ in range(256)]
            for a in nodes:
                for chars, b in edges[a]:
                    for c in chars:
                        to[c].add(b)
            row, known = [], {}
            for t in to:
                if (key := frozenset(t)) not in known:
                    s = closure(key | begin if anywhere else key)
                    if s not in states:
                        states[s] = len(states)
                        queue.append(s)
                    known[key] = states[s]
                row.append(known[key])
            rows.append(row)
            accepts.append(tuple(sorted(ends[a] for a in nodes if a in ends)))
        self._minimise(rows, accepts)
        self.dead = next((i for i, r in enumerate(self.rows) if set(r) == {i} and not self.accepts[i]), -1)

    def _minimise(self, rows: list[list[int]], accepts: list[tuple]) -> None:
        """Merge states until rows differ by block (partition refinement)."""
        names: dict = {}
        block = [names.setdefault(a, len(names)) for a in accepts]
        while True:
            names = {}
            finer = [names.setdefault((block[i], *(block[t] for t in row)), len(names)) for i, row in enumerate(rows)]
            if len(names) == len(set(block)):
                break
            block = finer
        first: dict[int, int] = {}
        for i, b in enumerate(finer):
            first.setdefault(b, i)
        self.rows = [[finer[t] for t in rows[i]] for i in first.values()]
        self.accepts = [accepts[i] for i in first.values()]


class Scanner:
    """Spans of all rules in a text."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([parse(r.hit or r.pattern, r.fold) for r in rules], True)
        self.own = [Automaton([parse(r.pattern, r.fold)], False) for r in rules]
        self.heads = [Automaton([parse(r.head, r.fold)], False) if r.head else None for r in rules]
        # bytes that all states treat alike are one class; each row holds the next rows themselves, and at last what it accepts
        columns = list(zip(*self.all.rows, strict=True))
        classes = {c: k for k, c in enumerate(dict.fromkeys(columns))}
        self.classes = bytes(classes[c] for c in columns)
        linked: list[list] = [[] for _ in self.all.rows]
        for state, row in enumerate(linked):
            row += [linked[c[state]] for c in classes]
            row.append(self.all.accepts[state])
        self.start, self.place = linked[0], len(classes)

    def segments(self, data: bytes) -> list[tuple[int, int]]:
        """Closed stretches that hold a hit: from the last place in the start state to the next one."""
        start, place = self.start, self.place
        row, out, opened, hit = start, [], 0, False
        last = -1  # the latest byte after which the state was the start
        for i, b in enumerate(data.translate(self.classes)):
            row = row[b]
            if row is start:
                last = i
                if hit:
                    out.append((opened, i))
                    hit = False
            elif row[place] and not hit:
                hit, opened = True, last + 1
        if hit:
            out.append((opened, len(data)))
        return out

    @staticmethod
    def longest(dfa: Automaton, data: bytes, at: int, end: int) -> int:
        """End of the longest match from ``at``; -1 if there is none."""
        rows, accepts, dead, state, best = dfa.rows, dfa.accepts, dfa.dead, 0, -1
        for i in range(at, end):
            state = rows[state][data[i]]
            if state == dead:
                break
            if accepts[state]:
                best = i + 1
        return best

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) in code points, by start, then rule."""
        data = text.encode("utf-8", "surrogatepass")
        found = []
        for opened, closed in self.segments(data):
            for k, rule in enumerate(self.rules):
                at = opened
                while at < closed:
                    end = self.longest(self.own[k], data, at, closed)
                    if end < 0:
                        at += 1
                        continue
                    value = self.longest(self.heads[k], data, at, end) if rule.head else at
                    if end - value >= rule.least:
                        found.append((at, end, k))
                    at = end
        if len(data) != len(text):
            points = lambda i: len(data[:i].decode("utf-8", "surrogatepass"))
            found = [(points(a), points(b), k) for a, b, k in found]
        return sorted(found)


@lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, base), by start and then rule, of every whole text."""

    def make():
        scan = scanner(rules).scan

        def step(x: dict) -> dict:
            spans = [[{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, b, k in scan(t)] for t in x["text"]]
            return {"doc_id": x["doc_id"], "spans": spans}

        return step

    return map_rows(id_text(docs), make, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
