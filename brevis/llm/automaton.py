"""Regexes over bytes, compiled to one minimal deterministic automaton.

Supported: literals, escapes, classes, groups, |, ?, *, +. Rules are parsed to a
tree, joined in a position-labelled nondeterministic automaton, determinised by
subset construction and minimised by partition refinement. A state's accepted
rules are a bitmask. The transition array has 256 entries a state, holding the
next state's offset into the array; states that accept come last, so that one
comparison tells whether anything was accepted.
"""

from __future__ import annotations

from array import array
from collections import defaultdict


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.s, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        out = [self.sequence()]
        while self.peek() == "|":
            self.take()
            out.append(self.sequence())
        return ("or", out)

    def sequence(self):
        out = []
        while self.peek() and self.peek() not in "|)":
            node = self.atom()
            while self.peek() and self.peek() in "?*+{":
                op = self.take()
                if op == "{":  # {n,}
                    n = int(self.s[self.i : (end := self.s.index(",}", self.i))])
                    self.i = end + 2
                    node = ("cat", [node] * (n - 1) + [("+", node)])
                else:
                    node = (op, node)
            out.append(node)
        return ("cat", out)

    def char(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def both(self, codes: set[int]) -> frozenset[int]:
        return frozenset(codes | {ord(chr(c).swapcase()) for c in codes if chr(c).isascii() and chr(c).isalpha()}) if self.fold else frozenset(codes)

    def atom(self):
        if self.peek() == "(":
            self.take()
            node = self.alternatives()
            self.take()
            return node
        if self.peek() == "[":
            self.take()
            codes: set[int] = set()
            while self.peek() != "]":
                a = self.char()
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.take()
                    codes.update(range(a, self.char() + 1))
                else:
                    codes.add(a)
            self.take()
            return ("set", frozenset(codes))
        return ("set", self.both({self.char()}))


def reverse(node):
    kind, x = node
    if kind == "set":
        return node
    if kind == "cat":
        return ("cat", [reverse(y) for y in reversed(x)])
    return (kind, [reverse(y) for y in x] if kind == "or" else reverse(x))


def parse(pattern: str, fold: bool = False):
    return _Parser(pattern, fold).alternatives()


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, node, a: int) -> int:
        kind, x = node
        if kind == "set":
            b = self.state()
            self.edges[a].append((x, b))
            return b
        if kind == "cat":
            for y in x:
                a = self.add(y, a)
            return a
        b = self.state()
        if kind == "or":
            for y in x:
                self.empty[self.add(y, a)].append(b)
            return b
        start = self.state()
        self.empty[a].append(start)
        end = self.add(x, start)
        self.empty[end].append(b)
        if kind in "?*":
            self.empty[a].append(b)
        if kind in "*+":
            self.empty[end].append(start)
        return b

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """table, start, first (offset of the first accepting state) and accepts (bitmask by state number)."""

    def __init__(self, nodes: list, anywhere: bool):
        nfa = _Nfa()
        root = nfa.state()
        ends = {}
        for k, node in enumerate(nodes):
            a = nfa.state()
            nfa.empty[root].append(a)
            ends[nfa.add(node, a)] = 1 << k
        start = nfa.closure([root])
        number, order, rows, masks = {start: 0}, [start], [], []
        for states in order:
            masks.append(sum({ends[s] for s in states if s in ends}))
            by_byte = defaultdict(set)
            for s in states:
                for codes, t in nfa.edges[s]:
                    for c in codes:
                        by_byte[c].add(t)
            row, memo = [], {}
            for c in range(256):
                key = frozenset(by_byte.get(c, ()))
                if key not in memo:
                    nxt = nfa.closure(key | {root} if anywhere else key)
                    if nxt not in number:
                        number[nxt] = len(order)
                        order.append(nxt)
                    memo[key] = number[nxt]
                row.append(memo[key])
            rows.append(row)
        self.subsets = len(rows)
        self._minimise(rows, masks)

    def __getstate__(self):
        return self.__dict__ | {"table": array("I", self.table)}

    def __setstate__(self, state):
        offsets = [i << 8 for i in range(state["states"])]
        self.__dict__.update(state, table=[offsets[x >> 8] for x in state["table"]])

    def _minimise(self, rows: list[list[int]], masks: list[int]) -> None:
        block = {m: i for i, m in enumerate(sorted(set(masks)))}
        of = [block[m] for m in masks]
        while True:
            names: dict = {}
            new = [names.setdefault((of[s], tuple(of[t] for t in row)), len(names)) for s, row in enumerate(rows)]
            if len(names) == len(set(of)):
                break
            of = new
        count = len(set(of))
        first_of = {}
        for s, b in enumerate(of):
            first_of.setdefault(b, s)
        ranked = sorted(range(count), key=lambda b: (masks[first_of[b]] != 0, first_of[b]))
        place = {b: i for i, b in enumerate(ranked)}
        self.states = count
        self.start = place[of[0]] << 8
        self.accepts = [masks[first_of[b]] for b in ranked]
        self.first = sum(1 for m in self.accepts if not m) << 8
        offsets = [i << 8 for i in range(count)]  # shared, so that an entry costs a pointer
        self.table = [offsets[place[of[t]]] for b in ranked for t in rows[first_of[b]]]
        empty = [i for i, b in enumerate(ranked) if not masks[first_of[b]] and all(t == first_of[b] or of[t] == b for t in rows[first_of[b]])]
        self.dead = empty[0] << 8 if empty else -1
