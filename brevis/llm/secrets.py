"""Secret scan: all rules in one pass over a text's bytes, through one minimal automaton.

Forward, the combined automaton says after each byte which rules end there. A rule
ends in a repeated class, so its greedy match ends where the rule stops being
accepted; from there a second automaton, built of the reversed rule, walks back
to the leftmost start that doesn't reach into the rule's previous match. The
forward automaton sees four of a hex run's 24 digits spelled out, since counters of
several rules multiply its states; matches are then measured, and dropped if too
short, as each rule states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, parse, reverse
from .common import arrow_map


@dataclass(frozen=True)
class Rule:
    """A pattern whose last element is a repeated class. fold: letters outside classes match in either case.

    tail: the class's bytes, and the fewest of them that a match must end in (0: no such check); least: fewest bytes of the match.
    """

    kind: str
    pattern: str
    fold: bool = False
    tail: str = ""
    tail_least: int = 0
    least: int = 0


#: The three base kinds, then the kinds that the operator adds.
VALUE = "A-Za-z0-9+/_.=-"
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", f"(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[{VALUE}]+", fold=True, tail_least=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{4,}", least=24),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_.-]+", least=40),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----+"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(r.pattern, r.fold) for r in rules]
        self.forward = Automaton(trees, anywhere=True)
        self.back = [Automaton([reverse(t)], anywhere=False) for t in trees]

    def _start(self, k: int, data: bytes, end: int, limit: int) -> int:
        """Leftmost start, at limit or later, of a match of rule k that ends at end; -1 if there is none."""
        a = self.back[k]
        table, s, dead, found = a.table, a.start, a.dead, -1
        for i in range(end - 1, limit - 1, -1):
            s = table[s + data[i]]
            if s == dead:
                break
            if s >= a.first:
                found = i
        return found

    def _long_enough(self, k: int, data: bytes, a: int, b: int) -> bool:
        rule = self.rules[k]
        if b - a < rule.least:
            return False
        if not rule.tail_least:
            return True
        value = data[a:b]
        cut = min(i for i in (value.find(b":"), value.find(b"=")) if i >= 0) + 1
        value = value[cut:].lstrip(b" ")
        return len(value) - (value[:1] in (b'"', b"'")) >= rule.tail_least

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule number) of the matches of each rule, leftmost and not overlapping, in bytes, by start and rule."""
        table, first, s, before = self.forward.table, self.forward.first, self.forward.start, 0
        accepts, found, last = self.forward.accepts, [], [0] * len(self.rules)

        def close(mask: int, end: int) -> None:
            for k in range(len(self.rules)):
                if mask >> k & 1:
                    a = self._start(k, data, end, last[k])
                    if a >= 0:
                        last[k] = end
                        if self._long_enough(k, data, a, end):
                            found.append((a, end, k))

        for i, byte in enumerate(data):
            s = table[s + byte]
            if s >= first:
                now = accepts[s >> 8]
                if before & ~now:
                    close(before & ~now, i)
                before = now
            elif before:
                close(before, i)
                before = 0
        if before:
            close(before, len(data))
        return sorted(found, key=lambda x: (x[0], x[2]))


@cache
def scanner() -> Scanner:
    return Scanner()


def spans(data: bytes, using: Scanner | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    found = (using or scanner()).scan(data)
    if not found:
        return []
    if not data.isascii():
        at, chars, places = 0, 0, {}
        for p in sorted({p for a, b, _ in found for p in (a, b)}):
            chars += sum(1 for c in data[at:p] if c & 0xC0 != 0x80)
            at, places[p] = p, chars
        found = [(places[a], places[b], k) for a, b, k in found]
    return [(RULES[k].kind, a, b) for a, b, k in found]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = shared.value
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for data in b.column("text").to_pylist():
                found = spans(data, using) if data else []
                base = [x for x in found if x[0] in BASE]
                for i, kind in enumerate(BASE):
                    cols[i].append(sum(x[0] == kind for x in base))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty: no spans, the digest of the empty string. Null and
    repeated ids come out as they came in; other columns are ignored; an empty
    table gives an empty one. A row's work is linear in its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner())  # a few MB, whatever the input
    return arrow_map(docs.select("doc_id", F.col("text").cast("binary").alias("text")), _scan_batches(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")
