"""Secret scans: all rules in one deterministic automaton, one pass over the bytes of every text.

The pass marks where rules accept. Only around those marks an anchored automaton of the one
rule finds the leftmost start and the longest end, so spans are those of a leftmost,
non-overlapping search for each kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import BREAK, Automaton
from .textblocks import blocks
from .workers import hold, mapped


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` is searched leftmost and longest; a match whose length after ``head`` is below ``least`` is dropped without a retry. Others run on over what ``tail`` matches behind them."""

    kind: str
    pattern: str
    least: int = 0
    head: str = ""
    tail: str = ""


_NAMED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: What follows a key's BEGIN line: header lines and base64 lines up to the END line. Where none comes, runs of 16 base64 letters or more, the last of any length if it closes with '='. Line breaks may be written as \\n or \\r.
_GAP = r"(?:\\[nr]|[\x20\x09-\x0D])"
_HEADERS = rf"(?:(?:Proc-Type:\x20*[0-9]+,[A-Z]+|DEK-Info:\x20*[A-Z0-9-]+,[0-9A-Fa-f]+|[A-Za-z0-9-]++:(?:(?!-----)[^\n\\])*+){_GAP}++)*+"
_KEY = (
    rf"(?:{_GAP}*+{_HEADERS}(?:[A-Za-z0-9+/=]|{_GAP})*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    rf"|{_GAP}*+{_HEADERS}[A-Za-z0-9+/]{{16,}}+=*+(?:{_GAP}++[A-Za-z0-9+/]{{16,}}+=*+)*+(?:{_GAP}++[A-Za-z0-9+/]++=++)?)?"
)

#: The three base rules, then further kinds. The hex run has its least length in the pattern, which spares a mark on every letter a-f: a shorter run holds no match either way.
RULES = (
    SecretRule("assign", _NAMED + "[A-Za-z0-9+/_.=-]+", 6, _NAMED),
    SecretRule("access", "AKIA[A-Z0-9]+", 20),
    SecretRule("hex", "[0-9a-f]{24,}"),
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    SecretRule("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", tail=_KEY),
)
BASE_KINDS = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: tuple[SecretRule, ...]):
        self.rules = rules
        self.all = Automaton([r.pattern for r in rules], search=True)
        self.one = [Automaton([r.pattern], search=False) for r in rules]
        self.tails = [re.compile(r.tail.encode()) if r.tail else None for r in rules]
        self.heads = [Automaton([r.head], search=False) if r.head else None for r in rules]

    def _longest(self, machine: Automaton, data: bytes, at: int, end: int) -> int:
        """End of the longest match from ``at``, or -1."""
        table, accepts, state, best = machine.table, machine.accepts, 0, -1
        dead = machine.dead
        for k in range(at, end):
            state = table[state][data[k]]
            if state == dead:
                break
            if accepts[state]:
                best = k + 1
        return best

    def spans(self, data: bytes, marks: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes for one text, from the marks of the common pass."""
        out = []
        for r, rule in enumerate(self.rules):
            cursor = 0
            for after, mask in marks:
                if not mask >> r & 1 or after <= cursor:
                    continue
                low = after - 1  # back to the byte after which every search stands at its start
                while low > cursor and not self.all.resets[data[low - 1]]:
                    low -= 1
                for at in range(low, after):
                    if (end := self._longest(self.one[r], data, at, len(data))) > 0:
                        break
                else:
                    continue
                if self.tails[r]:
                    end = self.tails[r].match(data, end).end()
                cursor = end
                if rule.least:
                    # The head takes as much as it can, the rest is what must be long.
                    head = self._longest(self.heads[r], data, at, end) if self.heads[r] else at
                    if end - head < rule.least:
                        continue
                out.append((at, r, end))
        return sorted(out)

    def scan(self, block) -> Iterator[list[tuple[int, int, int]]]:
        """Spans of every text of a block."""
        n = len(block)
        at = block.at + np.arange(n + 1)  # a break before each text but the first
        data = np.full(len(block.data) + n, BREAK, np.uint8)
        data[np.arange(len(block.data)) + np.repeat(np.arange(n), np.diff(block.at))] = block.data
        where, masks = self.all.scan(data)
        owner = np.searchsorted(at, where, "left") - 1
        first = np.searchsorted(owner, np.arange(n + 1))
        for k in range(n):
            i, j = first[k], first[k + 1]
            if i == j:
                yield []
            else:
                yield self.spans(block.text(k), list(zip((where[i:j] - at[k]).tolist(), masks[i:j].tolist(), strict=True)))


def scanner(rules: tuple[SecretRule, ...] = RULES) -> Scanner:
    """Compiled once in each worker."""
    return hold("secrets", rules, lambda: _compiled(rules))


def _compiled(rules: tuple[SecretRule, ...]) -> Scanner:
    made = Scanner(rules)
    for machine in [*made.one, *[h for h in made.heads if h]]:
        stuck = np.flatnonzero((machine.table == np.arange(len(machine.table))[:, None]).all(axis=1) & (machine.accepts == 0))
        machine.dead = int(stuck[0]) if len(stuck) else -1
        machine.table, machine.accepts = machine.table.tolist(), machine.accepts.tolist()
    return made


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with code points in place of bytes."""
    bytes_ = np.frombuffer(data, np.uint8)
    begins = np.concatenate([[0], np.cumsum((bytes_ & 0xC0) != 0x80)])
    return [(int(begins[a]), r, int(begins[b])) for a, r, b in spans]


def redacted(data: bytes, spans: list[tuple[int, int, int]], mask: bytes) -> str:
    out, done = [], 0
    for a, _, b in spans:
        if b <= done:
            continue
        if a > done or not done:
            out += [data[done : max(a, done)], mask]
        done = b
    return b"".join([*out, data[done:]]).decode()


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` and ``n_spans``.

    ``spans`` lists kind:start:end in code points by start, then by kind as listed in
    ``rules``. Null and empty texts hold none. Each row is scanned for itself: repeated rows
    and keys keep a row each; other columns are left out, whatever their names.
    """
    kind = docs.schema[key].dataType.simpleString()
    base = [k for k, r in enumerate(rules) if r.kind in BASE_KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(rules)
        for batch in batches:
            rows = []
            for block in blocks(batch.column(1)):
                for k, spans in enumerate(machine.scan(block)):
                    said = code_points(block.text(k), spans) if spans else []
                    names = [(r, f"{rules[r].kind}:{a}:{b}") for a, r, b in said]
                    digest = hashlib.sha256(",".join([s for r, s in names if r in base]).encode()).hexdigest()
                    counts = [sum(rules[r].kind == b for r, _ in names) for b in BASE_KINDS]
                    rows.append([*counts, digest, ",".join([s for _, s in names]), len(names)])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]], [key, *_NAMES])

    return mapped(docs.select(F.col(key), F.col(text).cast("string")), run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long", "secrets")


_NAMES = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping spans give one mask. All columns and rows stay; null texts stay null."""
    names, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(rules)
        for batch in batches:
            old = batch.column(place)
            out = []
            for block in blocks(old):
                for k, spans in enumerate(machine.scan(block)):
                    out.append(redacted(block.text(k), spans, mask.encode()) if spans else block.text(k).decode())
            new = pa.array([None if v else x for v, x in zip(old.is_null().to_pylist(), out, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == place else c for k, c in enumerate(batch.columns)], names=names)

    return mapped(docs, run, docs.schema, "secrets")
