"""Personal data: a conditional random field over word shapes, beside exact base patterns.

Words get categorical shape features in numpy, straight from the bytes. The field is trained
from a small labelled table and decodes every line of a batch by Viterbi at once. It finds what
the base patterns miss: mail addresses that are spelled out or lack a domain, phone numbers
without a plus sign, addresses with brackets, card numbers with dots or a wrong digit. What it
labels counts as a further span if it passes its kind's check and no base span is there.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import Crf, train
from .textblocks import NOT_SPACE, Block, blocks
from .workers import mapped

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is none; each kind has one for its first word and one for the next ones.
N_LABELS = 1 + 2 * len(KINDS)

# base patterns

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # no match begins within a run of digits
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches. Each has one @, so it starts where the letters before that @ do, or where the match before ended."""
    done = 0
    while (at := text.find("@", done)) >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
        else:
            done = at + 1


def valid(kind: str, said: str) -> bool:
    digits = "".join(_DIGIT.findall(said))
    if kind == "ip":
        return all(int(p) <= 255 if len(p) < 10 else not p.lstrip("0") or int(p[-12:]) <= 255 and not p[:-12].strip("0") for p in said.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def plausible(kind: str, said: str) -> bool:
    """The check of a span that the field labels."""
    digits = "".join(_DIGIT.findall(said))
    if kind == "email":
        sides = re.split(r"@|[(\[]at[)\]]", said)
        return len(sides) == 2 and all(re.search("[A-Za-z0-9]", x) for x in sides)
    if kind == "ip":
        parts = re.findall("[0-9]+", said)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    return 13 <= len(digits) <= 19 if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping for each, failing matches dropped."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            if k == 3 and "+" not in text:
                continue
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m[0])]
    return sorted(out)


# word shapes

_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_KIND = np.full(256, 4, np.int64)  # other marks
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 0, 1, 2, 3
_SIZES = (8 * 2 * 2, 5 * 2, 16, 7, 25, 24, 24, 3)
N_VALUES = sum(_SIZES)
_SHIFT = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])


def _spelled(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """1 for ``(at)`` and ``[at]``, 2 for ``(dot)`` and ``[dot]``, else 0."""
    open_ = (data[starts] == 40) | (data[starts] == 91)
    there = lambda n, said: open_ & (length == n) & np.logical_and.reduce([data[np.minimum(starts + 1 + k, len(data) - 1)] == c for k, c in enumerate(said)])
    return np.where(there(4, b"at"), 1, np.where(there(5, b"dot"), 2, 0))


def shapes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and features of the words, and of the lines each one's document and number of words."""
    data = block.data
    starts, ends, first = block.words(NOT_SPACE)
    n = len(starts)
    zero = np.zeros(0, np.int64)
    if not n:
        return starts, ends, np.zeros((0, len(_SIZES)), np.int64), zero, zero

    def count(wanted: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(wanted, out=sums[1:])
        return sums[ends] - sums[starts]

    digits, letters = count(_DIGITS[data]), count(_LETTERS[data])
    ats, dots, dashes = count(data == 64), count(data == 46), count(data == 45)
    length = ends - starts
    plus = data[starts] == 43
    round_ = (data[starts] == 40) | ((data[ends - 1] == 41))
    many = np.searchsorted([1, 4, 5, 7, 9, 13, 20], digits, "right")
    size = np.searchsorted([2, 3, 4, 5, 9, 16], length, "right")
    spelled = _spelled(data, starts, length)
    near = np.where(spelled > 0, 15 + spelled, many * 2 + plus)  # neighbours' view: spelled-out signs, else digits
    new_line = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=new_line[1:])
    doc = np.searchsorted(first, np.arange(n), "right") - 1
    row = new_line[starts].astype(np.int64) + doc
    new = np.concatenate([[True], row[1:] != row[:-1]])
    before = np.where(new, 0, np.concatenate([[0], near[:-1]]))
    after = np.where(np.append(new[1:], True), 0, np.append(near[1:], 0))
    columns = (
        many * 4 + (ats > 0) * 2 + (letters > 0),
        np.minimum(dots, 4) * 2 + (digits + dots == length),
        plus * 8 + round_ * 4 + (dashes > 0) * 2 + (digits + dashes + dots == length),
        size,
        _KIND[data[starts]] * 5 + _KIND[data[ends - 1]],
        before,
        after,
        spelled,
    )
    heads = np.flatnonzero(new)
    return starts, ends, np.column_stack(columns) + _SHIFT, doc[heads], np.diff(np.append(heads, n))


# the small labelled table

def labelled_table(n: int = 300, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Short lines with (start, kind, end) spans, made by rule from a seed: by default the training table."""
    rng = random.Random(seed)
    pick = rng.choice
    number = lambda k: "".join(pick("0123456789") for _ in range(k))
    letters = lambda k: "".join(pick("etaoinshrdlucmfwé" if k > 4 else "etaoinshrdlucmfw") for _ in range(k))

    def word() -> str:
        said = letters(rng.randint(1, 10))
        return pick([said, said, said, said.title(), said.upper()]) + pick(["", "", "", "", ",", ".", "!!", "###"])

    def email() -> str:
        who = pick(["", letters(2) + pick("._-")]) + "".join(pick("etaoinshrdl") for _ in range(rng.randint(2, 7))) + pick(["", number(2)])
        host = "".join(pick("mailhostexp") for _ in range(rng.randint(3, 8))) + pick(["", number(1)])
        end = pick(["org", "com", "net", "co.uk", "example.com"])
        if rng.random() < 0.35:
            at, dot = pick([("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."), ("[at]", ".")])
            return f"{who} {at} {host}" + (f".{end}" if dot == "." else f" {dot} {end.split('.')[0]}")
        said = f"{who}@{host}" + pick(["", f".{end}"])
        return pick([said, said, said.upper()])

    def ip() -> str:
        return pick([".", ".", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        body = pick("23456789") + number(pick([14, 14, 14, 12, 13, 17]))
        body += pick([next(str(d) for d in range(10) if luhn(body + str(d))), number(1)])
        gap = pick(["", "", " ", "-", "."])
        return gap.join(body[k : k + 4] for k in range(0, len(body), 4))

    def phone() -> str:
        plan = pick(["+{a} ({b}) {c}-{d}", "+{a} {b} {c} {d}", "({b}) {c}-{d}", "+{a}-{b}-{c}-{d}", "00{a} {b} {c} {d}", "0{b} {c} {d}", "0{b}-{c}-{d}", "0{b}/{c}{d}", "{b}-{c}-{d}"])
        return plan.format(a=rng.randint(1, 49), b=number(3), c=number(3), d=number(4))

    def none() -> str:
        year = rng.randint(1990, 2030)
        return pick([
            number(rng.randint(1, 6)), number(rng.randint(7, 8)), f"{year}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{year}", f"{number(1)}.{number(1)}.{number(1)}",
            f"{number(2)},{number(2)}", f"${number(3)}", "token = \"" + "".join(pick("0123456789abcdef") for _ in range(40)) + '"', f"({number(4)})", f"{number(2)}:{number(2)}", "@" + letters(5),
            f"{number(3)} {number(3)}", f"{year} {year + 1}", f"v{number(1)}.{number(2)}", f"pp. {number(3)}-{number(3)}", number(28), f"(see) {number(2)}", f"[{number(1)}]", f"{letters(3)} (at) {number(1)}:{number(2)}",
        ])

    out = []
    for _ in range(n):
        line, spans = "", []
        for _ in range(rng.randint(1, 3)):
            line += "".join(word() + " " for _ in range(rng.randint(0, 5)))
            kind = pick([0, 1, 2, 3, 4, 4])
            said = (email, ip, card, phone, none)[kind]()
            if kind < 4:
                spans.append((len(line), kind, len(line) + len(said)))
            line += said + pick(["", "", ".", ",", "###", "!!", "%%%", ")"]) + " "
        out.append((line + word(), spans))
    return out


def learn(table: list[tuple[str, list[tuple[int, int, int]]]] | None = None) -> Crf:
    """Train from lines with spans in characters: each line is one sequence."""
    xs, ys = [], []
    for text, spans in table if table is not None else labelled_table():
        block = next(blocks(pa.array([text])))
        starts, ends, x, _, _ = shapes(block)
        y = np.zeros(len(starts), np.int64)
        for a, kind, b in spans:
            inside = np.flatnonzero((starts < len(text[:b].encode())) & (ends > len(text[:a].encode())))
            y[inside] = 2 + 2 * kind
            y[inside[:1]] = 1 + 2 * kind
        xs.append(x)
        ys.append(y)
    return train(xs, ys, N_VALUES, N_LABELS)


def found_by(model: Crf, block: Block) -> dict[int, list[tuple[int, int, int]]]:
    """(start, kind, end) in bytes of what the field labels, by document."""
    starts, ends, x, doc, lengths = shapes(block)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(starts):
        return out
    labels = model.decode(model.scores(x), lengths)
    heads = np.flatnonzero(labels % 2 == 1)
    line_ends = np.cumsum(lengths)
    for h in heads.tolist():
        kind = (int(labels[h]) - 1) // 2
        line = int(np.searchsorted(line_ends, h, "right"))
        last = h
        while last + 1 < line_ends[line] and labels[last + 1] == 2 + 2 * kind:
            last += 1
        d, a, b = int(doc[line]), int(starts[h]), int(ends[last])
        said = block.data[a:b].tobytes()
        lead, tail = re.match(rb"[^0-9A-Za-z+(\x80-\xFF]*", said).end(), len(re.sub(rb"[^0-9A-Za-z)\x80-\xFF]+\Z", b"", said))
        if lead < tail and said.isascii():
            text = said[lead:tail].decode()
            while text.endswith(")") and text.count("(") < text.count(")"):  # closes a bracket around the span
                text = re.sub(r"[^0-9A-Za-z)]+\Z", "", text[:-1])
            tail = lead + len(text)
            if plausible(KINDS[kind], text):
                out.setdefault(d, []).append((a + lead - int(block.at[d]), kind, a + tail - int(block.at[d])))
    return out


def find(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    ``spans`` lists kind:start:end in code points by start, then kind: all base spans and those
    of the field that overlap none. Sequences are lines, decoded whole; of equally good labels
    the first wins. Null and empty texts hold nothing, an empty table gives an empty one; rows
    are independent, repeated ones keep a row each; other columns are left out, whatever their
    names. Time is linear in the length of a text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in blocks(batch.column(1)):
                added = found_by(shared.value, block)
                points = np.zeros(len(block.data) + 1, np.int64)  # code points before each byte
                if added:
                    np.cumsum((block.data & 0xC0) != 0x80, out=points[1:])
                marked = np.zeros(len(block.data) + 1, np.int32)
                np.cumsum(_DIGITS[block.data] | (block.data == 64), out=marked[1:])
                some = marked[block.at[1:]] > marked[block.at[:-1]]
                for d in range(len(block)):
                    if not some[d] and d not in added:  # no digit and no @: no pattern can match
                        rows.append((0, 0, 0, 0, nothing, "", 0))
                        continue
                    base = base_spans(block.text(d).decode())
                    starts = [i for i, _, _ in base]
                    far = [*accumulate((j for _, _, j in base), max)]  # the last end of all spans up to each one
                    more = []
                    head = int(block.at[d])
                    for first, k, last in added.get(d, ()):
                        a, b = (int(points[head + x] - points[head]) for x in (first, last))
                        before = bisect_left(starts, b)
                        if not before or far[before - 1] <= a:
                            more.append((a, k, b))
                    digest = hashlib.sha256(",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in base]).encode()).hexdigest()
                    rows.append((*[sum(k == j for _, k, _ in base) for j in range(4)], digest, ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more)]), len(more)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return mapped(docs.select(F.col(key), F.col(text).cast("string")), run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
