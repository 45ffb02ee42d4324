"""Compile byte regexes into one minimal deterministic automaton and scan with it in numpy.

Patterns use literals, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m,n}``, ``{m,}`` and
``(?i:...)``. All rules share one automaton: subset construction over their union, then
minimisation by refinement, giving a transition array and a bit mask of accepting rules.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from re import _parser as sre  # the standard library's own pattern reader

#: Never a byte of UTF-8: it stands between texts, and every state falls back to the start on it.
BREAK = 0xFF


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, items, at: int, folded: bool) -> int:
        """Append the parsed items after state ``at``; returns the state where they end."""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                at = self._step(at, {arg}, folded)
            elif name == "IN":
                at = self._step(at, _class(arg), folded)
            elif name == "SUBPATTERN":
                _, on, _, inner = arg
                at = self.add(inner, at, folded or bool(on & 2))
            elif name == "BRANCH":
                end = self.state()
                for way in arg[1]:
                    start = self.state()
                    self.free[at].append(start)
                    self.free[self.add(way, start, folded)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at, folded)
                if high == sre.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop, folded)].append(loop)
                    self.free[loop].append(end)
                    at = end
                else:
                    end = self.state()
                    self.free[at].append(end)
                    for _ in range(high - low):
                        at = self.add(inner, at, folded)
                        self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"pattern part not supported: {name}")
        return at

    def _step(self, at: int, codes: set[int], folded: bool) -> int:
        if folded:
            codes = codes | {ord(chr(c).swapcase()) for c in codes if c < 128 and chr(c).isalpha()}
        to = self.state()
        self.moves[at].append((frozenset(codes), to))
        return to

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _class(items) -> set[int]:
    out: set[int] = set()
    negate = False
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            negate = True
        elif name == "LITERAL":
            out.add(arg)
        elif name == "RANGE":
            out.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"class part not supported: {name}")
    return set(range(BREAK)) - out if negate else out


class Automaton:
    """``table[state, byte]`` is the next state, ``accepts[state]`` the bit mask of rules that end there, state 0 the start.

    With ``search`` a match may begin anywhere (the patterns are preceded by any bytes);
    without it the automaton is anchored. Several rules with counted repeats multiply the
    states: give one rule at most a count, and check lengths of the others after the match.
    """

    def __init__(self, patterns: list[str], search: bool):
        nfa = _Nfa()
        root = nfa.state()
        final: dict[int, int] = {}
        for k, p in enumerate(patterns):
            start = nfa.state()
            nfa.free[root].append(start)
            end = nfa.add(sre.parse(p), start, False)
            final[end] = final.get(end, 0) | 1 << k
        begin = nfa.closure({root})
        number, rows, masks, todo = {begin: 0}, [], [], deque([begin])
        while todo:  # subset construction
            now = todo.popleft()
            masks.append(sum({final[s] for s in now if s in final}))
            targets: list[set[int]] = [set() for _ in range(256)]
            for s in now:
                for codes, to in nfa.moves[s]:
                    for c in codes:
                        targets[c].add(to)
            row, memo = [], {}
            for c in range(256):
                key = frozenset(targets[c])
                if key not in memo:
                    full = nfa.closure(key | ({root} if search else set()))
                    if full not in number:
                        number[full] = len(number)
                        todo.append(full)
                    memo[key] = number[full]
                row.append(memo[key])
            if search:
                row[BREAK] = 0
            rows.append(row)
        table, accepts = _minimised(np.array(rows, np.int64), np.array(masks, np.int64))
        self.table, self.accepts = table.astype(np.int32), accepts
        #: Bytes that lead from every state to the start.
        self.resets = (table == 0).all(axis=0)

    def scan(self, data: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """One pass over the bytes: positions after which a rule accepts, in order, and the masks.

        The bytes are dealt to lanes that start behind a resetting byte, so every lane begins in the start state that the whole scan would have there.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = max(256, -(-n // lanes))
        cuts = np.flatnonzero(self.resets[data])
        ideal = np.arange(width, n, width)
        at = np.searchsorted(cuts, ideal)
        starts = np.unique(np.concatenate([[0], cuts[at[at < len(cuts)]] + 1]))
        starts = starts[starts < n]
        lengths = np.diff(np.append(starts, n))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        flat = self.table.ravel()
        accepting = self.accepts > 0
        state = np.zeros(len(starts), np.int32)
        found_at, found = [], []
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
        for t in range(int(lengths[0])):
            k = active[t]
            state = flat[(state[:k] << 8) | data[starts[:k] + t]]
            hit = accepting[state]
            if hit.any():
                lane = np.flatnonzero(hit)
                found_at.append(starts[lane] + t + 1)
                found.append(self.accepts[state[lane]])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, masks = np.concatenate(found_at), np.concatenate(found)
        order = np.argsort(where, kind="stable")
        return where[order], masks[order]


def _minimised(table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no byte string tells apart: refine classes by their successors' classes until none splits."""
    _, group = np.unique(masks, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = [group[0]] + [g for g in range(group.max() + 1) if g != group[0]]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    group = place[group]
    first = np.array([np.flatnonzero(group == g)[0] for g in range(len(order))])
    return group[table[first]], masks[first]
