"""Byte automata: rule patterns to one minimal deterministic automaton, by subset construction and partition refinement.

The pattern language is a small one: literals, ``.``-free classes with ranges and negation, ``\\x20``-style and escaped
characters, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and ``{m,n}``. Patterns are over bytes (ASCII).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

ALL = (1 << 256) - 1
_ESCAPES = {"d": "0-9", "w": "A-Za-z0-9_", "s": " \t-\r"}


class _Nfa:
    """Thompson fragments: ``eps[s]`` are free moves, ``arc[s]`` is one (byte mask, target) or None."""

    def __init__(self, fold: bool):
        self.eps: list[list[int]] = []
        self.arc: list[tuple[int, int] | None] = []
        self.fold = fold

    def state(self) -> int:
        self.eps.append([])
        self.arc.append(None)
        return len(self.eps) - 1

    def mask(self, chars) -> int:
        out = 0
        for c in chars:
            for x in {c, c.lower(), c.upper()} if self.fold else {c}:
                out |= 1 << ord(x)
        return out


def _char(p: str, i: int) -> tuple[str, int]:
    if p[i] != "\\":
        return p[i], i + 1
    if p[i + 1] == "x":
        return chr(int(p[i + 2:i + 4], 16)), i + 4
    return {"n": "\n", "t": "\t", "r": "\r"}.get(p[i + 1], p[i + 1]), i + 2


def _class(nfa: _Nfa, p: str, i: int) -> tuple[int, int]:
    negated = p[i] == "^"
    i, chars = i + negated, []
    while p[i] != "]":
        a, i = _char(p, i)
        if p[i] == "-" and p[i + 1] != "]":
            b, i = _char(p, i + 1)
            chars += map(chr, range(ord(a), ord(b) + 1))
        else:
            chars.append(a)
    m = nfa.mask(chars)
    return (ALL & ~m if negated else m), i + 1


def _parse(nfa: _Nfa, p: str):
    """Pattern to a tree of ('set', mask), ('cat', parts), ('or', parts) and ('rep', part, low, high)."""

    def either(i):
        parts, i = [], i
        while True:
            seq, i = row(i)
            parts.append(seq)
            if i >= len(p) or p[i] == ")":
                return (parts[0] if len(parts) == 1 else ("or", parts)), i
            i += 1

    def row(i):
        parts = []
        while i < len(p) and p[i] not in "|)":
            if p[i] == "(":
                node, i = either(i + 1 + 2 * p.startswith("?:", i + 1))
                i += 1
            elif p[i] == "[":
                m, i = _class(nfa, p, i + 1)
                node = ("set", m)
            elif p[i] == "\\" and p[i + 1] in _ESCAPES:
                m, _ = _class(nfa, _ESCAPES[p[i + 1]] + "]", 0)
                node, i = ("set", m), i + 2
            else:
                c, i = _char(p, i)
                node = ("set", nfa.mask(c))
            while i < len(p) and (p[i] in "?*+" or re.match(r"\{\d+(,\d*)?\}", p[i:])):
                if p[i] == "{":
                    j = p.index("}", i)
                    low, _, high = p[i + 1:j].partition(",")
                    node = ("rep", node, int(low), int(high) if high else None if "," in p[i:j] else int(low))
                    i = j + 1
                else:
                    node = ("rep", node, int(p[i] == "+"), 1 if p[i] == "?" else None)
                    i += 1
            parts.append(node)
        return ("cat", parts), i

    return either(0)[0]


def _build(nfa: _Nfa, node, at: int) -> int:
    """Adds the node's moves from state ``at``; returns the state after it."""
    kind = node[0]
    if kind == "set":
        to = nfa.state()
        nfa.arc[at] = (node[1], to)
        end = nfa.state()
        nfa.eps[to].append(end)
        return end
    if kind == "cat":
        for x in node[1]:
            at = _build(nfa, x, at)
        return at
    end = nfa.state()
    if kind == "or":
        for x in node[1]:
            begin = nfa.state()
            nfa.eps[at].append(begin)
            nfa.eps[_build(nfa, x, begin)].append(end)
        return end
    _, part, low, high = node
    for _ in range(low):
        at = _build(nfa, part, at)
    if high is None:
        loop, begin = nfa.state(), nfa.state()
        nfa.eps[at].append(loop)
        nfa.eps[loop] += [begin, end]
        nfa.eps[_build(nfa, part, begin)].append(loop)
        return end
    for _ in range(high - low):
        begin = nfa.state()
        nfa.eps[at] += [begin, end]
        at = _build(nfa, part, begin)
    nfa.eps[at].append(end)
    return end


@dataclass(frozen=True)
class Dfa:
    """``classes`` maps a byte to its column; ``table[state * width + column]`` is the next state times ``width``.

    State 0 is the start. States from ``accepting`` on (also times ``width``) accept; ``dead`` is the state without a
    way on, or -1.
    """

    classes: bytes
    width: int
    table: list[int]
    accepting: int
    dead: int

    @property
    def states(self) -> int:
        return len(self.table) // self.width

    def longest(self, data: bytes, start: int, end: int, failed: set[int] | None = None) -> int:
        """End of the longest match that begins at ``start``, or -1. For automata compiled with ``anywhere=False``.

        ``failed`` remembers, between calls with the same ``data``, states at every 16th place after which no match ended: a later start
        that comes to the same state there stops. So each place is read at most once per state, with up to 16 more per start.
        """
        s, best, table, accepting, dead, i, passed = 0, -1, self.table, self.accepting, self.dead, start, []
        while i < end:
            stop = min(end, (i | 15) + 1)
            for i in range(i, stop):
                s = table[s + data[i]]
                if s >= accepting:
                    best = i + 1
                elif s == dead:
                    break
            if s == dead:
                break
            i = stop
            name = i * len(table) + s
            if failed and name in failed:
                break
            passed.append(name)
        if passed and failed is not None:
            failed.update(x for x in passed if x >= best * len(table))
        return best


def compile_rules(patterns: list[tuple[str, bool]], anywhere: bool = True) -> Dfa:
    """One minimal automaton for ``(pattern, either case)`` rules; with ``anywhere`` a match may begin at every byte."""
    nfa = _Nfa(False)
    root, ends = nfa.state(), set()
    for p, fold in patterns:
        nfa.fold = fold
        begin = nfa.state()
        nfa.eps[root].append(begin)
        ends.add(_build(nfa, _parse(nfa, p), begin))

    # bytes that no rule tells apart share a column
    masks = sorted({a[0] for a in nfa.arc if a})
    signature = [tuple(m >> b & 1 for m in masks) for b in range(256)]
    column = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = bytes(column[s] for s in signature)
    sample = [classes.index(c) for c in range(len(column))]

    closed: dict[int, frozenset] = {}

    def closure(s: int) -> frozenset:
        if s not in closed:
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.eps[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closed[s] = frozenset(x for x in seen if nfa.arc[x] or x in ends)
        return closed[s]

    go = [[closure(a[1]) if a and a[0] >> b & 1 else None for b in sample] for a in nfa.arc]
    first = closure(root)
    ever = first if anywhere else frozenset()
    number, rows, todo = {first: 0}, [], [first]
    for states in todo:
        row, moves = [], [go[s] for s in states]
        for c in range(len(sample)):
            to = ever.union(*(m[c] for m in moves if m[c]))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows)
    accept = np.array([bool(s & ends) for s in todo])

    block = accept.astype(np.int64)  # partition refinement until no block splits
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    some = np.unique(block, return_index=True)[1]  # a state of each block
    order = sorted(range(len(some)), key=lambda b: (accept[some[b]], b != block[0], b))
    place = np.empty(len(some), dtype=np.int64)
    place[order] = np.arange(len(some))
    small = place[block[table[some[order]]]]
    width = 1 << max(1, (small.shape[1] - 1).bit_length())
    full = np.zeros((len(some), width), dtype=np.int64)
    full[:, :small.shape[1]] = small * width
    quiet = [i for i in range(len(some)) if not accept[some[order[i]]] and (small[i] == i).all()]
    return Dfa(classes, width, full.reshape(-1).tolist(), int((~accept[some]).sum()) * width, quiet[0] * width if quiet else -1)
