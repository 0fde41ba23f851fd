"""Regular expressions as deterministic automata over bytes, in transition arrays.

Supported: ASCII literals and escapes, ``\\xHH``, classes with ranges, groups,
``(?i:...)``, alternatives, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np

_QUOTED = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class _Parser:
    """Syntax trees: ``("set", bytes)``, ``("cat", parts)``, ``("alt", parts)``, ``("rep", part, least, most)``."""

    def __init__(self, pattern: str):
        self.text, self.at, self.either = pattern, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"pattern ends too early: {self.text!r}")
        self.at += 1
        return self.text[self.at - 1]

    def whole(self):
        tree = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unmatched {self.peek()!r} in {self.text!r}")
        return tree

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.atom()
            while self.peek() and self.peek() in "?*+{":
                part = ("rep", part, *self.times())
            parts.append(part)
        return ("cat", parts)

    def times(self) -> tuple[int, int | None]:
        sign = self.take()
        if sign != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
        end = self.text.index("}", self.at)
        least, comma, most = self.text[self.at : end].partition(",")
        self.at = end + 1
        return int(least), (int(most) if most else None) if comma else int(least)

    def atom(self):
        sign = self.take()
        if sign == "(":
            before = self.either
            for mark, either in (("?i:", True), ("?:", before)):
                if self.text.startswith(mark, self.at):
                    self.at, self.either = self.at + len(mark), either
                    break
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"a group is open in {self.text!r}")
            self.either = before
            return tree
        if sign == "[":
            return ("set", self.cased(self.members()))
        if sign in ".^$":
            raise ValueError(f"{sign!r} is not supported: {self.text!r}")
        return ("set", self.cased(frozenset([self.byte(sign)])))

    def byte(self, sign: str) -> int:
        if sign == "\\":
            sign = self.take()
            if sign == "x":
                return int(self.take() + self.take(), 16)
            if sign.isalnum():
                if sign not in _QUOTED:
                    raise ValueError(f"\\{sign} is not supported: {self.text!r}")
                return _QUOTED[sign]
        if ord(sign) > 127:
            raise ValueError(f"patterns are ASCII: {self.text!r}")
        return ord(sign)

    def members(self) -> frozenset[int]:
        out, other = set(), self.peek() == "^"
        self.at += other
        while (sign := self.take()) != "]":
            low = high = self.byte(sign)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("", "]"):
                self.take()
                high = self.byte(self.take())
            out |= set(range(low, high + 1))
        return frozenset(set(range(256)) - out if other else out)

    def cased(self, found: frozenset[int]) -> frozenset[int]:
        if not self.either:
            return found
        return found | {b ^ 32 for b in found if chr(b).isalpha() and b < 128}


def parse(pattern: str):
    return _Parser(pattern).whole()


def mirrored(tree):
    """The tree of the same texts read backwards."""
    kind, *rest = tree
    if kind == "cat":
        return ("cat", [mirrored(part) for part in reversed(rest[0])])
    if kind == "alt":
        return ("alt", [mirrored(part) for part in rest[0]])
    return ("rep", mirrored(rest[0]), *rest[1:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """States of ``tree`` from ``start`` on; the state after it."""
        kind, *rest = tree
        if kind == "set":
            end = self.state()
            here = self.state()
            self.free[start].append(here)
            self.step[here] = (rest[0], end)
            return end
        if kind == "cat":
            for part in rest[0]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in rest[0]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(part, begin)].append(end)
            return end
        part, least, most = rest
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
        else:
            for _ in range(most - least):
                self.free[start].append(end)
                start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class Dfa(NamedTuple):
    """``moves[state * width + kind[byte]]`` is the next state, times ``width``.

    State 0 is the start. Accepting states come last, from ``accepts`` (also times
    ``width``) on; bit ``r`` of ``marks[state]`` says that pattern ``r`` ends there.
    ``dead`` is the state that nothing leaves, or -1. ``resets`` holds the bytes that
    lead from any state to the start.
    """

    moves: np.ndarray
    kind: np.ndarray
    width: int
    accepts: int
    marks: np.ndarray
    dead: int
    resets: np.ndarray


def build(trees: tuple, anywhere: bool) -> Dfa:
    """One automaton for all trees, by subset construction and minimisation.

    ``anywhere`` lets a match begin at every byte.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for bit, tree in enumerate(trees):
        begin = nfa.state()
        nfa.free[root].append(begin)
        ends[nfa.add(tree, begin)] = bit
    sets = list({s[0] for s in nfa.step if s})
    member = np.zeros((256, len(sets)), bool)
    for i, own in enumerate(sets):
        member[list(own), i] = True
    rows, kind = np.unique(member, axis=0, return_inverse=True)
    kind, width = kind.reshape(-1), len(rows)
    takes = [{i for i, own in enumerate(sets) if row[i]} for row in rows]
    number = {own: i for i, own in enumerate(sets)}
    start = nfa.closure({root})
    found, todo, table = {start: 0}, [start], []
    for states in todo:
        row = []
        for own in takes:
            after = {nfa.step[s][1] for s in states if nfa.step[s] and number[nfa.step[s][0]] in own}
            after = nfa.closure(after | {root}) if anywhere else nfa.closure(after)
            if after not in found:
                found[after] = len(found)
                todo.append(after)
            row.append(found[after])
        table.append(row)
    moves = np.array(table, np.int64)
    marks = np.array([sum(1 << ends[s] for s in states if s in ends) for states in todo], np.int64)
    return _minimised(moves, marks, kind.astype(np.uint8), width)


def _minimised(moves: np.ndarray, marks: np.ndarray, kind: np.ndarray, width: int) -> Dfa:
    """States that no text tells apart become one, by refinement of their classes."""
    _, group = np.unique(marks, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    # The start first, accepting states last.
    place = np.lexsort((first, marks[first] > 0, group[first] != group[0]))
    if marks[0]:
        raise ValueError("a pattern matches the empty text")
    new = np.empty(len(place), np.int64)
    new[place] = np.arange(len(place))
    first = first[place]
    moves, marks = new[group[moves[first]]], marks[first]
    stuck = np.flatnonzero((moves == np.arange(len(moves))[:, None]).all(1) & (marks == 0))
    accepts = int(np.flatnonzero(marks)[0]) if marks.any() else len(marks)
    resets = (moves == 0).all(0)[kind]
    return Dfa(
        (moves * width).astype(np.int32).reshape(-1), kind, width, accepts * width, marks,
        int(stuck[0]) * width if len(stuck) else -1, resets,
    )


@functools.lru_cache(64)
def anchored(pattern: str) -> Dfa:
    return build((parse(pattern),), False)


@functools.lru_cache(8)
def starts_of(patterns: tuple[str, ...]) -> Dfa:
    """Reads texts backwards; marks every byte at which a match of a pattern begins."""
    return build(tuple(mirrored(parse(p)) for p in patterns), True)


def longest(dfa: Dfa, raw: bytes, at: int, end: int) -> int:
    """End of the longest match that begins at ``at``, or -1."""
    state, out, moves, kind = 0, -1, _lists(id(dfa), dfa)[0], _lists(id(dfa), dfa)[1]
    accepts, dead = dfa.accepts, dfa.dead
    for i in range(at, end):
        state = moves[state + kind[raw[i]]]
        if state >= accepts:
            out = i + 1
        elif state == dead:
            break
    return out


_LISTS: dict[int, tuple] = {}


def _lists(key: int, dfa: Dfa) -> tuple[list[int], list[int]]:
    """The arrays as lists, which single look-ups read faster."""
    held = _LISTS.get(key)
    if held is None or held[2] is not dfa:
        held = _LISTS[key] = (dfa.moves.tolist(), dfa.kind.tolist(), dfa)
    return held[:2]


#: Bytes between two places where the scan may start, about.
STRIDE = 256
#: With fewer lanes left than this the rest is scanned lane by lane.
FEW = 24


def scan_backwards(dfa: Dfa, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions marked by ``dfa`` in consecutive texts, ascending, and their marks.

    Every byte is read once. A byte that leads from any state to the start lets
    the scan begin there, so many such stretches advance side by side.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kinds = dfa.kind[raw]
    free = np.flatnonzero(dfa.resets[raw])
    some = free[np.minimum(np.searchsorted(free, np.arange(0, n, STRIDE)), len(free) - 1)] if len(free) else free
    cuts = np.unique(np.concatenate([offs, some]))
    low, high = cuts[:-1], cuts[1:]
    order = np.argsort(low - high, kind="stable")
    low, high = low[order], high[order]
    sizes = high - low
    state = np.zeros(len(low), np.int32)
    at, marks = [], []
    step, left = 0, len(low)
    while True:
        left = int(np.searchsorted(-sizes[:left], -step))
        if left < FEW:
            break
        pos = high[:left] - (1 + step)
        state = dfa.moves[state[:left] + kinds[pos]]
        if int(state.max()) >= dfa.accepts:
            hit = np.flatnonzero(state >= dfa.accepts)
            at.append(pos[hit])
            marks.append(dfa.marks[state[hit] // dfa.width])
        step += 1
    moves = _lists(id(dfa), dfa)[0] if left else []
    for lane in range(left):
        one, stop = int(state[lane]), int(high[lane]) - step
        mine, seen = [], []
        for back, kind in enumerate(kinds[low[lane] : stop][::-1].tobytes(), 1):
            one = moves[one + kind]
            if one >= dfa.accepts:
                mine.append(stop - back)
                seen.append(one)
        if mine:
            at.append(np.array(mine, np.int64))
            marks.append(dfa.marks[np.array(seen) // dfa.width])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, marks = np.concatenate(at), np.concatenate(marks)
    order = np.argsort(at)
    return at[order], marks[order]
