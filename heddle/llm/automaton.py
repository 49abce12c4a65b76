"""One deterministic automaton for several search patterns, compiled by subset construction.

Patterns are made of literals, ``\\`` escapes, ``\\xHH``, ``[...]`` classes of bytes, groups, ``(?i:...)``
(ASCII letters in either case), ``|``, ``?``, ``*`` and ``+``. The automaton finds, for each pattern by
itself, its leftmost non-overlapping longest matches, all in one pass over bytes.

Construction. Each pattern becomes an automaton with empty moves. Its deterministic states hold the
open attempts, earliest start first: sets of states, no state in two of them, as an earlier start is
preferred. Once an attempt accepts, later starts overlap it and are dropped, until it can't go on;
then its match ends and attempts start anew at that byte. The age of an attempt in bytes is part of
the state while it is young; the place where an older one started goes to a register. So what
registers are set and what matches end depends on state and byte alone and is part of the
transition; most transitions do neither. States of the combined automaton are tuples of the
patterns' states. Equivalent states, those whose transitions do the same and lead to equivalent
ones, are merged, and bytes that no state tells apart share a column.

A pattern must be such that what extends a match stays a match (it ends in a repeated class or in a
literal), and that no later start accepts while an earlier one is open. Both are checked when the
patterns are compiled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

LETTERS = frozenset(range(65, 91)) | frozenset(range(97, 123))


class _Nfa:
    """Empty moves, and moves by sets of bytes, of one pattern."""

    def __init__(self, pattern: str):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.pattern, self.at = pattern, 0
        self.start, self.accept = self._choice(False)
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} of {pattern!r}")

    def _state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.moves) - 1

    def _peek(self, what: str) -> bool:
        return self.pattern.startswith(what, self.at)

    def _take(self, what: str) -> bool:
        found = self._peek(what)
        self.at += len(what) * found
        return found

    def _choice(self, fold: bool) -> tuple[int, int]:
        start, end = self._state(), self._state()
        while True:
            first, last = self._sequence(fold)
            self.empty[start].append(first)
            self.empty[last].append(end)
            if not self._take("|"):
                return start, end

    def _sequence(self, fold: bool) -> tuple[int, int]:
        start = end = self._state()
        while self.at < len(self.pattern) and not self._peek("|") and not self._peek(")"):
            first, last = self._repeated(fold)
            self.empty[end].append(first)
            end = last
        return start, end

    def _repeated(self, fold: bool) -> tuple[int, int]:
        first, last = self._atom(fold)
        if not any(map(self._peek, "?*+")):
            return first, last
        kind = self.pattern[self.at]
        self.at += 1
        start, end = self._state(), self._state()
        self.empty[start].append(first)
        self.empty[last].append(end)
        if kind != "?":
            self.empty[last].append(first)
        if kind != "+":
            self.empty[start].append(end)
        return start, end

    def _atom(self, fold: bool) -> tuple[int, int]:
        if self._take("("):
            inside = self._choice(self._take("?i:") or fold)
            if not self._take(")"):
                raise ValueError(f"open group in {self.pattern!r}")
            return inside
        chosen = self._class() if self._take("[") else {self._byte()}
        if fold:
            chosen |= {b ^ 32 for b in chosen if b in LETTERS}
        start, end = self._state(), self._state()
        self.moves[start] = (frozenset(chosen), end)
        return start, end

    def _class(self) -> set[int]:
        chosen: set[int] = set()
        while not self._take("]"):
            low = high = self._byte()
            if self._peek("-") and not self._peek("-]"):
                self.at += 1
                high = self._byte()
            chosen |= set(range(low, high + 1))
        return chosen

    def _byte(self) -> int:
        if self.at >= len(self.pattern):
            raise ValueError(f"unexpected end of {self.pattern!r}")
        if self._take("\\x"):
            self.at += 2
            return int(self.pattern[self.at - 2 : self.at], 16)
        self._take("\\")
        self.at += 1
        code = ord(self.pattern[self.at - 1])
        if code > 127:
            raise ValueError("patterns are of ASCII bytes")
        return code

    def closure(self, states) -> frozenset[int]:
        found, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in found:
                found.add(s)
                todo += self.empty[s]
        return frozenset(found)

    def after(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure(self.moves[s][1] for s in states if self.moves[s] and byte in self.moves[s][0])


class _Attempt(NamedTuple):
    """States, and how many bytes ago it started and first accepted: 0 for never, OLD for long ago."""

    states: frozenset[int]
    age: int
    open: int


class _Act(NamedTuple):
    """What a transition does for a pattern. ``ends``: (age, open) of a match that ends before this byte;
    ``starts``: where registers of starts come from, an old register or, for -1, YOUNG bytes ago;
    ``opened``: the first accepting byte was YOUNG bytes ago."""

    pattern: int
    ends: tuple[int, int] | None
    starts: tuple[int, ...] | None
    opened: bool


class Automaton:
    """Transition arrays of several patterns: ``classes`` (256 bytes to columns), ``table`` (the next
    state's offset, or ~k for entry k of ``moves``), ``moves`` (next offset, and acts).

    ``least`` has, for each pattern, the least length of a match, or of its part from the first
    accepting byte on where ``last`` is true; shorter matches are dropped after they are matched.
    """

    #: A byte of no text in UTF-8, which ends all attempts; the age until which states tell ages
    #: apart; the mark of older ones.
    END, YOUNG, OLD = 255, 4, 99

    def __init__(self, patterns: list[str], least: list[int] | None = None, last: list[bool] | None = None, most_states: int = 100_000):
        nfas = [_Nfa(p) for p in patterns]
        self.least, self.last = least or [0] * len(nfas), last or [False] * len(nfas)
        columns = self._columns(nfas)
        single = [self._single(r, n, columns) for r, n in enumerate(nfas)]
        states = [(0,) * len(nfas)]
        numbers, rows = {states[0]: 0}, []
        while len(rows) < len(states):
            own = [single[r][s] for r, s in enumerate(states[len(rows)])]
            row = []
            for moved in zip(*own, strict=True):
                after = tuple([t for t, _ in moved])
                if after not in numbers:
                    numbers[after] = len(states)
                    states.append(after)
                    if len(states) > most_states:
                        raise ValueError("too many states")
                row.append((numbers[after], tuple([a for _, a in moved if a])))
            rows.append(row)
        self._lay(rows)

    def _columns(self, nfas: list[_Nfa]) -> list[int]:
        """Sets ``classes``; one byte of each column."""
        sets = [m[0] for n in nfas for m in n.moves if m]
        kinds: dict[tuple, int] = {}
        self.classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
        return [self.classes.index(k) for k in range(len(kinds))]

    def _single(self, pattern: int, nfa: _Nfa, columns: list[int]) -> list[list[tuple[int, _Act | None]]]:
        """The transitions of one pattern's states."""
        start = nfa.closure([nfa.start])
        if nfa.accept in start:
            raise ValueError(f"{nfa.pattern!r} matches nothing at all")
        states: list[tuple[_Attempt, ...]] = [()]
        numbers, rows = {states[0]: 0}, []
        while len(rows) < len(states):
            row = []
            for byte in columns:
                after, act = self._step(pattern, nfa, start, states[len(rows)], byte)
                if after not in numbers:
                    numbers[after] = len(states)
                    states.append(after)
                row.append((numbers[after], act))
            rows.append(row)
        return rows

    def _older(self, age: int) -> int:
        return age + 1 if age < self.YOUNG else self.OLD

    def _short(self, pattern: int, attempt: _Attempt) -> bool:
        """Whether a match is surely shorter than it has to be."""
        size = attempt.open if self.last[pattern] else attempt.age
        return size != self.OLD and size < self.least[pattern]

    def _step(self, pattern: int, nfa: _Nfa, start: frozenset[int], attempts: tuple[_Attempt, ...], byte: int):
        ends, left = None, attempts
        if attempts and attempts[0].open:
            held = attempts[0]
            moved = nfa.after(held.states, byte)
            if moved:
                if nfa.accept not in moved:
                    raise ValueError(f"what extends a match of {nfa.pattern!r} isn't always a match")
                now = _Attempt(moved, self._older(held.age), self._older(held.open))
                older, opened = held.age != now.age == self.OLD, held.open != now.open == self.OLD
                act = _Act(pattern, None, (-1,) if older else None, opened) if older or opened else None
                return (now,), act
            left = ()
            ends = None if self._short(pattern, held) else (held.age, held.open)
        out, starts, seen = [], [], set()
        for k, attempt in enumerate([*left, _Attempt(start, 0, 0)]):
            moved = nfa.after(attempt.states, byte) - seen
            if not moved:
                continue
            seen |= moved
            accepts = nfa.accept in moved
            now = _Attempt(frozenset(moved), self._older(attempt.age), int(accepts))
            # Registers of the young hold nothing, so they may stay as they are.
            starts.append(-1 if attempt.age != now.age == self.OLD else k if now.age == self.OLD else len(out))
            out.append(now)
            if accepts:
                if len(out) > 1:
                    raise ValueError(f"a later start of {nfa.pattern!r} accepts before an earlier one ends")
                break
        same = starts == list(range(len(out)))
        act = None if same and ends is None else _Act(pattern, ends, None if same else tuple(starts), False)
        return tuple(out), act

    def _lay(self, rows: list[list[tuple[int, tuple]]]) -> None:
        """Merge equivalent states and lay out the arrays."""
        acts: dict[tuple, int] = {(): 0}
        target = np.array([[t for t, _ in row] for row in rows])
        act = np.array([[acts.setdefault(a, len(acts)) for _, a in row] for row in rows])
        block, count = np.zeros(len(rows), "int64"), 0
        while True:
            told = np.unique(np.hstack([act, block[target]]), axis=0, return_inverse=True)[1].ravel()
            if told.max() + 1 == count:
                break
            block, count = told, told.max() + 1
        _, one = np.unique(block, return_index=True)
        width, names = target.shape[1], list(acts)
        table, act = block[target[one]] * width, act[one]
        self.moves: list[tuple[int, tuple[_Act, ...]]] = []
        for i, j in np.argwhere(act > 0):
            self.moves.append((int(table[i, j]), names[act[i, j]]))
            table[i, j] = -len(self.moves)
        self.first, self.states, self.table = int(block[0]) * width, len(one), table.ravel().tolist()

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(pattern, start, end) of all matches that are long enough, by end."""
        table, moves, at, young, old = self.table, self.moves, self.first, self.YOUNG, self.OLD
        starts: list[list[int]] = [[] for _ in self.least]
        opened, found = [0] * len(self.least), []
        for i, column in enumerate((data + bytes([self.END])).translate(self.classes)):
            at = table[at + column]
            if at < 0:
                at, acts = moves[~at]
                for r, ends, origins, opens in acts:
                    if ends is not None:
                        age, run = ends
                        start = starts[r][0] if age == old else i - age
                        size = i - ((opened[r] if run == old else i - run) if self.last[r] else start)
                        if size >= self.least[r]:
                            found.append((r, start, i))
                    if origins is not None:
                        held = starts[r]
                        starts[r] = [i - young if k < 0 else held[k] if k < len(held) else 0 for k in origins]
                    if opens:
                        opened[r] = i - young
        return found
