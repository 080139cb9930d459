"""Weighted finite-state clauses: expressions over word classes, composed with an automaton of their context.

Each clause is an expression; all of them together are one nondeterministic machine. A second machine reads the context
of a sentence: quotation, reporting verbs, negation and self-address. Both are composed, a clause that begins is tagged
with the context it begins in, and the composition is made deterministic while texts are read: a table of states by
symbols that fills as it is needed. Its outputs are (clause, context) pairs; their weights lie with the caller.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

PLAIN, NEGATED, SELF, REPORTED, QUOTED = range(5)
END, QUOTE, COMMA = "|", '"', ","
_PIECE = re.compile(r"[()|?*]|\{\d+,\d+\}|<\w+>|[^\s()|?*{}<>]+")
#: a table is begun anew beyond so many states; results do not change
MOST_STATES = 10_000


class Machine:
    """A nondeterministic machine of clauses, built from expressions.

    Words are separated by blanks; ``( | )`` alternatives, ``?``, ``*`` and ``{m,n}`` repeat what stands before; ``.`` is any
    word but a sentence's end, ``$`` that end, ``^`` a sentence's beginning; ``<name>`` is another expression."""

    def __init__(self, named: dict[str, str]):
        self.named = named
        self.arcs: list[dict[str, set[int]]] = []
        self.free: list[set[int]] = []
        self.accepts: dict[int, int] = {}
        self.begins: list[int] = []
        self.begins_sentence: list[int] = []
        self.words: set[str] = {END, QUOTE, COMMA}

    def _state(self) -> int:
        self.arcs.append({})
        self.free.append(set())
        return len(self.arcs) - 1

    def add(self, expression: str, clause: int) -> None:
        a, b = self._state(), self._state()
        at_start = expression.startswith("^ ")
        pieces = _PIECE.findall(expression[2:] if at_start else expression)
        if self._either(pieces, 0, a, b) != len(pieces):
            raise ValueError(f"cannot read {expression!r}")
        (self.begins_sentence if at_start else self.begins).append(a)
        self.accepts[b] = clause

    def _either(self, p: list[str], i: int, a: int, b: int) -> int:
        while True:
            i = self._run(p, i, a, b)
            if i >= len(p) or p[i] != "|":
                return i
            i += 1

    def _run(self, p: list[str], i: int, a: int, b: int) -> int:
        at = a
        while i < len(p) and p[i] not in "|)":
            begin, depth = i, 0
            while True:  # one word or group
                depth += (p[i] == "(") - (p[i] == ")")
                i += 1
                if not depth:
                    break
            unit, lo, hi = p[begin:i], 1, 1
            if i < len(p) and (p[i] in "?*" or p[i][0] == "{"):
                lo, hi = {"?": (0, 1), "*": (0, -1)}.get(p[i]) or tuple(map(int, p[i][1:-1].split(",")))
                i += 1
            for _ in range(lo):
                at = self._unit(unit, at)
            if hi < 0:
                loop = self._state()
                self.free[at].add(loop)
                self.free[self._unit(unit, loop)].add(loop)
                at = loop
            elif hi > lo:
                out = self._state()
                for _ in range(hi - lo):
                    self.free[at].add(out)
                    at = self._unit(unit, at)
                self.free[at].add(out)
                at = out
        self.free[at].add(b)
        return i

    def _unit(self, unit: list[str], at: int) -> int:
        out = self._state()
        if unit[0] == "(":
            self._either(unit[1:-1], 0, at, out)
        elif unit[0][0] == "<":
            self._either(_PIECE.findall(self.named[unit[0][1:-1]]), 0, at, out)
        else:
            word = END if unit[0] == "$" else unit[0]
            self.words.add(word)
            self.arcs[at].setdefault(word, set()).add(out)
        return out

    def closed(self, states: Iterable[int]) -> set[int]:
        todo, seen = list(states), set()
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.free[s]
        return seen


class _State:
    __slots__ = ("context", "open", "next", "out")

    def __init__(self, context: tuple, open_: frozenset[int], out: tuple, size: int):
        self.context, self.open, self.out = context, open_, out
        self.next: list[_State | None] = [None] * size


class Composed:
    """The clauses of a ``Machine`` composed with the context, deterministic as far as it was used.

    ``reports``: symbols of reporting words, ``frames``: pairs of words that report ("words like"); both hold for the next
    six words. ``negations`` take back a clause that follows at once or after ``links``. ``selves`` followed by one of
    ``feelings`` take back one that begins within three words."""

    def __init__(self, machine: Machine, reports: set[str], frames: set[tuple[str, str]], negations: set[str], links: set[str], selves: set[str], feelings: set[str]):
        self.m = machine
        self.reports, self.frames, self.negations, self.links, self.selves, self.feelings = reports, frames, negations, links, selves, feelings
        known = machine.words | reports | negations | links | selves | feelings | {w for f in frames for w in f}
        self.names = [".", *sorted(known - {"."})]
        self.symbol = {w: i for i, w in enumerate(self.names)}
        self.size = machine.arcs and len(machine.arcs)
        self.mid, self.first = machine.closed(machine.begins), machine.closed([*machine.begins, *machine.begins_sentence])
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state((True, False, False, 0, False, False, 0, ""), frozenset(), ())

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("states", "start")}

    def __setstate__(self, d):
        self.__dict__.update(d)
        self._clear()

    def _state(self, context: tuple, open_: frozenset[int], out: tuple) -> _State:
        key = (context, open_, out)
        if key not in self.states:
            self.states[key] = _State(context, open_, out, len(self.names))
        return self.states[key]

    @staticmethod
    def _tag(context: tuple) -> int:
        """What the context makes of a clause that begins here."""
        _, quoted, reported, near, denied, _, feeling, _ = context
        if near or quoted and reported:
            return REPORTED
        if denied:
            return NEGATED
        if feeling:
            return SELF
        return QUOTED if quoted else PLAIN

    def _read(self, context: tuple, word: str) -> tuple:
        """(at the sentence's beginning, in quotes, report read, words it still holds for, denied, self read, words a feeling
        still holds for, last word if a frame may begin with it)"""
        _, quoted, reported, near, denied, me, feeling, last = context
        if word == END:
            return (True, False, False, 0, False, False, 0, "")
        report = word in self.reports
        if word == QUOTE:
            quoted = not quoted
        holds = 7 if report or (last, word) in self.frames else max(0, near - 1)
        denied = word in self.negations or denied and word in self.links
        feeling = 4 if me and word in self.feelings else max(0, feeling - 1)
        starts = word if any(word == a for a, _ in self.frames) else ""
        return (False, quoted, reported or report, holds, denied, word in self.selves, feeling, starts)

    def step(self, state: _State, k: int) -> _State:
        """The next state for symbol ``k``, computed once."""
        word, m, n = self.names[k], self.m, self.size
        tag = self._tag(state.context)
        begin = self.first if state.context[0] else self.mid
        reached: set[int] = set()
        for tagged in {*state.open, *(tag * n + s for s in begin)}:
            t, s = divmod(tagged, n)
            arcs = m.arcs[s]
            to = arcs.get(word, set()) if word == END else arcs.get(word, set()) | arcs.get(".", set())
            if to:
                reached.update(t * n + x for x in m.closed(to))
        out: dict[int, int] = {}
        for tagged in reached:
            t, s = divmod(tagged, n)
            if (clause := m.accepts.get(s)) is not None:  # of two beginnings the one that is taken back
                out[clause] = t if clause not in out or out[clause] == PLAIN else out[clause]
        kept = frozenset(x for x in reached if m.arcs[x % n])
        if len(self.states) > MOST_STATES:
            self._clear()
        state.next[k] = self._state(self._read(state.context, word), kept, tuple(sorted(out.items())))
        return state.next[k]

    def read(self, words: list[str]) -> set[tuple[int, int]]:
        """Every (clause, context) of a text. A clause in quotes counts as reported if a reporting word follows in the
        sentence, or the quotes end right after it or after its sentence; else as plain."""
        found: set[tuple[int, int]] = set()
        waiting: set[int] = set()  # in quotes, their sentence not ended
        closing: set[int] = set()  # in quotes, their sentence just ended
        fresh: tuple[int, ...] = ()
        get, state = self.symbol.get, self.start
        for w in [*words, END, END]:
            k = get(w, 0)
            state = state.next[k] or self.step(state, k)
            if closing:
                found.update((c, REPORTED if w == QUOTE else PLAIN) for c in closing)
                closing = set()
            if waiting:
                if w in self.reports:
                    found.update((c, REPORTED) for c in waiting)
                    waiting = set()
                elif w == QUOTE and fresh:
                    found.update((c, REPORTED) for c in fresh)
                    waiting.difference_update(fresh)
                fresh = ()
            for clause, tag in state.out:
                if tag != QUOTED:
                    found.add((clause, tag))
                elif w == QUOTE:
                    found.add((clause, REPORTED))
                else:
                    waiting.add(clause)
                    fresh = (*fresh, clause)
            if w == END and waiting:
                closing, waiting = waiting, set()
        return found
