"""A regex dialect for patterns, compiled to minimal deterministic automata over the printable characters."""

from __future__ import annotations

import string
from dataclasses import dataclass

#: The symbols that patterns are made of. Blanks are space and tab alone, so line feed, carriage return, vertical tab and form feed are word characters.
ALPHABET = frozenset(string.printable)
BLANKS = frozenset(" \t")
CLASSES = {
    "s": BLANKS, "S": ALPHABET - BLANKS,
    "d": frozenset(string.digits), "D": ALPHABET - frozenset(string.digits),
    "w": frozenset(string.ascii_letters + string.digits + "_"), "W": ALPHABET - frozenset(string.ascii_letters + string.digits + "_"),
}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}


@dataclass(frozen=True)
class Dfa:
    """States from 0, the initial one; per state its moves; the accepting states. Dead states are left out."""

    moves: tuple[dict[str, int], ...]
    accepting: frozenset[int]

    def accepts(self, word: str) -> bool:
        state = 0
        for c in word:
            if (state := self.moves[state].get(c, -1)) < 0:
                return False
        return state in self.accepting

    @property
    def run_of(self) -> frozenset[str] | None:
        """The class C if the language is C+, else None."""
        if len(self.moves) == 2 and self.accepting == {1} and self.moves[0] == self.moves[1] and set(self.moves[0].values()) == {1}:
            return frozenset(self.moves[0])
        return None


class _Parser:
    """Recursive descent to an epsilon automaton: ``edges[q]`` holds (characters or None, target)."""

    def __init__(self, regex: str):
        self.regex, self.at = regex, 0
        self.edges: list[list[tuple[frozenset[str] | None, int]]] = []

    def fail(self, why: str):
        raise ValueError(f"{why} at {self.at} in {self.regex!r}")

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def peek(self) -> str:
        return self.regex[self.at] if self.at < len(self.regex) else ""

    def parse(self) -> tuple[int, int]:
        node = self.alternation()
        if self.at < len(self.regex):
            self.fail("an unbalanced parenthesis")
        return self.build(node)

    def alternation(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while (c := self.peek()) and c not in "|)":
            parts.append(self.repeated())
        return ("and", parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.at += 1
            if c == "{":
                close = self.regex.find("}", self.at)
                low, comma, high = self.regex[self.at : close].partition(",")
                if close < 0 or not low.strip().isdigit() or high.strip() and not high.strip().isdigit():
                    self.fail("a repeat count that is no number")
                self.at = close + 1
                least, most = int(low), (int(high) if high.strip() else None) if comma else int(low)
            else:
                least, most = (1 if c == "+" else 0), (1 if c == "?" else None)
            node = ("repeat", node, least, most)
        return node

    def atom(self):
        c = self.peek()
        self.at += 1
        if c == "(":
            if self.regex.startswith("?:", self.at):
                self.at += 2
            elif self.peek() == "?":
                self.fail("a group of an unknown kind")
            node = self.alternation()
            if self.peek() != ")":
                self.fail("a group that isn't closed")
            self.at += 1
            return node
        if c == "[":
            return ("set", self.bracket())
        if c == "\\":
            return ("set", self.escape())
        if c in ".^$*+?{":
            self.fail(f"{c!r}, which this dialect does not have,")
        return ("set", frozenset(c))

    def escape(self) -> frozenset[str]:
        c = self.peek()
        self.at += 1
        if c in CLASSES:
            return CLASSES[c]
        if not c or c.isalnum() and c not in ESCAPES:
            self.fail("an unknown escape")
        return frozenset(ESCAPES.get(c, c))

    def bracket(self) -> frozenset[str]:
        negated = self.peek() == "^"
        self.at += negated
        found: set[str] = set()
        first = True
        while (c := self.peek()) != "]" or first:
            if not c:
                self.fail("a class that isn't closed")
            first = False
            self.at += 1
            own = self.escape() if c == "\\" else frozenset(c)
            if self.peek() == "-" and self.regex[self.at + 1 : self.at + 2] not in ("]", "") and len(own) == 1:
                self.at += 1
                end = self.peek()
                self.at += 1
                end = next(iter(self.escape())) if end == "\\" else end
                start = next(iter(own))
                if start > end:
                    self.fail("a range in the wrong order")
                own = frozenset(map(chr, range(ord(start), ord(end) + 1)))
            found |= own
        self.at += 1
        return ALPHABET - found if negated else frozenset(found)

    def build(self, node) -> tuple[int, int]:
        kind = node[0]
        a = self.state()
        if kind == "set":
            b = self.state()
            self.edges[a].append((node[1] & ALPHABET, b))
        elif kind == "and":
            b = a
            for part in node[1]:
                x, y = self.build(part)
                self.edges[b].append((None, x))
                b = y
        elif kind == "or":
            b = self.state()
            for option in node[1]:
                x, y = self.build(option)
                self.edges[a].append((None, x))
                self.edges[y].append((None, b))
        else:
            _, inner, least, most = node
            b = a
            for _ in range(least):
                x, y = self.build(inner)
                self.edges[b].append((None, x))
                b = y
            if most is None:
                x, y = self.build(inner)
                loop = self.state()
                self.edges[b].append((None, loop))
                self.edges[loop].append((None, x))
                self.edges[y].append((None, loop))
                b = loop
            else:
                end = self.state()
                for _ in range(most - least):
                    self.edges[b].append((None, end))
                    x, y = self.build(inner)
                    self.edges[b].append((None, x))
                    b = y
                self.edges[b].append((None, end))
                b = end
        return a, b


def compile_dfa(regex: str) -> Dfa:
    """The minimal automaton of a regex: literals, classes, escapes \\s \\S \\d \\D \\w \\W, groups, alternation, * + ? {m} {m,} {m,n}."""
    parser = _Parser(regex)
    start, goal = parser.parse()

    def closure(states: frozenset[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for chars, target in parser.edges[todo.pop()]:
                if chars is None and target not in found:
                    found.add(target)
                    todo.append(target)
        return frozenset(found)

    first = closure(frozenset([start]))
    number, moves, todo = {first: 0}, [], [first]
    while todo:
        own, step = todo.pop(0), {}
        for c in sorted(ALPHABET):
            target = frozenset(t for q in own for chars, t in parser.edges[q] if chars is not None and c in chars)
            if target:
                target = closure(target)
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                step[c] = number[target]
        moves.append(step)
    return minimal(moves, {i for s, i in number.items() if goal in s})


def minimal(moves: list[dict[str, int]], accepting: set[int]) -> Dfa:
    """Merges states that no word tells apart, drops states from which nothing is accepted, and renumbers by breadth."""
    block = [int(q in accepting) for q in range(len(moves))]
    while True:
        keys = [(block[q], tuple(sorted((c, block[r]) for c, r in moves[q].items()))) for q in range(len(moves))]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        refined = [names[k] for k in keys]
        if len(names) == len(set(block)):
            break
        block = refined
    alive = set(accepting)
    while more := {q for q in range(len(moves)) if q not in alive and any(r in alive for r in moves[q].values())}:
        alive |= more
    order, queue = {refined[0]: 0}, [0]
    member = {refined[q]: q for q in range(len(moves) - 1, -1, -1)}
    out: list[dict[str, int]] = []
    while queue:
        q, step = queue.pop(0), {}
        for c, r in sorted(moves[q].items()):
            if r in alive:
                if refined[r] not in order:
                    order[refined[r]] = len(order)
                    queue.append(member[refined[r]])
                step[c] = order[refined[r]]
        out.append(step)
    return Dfa(tuple(out), frozenset(order[refined[q]] for q in accepting if refined[q] in order))
