"""CSS selectors (level 4, what documents need of it): parsed once, matched from right to left."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from webloom.functions.htmltree import Node

Test = Callable[["Node", "Scope"], bool]


@dataclass
class Compound:
    """Tests of one element; ``tag``, ``ids`` and ``classes`` are looked at first, as most elements fail there."""

    tag: str = ""
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    tests: list[Test] = field(default_factory=list)

    def fits(self, n: Node, scope: Scope) -> bool:
        if n.tag == "#document" or self.tag and n.tag != self.tag:
            return False
        if self.ids and any(n.attrs.get("id") != i for i in self.ids):
            return False
        if self.classes:
            have = n.attrs.get("class", "").split()
            if any(c not in have for c in self.classes):
                return False
        return all(t(n, scope) for t in self.tests)


@dataclass
class Chain:
    """Compounds from left to right; ``joints[i]`` stands before compound i (the first one's only means something in ``:has``)."""

    compounds: list[Compound]
    joints: list[str]


class Scope:
    """Places among siblings, worked out once a parent."""

    def __init__(self) -> None:
        self._of: dict[int, tuple[Node, list[Node], dict[int, int]]] = {}

    def siblings(self, n: Node) -> tuple[list[Node], int]:
        """The elements of n's parent and n's place among them."""
        parent = n.parent
        if parent is None:
            return [n], 0
        if id(parent) not in self._of:
            held = [c for c in parent.children if not isinstance(c, str)]
            self._of[id(parent)] = (parent, held, {id(c): i for i, c in enumerate(held)})
        _, held, place = self._of[id(parent)]
        return held, place.get(id(n), 0)


_SPACE = " \t\r\n\f"
_NAME = re.compile(r"(?:[\w-]|[^\x00-\x7F]|\\[0-9A-Fa-f]{1,6}[ \t\r\n\f]?|\\[^0-9A-Fa-f\r\n\f])+")
_STRING = re.compile(r""""((?:[^"\\\r\n\f]|\\[\s\S])*)"|'((?:[^'\\\r\n\f]|\\[\s\S])*)'""")
_ESCAPE = re.compile(r"\\(?:([0-9A-Fa-f]{1,6})[ \t\r\n\f]?|([\s\S]))")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n(?:\s*([+-])\s*(\d+))?|([+-]?\d+))\s*", re.IGNORECASE)
_OPERATOR = re.compile(r"[~|^$*!]?=")


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: (chr(int(m[1], 16)) if 0 < int(m[1], 16) < 0x110000 else "�") if m[1] else "" if m[2] == "\n" else m[2], text)


class Parser:
    """Recursive descent over one selector; anything else than a selector raises."""

    def __init__(self, css: str) -> None:
        self.css, self.at = css, 0

    def fail(self) -> ValueError:
        return ValueError(f"a selector that isn't known: {self.css}")

    def peek(self) -> str:
        return self.css[self.at : self.at + 1]

    def skip(self) -> bool:
        start = self.at
        while self.peek() and self.peek() in _SPACE:
            self.at += 1
        return self.at > start

    def take(self, pattern: re.Pattern) -> re.Match:
        m = pattern.match(self.css, self.at)
        if not m or m.end() == self.at:
            raise self.fail()
        self.at = m.end()
        return m

    def expect(self, ch: str) -> None:
        self.skip()
        if self.peek() != ch:
            raise self.fail()
        self.at += 1

    def name(self) -> str:
        return _unescaped(self.take(_NAME)[0])

    def chains(self, end: str = "", relative: bool = False) -> list[Chain]:
        out = [self.chain(end, relative)]
        while self.peek() == ",":
            self.at += 1
            out.append(self.chain(end, relative))
        if self.peek() != end:
            raise self.fail()
        return out

    def chain(self, end: str, relative: bool) -> Chain:
        self.skip()
        joint = " "
        if relative and self.peek() and self.peek() in ">+~":
            joint = self.peek()
            self.at += 1
            self.skip()
        out = Chain([self.compound()], [joint])
        while True:
            apart = self.skip()
            if self.peek() in ("", ",") or self.peek() == end:
                return out
            if self.peek() in ">+~":
                joint = self.peek()
                self.at += 1
                self.skip()
            elif apart:
                joint = " "
            else:
                raise self.fail()
            out.joints.append(joint)
            out.compounds.append(self.compound())

    def compound(self) -> Compound:
        out, start = Compound(), self.at
        if self.peek() == "*":
            self.at += 1
        elif _NAME.match(self.css, self.at):
            out.tag = self.name().lower()
        while True:
            ch = self.peek()
            if ch == "#":
                self.at += 1
                out.ids.append(self.name())
            elif ch == ".":
                self.at += 1
                out.classes.append(self.name())
            elif ch == "[":
                out.tests.append(self.attribute())
            elif ch == ":":
                out.tests.append(self.pseudo())
            elif self.at == start:
                raise self.fail()
            else:
                return out

    def attribute(self) -> Test:
        self.at += 1
        self.skip()
        name = self.name().lower()
        self.skip()
        if self.peek() == "]":
            self.at += 1
            return lambda n, _: name in n.attrs
        how = self.take(_OPERATOR)[0]
        self.skip()
        value = self.string() if self.peek() in ("'", '"') else self.name()
        self.skip()
        fold = self.peek().lower() == "i" and self.peek() != ""
        if self.peek().lower() in ("i", "s") and self.peek():
            self.at += 1
        self.expect("]")
        return _attribute(name, how, value, fold)

    def string(self) -> str:
        m = self.take(_STRING)
        return _unescaped(m[1] if m[1] is not None else m[2])

    def pseudo(self) -> Test:
        self.at += 1
        name = self.name().lower()
        if name in _PLAIN:
            return _PLAIN[name]
        self.expect("(")
        if name in ("not", "is", "where", "matches"):
            inner = self.chains(")")
            self.at += 1
            return (lambda n, s: not any(fits(n, c, s) for c in inner)) if name == "not" else (lambda n, s: any(fits(n, c, s) for c in inner))
        if name == "has":
            inner = self.chains(")", relative=True)
            self.at += 1
            return lambda n, s: any(_has(n, c, s) for c in inner)
        if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
            m = self.take(_NTH)
            a, b = _step(m)
            of = None
            if self.css[self.at : self.at + 2].lower() == "of" and name.endswith("child"):
                self.at += 2
                of = self.chains(")")
            self.expect(")")
            return _nth(a, b, "last" in name, name.endswith("type"), of)
        if name == "contains":
            self.skip()
            text = self.string()
            self.expect(")")
            return lambda n, _: text in n.text()
        raise self.fail()


def _step(m: re.Match) -> tuple[int, int]:
    if m[1]:
        return 2, int(m[1].lower() == "odd")
    if m[5] is not None:
        return 0, int(m[5])
    a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
    return a, int((m[3] or "") + (m[4] or "0"))


def _attribute(name: str, how: str, value: str, fold: bool) -> Test:
    value = value.lower() if fold else value

    def test(n: Node, _: Scope) -> bool:
        have = n.attrs.get(name)
        if have is None:
            return how == "!="
        have = have.lower() if fold else have
        if how == "=":
            return have == value
        if how == "!=":
            return have != value
        if how == "~=":
            return value in have.split()
        if how == "|=":
            return have == value or have.startswith(f"{value}-")
        if not value:
            return False
        return have.startswith(value) if how == "^=" else have.endswith(value) if how == "$=" else value in have

    return test


def _nth(a: int, b: int, last: bool, typed: bool, of: list[Chain] | None = None) -> Test:
    def test(n: Node, scope: Scope) -> bool:
        held, at = scope.siblings(n)
        if of is not None and not any(fits(n, c, scope) for c in of):
            return False
        same = held[at:] if last else held[: at + 1]
        place = sum((not typed or x.tag == n.tag) and (of is None or any(fits(x, c, scope) for c in of)) for x in same) if typed or of else len(same)
        return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0

    return test


def _both(x: Test, y: Test) -> Test:
    return lambda n, s: x(n, s) and y(n, s)


_PLAIN: dict[str, Test] = {
    "first-child": _nth(0, 1, False, False), "last-child": _nth(0, 1, True, False), "first-of-type": _nth(0, 1, False, True), "last-of-type": _nth(0, 1, True, True),
    "only-child": _both(_nth(0, 1, False, False), _nth(0, 1, True, False)), "only-of-type": _both(_nth(0, 1, False, True), _nth(0, 1, True, True)),
    "empty": lambda n, _: not any(not isinstance(c, str) or c for c in n.children), "root": lambda n, _: n.parent is not None and n.parent.tag == "#document",
}


def _related(n: Node, joint: str, scope: Scope) -> Iterator[Node]:
    """Elements that may stand on the left of ``joint`` before n, the nearest first."""
    if joint in (" ", ">"):
        above = n.parent
        while above is not None:
            yield above
            above = above.parent if joint == " " else None
    else:
        held, at = scope.siblings(n)
        yield from (held[at - 1 : at] if joint == "+" else held[:at][::-1])


def fits(n: Node, chain: Chain, scope: Scope, k: int = -1, anchor: Node | None = None) -> bool:
    """Whether n is what the chain up to compound ``k`` selects, below or after ``anchor`` if there is one."""
    k = len(chain.compounds) - 1 if k < 0 else k
    if not chain.compounds[k].fits(n, scope):
        return False
    if k == 0:
        return anchor is None or any(x is anchor for x in _related(n, chain.joints[0], scope))
    return any(fits(x, chain, scope, k - 1, anchor) for x in _related(n, chain.joints[k], scope))


def _has(n: Node, chain: Chain, scope: Scope) -> bool:
    if chain.joints[0] in (" ", ">"):
        return any(fits(x, chain, scope, anchor=n) for x in n.walk())
    held, at = scope.siblings(n)
    return any(fits(x, chain, scope, anchor=n) for s in held[at + 1 :] for x in (s, *s.walk()))


@lru_cache(maxsize=256)
def compile_selector(css: str) -> list[Chain]:
    """The alternatives of a selector; one that isn't known raises."""
    return Parser(css).chains()


def select(root: Node, css: str) -> list[Node]:
    """Elements that match, in document order."""
    chains, scope = compile_selector(css), Scope()
    return [n for n in root.walk() if any(fits(n, c, scope) for c in chains)]
