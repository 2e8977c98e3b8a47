"""One parsed tree for validator patterns (T4, G7): the same tree is matched
against tokens, as a regular expression the JVM runs, and drawn from, as a
column of hashed draws.

A pattern is a list of alternatives (``|``). An alternative is a chain of
character sets, each with a count (``?``, ``*``, ``+``, ``{a}``, ``{a,b}``; none is
once), and may end in a group of alternatives. A chain takes as many characters of
a set as it can, up to the count, and never gives one back; alternatives are each
tried to the end of the text. Unescaped blanks mean nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """``lo`` to ``hi`` (None: any number) characters of ``choices``, then one of ``children``.

    ``choices`` are byte values; one written twice counts twice when drawing. A node of
    alternatives alone has no choices and the count 0."""
    choices: tuple[int, ...]
    lo: int
    hi: int | None
    children: tuple["Node", ...]


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        self.marks: list[tuple[int, bool]] = []  # byte, is it a command
        data, i = pattern.encode(), 0
        while i < len(data):
            if data[i:i + 1] == b"\\":
                i += 1
                if i == len(data):
                    raise self.illegal("ends in a backslash")
                self.marks.append((data[i], False))
            elif data[i:i + 1] != b" ":
                self.marks.append((data[i], True))
            i += 1

    def illegal(self, why: str) -> ValueError:
        return ValueError(f"pattern {self.pattern!r} {why}")

    def sees(self, commands: str) -> bool:
        if self.at == len(self.marks):
            return False
        byte, command = self.marks[self.at]
        return command and byte in commands.encode()

    def take(self) -> int:
        if self.at == len(self.marks):
            raise self.illegal("ends too early")
        self.at += 1
        return self.marks[self.at - 1][0]

    def alternatives(self) -> tuple[Node, ...]:
        found = [self.chain()]
        while self.sees("|"):
            self.take()
            found.append(self.chain())
        return tuple(found)

    def chain(self) -> Node:
        if self.at == len(self.marks) or self.sees("|)"):
            raise self.illegal("has an empty alternative")
        if self.sees("("):
            return Node((), 0, 0, self.group())
        choices = self.choices()
        lo, hi = self.count()
        if self.sees("("):
            return Node(choices, lo, hi, self.group())
        if self.at == len(self.marks) or self.sees("|)"):
            return Node(choices, lo, hi, ())
        return Node(choices, lo, hi, (self.chain(),))

    def group(self) -> tuple[Node, ...]:
        self.take()
        inner = self.alternatives()
        if not self.sees(")"):
            raise self.illegal("has an unclosed group")
        self.take()
        if self.at < len(self.marks) and not self.sees("|)"):
            raise self.illegal("goes on after a group")
        return inner

    def choices(self) -> tuple[int, ...]:
        if not self.sees("["):
            return (self.take(),)
        self.take()
        negated = self.sees("^")
        if negated:
            self.take()
        found: list[int] = []
        held: int | None = None  # may begin a range
        depth = 0
        while not self.sees("]"):
            if self.sees("|"):
                raise self.illegal("has an unescaped | in a set")
            depth += self.sees("(") - self.sees(")")
            if self.sees("-") and held is not None:
                self.take()
                if self.sees("]"):
                    found.append(held)
                    held = ord("-")
                    continue
                end = self.take()
                if _signed(held) > _signed(end):
                    raise self.illegal("has a range that falls")
                found.extend(b % 256 for b in range(_signed(held), _signed(end) + 1))
                held = None
            else:
                if held is not None:
                    found.append(held)
                held = self.take()
        self.take()
        if depth:
            raise self.illegal("has unbalanced parentheses in a set")
        if held is not None:
            found.append(held)
        if negated:
            return tuple(b for b in range(255) if b not in found)
        return tuple(sorted(found, key=_signed))

    def count(self) -> tuple[int, int | None]:
        for command, lo, hi in (("?", 0, 1), ("*", 0, None), ("+", 1, None)):
            if self.sees(command):
                self.take()
                return lo, hi
        if not self.sees("{"):
            return 1, 1
        self.take()
        parts = [""]
        while not self.sees("}"):
            if self.sees(","):
                self.take()
                parts.append("")
            else:
                parts[-1] += chr(self.take())
        self.take()
        if len(parts) > 1 and not parts[-1]:
            parts.pop()  # {a,} is {a}
        if len(parts) > 2 or not all(p.isdecimal() for p in parts) or int(parts[0]) > int(parts[-1]):
            raise self.illegal("has an unclear count")
        return int(parts[0]), int(parts[-1])


def _signed(byte: int) -> int:
    return byte - 256 if byte > 127 else byte


def parse(pattern: str) -> Node:
    """The tree of a pattern; ValueError if it is not legal."""
    r = _Reader(pattern)
    found = r.alternatives()
    if r.at < len(r.marks):
        raise r.illegal("closes a group that is not open")
    return found[0] if len(found) == 1 else Node((), 0, 0, found)


# -- matching -------------------------------------------------------------

def _set(choices: tuple[int, ...]) -> str:
    members, out = sorted(set(choices)), []
    while members:
        first = last = members.pop(0)
        while members and members[0] == last + 1:
            last = members.pop(0)
        out.append(f"\\x{first:02x}" + (f"-\\x{last:02x}" if last > first else ""))
    return "[" + "".join(out) + "]"


def regex(node: Node) -> str:
    """The tree as a Java expression over bytes: counts are possessive, so no character is given back."""
    own = ""
    if node.hi != 0:
        if node.choices:
            own = _set(node.choices) + "{%d,%s}+" % (node.lo, "" if node.hi is None else node.hi)
        elif node.lo:
            own = "(?!)"  # characters of an empty set
    if node.children:
        own += "(?:" + "|".join(regex(c) for c in node.children) + ")"
    return own


def matches(token: Column, pattern: str) -> Column:
    """T4: does the whole token match? Characters are bytes of its UTF-8 form."""
    as_bytes = F.decode(F.encode(token, "UTF-8"), "ISO-8859-1")
    return as_bytes.rlike("^(?:" + regex(parse(pattern)) + ")\\z")


# -- drawing --------------------------------------------------------------

def drawn(pattern: str, draw, draw_at) -> Column:
    """A text of the pattern. ``draw(salt)`` is a uniform integer column, ``draw_at(salt, j)``
    one for position j. A count is uniform in its range, a character among its set's choices (one
    written twice is twice as likely), an alternative among all of its group. Texts use the
    characters 1..127; ``*`` and ``+`` are refused, as is a set without such characters.
    """
    numbers = iter(range(10_000))

    def column(node: Node) -> Column:
        n = next(numbers)
        if node.hi is None:
            raise ValueError(f"pattern {pattern!r}: '*' and '+' are not allowed when generating")
        parts = []
        if node.hi:
            alphabet = "".join(chr(b) for b in node.choices if 0 < b < 128)
            if not alphabet:
                raise ValueError(f"pattern {pattern!r}: a set has no character to draw")
            span = node.hi - node.lo + 1
            if node.hi == 1 and span == 1 and len(alphabet) == 1:
                parts.append(F.lit(alphabet))
            else:
                size = F.lit(node.lo) + draw(f"len{n}") % span if span > 1 else F.lit(node.lo)
                places = F.when(size > 0, F.sequence(F.lit(1), size.cast("int"))).otherwise(F.array().cast("array<int>"))
                parts.append(F.array_join(F.transform(places, lambda j: F.substring(
                    F.lit(alphabet), (draw_at(f"ch{n}", j) % len(alphabet) + 1).cast("int"), 1)), ""))
        if node.children:
            texts = [column(c) for c in node.children]
            if len(texts) > 1:
                pick = draw(f"alt{n}") % len(texts)
                chosen = F.when(pick == 0, texts[0])
                for k, t in enumerate(texts[1:], 1):
                    chosen = chosen.when(pick == k, t)
                texts = [chosen]
            parts.append(texts[0])
        return F.concat(*parts) if parts else F.lit("")

    return column(parse(pattern))
