"""Regular expressions of rule files: their tokens, and the literals that every match must contain.

Rules are configuration, so all of this runs on the driver, once a rule. A
pattern is read into tokens with the flags that hold where each stands; the
tokens serve to count groups, to translate between dialects and to derive
anchors. What a token means beyond that is left to the engine that runs the
pattern: an unknown construct only ends a literal.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

# An AND of ORs of lower-case literals.
Clauses = tuple[tuple[str, ...], ...]

MAX_STRINGS = 16  # alternatives of one literal
MAX_PRODUCT = 4
MAX_LENGTH = 40
MAX_CLAUSES = 6

_CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}
_ZERO_WIDTH = "bBAzZG"
_LOOK = ("(?=", "(?<=", "(?!", "(?<!")


@dataclass(frozen=True)
class Token:
    """A piece of a pattern.

    ``kind`` is one of chars (one character out of ``chars``; None if any), empty
    (matches nothing), open, close, or, repeat (``least`` to ``most`` times, None
    for no end), flags and space (comments and blanks under the x flag).
    """

    kind: str
    text: str
    flags: frozenset[str] = frozenset()
    chars: frozenset[str] | None = None
    least: int = 0
    most: int | None = None


def _class_end(pattern: str, at: int) -> int:
    """Place behind the class that begins at ``at``; a bracket that comes first is a member."""
    i = at + 1
    if pattern[i : i + 1] == "^":
        i += 1
    if pattern[i : i + 1] == "]":
        i += 1
    while i < len(pattern) and pattern[i] != "]":
        if pattern[i] == "\\":
            i += 2
        elif pattern[i] == "[":
            i = _class_end(pattern, i)
        else:
            i += 1
    return i + 1


def _class_members(text: str, verbose: bool) -> frozenset[str] | None:
    """The characters of a plain small class; None for any other."""
    body = text[1:-1]
    if verbose or body.startswith("^") or "[" in body or "&&" in body:
        return None
    out: set[str] = set()
    for m in re.finditer(r"\\(.)|(.)-([^\\])|(.)", body, re.S):
        escaped, low, high, one = m.groups()
        if escaped is not None:
            if escaped.isalnum() and escaped not in _CONTROL:
                return None
            out.add(_CONTROL.get(escaped, escaped))
        elif low is not None:
            if not 0 <= ord(high) - ord(low) < MAX_PRODUCT:
                return None
            out.update(map(chr, range(ord(low), ord(high) + 1)))
        else:
            out.add(one)
    return frozenset(out) if 0 < len(out) <= MAX_PRODUCT else None


def _escape(pattern: str, at: int, flags: frozenset[str]) -> Token:
    """The token of the escape that begins at ``at``."""
    c = pattern[at + 1 : at + 2]
    if c in _ZERO_WIDTH and c:
        m = re.compile(r"\\b\{[a-z-]+\}").match(pattern, at)
        return Token("empty", m.group() if m else pattern[at : at + 2], flags)
    if m := re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|[xuU]\{([0-9A-Fa-f]+)\})").match(pattern, at):
        return Token("chars", m.group(), flags, frozenset(chr(int(m.group(1) or m.group(2) or m.group(3), 16))))
    if m := re.compile(r"\\(?:[pP](?:\{[^}]*\}|.)|k<[^>]*>|N\{[^}]*\}|0[0-7]{1,3}|[0-9]+|c.|[xuU]\S*)").match(pattern, at):
        return Token("back" if c in "k123456789" else "chars", m.group(), flags)
    if c in _CONTROL and c:
        return Token("chars", pattern[at : at + 2], flags, frozenset(_CONTROL[c]))
    return Token("chars", pattern[at : at + 2], flags, None if c.isalnum() or not c else frozenset(c))


def tokens(pattern: str) -> Iterator[Token]:
    """``pattern`` piece by piece; the texts of all tokens make up the pattern."""
    stack: list[frozenset[str]] = []
    flags: frozenset[str] = frozenset()
    at = 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("\\Q", at):
            end = pattern.find("\\E", at)
            end = len(pattern) if end < 0 else end
            yield Token("space", "\\Q", flags)
            yield from (Token("chars", x, flags, frozenset(x)) for x in pattern[at + 2 : end])
            if pattern[end : end + 2]:
                yield Token("space", "\\E", flags)
            at = end + 2
            continue
        if c == "\\":
            token = _escape(pattern, at, flags)
        elif c == "[":
            text = pattern[at : _class_end(pattern, at)]
            token = Token("chars", text, flags, _class_members(text, "x" in flags))
        elif "x" in flags and (c.isspace() or c == "#"):
            m = re.compile(r"\s+|#[^\n]*").match(pattern, at)
            token = Token("space", m.group(), flags)
        elif m := re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])").match(pattern, at):
            now = (flags | set(m.group(1))) - set(m.group(2) or "")
            if m.group(3) == ":":
                stack.append(flags)
            token = Token("open" if m.group(3) == ":" else "flags", m.group(), now)
            flags = now
        elif c == "(":
            m = re.compile(r"\((?:\?(?:P?<[A-Za-z_][A-Za-z0-9_.]*>|<?[=!]|>))?").match(pattern, at)
            stack.append(flags)
            token = Token("open", m.group(), flags)
        elif c == ")":
            flags = stack.pop() if stack else flags
            token = Token("close", c, flags)
        elif c == "|":
            token = Token("or", c, flags)
        elif m := re.compile(r"(?:([*+?])|\{([0-9]+)(?:(,)([0-9]*))?\})[?+]?").match(pattern, at):
            sign, least, comma, most = m.groups()
            if sign:
                low, high = (1 if sign == "+" else 0), (1 if sign == "?" else None)
            else:
                low, high = int(least), int(least) if not comma else int(most) if most else None
            token = Token("repeat", m.group(), flags, least=low, most=high)
        elif c in "^$":
            token = Token("empty", c, flags)
        elif c == ".":
            token = Token("chars", c, flags)
        else:
            token = Token("chars", c, flags, frozenset(c))
        yield token
        at += len(token.text)


def group_count(pattern: str) -> int:
    """Number of capturing groups."""
    return sum(t.kind == "open" and (t.text == "(" or t.text.endswith(">") and t.text != "(?>") for t in tokens(pattern))


# --- anchors ----------------------------------------------------------------


@dataclass(frozen=True)
class _Known:
    """What is known of a part: all strings it can match (lowered), if few; and clauses that hold for every match."""

    strings: frozenset[str] | None
    clauses: tuple[frozenset[str], ...] = ()

    def required(self) -> tuple[frozenset[str], ...]:
        return (*self.clauses, *_clause(self.strings))


_NOTHING = _Known(frozenset([""]))
_ANYTHING = _Known(None)


def _clause(strings: Iterable[str] | None) -> tuple[frozenset[str], ...]:
    """The clause "one of these", without strings that hold another one; none if the empty string is among them."""
    if strings is None or "" in strings:
        return ()
    return (frozenset(s for s in strings if not any(o != s and o in s for o in strings)),)


def _telling(clause: frozenset[str]) -> tuple[int, int]:
    return min(map(len, clause)), -len(clause)


def _sequence(parts: Iterable[_Known]) -> _Known:
    strings, whole, clauses = frozenset([""]), True, []
    for part in parts:
        clauses += part.clauses
        # Optional pieces between words would multiply: beyond MAX_PRODUCT the words become clauses of their own.
        if part.strings is not None and len(strings) * len(part.strings) <= max(MAX_PRODUCT, len(strings), len(part.strings)):
            longer = frozenset(a + b for a in strings for b in part.strings)
            if max(map(len, longer)) <= MAX_LENGTH:
                strings = longer
                continue
        clauses += _clause(strings)
        strings, whole = part.strings if part.strings is not None else frozenset([""]), False
    if whole:
        return _Known(strings, tuple(clauses))
    return _Known(None, (*clauses, *_clause(strings)))


def _either(branches: list[_Known]) -> _Known:
    if len(branches) == 1:
        return branches[0]
    if all(b.strings is not None for b in branches):
        strings = frozenset().union(*[b.strings for b in branches])
        if len(strings) <= MAX_STRINGS:
            return _Known(strings)
    ranked = [sorted(b.required(), key=_telling, reverse=True) for b in branches]
    together = [frozenset().union(*row) for row in zip(*ranked, strict=False)]
    return _Known(None, tuple(c for row in together if len(row) <= 2 * MAX_STRINGS for c in _clause(row)))


def _repeated(part: _Known, least: int, most: int | None) -> list[_Known]:
    if most == 0:
        return [_NOTHING]
    if least == 0:
        return [_Known(part.strings | {""})] if most == 1 and part.strings is not None else [_ANYTHING]
    times = [part] * min(least, MAX_LENGTH)
    return times if least == most and least <= MAX_LENGTH else [*times, _ANYTHING]


def _parse(stream: list[Token], at: int) -> tuple[_Known, int]:
    """What is known of the alternatives from ``at`` up to the closing bracket or the end, and where that is."""
    branches, parts = [], []
    last: list[_Known] | None = None  # what a following repeat applies to
    while at < len(stream) and stream[at].kind != "close":
        t = stream[at]
        if t.kind == "or":
            branches.append(_sequence([*parts, *(last or [])]))
            parts, last = [], None
        elif t.kind == "repeat" and last is not None:
            last = _repeated(_sequence(last), t.least, t.most)
        elif t.kind != "space":
            parts += last or []
            if t.kind == "open":
                inner, at = _parse(stream, at + 1)
                if t.text in _LOOK:
                    # What must stand beside the match also stands in the text.
                    inner = _Known(_NOTHING.strings, inner.required() if t.text.endswith("=") else ())
                last = [inner]
            elif t.kind in ("empty", "flags"):
                last = [_NOTHING]
            elif t.kind == "chars" and t.chars is not None and all(c.isascii() for c in t.chars):
                last = [_Known(frozenset(c.lower() for c in t.chars))]
            else:
                last = [_ANYTHING]
        at += 1
    branches.append(_sequence([*parts, *(last or [])]))
    return _either(branches), at


def derive_anchors(pattern: str) -> Clauses:
    """An AND of ORs of literals, the most telling first: the lower-cased text of any match holds one of each.

    Empty where nothing is required. Under the x flag blanks and comments are
    skipped. Characters that are not ASCII end a literal, as do classes of many
    characters, references and unknown constructs.
    """
    stream = list(tokens(pattern))
    known, end = _parse(stream, 0)
    if end != len(stream):  # brackets that don't match: left to the engine
        return ()
    clauses: list[frozenset[str]] = []
    for clause in sorted(set(known.required()), key=lambda c: (*_telling(c), sorted(c)), reverse=True):
        # A clause that a stronger one implies tells nothing new.
        if not any(all(any(a in b for a in clause) for b in held) for held in clauses):
            clauses.append(clause)
    return tuple(tuple(sorted(c)) for c in clauses[:MAX_CLAUSES])
