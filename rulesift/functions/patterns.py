"""Rule patterns: safety gate and translation to the JVM's regular expressions. Packs are small; this runs on the driver."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that no pattern may match emptily.
PROBES = ("", "a", "금지 문구")


def has_backreference(pattern: str) -> bool:
    """An unescaped ``\\1`` to ``\\9`` or ``\\k<``: the digit follows an odd number of backslashes."""
    return any(len(m[1]) % 2 for m in re.finditer(r"(\\+)(?=[1-9]|k<)", pattern))


def has_lookbehind(pattern: str) -> bool:
    return bool(re.search(r"(?<!\\)(?:\\\\)*\(\?<[=!]", pattern))


def problem(pattern: str) -> str | None:
    """Why a pattern is refused, or None."""
    if not pattern:
        return "empty"
    if has_backreference(pattern):
        return "backreference"
    if has_lookbehind(pattern):
        return "lookbehind"
    try:
        compiled = re.compile(pattern, re.IGNORECASE)
    except re.error:
        return "syntax"
    if any((m := compiled.search(p)) and not m[0] for p in PROBES):
        return "empty match"
    return None


def literal(text: str) -> str:
    return re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", text)


def jvm(pattern: str, is_literal: bool, ignore_case: bool) -> str:
    """One capture group around the whole. Regular expressions always ignore case, literals if they ask for it; dots know no other line ends than scripts do."""
    body = literal(pattern) if is_literal else pattern
    return f"(?{'iu' if ignore_case or not is_literal else ''})({body})".replace("(?)(", "(")


# --- required literals ------------------------------------------------------------------------------------------

#: Literals that a pattern is told by at most, and members of a character class that are written out.
LITERALS, MEMBERS = 24, 6
#: Letters beyond ASCII that match one of ASCII where case is ignored, and that one.
_LIKE = ("\u212a\u017f\u0131\u0130", "ksii")


def fold(text: Column) -> Column:
    """The form of a text that required literals are looked for in."""
    return F.lower(F.translate(text, *_LIKE))


def _folded(c: str) -> str | None:
    """The character in folded texts; None if that could be another one there."""
    if c.isascii():
        return c.lower()
    return c if c == c.lower() == c.upper() and c not in _LIKE[0] else None


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets of literals, one of which is in every match, the one that tells more."""
    usable = [x for x in (a, b) if x and min(map(len, x))]
    return max(usable, key=lambda x: (min(min(map(len, x)), 6), -len(x), min(map(len, x))), default=None)


def _sequence(nodes) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    """exact: all texts that the parsed nodes match, if these are few; needed: literals one of which every match has."""
    run, whole, needed = frozenset([""]), True, None
    for name, value in nodes:
        exact, inner = _node(str(name), value)
        if exact is not None and len(run) * len(exact) <= LITERALS:
            run = frozenset(a + b for a, b in product(run, exact))
            continue
        needed = _better(_better(needed, run), inner)
        run, whole = (frozenset([""]), False) if exact is None else (exact, False)
    return run if whole else None, _better(needed, run)


def _node(name: str, value) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    nothing = frozenset([""])
    if name == "LITERAL":
        c = _folded(chr(value))
        return (None, None) if c is None else (frozenset([c]), None)
    if name == "IN":
        members = set()
        for kind, x in value:
            codes = [x] if str(kind) == "LITERAL" else range(x[0], x[1] + 1) if str(kind) == "RANGE" and x[1] - x[0] < MEMBERS else None
            if codes is None or any(_folded(chr(c)) is None for c in codes):
                return None, None
            members |= {_folded(chr(c)) for c in codes}
        return (frozenset(members), None) if len(members) <= MEMBERS else (None, None)
    if name == "SUBPATTERN":
        return _sequence(value[3])
    if name == "ATOMIC_GROUP":
        return _sequence(value)
    if name == "BRANCH":
        parts = [_sequence(x) for x in value[1]]
        exact = frozenset().union(*[x for x, _ in parts]) if all(x is not None for x, _ in parts) else None
        each = [_better(x, n) for x, n in parts]
        needed = frozenset().union(*each) if all(each) else None
        few = lambda x: x if x is not None and len(x) <= LITERALS else None
        return few(exact), few(needed)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = value
        exact, needed = _sequence(body)
        if not least:
            return (exact | nothing, None) if most == 1 and exact is not None else (None, None)
        return (exact, needed) if least == most == 1 else (None, _better(exact, needed))
    return (nothing, None) if name in ("AT", "ASSERT", "ASSERT_NOT") else (None, None)


def required(pattern: str, is_literal: bool) -> tuple[str, ...] | None:
    """Literals one of which the folded form of every text has that the pattern matches in; None if none can be told."""
    from re import _parser  # the parser that compiled the pattern when it was let in

    found = _better(*_sequence(_parser.parse(literal(pattern) if is_literal else pattern)))
    return tuple(sorted(found)) if found else None
