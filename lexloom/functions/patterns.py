"""Patterns that have one text for Spark's (Java) and for other engines' expressions."""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import let

#: Java's \b follows Unicode; the data contract's follows ASCII.
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str) -> str:
    return pattern.replace(r"\b", BOUNDARY)


def _leaner(words: set[str]) -> set[str]:
    """Without words that hold another of the set."""
    return {w for w in words if not any(v != w and v in w for v in words)}


def _needed(tree) -> set[str]:
    """Literals of which any match of a parsed pattern holds one; empty if none is known."""
    found, run = [], ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        found.append({run} - {""})
        run = ""
        if name == "SUBPATTERN":
            found.append(_needed(arg[-1]) if not arg[1] and not arg[2] else set())
        elif name == "BRANCH":
            parts = [_needed(x) for x in arg[1]]
            found.append(set().union(*parts) if all(parts) else set())
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            found.append(_needed(arg[2]))
    found = [_leaner(x) for x in [*found, {run} - {""}] if x]
    # Longer literals are rarer; of equal ones, fewer are cheaper.
    return max(found, key=lambda x: (min(min(map(len, x)), 5), -len(x)), default=set())


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Literals of which every text that a portable pattern matches holds one; none if that is not known."""
    try:
        words = _needed(re._parser.parse(pattern))
    except re.error:
        return ()
    return tuple(sorted(words, key=lambda w: (-len(w), w)))


def holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def may_match(text: Column, pattern: str, ignore_case: bool = False, low: Column | None = None) -> Column | None:
    """A test for literals that is far cheaper than the expression, and true for every text that it matches; null for
    null, None where the pattern needs no literal. low: the text in lower case, if it is at hand."""
    words = needed(pattern)
    if ignore_case:
        # Only ASCII letters match either case.
        words = tuple(dict.fromkeys(w.lower() for w in words)) if all(w.isascii() for w in words) else ()
        if words:
            return holds(low, words) if low is not None else let(F.lower(text), lambda x: holds(x, words))
    return holds(text, words) if words else None


def matches(text: Column, pattern: str, ignore_case: bool = False, low: Column | None = None) -> Column:
    found = text.rlike(("(?i)" if ignore_case else "") + java(pattern))
    guard = may_match(text, pattern, ignore_case, low)
    return found if guard is None else guard & found


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, java(pattern), group)


def extracted(text: Column, pattern: str, group: int, ignore_case: bool = False, low: Column | None = None) -> Column:
    """The trimmed group of the first match; null if there is none, or it is empty."""
    found = F.nullif(F.trim(F.regexp_extract(text, ("(?i)" if ignore_case else "") + java(pattern), group)), F.lit(""))
    guard = may_match(text, pattern, ignore_case, low)
    return found if guard is None else F.when(guard, found)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_matches(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {sql_text(pattern)}{', ' + sql_text('i') if ignore_case else ''})"


def sql_case(key: str, values: dict, default: str = "NULL") -> str:
    """CASE key WHEN … for lookup tables in SQL."""
    quote = lambda x: sql_text(x) if isinstance(x, str) else str(x)
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + f" ELSE {default} END"


def lookup(key: Column, values: dict) -> Column:
    """A lookup table as a map literal; null for other keys."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]
