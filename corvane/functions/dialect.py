"""Python regular expressions and string methods in Spark's terms."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


_LISTED = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def java_regex(pattern: str, flags: str = "") -> str:
    """The Java form of a Python pattern: Unicode classes and case, ``\\n`` as the only line end.

    Rewrites what Java reads differently: ``{,n}``, a ``[`` or ``&&`` inside a class, ``\\Z``. ASCII letters and
    digits of a range are listed where case counts: Java looks listed characters up in one table, but asks
    one range after another.
    """
    out, in_class, k = [], False, 0
    listed = "i" not in flags and not ignores_case(pattern)
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            pair = pattern[k : k + 2]
            out.append("\\z" if pair == "\\Z" and not in_class else pair)
            k += 2
            continue
        if in_class:
            first = out[-1] in ("[", "[^")
            a, dash, z = (pattern[k : k + 3] + "   ")[:3]
            if listed and dash == "-" and any(a in x and z in x and a <= z for x in _LISTED):
                out.append("".join(map(chr, range(ord(a), ord(z) + 1))))
                k += 3
                continue
            if c == "]" and not first:
                in_class = False
                out.append(c)
            elif c in "[]" or c == "&" and pattern[k + 1 : k + 2] == "&":
                out.append("\\" + c)
            else:
                out.append(c)
            k += 1
            continue
        if c == "[":
            in_class = True
            head = "[^" if pattern[k + 1 : k + 2] == "^" else "["
            out.append(head)
            k += len(head)
            continue
        m = re.match(r"\{,(\d+)\}", pattern[k:])
        if m:
            out.append("{0," + m[1] + "}")
            k += len(m[0])
            continue
        out.append(c)
        k += 1
    return f"(?Uud{flags})" + "".join(out)


def fault(pattern: str, flags: str = "is") -> str | None:
    """Why a pattern can't be used, null if it can: it must be a Python pattern whose Java form compiles."""
    try:
        re.compile(pattern)
    except (re.error, TypeError, OverflowError, RecursionError) as bad:
        return str(bad)
    context = SparkContext._active_spark_context
    if context is not None and context._jvm is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java_regex(pattern, flags))
        except Py4JJavaError as bad:
            return str(bad.java_exception.getMessage()).split("\n")[0]
    return None


def compiles(pattern: str, flags: str = "is") -> bool:
    return fault(pattern, flags) is None


def _is_space(op, arg) -> bool:
    """Whether an item matches one character, and white space only."""
    name = str(op)
    if name == "LITERAL":
        return chr(arg).isspace()
    if name != "IN":
        return False
    one = {"LITERAL": lambda x: chr(x).isspace(), "RANGE": lambda x: x[1] - x[0] < 64 and all(chr(c).isspace() for c in range(x[0], x[1] + 1)), "CATEGORY": lambda x: str(x) == "CATEGORY_SPACE"}
    return all(str(o) in one and one[str(o)](x) for o, x in arg)


def required(pattern: str, squeezed: bool = False) -> list[frozenset[str]]:
    """Sets of strings of which every match holds at least one each, the most telling sets first.

    A search for plain strings is many times faster than a regular expression, so detectors ask
    for these first. Case is left as in the pattern; a pattern may have no such set. ``squeezed``
    is for texts in which each run of white space is one space, with one at either end: there
    ``two\\s+words`` needs the string ``two words``.
    """

    def weight(s: frozenset[str]) -> tuple[int, int]:
        return min(map(len, s)), -len(s)

    def needs(items) -> list[frozenset[str]]:
        found, run = [], ""
        for op, arg in items:
            name = str(op)
            repeat = name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT")
            if squeezed:
                many = repeat and len(arg[2]) == 1 and _is_space(*arg[2][0])
                if _is_space(op, arg) or many and arg[0] > 0:
                    run = run if run.endswith(" ") else run + " "
                    continue
                if many and run.endswith(" "):  # more of it changes nothing
                    continue
            if name == "LITERAL":
                run += chr(arg)
                continue
            if name == "AT":
                continue
            if run:
                found.append(frozenset([run]))
                run = ""
            if name == "SUBPATTERN":
                found += needs(arg[-1])
            elif repeat and arg[0] > 0:
                found += needs(arg[2])
            elif name == "IN" and len(arg) <= 3 and all(str(o) == "LITERAL" for o, _ in arg):
                found.append(frozenset(chr(c) for _, c in arg))
            elif name == "BRANCH":
                best = [max(needs(b), key=weight, default=None) for b in arg[1]]
                if all(best):
                    found.append(frozenset().union(*best))
        if run:
            found.append(frozenset([run]))
        return found

    kept = [s for s in needs(re._parser.parse(pattern)) if len(s) <= 24 and all(x.isascii() for x in s)]
    return sorted(set(kept), key=lambda s: (-min(map(len, s)), len(s), sorted(s)))


def ignores_case(pattern: str) -> bool:
    """Whether a pattern, or a part of it, ignores case by a flag that it sets itself."""

    def within(items) -> bool:
        for op, arg in items:
            if str(op) == "SUBPATTERN" and arg[1] & re.IGNORECASE:
                return True
            if str(op) == "BRANCH":
                inner = arg[1]
            else:
                inner = [x for x in (arg if isinstance(arg, (tuple, list)) else [arg]) if isinstance(x, re._parser.SubPattern)]
            if any(within(x) for x in inner):
                return True
        return False

    tree = re._parser.parse(pattern)
    return bool(tree.state.flags & re.IGNORECASE) or within(tree)


def folded(text: Column) -> Column:
    """Lower case in which every letter that a pattern without case takes for an ASCII one is that one."""
    plain = F.lower(text)
    return F.when(text.rlike("[\u0130\u0131\u017f\u212a]"), F.translate(plain, "\u0131\u017f\u0307", "is")).otherwise(plain)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\x00", "\\0") + "'"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held(value: Column) -> Column:
    """``value``, computed where it stands. A filter on anything made of it isn't pushed below it: the
    optimizer would write the whole detector into the filter, and compute it twice. (What looks random is
    always true.)"""
    return F.when(F.rand(0) + 1 > 0, value)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def words(col: Column) -> Column:
    """Pieces between runs of white space, none empty."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda x: x != "")


def count_of(text: Column, kind: str) -> Column:
    """How many code points of a text are in a character class, given without its brackets."""
    return F.length(F.regexp_replace(text, f"(?U)[^{kind}]+", ""))


def found(text: Column, pattern: str, flags: str = "is") -> Column:
    return text.rlike(java_regex(pattern, flags))


def first_match(text: Column, pattern: str, flags: str = "is", limit: int | None = None) -> Column:
    out = F.regexp_extract(text, java_regex(pattern, flags), 0)
    return out if limit is None else F.substring(out, 1, limit)


def escaped(col: Column) -> Column:
    """Like ``re.escape`` for letters, digits, underscore and spaces."""
    return F.regexp_replace(col, r"([^\p{L}\p{N}_])", r"\\$1")


def double_sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda a, x: a + x)
