"""Python regular expressions on the JVM: translation, routing and match offsets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_java(pattern: str, ignore_case: bool = True, dotall: bool = False) -> str:
    """The same expression for java.util.regex.

    Flags: m as in rules, d so that only \\n ends a line, U for Unicode classes."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\":
            out.append("\\z" if two == "\\Z" else two)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[" or two == "&&":
                c = "\\" + c
            out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
            for extra in ("^", "]"):  # a ] in first place is a member
                if pattern[i + 1 : i + 2] == extra:
                    i += 1
                    out.append("\\]" if extra == "]" else extra)
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(f"\\k<{pattern[i + 4 : end]}>")
            i = end
        else:
            out.append(c)
        i += 1
    return f"(?mdU{'i' * ignore_case}{'s' * dotall})" + "".join(out)


def needs_python(pattern: str) -> bool:
    """Whether a group with an alternation or a quantifier in it is itself repeated.

    java.util.regex recurses on such groups and can overflow the stack on long text."""
    stack: list[bool] = []
    i, inside = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            i += pattern[i + 1 : i + 2] == "^"
            i += pattern[i + 1 : i + 2] == "]"
        elif c == "(":
            stack.append(False)
        elif c == ")" and stack:
            risky = stack.pop()
            if risky and pattern[i + 1 : i + 2] in ("*", "+", "{"):
                return True
            if stack and risky:
                stack[-1] = True
        elif c in "|*+{" and stack:
            stack[-1] = True
        i += 1
    return False


CHUNK = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def finditer(text: Column, java: str) -> Column:
    """``array<struct<start int, feeds int, column int, match string>>`` in code points, as ``re.finditer`` gives them.

    ``feeds`` line feeds stand before the start and ``column`` characters between the
    last of them and it.  The pattern must not match the empty string.  Matches and the
    gaps between them are bound once and measured once; sums run over chunks, so the
    work grows with the text and about with the number of matches."""
    found = F.struct(F.regexp_extract_all(text, F.lit(java), F.lit(0)).alias("m"), F.split(text, java, -1).alias("g"))

    def size_of(s: Column) -> Column:
        """Characters, line feeds, and characters after the last feed."""
        return F.struct(F.length(s).alias("n"), (F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))).alias("feeds"), F.length(F.substring_index(s, "\n", -1)).alias("tail"))

    def after(at: Column, s: Column) -> Column:
        return F.struct((at["n"] + s["n"]).alias("n"), (at["feeds"] + s["feeds"]).alias("feeds"), F.when(s["feeds"] > 0, s["tail"]).otherwise(at["tail"] + s["n"]).alias("tail"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("feeds"), F.lit(0).alias("tail"))
    none = F.array().cast("array<struct<n:int,feeds:int,tail:int>>")

    def running(sizes: Column, begin: Column) -> Column:
        """What stands before each but the first of ``sizes``, from ``begin`` on, and after the last."""
        state = F.struct(begin.alias("at"), none.alias("out"))
        step = lambda acc, s: F.struct(after(acc["at"], s).alias("at"), F.concat(acc["out"], F.array(after(acc["at"], s))).alias("out"))
        return F.aggregate(sizes, state, step)["out"]

    def places(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, after))
        begins = F.slice(F.concat(F.array(zero), running(totals, zero)), F.lit(1), F.size(chunks))
        return F.flatten(F.zip_with(chunks, begins, running))

    def offsets(z: Column) -> Column:
        sizes = F.flatten(F.zip_with(F.transform(z["g"], size_of), F.transform(z["m"], size_of), lambda a, b: F.array(a, F.coalesce(b, zero))))
        last = lambda x: F.floor((F.size(x) - 1) / CHUNK).cast("int")
        chunks = bound(sizes, lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK))))
        starts = F.filter(bound(chunks, places), lambda _, i: i % 2 == 0)  # what stands before each match: all up to the gap
        return F.zip_with(z["m"], F.slice(starts, F.lit(1), F.size(z["m"])), lambda m, at: F.struct(at["n"].alias("start"), at["feeds"].alias("feeds"), at["tail"].alias("column"), m.alias("match")))

    return bound(found, offsets)


def compile_rule(pattern: str, ignore_case: bool = True, dotall: bool = False) -> re.Pattern[str]:
    return re.compile(pattern, re.M | (re.I if ignore_case else 0) | (re.S if dotall else 0))
